"""Verdicts on URLs: rules first, then logistic regression on hashed character n-grams of host and path (operator 7).

DataFrame and SQL functions and Spark's own linear model only: URLs never leave the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of sites that a crawl would rather not fetch, and of sites that it may: the labels of the small URL table.
UNWANTED = """casino-bonus online-casino win-casino lucky-casino casino-games sports-bets bets-online free-bet betting-tips poker-bets cheap-meds
pills-online buy-pills diet-pills cheap-viagra cheap-watches adult-video adult-cams xxx-adult adult-dating sex-chat ads-server ads-click
ad-tracker track-click tracking-pixel pixel-track spam-mail spam-links seo-spam link-farm content-farm click-farm win-prize jackpot-win
lottery-win free-money free-gift fast-loan payday-loans fake-id crack-keygen malware-drop phish-login torrent-crack""".split()
WANTED = """city-library university research-group news-today evening-news gardening museum weather software-manual recipes history mathematics
townhall open-source radio hospital theatre school astronomy riverside nation the-other-thing bicycle chess poetry harbour northern-light
southern-star weather-station farmers-market travel-notes music-hall old-town railways physics chemistry biology philosophy parliament
court-records law-review teachers children-books painting sculpture opera cinema football athletics swimming mountain forest island
lighthouse bakery kitchen garden-design carpentry pottery knitting photography printing typography linguistics translation""".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: each name with the usual first labels and some paths, so that neither decides."""
    firsts, paths = ("", "www.", "m.", "blog."), ("/en/12.html", "/de/7/", "/fr/305?page=2", "/es/48#top", "/en/9", "/")
    return [(f"https://{first}{name}.test{paths[(k + n) % len(paths)]}", label) for label, names in ((1, UNWANTED), (0, WANTED)) for k, name in enumerate(names) for n, first in enumerate(firsts)]


def host_of(url: str) -> Column:
    """From behind the first :// to /, ?, # or the end, A-Z lowered; empty where the url is null or has no ://."""
    host = F.regexp_extract(F.col(url), r"(?s)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str) -> Column:
    """From behind the host to ?, # or the end."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, else null. rules: (verdict, host and path), a table of up
    to some hundreds; of equal rules the one that is last in order of verdict wins."""
    known = F.array(*(F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit(f"/{r.partition('/')[2]}").alias("path")) for v, r in rules))
    fits = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(fits)


def ngrams(host: Column, path: Column, sizes: Sequence[int] = (3, 4, 5)) -> Column:
    """The character n-grams of host and path, each marked by where it comes from."""

    def of(mark: str, text: Column) -> list[Column]:
        framed = F.concat(F.lit("^"), text, F.lit("$"))

        def grams(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(framed) - (n - 1), F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n))))

        return [grams(n) for n in sizes]

    return F.concat(*of("h", host), *of("p", F.lower(path)))


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]], features: int = 1 << 14) -> tuple[HashingTF, LogisticRegressionModel]:
    """The hashed n-gram features and the regression over them. The labelled table is small; it is fitted in one partition,
    so that the sums have one order."""
    rows = spark.range(1, numPartitions=1).select(F.inline(F.array(*(F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("label")) for u, y in labelled))))
    hashed = HashingTF(numFeatures=features, binary=True, inputCol="__grams", outputCol="__features")
    rows = hashed.transform(rows.withColumn("__grams", ngrams(host_of("url"), path_of("url"))).coalesce(1))
    return hashed, LogisticRegression(featuresCol="__features", labelCol="label", regParam=0.0001, maxIter=100, standardization=False, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__prediction").fit(rows)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: Sequence[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, block_score) of each row: the verdict (allow or block) is the longest fitting rule's,
    else the model's.

    A rule fits its host and all subdomains where the path starts with the rule's. A null url, or one without ://, has an
    empty host and path: no rule fits, the model judges the empty strings. Repeated rows are judged one by one; null ids
    and other columns make no difference; an empty table gives an empty result."""
    hashed, model = train(pages.sparkSession, labelled or labelled_urls())
    rows = pages.select(F.col(id_col).alias("__id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    rows = model.transform(hashed.transform(rows.withColumn("__grams", ngrams(F.col("host"), F.col("path")))))
    rows = rows.withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("block_score", vector_to_array("__p")[1])
    guess = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return rows.select(F.col("__id").alias(id_col), "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", guess).alias("verdict"), "block_score")
