"""Lines that many documents share (operator 6).

Line keys are held as 128-bit hashes in levelled sorted runs. Each batch of documents is merge-joined with the runs: keys
that enough documents hold are settled and go by an anti-join, new keys and raised counts make the batch's own sorted run
at level 0; when a level holds `fanout` runs they are merged into one run of the next level. The settled keys are the lines
to drop."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BUCKET, bucket_of, buckets, small_batches, stored, whole_text

KEYS = ["k1", "k2"]
BLANK, BLANK_BYTES = " \t\n\x0b\x0c\r", b" \t\n\x0b\x0c\r"


def line_keys(text: str, least: int) -> list[bytes | None]:
    """The 128-bit key of each line: of the line stripped and with A-Z lowered; None below `least` code points."""
    digest, out = xxhash.xxh3_128_digest, []
    for line in text.split("\n"):
        line = line.strip(BLANK)
        out.append(digest(line.encode().lower()) if len(line) >= least else None)  # bytes: A-Z alone are lowered
    return out


class LineRuns:
    """Levelled sorted runs of (k1, k2, docs): in how many documents each line key was met; and of the keys that `least`
    documents or more hold, which are settled and counted no further."""

    def __init__(self, spark: SparkSession, least: int, fanout: int = 2):
        self.spark, self.least, self.fanout = spark, least, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unsettled(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is not settled yet."""
        return reduce(lambda left, run: left.join(run, KEYS, "left_anti"), self.settled, keys)

    def add(self, batch: DataFrame) -> None:
        """Adds one batch of (k1, k2, docs). What is settled is taken out of it; the rest is joined with the runs: a key that
        no run holds is new, another's count is raised. Keys that reach `least` with this batch are settled, the others are
        its sorted run; then the levels that are full are merged."""
        rest = self.unsettled(batch.groupBy(*KEYS).agg(F.sum("docs").alias("docs")))
        before = merge(self.runs()).withColumnRenamed("docs", "before") if self.runs() else None
        met = rest.join(before, KEYS, "left") if before else rest.withColumn("before", F.lit(0).cast("long"))
        met = stored(met.withColumn("total", F.col("docs") + F.coalesce("before", F.lit(0))), "batch")
        self.settled.append(sorted_run(met.filter(F.col("total") >= self.least).select(*KEYS)))
        self.levels[0].append(sorted_run(met.filter(F.col("total") < self.least).select(*KEYS, "docs")))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(sorted_run(self.unsettled(merge(self.levels[k]))))
                self.levels[k] = []
                self.settled = [sorted_run(reduce(DataFrame.union, self.settled))]

    def frequent(self) -> DataFrame:
        """The keys that `least` documents or more hold, each once."""
        return reduce(DataFrame.union, self.settled) if self.settled else self.spark.createDataFrame([], "k1 long, k2 long")


def merge(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, runs).groupBy(*KEYS).agg(F.sum("docs").alias("docs"))


def sorted_run(keys: DataFrame) -> DataFrame:
    return stored(keys.sortWithinPartitions(*KEYS), "run")


def batches_of(n: int, first: int) -> list[tuple[int, int]]:
    """Ranges that cut n buckets into batches: the first of `first`, each further one as large as all before it, so that all
    joins with the runs together read a few times the keys, whatever their number, and there are log n batches."""
    out, at = [], 0
    while at < n:
        out.append((at, min(n, max(first, 2 * at))))
        at = out[-1][1]
    return out


def drop_common_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, first_batch: int = 8, fanout: int = 2, bucket_bytes: int = 8_000_000,
                      id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(id, *carry, kept, n_lines, n_dropped) of each row of docs: kept is the text without the lines whose key at least
    least_docs rows hold.

    A null or empty text is one empty line, and keys below least_chars code points are never dropped. A repeated row is
    one more document. Null and repeated ids are ids like others. Columns to carry may have any name. Texts are shuffled
    once, by a hash of id and text; an empty table gives an empty result."""
    spark, n = docs.sparkSession, buckets(docs, text_col, bucket_bytes)
    rows = small_batches(docs).select(F.col(id_col).alias("__id"), whole_text(text_col).alias("__text"), *(F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)))
    rows = rows.withColumn(BUCKET, bucket_of(n, "__id", "__text"))

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found: Counter = Counter()
            for bucket, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                found.update((bucket, key) for key in set(line_keys(text.as_py(), least_chars)) if key)
            k = np.frombuffer(b"".join(key for _, key in found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(list(found.values()), pa.int64())], names=[BUCKET, "k1", "k2", "docs"])

    met = stored(rows.select(BUCKET, "__text").mapInArrow(count, f"{BUCKET} int, k1 long, k2 long, docs long"), "lines")
    runs = LineRuns(spark, least_docs, fanout)
    for start, end in batches_of(n, first_batch):
        runs.add(met.filter(F.col(BUCKET).between(start, end - 1)))
    # every bucket that holds a frequent key is told of it once
    frequent = met.join(runs.frequent(), KEYS, "left_semi").select(BUCKET, *KEYS).distinct()
    carried = [T.StructField(c, docs.schema[c].dataType) for c in carry]
    inner = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), *(T.StructField(f"__c{k}", f.dataType) for k, f in enumerate(carried)), T.StructField("__kept", T.StringType()), T.StructField("__n", T.LongType()), T.StructField("__dropped", T.LongType())])

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        k = np.stack([right.column(x).to_numpy() for x in KEYS], axis=1) if right.num_rows else np.zeros((0, 2), dtype="<i8")
        known = {row.tobytes() for row in k.astype("<i8")}
        kept, n_lines, dropped = [], [], []
        for text in left.column("__text"):
            text = text.as_py()
            keys = line_keys(text, least_chars)
            stay = [x for x, key in zip(text.split("\n"), keys, strict=True) if key not in known]
            kept.append("\n".join(stay))
            n_lines.append(len(keys))
            dropped.append(len(keys) - len(stay))
        columns = [left.column("__id"), *(left.column(f"__c{k}") for k in range(len(carry))), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64())]
        return pa.Table.from_arrays(columns, names=inner.names)

    out = rows.groupBy(BUCKET).cogroup(frequent.groupBy(BUCKET)).applyInArrow(drop, inner)
    return out.select(F.col("__id").alias(id_col), *(F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)), F.col("__kept").alias("kept"), F.col("__n").alias("n_lines"), F.col("__dropped").alias("n_dropped"))
