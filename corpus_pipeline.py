"""Corpus preparation: language, common lines, near-duplicates, packing, each on what the stage before kept."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsift.llm import language, line_dedup, packing, shingles
from feedsift.llm.common import read, stored
from feedsift.llm.queries import BYTE_BPE

#: Below this score a text is like no known language (letters at random; prose scores 0.4 or more).
MIN_SCORE = 0.15

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach: those without a letter, or too unlike every
    language's profile, go. Null and repeated ids and repeated rows are judged like others, ties go to the language that
    comes first by name; without any labelled document none is known and all go."""
    judged = language.predict_rows(docs, language.profiles(docs))
    return judged.filter((F.col("__lang") != language.UNDETERMINED) & (F.col("__score") >= MIN_SCORE)).select(*docs.columns)


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars follows the text. A null text comes out empty, a
    repeated row counts as a document more, null and repeated ids are ids like others; no document goes."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = line_dedup.drop_common_lines(docs, carry=carry)
    kept = kept.toDF(*(f"c{k}" for k in range(len(kept.columns))))  # by place: columns of docs may have any name
    place = {"doc_id": F.col("c0"), "text": F.col(f"c{len(carry) + 1}")} | {c: F.col(f"c{k}") for k, c in enumerate(carry, 1)}
    if "n_chars" in carry:
        place["n_chars"] = F.char_length(place["text"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*(place[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates (shingles of five words, similarity 0.8 or more): that with the smallest
    doc_id, null last, whether or not other rows have the same id. Null and empty texts are one class, equal rows too."""
    row = next(name for k in count() if (name := f"__row{k}") not in docs.columns)
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # written once: the keys stay
    kept = shingles.survivors(keyed, row, ["doc_id"]).withColumnRenamed("row", row)
    return keyed.join(kept, row, "left_semi").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, as op8 gives them: a null text is its end alone, a repeated row is packed once
    more, null and repeated ids are ids like others, other columns are ignored; no documents give no pieces."""
    return packing.digest(packing.pack(docs, BYTE_BPE))


STAGES: list[tuple[str, Stage]] = [("language ID", known_language), ("line dedup", common_lines), ("near-duplicates", near_duplicates), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
