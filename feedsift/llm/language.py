"""Language identification by rank-order profiles (operator 1).

A profile lists the most frequent n-grams (1 to 3 letters, words padded by a blank) in order. A document's own profile is
compared with each language's by out-of-place distance: the sum, over the document's n-grams, of how far the ranks lie
apart, or the profile length where the language lacks the n-gram. The nearest language wins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored
from .pieces import slices

#: In the code of an n-gram, the third or second letter that there isn't.
NONE = (1 << 21) - 1
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Of each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> np.ndarray:
    """The codes of all n-grams of 1 to 3 letters, repeats included; a blank (0) stands before and after each word."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    line = np.zeros(len(points) + 2, dtype=np.int64)
    line[1:-1] = np.where(letters()[points], points, 0)
    line = line[np.concatenate([[True], (line[1:] != 0) | (line[:-1] != 0)])]  # one blank between words
    if len(line) < 3:
        return np.zeros(0, dtype=np.int64)
    one = line[line != 0] << 42 | NONE << 21 | NONE
    two = line[:-1] << 42 | line[1:] << 21 | NONE
    three = (line[:-2] << 42 | line[1:-1] << 21 | line[2:])[line[1:-1] != 0]
    return np.concatenate([one, two, three])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the whole text and their counts; long texts are counted part by part."""
    parts = [np.unique(grams(part), return_counts=True) for part in slices(text, 500_000)]
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The `length` most frequent n-grams in order; ties by code."""
    return keys[np.lexsort((keys, -counts))[:length]]


def profiles(docs: DataFrame, length: int = 300, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """The profile of each language: the n-grams of all its documents. length n-grams a language come to the driver."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                keys, counts = counted("\n".join(own))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    counts = stored(rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    tops = [counts.filter(F.col("lang") == x).orderBy(F.desc("n"), "gram").limit(length) for x in langs]
    found: dict[str, list[tuple[int, int]]] = {x: [] for x in langs}
    for r in reduce(DataFrame.union, tops).collect() if tops else []:
        found[r["lang"]].append((-r["n"], r["gram"]))
    return {x: np.array([g for _, g in sorted(v)], dtype=np.int64) for x, v in found.items()}


def judge_of(known: dict[str, np.ndarray], length: int) -> Callable[[str], tuple[str, float]]:
    """What finds the language and the score of a text."""
    names = sorted(known)
    all_keys = np.unique(np.concatenate([known[x] for x in names])) if names else np.zeros(0, dtype=np.int64)
    ranks = np.full((len(names), len(all_keys) + 1), length, dtype=np.int64)  # the last column: n-grams of no profile
    for k, x in enumerate(names):
        ranks[k, np.searchsorted(all_keys, known[x])] = np.arange(len(known[x]))

    def judge(text: str) -> tuple[str, float]:
        own = ranked(*counted(text), length)
        if not len(own) or not names:
            return UNDETERMINED, 0.0
        at = np.searchsorted(all_keys, own)
        at[(at == len(all_keys)) | (all_keys[np.minimum(at, len(all_keys) - 1)] != own)] = len(all_keys)
        theirs = ranks[:, at]
        apart = np.where(theirs == length, length, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(apart.argmin())
        return names[best], float(1 - apart[best] / (length * len(own)))

    return judge


def predict_rows(docs: DataFrame, known: dict[str, np.ndarray], length: int = 300, text_col: str = "text") -> DataFrame:
    """All columns of docs with __lang (string) and __score (double): the language at the least out-of-place distance, ties
    to the first name; the score is 1 less that distance over the greatest possible.

    Null texts, texts without a letter and, where no language is known, all texts get `und` and score 0. Nulls, repeated
    rows and other columns make no difference. Texts of any length are judged whole."""
    names = [f"__c{k}" for k in range(len(docs.columns))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)]
    schema = T.StructType([*fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    text_at, judge = docs.columns.index(text_col), judge_of(known, length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py() or "") for t in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=schema.names)

    return small_batches(docs).toDF(*names).mapInArrow(run, schema).toDF(*docs.columns, "__lang", "__score")


def predict(docs: DataFrame, known: dict[str, np.ndarray], length: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row, as predict_rows finds them."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    judge = judge_of(known, length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=schema.names)

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, schema)


def held_out(id_col: str, parts: int, part: int = 2) -> Column:
    """Whether the CRC-32 of the id as text leaves `part` when divided by `parts`; ids that are null are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))
