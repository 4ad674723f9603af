"""Language-model scores of whole texts (operator 5).

The model is a backoff automaton over words: a state for each word of the training texts as context and one for a text's
start, an arc for each bigram met there, a failure arc from each state to the root, and the root's arcs for all words and
the unknown one. The root's words are smoothed by absolute discounting; a state's arcs by a Dirichlet prior drawn from the
root: P(w | h) = (c(h, w) + strength * P(w)) / (c(h) + strength), so that the failure arc weighs strength / (c(h) + strength)
and each state's probabilities sum to 1. No word, context or bigram is left out, however rare.

Words and bigrams are 64-bit keys (at 10^9 distinct ones a collision anywhere has a chance of 3 %) and their counts are never
in one place. Documents are dealt into buckets. A bucket sends its distinct keys, with how often its training texts hold
each, to the parts of the key space; a part adds up what all buckets sent and answers each bucket in the order in which it
asked. So a key crosses the network once for each bucket that holds it, and the answer is a count alone. The bucket's texts
then traverse their own part of the automaton from left to right."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BUCKET, buckets, scattered, whole_groups, whole_text
from .pieces import Numbers

#: Keys of the end token, of the context at the start of a text (no word holds a blank) and of the root as context.
END, START, ROOT = (xxhash.xxh64_intdigest(x) for x in (b" end", b" start", b" root"))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def arc_keys(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """A key for each arc from a context's to a token's key."""
    x = (context * _MIX[0]) ^ (token * _MIX[1] + _MIX[2])
    x = (x ^ x >> np.uint64(29)) * _MIX[0]
    return x ^ x >> np.uint64(32)


class Tokens:
    """Distinct tokens of some texts by number (the end is 0) with their 64-bit keys, and all texts as one line of numbers."""

    def __init__(self, texts: Iterable[str]):
        numbers = Numbers({b" end": 0})
        get = numbers.__getitem__
        line = []
        for text in texts:
            words = text.encode().lower().split()  # bytes: A-Z alone are lowered, and only 20 and 09-0D are white space
            line.append(np.fromiter(map(get, [*words, b" end"]), dtype=np.int32, count=len(words) + 1))
        self.sizes = np.array([len(x) for x in line], dtype=np.int64)
        self.line = np.concatenate(line) if line else np.zeros(0, dtype=np.int32)
        self.keys = np.fromiter(map(xxhash.xxh64_intdigest, numbers), dtype=np.uint64, count=len(numbers))

    def arcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted distinct keys of the root's arcs for these tokens and of the arcs taken along the texts; which of them
        each token's and each step's is."""
        token = self.keys[self.line]
        context = np.concatenate([[np.uint64(START)], token[:-1]]) if len(token) else token
        if len(self.sizes):
            context[np.cumsum(self.sizes)[:-1]] = START
        keys, at = np.unique(np.concatenate([arc_keys(np.array([ROOT], dtype=np.uint64), self.keys), arc_keys(context, token)]), return_inverse=True)
        return keys, at[: len(self.keys)], at[len(self.keys) :]


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, all lowest bytes first: their high bytes, mostly zero, compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def from_planes(held: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(held, dtype=np.uint8).reshape(width, -1).T).view(kind)[:, 0]


def score(docs: DataFrame, training: Column, strength: float = 50.0, bucket_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row, learned from the rows where training holds.

    score is the log10 probability of the text's words and its end. A null text is empty: its end alone. A repeated row
    counts, and is scored, as often as it stands there; ids may be null or repeat; other columns are ignored. Without any
    training row every token is unknown and has probability 1 (base: 1 / 1). An empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("__id"), whole_text(text_col).alias("__text"), F.coalesce(training, F.lit(False)).alias("__train"))

    def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = Tokens(t.as_py() for t in batch.column(0))
            n = np.bincount(tokens.line, minlength=len(tokens.keys))
            met = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(tokens.keys[met].view(np.int64)), pa.array(n[met].astype(np.int64))], names=["w", "c"])

    words = rows.filter("__train").select("__text").mapInArrow(count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    total, vocabulary, ones, twos = words.agg(F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    total = total or 0
    cut = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5  # the discount, from how many counts are 1 and 2

    n = buckets(docs, text_col, bucket_bytes)
    parts = max(1, n // 2)
    edges = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
    dealt = rows.select(scattered(n).alias(BUCKET), "__id", "__text", "__train").repartition(BUCKET)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, [BUCKET]):
            bucket = part.column(BUCKET).to_numpy()
            for b in np.unique(bucket):
                own = part.filter(pa.array(bucket == b))
                tokens = Tokens(t.as_py() for t in own.column("__text"))
                keys, roots, steps = tokens.arcs()
                learned = np.repeat(own.column("__train").to_numpy(), tokens.sizes)
                n = np.bincount(steps[learned], minlength=len(keys))
                n[roots] += np.bincount(tokens.line[learned], minlength=len(roots))
                bounds = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                slices = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(parts), pa.int32()), pa.array([int(b)] * parts, pa.int32()), pa.array([planes(np.diff(keys[s], prepend=np.uint64(0))) for s in slices], pa.binary()), pa.array([planes(n[s].astype(np.uint32)) for s in slices], pa.binary())],
                    names=["part", BUCKET, "keys", "n"],
                )

    asked = dealt.sortWithinPartitions(BUCKET).mapInArrow(ask, f"part int, {BUCKET} int, keys binary, n binary")

    def add_up(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(from_planes(k.as_py(), "<u8"), dtype=np.uint64) for k in table.column("keys")]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([from_planes(x.as_py(), "<u4") for x in table.column("n")]))
        found = np.split(sums.astype(np.uint64)[at], np.cumsum([len(k) for k in keys])[:-1])
        return pa.Table.from_arrays([table.column("part"), table.column(BUCKET), pa.chunked_array([pa.array(map(planes, found), pa.binary())])], names=["part", BUCKET, "n"])

    answers = asked.groupBy("part").applyInArrow(add_up, f"part int, {BUCKET} int, n binary")
    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def traverse(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens = Tokens(t.as_py() for t in left.column("__text"))
        _, roots, steps = tokens.arcs()
        order = np.argsort(right.column("part").to_numpy())
        held = right.column("n").to_pylist()
        counts = np.concatenate([from_planes(held[k], "<u8") for k in order]).astype(np.float64) if len(order) else np.zeros(0)
        word, arc, line = counts[roots], counts[steps], tokens.line
        base = np.log10((word + 1) / (total + vocabulary + 1))
        plain = np.where(word > 0, word - cut, cut * vocabulary) / total if total else np.ones(len(word))
        # the state in which each token is met: that of the token before it, or of the start; how often training was there
        state = word[np.concatenate([[0], line[:-1]])] if len(line) else np.zeros(0)  # a text's end (0) was met as often as a start
        fail = strength / (state + strength)
        step = np.log10(np.where(arc > 0, arc / (state + strength) + fail * plain[line], fail * plain[line]))
        starts = np.cumsum(tokens.sizes) - tokens.sizes
        columns = [left.column("__id"), pa.array(tokens.sizes), pa.array(np.add.reduceat((word > 0)[line].astype(np.int64), starts)), pa.array(np.full(len(starts), total)), pa.array(np.add.reduceat(base[line], starts)), pa.array(np.add.reduceat(step, starts))]
        return pa.Table.from_arrays(columns, names=schema.names)

    out = dealt.groupBy(BUCKET).cogroup(answers.groupBy(BUCKET)).applyInArrow(traverse, schema)
    return out.withColumnRenamed("__id", id_col)
