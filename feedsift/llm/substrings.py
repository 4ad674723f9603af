"""Passages that other documents hold too (operator 11).

Every word is a 64-bit hash of its bytes; every window of `size` words is a Rabin-Karp hash of its words' hashes, rolled
along the text by prefix sums modulo 2^64. Documents are dealt into buckets. A bucket sends each of its distinct window
hashes once, with the smallest id that holds it there, to the slice of the hash space it lies in; a slice finds the smallest
id of all and answers each bucket, in the order in which it asked, with one bit: a smaller id holds this window elsewhere. The
bucket's repeated windows then merge into maximal intervals of words, which are removed.

Two different windows share a hash with a chance of 2^-64 (a few bits more where one is the other's words in another order):
of 10^12 windows about one in 10^7 would be taken for another."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BUCKET, buckets, scattered, whole_groups, whole_text
from .lm_scoring import from_planes, planes

#: Ids stand for null with the largest number: null comes last.
NO_ID = np.iinfo(np.int64).max
#: Bytes, and words, hashed at once.
BYTES, WORDS = 1 << 20, 1 << 18
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_WORD_BASE, _WINDOW_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE_VALUES = np.random.default_rng(11).integers(1, 1 << 64, 256, dtype=np.uint64)


class Powers:
    """The powers of an odd base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.up, self.down = self.table(1, 0), self.table(1, 1)

    def table(self, n: int, k: int) -> np.ndarray:
        out = np.full(n, self.bases[k], dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self.table(n, 0), self.table(n, 1)
        return self.up[:n], self.down[:n]


class Texts:
    """Words of some texts as one line: where each begins and ends in the bytes (a blank behind each text) and whose it is."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        inside = ~_BLANK[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate([[0], edges]) if len(inside) and inside[0] else edges
        self.starts, self.ends = edges[::2], edges[1::2]
        self.upto = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
        #: of each text the first of its words, and behind the last text all words' number
        self.bounds = np.concatenate([[0], np.searchsorted(self.starts, self.upto)]).astype(np.int64)

    def word_hashes(self, powers: Powers) -> np.ndarray:
        out, at, n = [], 0, len(self.starts)
        while at < n:
            first = int(self.starts[at])
            upto = max(at + 1, int(np.searchsorted(self.ends, first + BYTES, side="right")))
            data = self.data[first : int(self.ends[upto - 1])]
            up, down = powers.of(len(data) + 1)
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[data] * up[:-1], out=sums[1:])
            s, e = self.starts[at:upto] - first, self.ends[at:upto] - first
            x = (sums[e] - sums[s]) * down[s]
            x = (x ^ x >> np.uint64(32)) * _MIX  # from here on not linear in the bytes
            out.append(x ^ x >> np.uint64(29))
            at = upto
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def windows(self, size: int, powers: tuple[Powers, Powers]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window of `size` words: its hash, its first word, its text."""
        words, out = self.word_hashes(powers[0]), []
        for at in range(0, max(0, len(words) - size + 1), WORDS):
            own = words[at : at + WORDS + size - 1]
            up, down = powers[1].of(len(own) + 1)
            sums = np.zeros(len(own) + 1, dtype=np.uint64)
            np.cumsum(own * up[:-1], out=sums[1:])
            out.append((sums[size:] - sums[:-size]) * down[: len(own) - size + 1])
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        first = np.flatnonzero(text[size - 1 :] == text[: len(text) - size + 1]) if len(text) >= size else np.zeros(0, dtype=np.int64)
        return (np.concatenate(out)[first] if out else np.zeros(0, dtype=np.uint64)), first, text[first]

    def without(self, gone: np.ndarray) -> list[bytes]:
        """The texts' words that are not gone, joined by blanks."""
        stay = np.flatnonzero(~gone)
        data = self.data.copy()
        data[self.ends] = 0x20
        mark = np.zeros(len(data) + 1, dtype=np.int8)
        mark[self.starts[stay]] += 1
        mark[self.ends[stay] + 1] -= 1
        kept = data[np.cumsum(mark, dtype=np.int8)[:-1] > 0].tobytes()
        length = np.zeros(len(gone) + 1, dtype=np.int64)
        np.cumsum(np.where(gone, 0, self.ends - self.starts + 1), out=length[1:])
        at = length[self.bounds].tolist()
        return [kept[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


def distinct(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the smallest id of each; which order sorts the keys, and which distinct one each in
    that order is."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    return ranked[starts], np.minimum.reduceat(ids[order], starts) if len(starts) else ids[:0], order, np.cumsum(new) - 1


def texts_of(table: pa.Table) -> tuple[Texts, np.ndarray]:
    return Texts(table.column("__text").cast(pa.binary()).to_pylist()), table.column("__key").to_numpy()


def intervals(gone: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Of each text the maximal runs of words that are gone, as (start, end), counted in the text's words."""
    first, last = (np.zeros(len(gone), dtype=bool) for _ in range(2))
    held = bounds[:-1] < bounds[1:]
    first[bounds[:-1][held]] = last[bounds[1:][held] - 1] = True
    before, behind = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
    starts, ends = np.flatnonzero(gone & (first | ~before)), np.flatnonzero(gone & (last | ~behind)) + 1
    offsets = np.searchsorted(starts, bounds).astype(np.int32)
    base = np.repeat(bounds[:-1], np.diff(offsets))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], names=["start", "end"]))


def remove_repeats(docs: DataFrame, size: int = 13, bucket_bytes: int = 8_000_000, slice_bytes: int = 6_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, removed, kept) of each row: its text without the words covered by windows of `size` words that
    also start in a document with a smaller id.

    Words are what white space (20, 09-0D) parts; kept joins those that stay by one blank, removed lists the maximal
    intervals (start, end; in words) that went. Windows are judged on the input. Ids are whole numbers; a null id comes behind
    all others, and rows of equal id, repeated rows among them, take nothing from each other. A null text has no words, a text
    of fewer words than a window stays as it is. Other columns are ignored; an empty table gives an empty result.

    A bucket holds about bucket_bytes of text (a longer text is one of its own) and a slice the windows of about slice_bytes, so a
    window that every document holds is sent once for each bucket. Texts cross the network once; what else crosses is
    at most a hash and an id for each word."""
    n = buckets(docs, text_col, bucket_bytes)
    shift = np.uint64(64 - max(1, (n * bucket_bytes // slice_bytes).bit_length()))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("__key"), whole_text(text_col).alias("__text"))
    dealt = rows.withColumn(BUCKET, scattered(n)).repartition(BUCKET)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(_WORD_BASE), Powers(_WINDOW_BASE)
        for part in whole_groups(batches, [BUCKET]):
            bucket = part.column(BUCKET).to_numpy()
            for b in np.unique(bucket):
                texts, ids = texts_of(part.filter(pa.array(bucket == b)))
                keys, _, text = texts.windows(size, powers)
                keys, least, _, _ = distinct(keys, ids[text])
                at = keys >> shift
                starts = [*(np.flatnonzero(np.diff(at, prepend=~at[:1]))).tolist(), len(keys)]
                held = [(int(at[s]), planes(np.diff(keys[s:e], prepend=np.uint64(0))), planes(least[s:e])) for s, e in zip(starts[:-1], starts[1:], strict=True)]
                columns = [pa.array([h[k] for h in held], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array([int(b)] * len(held), pa.int32()), *columns[1:]], names=["part", BUCKET, "keys", "ids"])

    asked = dealt.sortWithinPartitions(BUCKET).mapInArrow(ask, f"part long, {BUCKET} int, keys binary, ids binary")

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(from_planes(x.as_py(), "<u8"), dtype=np.uint64) for x in table.column("keys")]
        ids = np.concatenate([from_planes(x.as_py(), "<i8") for x in table.column("ids")])
        _, least, order, group = distinct(np.concatenate(keys), ids)
        before = np.zeros(len(ids), dtype=bool)
        before[order] = least[group] < ids[order]
        found = np.split(before, np.cumsum([len(k) for k in keys])[:-1])
        return pa.Table.from_arrays([table.column("part"), table.column(BUCKET), pa.chunked_array([pa.array([np.packbits(x).tobytes() for x in found], pa.binary())])], names=["part", BUCKET, "before"])

    answers = asked.groupBy("part").applyInArrow(answer, f"part long, {BUCKET} int, before binary")
    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, ids = texts_of(left)
        keys, first, text = texts.windows(size, (Powers(_WORD_BASE), Powers(_WINDOW_BASE)))
        known, least, order, group = distinct(keys, ids[text])
        held = right.column("before").to_pylist()
        at, before = known >> shift, np.zeros(len(known), dtype=bool)
        parts = right.column("part").to_numpy().astype(np.uint64)
        for k in np.argsort(parts):
            a, b = np.searchsorted(at, parts[k]), np.searchsorted(at, parts[k], side="right")
            before[a:b] = np.unpackbits(np.frombuffer(held[k], dtype=np.uint8), count=b - a)
        hit = order[before[group] | (least[group] < ids[text[order]])]
        mark = np.zeros(len(texts.starts) + 1, dtype=np.int32)
        mark[first[hit]] += 1
        mark[first[hit] + size] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        count = np.concatenate([[0], np.cumsum(gone)])[texts.bounds]
        columns = [left.column("__id"), pa.array(np.diff(texts.bounds)), pa.array(np.diff(count)), intervals(gone, texts.bounds), pa.array(texts.without(gone), pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays(columns, names=schema.names)

    out = dealt.groupBy(BUCKET).cogroup(answers.groupBy(BUCKET)).applyInArrow(cut, schema)
    return out.withColumnRenamed("__id", id_col)
