"""SimHash near-duplicates (operator 4).

Fingerprints come from word shingles. Equal fingerprints are one node. Two fingerprints that differ in at most r bits
agree wholly on `agree` of any r + agree blocks of bits, so each choice of `agree` blocks is a table in which linked
fingerprints share a bucket. Buckets are compared bit-sliced: the bits of many fingerprints stand in vertical planes of
64-bit words, one fingerprint's distances to 64 others grow together in carry-save counters, and words in which all
distances have passed the radius are abandoned. Of a block's links a spanning forest goes on, which keeps the classes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored, whole_groups, whole_text
from .graph import components, forest, pair_blocks

#: Shingles counted at once; rows of a comparison block; planes between two tests for abandoned words.
SLAB, BLOCK, STRIDE = 1 << 15, 1024, 8


def fingerprint(text: str, width: int, seed: int = 42) -> int:
    """The SimHash of the text's word shingles as a signed 64-bit number; 0 if it has no word."""
    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, and only 20 and 09-0D are white space
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[-n:]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLAB):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + SLAB].tolist(), ends[at : at + SLAB].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long) of each row; null texts count as empty."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=schema.names)

    return small_batches(docs).select(id_col, whole_text(text_col).alias("__text")).mapInArrow(run, schema)


def masks(radius: int, agree: int) -> list[int]:
    """Bit masks, as signed numbers, of each choice of `agree` of radius + agree nearly equal blocks."""
    n = radius + agree
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    out = [sum(c) for c in combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def planes(fps: np.ndarray) -> np.ndarray:
    """(64 k, words) of fingerprints of k numbers each: bit b of fingerprint 64 w + i is bit i of word w of plane b. Padding
    repeats the last fingerprint."""
    padded = np.concatenate([fps, np.repeat(fps[-1:], -len(fps) % 64, axis=0)])
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T.reshape(bits.shape[1], -1, 64), axis=2, bitorder="little")).view("<u8")[..., 0]


def over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose count has passed the radius (which the counters can hold)."""
    greater, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            greater |= equal & counters[k]
            equal &= ~counters[k]
    return greater


def plus(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum's bits and the carries of three numbers of one bit in each lane."""
    differ = a ^ b
    return differ ^ c, a & b | differ & c


def count_planes(state: list[np.ndarray], x: list[np.ndarray]) -> None:
    """Adds STRIDE planes to the counters, of which the last holds what ran over: carries are saved until planes of their weight are
    added."""
    one, a = plus(x[0], x[1], x[2])
    two, b = plus(x[3], x[4], x[5])
    three, c = plus(one, two, x[6])
    state[0], d = plus(state[0], three, x[7])
    four, e = plus(a, b, c)
    state[1], f = plus(state[1], four, d)
    state[2], carry = plus(state[2], e, f)
    for k in range(3, len(state) - 1):
        state[k], carry = state[k] ^ carry, state[k] & carry
    state[-1] |= carry


def close(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all fingerprints left[i], right[j] that differ in at most radius bits. A fingerprint is a number or
    a row of numbers of 64 bits."""
    left, right = (x.reshape(len(x), -1) for x in (left, right))
    sliced = planes(right)
    size = max(3, radius.bit_length())
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for base in range(0, len(left), 256):
        own = left[base : base + 256].astype("<u8")
        asks = np.unpackbits(own.view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little").T * ~np.uint64(0)  # all ones where the query's bit is 1
        query, word = np.divmod(np.arange(len(own) * sliced.shape[1]), sliced.shape[1])
        state, whole = [np.zeros(len(query), dtype=np.uint64) for _ in range(size + 1)], True  # counter bits, and what ran over them
        for bit in range(0, len(sliced), STRIDE):
            count_planes(state, [(sliced[k] ^ asks[k][:, None]).ravel() if whole else sliced[k][word] ^ asks[k][query] for k in range(bit, bit + STRIDE)])
            if bit + STRIDE > radius:
                dead = state[size] | over(state[:size], radius)
                alive = dead != ~np.uint64(0)
                if bit + STRIDE == len(sliced) or alive.sum() < 0.7 * len(alive):
                    query, word, state, whole = query[alive], word[alive], [s[alive] for s in state], False
                    if not len(query):
                        break
        if len(query):
            lanes = np.unpackbits((~(state[size] | over(state[:size], radius))).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cell, lane = np.nonzero(lanes)
            i, j = query[cell] + base, word[cell] * 64 + lane
            hits.append((i[j < len(right)], j[j < len(right)]))
    if not hits:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def links(fps: DataFrame, radius: int = 4, agree: int = 3) -> DataFrame:
    """Links (a, b) between the distinct fingerprints (column fingerprint) that connect whatever pairs within the radius
    connect."""
    table = F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks(radius, agree)))).alias("__table", "__bits")
    blocks = pair_blocks(fps.select("fingerprint", table), ["__table", "__bits"], "fingerprint", BLOCK)
    keys = ["__table", "__bits", "__low", "__high"]
    schema = "a long, b long"

    def block_links(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        fp, chunk, low, high = (part.column(x).to_numpy() for x in ("fingerprint", "__chunk", "__low", "__high"))
        crossed = low[0] != high[0]
        left, right = (fp[chunk == low[0]], fp[chunk == high[0]]) if crossed else (fp, fp)
        if not len(left) or not len(right):
            return fp[:0], fp[:0]
        i, j = close(left.view(np.uint64), right.view(np.uint64), radius)
        nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        a, b = forest(len(nodes), at[: len(left)][i], at[len(left) :][j])
        return nodes[a], nodes[b]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, keys, BLOCK):
            found = []
            columns = [group.column(x).to_numpy() for x in keys]
            starts = np.flatnonzero(np.any([np.diff(c, prepend=c[0] - 1) != 0 for c in columns], axis=0)).tolist()
            at = 0
            # small buckets share a block: every pair within the radius is a link, whichever buckets it comes from
            while at < len(starts):
                upto = at + 1
                first = group.slice(starts[at], 1)
                while upto < len(starts) and first.column("__high")[0].as_py() == 0 and columns[3][starts[upto]] == 0 and (starts[upto + 1] if upto + 1 < len(starts) else group.num_rows) - starts[at] <= BLOCK // 2:
                    upto += 1
                end = starts[upto] if upto < len(starts) else group.num_rows
                found.append(block_links(group.slice(starts[at], end - starts[at])))
                at = upto
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks.repartition(*keys).sortWithinPartitions(*keys, "fingerprint").mapInArrow(run, schema).distinct()


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long, component_id) of each row: component_id is the smallest id reachable by links between
    fingerprints that differ in at most radius bits.

    Null and blank texts have fingerprint 0 and are linked like any other. Repeated rows and rows with equal texts fall in
    one class; a null id never names a class unless the class has no other. Other columns are ignored. An empty table
    gives an empty result."""
    prints = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = stored(prints.groupBy("fingerprint").agg(F.min(id_col).alias("first")), "nodes")
    classes = components(links(nodes, radius))
    named = nodes.join(classes.withColumnRenamed("node", "fingerprint").hint("merge"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    first = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stored(named.join(first.hint("merge"), "component").select("fingerprint", "component_id"), "classes")
    return prints.join(named.hint("merge"), "fingerprint").select(id_col, "fingerprint", "component_id")


def hexadecimal(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
