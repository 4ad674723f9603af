"""Near-duplicate vectors within a label (operator 10).

Each direction is rotated at random once and stored as the packed signs of its coordinates with a correction factor, from
which the inner product with any other vector can be estimated without bias; the error has a known scale. Sign bits of
further rotations key the candidate buckets. Through the buckets go the codes alone. Only rows whose code is close enough to
another's in a block of a bucket meet their vectors and factors; of such pairs, those whose upper confidence bound reaches
the threshold are computed again, exactly, on the original vectors. Counts and a spanning forest leave a block, never its pairs."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, stored, whole_groups
from .graph import components, forest, pair_blocks
from .vectors import dimension, matrix, rotations, usable

#: Rows of a comparison block; pairs computed at once.
BLOCK, PAIRS = 1024, 65_536


class Codes:
    """Binary codes of unit vectors by random rotations: bits and a correction factor for estimates, and keys of `bits` bits for
    `tables` tables."""

    def __init__(self, d: int, tables: int, bits: int, threshold: float, sigmas: float, lost: float, seed: int = 11):
        self.d, self.tables, self.bits, self.threshold, self.sigmas = d, tables, bits, threshold, sigmas
        rotation = rotations(d, 1 + -(-tables * bits // d), seed)
        self.first, self.rotation = rotation[:d], rotation[d:]
        # a pair just at the threshold differs in more than `apart` bits with a chance below `lost`
        share, self.apart, tail = math.acos(threshold) / math.pi, d, 0.0
        while self.apart and (tail := tail + math.comb(d, self.apart) * share**self.apart * (1 - share) ** (d - self.apart)) < lost:
            self.apart -= 1

    def unit(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the square
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables): the sign bits of `bits` rotated coordinates each."""
        signs = (unit @ self.rotation.T >= 0)[:, : self.tables * self.bits].reshape(-1, self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the signs of its rotated coordinates, packed in words of 64 bits, and the code's product with its own
        vector."""
        turned = unit @ self.first.T
        bits = np.packbits(turned >= 0, axis=1, bitorder="little")
        return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view("<u8"), np.abs(turned).sum(axis=1) / np.sqrt(self.d)

    def estimate(self, code: np.ndarray, factor: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row by row, the unbiased estimate of the inner product of a coded vector with another unit vector, and how far that
        may lie above it."""
        signs = np.where(np.unpackbits(code.view(np.uint8), axis=1, bitorder="little")[:, : self.d], 1.0, -1.0) / np.sqrt(self.d)
        found = np.einsum("ij,ij->i", signs, other @ self.first.T) / factor
        return found, self.sigmas * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / np.sqrt(max(1, self.d - 1))

    def close(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """(left, right): which codes do not differ in too many bits."""
        return sum(np.bitwise_count(left[:, None, w] ^ right[None, :, w]).astype(np.int16) for w in range(left.shape[1])) <= self.apart

    def linked(self, x: np.ndarray, y: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Positions (i, j) of all pairs of rows of x and y whose cosine is at least the threshold; left and right: their codes
        and factors. Codes that differ in too many bits are left, then pairs whose bound stays below; the rest is computed."""
        i, j = np.nonzero(self.close(left[0], right[0]))
        u, v, hits = self.unit(x), self.unit(y), []
        for p, q in zip(np.array_split(i, max(1, len(i) // PAIRS)), np.array_split(j, max(1, len(j) // PAIRS)), strict=True):
            found, above = self.estimate(left[0][p], left[1][p], v[q])
            near = np.flatnonzero(found + above >= self.threshold)
            near = near[np.einsum("ij,ij->i", u[p[near]], v[q[near]]) >= self.threshold]
            hits.append(np.stack([p[near], q[near]]))
        i, j = np.concatenate(hits, axis=1)
        return i, j


def near_vectors(rows: DataFrame, threshold: float = 0.98, sigmas: float = 6.0, lost: float = 1e-6, least_bits: int = 12, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) of each row: how many other rows of the same label have a cosine of at least threshold,
    and the smallest id reachable by such links.

    Rows whose label is null, or whose vector is null, zero, holds null or non-finite components or has another size than
    most, link with nothing: 0 links, their own id. Equal vectors are one node that counts as often as it stands there; where
    an id names several vectors, each is a node of its own. Null ids link with nothing. Other columns are ignored. The keys'
    bits grow with the logarithm of the largest label's rows, so that buckets do not grow, and the tables with the bits: a
    pair just at the threshold misses all tables with a chance of `lost`, closer ones with less. An empty table gives an empty
    result."""
    d = dimension(rows, vector_col)
    base = rows.select(F.col(id_col), F.col(label_col).alias("__label"), F.col(vector_col).alias("__v"))
    if not d:
        return base.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    live = base.filter(usable("__v") & (F.size("__v") == d) & F.col("__label").isNotNull() & F.col(id_col).isNotNull())
    alike = live.groupBy("__label", "__v").agg(F.min(F.col(id_col).cast("long")).alias("__first"), F.count(F.lit(1)).alias("__size"))
    nodes = stored(alike.withColumn("__rep", F.monotonically_increasing_id()), "nodes")  # written once: the numbers stay
    largest = nodes.groupBy("__label").count().agg(F.max("count")).first()[0] or 1
    bits = max(least_bits, math.ceil(math.log2(largest)))
    tables = math.ceil(math.log(lost) / math.log(1 - (1 - math.acos(threshold) / math.pi) ** bits))
    codes = Codes(d, tables, bits, threshold, sigmas, lost)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = codes.unit(matrix(batch.column("__v"), d))
            code, factor = codes.encode(unit)
            keys = codes.keys(unit)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("__rep"), batch.column("__lab"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor), lists], names=["__rep", "__lab", "__code", "__factor", "__keys"])

    # a label's number is the least __rep of its nodes: block keys are numbers, and unlike labels never share one
    labels = stored(nodes.groupBy("__label").agg(F.min("__rep").alias("__lab"), F.count(F.lit(1)).alias("__nodes")), "labels")
    total = labels.agg(F.sum("__nodes")).first()[0] or 0
    named = joined(nodes.select("__label", "__rep", "__v"), labels, ["__label"], F.col("__nodes") > total * 0.001)
    coded = stored(named.select("__rep", "__lab", "__v").mapInArrow(encode, "__rep long, __lab long, __code binary, __factor double, __keys array<long>"), "codes")
    keyed = coded.select("__rep", "__lab", "__code", F.posexplode("__keys").alias("__table", "__key"))
    keys = ["__lab", "__table", "__key", "__low", "__high"]
    coded_blocks = pair_blocks(keyed, keys[:3], "__rep", BLOCK).select(*keys, "__chunk", "__rep", "__code")

    def partnered(part: pa.Table) -> np.ndarray:
        """Which rows of a block have a close partner in it."""
        rep, chunk = part.column("__rep").to_numpy(), part.column("__chunk").to_numpy()
        low, high = (part.column(c)[0].as_py() for c in ("__low", "__high"))
        code = np.frombuffer(b"".join(part.column("__code").to_pylist()), dtype="<u8").reshape(len(rep), -1)
        a, b = (np.flatnonzero(chunk == low), np.flatnonzero(chunk == high))
        near = codes.close(code[a], code[b]) & (rep[a][:, None] != rep[b][None, :])
        out = np.zeros(len(rep), dtype=bool)
        out[a[near.any(axis=1)]] = out[b[near.any(axis=0)]] = True
        return out

    def in_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        for group in whole_groups(batches, keys, BLOCK):
            starts = [0, *(np.flatnonzero(np.any([np.diff(group.column(c).to_numpy()) != 0 for c in keys], axis=0)) + 1).tolist(), group.num_rows]
            for at, end in zip(starts[:-1], starts[1:], strict=True):
                yield group.slice(at, end - at)

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_blocks(batches):
            kept = partnered(part)
            if kept.any():
                yield from part.filter(pa.array(kept)).select([*keys, "__chunk", "__rep"]).combine_chunks().to_batches()

    schema = "__lab long, __table int, __key long, __low int, __high int, __chunk int, __rep long"
    sifted = coded_blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(sift, schema)
    held = nodes.select("__rep", "__size", "__v").join(coded.select("__rep", "__code", "__factor"), "__rep")
    blocks = sifted.join(held, "__rep")

    def block(part: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rep, size, chunk, factor = (part.column(c).to_numpy() for c in ("__rep", "__size", "__chunk", "__factor"))
        table, low, high = (part.column(c)[0].as_py() for c in ("__table", "__low", "__high"))
        x, code = matrix(part.column("__v"), d), np.frombuffer(b"".join(part.column("__code").to_pylist()), dtype="<u8").reshape(len(rep), -1)
        a, b = (np.flatnonzero(chunk == low), np.flatnonzero(chunk == high))
        i, j = codes.linked(x[a], x[b], (code[a], factor[a]), (code[b], factor[b]))
        i, j = a[i], b[j]
        i, j = (i[i < j], j[i < j]) if low == high else (i, j)
        if not len(i):
            return
        left, right = forest(len(rep), i, j)
        yield rep[left], rep[right], np.zeros(len(left), dtype=np.int64)
        some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        own, p, q = codes.keys(codes.unit(x[some])), at[: len(i)], at[len(i) :]
        first = np.concatenate([(own[m] == own[n]).argmax(axis=1) for m, n in zip(np.array_split(p, max(1, len(p) // PAIRS)), np.array_split(q, max(1, len(q) // PAIRS)), strict=True)]) == table
        i, j = i[first], j[first]  # each pair counts in the first table in which it meets
        n = np.bincount(i, weights=size[j], minlength=len(rep)) + np.bincount(j, weights=size[i], minlength=len(rep))
        some = np.flatnonzero(n)
        yield rep[some], rep[some], n[some].astype(np.int64)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_blocks(batches):
            for a, b, n in block(part):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    found = stored(blocks.select(*keys, "__chunk", "__rep", "__size", "__v", "__code", "__factor").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long, n long"), "links")
    counts = found.groupBy(F.col("a").alias("__rep")).agg(F.sum("n").alias("__n"))
    classes = components(found.select("a", "b").distinct()).withColumnRenamed("node", "__rep")
    known = nodes.join(counts, "__rep", "left").join(classes, "__rep", "left").withColumn("component", F.coalesce("component", "__rep"))
    least = known.groupBy("component").agg(F.min("__first").alias("__least"))
    known = stored(known.join(least, "component").select("__label", "__v", (F.col("__size") - 1 + F.coalesce("__n", F.lit(0))).alias("n_links"), F.col("__least").alias("component")), "known")
    judged = base.join(known, ["__label", "__v"], "left")
    alone = F.col(id_col).isNull() | F.col("n_links").isNull()
    return judged.select(id_col, F.when(alone, 0).otherwise(F.col("n_links")).alias("n_links"), F.when(alone, F.col(id_col)).otherwise(F.col("component")).cast(rows.schema[id_col].dataType).alias("component_id"))
