"""Approximate nearest neighbours by largest inner product (operator 3).

An inverted file of coarse centroids; what a centroid leaves of a vector is product-quantised. A query probes the
centroids of largest inner product and scores their members by table lookups (centroid part plus one entry per
subspace). Members whose score, with its error margin, can reach the best are scored again on the original vectors.

Centroids and codebooks are fitted on a bounded sample of distinct vectors; every row is encoded and indexed once, and
stored. The lists route the rows: small lists share a shard, a list of many rows (a crowd of equal vectors, say) is dealt
over several by a hash. A query goes to the shards of the lists that it probes, with their numbers, and no further."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import dimension, matrix, usable


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """By Euclidean distance."""
    return np.concatenate([((centroids**2).sum(axis=1) - 2 * part @ centroids.T).argmin(axis=1) for part in np.array_split(x, max(1, len(x) // 8192))]) if len(x) else np.zeros(0, dtype=np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest_centroid(x, centroids)
        n = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


class Index:
    """Coarse centroids and the codebooks of their residuals."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, words: int = 256, rounds: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        sample = np.unique(sample, axis=0)  # a crowd of equal vectors is one point
        self.centroids = kmeans(sample, lists, rounds, rng)
        rest = sample - self.centroids[nearest_centroid(sample, self.centroids)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.books = [kmeans(rest[:, p], words, rounds, rng) for p in self.parts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row its list, its code words, and the length of what the code leaves."""
        at = nearest_centroid(x, self.centroids)
        rest = x - self.centroids[at]
        codes = np.stack([nearest_centroid(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1)
        lost = sum(((rest[:, p] - b[codes[:, m]]) ** 2).sum(axis=1) for m, (p, b) in enumerate(zip(self.parts, self.books, strict=True)))
        return at, codes.astype(np.uint8), np.sqrt(lost)

    def probed(self, queries: np.ndarray, rows: np.ndarray, least: np.ndarray, share: float) -> np.ndarray:
        """(queries, lists): which lists each query probes, those of largest inner product first, until they hold the share of
        all rows and at least `least` of them; rows: how many each list holds. Empty lists don't count."""
        order = np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")
        held = rows[order]
        before = held.cumsum(axis=1) - held
        out = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(out, order, (before < np.maximum(least, share * rows.sum())[:, None]) & (held > 0), axis=1)
        return out

    def search(self, queries: np.ndarray, query_ids: np.ndarray, probed: np.ndarray, x: np.ndarray, ids: np.ndarray, at: np.ndarray, codes: np.ndarray, lost: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, exact score) of the up to k best of each query among the encoded rows x of the lists that it probes."""
        order = np.lexsort((ids, at))
        x, ids, at, codes, lost = x[order], ids[order], at[order], codes[order], lost[order]
        lists, starts = np.unique(at, return_index=True)
        bounds = [*starts.tolist(), len(at)]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for base in range(0, len(queries), 256):
            q, own, asks = queries[base : base + 256], query_ids[base : base + 256], probed[base : base + 256]
            coarse = (q @ self.centroids[lists].T).astype(np.float32)
            tables = [(q[:, p] @ b.T).astype(np.float32) for p, b in zip(self.parts, self.books, strict=True)]
            scores = np.full((len(q), len(x)), -np.inf, dtype=np.float32)
            for n, c in enumerate(lists.tolist()):
                rows, ask = slice(bounds[n], bounds[n + 1]), np.flatnonzero(asks[:, c])
                if len(ask):
                    part = np.repeat(coarse[ask, n][:, None], bounds[n + 1] - bounds[n], axis=1)
                    for m, table in enumerate(tables):
                        part += table[ask][:, codes[rows, m]]
                    scores[ask, rows] = part
            scores[own[:, None] == ids[None, :]] = -np.inf
            slack = margin * np.linalg.norm(q, axis=1)[:, None] * lost[None, :] / np.sqrt(x.shape[1])
            least = np.partition(scores - slack, -k, axis=1)[:, -k] if len(x) > k else np.full(len(q), -np.inf)
            for i in range(len(q)):
                near = np.flatnonzero((scores[i] + slack[i] >= least[i]) & (scores[i] > -np.inf))
                exact = x[near] @ q[i]
                best = np.lexsort((ids[near], -exact))[:k]
                out.append((np.full(len(best), own[i]), ids[near][best], exact[best]))
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        return tuple(np.concatenate([o[n] for o in out]) for n in range(3))


def shards_of(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, how many) of each list: lists of up to size rows are filled into shards in order, a larger one gets several
    of its own."""
    first, many = np.zeros(len(rows), dtype=np.int64), np.maximum(1, -(-rows // size))
    shard, held = -1, size
    for c, n in enumerate(rows.tolist()):
        if n > size or held + n > size:
            shard, held = shard + 1, 0
        first[c] = shard
        held += n
        if n > size:
            shard, held = shard + int(many[c]) - 1, size
    return first, many


def search(rows: DataFrame, queries: DataFrame, k: int = 20, lists: int = 64, probe_share: float = 0.75, subspaces: int = 16, margin: float = 1.5, sample_rows: int = 20_000,
           shard_rows: int = 16_384, query_rows: int = 2_048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of largest inner product found, its own id left out, nearest
    first, ties to the smaller id; score is that product of the original vectors in double precision.

    The index is fitted on at most sample_rows rows (those of the least id hash) and holds every row; the number of lists is at
    least `lists` and grows with the root of the rows. A query probes lists until they hold probe_share of all rows and k rows
    besides those of its own id, so it finds k whenever there are k. Null ids and vectors that are null, zero, hold null or
    non-finite components, or have another size than most take no part. Repeated rows are found as often as they stand there,
    rows with the query's id never; a query id that stands there several times is asked once, with the least of its vectors.
    Other columns are ignored. An empty table, or one without usable vectors, gives an empty result."""
    d = dimension(rows, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    if not d:
        return rows.sparkSession.createDataFrame([], schema)

    def usable_rows(df: DataFrame) -> DataFrame:
        return df.filter(usable(vector_col) & (F.size(vector_col) == d) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).alias("__v"))

    rows, queries = usable_rows(rows), usable_rows(queries).groupBy("__id").agg(F.min("__v").alias("__v"))
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows).select("__v").toArrow()
    index = Index(matrix(sample.column(0), d), max(lists, int(total**0.5) // 4), subspaces)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, codes, lost = index.encode(matrix(batch.column(1), d))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), packed, pa.array(lost)], names=["__id", "__v", "__list", "__code", "__lost"])

    vector = rows.schema["__v"].dataType.simpleString()
    held = stored(rows.mapInArrow(encode, f"__id long, __v {vector}, __list long, __code binary, __lost double"), "encoded")
    counts = np.zeros(len(index.centroids), dtype=np.int64)  # one number a list comes to the driver
    for r in held.groupBy("__list").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["__list"]] = r["n"]
    first, many = shards_of(counts, shard_rows)
    blocks = max(1, -(-queries.count() // query_rows))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            asks = index.probed(matrix(batch.column("__v"), d), counts, batch.column("__own").to_numpy() + k, probe_share)
            query, at = np.nonzero(asks)
            parts = many[at]
            query, shard = np.repeat(query, parts), np.repeat(first[at], parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            pair = np.unique(np.stack([query, shard], axis=1), axis=0)
            packed = pa.array([np.packbits(row).tobytes() for row in asks], pa.binary())
            took = pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__v"), packed], names=["__id", "__v", "__asks"]).take(pa.array(pair[:, 0]))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(pair[:, 1])], names=["__id", "__v", "__asks", "__shard"])

    own = rows.join(queries.select("__id"), "__id", "left_semi").groupBy("__id").agg(F.count(F.lit(1)).alias("__own"))
    asked = queries.join(own, "__id", "left").select("__id", "__v", F.coalesce("__own", F.lit(0)).alias("__own"))
    left = asked.mapInArrow(probe, f"__id long, __v {vector}, __asks binary, __shard long").withColumn("__block", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int"))
    base, deal = (F.array(*(F.lit(int(x)) for x in column)) for column in (first, many))
    shard = F.get(base, F.col("__list").cast("int")) + F.pmod(F.xxhash64("__id", F.lit("shard")), F.get(deal, F.col("__list").cast("int")))
    right = held.withColumn("__shard", shard).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        else:
            asks = np.unpackbits(np.frombuffer(b"".join(asked.column("__asks").to_pylist()), dtype=np.uint8).reshape(asked.num_rows, -1), axis=1)[:, : len(counts)].astype(bool)
            codes = np.frombuffer(b"".join(held.column("__code").to_pylist()), dtype=np.uint8).reshape(held.num_rows, -1)
            found = index.search(matrix(asked.column("__v"), d), asked.column("__id").to_numpy(), asks, matrix(held.column("__v"), d), held.column("__id").to_numpy(), held.column("__list").to_numpy(), codes, held.column("__lost").to_numpy(), k, margin)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    found = left.groupBy("__shard", "__block").cogroup(right.groupBy("__shard", "__block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
