"""Codes of vectors by codebooks of small parts (operator 12).

Components become whole numbers, vectors are cut into parts, and each part position has a codebook of at most 64 entries, so
a set of entries is one unsigned number of 64 bits. To find a part's nearest entry, each of its dimensions holds the entries'
coordinates sorted, with a mask of the entries before each place: a range of the dimension is the difference of two
prefix masks. The entry next to the part in one of the dimensions gives an initial radius; the ranges of that radius are
ANDed over the dimensions, and no entry outside what is left can be as near. Those left are compared exactly, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix

#: A label that holds more than this share of the rows is met by broadcast: there are fewer than 1 / HOT of them.
HOT = 0.001
#: Entries that one mask holds; components beyond +-LIMIT count as LIMIT (so that sums of squares stay whole numbers of 64 bits).
MOST, LIMIT = 64, 1 << 26


class PartIndex:
    """Exact nearest entries (squared distance, ties to the lower index) of one part position's codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0)
        bits = np.left_shift(np.uint64(1), self.order.astype(np.uint64))
        self.before = np.zeros((len(entries) + 1, entries.shape[1]), dtype=np.uint64)
        np.bitwise_or.accumulate(bits, axis=0, out=self.before[1:])

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A radius within which each row has an entry: that of the nearest of the entries next to it in each dimension."""
        best = ((x - self.entries[0]) ** 2).sum(axis=1)
        for d in range(x.shape[1]):
            place = np.searchsorted(self.sorted[:, d], x[:, d])
            for near in (np.maximum(place - 1, 0), np.minimum(place, len(self.entries) - 1)):
                best = np.minimum(best, ((x - self.entries[self.order[near, d]]) ** 2).sum(axis=1))
        return np.sqrt(best.astype(np.float64)).astype(np.int64) + 1  # not below the root, however that rounds

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Of each row the mask of the entries within the radius in every dimension."""
        mask = np.full(len(x), self.before[-1, 0] if x.shape[1] else np.uint64((1 << len(self.entries)) - 1), dtype=np.uint64)
        for d in range(x.shape[1]):
            low, high = np.searchsorted(self.sorted[:, d], x[:, d] - radius), np.searchsorted(self.sorted[:, d], x[:, d] + radius, side="right")
            mask &= self.before[high, d] ^ self.before[low, d]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = self.candidates(x, self.radius(x))
        best, entry, rows = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(rows):  # the lowest candidate of each row, then the next
            own = mask[rows]
            low = own & (~own + np.uint64(1))
            k = np.bitwise_count(low - np.uint64(1)).astype(np.int64)
            distance = ((x[rows] - self.entries[k]) ** 2).sum(axis=1)
            nearer = distance < best[rows]
            best[rows[nearer]], entry[rows[nearer]] = distance[nearer], k[nearer]
            mask[rows] = own ^ low
            rows = rows[mask[rows] != 0]
        return entry, best


def bounds(d: int, parts: int) -> list[int]:
    """Where the parts begin and end; equal parts where d can be divided so."""
    return [k * d // parts for k in range(parts + 1)]


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype(np.int64)


def assign(x: np.ndarray, books: list[np.ndarray], cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) of entries, and of each row the sum of the parts' squared distances."""
    found = [PartIndex(book).nearest(x[:, a:b]) for book, a, b in zip(books, cuts[:-1], cuts[1:], strict=True)]
    return np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)


def moved(rows: DataFrame, books: list[np.ndarray], cuts: list[int], scale: float) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floor of the mean of the parts that it is nearest to."""
    d, size, parts = cuts[-1], len(books[0]), len(books)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((size, parts), dtype=np.int64), np.zeros((size, d), dtype=np.int64)
        for batch in batches:
            x = whole(matrix(batch.column(0), d), scale)
            entry, _ = assign(x, books, cuts)
            for p in range(parts):
                count[:, p] += np.bincount(entry[:, p], minlength=size)
                np.add.at(total[:, cuts[p] : cuts[p + 1]], entry[:, p], x[:, cuts[p] : cuts[p + 1]])
        for p in range(parts):
            held = np.flatnonzero(count[:, p])
            values = total[held, cuts[p] : cuts[p + 1]]
            lists = pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * values.shape[1], values.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), p, dtype=np.int32)), pa.array(held.astype(np.int32)), pa.array(count[held, p]), lists], names=["part", "entry", "n", "total"])

    # at most parts x 64 rows from each task, and as many in all
    found = rows.select("__v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    widest = max(b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(k))).alias(f"t{k}") for k in range(widest)))
    books = [b.copy() for b in books]
    for part, entry, n, *total in found.collect():
        books[part][entry] = [t // n for t in total[: books[part].shape[1]]]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def vector_codes(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """(id, code, error, label_error) of each row whose vector is not null and holds finite components only, and the codebooks
    of the part positions.

    A component x becomes floor(scale * x). The codebooks start as the parts of the rows with the `entries` (64 at most)
    smallest ids, equal ids ordered by vector and null ids last, fewer where there are fewer rows; each round moves an entry to
    the floored mean of the parts that are nearest to it, and an entry that is nearest to none stays. code is binary, a byte for
    each part; error sums the parts' squared distances, label_error sums error over the rows of equal label, null labels
    together. Vectors of another size than most (the smaller of equals) are dropped. Repeated rows count as often
    as they stand there; other columns are ignored; an empty table gives an empty result.

    Rows stay where they are read: a task sends sums for parts x entries at most, and the driver holds the codebooks alone.
    Errors are added up before they are shuffled, so a label of many rows weighs on no task; the sums of the large labels, fewer
    than 1 / HOT, come back to their rows by broadcast, those of the others by a shuffle."""
    if not 1 <= entries <= MOST:
        raise ValueError(f"a codebook has 1 to {MOST} entries")
    v = F.col(vector_col)
    finite = F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    live = rows.filter(finite).select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), v.cast("array<double>").alias("__v"))
    sizes = live.groupBy(F.size("__v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    d = int(sizes["d"]) if sizes else 0
    live, cuts = live.filter(F.size("__v") == d), bounds(d, parts)
    seeds = live.orderBy(F.asc_nulls_last("__id"), "__v").limit(entries).select("__v").collect()
    first = whole(np.array([r[0] for r in seeds], dtype=np.float64).reshape(len(seeds), d), scale)
    books = [first[:, a:b].copy() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for _ in range(rounds if seeds else 0):
        books = moved(live, books, cuts, scale)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, error = assign(whole(matrix(batch.column(2), d), scale), books, cuts)
            codes = [row.tobytes() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary()), pa.array(error)], names=["__id", "__label", "code", "error"])

    kinds = {c: live.schema[c].dataType.simpleString() for c in ("__id", "__label")}
    coded = stored(live.mapInArrow(encode, f"__id {kinds['__id']}, __label {kinds['__label']}, code binary, error long"), "codes")
    sums = coded.groupBy(F.col("__label").alias("__of")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n"))
    large, same = F.col("__n") > HOT * (sizes["n"] if sizes else 0), F.col("__label").eqNullSafe(F.col("__of"))
    hot = F.broadcast(sums.filter(large))
    out = coded.join(hot, same).unionByName(coded.join(hot, same, "left_anti").join(sums.filter(~large), same))
    return out.select(F.col("__id").alias(id_col), "code", "error", "label_error"), books
