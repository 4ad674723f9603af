"""Order-preserving packing of token sequences into windows (operator 8).

Documents are dealt into hash groups of about equal text. A group's documents, in order of id, make one stream of tokens.
Windows are cut at document ends, sentence ends or, at a higher penalty, when they are full. Dynamic programming over
these places minimises padding plus the penalties of cuts inside documents plus a cost per window; as padding grows by one
with each place that a window falls short, the best start of a window is the least of (cost + position) over the places
in reach, which a monotone queue keeps. Windows whose length is a power of two aren't padded: they are further starts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BUCKET, bucket_of, buckets, small_batches, whole_text
from .pieces import PieceIds, byte_level

#: Bits of a sequence_id that number the windows of a group.
WINDOW_BITS = 26
SENTENCE_END = {".", "!", "?", "\n", "。", "！", "？"}


class Ids(PieceIds):
    """The ids of texts and where their sentences end."""

    def __init__(self, path: str):
        super().__init__(path)
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        signs = tuple(byte_level(x) for x in SENTENCE_END)
        self.ends, self.feeds = (np.array([x.endswith(last) for x in names]) for last in (signs, byte_level("\n")))
        self.blank = np.array([x.startswith((byte_level(" "), byte_level("\n"))) for x in names])

    def sentences(self, ids: bytes) -> np.ndarray:
        """The places behind an id that ends a sentence: a line feed, or a sign with white space to follow."""
        ids = np.frombuffer(ids, dtype="<u4")
        return np.flatnonzero(self.feeds[ids[:-1]] | (self.ends[ids[:-1]] & self.blank[ids[1:]])) + 1


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    return Ids(path)


def choose_cuts(places: np.ndarray, penalties: np.ndarray, window: int, window_cost: float = 0.0) -> list[int]:
    """The places (ascending, above 0, gaps of at most window) at which windows end, at least cost; the last is one.

    cost(j) = penalty(j) + window_cost + the least of cost(i) + padding(j - i) over places i (or 0) in reach."""
    line = np.concatenate([[0], places])
    index = np.full(int(line[-1]) + 1, -1, dtype=np.int32)
    index[line] = np.arange(len(line), dtype=np.int32)
    # the places a power of two before each place, as one list with bounds
    hits = [(j, index[line[j] - p]) for p in (1 << k for k in range(window.bit_length())) if p < window for j in [np.flatnonzero(line >= p)]]
    ends = np.concatenate([j[i >= 0] for j, i in hits] or [np.zeros(0, dtype=np.int64)])
    order = np.argsort(ends, kind="stable")
    before = np.concatenate([i[i >= 0] for _, i in hits] or [ends])[order].tolist()
    bounds = np.searchsorted(ends[order], np.arange(len(line) + 2)).tolist()
    at, cost, best, keys = line.tolist(), [0.0], [0], [0.0]  # keys: cost + position
    queue: deque[int] = deque([0])  # of places in reach, keys rising
    pop, push, shift = queue.pop, queue.append, queue.popleft
    upto = 0
    for j, (here, penalty) in enumerate(zip(at[1:], (penalties + window_cost).tolist(), strict=True), 1):
        start = queue[0]
        while here - at[start] > window:
            shift()
            start = queue[0]
        least = keys[start] + window - here
        since, upto = upto if j > 1 else bounds[1], bounds[j + 1]
        if since != upto:
            for k in before[since:upto]:
                if cost[k] < least:
                    least, start = cost[k], k
        least += penalty
        cost.append(least)
        best.append(start)
        least += here
        keys.append(least)
        while queue and keys[queue[-1]] >= least:
            pop()
        push(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = best[j]
    return cuts[::-1]


def cut_places(ends: list[np.ndarray], totals: list[int], window: int, split: float, hard: float) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows may end and their penalties. ends: sentence ends in each document; totals: its tokens.

    Places: document ends (no penalty), sentence ends (split), and (hard) what lies a full window behind the last of these
    in each sixteenth of a window, or at a multiple of the window, so that no gap is wider than a window."""
    bases = np.concatenate([[0], np.cumsum(totals)])
    total = int(bases[-1])
    kind = np.zeros(total + 1, dtype=np.uint8)  # of each place: 0 none, 1 full, 2 sentence, 3 document
    kind[np.concatenate([e + b for e, b in zip(ends, bases[:-1], strict=True)]).astype(np.int64)] = 2
    kind[bases] = 3
    soft = np.flatnonzero(kind)[1:]
    sixteenth = soft // max(1, window // 16)
    full = np.concatenate([soft[np.append(sixteenth[1:] != sixteenth[:-1], True)] + window, np.arange(window, total, window)])
    full = full[full < total]
    kind[full[kind[full] == 0]] = 1
    places = np.flatnonzero(kind)[1:]  # but for the start
    return places, np.array([0.0, hard, split, 0.0])[kind[places]]


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, split_penalty: float = 2.0, hard_penalty: float = 8.0, window_cost: float = 8.0,
         group_bytes: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of packed windows: (id, start, length, ids, doc_tokens, sequence_id, offset); ids is binary, little-endian
    unsigned 32 bit.

    Each document's ids and end_id lie in exactly one piece each; pieces of a sequence are gapless from 0. Null texts count
    as empty (end_id alone); a repeated row is packed once more; ties in id are ordered by text. Null ids are one more id.
    Other columns are ignored. A text longer than a group is packed whole, in its own group. Texts are shuffled once."""
    n = buckets(docs, text_col, group_bytes)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(x, T.LongType()) for x in ("doc_tokens", "sequence_id", "offset"))])
    end = np.array([end_id], dtype="<u4").tobytes()

    def packed(group: int, keys: list, tokens: list[bytes], ends: list[np.ndarray]) -> pa.RecordBatch:
        totals = [len(x) // 4 for x in tokens]
        cuts = choose_cuts(*cut_places(ends, totals, window, split_penalty, hard_penalty), window, window_cost)
        rows: list[tuple] = []
        doc, base, opened = 0, 0, 0
        for k, cut in enumerate(cuts):
            at = opened
            while at < cut:
                if at == base + totals[doc]:
                    base += totals[doc]
                    doc += 1
                upto = min(cut, base + totals[doc])
                rows.append((keys[doc], at - base, upto - at, tokens[doc][4 * (at - base) : 4 * (upto - base)], totals[doc], (group << WINDOW_BITS) + k, at - opened))
                at = upto
            opened = cut
        columns = list(zip(*rows, strict=True))
        kinds = [keys_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal keys_type
        table = ids_of(tokenizer_path)
        group, keys, tokens, ends = None, [], [], []
        for batch in batches:
            keys_type = batch.schema.field(1).type
            for g, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if g != group and keys:
                    yield packed(group, keys, tokens, ends)
                    keys, tokens, ends = [], [], []
                group = g
                keys.append(key)
                ids = table.of(text.as_py())
                tokens.append(ids + end)
                ends.append(table.sentences(ids))
                table.trim()
        if keys:
            yield packed(group, keys, tokens, ends)

    keys_type: pa.DataType = pa.int64()
    rows = small_batches(docs).select(F.col(id_col), whole_text(text_col).alias("__text")).select(bucket_of(n, id_col, "__text").alias(BUCKET), id_col, "__text")
    return rows.repartition(BUCKET).sortWithinPartitions(BUCKET, id_col, "__text").mapInArrow(run, schema)


def digest(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return packed.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
