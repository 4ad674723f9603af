"""Byte-level BPE, encoding and decoding (operator 9).

The distinct pieces of an Arrow batch lie in one array of symbols. An index maps each mergeable pair, by its rank, to all
its positions; the ranks that are active are applied in ascending order, each to all its positions at once, and the
pairs that a merge makes join the lists of their ranks. As a merge's parts are made by merges of lower rank, no rank
becomes active again after its turn."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches, whole_text
from .pieces import PieceTable

#: Fixed value: the pattern by which the vocabulary's texts are cut before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files: itself, or the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class PairIndex:
    """Encodes many byte strings at once by merges on an index from pairs to positions."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs, vocab = byte_signs(), spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.first = np.full(256, -1, dtype=np.int64)
        for sign, b in signs.items():
            self.first[b] = vocab[sign]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")  # position among the sorted keys -> rank
        self.keys = keys[self.order]
        self.left, self.right = keys >> 32, keys & 0xFFFFFFFF
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.bytes = {i: bytes(signs[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for t, i in self.special.items()}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 where there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == keys), self.order[at], -1)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        if not words:
            return []
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(sizes + 1) - sizes  # a wall stands before each word and at the end
        symbols = np.full(int(sizes.sum()) + len(words) + 1, -1, dtype=np.int64)
        inside = np.ones(len(symbols), dtype=bool)
        inside[starts - 1] = inside[-1] = False
        symbols[inside] = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        after[-1] = len(symbols) - 1
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def index(positions: np.ndarray, ranks: np.ndarray) -> None:
            positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            bounds = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rank = int(ranks[a])
                if rank not in lists:
                    lists[rank] = []
                    heapq.heappush(active, rank)
                lists[rank].append(positions[a:b])

        index(np.arange(len(symbols) - 1), self.ranks(symbols[:-1], symbols[1:]))
        while active:
            rank = heapq.heappop(active)
            held = lists.pop(rank)
            at = np.unique(held[0] if len(held) == 1 else np.concatenate(held))
            left, right = self.left[rank], self.right[rank]
            at = at[(symbols[at] == left) & (symbols[after[at]] == right)]
            if left == right and len(at) > 1:  # of overlapping pairs the leftmost goes first
                taken, last = [], -1
                for p in at.tolist():
                    if p != last:
                        taken.append(p)
                        last = int(after[p])
                at = np.array(taken, dtype=np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbols[at], symbols[gone] = self.made[rank], -2
            after[at] = after[gone]
            before[after[at]] = at
            lower, upper = before[at], after[at]
            index(np.concatenate([lower, at]), self.ranks(np.concatenate([symbols[lower], symbols[at]]), np.concatenate([symbols[at], symbols[upper]])))
        alive = symbols >= 0
        counts = np.add.reduceat(alive, starts - 1).tolist()
        flat, out, at = symbols[alive], [], 0
        for n in counts[: len(words)]:
            out.append(flat[at : at + n])
            at += n
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Codes(PieceTable):
    """Of each piece: how many ids, the ids as decimal text, and the bytes that they decode to."""

    def __init__(self, path: str):
        import regex

        self.bpe = PairIndex(path)
        self.cut = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")") if self.bpe.special else None
        self.lengths, self.ids, self.texts = np.zeros(0, dtype=np.int64), [], []
        super().__init__(self.add, self.stay)

    def stay(self, numbers: np.ndarray) -> None:
        self.lengths = self.lengths[numbers]
        self.ids, self.texts = (list(map(held.__getitem__, numbers.tolist())) for held in (self.ids, self.texts))

    def words(self, piece: str) -> list[str]:
        if self.specials and self.specials.search(piece):
            return [w for part in self.specials.split(piece) for w in ([part] if part in self.bpe.special else self.cut.findall(part))]
        return self.cut.findall(piece)

    def add(self, new: list[str]) -> None:
        cut = [self.words(p) for p in new]
        distinct = list(dict.fromkeys(w for ws in cut for w in ws if w not in self.bpe.special))
        coded = dict(zip(distinct, (x.tolist() for x in self.bpe.encode([w.encode() for w in distinct])), strict=True)) | {t: [i] for t, i in self.bpe.special.items()}
        lengths = []
        for ws in cut:
            ids = [i for w in ws for i in coded[w]]
            lengths.append(len(ids))
            self.ids.append("".join(f",{i}" for i in ids))
            self.texts.append(self.bpe.decode(ids))
        self.lengths = np.concatenate([self.lengths, np.array(lengths, dtype=np.int64)])


@lru_cache(maxsize=1)
def codes(path: str) -> Codes:
    return Codes(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of each row of docs: the ids of the whole text as decimal numbers joined by commas,
    and the text that they decode to (invalid UTF-8 replaced).

    Special strings in a text become their ids, as is the library's default. Null texts count as empty (0 tokens, empty
    strings). Null ids, repeated rows and other columns make no difference: one row comes out for each that goes in."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codes(tokenizer_path)
        for batch in batches:
            found = [table.number(t.as_py()) for t in batch.column(1)]
            table.settle(found)
            n = [int(table.lengths[x].sum()) for x in found]
            id_of, text_of = table.ids.__getitem__, table.texts.__getitem__
            ids = ["".join(map(id_of, x.tolist()))[1:] for x in found]
            decoded = [b"".join(map(text_of, x.tolist())).decode("utf-8", "replace") for x in found]
            table.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return small_batches(docs).select(id_col, whole_text(text_col).alias("__text")).mapInArrow(run, schema)
