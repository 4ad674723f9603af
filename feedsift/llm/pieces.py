"""Texts as sequences of numbered pieces, so that a byte-level BPE has to see each distinct piece only once.

A byte-level BPE cuts a text by a pattern before it merges. No match of that pattern holds a white space after another
character, but for white-space runs themselves; so a boundary between a character that is no white space and a white
space is safe, and where a white space stands alone, both its sides are."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from struct import Struct, pack

import numpy as np

#: Two white spaces in a row, or one other than blank and line feed: such texts are cut by CUT.
RUNS = ("  ", "\n\n", " \n", "\n ")
OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CUT = re.compile(r"(?<=\S)(?=\s)")
#: One blank at most, in front of other signs.
PLAIN = re.compile(r" ?\S+")
LONG = 1_000
RAW = "\0"
#: Pieces of ASCII signs and Latin letters that every version of Unicode has, and how the pattern cuts them.
PLAIN_SIGNS = re.compile(" ?[!-~À-ÖØ-öø-ɏ]+")
PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^A-Za-zÀ-ÖØ-öø-ɏ0-9 ]+")
#: Bytes of a line of pieces and of a batch that goes to the tokenizer at once.
LINE, BATCH = 16_000, 256_000
EDGE = re.compile(r"(?<=\S)\s")


def slices(text: str, size: int = 1_000_000) -> Iterator[str]:
    """The text in parts of about size characters, cut at safe boundaries; a part without one stays whole."""
    at = 0
    while len(text) - at > size and (edge := EDGE.search(text, at + size)):
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:] if at else text


def pieces(text: str) -> list[str]:
    """Keys of strings that make up the text and can be encoded one by one: `word` stands for a blank and the word, and
    what follows RAW for itself. So the usual text, words with single blanks between, costs one split."""
    if RAW in text or any(x in text for x in RUNS) or OTHER.search(text):
        return [RAW + x for x in CUT.split(text)]
    return (RAW + text.replace("\n", f" {RAW}\n {RAW}")).split(" ")


def piece_of(key: str) -> str:
    return key[1:] if key[:1] == RAW else f" {key}"


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class PieceTable:
    """Numbers the distinct pieces met and keeps, in the same order, what learn says of each. From batch to batch at most about
    `most` pieces stay: when there are more, those that were met once go (keep: the numbers of those that stay, in order)."""

    def __init__(self, learn: Callable[[list[str]], None], keep: Callable[[np.ndarray], None], most: int = 600_000):
        self.numbers, self.uses, self.learn, self.keep, self.most = Numbers(), np.zeros(0, dtype=np.int64), learn, keep, most

    def number(self, text: str) -> np.ndarray:
        get = self.numbers.__getitem__
        parts = [np.fromiter(map(get, found), dtype=np.int32, count=len(found)) for found in map(pieces, slices(text))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def settle(self, found: list[np.ndarray]) -> None:
        """Learns the pieces numbered since the last call and counts the uses in these texts."""
        known = len(self.uses)
        if len(self.numbers) > known:
            self.learn(list(map(piece_of, islice(self.numbers, known, None))))
        uses = np.bincount(np.concatenate(found), minlength=len(self.numbers)) if found else np.zeros(len(self.numbers), dtype=np.int64)
        uses[:known] += self.uses
        self.uses = uses

    def trim(self) -> None:
        if len(self.uses) > self.most:
            least = 2
            while (self.uses >= least).sum() > self.most // 2:
                least *= 2
            stay = np.flatnonzero(self.uses >= least)
            names = list(self.numbers)
            self.numbers = Numbers(zip(map(names.__getitem__, stay.tolist()), range(len(stay)), strict=True))
            self.uses = np.ones(len(stay), dtype=np.int64)
            self.keep(stay)


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def even_batches(texts: Sequence[str], size: int) -> Iterator[Sequence[str]]:
    """The texts in batches of about size bytes; a longer text is a batch of its own."""
    ends = np.cumsum(np.fromiter((len(x) if x.isascii() else len(x.encode()) for x in texts), dtype=np.int64, count=len(texts)))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield texts[at:upto]
        at = upto


def encode_pieces(tokenizer, new: list[str]) -> list[bytes]:
    """The ids of each piece, as little-endian unsigned 32-bit numbers, encoded in batches of about equal bytes. Pieces
    without a white space inside go as lines of longer texts, themselves of about equal bytes: a lone line feed is a token
    of its own between them, at which the ids are cut again. The others, and pieces of over LONG characters, are texts of
    their own."""
    (feed,) = tokenizer.encode("\n", add_special_tokens=False).ids
    lined = [len(x) <= LONG and PLAIN.fullmatch(x) is not None for x in new]
    coded: list[bytes] = []
    lines = ["\n".join(x) for x in even_batches([x for x, plain in zip(new, lined, strict=True) if plain], LINE)]
    for batch in even_batches(lines, BATCH):
        for text in tokenizer.encode_batch_fast(batch, add_special_tokens=False):
            ids = np.array(text.ids, dtype="<u4")
            held, feeds = ids.tobytes(), (4 * np.flatnonzero(ids == feed)).tolist()
            coded += [held[a:b] for a, b in zip([0, *(f + 4 for f in feeds)], [*feeds, len(held)], strict=True)]
    if len(coded) == len(new):
        return coded
    alone = (np.array(text.ids, dtype="<u4").tobytes() for batch in even_batches([x for x, plain in zip(new, lined, strict=True) if not plain], BATCH) for text in tokenizer.encode_batch_fast(batch, add_special_tokens=False))
    found = iter(coded)
    return [next(found if plain else alone) for plain in lined]


def byte_letters() -> list[str]:
    """How a byte-level vocabulary writes bytes: visible ones of Latin-1 as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


BYTES = byte_letters()


def byte_level(text: str) -> str:
    return "".join(BYTES[b] for b in text.encode())


BLANK, word = byte_level(" "), re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
LETTERS = {c: byte_level(chr(c)) for c in [0x20, *range(0xC0, 0x250)]}
#: How to pack so many ids as little-endian unsigned 32-bit numbers.
PACK = [Struct(f"<{n}I").pack for n in range(64)]


class PieceIds(dict):
    """The ids of pieces by their keys (see pieces), as little-endian unsigned 32-bit numbers, found when first asked for. A
    piece of plain signs is cut as the pattern cuts it and its parts go straight to the merges; any other goes to the
    tokenizer. Pieces not asked for since the table was last full are forgotten."""

    def __init__(self, path: str, most: int = 300_000):
        self.tokenizer, self.most, self.old = tokenizer(path), most, {}
        self.tokenize = self.tokenizer.model.tokenize
        self.special = any(PLAIN_SIGNS.fullmatch(t.content) and "<|" not in t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def __missing__(self, key: str) -> bytes:
        found = self.old.pop(key, None)
        if found is None and not self.special and (key.isalpha() if key.isascii() else word(key)):  # by far the most
            ids = [t.id for t in self.tokenize(BLANK + (key if key.isascii() else byte_level(key)))]
            found = PACK[len(ids)](*ids) if len(ids) < len(PACK) else pack(f"<{len(ids)}I", *ids)
        self[key] = found = self.encode(piece_of(key)) if found is None else found
        return found

    def encode(self, piece: str) -> bytes:
        if self.special or not PLAIN_SIGNS.fullmatch(piece) or "<|" in piece:
            return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        parts = PARTS.findall(piece)
        if len(parts) > 1:
            return b"".join([self[p[1:] if p[0] == " " else RAW + p] for p in parts])
        ids = [t.id for t in self.tokenize(piece.replace(" ", LETTERS[0x20]) if piece.isascii() else piece.translate(LETTERS))]
        return pack(f"<{len(ids)}I", *ids)

    def of(self, text: str) -> bytes:
        """The ids of a whole text."""
        get = self.__getitem__
        return b"".join([b"".join(map(get, pieces(x))) for x in slices(text)])

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
