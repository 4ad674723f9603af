"""Token counts, packing and BPE against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest

from feedsift.llm import bpe, packing, token_counts
from feedsift.llm.pieces import slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "the", "word", " ", " ", " ", "  ", "\n", "\t", " \n", "é", "1", "23", "!", "'s", "<|endoftext|>", "\x1c", "\x85", "中", "😀", "aaaa", "\r\n", "\0", "½", ".", "'re", "’", "word.", " Wört,", "###", "_", "ǅ", "×", "x2y", "?!", "don't"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    return ["", " ", "\n", "<|endoftext|>", "a <|endoftext|> b", "x" * 5000, "word " * 3000] + ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]


def test_ids_lengths_and_decoded_text_equal_the_library(texts):
    library = token_counts.tokenizer(PATH)
    tables, packed = (token_counts.Lengths(PATH), bpe.Codes(PATH)), packing.Ids(PATH)
    numbers = [[t.number(x) for x in texts] for t in tables]
    for t, found in zip(tables, numbers, strict=True):
        t.settle(found)
    for k, x in enumerate(texts):
        ids = library.encode(x, add_special_tokens=False).ids
        assert tables[0].lengths[numbers[0][k]].sum() == len(ids), repr(x)
        assert packed.of(x) == np.array(ids, dtype="<u4").tobytes(), repr(x)
        assert "".join(tables[1].ids[n] for n in numbers[1][k])[1:] == ",".join(map(str, ids)), repr(x)
        assert b"".join(tables[1].texts[n] for n in numbers[1][k]).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False), repr(x)


def test_a_table_that_forgets_gives_the_same(texts):
    library = token_counts.tokenizer(PATH)
    packed = packing.Ids(PATH)
    packed.most = 200
    for x in texts:
        assert packed.of(x) == np.array(library.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(x)
        packed.trim()
        assert len(packed) <= 200
    for t in (token_counts.Lengths(PATH), bpe.Codes(PATH)):
        t.most = 300
        for at in range(0, 4000, 100):
            found = [t.number(x) for x in texts[at : at + 100]]
            t.settle(found)
            for x, n in zip(texts[at : at + 100], found, strict=True):
                assert t.lengths[n].sum() == len(library.encode(x, add_special_tokens=False).ids)
            t.trim()
            assert len(t.numbers) == len(t.uses) == len(t.lengths) <= 300


def test_slices_make_up_the_text():
    text = "ab  cd\n" * 1000 + "z" * 50
    assert "".join(slices(text, 100)) == text and len(list(slices(text, 100))) > 50


def brute_cost(places, penalties, window, window_cost):
    cost = {0: 0.0}
    for p, extra in zip(places, penalties, strict=True):
        pad = lambda n: 0 if n & (n - 1) == 0 else window - n
        cost[p] = extra + window_cost + min(c + pad(p - q) for q, c in cost.items() if p - q <= window)
    return cost[places[-1]]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_cost_the_least(seed):
    rng = np.random.default_rng(seed)
    window = 16
    totals = rng.integers(1, 40, 6).tolist()
    ends = [np.sort(rng.integers(1, t + 1, rng.integers(0, 5))) for t in totals]
    places, penalties = packing.cut_places(ends, totals, window, 2.0, 5.0)
    assert np.diff(places, prepend=0).max() <= window and places[-1] == sum(totals)
    cuts = packing.choose_cuts(places, penalties, window, 3.0)
    extra = dict(zip(places.tolist(), penalties.tolist(), strict=True))
    lengths = np.diff([0, *cuts])
    got = sum(extra[c] + 3.0 for c in cuts) + sum(0 if n & (n - 1) == 0 else window - n for n in lengths.tolist())
    assert lengths.max() <= window and got == pytest.approx(brute_cost(places.tolist(), penalties.tolist(), window, 3.0))


def test_sentences_end_at_line_feeds_and_before_white_space():
    table = packing.Ids(PATH)
    text = "One. Two 3.5 three! four?\nfive. "
    ids = table.of(text)
    cuts = [4 * k for k in table.sentences(ids).tolist()]
    assert [table.tokenizer.decode(np.frombuffer(ids[a:b], dtype="<u4").tolist()) for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)] == ["One.", " Two 3.5 three!", " four?", "\n", "five.", " "]
