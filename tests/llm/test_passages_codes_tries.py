"""Operators 11 to 13 against plain versions, on small hard tables: nulls, empty and long texts, ties, repeated rows, no rows,
columns of clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedsift.llm import prefix_trie, substrings, vector_codes
from feedsift.llm.contraction import subtree_totals
from feedsift.operators import scan

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_removal(rows, size):
    """(id, n_words, n_removed, kept) by all windows of all texts; a null id comes last."""
    words = [(10**9 if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for rank, _, w in words:
        for k in range(len(w) - size + 1):
            least[tuple(w[k : k + size])] = min(rank, least.get(tuple(w[k : k + size]), rank))
    out = []
    for rank, i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < rank:
                gone.update(range(k, k + size))
        runs = [(a, next(b for b in range(a, len(w) + 1) if b not in gone)) for a in sorted(gone) if a - 1 not in gone]
        out.append((i, len(w), len(gone), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_repeated_passages_go_where_a_smaller_id_holds_them(spark):
    rng = np.random.default_rng(8)
    passages = [" ".join(f"p{k}w{x}" for x in rng.integers(0, 9, 9)) for k in range(6)]
    rows = [(None, None), (0, ""), (1, " \n\t "), (2, "one two"), (None, passages[0]), (None, passages[0]), (3, "x " + passages[0] + " y"), (3, passages[0]), (-5, passages[1] + "  é ü "), (4, "a" * 5000)]
    for k in range(10, 60):
        parts = [passages[int(rng.integers(6))] if rng.random() < 0.5 else " ".join(f"w{x}" for x in rng.integers(0, 400, 7)) for _ in range(5)]
        rows.append((int(rng.integers(10, 40)), ("\n" if k % 3 else "  ").join(parts)))
    rows += [(70, " ".join(["again"] * 50)), (71, " ".join(["again"] * 20)), (72, " ".join(f"l{x}" for x in rng.integers(0, 50, 30_000)))]
    rows += [rows[12], rows[12]]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_words int, kept string").repartition(3)
    want = sorted(map(repr, plain_removal(rows, 5)))
    for bucket in (8_000_000, 700):  # one bucket, and many
        found = substrings.remove_repeats(docs, size=5, bucket_bytes=bucket, slice_bytes=bucket // 2)
        assert sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], [tuple(x) for x in r["removed"]], r["kept"])) for r in found.collect()) == want
    assert substrings.remove_repeats(docs.filter("false")).count() == 0


def test_word_and_window_hashes_do_not_depend_on_where_they_stand(monkeypatch):
    text = (" ".join(f"w{k % 97}é" for k in range(3000)) + " ").encode()
    powers = substrings.Powers(substrings._WORD_BASE), substrings.Powers(substrings._WINDOW_BASE)
    whole = substrings.Texts([text, b"", text]).windows(7, powers)
    monkeypatch.setattr(substrings, "BYTES", 100)
    monkeypatch.setattr(substrings, "WORDS", 64)
    small = substrings.Texts([text, b"", text]).windows(7, powers)
    assert all((a == b).all() for a, b in zip(whole, small, strict=True))
    keys = whole[0].reshape(2, -1)
    assert (keys[0] == keys[1]).all() and len(np.unique(keys[0])) == 97


def plain_codes(rows, parts, entries, rounds):
    """Codes, errors and codebooks in plain Python."""
    live = [(i, label, [int(np.floor(256.0 * x)) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = len(live[0][2])
    cut = [k * d // parts for k in range(parts + 1)]
    seeds = sorted(live, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][cut[p] : cut[p + 1]] for r in seeds] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in seeds]
            for r in live:
                x = r[2][cut[p] : cut[p + 1]]
                held[nearest(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(h) for c in zip(*h, strict=True)] if h else e for e, h in zip(books[p], held, strict=True)]
    out, by_label = [], Counter()
    for i, label, x in live:
        found = [nearest(x[cut[p] : cut[p + 1]], books[p]) for p in range(parts)]
        out.append((i, label, bytes(k for _, k in found), sum(e for e, _ in found)))
        by_label[label] += out[-1][3]
    return [(i, c, e, by_label[label]) for i, label, c, e in out], books


@pytest.mark.parametrize("n", [1, 40, 500])
def test_codes_equal_a_plain_reading(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), None if k % 7 == 0 else int(rng.integers(5)), [float(np.float32(x)) for x in rng.normal(0, 0.3, 16)]) for k, i in enumerate(rng.permutation(n))]
    rows += [(9, 1, None), (10, 2, [None] + [0.0] * 15), (11, 2, [float("nan")] + [0.0] * 15), (12, 2, [float("inf")] + [1.0] * 15)]
    if n > 40:
        rows += [rows[3], rows[3], (None, None, [0.0] * 16), (500, 3, [0.1] * 16), (501, 3, [0.1] * 16)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, label int, embedding array<float>, error int").repartition(4)
    coded, books = vector_codes.vector_codes(frame, parts=4)
    want, plain_books = plain_codes(rows, 4, 64, 2)
    assert [b.tolist() for b in books] == plain_books
    assert sorted(map(repr, ((r["vec_id"], bytes(r["code"]), r["error"], r["label_error"]) for r in coded.collect()))) == sorted(map(repr, want))
    empty, books = vector_codes.vector_codes(frame.filter("false"))
    assert empty.count() == 0 and vector_codes.books_digest(books)
    odd, _ = vector_codes.vector_codes(frame.select("vec_id", "label", F.when(F.col("vec_id") == 0, F.array(F.lit(1.0))).otherwise(F.col("embedding")).alias("embedding")), parts=3)
    assert odd.count() <= len(want)  # vectors of another size than most are dropped, and parts need not be equal


def test_masks_find_the_nearest_entry_whatever_the_size():
    rng = np.random.default_rng(0)
    for width in (0, 1, 3, 8):
        for entries in (1, 5, 64):
            for scale in (2, 300, 1 << 26):  # ties are frequent at 2
                book, x = (rng.integers(-scale, scale + 1, (n, width)) for n in (entries, 300))
                entry, error = vector_codes.PartIndex(book).nearest(x)
                all_of = ((x[:, None] - book[None]) ** 2).sum(axis=2)
                assert (entry == all_of.argmin(axis=1)).all() and (error == all_of.min(axis=1)).all()


def plain_trie(rows, heads, every=5):
    """Nodes as op13 gives them. rows: (conv, turn, role, text), turns of a conversation distinct."""
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {c: convs.get(c - int(math.fmod(c, every)), [])[: heads(c)] + own[heads(c) :] for c, own in convs.items()}
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, held in members.items():
        below = [m for m in members if m[: len(node)] == node]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in members)]
        ends = sorted(c for c in held if len(rebuilt[c]) == len(node))
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        kids = [m for m in below if len(m) == len(node) + 1]
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def conversations(seed):
    rng = np.random.default_rng(seed)
    rows = [(None, 1, "user", "lost"), (3, None, None, None), (3, 1, "user", "é"), (4, 0, "user", "x" * 5000), (100, 5, "", ""), (-7, 0, "user", "minus"), (-5, 0, "user", "minus")]
    for c in range(20, 80):
        if c % 9:  # some are absent, multiples of five among them
            rows += [(c, int(t), ["user", "assistant"][t % 2], f"t{rng.integers(0, 1 + t // 2)}") for t in range(int(rng.integers(1, 12)))]
    rows += [(c, t, "user", "same") for c in range(200, 240) for t in range(12)]  # a third of all: one conversation many times
    return rows


def crc_heads(c):
    return zlib.crc32(str(c).encode()) % 9


def test_the_trie_equals_a_plain_one(spark):
    rows = conversations(1)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, id int").repartition(5)
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = prefix_trie.prefix_trie(frame, heads).select(*names)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_trie(rows, crc_heads)))
    assert prefix_trie.prefix_trie(frame.filter("false"), heads).count() == 0
    alone = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in prefix_trie.prefix_trie(alone).select("depth", "n_convs", "n_leaves").collect()) == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_totals_of_long_chains_and_wide_trees(spark):
    rng = np.random.default_rng(5)
    parent = [None] + [k - 1 if k < 300 else int(rng.integers(0, k)) if k < 500 else 7 for k in range(1, 900)] + [None]
    value = [int(x) for x in rng.integers(0, 100, len(parent))]
    total = list(value)
    for k in range(len(parent) - 1, 0, -1):
        if parent[k] is not None:
            total[parent[k]] += total[k]
    nodes = spark.createDataFrame([(k, p, 1, v) for k, (p, v) in enumerate(zip(parent, value, strict=True))], "id long, parent long, ones long, value long")
    got = {r["id"]: r["value"] for r in subtree_totals(nodes, ["ones", "value"]).collect()}
    assert got == dict(enumerate(total))


def test_what_a_group_brings_over_partitions():
    ends = [(3, "b", ("b", 4), True), (0, "a", ("b", 2), False), (2, "b", ("b", 1), True), (5, "c", ("d", 9), False), (4, "b", ("c", 3), False)]
    assert scan.carried(ends, lambda a, b: a + b, 0) == {0: 0, 2: 2, 3: 3, 4: 7, 5: 3}
