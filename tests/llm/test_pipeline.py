import numpy as np
import pytest

import corpus_pipeline
from feedsift.llm import line_dedup, shingles
from feedsift.llm.common import read


def test_stages_keep_what_they_should(spark):
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "line dedup", "near-duplicates", "packing"]
    first = stages["language ID"](spark, docs, sf)
    assert first.columns == docs.columns and first.count() == len(text)  # all are prose
    second = stages["line dedup"](spark, first, sf)
    kept = {r["doc_id"]: r["kept"] for r in line_dedup.drop_common_lines(docs).collect()}
    assert second.columns == docs.columns and {r["doc_id"]: r["text"] for r in second.collect()} == kept
    third = stages["near-duplicates"](spark, second, sf)
    ids = {r["doc_id"] for r in third.collect()}
    assert third.columns == docs.columns and third.count() == len(ids)
    label = near_classes(list(kept.values()))
    first_of = {}
    for i, c in zip(kept, label, strict=True):
        first_of[c] = min(i, first_of.get(c, i))
    assert ids == set(first_of.values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == ids


def near_classes(texts):
    """The class of each text by links of shingles of five words at a similarity of 0.8 or more, all pairs compared."""
    words = [t.encode().lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_rejected_documents_go(spark):
    docs = spark.createDataFrame([(1, "the and of to is it", "en"), (2, None, "en"), (3, "12 34 -", "en"), (4, "", None), (None, "the and of it", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()} == {1, None}


def test_copies_with_few_changed_words_go(spark):
    rng = np.random.default_rng(3)
    texts = []
    for k in range(40):  # independent texts, each with copies of which 1 to 2 % of the words are changed
        words = [f"w{x}" for x in rng.integers(0, 5_000, int(rng.integers(150, 600)))]
        texts.append(words)
        for share in (0.01, 0.015, 0.02):
            copy = list(words)
            for at in rng.choice(len(words), max(1, round(share * len(words))), replace=False):
                copy[at] = f"new{k}x{at}"
            texts.append(copy)
    texts += [[], [], ["one"], ["one"], ["two", "words"], ["two", "word"]]
    label = near_classes([" ".join(t) for t in texts])
    assert len(set(label)) <= len(texts) - 100  # most of the planted copies are as similar as the stage asks for
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(label))


def test_null_and_repeated_ids(spark):
    one, two, three, four = (" ".join(f"{x}{k}" for k in range(50)) for x in "abcd")
    rows = [(None, one), (5, two), (5, two), (5, two), (None, two), (7, two + " more"), (6, three), (6, four), (None, three), (None, "alone"), (None, "alone"), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got)) == [(False, 5, two), (False, 6, three), (False, 6, four), (False, 8, ""), (True, 0, one), (True, 0, "alone")]


def test_a_chain_of_copies_in_hot_buckets_is_one_class(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 500, 150)]
    texts = []
    for k in range(260):  # a large group: similarities of pairs lie on both sides of 0.8
        copy = list(base)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            copy[at] = f"new{k}x{at}"
        texts.append(" ".join(copy))
    want = near_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(set(want)) > 5
    for block in (512, 24):  # whole buckets, and buckets cut into chunks
        monkeypatch.setattr(shingles, "BLOCK", block)
        assert sorted(r["row"] for r in shingles.survivors(docs, "doc_id").collect()) == sorted(set(want))


@pytest.mark.parametrize("size", [shingles.MATRIX_BYTES, 1000, 1])
def test_exact_similarity(monkeypatch, size):
    monkeypatch.setattr(shingles, "MATRIX_BYTES", size)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (0, 0, 1, 1, 90, 95, 300, 310, 400)] + [np.arange(100, dtype=np.uint64), np.arange(89, dtype=np.uint64), np.arange(80, dtype=np.uint64), np.arange(79, dtype=np.uint64)]
    i, j = np.nonzero(~np.eye(len(sets), dtype=bool))
    want = [5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)) for a, b in ((sets[x].tolist(), sets[y].tolist()) for x, y in zip(i, j, strict=True))]
    assert shingles.alike(sets, i, j).tolist() == want


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_extra_columns_with_clashing_names_stay(spark):
    names = ["row", "node", "class", "rank", "table", "key", "kept", "n_lines", "score", "__bucket"]
    rows = [(k, f"the and of to is it {'x' * k}\nthe line", "en", *[str(k)] * len(names)) for k in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", *names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", *names]
        assert all(r["node"] == str(r["doc_id"]) for r in docs.collect())
    assert corpus_pipeline.packed(spark, docs, "").count() >= 1


def test_a_leader_of_many_pairs_is_dealt_to_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(0, 900, 300)]
    texts = [" ".join([*words[:k % 290], f"new{k}", *words[k % 290 + 1 :]]) for k in range(3000)] + [" ".join(f"other{k}x{x}" for x in range(60)) for k in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 3000)] + [(k + 1, k) for k in range(3000, 3038)], "a long, b long")
    monkeypatch.setattr(shingles, "BUCKET_BYTES", 100_000)
    dealt = shingles.dealt_pairs(pairs, frame)
    held = dealt.join(frame.withColumnRenamed("node", "a"), "a").groupBy(dealt.columns[0]).agg({"text": "count"}).collect()
    assert dealt.count() == 3037 and max(r[1] for r in held) * len(texts[0]) < 6 * 100_000
    got = {(r["a"], r["b"]) for r in shingles.judged(pairs, frame).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    assert got == {(r["a"], r["b"]) for r in pairs.collect() if 5 * len(sets[r["a"]] & sets[r["b"]]) >= 4 * len(sets[r["a"]] | sets[r["b"]])}


def test_table_keys_are_bits_of_the_simhash():
    hashes = np.random.default_rng(2).integers(0, 1 << 63, (301, 2), dtype=np.uint64)
    bits = 5
    mixed = shingles.mixers(shingles.COMPARED + shingles.tables(bits) * bits)
    of_one = np.array([np.unpackbits(shingles.fingerprint(hashes[k : k + 1], mixed).view(np.uint8), bitorder="little") for k in range(301)])
    majority = of_one.sum(axis=0) > 150
    want = [(t << bits) + sum(int(majority[shingles.COMPARED + t * bits + k]) << k for k in range(bits)) for t in range(shingles.tables(bits))]
    assert shingles.table_keys(shingles.fingerprint(hashes, mixed), bits).tolist() == want


@pytest.mark.parametrize("bits", [6, 9, 12])
def test_pairs_just_at_the_similarity_share_a_key(bits):
    rng = np.random.default_rng(bits)
    mixed = shingles.mixers(shingles.COMPARED + shingles.tables(bits) * bits)
    for _ in range(100):  # 120 of 150 shingles in common: 0.8
        h = rng.integers(0, 1 << 63, (150, 2), dtype=np.uint64)
        one, two = (shingles.fingerprint(x, mixed) for x in (h[:135], h[15:]))
        assert (shingles.table_keys(one, bits) == shingles.table_keys(two, bits)).any()
        assert np.bitwise_count((one ^ two)[: len(shingles.MARKS)].view(np.uint64)).sum() <= shingles.RADIUS
