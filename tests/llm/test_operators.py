"""Each operator on hard small tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing column names."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from feedsift.llm import bpe, graph, language, line_dedup, lm_scoring, nearest, packing, queries, simhash, token_counts, url_filter, vector_dedup

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double, component_id long, kept string, ids string, host string"
ENGLISH, GERMAN = "the quick brown fox jumps over the lazy dog and runs", "der schnelle braune fuchs springt und das ist nicht alles"
TEXTS = [None, "", " \n ", "one", ENGLISH, ENGLISH, ENGLISH + " away", GERMAN, GERMAN.upper(), "shared line\nown " + ENGLISH, "  SHARED line\t\nother", "shared line", "12 34", "a" * 3000,
         "\n".join(f"{ENGLISH} {k}." for k in range(400)), "<|endoftext|> x", "é\u0000 ü\r\n\r\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None if k % 5 == 4 else ("de" if t and "der" in t.lower()[:4] else "en"), "src", None, 7, 1.0, 5, "x", "y", "z") for k, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "null id", "en", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language(docs, empty):
    known = language.profiles(docs.filter("doc_id is null or doc_id % 4 <> 3"))
    assert sorted(known) == ["de", "en"]
    found = {r["doc_id"]: r for r in language.predict(docs, known).collect() if r["doc_id"] is not None}
    assert [found[k]["lang_pred"] for k in (0, 1, 2, 12)] == ["und"] * 4
    assert found[4]["lang_pred"] == "en" and found[7]["lang_pred"] == found[8]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language.predict(docs, known).count() == docs.count() and language.predict_rows(docs, known).columns[:-2] == docs.columns
    assert language.profiles(empty) == {} and language.predict(empty, {}).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, {}).collect()} == {"und"}


def test_long_texts_are_counted_part_by_part():
    text = (ENGLISH + "\n") * 30_000
    keys, counts = np.unique(language.grams(text), return_counts=True)
    got = language.counted(text)
    assert (got[0] == keys).all() and (got[1] == counts).all()


def test_tokens(docs, empty, rows):
    library = token_counts.tokenizer(PATH)
    want = sorted((i is None, i or 0, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in token_counts.count_tokens(docs, PATH).collect())
    assert got == want and token_counts.count_tokens(empty, PATH).count() == 0


def test_bpe(docs, empty, rows):
    library = token_counts.tokenizer(PATH)
    coded = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in rows]
    want = sorted((i is None, i or 0, len(ids), ",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)) for i, ids in coded)
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3]) for r in bpe.encode_decode(docs, PATH).collect())
    assert got == want and bpe.encode_decode(empty, PATH).count() == 0


@pytest.mark.parametrize("group_bytes", [500, 2_000_000])
def test_packing(docs, empty, rows, group_bytes):
    library = token_counts.tokenizer(PATH)
    got = packing.pack(docs, PATH, window=64, group_bytes=group_bytes).collect()
    sequences, texts = {}, {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        texts.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    count = Counter(i for i, _ in rows)
    for i, text in rows:
        if count[i] == 1:
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
            assert b"".join(x for _, x, _ in sorted(texts[i])) == ids and {n for *_, n in texts[i]} == {len(ids) // 4}
    assert packing.pack(empty, PATH).count() == 0
    assert packing.digest(packing.pack(docs, PATH)).filter("ids_crc32 is null").count() == 0


def test_simhash(docs, empty, rows):
    def brute(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(i, brute(t)) for i, t in rows]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hexadecimal("fingerprint").alias("f"), "component_id").collect()
    assert Counter((r["doc_id"], r["f"]) for r in got) == Counter((i, f"{p:016x}") for i, p in prints)
    nodes = sorted({p for _, p in prints})
    label = {p: p for p in nodes}
    for _ in nodes:
        for a in nodes:
            for b in nodes:
                if (a ^ b).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    first = {}
    for i, p in prints:
        if i is not None:
            first[label[p]] = min(i, first.get(label[p], i))
    want = {f"{p:016x}": first.get(label[p]) for p in nodes}
    assert all(r["component_id"] == want[r["f"]] for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def test_counts_of_buckets_are_not_broadcast(spark):
    rows = spark.range(1000).select(F.col("id").alias("item"), F.explode(F.sequence(F.lit(0), F.lit(34))).alias("key"))
    plan = graph.pair_blocks(rows, ["key"], "item", 64)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_hot_buckets_are_cut_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 60)}
    chain = [5]
    for k in range(150):
        chain.append(chain[-1] ^ (0b111 << (k * 7 % 60)))
    frame = spark.createDataFrame([(x,) for x in fps | set(chain)], "fingerprint long")
    edges = {(r["a"], r["b"]) for r in simhash.links(frame).collect()}
    label = {x: x for x in fps | set(chain)}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
        label[max(root(a), root(b))] = min(root(a), root(b))
    assert len({root(x) for x in chain}) == 1 and len({root(x) for x in label}) == 1 + len(fps - set(chain))


def test_lines(docs, empty, rows):
    def brute(least):
        keys = [[line.strip(" \t\n\x0b\x0c\r") for line in t.split("\n")] for _, t in rows]
        keys = [["".join(c.lower() if "A" <= c <= "Z" else c for c in k) for k in ks] for ks in keys]
        met = Counter(k for ks in keys for k in set(ks) if k)
        return sorted((i is None, i or 0, "\n".join(x for x, k in zip(t.split("\n"), ks, strict=True) if met[k] < least), len(ks), sum(met[k] >= least for k in ks)) for (i, t), ks in zip(rows, keys, strict=True))

    for least in (2, 3, 10):
        got = line_dedup.drop_common_lines(docs, least_docs=least, bucket_bytes=2_000, first_batch=1, carry=["kept", "n_tokens"])
        assert got.columns == ["doc_id", "kept", "n_tokens", "kept", "n_lines", "n_dropped"]
        assert sorted((r[0] is None, r[0] or 0, r[3], r[4], r[5]) for r in got.collect()) == brute(least)
    assert line_dedup.drop_common_lines(empty).count() == 0


def test_line_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, least=4, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1), (2, k, 3), (3, 3, 4 * (k == 2))], "k1 long, k2 long, docs long").filter("docs > 0"))
        want = ({(3, 3)} if k >= 2 else set()) | ({(1, 1)} if k >= 3 else set())
        assert sorted((r["k1"], r["k2"]) for r in runs.frequent().collect()) == sorted(want)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [tuple(r) for r in runs.levels[0][0].collect()] == [(2, 4, 3)]  # settled keys are counted no further
    assert sorted(tuple(r) for r in runs.levels[2][0].collect()) == [(2, k, 3) for k in range(4)]
    assert line_dedup.batches_of(70, 8) == [(0, 8), (8, 16), (16, 32), (32, 64), (64, 70)] and line_dedup.batches_of(1, 8) == [(0, 1)]


def plain_model(texts, strength):
    """The log10 probability of a text's tokens, and P(token | context), by plain counting; context None: a text's start."""
    c, pairs = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip([None, *t[:-1]], t, strict=True))
    starts, total, (one, two) = len(texts), sum(c.values()), (sum(n == k for n in c.values()) for k in (1, 2))
    cut = min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5

    def probability(h, w):
        root = (c[w] - cut if c[w] else cut * len(c)) / total
        seen = starts if h is None else c[h]
        return (pairs[h, w] + strength * root) / (seen + strength)

    return lambda t: sum(math.log10(probability(h, w)) for h, w in zip([None, *t[:-1]], t, strict=True)), probability


def test_language_model(docs, empty, rows):
    held = [(i, t, zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False) for i, t in rows]
    tokens = lambda t: [*t.encode().lower().split(), "end"]
    c = Counter(w for _, t, out in held if not out for w in tokens(t))
    total, kinds = sum(c.values()), len(c)
    got = lm_scoring.score(docs, ~language.held_out("doc_id", 7), bucket_bytes=3_000).collect()
    want = sorted((i is None, i or 0, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), total, round(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in tokens(t)), 6)) for i, t, _ in held)
    assert sorted((r[0] is None, r[0] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    model, probability = plain_model([tokens(t) for _, t, out in held if not out], strength=50.0)
    assert sorted((r[0] is None, r[0] or 0, round(r["score"], 6)) for r in got) == sorted((i is None, i or 0, round(model(tokens(t)), 6)) for i, t, _ in held)
    for state in [None, *c.keys() - {"end"}]:  # every state's probabilities sum to 1, the unknown word's included
        assert sum(probability(state, w) for w in [*c, "no such word"]) == pytest.approx(1)
    other = lm_scoring.score(docs, ~language.held_out("doc_id", 7)).collect()  # all in one bucket
    assert sorted((r[0] is None, r[0] or 0, round(r["score"], 6)) for r in other) == sorted((r[0] is None, r[0] or 0, round(r["score"], 6)) for r in got)
    assert lm_scoring.score(empty, F.lit(True)).count() == 0
    assert {(r["train_tokens"], r["score"]) for r in lm_scoring.score(docs, F.lit(False)).collect()} == {(0, 0.0)}


def test_urls(spark, docs):
    rules = queries.URL_RULES
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM", "http://a.com/x", "https://Example.com/en/1", "http://www.example.com/en/?q", "http://sub.example.com/en/1", "http://xexample.com/en/2",
            "https://x.net/es/1#a", "https://net/fr/", "https://x.net/de/1", "ftp://u:p@host.org:80/p?x://y.com/", "https://big-casino-bonus.org/en/1", "https://old-library.org/en/1"]
    frame = spark.createDataFrame([*((k, u, "h") for k, u in enumerate(urls)), (5, urls[5], None), (None, urls[5], None)], "page_id long, url string, host string")
    got = url_filter.judge(frame, rules).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = (urls[5] if r["page_id"] is None else urls[r["page_id"]]) or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = next((rest[:k] for k, c in enumerate(rest) if c in "/?#"), rest)
        path = rest[len(host) :]
        path = next((path[:k] for k, c in enumerate(path) if c in "?#"), path)
        host = host.lower()
        fits = [(len(x), x, v) for v, x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        best = max(fits, default=(0, None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1])
        assert r["verdict"] == (best[2] or ("block" if "casino" in host else r["verdict"]))
    assert {r["verdict"] for r in got if r["page_id"] == 15} == {"allow"}
    assert url_filter.judge(frame.limit(0), rules).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 24))
    near = base[rng.integers(0, 40, 300)] + 0.03 * rng.standard_normal((300, 24))
    x = np.concatenate([base, near, np.repeat(base[:1], 60, axis=0)])
    rows = [(int(k), v.tolist(), int(k) % 3 if k % 11 else None, "c") for k, v in enumerate(x)]
    rows += [(2000, None, 1, ""), (2020, [0.0] * 24, 1, ""), (2040, [float("nan")] * 24, 1, ""), (2060, [None] * 24, 1, ""), (2080, [1.0] * 5, 1, ""), (2100, [float("inf")] * 24, 1, ""), (None, x[3].tolist(), 1, ""), (2120, (x[4] * 3e200).tolist(), 1, "")]
    rows.append(rows[40])
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string").repartition(3).cache()


def test_nearest(spark, vectors):
    rows = vectors.filter("vec_id < 2120 or vec_id is null")
    got = nearest.search(rows, rows.filter("vec_id % 20 = 0"), k=20, lists=8, subspaces=8, shard_rows=200, query_rows=16).collect()
    known = [(r["vec_id"], np.array(r["embedding"])) for r in rows.collect() if r["vec_id"] is not None and r["vec_id"] < 2000]
    ids, x = np.array([i for i, _ in known]), np.stack([v for _, v in known])
    recall = []
    for q in {r["query_id"] for r in got}:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        score = x @ x[np.flatnonzero(ids == q)[0]]
        order = np.lexsort((ids, -score))
        best = [ids[k] for k in order if ids[k] != q][:20]
        assert [r["rank"] for r in mine] == list(range(1, 1 + 20 * (1 + int(q == 40)))) [: len(mine)]
        assert all(r["score"] == pytest.approx(score[np.flatnonzero(ids == r["vec_id"])[0]], rel=1e-12) for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        recall.append(len({r["vec_id"] for r in mine} & set(best)) / len(set(best)))
    assert {r["query_id"] for r in got} == {i for i in ids.tolist() if i % 20 == 0} and np.mean(recall) >= 0.9
    assert nearest.search(rows.limit(0), rows.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 10, 21, 27])
def test_nearest_finds_all_candidates_where_they_are_few(spark, n):
    rng = np.random.default_rng(n)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((n, 16)))], "vec_id long, embedding array<double>")
    got = nearest.search(rows, rows, k=20).collect()
    assert Counter(r["query_id"] for r in got) == Counter({k: min(20, n - 1) for k in range(n) if n > 1})


def test_nearest_at_production_parameters_with_a_crowd_of_equal_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x[::3] = x[0]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = nearest.search(rows, rows.filter("vec_id % 20 = 0"), k=20, shard_rows=500).collect()
    found: dict[int, set[int]] = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    y, recall = x.astype(np.float64), []
    for q in range(0, 3000, 20):
        order = np.lexsort((np.arange(3000), -(y @ y[q])))
        best = [k for k in order.tolist() if k != q][:20]
        assert len(found[q]) == 20
        recall.append(len(found[q] & set(best)) / 20)
    assert np.mean(recall) >= 0.9


def test_shards_hold_lists_up_to_their_size():
    first, many = nearest.shards_of(np.array([3, 0, 4, 25, 9, 2, 10]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 5, 6] and many.tolist() == [1, 1, 1, 3, 1, 1, 1]


@pytest.mark.parametrize("block", [16, 1024])
def test_vector_dedup(vectors, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(vectors).collect()}
    known = [(r["vec_id"], r["label"], np.array(r["embedding"])) for r in vectors.collect() if r["vec_id"] is not None and (r["vec_id"] < 2000 or r["vec_id"] == 2120) and r["label"] is not None]
    ids, labels = np.array([k[0] for k in known]), np.array([k[1] for k in known])
    u = np.stack([k[2] / np.abs(k[2]).max() for k in known])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    label = ids.copy()
    while True:
        new = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            break
        label = new
    for k, i in enumerate(ids.tolist()):
        assert got[i]["n_links"] == linked[k].sum() - 1 and got[i]["component_id"] == label[k], i
    for i in (2000, 2020, 2040, 2060, 2080, 2100, 11, None):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i
    assert vector_dedup.near_vectors(vectors.limit(0)).count() == 0


def test_an_id_of_several_vectors_has_a_node_for_each(spark):
    rows = [(1, [1.0, 0.0, 0.0], "a"), (1, [0.0, 1.0, 0.0], "a"), (2, [1.0, 0.001, 0.0], "a"), (3, [0.0, 1.0, 0.001], "a"), (3, [1.0, 0.0, 0.0], "b")]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 1, 1)]


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    codes = vector_dedup.Codes(64, 32, 16, 0.98, 6.0, 1e-6)
    x, y = codes.unit(rng.standard_normal((300, 64))), codes.unit(rng.standard_normal((300, 64)))
    code, factor = codes.encode(x)
    i, j = (k.ravel() for k in np.indices((300, 300)))
    true, (estimate, above) = (x @ y.T).ravel(), codes.estimate(code[i], factor[i], y[j])
    assert (estimate + above >= true).all() and abs((estimate - true).mean()) < 0.003


def test_codes_of_linked_vectors_are_not_too_far_apart():
    rng = np.random.default_rng(4)
    codes = vector_dedup.Codes(64, 32, 16, 0.98, 6.0, 1e-6)
    x = codes.unit(rng.standard_normal((4000, 64)))
    off = rng.standard_normal((4000, 64))
    off = codes.unit(off - (off * x).sum(axis=1, keepdims=True) * x)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * off  # just at the threshold
    apart = np.bitwise_count(codes.encode(x)[0] ^ codes.encode(y)[0]).sum(axis=1)
    assert 3.5 < apart.mean() < 4.7 and (apart <= codes.apart).all() and codes.apart < 25


def test_queries_carry_the_asked_columns(spark):
    found = queries.op6_line_dedup(spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(found) == len(text)
    assert all(r["kept_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in found if not r["n_dropped"])
