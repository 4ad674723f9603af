"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, line_dedup, lm_scoring, nearest, packing, prefix_trie, simhash, substrings, token_counts, url_filter, vector_codes, vector_dedup
from .common import read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: The verdicts given for hosts and paths.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = language.held_out("doc_id", 4)
    known = language.profiles(docs.filter(~held_out))
    return language.predict(docs, known).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"), BYTE_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest.search(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language.held_out("doc_id", 7)
    scores = lm_scoring.score(read(spark, sf_dir, "documents"), training=~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(read(spark, sf_dir, "documents"), least_docs=10, least_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir, "documents"), BYTE_BPE, window=1024, end_id=0))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(read(spark, sf_dir, "documents"), BYTE_BPE)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_dedup.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.98)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(read(spark, sf_dir, "documents"), size=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256.0)
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"), heads, least=8, every=5)


QUERIES = {f.__name__: f for f in (op1_language, op2_token_counts, op3_nearest, op4_simhash, op5_lm_scoring, op6_line_dedup, op7_url_filter, op8_packing, op9_bpe, op10_vector_dedup, op11_substrings, op12_vector_codes, op13_prefix_trie)}

ORACLE_SQL = {
    "op6_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, unnest(list_zip(parts, range(1, len(parts) + 1))) AS x
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT doc_id, x[1] AS line, x[2] AS pos,
        translate(trim(x[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), common AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
    SELECT keyed.*, k IN (SELECT k FROM common) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op10_vector_dedup": r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), classes AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM classes LEFT JOIN counts USING (vec_id)
""",
    "op11_substrings": r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM texts WHERE len(words) >= 13
), keyed AS (
    SELECT doc_id, pos, sha256(array_to_string(words[pos:pos + 12], ' ')) AS k FROM windows
), repeated AS (
    SELECT doc_id, pos FROM keyed JOIN (SELECT k, min(doc_id) AS least FROM keyed GROUP BY k) USING (k) WHERE least < doc_id
), placed AS (
    SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM texts
), judged AS (
    SELECT placed.doc_id, placed.pos, word, max(CASE WHEN repeated.pos IS NULL THEN 0 ELSE 1 END)
        OVER (PARTITION BY placed.doc_id ORDER BY placed.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone
    FROM placed LEFT JOIN repeated ON repeated.doc_id = placed.doc_id AND repeated.pos = placed.pos
), kept AS (
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
    FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
""",
    "op12_vector_codes": r"""
WITH live AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT vec_id, p, e[p * len(e) // 16 + 1:(p + 1) * len(e) // 16] AS x FROM live, (SELECT unnest(range(16)) AS p)
), book0 AS (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c
    FROM parts WHERE vec_id IN (SELECT vec_id FROM live ORDER BY vec_id LIMIT 64)
), near0 AS (
    SELECT vec_id, p, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + k) AS m
    FROM parts JOIN book0 USING (p) GROUP BY vec_id, p
), mean0 AS (
    SELECT p, k, list(v ORDER BY i) AS c FROM (
        SELECT p, m % 64 AS k, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v
        FROM (SELECT p, m, unnest(x) AS v, unnest(range(len(x))) AS i FROM near0) GROUP BY ALL
    ) GROUP BY p, k
), book1 AS (
    SELECT book0.p, book0.k, coalesce(mean0.c, book0.c) AS c FROM book0 LEFT JOIN mean0 ON book0.p = mean0.p AND book0.k = mean0.k
), near1 AS (
    SELECT vec_id, p, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + k) AS m
    FROM parts JOIN book1 USING (p) GROUP BY vec_id, p
), mean1 AS (
    SELECT p, k, list(v ORDER BY i) AS c FROM (
        SELECT p, m % 64 AS k, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v
        FROM (SELECT p, m, unnest(x) AS v, unnest(range(len(x))) AS i FROM near1) GROUP BY ALL
    ) GROUP BY p, k
), book2 AS (
    SELECT book1.p, book1.k, coalesce(mean1.c, book1.c) AS c FROM book1 LEFT JOIN mean1 ON book1.p = mean1.p AND book1.k = mean1.k
), near2 AS (
    SELECT vec_id, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + k) AS m
    FROM parts JOIN book2 USING (p) GROUP BY vec_id, p
), coded AS (
    SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM near2 GROUP BY vec_id
), digest AS (
    SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN live USING (vec_id), digest
""",
    "op13_prefix_trie": r"""
WITH t AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), lengths AS (
    SELECT c, count(*) AS n FROM t GROUP BY c
), hashed AS (
    SELECT c, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ord((c::VARCHAR)[i])::UBIGINT)),
        lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 9)::BIGINT AS h
    FROM lengths
), convs AS (
    SELECT hashed.c, h, least(h, coalesce(b.n, 0)) AS m FROM hashed LEFT JOIN lengths b ON b.c = hashed.c - hashed.c % 5
), r AS (
    SELECT convs.c, t.pos AS d, role, text FROM convs JOIN t ON t.c = convs.c - convs.c % 5 WHERE t.pos <= h
    UNION ALL
    SELECT convs.c, m + t.pos - h, role, text FROM convs JOIN t ON t.c = convs.c WHERE t.pos > h
), p AS (
    SELECT c, d, strlen(text) AS bytes, md5(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM r
    UNION ALL
    SELECT c, 0, 0, '' FROM convs
), n AS (
    SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved FROM p GROUP BY d, k
), up AS (
    SELECT n.d, n.k, n.saved, p.d AS above_d, p.k AS above_k FROM n JOIN p ON p.c = n.conv_id AND p.d <= n.d
), kids AS (
    SELECT above_d AS d, above_k AS k, count(*) AS n_children FROM up WHERE above_d = d - 1 GROUP BY ALL
), sums AS (
    SELECT above_d AS d, above_k AS k, count(*) FILTER (kids.n_children IS NULL) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
    FROM up LEFT JOIN kids ON kids.d = up.d AND kids.k = up.k GROUP BY above_d, above_k
), ends AS (
    SELECT d, k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS x FROM p WHERE (c, d) IN (SELECT c, max(d) FROM p GROUP BY c) GROUP BY d, k
), parents AS (
    SELECT up.d, up.k, n.conv_id AS parent_conv_id FROM up JOIN n ON n.d = up.above_d AND n.k = up.above_k WHERE up.above_d = up.d - 1
)
SELECT n.conv_id, n.d AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(x, sha256('')) AS ends_sha256
FROM n JOIN sums USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN ends USING (d, k) LEFT JOIN parents USING (d, k)
""",
}
