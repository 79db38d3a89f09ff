"""Queries ``opN_<name>`` over the whole tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, centroids, exact_dedup, langid, lm_score, ngram_join, ogg, packing, quality, secret_scan, sharding, spelling, substring_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), ranks_path())


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ranks_path())


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_media(ogg.write_media(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score_corpus(docs, table(spark, sf_dir, "benchmark"), docs, ranks_path())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_packing": op2_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_ngram_join": op6_ngram_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ogg": op8_ogg,
    "op9_quality": op9_quality,
    "op10_lm_score": op10_lm_score,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
}


def _secret_sql() -> str:
    """Spans of every rule by splitting at its matches."""
    parts = []
    for order, rule in enumerate(secret_scan.RULES):
        pattern = secret_scan.either_case(secret_scan.java_pattern(rule)).replace("'", "''")
        parts.append(
            f"""SELECT rowid, {order} AS kind, '{rule.kind}' AS name, gap_chars + match_chars AS start, gap_chars + match_chars + length(m[i]) AS stop FROM (
 SELECT rowid, m, g, i, list_sum(list_transform(gap[1:i], lambda x: length(x))) AS gap_chars, coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS match_chars
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rowid, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS gap FROM docs)))
 WHERE length(g[i]) >= {rule.least}"""
        )
    base = len(secret_scan.BASE_KINDS)
    joined = "string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{kind}" for k, kind in enumerate(secret_scan.BASE_KINDS))
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rowid, doc_id, coalesce(text, '') AS t FROM documents), spans AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {counts}, sha256(coalesce({joined} FILTER (WHERE kind < {base}), '')) AS base_sha256, coalesce({joined}, '') AS spans FROM docs LEFT JOIN spans USING (rowid) GROUP BY rowid, doc_id"""


_NEAR_SQL = r"""WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+') AS w FROM documents),
 grams AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM docs WHERE len(w) > 0)),
 sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
 pairs AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE c * 10 >= 8 * (p.n + q.n - c)),
 tree(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.a, p.b FROM tree t JOIN pairs p ON p.a = t.b),
 named AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM tree GROUP BY a)
SELECT doc_id, class_id, (SELECT count(*) FROM pairs WHERE a = doc_id) AS n_links, class_size FROM named"""

_EXACT_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) WINDOW w AS (PARTITION BY t)"""

# crc32 byte by byte over a table made from its polynomial; near words share what is left of them without one letter
_SPELLING_SQL = r"""WITH RECURSIVE crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS x(i))),
 runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
 counted AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS keyed, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
 drawn AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(keyed)), lambda k: CAST('0x' || substr(hex(encode(keyed)), 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM counted, crc),
 kept AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM drawn),
 words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
 cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
 once AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word < b.word UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word),
 near AS MATERIALIZED (SELECT a AS word, b AS other FROM once UNION SELECT b, a FROM once),
 best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY w.n DESC, other) AS other, max(w.n) AS other_n FROM near JOIN words w ON w.word = other GROUP BY near.word),
 formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
 steps(word, reached) AS (SELECT word, word FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.reached WHERE f.form IS NOT NULL)
SELECT word, form, reached AS root, n, n_near, form_n FROM formed JOIN steps USING (word) WHERE reached IN (SELECT word FROM formed WHERE form IS NULL)"""

_SUBSTRING_SQL = r"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 windows AS MATERIALIZED (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM docs)),
 least AS (SELECT t, min(doc_id) AS least FROM windows GROUP BY t),
 gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS i FROM windows JOIN least USING (t) WHERE least < doc_id),
 lost AS (SELECT rid, list(i) AS gone FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM docs LEFT JOIN lost USING (rid)"""


def _clustering_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Every round in full: all distances, all means."""
    text = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v AS m FROM v QUALIFY c < {clusters})"""
    for k in range(rounds + 1):
        text += f""",
 a{k} AS MATERIALIZED (SELECT rid, arg_min(c, d * {clusters} + c) AS c, min(d) AS d FROM (SELECT rid, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS d FROM v, c{k}) GROUP BY rid)"""
        if k < rounds:
            text += f""",
 c{k + 1} AS MATERIALIZED (SELECT c, coalesce(n, m) AS m FROM c{k} LEFT JOIN (SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS n FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM v JOIN a{k} USING (rid)) GROUP BY c, i) GROUP BY c) USING (c))"""
    return f"""{text}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} USING (c)"""


ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": _secret_sql(),
    "op6_ngram_join": _NEAR_SQL,
    "op7_exact_dedup": _EXACT_SQL,
    "op11_spelling_variants": _SPELLING_SQL,
    "op12_substring_dedup": _SUBSTRING_SQL,
    "op13_centroid_clustering": _clustering_sql(),
}
