"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import byte_bpe, exact_dedup, infill, mixing, ngram_join, pii, prefix_trie, quality, secret_scan, simhash, token_counts, token_files, vector_search
from marginalia.llm import spans as span_columns
from marginalia.llm.common import table

SOURCE_WEIGHTS = [3, 1, 2]
END_ID = 2
TOKEN_LIMIT = 1024
QUERY_EVERY = 100


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_files.tokenise_to_files(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", "file")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts.prefix_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", token_counts.over_limit(TOKEN_LIMIT).alias("over_limit"))


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, k=10, scale=1024)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, SOURCE_WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets_in(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [span_columns.count_of(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    return found.select("doc_id", *counts, *span_columns.digest_columns(secret_scan.BASE_KINDS))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.decode(byte_bpe.encode(docs, path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data_in(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [span_columns.count_of(k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, *span_columns.digest_columns(pii.BASE_KINDS))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hashes = [F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_token_files, op2_simhash, op3_quality, op4_token_counts, op5_vector_search, op6_mixing, op7_secrets, op8_byte_bpe, op9_personal_data, op10_exact_dedup,
    op11_fill_in_middle, op12_prefix_trie, op13_ngram_join,
)}

ORACLE_SQL: dict[str, str] = {
    "op5_vector_search": """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS mark,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank_no FROM sources),
weighed AS (SELECT *, CAST([3, 1, 2][CAST((rank_no - 1) % 3 + 1 AS INT)] AS BIGINT) AS w, 2 * source_size AS cap FROM ranked WHERE source_size > 0),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, rank_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_caps,
    CAST(sum(w) OVER (ORDER BY cap / w, rank_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left FROM weighed),
marked AS (SELECT *, w * (total * 3 - before_caps * 2) > cap * w_left * 2 AS capped FROM filled),
freed AS (SELECT *, CAST(coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS BIGINT) AS cap_sum, CAST(sum(CASE WHEN NOT capped THEN w END) OVER () AS BIGINT) AS w_free FROM marked),
shares AS (
  SELECT r.source, r.source_size, r.rank_no,
    coalesce(CASE WHEN f.capped THEN CAST(f.cap AS DOUBLE) ELSE CAST(f.w * (f.total * 3 - f.cap_sum * 2) AS DOUBLE) / CAST(f.w_free * 2 AS DOUBLE) END, 0.0) AS target
  FROM ranked r LEFT JOIN freed f ON r.rank_no = f.rank_no),
queued AS (
  SELECT d.doc_id, d.size, d.mark, s.source_size, s.rank_no, s.target,
    CAST(sum(d.size) OVER (PARTITION BY s.rank_no ORDER BY d.mark, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source),
timed AS (
  SELECT q.*, p.pass_no, CAST(source_size * p.pass_no + cum AS DOUBLE) / target AS finish
  FROM queued q CROSS JOIN (VALUES (0), (1)) p(pass_no) WHERE target > 0),
merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank_no, mark, doc_id, size, pass_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM timed),
taken AS (
  SELECT doc_id, rank_no, size, cum, count(*) AS copies FROM merged
  WHERE run <= (SELECT (CAST(sum(size) AS BIGINT) * 3) // 2 FROM sized) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(t.copies, 0) * q.size AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.rank_no = t.rank_no AND q.size = t.size AND q.cum = t.cum
""",
    "op10_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
best AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n_points, doc_id)) AS keep_id FROM n GROUP BY text_sha256)
SELECT n.doc_id, best.keep_id, best.group_size, n.doc_id = best.keep_id AS kept, n.text_sha256 FROM n JOIN best USING (text_sha256)
""",
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
drawn AS (
  SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || mark[1:8] AS BIGINT) AS h1, CAST('0x' || mark[9:16] AS BIGINT) AS h2,
    CAST('0x' || mark[17:24] AS BIGINT) AS h3, CAST('0x' || mark[25:32] AS BIGINT) AS h4 FROM d),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts
""",
    "op12_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
crc_steps AS (
  WITH RECURSIVE bits(i, v, k) AS (
    SELECT i, CAST(i AS UBIGINT), 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8)
  SELECT list(v ORDER BY i) AS step FROM bits WHERE k = 8),
convs AS (
  SELECT conv_id, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST(ord(x) AS UBIGINT) for x in string_split(CAST(conv_id AS VARCHAR), '')]),
      lambda c, x: xor(c >> 8, step[CAST(xor(c & 255, x) AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 4 AS BIGINT) AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc_steps),
built AS (
  SELECT c.conv_id, 0 AS part, t.place, {'r': t.role, 't': t.text} AS turn FROM convs c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.place < c.h
  UNION ALL SELECT c.conv_id, 1, t.place, {'r': t.role, 't': t.text} FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.place >= c.h),
seqs AS (SELECT c.conv_id, coalesce(s.turns, []) AS turns FROM convs c LEFT JOIN (SELECT conv_id, list(turn ORDER BY part, place) AS turns FROM built GROUP BY conv_id) s ON c.conv_id = s.conv_id),
members AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM seqs),
keyed AS (SELECT conv_id, depth, len(turns) AS size, turns[1:depth] AS prefix FROM members),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '') AS ends FROM keyed GROUP BY prefix, depth),
weighed AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[depth]['t'], '[^\x20\x09-\x0D]+')) END AS own FROM nodes),
children AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT w.prefix[1:u.k] AS prefix, w.own, c.prefix IS NULL AS leaf FROM weighed w LEFT JOIN children c ON w.prefix = c.prefix, LATERAL (SELECT unnest(range(0, w.depth + 1)) AS k) u),
sums AS (SELECT prefix, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM below GROUP BY prefix)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(c.n_children, 0) AS BIGINT) AS n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON n.prefix = s.prefix LEFT JOIN children c ON n.prefix = c.prefix LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
""",
}
