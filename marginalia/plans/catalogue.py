"""The library's registered queries over the driver's tables, each with the SQL that must agree with it.

Tables stand in for the data model: documents for sections (paper = source), embeddings for their vectors, part for symbols and
canonical works, lineitem for references (paper = l_orderkey), orders for papers, events for stage runs,
conversations for memory, benchmark for evaluation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import embedding
from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.operators import audit, chunking, evaluate, evidence, extract, ingest, knn, lexical as fulltext, library, outline, references, retrieval, stages, structure

FLAGSHIP = "fusion_search"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# vectors --------------------------------------------------------------------------------------------------------

COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def scored(spark, sf_dir, *carried: str) -> DataFrame:
    """Every vector against that of vec_id 0: one row is sent to all tasks."""
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    q = e.filter("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", *carried, V.cosine(F.col("embedding"), F.col("q")).alias("s"))


@query(f"SELECT e.vec_id, round({COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COS} DESC, e.vec_id LIMIT 30")
def vec_topk(spark, sf_dir):
    return scored(spark, sf_dir).orderBy(F.col("s").desc(), "vec_id").limit(30).select("vec_id", F.round("s", 6).alias("score"))


@query(f"SELECT e.vec_id, e.label, round({COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 1 ORDER BY {COS} DESC, e.vec_id LIMIT 30")
def vec_topk_scoped(spark, sf_dir):
    return scored(spark, sf_dir, "label").filter("label = 1").orderBy(F.col("s").desc(), "vec_id").limit(30).select("vec_id", "label", F.round("s", 6).alias("score"))


@query(f"SELECT e.vec_id, round({COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {COS} >= 0.2")
def vec_threshold(spark, sf_dir):
    return scored(spark, sf_dir).filter("s >= 0.2").select("vec_id", F.round("s", 6).alias("score"))


@query(
    """WITH p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  r AS (SELECT id, neighbour, s, CAST(row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, neighbour) AS INTEGER) AS rank FROM p WHERE s > 0.2)
  SELECT id, neighbour, rank, round(s, 6) AS similarity FROM r WHERE rank <= 3"""
)
def neighbours_excl_self(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return knn.nearest(e, e, k=3, above=0.2).select("id", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


@query()
def neighbours_listed(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return knn.nearest_listed(e, e, k=3, above=0.2).select("id", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


@query(
    """SELECT e.vec_id, e.v = e.embedding AS same FROM (SELECT vec_id, embedding, CAST(CAST(to_json(embedding) AS JSON) AS FLOAT[]) AS v FROM embeddings) e"""
)
def vector_text(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (V.parse(V.render(F.col("embedding"))) == F.col("embedding")).alias("same"))


# joins ----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_brand, 1.0::DOUBLE AS lexical_score FROM part WHERE lower(p_brand) = lower('brand#12') OR lower(p_type) = lower('brand#12') ORDER BY p_partkey LIMIT 30")
def exact_match(spark, sf_dir):
    hit = (F.lower("p_brand") == "brand#12") | (F.lower("p_type") == "brand#12")
    return table(spark, sf_dir, "part").filter(hit).orderBy("p_partkey").limit(30).select("p_partkey", "p_brand", F.lit(1.0).alias("lexical_score"))


@query(
    f"""SELECT d.doc_id, round({COS}, 6) AS score FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
  WHERE {COS} > 0.3 OR d.text ILIKE '%tion %' ORDER BY score DESC NULLS FIRST, d.doc_id LIMIT 50"""
)
def title_or_vector(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = d.join(scored(spark, sf_dir), F.col("doc_id") == F.col("vec_id"), "left")
    return joined.filter((F.col("s") > 0.3) | F.col("text").ilike("%tion %")).select("doc_id", F.round("s", 6).alias("score")).orderBy(F.col("score").desc_nulls_first(), "doc_id").limit(50)


@query("SELECT d.doc_id, d.source, e.label, 'SECTION:' || d.doc_id AS evidence_key, 'SECTION' AS evidence_type, concat_ws(' ', d.source, d.lang) AS content FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def join_chunk_paper(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id", "label")
    joined = d.select("doc_id", "source", "lang").join(e, F.col("doc_id") == F.col("vec_id"))
    return joined.select("doc_id", "source", "label", F.concat(F.lit("SECTION:"), "doc_id").alias("evidence_key"), F.lit("SECTION").alias("evidence_type"), F.concat_ws(" ", "source", "lang").alias("content"))


@query("SELECT l.l_orderkey, l.l_linenumber, p.p_name, o.o_orderstatus FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey")
def join_ref_canonical_paper(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    c, p = table(spark, sf_dir, "part").select("p_partkey", "p_name"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return r.join(c, F.col("l_partkey") == F.col("p_partkey")).join(p, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "p_name", "o_orderstatus")


@query("SELECT p.p_partkey, p.p_brand, l.l_orderkey, o.o_totalprice FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_orderstatus = 'F'")
def left_reference_paper(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return r.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("p_partkey", "p_brand", "l_orderkey", "o_totalprice")


@query("SELECT d.doc_id, e.label FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def left_section_paper(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return table(spark, sf_dir, "documents").select("doc_id").join(e, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "label")


REF_SQL = "SELECT l_orderkey AS paper_id, CASE WHEN l_linenumber % 2 = 0 THEN '[' || l_linenumber || ']' ELSE CAST(l_linenumber AS VARCHAR) END AS ref_index, l_partkey AS global_ref_id FROM lineitem"


def refs(spark, sf_dir) -> DataFrame:
    n = F.col("l_linenumber").cast("string")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("["), n, F.lit("]"))).otherwise(n).alias("ref_index"), F.col("l_partkey").alias("global_ref_id"))


@query(f"SELECT r.paper_id, r.ref_index, p.p_name AS title FROM ({REF_SQL}) r JOIN part p ON r.global_ref_id = p.p_partkey WHERE r.ref_index IN ('2', '[2]')")
def ref_lookup_bracketed(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("global_ref_id"), F.col("p_name").alias("title"))
    return references.by_index(refs(spark, sf_dir), "2").join(p, "global_ref_id").select("paper_id", "ref_index", "title")


@query(f"SELECT r.paper_id, r.ref_index, p.p_name AS title FROM ({REF_SQL}) r JOIN part p ON r.global_ref_id = p.p_partkey WHERE r.paper_id = 7 AND r.ref_index IN ('1', '[1]')")
def ref_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("global_ref_id"), F.col("p_name").alias("title"))
    return references.by_index(refs(spark, sf_dir).filter("paper_id = 7"), "1").join(p, "global_ref_id").select("paper_id", "ref_index", "title")


@query("SELECT p.p_partkey, p.p_name AS title, c.n AS citation_count FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) c ON p.p_partkey = c.l_partkey ORDER BY c.n DESC NULLS FIRST, p.p_partkey LIMIT 5")
def top_cited(spark, sf_dir):
    counts = references.popularity(table(spark, sf_dir, "lineitem"), "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    return p.join(counts, F.col("p_partkey") == F.col("l_partkey"), "left").orderBy(F.col("citation_count").desc_nulls_first(), "p_partkey").limit(5).select("p_partkey", "title", "citation_count")


@query("SELECT l_orderkey AS paper_id, count(*) AS n_references, count(DISTINCT l_partkey) AS n_works FROM lineitem GROUP BY 1")
def counts_per_paper(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("l_partkey").alias("n_works"))


@query("SELECT p_brand, p_partkey, n FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS n FROM part) WHERE n <= 5")
def first5_symbols(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", n.alias("n")).filter("n <= 5")


@query(f"WITH r AS ({REF_SQL}), links AS (SELECT paper_id, ref_index, global_ref_id % 3 AS section_id FROM r) SELECT DISTINCT r.paper_id, links.section_id, r.ref_index, coalesce(known.p_name, 'work ' || r.global_ref_id) AS title FROM links JOIN r USING (paper_id, ref_index) LEFT JOIN part known ON r.global_ref_id = known.p_partkey AND known.p_size > 20")
def cited_works_fallback(spark, sf_dir):
    r = refs(spark, sf_dir).withColumnRenamed("paper_id", "doc").withColumn("title", F.concat(F.lit("work "), F.col("global_ref_id").cast("string")))
    links = r.select("doc", (F.col("global_ref_id") % 3).alias("section_id"), "ref_index")
    known = table(spark, sf_dir, "part").filter("p_size > 20").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return references.cited_works(links, r, known).withColumnRenamed("doc", "paper_id")


@query("SELECT doc_id, 'Heading path: ' || coalesce(source, '') || chr(10) || 'Content: ' || coalesce(text, '') AS chunk_text, 'Section: ' || coalesce(lang, '') || chr(10) || 'Content: ' || substr(coalesce(text, ''), 1, 500) AS section_text FROM documents")
def embedding_inputs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", evidence.chunk_embedding_text("source", "text").alias("chunk_text"), evidence.section_embedding_text("lang", "text").alias("section_text"))


@query("SELECT p_partkey, 'Symbol: ' || p_name || '; Meaning: ' || p_type || '; LaTeX Representation: ' || p_brand || CASE WHEN p_size > 25 THEN '; Definition Formula: ' || p_size ELSE '' END AS symbol_text FROM part")
def symbol_embedding_inputs(spark, sf_dir):
    formula = F.when(F.col("p_size") > 25, F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", evidence.symbol_embedding_text("p_name", "p_type", "p_brand", formula).alias("symbol_text"))


@query("SELECT p.p_partkey AS id, p.p_size % 10 AS fingerprint, (SELECT min(s_suppkey) FROM supplier s WHERE s.s_nationkey = p.p_size % 10) AS linked_paper_id FROM part p")
def linked_papers(spark, sf_dir):
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("fingerprint"))
    papers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("paper_id"), F.col("s_nationkey").alias("fingerprint"))
    return evidence.link_papers(works, papers).select("id", "fingerprint", "linked_paper_id")


@query("SELECT o_orderkey, 'source=' || o_orderstatus || ';target=' || coalesce(o_orderpriority, '') AS versions FROM orders")
def joined_versions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", evidence.joined_versions("o_orderstatus", "o_orderpriority").alias("versions"))


@query(r"SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(text, '^[\x00-\x20]+', ''), '[\x00-\x20]+$', ''), 1, 300), '[\r\n]+', ' ', 'g') AS context FROM documents")
def context_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evidence.one_line("text", 300).alias("context"))


LOST_SQL = """
WITH d AS (SELECT doc_id AS doc, doc_id % 20 + 1 AS n, doc_id % 3 = 0 AS deep, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source FROM documents),
l AS (
  SELECT doc, 0 AS ln, 0 AS part, 'A study in ' || lang AS line FROM d UNION ALL SELECT doc, 1, 0, '## ' || n || '. Methods of ' || source || '.' FROM d UNION ALL SELECT doc, 1, 1, 'They are told here' FROM d
  UNION ALL SELECT doc, 2, 0, 'of document ' || doc FROM d UNION ALL SELECT doc, 3, 0, n || '.1 Data' FROM d
  UNION ALL SELECT doc, 4, 0, CASE WHEN deep THEN '## ' || (n + 1) || '. Results' ELSE (n + 1) || ' Results' END FROM d
  UNION ALL SELECT doc, 5, 0, CASE WHEN deep THEN (n + 1) || '.1 Detail' ELSE (n + 2) || ' Discussion' END FROM d
  UNION ALL SELECT doc, 6, 0, '## References' FROM d UNION ALL SELECT doc, 6, 1, '[1] A. Author, 2001' FROM d UNION ALL SELECT doc, 7, 0, '[2] B. Author' FROM d
  UNION ALL SELECT doc, 8, 0, (n + 3) || ' Late' FROM d UNION ALL SELECT doc, 9, 0, (n + 3) || '.1 After' FROM d)
SELECT * FROM l
"""


@query(LOST_SQL)
def recovered_headings(spark, sf_dir):
    """Every document's outline with headings lost; the SQL writes out what must come back."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 20 + 1).alias("n"), (F.col("doc_id") % 3 == 0).alias("deep"), *[F.coalesce(c, F.lit("none")).alias(c) for c in ("lang", "source")])
    at = lambda k, title: F.concat((F.col("n") + k).cast("string"), F.lit(title))
    lines = F.array(
        F.concat(F.lit("A study in "), "lang"), F.concat(at(0, " Methods of "), "source", F.lit(". They are told here")), F.concat(F.lit("of document "), F.col("doc_id").cast("string")), at(0, ".1 Data"),
        at(1, " Results"), F.when(F.col("deep"), at(1, ".1 Detail")).otherwise(at(2, " Discussion")), F.lit("[1] A. Author, 2001"), F.lit("[2] B. Author"), at(3, " Late"), at(3, ".1 After"),
    )
    return outline.recover_headings(d.select(F.col("doc_id").alias("doc"), F.posexplode(lines).alias("ln", "line")))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def canonical_to_insert(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("fingerprint")).distinct().withColumn("id", F.col("fingerprint"))
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fingerprint"))
    _, new = references.canonicalise(found, known)
    return new.select(F.col("fingerprint").alias("id"))


# lexical and fused search ---------------------------------------------------------------------------------------

def query_text(spark, sf_dir) -> str:
    return table(spark, sf_dir, "benchmark").filter("item_id = 0").select("text").first()[0]


def lexical(spark, sf_dir) -> DataFrame:
    """doc_id, n: how many distinct words of the query the text has. The query is one row, so its terms are literals."""
    d = table(spark, sf_dir, "documents")
    terms = spark.range(1).select(T.query_terms(F.lit(query_text(spark, sf_dir))).alias("t")).first()[0]
    n = F.size(F.array_intersect(T.query_terms("text"), F.array(*[F.lit(t) for t in terms]))) if terms else F.lit(0)
    return d.select("doc_id", n.cast("long").alias("n"))


LEX_SQL = """SELECT d.doc_id, CAST(len(list_intersect([t for t in list_distinct(regexp_split_to_array(lower(d.text), '[^\\p{L}\\p{N}]+')) if len(t) > 0], q.terms)) AS BIGINT) AS n
  FROM documents d, (SELECT [t for t in list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) if len(t) > 0] AS terms FROM benchmark WHERE item_id = 0) q"""


@query(f"SELECT doc_id, n FROM ({LEX_SQL}) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 30")
def lex_topk(spark, sf_dir):
    return lexical(spark, sf_dir).filter("n > 0").orderBy(F.col("n").desc(), "doc_id").limit(30)


def channels(spark, sf_dir) -> DataFrame:
    none = F.lit(None).cast("double")
    exact = table(spark, sf_dir, "documents").filter("source = 'src3'").select(F.lit(0).alias("qid"), F.col("doc_id").alias("id"), none.alias("semantic_score"), F.lit(1.0).alias("lexical_score"))
    lex = lexical(spark, sf_dir).filter("n > 0").select(F.lit(0).alias("qid"), F.col("doc_id").alias("id"), none.alias("semantic_score"), F.col("n").cast("double").alias("lexical_score"))
    vec = scored(spark, sf_dir).filter("s >= 0.2").select(F.lit(0).alias("qid"), F.col("vec_id").alias("id"), F.col("s").alias("semantic_score"), none.alias("lexical_score"))
    return retrieval.channel(exact, "EXACT_SYMBOL").unionByName(retrieval.channel(lex, "TEXT_SECTION")).unionByName(retrieval.channel(vec, "VECTOR_SECTION"))


CHANNELS_SQL = f"""WITH lex AS ({LEX_SQL}),
 c1 AS (SELECT 1 AS seq, 1.25 AS weight, 'SYMBOL:' || doc_id AS k, 'SYMBOL' AS evidence_type, 'EXACT_SYMBOL' AS channel, row_number() OVER (ORDER BY doc_id) AS rank, 0.0 AS sem, 1.0 AS lexs FROM documents WHERE source = 'src3'),
 c2 AS (SELECT 2 AS seq, 1.0 AS weight, 'SECTION:' || doc_id AS k, 'SECTION' AS evidence_type, 'TEXT_SECTION' AS channel, row_number() OVER (ORDER BY n DESC, doc_id) AS rank, 0.0 AS sem, CAST(n AS DOUBLE) AS lexs FROM lex WHERE n > 0),
 v AS (SELECT e.vec_id, {COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
 c5 AS (SELECT 5 AS seq, 1.0 AS weight, 'SECTION:' || vec_id AS k, 'SECTION' AS evidence_type, 'VECTOR_SECTION' AS channel, row_number() OVER (ORDER BY s DESC, vec_id) AS rank, s AS sem, 0.0 AS lexs FROM v WHERE s >= 0.2),
 cand AS (SELECT * FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c5) WHERE rank <= 30),
 fused AS (SELECT k AS evidence_key, min(evidence_type) AS evidence_type, sum(CAST(weight AS DOUBLE) / (60 + rank)) AS f, max(CAST(sem AS DOUBLE)) AS sem, max(CAST(lexs AS DOUBLE)) AS lexs, min(seq * 1000 + rank) AS first, count(DISTINCT channel) AS n_channels FROM cand {{where}} GROUP BY k),
 ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY round(f, 12) DESC, round(greatest(sem, lexs), 9) DESC, first, evidence_key) AS INTEGER) AS position FROM fused)
 SELECT evidence_key, evidence_type, position, round(f, 6) AS fusion_score, round(sem, 6) AS semantic_score, round(lexs, 6) AS lexical_score, n_channels FROM ranked WHERE position <= {{limit}}"""


def fused_sql(where: str, limit: int) -> str:
    return CHANNELS_SQL.replace("{where}", where).replace("{limit}", str(limit))


def shown(fused: DataFrame) -> DataFrame:
    return fused.select("evidence_key", "evidence_type", "position", F.round("fusion_score", 6).alias("fusion_score"), F.round("semantic_score", 6).alias("semantic_score"), F.round("lexical_score", 6).alias("lexical_score"), F.size("channels").cast("long").alias("n_channels"))


@query(fused_sql("", 8))
def fusion_search(spark, sf_dir):
    return shown(retrieval.fuse(channels(spark, sf_dir)))


@query(fused_sql("", 1000))
def rrf_fuse_all(spark, sf_dir):
    return shown(retrieval.fuse(channels(spark, sf_dir), None))


@query(fused_sql("WHERE seq >= 5", 8))
def rrf_mode_vector(spark, sf_dir):
    return shown(retrieval.fuse(retrieval.in_mode(channels(spark, sf_dir), "vector")))


@query(fused_sql("WHERE seq <= 4", 8))
def rrf_mode_fulltext(spark, sf_dir):
    return shown(retrieval.fuse(retrieval.in_mode(channels(spark, sf_dir), "fulltext")))


@query(
    "WITH r AS (" + fused_sql("", 8) + """), s AS (SELECT evidence_key, CAST(row_number() OVER (ORDER BY position) AS INTEGER) AS n, fusion_score FROM r WHERE evidence_type = 'SECTION')
  SELECT evidence_key AS section_key, n FROM s WHERE n <= CASE WHEN (SELECT fusion_score FROM s WHERE n = 1) / (SELECT fusion_score FROM s WHERE n = 2) >= 1.35 THEN 1 ELSE 2 END"""
)
def expand_sections(spark, sf_dir):
    return retrieval.expansions(retrieval.fuse(channels(spark, sf_dir))).select("section_key", "n")


@query(
    """WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
 m AS (SELECT doc_id, t, greatest(0, coalesce(nullif(least(coalesce(nullif(strpos(lower(t), 'tion'), 0), 1000000000), coalesce(nullif(strpos(lower(t), 'ement'), 0), 1000000000)), 1000000000) - 1, 0) - 233) AS a FROM f),
 e AS (SELECT *, least(length(t), a + 700) AS z FROM m), s AS (SELECT *, CASE WHEN z - a < 700 THEN greatest(0, z - 700) ELSE a END AS b FROM e)
 SELECT doc_id, CASE WHEN length(t) <= 700 THEN t ELSE (CASE WHEN b > 0 THEN '...' ELSE '' END) || substr(t, CAST(b + 1 AS BIGINT), CAST(z - b AS BIGINT)) || (CASE WHEN z < length(t) THEN '...' ELSE '' END) END AS quote FROM s"""
)
def quote_window(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.quote("text", F.lit("Tion ement the")).alias("quote"))


# full-text search by an index of terms --------------------------------------------------------------------------

#: A set of requests in the web style: all words, phrases, alternatives, exclusions.
REQUESTS = {1: "the of", 2: '"of the"', 3: "tion or orantion", 4: "the -and", 5: '"in the" that', 6: "src3 de", 7: 'the of and or "de la"', 8: "-the", 9: "Thatin THATIN inoran"}


def requests(spark) -> DataFrame:
    return spark.createDataFrame(list(REQUESTS.items()), "qid int, query string")


def request_values() -> str:
    """The requests' terms as SQL values."""
    rows = []
    for qid, text in REQUESTS.items():
        for alternative, parts in enumerate(fulltext.parse_query(text, "simple")):
            n = sum(wanted for _, wanted in parts)
            rows += [f"({qid}, {alternative}, {part}, {wanted}, {len(phrase)}, {n}, {k}, '{term}')" for part, (phrase, wanted) in enumerate(sorted(parts, key=lambda p: not p[1])) for k, term in enumerate(phrase)]
    return ", ".join(rows)


FULLTEXT_SQL = f"""q(qid, alt, part, wanted, n_terms, n, off, term) AS (VALUES {request_values()}),
 words AS (SELECT doc_id AS id, 'h' AS field, regexp_extract_all(lower(coalesce(source, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents UNION ALL SELECT doc_id, 'b', regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') FROM documents),
 tok AS (SELECT id, field, unnest(w) AS term, unnest(range(len(w))) AS pos FROM words),
 place AS (SELECT qid, alt, part, wanted, n, id, field, pos - off AS spot FROM tok JOIN q USING (term) GROUP BY qid, alt, part, wanted, n, n_terms, id, field, pos - off HAVING count(*) = n_terms),
 hit AS (SELECT qid, alt, id, n, count(DISTINCT CASE WHEN field = 'h' THEN part END) AS n_h FROM place GROUP BY 1, 2, 3, 4 HAVING bool_and(wanted) AND count(DISTINCT part) = n),
 latest AS (SELECT DISTINCT qid, alt, id, p.field, p.n, spot, max(CASE WHEN part = 0 THEN spot END) OVER w AS l0, max(CASE WHEN part = 1 THEN spot END) OVER w AS l1, max(CASE WHEN part = 2 THEN spot END) OVER w AS l2
   FROM place p JOIN hit USING (qid, alt, id) WINDOW w AS (PARTITION BY qid, alt, id, p.field ORDER BY spot RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 stretch AS (SELECT qid, alt, id, field, least(l0, coalesce(l1, l0), coalesce(l2, l0)) AS a, min(spot) AS z, max(n) AS n FROM latest
   WHERE l0 IS NOT NULL AND (n < 2 OR l1 IS NOT NULL) AND (n < 3 OR l2 IS NOT NULL) GROUP BY 1, 2, 3, 4, 5),
 dense AS (SELECT qid, alt, id, sum(CASE WHEN field = 'h' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END / (1 + greatest(0, z - a + 1 - n))) AS score FROM stretch GROUP BY 1, 2, 3),
 ft AS (SELECT qid, id, round(max(coalesce(score, 0.1::DOUBLE * (n_h + 0.4::DOUBLE * (n - n_h)))), 9) AS score FROM hit LEFT JOIN dense USING (qid, alt, id) GROUP BY 1, 2)"""


def ranked_texts(spark, sf_dir, config: str) -> DataFrame:
    return fulltext.match(fulltext.index(table(spark, sf_dir, "documents"), "doc_id", "source", "text", config), requests(spark), config)


@query(f"WITH {FULLTEXT_SQL} SELECT CAST(qid AS INTEGER) AS qid, id, round(score, 6) AS lexical_score FROM ft")
def fulltext_rank(spark, sf_dir):
    return ranked_texts(spark, sf_dir, "simple").withColumn("lexical_score", F.round("lexical_score", 6))


@query()
def fulltext_english(spark, sf_dir):
    return ranked_texts(spark, sf_dir, "english").withColumn("lexical_score", F.round("lexical_score", 6))


def request_channels(spark, sf_dir) -> DataFrame:
    """For each request: texts by full-text rank, and vectors by that of vec_id = qid."""
    lex = ranked_texts(spark, sf_dir, "simple").select("qid", "id", F.lit(None).cast("double").alias("semantic_score"), "lexical_score")
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter(F.col("vec_id").isin(*REQUESTS)).select(F.col("vec_id").cast("int").alias("qid"), F.col("embedding").alias("vector"), F.lit(0.2).alias("min_score"), F.lit(None).cast("bigint").alias("paper_id"))
    return retrieval.channel(lex, "TEXT_SECTION").unionByName(retrieval.channel(retrieval.vector_scores(e, asked, "vec_id", "embedding"), "VECTOR_SECTION"))


@query(
    f"""WITH {FULLTEXT_SQL},
 c2 AS (SELECT 2 AS seq, 1.0 AS weight, qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, 0.0::DOUBLE AS sem, score AS lexs FROM ft),
 v AS (SELECT q.vec_id AS qid, e.vec_id AS id, {COS} AS s FROM embeddings e JOIN embeddings q ON q.vec_id BETWEEN 1 AND {len(REQUESTS)}),
 c5 AS (SELECT 5 AS seq, 1.0 AS weight, qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank, s AS sem, 0.0::DOUBLE AS lexs FROM v WHERE s >= 0.2),
 cand AS (SELECT * FROM (SELECT * FROM c2 UNION ALL SELECT * FROM c5) WHERE rank <= 30),
 fused AS (SELECT qid, 'SECTION:' || id AS evidence_key, sum(CAST(weight AS DOUBLE) / (60 + rank)) AS f, max(sem) AS sem, max(lexs) AS lexs, min(seq * 1000 + rank) AS first, count(DISTINCT seq) AS n_channels FROM cand GROUP BY 1, 2),
 ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(f, 12) DESC, round(greatest(sem, lexs), 9) DESC, first, evidence_key) AS INTEGER) AS position FROM fused)
 SELECT CAST(qid AS INTEGER) AS qid, evidence_key, 'SECTION' AS evidence_type, position, round(f, 6) AS fusion_score, round(sem, 6) AS semantic_score, round(lexs, 6) AS lexical_score, n_channels FROM ranked WHERE position <= 8"""
)
def hybrid_requests(spark, sf_dir):
    fused = retrieval.fuse(request_channels(spark, sf_dir))
    return fused.select("qid", *shown(fused).columns[:3], *[F.round(c, 6).alias(c) for c in ("fusion_score", "semantic_score", "lexical_score")], F.size("channels").cast("long").alias("n_channels"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def keep_first_by_key(spark, sf_dir):
    return retrieval.keep_first(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", F.col("n_chars").desc(), "doc_id").select("source", "doc_id")


# outlines and lines ---------------------------------------------------------------------------------------------


def tree(spark, sf_dir) -> DataFrame:
    """Documents of a source as a heap-shaped tree."""
    idx = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    d = table(spark, sf_dir, "documents").select("source", "doc_id", idx.alias("idx"))
    up = d.select("source", F.col("doc_id").alias("parent_id"), F.col("idx").alias("p_idx"))
    return d.withColumn("p_idx", F.when(F.col("idx") > 0, F.floor((F.col("idx") - 1) / 2))).join(up, ["source", "p_idx"], "left").select("source", F.col("doc_id").alias("id"), "idx", "parent_id", F.concat(F.lit("h"), "idx").alias("header"))


TREE_SQL = """d AS (SELECT source, doc_id AS id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS idx FROM documents),
 t AS (SELECT d.source, d.id, d.idx, p.id AS parent_id, 'h' || d.idx AS header FROM d LEFT JOIN d p ON d.source = p.source AND d.idx > 0 AND p.idx = (d.idx - 1) // 2)"""


@query(f"WITH RECURSIVE {TREE_SQL}, w AS (SELECT id, header AS heading_path, CAST(1 AS INTEGER) AS level FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, w.heading_path || ' > ' || t.header, w.level + 1 FROM t JOIN w ON t.parent_id = w.id) SELECT * FROM w")
def heading_path(spark, sf_dir):
    return structure.heading_paths(tree(spark, sf_dir)).select("id", "heading_path", "level")


@query(f"WITH RECURSIVE {TREE_SQL}, w AS (SELECT source, id, lpad(CAST(idx AS VARCHAR), 12, '0') AS p FROM t WHERE parent_id IS NULL UNION ALL SELECT t.source, t.id, w.p || ' > ' || lpad(CAST(t.idx AS VARCHAR), 12, '0') FROM t JOIN w ON t.parent_id = w.id) SELECT source AS doc, id, CAST(row_number() OVER (PARTITION BY source ORDER BY p, id) AS INTEGER) AS position FROM w")
def dfs_order(spark, sf_dir):
    return structure.depth_first(tree(spark, sf_dir), "source", "id", "parent_id", "idx")


@query(f"WITH {TREE_SQL} SELECT t.id, t.parent_id AS parent, coalesce(c.children, CAST([] AS BIGINT[])) AS children FROM t LEFT JOIN (SELECT parent_id, list(id ORDER BY id) AS children FROM t WHERE parent_id IS NOT NULL GROUP BY 1) c ON t.id = c.parent_id")
def outline_tree(spark, sf_dir):
    return structure.outline_nodes(tree(spark, sf_dir), "id", "parent_id")


@query(f"WITH {TREE_SQL} SELECT source, id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM t WINDOW w AS (PARTITION BY source ORDER BY idx, id)")
def siblings(spark, sf_dir):
    return structure.siblings(tree(spark, sf_dir), "source", "id", "idx")


@query(f"WITH {TREE_SQL} SELECT t.id, p.id AS parent, CASE WHEN length(pd.text) > 500 THEN substr(pd.text, 1, 500) || '...' ELSE pd.text END AS preview FROM t JOIN t p ON t.parent_id = p.id JOIN documents pd ON pd.doc_id = p.id")
def parent_preview(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent"), T.abbreviate("text", 500).alias("preview"))
    return tree(spark, sf_dir).select("id", F.col("parent_id").alias("parent")).join(d, "parent").select("id", "parent", "preview")


LINES_SQL = "l AS (SELECT doc_id AS doc, CAST(unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS INTEGER) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents)"


def doc_lines(spark, sf_dir) -> DataFrame:
    return structure.lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    f"""WITH {LINES_SQL}, b AS (SELECT *, trim(line) = '' AS e, lower(trim(line)) IN ('references', 'bibliography') AS r FROM l)
  SELECT doc, ln, coalesce(lag(e) OVER w, true) AS blank_before, coalesce(lead(e) OVER w, true) AS blank_after,
    coalesce(max(r) OVER (PARTITION BY doc ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_references FROM b WINDOW w AS (PARTITION BY doc ORDER BY ln)"""
)
def line_flags(spark, sf_dir):
    return structure.line_flags(doc_lines(spark, sf_dir)).select("doc", "ln", "blank_before", "blank_after", "after_references")


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def names_sql(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def page_sql(x: str) -> str:
    """Is x a page's header or footer: the survey's rules, written out here a second time."""
    year, journal, more = (f"regexp_matches({x}, '{p}')" for p in (
        r"\b(19|20)\d{2}\b", r"(?i)\b(chaos|vol\.|no\.|pp\.|doi|issn|isbn|phys\.|math\.|theor\.|rev\.|lett\.|proc\.|conf\.|physics|institute|university|society|journal|transactions|ieee|acm|springer|elsevier|nature|science)\b",
        r"(?i)\bet\s+al\b",
    ))
    number = rf"regexp_matches({x}, '\b\d{{5,7}}(-\d+)?\b')"
    return rf"""({x} <> '' AND length({x}) <= 120 AND NOT regexp_matches({x}, '^(\[\d+\]|\d+\.|\(\d+\))') AND NOT regexp_matches({x}, '^#{{1,6}}\s+(\d+(\.\d+)*|[IVXLCDM]+|[A-Z])\.\s+.')
  AND NOT regexp_matches({x}, '(?i)^#{{1,6}}\s+(abstract|references|acknowledge?ments?|data availability|appendix\b.*)$') AND (regexp_matches({x}, '(?i)©|\(c\)|copyright|downloaded from|rights reserved')
  OR length({x}) < 20 AND regexp_matches({x}, '(?i)^(page\s*)?\d+(\s*of\s*\d+)?$') OR {year} AND ({journal} OR {more}) OR {journal} AND ({number} OR {more}) OR starts_with({x}, '#') AND ({journal} OR {number} OR {more})))"""


#: Lines of every kind: whether the references came before, the line, its kind.
KIND_LINES = (
    (False, "", "BODY"), (False, "plain words", "BODY"), (True, "[3] A work of note", "REFERENCE_ITEM"), (True, "Smith, J. A work", "REFERENCE_ITEM"), (True, "4. A work", "REFERENCE_ITEM"), (True, "lower case goes on", "BODY"),
    (False, "Contents", "NOISE"), (False, "Published online: 3 May", "NOISE"), (False, "![a](b.png)", "NOISE"), (False, "12 may 2020 10:11:12", "NOISE"), (False, "Theorem 2 holds", "THEOREM_LIKE"), (False, "Fig. 3", "THEOREM_LIKE"),
    (False, "## ABSTRACT", "ABSTRACT"), (False, "Abstract. We do", "ABSTRACT"), (False, "Bibliography", "REFERENCES"), (False, "7. References", "SECTION"), (False, "Appendix A: Proofs", "APPENDIX"), (False, "Chapter 3", "SECTION"),
    (False, "Part 3", "BODY"), (False, "§ 3. Sign", "SECTION"), (False, "2.1 Data", "SUBSECTION"), (False, "2. Data", "SECTION"), (False, "1. Draw a sample", "LIST_ITEM"), (False, "## 1. Draw a sample", "SECTION"), (False, "1. For each", "SECTION"),
    (False, "IV. Results", "SECTION"), (False, "B. Proofs", "SUBSECTION"), (False, "Acknowledgment", "SECTION"), (False, "ORCID iDs", "SECTION"), (False, "### Methods", "UNCERTAIN"), (False, "Methods", "BODY"),
)
#: The same rules in SQL for the documents' own lines, and a line of the list above for each document with the kind that it must get.
KINDS_SQL = rf"""WITH {LINES_SQL}, a AS (SELECT *, {trim_sql('line')} AS u FROM l), b AS (SELECT *, regexp_matches(u, '^#{{1,6}}\s+\S') AS marked, {trim_sql(r"regexp_replace(regexp_replace(u, '^#{1,6}\s+', ''), '\s{2,}', ' ', 'g')")} AS t FROM a),
 c AS (SELECT *, lower({trim_sql(r"regexp_replace(regexp_replace(regexp_replace(t, '\s+\*$', ''), '(?i)\s+(FREE|EP)$', ''), '\s*[☐☑✓✔]\s*$', '')")}) AS key FROM b),
 d AS (SELECT *, coalesce(max(key IN ('references', 'bibliography')) OVER (PARTITION BY doc ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after FROM c),
 k AS (SELECT CASE WHEN t = '' THEN 'BODY' WHEN after AND regexp_matches(t, '^(\[\d+\]|\$\^\{{?\d+\}}?\$|\d+\.|[A-Z][a-zA-ZÀ-ÿ''\-]+,?\s+[A-Z].*)\s+.+$') THEN 'REFERENCE_ITEM'
   WHEN key IN ('paper', 'affiliations', 'a preprint', 'preprint', 'aip advances', 'why publish with us', 'contents', 'cc creative commons', 'common deed', 'commons deed', 'you may also like', 'articles you may be interested in')
     OR regexp_matches(lower(t), '^(to cite this article|view the article online|check for updates|research article \||cite as:|submitted:|published online:|received:|accepted:)|creative commons|commons deed|legal code|disclaimer|all rights reserved|著作权|저작권|비영리|^(chorus|aip publishing|learn more|\d{{1,2}}\s+[a-z]+\s+\d{{4}}\s+\d{{1,2}}:\d{{2}}:\d{{2}})$')
     OR regexp_matches(t, '^!\[[^\]]*\]\([^)]+\)\s*$') THEN 'NOISE'
   WHEN regexp_matches(t, '(?i)^(theorem|lemma|proposition|definition|corollary|remark|example|proof|fig\.?|figure|table)\b') THEN 'THEOREM_LIKE' WHEN key = 'abstract' OR regexp_matches(t, '(?i)^abstract\s*[:.]\s+.') THEN 'ABSTRACT'
   WHEN key IN ('references', 'bibliography') THEN 'REFERENCES' WHEN starts_with(key, 'appendix') THEN 'APPENDIX' WHEN regexp_matches(t, '(?i)^chapter\s+\d+\b') OR regexp_matches(t, '^§\s*\d+\.\s+.') THEN 'SECTION'
   WHEN regexp_matches(t, '^\d+(\.\d+)+\.?\s+.') THEN 'SUBSECTION'
   WHEN regexp_matches(t, '^\d+\.\s+.') THEN CASE WHEN lower(regexp_extract(t, '^\d+\.\s+(\S+)', 1)) IN ('sample', 'set', 'obtain', 'denote', 'choose', 'draw', 'generate', 'repeat', 'return', 'compute', 'solve', 'let') AND NOT marked THEN 'LIST_ITEM' ELSE 'SECTION' END
   WHEN regexp_matches(t, '^[IVXLCDM]+\.\s+.') THEN 'SECTION' WHEN regexp_matches(t, '^[A-Z]\.\s+.') THEN 'SUBSECTION'
   WHEN key IN ('abstract', 'references') OR regexp_matches(key, '^(acknowledg|data availability|orcid|appendix)') THEN 'SECTION' WHEN marked THEN 'UNCERTAIN' ELSE 'BODY' END AS kind FROM d
   UNION ALL SELECT ([{', '.join(f"'{k}'" for _, _, k in KIND_LINES)}])[CAST(doc_id % {len(KIND_LINES)} + 1 AS INTEGER)] FROM documents)
 SELECT kind, count(*) AS n FROM k GROUP BY 1"""


@query(KINDS_SQL)
def line_kinds(spark, sf_dir):
    """The kinds of all lines of the documents, and of a line of KIND_LINES for each document."""
    pick = lambda k, kind: F.element_at(F.array(*[F.lit(r[k]) for r in KIND_LINES]), (F.col("doc_id") % len(KIND_LINES) + 1).cast("int")).cast(kind)
    ids = table(spark, sf_dir, "documents").select("doc_id", pick(0, "boolean").alias("after"), pick(1, "string").alias("line"))
    made = ids.select(F.concat(F.lit("made "), F.col("doc_id").cast("string")).alias("doc"), F.posexplode(F.when(F.col("after"), F.array(F.lit("References"), "line")).otherwise(F.array("line"))).alias("ln", "line"))
    own = structure.line_flags(doc_lines(spark, sf_dir)).select("kind")
    told = structure.line_flags(made).filter("ln = 1 or line <> 'References'").select("kind")
    return own.unionByName(told).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def marked(spark, sf_dir) -> DataFrame:
    """Lines with headings: the first line starts with a title, every fourth with a section, every seventh with a lower one.

    A heading has whole words, up to 60 or 40 characters (one longer word is cut); what follows is the next line, so no text is lost. Line ln of the
    document is 2 ln here, and what follows its heading 2 ln + 1.
    """
    n, line = F.col("ln"), F.col("line")
    head = lambda most: F.regexp_extract("line", rf"(?s)^\s*\S(?:.{{0,{most - 1}}}(?=\s|$)|.{{0,{most - 1}}})", 0)
    mark = F.when(n == 0, "# ").when(n % 7 == 5, "### ").when(n % 4 == 1, "## ")
    cut = doc_lines(spark, sf_dir).filter(~T.blank("line")).select("doc", "ln", "line", mark.alias("mark"), F.when(n == 0, head(60)).when(mark.isNotNull(), head(40)).alias("head"))
    rest = F.substr(line, F.length("head") + 1)
    heading = F.struct((2 * n).alias("ln"), F.concat("mark", T.jtrim("head")).alias("line"))
    both = F.when(F.col("mark").isNull(), F.array(F.struct((2 * n).alias("ln"), line.alias("line")))).when(T.blank(rest), F.array(heading)).otherwise(F.array(heading, F.struct((2 * n + 1).alias("ln"), rest.alias("line"))))
    return cut.select("doc", F.inline(both))


def head_sql(most: int) -> str:
    return rf"coalesce(nullif(regexp_extract(line, '(?s)^(\s*\S.{{0,{most - 1}}})(?:\s|$)', 1), ''), regexp_extract(line, '(?s)^\s*\S.{{0,{most - 1}}}'))"


MARKED_SQL = rf"""{LINES_SQL}, m1 AS (SELECT *, CASE WHEN ln = 0 THEN '# ' WHEN ln % 7 = 5 THEN '### ' WHEN ln % 4 = 1 THEN '## ' END AS mark FROM l WHERE {trim_sql('line')} <> ''),
 m2 AS (SELECT *, CASE WHEN ln = 0 THEN {head_sql(60)} ELSE {head_sql(40)} END AS head FROM m1), m3 AS (SELECT *, substr(line, length(head) + 1) AS rest FROM m2),
 m4 AS (SELECT doc, 2 * ln AS ln, coalesce(mark || {trim_sql('head')}, line) AS line FROM m3 UNION ALL SELECT doc, 2 * ln + 1, rest FROM m3 WHERE mark IS NOT NULL AND {trim_sql('rest')} <> ''),
 md AS (SELECT *, {trim_sql('line')} AS u FROM m4)"""
SECTIONS_SQL = rf"""{MARKED_SQL}, s1 AS (SELECT *, regexp_matches(line, '^\s*#{{1,9}}\s+\S') AS is_heading FROM md),
 s2 AS (SELECT *, CAST(sum(CAST(is_heading AS INTEGER)) OVER (PARTITION BY doc ORDER BY ln) AS BIGINT) AS idx FROM s1 WHERE is_heading OR NOT {page_sql('u')}),
 s3 AS (SELECT doc, idx, ln, {trim_sql('line')} AS u FROM s2 WHERE NOT is_heading AND {trim_sql('line')} <> ''),
 s4 AS (SELECT *, lag(u) OVER (PARTITION BY doc, idx ORDER BY ln) AS before FROM s3),
 s5 AS (SELECT doc, idx, string_agg(CASE WHEN before IS NULL THEN '' WHEN regexp_matches(before, '[.!?:;]$') THEN chr(10) ELSE ' ' END || u, '' ORDER BY ln) AS content FROM s4 GROUP BY 1, 2),
 s6 AS (SELECT doc, idx, {trim_sql("regexp_replace(u, '^#+', '')")} AS header, length(regexp_extract(u, '^(#+)', 1)) AS level FROM s2 WHERE is_heading),
 sections AS (SELECT doc, idx, coalesce(header, '') AS header, CAST(coalesce(level, 0) AS INTEGER) AS level, coalesce(content, '') AS content FROM s6 FULL JOIN s5 USING (doc, idx))"""


@query()
def heading_decisions(spark, sf_dir):
    return structure.decide_headings(structure.line_flags(marked(spark, sf_dir))).select("doc", "ln", "kind", "action", "level", F.round("confidence", 6).alias("confidence"), "reason")


@query()
def outline_confidence(spark, sf_dir):
    return structure.outline_report(structure.decide_headings(structure.line_flags(marked(spark, sf_dir))))


@query()
def normalised_markdown(spark, sf_dir):
    return structure.normalised_markdown(structure.decide_headings(structure.line_flags(marked(spark, sf_dir))))


@query(f"WITH {SECTIONS_SQL} SELECT * FROM sections")
def sections_from_markdown(spark, sf_dir):
    return structure.sections(marked(spark, sf_dir))


@query(f"WITH {SECTIONS_SQL} SELECT a.doc, a.idx, a.level, CASE WHEN a.level > 1 THEN (SELECT max(b.idx) FROM sections b WHERE b.doc = a.doc AND b.idx < a.idx AND b.level BETWEEN 1 AND a.level - 1) END AS parent_idx FROM sections a")
def section_parents(spark, sf_dir):
    return structure.parents(structure.sections(marked(spark, sf_dir)))


@query(
    rf"""WITH {MARKED_SQL}, t AS (SELECT *, {trim_sql(r"regexp_replace(regexp_replace(u, '^#+', ''), '[*_]', '', 'g')")} AS title FROM md),
  f AS (SELECT * FROM t WHERE (starts_with(u, '# ') OR starts_with(u, '## ') AND NOT regexp_matches(lower(title), '^(abstract$|index$|introduction|author)')) AND NOT {page_sql('u')})
  SELECT doc, coalesce(arg_min(f.title, f.ln), 'Untitled Paper') AS title FROM md LEFT JOIN f USING (doc, ln) GROUP BY doc"""
)
def title_extract(spark, sf_dir):
    return structure.titles(marked(spark, sf_dir))


@query()
def abstract_extract(spark, sf_dir):
    return structure.abstracts(structure.sections(marked(spark, sf_dir)))


# chunks ---------------------------------------------------------------------------------------------------------

UUID_SQL = """m AS (SELECT *, md5(CAST(doc_id AS VARCHAR) || '|0|' || sha256(text)) AS m FROM documents)"""


@query(
    f"""WITH {UUID_SQL} SELECT doc_id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-' || lower(printf('%02x', (CAST('0x' || substr(m, 17, 2) AS INTEGER) & 63) | 128)) || substr(m, 19, 2) || '-' || substr(m, 21, 12) AS chunk_id,
   sha256(text) AS content_hash, CAST(greatest(1, (length(text) + 3) // 4) AS INTEGER) AS token_count FROM m"""
)
def chunk_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.chunk_id(F.col("doc_id"), F.lit(0), F.col("text")).alias("chunk_id"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), T.token_estimate("text").alias("token_count"))


@query()
def chunks(spark, sf_dir):
    return chunking.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("section_id", "chunk_index", "chunk_id", "token_count")


@query(
    f"""WITH {LINES_SQL}, c AS (SELECT doc, ln AS seq, ln // 5 + 1 AS page, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t FROM l)
  SELECT doc, seq, CAST(page AS INTEGER) AS page, CAST(coalesce(sum(length(t) + 1) OVER w, 0) AS BIGINT) AS start, CAST(coalesce(sum(length(t) + 1) OVER w, 0) + length(t) AS BIGINT) AS "end" FROM c WHERE t <> ''
  WINDOW w AS (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def page_spans(spark, sf_dir):
    blocks = doc_lines(spark, sf_dir).withColumn("page", F.floor(F.col("ln") / 5))
    return chunking.page_spans(blocks, "doc", "ln", "line", "page").drop("t")


#: Slices of each text in swapped pairs, so that every second is found by going back to the beginning; some with another end, some that are nowhere, some too short.
LOCATED_SQL = f"""WITH RECURSIVE {LINES_SQL}, b AS (SELECT doc, ln AS seq, ln // 5 + 1 AS page, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t FROM l),
 p AS (SELECT doc, page, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(t) AS n, seq, t FROM b WHERE t <> ''),
 s AS (SELECT doc, string_agg(t, ' ' ORDER BY seq) AS source FROM p GROUP BY doc),
 k AS (SELECT doc_id AS doc, text, unnest(range(0, length(text) // 400 + 1)) AS k FROM documents),
 c AS (
  SELECT doc, k, trim(regexp_replace(CASE WHEN k % 11 = 3 THEN 'these words are nowhere to be found in any of the texts' WHEN k % 13 = 5 THEN substr(text, 400 * xor(k, 1) + 1, 20)
    WHEN k % 5 = 0 THEN substr(text, 400 * xor(k, 1) + 1, 120) || ' and another end of it that goes on for long enough to be in the anchor' ELSE substr(text, 400 * xor(k, 1) + 1, 700) END, '\\s+', ' ', 'g')) AS t FROM k),
 r AS (
  SELECT doc, CAST(-1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS after, CAST(NULL AS BIGINT) AS hit, CAST(0 AS BIGINT) AS size FROM (SELECT DISTINCT doc FROM c)
  UNION ALL SELECT doc, k, CASE WHEN hit IS NULL THEN after ELSE least(length(source), hit + 1) END, hit, size FROM (
    SELECT r.doc, c.k, r.after, s.source, length(c.t) AS size, CASE WHEN length(c.t) < 24 THEN NULL WHEN strpos(substr(s.source, r.after + 1), substr(c.t, 1, 180)) > 0 THEN r.after + strpos(substr(s.source, r.after + 1), substr(c.t, 1, 180)) - 1
      WHEN length(c.t) > 100 AND strpos(substr(s.source, r.after + 1), substr(c.t, 1, 100)) > 0 THEN r.after + strpos(substr(s.source, r.after + 1), substr(c.t, 1, 100)) - 1
      ELSE nullif(strpos(s.source, substr(c.t, 1, CASE WHEN length(c.t) > 100 THEN 100 ELSE 180 END)), 0) - 1 END AS hit
    FROM r JOIN c ON c.doc = r.doc AND c.k = r.k + 1 LEFT JOIN s ON s.doc = r.doc))
 SELECT r.doc, CAST(r.k AS INTEGER) AS chunk_index, CAST(a.page AS INTEGER) AS page_start, CAST(z.page AS INTEGER) AS page_end FROM r LEFT JOIN s ON s.doc = r.doc
 LEFT JOIN p a ON a.doc = r.doc AND r.hit >= a.a AND r.hit < a.a + a.n
 LEFT JOIN p z ON r.hit IS NOT NULL AND z.doc = r.doc AND greatest(r.hit, least(r.hit + r.size, length(s.source)) - 1) >= z.a AND greatest(r.hit, least(r.hit + r.size, length(s.source)) - 1) < z.a + z.n WHERE r.k >= 0"""


@query(LOCATED_SQL)
def page_locate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    k = d.select(F.col("doc_id").alias("doc"), "text", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 400).cast("int"))).alias("k"))
    cut = lambda n: F.substr("text", 400 * F.col("k").bitwiseXOR(1) + 1, F.lit(n))
    content = F.when(F.col("k") % 11 == 3, "these words are nowhere to be found in any of the texts").when(F.col("k") % 13 == 5, cut(20))
    content = content.when(F.col("k") % 5 == 0, F.concat(cut(120), F.lit(" and another end of it that goes on for long enough to be in the anchor"))).otherwise(cut(700))
    blocks = doc_lines(spark, sf_dir).select("doc", F.col("ln").alias("seq"), F.col("line").alias("text"), F.floor(F.col("ln") / 5).cast("int").alias("page_index"))
    return chunking.locate_pages(k.select("doc", F.col("k").alias("chunk_index"), content.alias("content")), blocks)


# references and symbols -----------------------------------------------------------------------------------------

#: Eight texts by line, with numbers a, b and c: every form of citation, and what only looks like one.
CITED = """CASE CAST((l_orderkey + l_linenumber) % 8 AS INT) WHEN 0 THEN concat('As in [', a, ', ', b, '-', c, '] we see') WHEN 1 THEN concat('x<sup>', a, '</sup> and <sup>', b, ',', c, '</sup>')
  WHEN 2 THEN concat('told$^{', a, '–', c, '}$') WHEN 3 THEN concat('x^{', a, '}, but not [', c, '-', a, '] nor [see ', b, ']') WHEN 4 THEN 'Smith et al. (2019; 2020a) told it, and [1-2000] did not'
  WHEN 5 THEN 'By Müller and Kaya (1789, 2018b) and by O-Neil (2001)' WHEN 6 THEN concat('In 2019 we saw [', a, ' ', b, ']. Since 1999, Smith 2001 and (Kaya, 2002)') ELSE concat('[', a, ', ', a, '] by Kaya (2001) and Kaya (2001)') END"""
CITED_SQL = """
WITH t AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 8 AS k, l_linenumber AS a, l_linenumber + 2 AS b, l_linenumber + 4 AS c FROM lineitem),
n AS (
  SELECT *, CASE k WHEN 0 THEN [a, b, b + 1, c] WHEN 1 THEN [a, b, c] WHEN 2 THEN [a, a + 1, a + 2, a + 3, a + 4] WHEN 3 THEN [a] WHEN 7 THEN [a] ELSE [] END AS numbers,
    CASE k WHEN 4 THEN ['Smith 2019', 'Smith 2020a'] WHEN 5 THEN ['Müller 1789', 'Müller 2018b', 'O-Neil 2001'] WHEN 7 THEN ['Kaya 2001'] ELSE [] END AS author_years FROM t),
told AS (SELECT l_orderkey, l_linenumber, list_sort([CAST(x AS VARCHAR) for x in numbers]) AS numbers, CAST(author_years AS VARCHAR[]) AS author_years FROM n)
"""


def cited_texts(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + 2).alias("b"), (F.col("l_linenumber") + 4).alias("c"))
    return r.select("l_orderkey", "l_linenumber", F.expr(CITED).alias("t"))


@query(CITED_SQL + "SELECT * FROM told")
def citations(spark, sf_dir):
    return cited_texts(spark, sf_dir).select("l_orderkey", "l_linenumber", T.numeric_citations("t").alias("numbers"), T.author_year_citations("t").alias("author_years"))


@query(CITED_SQL + "SELECT DISTINCT l_orderkey AS doc, l_orderkey AS section_id, unnest(numbers || author_years) AS ref_index FROM told")
def citation_links(spark, sf_dir):
    return references.citation_links(cited_texts(spark, sf_dir), "l_orderkey", "l_orderkey", "t")


@query(
    """WITH e AS (SELECT unnest(range(1, 9)) AS k), o AS (SELECT o_orderkey FROM orders)
  SELECT o_orderkey AS doc, CAST(k AS INTEGER) AS seq, ['1', '2', '3', '4', '5', 'Beale 1984', 'Altafini 2012a', 'Smith 1999'][k] AS ref_index,
    ['Work ' || o_orderkey || ' goes on. more of it.', 'R. C. Other, 2001.;', 'Third one', 'Fourth', 'Fifth', 'J. T. Beale (1984). On it', 'Altafini, C. (2012a) Consensus', 'Smith et al. (1999) Title and a line more'][k] AS raw_text FROM o, e"""
)
def reference_entries(spark, sf_dir):
    text = F.concat(
        F.lit("of no entry\n[1] Work "), "o_orderkey", F.lit(" goes on.\nmore of it. 2. R. C. Other, 2001.; 3. Third one\n<sup>4</sup> Fourth\n$^{5}$ Fifth\n"),
        F.lit("J. T. Beale (1984). On it\n Altafini, C. (2012a) Consensus\nSmith et al. (1999) Title\n\n  and a line more"),
    )
    return references.entries(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", "t")


@query("SELECT c_custkey, md5('customer' || lpad(CAST(c_custkey % 7 AS VARCHAR), 2, '0') || '|zed|' || (2000 + c_custkey % 5) || '|') AS fingerprint FROM customer")
def fingerprints(spark, sf_dir):
    names = F.array(F.lit(" Zed! "), F.concat(F.lit("Customer-"), F.lpad((F.col("c_custkey") % 7).cast("string"), 2, "0")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.fingerprint(names, 2000 + F.col("c_custkey") % 5).alias("fingerprint"))


NO_DESCRIPTION = "lower({0}) IN ('', 'null', 'none')"


@query(
    f"""WITH g AS (SELECT p_size % 10 AS doc, p_brand AS symbol, list(CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE p_name END ORDER BY p_partkey) AS told, list_sort(list(DISTINCT p_partkey % 6)) AS scopes FROM part WHERE length(p_brand) BETWEEN 1 AND 10 GROUP BY 1, 2)
  SELECT doc, symbol, list_reduce(told, lambda held, new: CASE WHEN NOT {NO_DESCRIPTION.format('new')} AND ({NO_DESCRIPTION.format('held')} OR length(new) > length(held) + 5) THEN new ELSE held END) AS description, scopes, len(scopes) > 3 AS is_global FROM g"""
)
def symbol_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("doc"), F.col("p_partkey").alias("seq"), F.concat(F.lit(" "), "p_brand").alias("symbol"), F.when(F.col("p_partkey") % 3 == 0, "null").otherwise(F.col("p_name")).alias("description"), (F.col("p_partkey") % 6).alias("root"))
    return references.merge_symbols(rows)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE doc_id % 3 = 0) WHERE n = 1")
def reference_section(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 == 0, "References").otherwise("Body").alias("header"), "text")
    return references.reference_section(d, "source", "header", "text", "doc_id").select("source", "doc_id")


# audit ----------------------------------------------------------------------------------------------------------


def relations(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source"), (F.col("vec_id") + 1).alias("target"), "label")
    return e.select("source", "target", F.when(F.col("label") % 3 == 0, "SUPPORTS").when(F.col("label") % 3 == 1, "extends ").otherwise("odd").alias("type"), (F.col("source") % 11 / 10.0).alias("confidence"), (F.col("source") % 4).alias("n_for"), (F.col("source") % 3).alias("n_against"))


REL_SQL = "SELECT vec_id AS source, vec_id + 1 AS target, CASE WHEN label % 3 = 0 THEN 'SUPPORTS' WHEN label % 3 = 1 THEN 'EXTENDS' ELSE 'UNRELATED' END AS type, CASE WHEN least(vec_id % 11 / 10.0, 1.0) >= 0.65 AND vec_id % 4 + vec_id % 3 > 0 THEN 'CONFIRMED' ELSE 'PENDING_REVIEW' END AS audit_status FROM embeddings"


def audited(spark, sf_dir) -> DataFrame:
    return relations(spark, sf_dir).select("source", "target", T.relation_type("type").alias("type"), audit.status(F.col("confidence"), F.col("n_for"), F.col("n_against")).alias("audit_status"))


@query(REL_SQL)
def audit_status(spark, sf_dir):
    return audited(spark, sf_dir)


@query(f"SELECT source AS paper_id, target AS other_id, 'OUTGOING' AS direction, type, audit_status FROM ({REL_SQL}) UNION ALL SELECT target, source, 'INCOMING', type, audit_status FROM ({REL_SQL})")
def relations_both_ways(spark, sf_dir):
    return audit.both_ways(audited(spark, sf_dir))


@query(f"SELECT * FROM ({REL_SQL}) WHERE source % 5 <> 0 UNION ALL SELECT source, target, 'USES' AS type, 'CONFIRMED' AS audit_status FROM ({REL_SQL}) WHERE source % 5 = 0")
def relation_upsert(spark, sf_dir):
    old = audited(spark, sf_dir)
    new = old.filter("source % 5 = 0").select("source", "target", F.lit("USES").alias("type"), F.lit("CONFIRMED").alias("audit_status"))
    return audit.upsert(old, new, "source", "target")


@query(f"SELECT CASE WHEN source % 4 = 0 THEN 'history' WHEN audit_status = 'CONFIRMED' THEN 'confirmed' ELSE 'pending' END AS bucket, count(*) AS n FROM ({REL_SQL}) GROUP BY 1")
def relation_buckets(spark, sf_dir):
    version = F.when(F.col("source") % 4 == 0, "v0").otherwise("v1")
    return audited(spark, sf_dir).groupBy(audit.bucket(F.col("audit_status"), version, "v1").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT source, CASE WHEN audit_status = 'PENDING_REVIEW' THEN 'Needs review: ' ELSE '' END || 'This paper ' || CASE type WHEN 'SUPPORTS' THEN 'supports' WHEN 'EXTENDS' THEN 'extends' ELSE 'is unrelated to' END || ' paper ' || target || CASE WHEN audit_status = 'PENDING_REVIEW' OR type = 'UNRELATED' THEN '' ELSE '. So it is' END AS said FROM ({REL_SQL})")
def relation_narrative(spark, sf_dir):
    return audited(spark, sf_dir).select("source", audit.narrative(F.col("type"), F.lit("OUTGOING"), F.col("audit_status"), F.concat(F.lit("paper "), "target"), F.lit("So it is")).alias("said"))


@query("SELECT vec_id AS source, vec_id + 1 AS target, 'SECTION:' || vec_id AS evidence_key, 1 AS seq FROM embeddings")
def audit_evidence_filter(spark, sf_dir):
    r = relations(spark, sf_dir).select("source", "target")
    keys = r.withColumn("keys", F.array(F.lit("SECTION:made-up"), F.concat(F.lit("SECTION:"), "source"), F.concat(F.lit("SECTION:"), "source")))
    return audit.cited(keys, r.withColumn("evidence_key", F.concat(F.lit("SECTION:"), "source")))


# evaluation, ingest, memory -------------------------------------------------------------------------------------


@query("WITH r AS (SELECT doc_id AS qid, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE doc_id % 13 + 1 END AS f FROM documents) SELECT round(avg(CASE WHEN f BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN f BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(CASE WHEN f BETWEEN 1 AND 10 THEN 1.0 / greatest(f, 1) ELSE 0.0 END), 6) AS mrr_10, round(avg(CASE WHEN f BETWEEN 1 AND 10 THEN 1.0 / log2(f + 1.0) ELSE 0.0 END), 6) AS ndcg_10 FROM r")
def eval_metrics(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 3, 0).otherwise(F.col("doc_id") % 13 + 1).alias("first_rank"))
    return evaluate.metrics(r)


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS position FROM documents) SELECT source AS qid, CAST(coalesce(min(CASE WHEN contains(lower('Section ' || doc_id), 'section 1') THEN position END), 0) AS INTEGER) AS first_rank FROM r WHERE position <= 10 GROUP BY 1")
def eval_first_rank(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))
    r = table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), n.alias("position"), F.concat(F.lit("Section  "), "doc_id").alias("heading"), F.lit("").alias("heading_path")).filter("position <= 10")
    cases = r.select("qid").distinct().withColumn("expected", F.lit(" SECTION 1"))
    return evaluate.first_rank(r, cases)


@query("SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events")
def latency_percentiles(spark, sf_dir):
    return evaluate.percentiles(table(spark, sf_dir, "events"), "value")


@query("SELECT md5(text) AS file_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def job_dedupe(spark, sf_dir):
    jobs = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("file_hash"), "doc_id")
    return ingest.earliest_by_hash(jobs, "file_hash", "doc_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def stage_latest(spark, sf_dir):
    return ingest.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


STATUS = "element_at(array('UPLOADED', 'PARSING', 'PARSED', 'AUDITING', 'READY', 'FAILED'), cast(event_id % 6 + 1 as int))"


@query(
    """WITH e AS (SELECT user_id, event_id, ts, (['UPLOADED', 'PARSING', 'PARSED', 'AUDITING', 'READY', 'FAILED'])[CAST(event_id % 6 + 1 AS INTEGER)] AS after FROM events),
  t AS (SELECT user_id, event_id, lag(after) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, after FROM e)
  SELECT * FROM t WHERE before IS NOT NULL AND before <> after AND before || '>' || after NOT IN ('UPLOADED>PARSING', 'UPLOADED>FAILED', 'PARSING>PARSED', 'PARSING>FAILED', 'PARSED>AUDITING', 'PARSED>FAILED', 'AUDITING>READY', 'AUDITING>FAILED', 'READY>UPLOADED', 'READY>PARSED', 'FAILED>UPLOADED', 'FAILED>PARSED')"""
)
def transitions_illegal(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr(STATUS).alias("status"))
    return ingest.transitions(e, "user_id", "ts", "event_id", "status").filter("not legal").drop("legal")


@query("SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS updated_at FROM events WHERE event_type <> 'purchase' AND ts < (SELECT max(ts) FROM events) - INTERVAL 130 MINUTE ORDER BY ts, event_id LIMIT 10")
def recoverable_jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    jobs = e.select(F.col("event_id").alias("id"), F.col("ts").alias("updated_at"), F.when(F.col("event_type") == "purchase", "READY").otherwise("PARSING").alias("status"), F.lit(None).cast("timestamp_ntz").alias("lease_until"))
    return ingest.recoverable(jobs, now).select("id", "updated_at")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def memory_window(spark, sf_dir):
    return ingest.memory_window(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'AI: ' END || text, chr(10) ORDER BY turn) AS context FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1")
def rewrite_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    said = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("AI: "), "text")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))).alias("r")).select("conv_id", F.array_join(F.transform("r", lambda r: r["s"]), "\n").alias("context"))


@query("SELECT user_id FROM (SELECT user_id, min(event_id) AS o FROM events WHERE user_id > 0 GROUP BY 1) ORDER BY o, user_id LIMIT 20")
def scope_ids(spark, sf_dir):
    return ingest.scope_ids(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("SELECT o.o_orderkey AS paper_id, o.o_orderstatus, o.o_totalprice, count(l.l_partkey) AS n_references, CAST(coalesce(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_returned FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2, 3")
def workspace_bundle(spark, sf_dir):
    sides = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_orderstatus", "o_totalprice")
    return o.join(sides, "paper_id", "left").select("paper_id", "o_orderstatus", "o_totalprice", F.coalesce("n", F.lit(0)).alias("n_references"), F.coalesce("r", F.lit(0)).alias("n_returned"))


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN NULL ELSE 'v2' END, ''), 'legacy-v0') AS audit_version, coalesce(CASE WHEN event_id % 2 = 0 THEN 'CONFIRMED' END, 'PENDING_REVIEW') AS audit_status FROM events")
def audit_backfill(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n % 3 == 0, "").when(n % 3 == 2, "v2").alias("audit_version"), F.when(n % 2 == 0, "CONFIRMED").alias("audit_status"))
    return audit.fill_audit(rows)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json(T.json_object(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "k bigint")["k"].alias("k"))


# library views --------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def rows_by_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return library.with_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ids, "o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ar')")
def title_filter(spark, sf_dir):
    return library.titled(table(spark, sf_dir, "part").select("p_partkey", "p_name"), " AR ", "p_name")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_brand), '#1') OR contains(lower(p_type), 'steel')")
def symbol_keyword(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    both = library.symbols_like(p, "#1", "p_brand").select("p_partkey").union(library.symbols_like(p, "STEEL", "p_type").select("p_partkey"))
    return both.distinct()


@query("SELECT l_orderkey AS paper_id, CAST(l_partkey % 9 AS VARCHAR) AS ref_index, list(DISTINCT CAST(l_linenumber AS VARCHAR) ORDER BY CAST(l_linenumber AS VARCHAR)) AS section_ids FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1, 2")
def citing_sections(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), (F.col("l_partkey") % 9).cast("string").alias("ref_index"), F.col("l_linenumber").cast("string").alias("section_id"))
    sections = spark.range(1, 8).select(F.col("id").cast("string").alias("id"), F.col("id").alias("idx"))
    return library.citing_sections(links, sections)


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'up' WHEN event_id % 6 = 1 THEN 'busy' WHEN event_id % 6 = 2 THEN 'text' WHEN event_id % 6 = 3 THEN 'busy' WHEN event_id % 6 = 4 THEN 'ok' ELSE 'error' END AS mark FROM events")
def status_marks(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", library.status_mark(F.expr(STATUS)).alias("mark"))


@query("SELECT source AS doc, string_agg('h' || doc_id || chr(10) || lang, chr(10) || chr(10) ORDER BY doc_id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY 1")
def metadata_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.lit("h"), "doc_id").alias("header"), "lang")
    return library.metadata_context(d, "source", "doc_id", "header", "lang")


@query("SELECT doc_id, repeat('#', CAST(doc_id % 4 + 1 AS INTEGER)) || ' ' || source AS key FROM documents")
def outline_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", library.outline_key((F.col("doc_id") % 4 + 1).cast("int"), F.col("source")).alias("key"))


@query("SELECT user_id, max(ts) AS updated_at FROM events GROUP BY 1")
def workspace_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    return library.workspaces(e.filter("user_id % 2 = 0"), e, "user_id", "updated_at")


@query("SELECT n_nationkey, [n_name] AS surnames, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 2000 END AS year, n_nationkey % 3 <> 0 AS ok FROM nation")
def metadata_complete(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.array("n_name").alias("surnames"), F.when(F.col("n_nationkey") % 3 == 0, 0).otherwise(2000).alias("year"))
    return library.whole_metadata(n)


STALE_SQL = """
WITH p AS (SELECT doc_id AS paper_id, doc_id % 7 = 0 AS edited, doc_id % 13 = 0 AS is_new, doc_id % 11 = 0 AS failed, doc_id % 17 = 0 AS unseen FROM documents WHERE text IS NOT NULL),
t AS (
  SELECT paper_id, CASE WHEN is_new THEN 'NEW' WHEN failed THEN 'FAILED' WHEN edited THEN 'CHANGED' END AS sections, CASE WHEN failed THEN 'FAILED' END AS own_symbols,
    CASE WHEN unseen THEN 'NEW' END AS own_vectors FROM p),
s AS (SELECT paper_id, sections, coalesce(own_symbols, CASE WHEN sections IS NOT NULL THEN 'UPSTREAM' END) AS symbols, own_vectors FROM t),
v AS (SELECT paper_id, sections, symbols, coalesce(own_vectors, CASE WHEN sections IS NOT NULL OR symbols IS NOT NULL THEN 'UPSTREAM' END) AS vectors FROM s)
SELECT paper_id, 'PERSIST' AS stage, sections AS reason FROM v WHERE sections IS NOT NULL UNION ALL SELECT paper_id, 'SYMBOLS', symbols FROM v WHERE symbols IS NOT NULL
UNION ALL SELECT paper_id, 'EMBEDDING', vectors FROM v WHERE vectors IS NOT NULL
"""


@query(STALE_SQL)
def stale_stages(spark, sf_dir):
    """What a run would compute, and why, after some documents were edited, some came and some stages failed."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("paper_id"), "text")
    graph = [stages.Stage("PERSIST", ("parsed",), None), stages.Stage("SYMBOLS", ("persist",), None), stages.Stage("EMBEDDING", ("persist", "symbols"), None)]
    prints = {"parsed": stages.fingerprints(docs), "persist": stages.fingerprints(docs.select("paper_id", F.upper("text").alias("content"))), "symbols": stages.fingerprints(docs.select("paper_id", F.substring("text", 1, 8).alias("symbol")))}
    last = lambda s, edited: stages.input_print({n: stages.fingerprints(docs.withColumn("text", F.when(edited, F.concat("text", F.lit("."))).otherwise(F.col("text")))) if n == "parsed" else prints[n] for n in s.reads}, s.version)
    status = F.when(F.col("paper_id") % 11 == 0, "FAILED").otherwise("COMPLETED")
    ledgers = {s.name: last(s, F.col("paper_id") % 7 == 0) for s in graph}
    ledgers["PERSIST"] = ledgers["PERSIST"].filter("paper_id % 13 <> 0").withColumn("status", status)
    ledgers["SYMBOLS"] = ledgers["SYMBOLS"].withColumn("status", status)
    ledgers["EMBEDDING"] = ledgers["EMBEDDING"].filter("paper_id % 17 <> 0").withColumn("status", F.lit("COMPLETED"))
    return stages.stale(graph, prints, ledgers)


#: A paper with every rule of levels, and what must become of each line: (line, action, level).
OUTLINE = (
    ("", "DROP", 0), ("Published online: 3 May", "DROP", 0), ("# A Title of Some Words", "HEADING", 1), ("## Odd heading", "DROP", 0), ("Abstract: We do things.", "SPLIT", 2), ("Contents", "DROP", 0), ("1 Data 3", "DROP", 0),
    ("## 1. Introduction", "HEADING", 2), ("plain words", "TEXT", 0), ("", "TEXT", 0), ("## 1.1 Rows", "HEADING", 3), ("## 1. First step", "HEADING", 4), ("## 2. Data", "HEADING", 2), ("2.1.3 Deep", "HEADING", 3),
    ("## 2.1.3 Deep. It goes on here.", "HEADING", 4), ("3. METHODS AND MORE", "HEADING", 2), ("4. Things we saw", "TEXT", 0), ("1. Draw a sample", "TEXT", 0), ("Theorem 2 holds", "TEXT", 0), ("## A. Letter", "HEADING", 3),
    ("## IV. Roman", "HEADING", 2), ("### Odd again", "HEADING", 3), ("#### The Algorithm", "HEADING", 4), ("# A Title of Some Words", "DROP", 0), ("Acknowledgements: we thank all.", "SPLIT", 2), ("## Appendix A: Proofs", "HEADING", 2),
    ("## 1. Lemmas", "HEADING", 3), ("## Other", "HEADING", 3), ("5. Results of all. They are told here.", "SPLIT", 3), ("## References", "HEADING", 2), ("[1] A work", "TEXT", 0), ("## 6. Late", "TEXT", 0),
)
OUTLINE_SQL = f"""SELECT doc_id AS doc, CAST(k AS INTEGER) AS ln, ([{', '.join(f"'{a}'" for _, a, _ in OUTLINE)}])[k + 1] AS action, CAST(([{', '.join(str(v) for *_, v in OUTLINE)}])[k + 1] AS INTEGER) AS level
 FROM documents, (SELECT unnest(range({len(OUTLINE)})) AS k)"""


@query(OUTLINE_SQL)
def outline_rules(spark, sf_dir):
    """The decisions over a paper with every kind of heading, for each document; the SQL writes out what must come."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.array(*[F.lit(x) for x, *_ in OUTLINE])).alias("ln", "line"))
    return structure.decide_headings(structure.line_flags(docs)).select("doc", "ln", "action", "level")


@query()
def hashed_neighbours(spark, sf_dir):
    """The documents nearest to each benchmark text by the embedding that needs no model: every text of both tables is embedded."""
    found = embedding.hashed(table(spark, sf_dir, "documents"), "doc_id", "text")
    # ids of the asked below zero: a row is never its own neighbour by number
    asked = embedding.hashed(table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("item_id"), "text"), "item_id", "text")
    return knn.nearest(asked, found, 3, above=0.0).select((-1 - F.col("id")).alias("item_id"), F.col("neighbour").alias("doc_id"), "rank", F.round("similarity", 6).alias("similarity"))


@query(
    """WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source FROM documents)
  SELECT doc_id AS id, unnest(['x_1', '\\beta', 'N', 'm_k']) AS symbol, unnest(['the rate of ' || lang, 'a weight in ' || source, 'the number of rows', 'The mean of ' || source]) AS description FROM d"""
)
def defined_symbols(spark, sf_dir):
    """The symbols that each document defines: sentences of every form are put before, between and behind its own text, which defines none."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(c, F.lit("none")).alias(c) for c in ("lang", "source")])
    told = F.concat(
        F.lit("Let x_1 denote the rate of "), "lang", F.lit(".\n"), "text", F.lit("\nwe go on, where $\\beta$ is a weight in "), "source", F.lit("; denote by none. Denote by N the number of rows, then.\n"),
        "text", F.lit("\nThe mean of "), "source", F.lit(" is denoted by m_k. Let us go"),
    )
    rows = d.select("doc_id", F.lit(None).cast("string").alias("title"), told.alias("told"))
    return extract.symbols(rows, "doc_id", "title", "told").select("id", "symbol", "description")


@query(
    """SELECT doc_id AS doc, CASE doc_id % 4 WHEN 0 THEN 'We weigh ' || coalesce(source, 'none') || '.' WHEN 1 THEN 'We weigh ' || coalesce(lang, 'none') || ' here'
  WHEN 2 THEN 'We weigh document ' || doc_id || ' at length' ELSE 'Abstract Not Found' END AS abstract FROM documents"""
)
def abstracts_found(spark, sf_dir):
    """Papers whose abstract has a section of its own, stands within the first one, or in the first half behind an empty section, or is not there; a paper a document."""
    d = table(spark, sf_dir, "documents").select("doc_id", *[F.coalesce(c, F.lit("none")).alias(c) for c in ("lang", "source")])
    part = lambda header, *content: F.struct(F.lit(header).alias("header"), F.concat(*[F.lit(x) if x not in d.columns else F.col(x).cast("string") for x in content]).alias("content"))
    own = F.array(part("Title", ""), part("1. ABSTRACT", "Abstract: We weigh ", "source", ". Keywords: a, b"), part("2. Data", "In this paper we go on."))
    first = F.array(part("Front", "By A. Author. ABSTRACT - We weigh ", "lang", " here"), part("Data", "words"))
    behind = F.array(part("Abstract", ""), part("Front", "Some words about the authors that go on for a while. " * 2 + "Abstract. We weigh document ", "doc_id", " at length INTRODUCTION and more"), part("Data", "x"), part("More", "y"))
    none = F.array(part("Front", "plain words"), part("Data", "more of them"))
    kind = F.col("doc_id") % 4
    rows = F.when(kind == 0, own).when(kind == 1, first).when(kind == 2, behind).otherwise(none)
    return structure.abstracts(d.select(F.col("doc_id").alias("doc"), F.posexplode(rows).alias("idx", "s")).select("doc", "idx", "s.header", "s.content"))
