"""Hybrid evidence retrieval for a set of queries: channels, weighted rank fusion, evidence, expansion.

Candidates of every channel share CANDIDATE. Channels are limited to the best rows a query by a window whose limit is
applied before the shuffle, so a channel moves at most `limit` rows a query and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import vectors as V

CANDIDATE = ["qid", "channel", "channel_seq", "weight", "rank", "evidence_key", "evidence_type", "semantic_score", "lexical_score"]
#: Channel order, weight and kind of evidence.
CHANNELS = {
    "EXACT_SYMBOL": (1, 1.25, "SYMBOL"), "TEXT_SECTION": (2, 1.0, "SECTION"), "TEXT_SYMBOL": (3, 0.85, "SYMBOL"), "TEXT_REFERENCE": (4, 0.75, "REFERENCE"),
    "VECTOR_SECTION": (5, 1.0, "SECTION"), "VECTOR_SYMBOL": (6, 0.85, "SYMBOL"), "VECTOR_REFERENCE": (7, 0.75, "REFERENCE"),
}
MODES = {"hybrid": range(1, 8), "vector": range(5, 8), "fulltext": range(1, 5)}
RRF_K, CANDIDATES, LEAST_CANDIDATES, RESULTS, EXPANSIONS, GATE = 60, 30, 5, 8, 2, 1.35


def mode_of(name: str | None) -> str:
    mode = (name or "hybrid").strip().lower()
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode: {name}")
    return mode


def request(query: str, paper_id: int | None = None, min_score: float | None = None, limit: int | None = None) -> tuple:
    """One row of `queries`, checked."""
    if query is None or not query.strip():
        raise ValueError("the query is blank")
    return query.strip(), paper_id, min(max(V.THRESHOLD if min_score is None else min_score, V.LEAST), V.MOST), max(1, limit or RESULTS)


def channel(scored: DataFrame, name: str, limit: int = CANDIDATES) -> DataFrame:
    """Ranks rows (qid, id, semantic_score, lexical_score) within each query and keeps the best."""
    seq, weight, kind = CHANNELS[name]
    order = W.partitionBy("qid").orderBy(F.coalesce("semantic_score", "lexical_score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(limit, LEAST_CANDIDATES)).select(
        "qid", F.lit(name).alias("channel"), F.lit(seq).alias("channel_seq"), F.lit(weight).alias("weight"), "rank",
        F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("evidence_key"), F.lit(kind).alias("evidence_type"), F.col("semantic_score").cast("double").alias("semantic_score"), F.col("lexical_score").cast("double").alias("lexical_score"),
    )


def vector_scores(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, scope_col: str | None = None) -> DataFrame:
    """Rows at or above each query's threshold. queries: qid, vector, min_score, and paper_id (null: no scope)."""
    some = rows.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("__v"), *([F.col(scope_col).alias("__scope")] if scope_col else []))
    pairs = some.join(F.broadcast(small(queries)), F.col("paper_id").isNull() | (F.col("paper_id") == F.col("__scope")) if scope_col else F.lit(True))
    scored = pairs.select("qid", "id", "min_score", V.cosine(F.col("__v"), F.col("vector")).alias("semantic_score"))
    return scored.filter(F.col("semantic_score") >= F.col("min_score")).select("qid", "id", "semantic_score", F.lit(None).cast("double").alias("lexical_score"))


#: A request set of at most so many rows is sent to every task; larger sets go through block search.
REQUESTS = 1000


def small(queries: DataFrame) -> DataFrame:
    """queries, checked against the bound under which they are broadcast."""
    if len(queries.limit(REQUESTS + 1).select(F.lit(1)).collect()) > REQUESTS:
        raise ValueError(f"more than {REQUESTS} requests at once: split the set, or use knn.nearest()")
    return queries


def exact_scores(rows: DataFrame, queries: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """Case-insensitive equality of the query with any of the columns: an equi-join, each hit with score 1."""
    keys = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.array(*[F.lower(T.jtrim(c)) for c in text_cols]))).alias("__k"))
    return keys.join(queries.select("qid", F.lower(T.jtrim("query")).alias("__k")), "__k").select("qid", "id", F.lit(None).cast("double").alias("semantic_score"), F.lit(1.0).alias("lexical_score")).distinct()


def fuse(candidates: DataFrame, limit: int | None = RESULTS) -> DataFrame:
    """Weighted reciprocal-rank fusion by evidence key.

    Contributions are added in channel order, so sums do not depend on the plan. A key that a channel lists twice counts
    twice; blank keys are skipped. Scores are maxima with null as zero.
    """
    part = candidates.filter(~T.blank("evidence_key")).withColumn("gain", F.col("weight") / (RRF_K + F.col("rank")))
    first = F.min(F.struct("channel_seq", "rank")).alias("first")
    fused = part.groupBy("qid", "evidence_key").agg(
        F.array_sort(F.collect_list(F.struct("channel_seq", "rank", "gain"))).alias("gains"), F.array_sort(F.collect_set("channel")).alias("channels"), F.min("evidence_type").alias("evidence_type"),
        F.max(F.coalesce("semantic_score", F.lit(0.0))).alias("semantic_score"), F.max(F.coalesce("lexical_score", F.lit(0.0))).alias("lexical_score"), first,
    )
    fused = fused.withColumn("fusion_score", F.aggregate("gains", F.lit(0.0), lambda s, g: s + g["gain"])).drop("gains")
    order = W.partitionBy("qid").orderBy(F.col("fusion_score").desc(), F.greatest("semantic_score", "lexical_score").desc(), "first", "evidence_key")
    ranked = fused.withColumn("position", F.row_number().over(order)).drop("first")
    return ranked.filter(F.col("position") <= max(1, limit)) if limit else ranked


def in_mode(candidates: DataFrame, mode: str) -> DataFrame:
    return candidates.filter(F.col("channel_seq").isin(*MODES[mode_of(mode)]))


def keep_first(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def expansions(evidence: DataFrame, limit: int = EXPANSIONS) -> DataFrame:
    """qid, section_key, n: the matched sections that are read whole.

    One when the first's score is GATE times the second's or more, else up to the limit.
    """
    sections = evidence.filter((F.col("evidence_type") == "SECTION") & ~T.blank("evidence_key"))
    order = W.partitionBy("qid").orderBy("position")
    some = sections.groupBy("qid", "evidence_key").agg(F.min("position").alias("position"), F.max("fusion_score").alias("score"))
    some = some.select("*", F.row_number().over(order).alias("n"), F.lead("score").over(order).alias("next"))
    firsts = F.max(F.when(F.col("n") == 1, F.struct("score", "next"))).over(W.partitionBy("qid"))
    a, b = F.col("firsts.score"), F.col("firsts.next")
    one = b.isNotNull() & (a > 0) & ((b <= 0) | (a / b >= GATE))
    return some.withColumn("firsts", firsts).filter(F.col("n") <= F.when(one, 1).otherwise(limit)).select("qid", F.col("evidence_key").alias("section_key"), "n")
