"""Retrieval quality: first relevant rank, Recall@k, MRR, nDCG, nearest-rank percentiles."""

from __future__ import annotations

import fractions
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T


def first_rank(results: DataFrame, cases: DataFrame, heading: str = "heading", path: str = "heading_path") -> DataFrame:
    """qid, first_rank (0: none): the first result whose heading or path holds the expected heading."""
    bare = lambda c: F.lower(T.collapse(c))
    joined = cases.join(results, "qid", "left")
    hit = bare(heading).contains(bare("expected")) | bare(path).contains(bare("expected"))
    return joined.groupBy("qid").agg(F.coalesce(F.min(F.when(hit, F.col("position"))), F.lit(0)).alias("first_rank"))


def metrics(ranks: DataFrame, rank: str = "first_rank") -> DataFrame:
    r = F.col(rank)
    within = lambda k: r.between(1, k)
    return ranks.agg(
        F.round(F.avg(F.when(within(5), 1.0).otherwise(0.0)), 6).alias("recall_5"), F.round(F.avg(F.when(within(10), 1.0).otherwise(0.0)), 6).alias("recall_10"),
        F.round(F.avg(F.when(within(10), 1.0 / F.greatest(r, F.lit(1))).otherwise(0.0)), 6).alias("mrr_10"), F.round(F.avg(F.when(within(10), 1.0 / F.log2(r + F.lit(1.0))).otherwise(0.0)), 6).alias("ndcg_10"),
    )


#: Cuts of a round, and rows that are few enough to be ordered on the driver.
CUTS, FEW = 100, 10_000


def nearest_rank(rows: DataFrame, value: str, share: float):
    """The smallest value that at least this share of the values do not exceed; null without values. Nulls are no values.

    Round by round, cuts from a sketch of bounded size split the values that are left, each part is counted exactly, and the part that holds the rank is
    left: a hundredth of the rows about, so 10**12 rows take five rounds. No buffer grows with the distinct values.
    """
    left = rows.select(F.col(value).alias("v")).filter("v is not null")
    n = left.count()
    rank = max(1, math.ceil(fractions.Fraction(str(share)) * n))
    while n > FEW:
        cuts = sorted(set(left.agg(F.percentile_approx("v", [k / CUTS for k in range(CUTS + 1)], 10 * CUTS)).first()[0]))
        told = F.array(*map(F.lit, cuts))
        # 2k: between two cuts; 2k + 1: equal to one
        part = 2 * F.size(F.filter(told, lambda c: c < F.col("v"))) + F.array_contains(told, F.col("v")).cast("int")
        counts = sorted(tuple(r) for r in left.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
        for k, n in counts:  # noqa: B007
            if rank <= n:
                break
            rank -= n
        if k % 2:
            return cuts[k // 2]
        if k > 0:
            left = left.filter(F.col("v") > F.lit(cuts[k // 2 - 1]))
        if k // 2 < len(cuts):
            left = left.filter(F.col("v") < F.lit(cuts[k // 2]))
    for v, m in left.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect():
        if rank <= m:
            return v
        rank -= m
    return None


def percentiles(rows: DataFrame, value: str, shares: dict[str, float] | None = None) -> DataFrame:
    """One row with the nearest-rank percentiles of a column."""
    shares = shares or {"p50": 0.5, "p95": 0.95}
    kind = rows.schema[value].dataType.simpleString()
    return rows.sparkSession.createDataFrame([tuple(nearest_rank(rows, value, s) for s in shares.values())], ", ".join(f"{name} {kind}" for name in shares))
