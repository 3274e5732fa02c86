"""The ingest state machine as tables: stages, legal transitions, jobs, leases, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statuses that may follow one another, and stages in order.
LEGAL = {"UPLOADED": ("PARSING", "FAILED"), "PARSING": ("PARSED", "FAILED"), "PARSED": ("AUDITING", "FAILED"), "AUDITING": ("READY", "FAILED"), "READY": ("UPLOADED", "PARSED"), "FAILED": ("UPLOADED", "PARSED")}
STAGES = ("UPLOAD", "PARSE", "NORMALIZE", "METADATA", "PERSIST", "SYMBOLS", "CITATIONS", "EMBEDDING", "AUDIT", "FINALIZE")
CORE, RERUN_FROM = 5, 2
LEASE_MINUTES, STALE_MINUTES, LEAST_MINUTES, MEMORY, SCOPE = 120, 130, 10, 20, 20


def is_legal(before: str | None, after: str | None) -> bool:
    return before is not None and after is not None and (before == after or after in LEGAL.get(before, ()))


def legal(before: Column, after: Column) -> Column:
    pairs = [f"{a}>{b}" for a, more in LEGAL.items() for b in (a, *more)]
    return F.coalesce(F.concat_ws(">", before, after).isin(*pairs) & before.isNotNull() & after.isNotNull(), F.lit(False))


def stage_table(spark: SparkSession) -> DataFrame:
    status = lambda k: "UPLOADED" if k == 0 else "PARSING" if k < CORE else "AUDITING"
    return spark.createDataFrame([(k, s, k < CORE, status(k), k >= RERUN_FROM) for k, s in enumerate(STAGES)], "stage_no int, stage string, core boolean, status string, rerun boolean")


def transitions(events: DataFrame, job: str, at: str, tie: str, status: str) -> DataFrame:
    """job, tie, before, after, legal: each status change of a job."""
    w = W.partitionBy(job).orderBy(at, tie)
    return events.select(job, tie, F.lag(status).over(w).alias("before"), F.col(status).alias("after")).filter("before is not null").withColumn("legal", legal(F.col("before"), F.col("after")))


def latest(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in runs.columns if c not in keys]
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def earliest_by_hash(jobs: DataFrame, hash_col: str, *order: str) -> DataFrame:
    """Insert or return what is there: the first job of each content hash."""
    rest = [c for c in jobs.columns if c != hash_col]
    return jobs.groupBy(hash_col).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(hash_col, "r.*")


def lease_until(now: Column, minutes: int = LEASE_MINUTES) -> Column:
    return now + F.make_interval(mins=F.lit(max(minutes, LEAST_MINUTES)))


def recoverable(jobs: DataFrame, now: Column, limit: int = 10, minutes: int = STALE_MINUTES) -> DataFrame:
    """Interrupted jobs whose lease is gone or whose last change is stale, oldest first."""
    stale = F.col("updated_at") < now - F.make_interval(mins=F.lit(max(minutes, LEAST_MINUTES)))
    return jobs.filter(~F.col("status").isin("READY", "FAILED") & (F.col("lease_until").isNull() | (F.col("lease_until") < now)) & stale).orderBy("updated_at", "id").limit(limit)


def memory_window(messages: DataFrame, session: str, turn: str, n: int = MEMORY) -> DataFrame:
    w = W.partitionBy(session).orderBy(F.col(turn).desc())
    return messages.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def scope_ids(ids: DataFrame, id_col: str, order: str, n: int = SCOPE) -> DataFrame:
    """The first n distinct positive ids."""
    return ids.filter(F.col(id_col) > 0).groupBy(id_col).agg(F.min(order).alias("__o")).orderBy("__o", id_col).limit(n).select(id_col)
