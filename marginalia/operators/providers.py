"""Model calls as injected providers, and the relation audit that uses one.

A provider is a Python function; it is called in Arrow-batched tasks, and its error on one row gives that row's default, as a lost
answer must not end the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import audit, evidence

METRICS = ("faithfulness", "answer_relevancy", "context_recall", "context_precision")
THREADS, QUEUE = 4, 20
R = TypeVar("R")


def _called(rows: DataFrame, out: str, kind: str, call: Callable[[dict], object], default: object) -> DataFrame:
    """rows with a column `out` of call(row)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for row in pdf.to_dict("records"):
                try:
                    found.append(call(row))
                except Exception:
                    found.append(default)
            yield pdf.assign(**{out: pd.Series(found, index=pdf.index, dtype=object)})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != out] + [f"`{out}` {kind}"])
    return rows.drop(out).mapInPandas(run, schema)


def rewrite_query(rows: DataFrame, provider: Callable[[str, str], str] | None = None) -> DataFrame:
    """rows (question, history, ...) with `query`: the provider's wording, else the question itself."""
    if provider is None:
        return rows.withColumn("query", F.col("question"))
    asked = _called(rows, "query", "string", lambda r: provider(r["question"], r["history"]), None)
    return asked.withColumn("query", F.when(T.blank("query") | F.col("query").isNull(), F.col("question")).otherwise(F.col("query")))


def summarise_references(snippets: DataFrame, provider: Callable[[str, list[str]], str]) -> DataFrame:
    """doc, ref_index, summary from (doc, ref_index, seq, snippet): the snippets of one reference meet, in order."""
    grouped = snippets.groupBy("doc", "ref_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "snippet"))), lambda s: s["snippet"]).alias("snippets"))
    return _called(grouped, "summary", "string", lambda r: provider(r["ref_index"], list(r["snippets"])), None).drop("snippets")


def fuse_abstracts(rows: DataFrame, provider: Callable[[str, str], str]) -> DataFrame:
    """rows (known, found, ...) with `abstract`: of two texts the provider's, of one that one, of none null; where the provider fails, the known one."""
    both = _called(rows, "abstract", "string", lambda r: provider(r["known"], r["found"]) if (r["known"] or "").strip() and (r["found"] or "").strip() else None, None)
    given = lambda c: F.when(~F.coalesce(T.blank(c), F.lit(True)), F.col(c))
    return both.withColumn("abstract", F.coalesce("abstract", given("known"), given("found")))


def judge_answers(samples: DataFrame, judge: Callable[[str, dict], float]) -> DataFrame:
    """samples with a score from 0 to 1 for each of METRICS (null where the judge fails), by an injected judge(metric, sample)."""
    for metric in METRICS:
        samples = _called(samples, metric, "double", lambda r, m=metric: min(max(float(judge(m, r)), 0.0), 1.0), None)
    return samples


def judge_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("samples"), *[F.avg(m).alias(m) for m in METRICS])


def audit_relations(pairs: DataFrame, found: DataFrame, judge: Callable[[dict, list[dict]], dict], review: float = audit.REVIEW) -> DataFrame:
    """The relations that a judge finds for pairs (source, target, title, other_title, abstract, source_version, target_version).

    found: source, target, evidence_key, quote, score. PER_SIDE pieces of evidence a pair go to the judge, best first, with the
    query; it answers type, reason, confidence and the keys that support or conflict. Keys that were not in the evidence are struck out; a
    relation without any left, or below `review`, needs review. A judge that fails gives an UNRELATED relation of confidence 0.
    """
    best = W.partitionBy("source", "target").orderBy(F.col("score").desc_nulls_last(), "evidence_key")
    told = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= 2 * audit.PER_SIDE)
    told = told.groupBy("source", "target").agg(F.array_sort(F.collect_list(F.struct("n", "evidence_key", "quote"))).alias("evidence"))
    asked = pairs.join(told, ["source", "target"], "left").withColumn("query", audit.audit_query(F.col("title"), F.col("other_title"), F.col("abstract")))

    def call(row: dict) -> dict:
        pieces = [dict(e) if isinstance(e, dict) else e.asDict() for e in (row["evidence"] if row["evidence"] is not None else [])]
        answer = judge(row, pieces)
        keys = [e["evidence_key"] for e in pieces]
        cited = {side: [k for k in dict.fromkeys(answer.get(side) or ()) if k in keys] for side in ("supporting", "conflicting")}
        return {"type": answer.get("type"), "reason": answer.get("reason"), "confidence": float(answer.get("confidence") or 0.0), **cited}

    kind = "struct<type:string,reason:string,confidence:double,supporting:array<string>,conflicting:array<string>>"
    judged = _called(asked, "answer", kind, call, {"type": None, "reason": None, "confidence": 0.0, "supporting": [], "conflicting": []})
    version = evidence.joined_versions("source_version", "target_version")
    return judged.select(
        "source", "target", T.relation_type("answer.type").alias("type"), F.col("answer.reason").alias("reason"), F.least(F.greatest("answer.confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.col("answer.supporting").alias("supporting"), F.col("answer.conflicting").alias("conflicting"),
        audit.status(F.col("answer.confidence"), F.size("answer.supporting"), F.size("answer.conflicting"), review).alias("audit_status"), version.alias("audit_version"),
    )


def dispatch(jobs: list[Callable[[], R]], threads: int = THREADS, queue: int = QUEUE) -> list[R]:
    """Runs a bounded number of jobs on a few threads of the driver; more than threads and queue hold are refused."""
    if len(jobs) > threads + queue:
        raise RuntimeError(f"{len(jobs)} jobs are more than {threads} threads and a queue of {queue} take")
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]
