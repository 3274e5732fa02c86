"""Relation audit: evidence that may be cited, status, storage, narrative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import vectors as V

REVIEW, NEIGHBOURS, SIMILARITY, PER_SIDE = 0.65, 3, 0.4, 4
#: Wording by type, from the source's side and from the target's.
WORDING = {"SUPPORTS": ("supports", "is supported by"), "CONTRADICTS": ("contradicts", "is contradicted by"), "EXTENDS": ("extends", "is extended by"), "USES": ("uses", "is used by"), "COMPARES": ("compares with", "is compared with")}


def cited(keys: DataFrame, evidence: DataFrame) -> DataFrame:
    """source, target, evidence_key, seq: keys that are really in the pair's evidence, each once, in their order."""
    told = keys.select("source", "target", F.posexplode("keys").alias("seq", "evidence_key"))
    known = told.join(evidence.select("source", "target", "evidence_key").distinct(), ["source", "target", "evidence_key"], "left_semi")
    return known.groupBy("source", "target", "evidence_key").agg(F.min("seq").alias("seq"))


def status(confidence: Column, n_supporting: Column, n_conflicting: Column, review: float = REVIEW) -> Column:
    good = (V.confidence(confidence) >= review) & (F.coalesce(n_supporting, F.lit(0)) + F.coalesce(n_conflicting, F.lit(0)) > 0)
    return F.when(good, "CONFIRMED").otherwise("PENDING_REVIEW")


def later_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    both = first.withColumn("__s", F.lit(0)).unionByName(second.withColumn("__s", F.lit(1)))
    return both.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.col("__s").desc()))).filter("__n = 1").drop("__s", "__n")


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*key), list(key), "left_anti").select(*old.columns).unionByName(new)


def both_ways(relations: DataFrame) -> DataFrame:
    """paper_id, other_id, direction and the rest, a row for each side."""
    rest = [c for c in relations.columns if c not in ("source", "target")]
    out = relations.select(F.col("source").alias("paper_id"), F.col("target").alias("other_id"), F.lit("OUTGOING").alias("direction"), *rest)
    return out.unionByName(relations.select(F.col("target").alias("paper_id"), F.col("source").alias("other_id"), F.lit("INCOMING").alias("direction"), *rest))


def bucket(status_col: Column, version: Column, current: str) -> Column:
    return F.when(version != current, "history").when(status_col == "CONFIRMED", "confirmed").otherwise("pending")


def phrase(kind: Column, direction: Column) -> Column:
    out = F.lit("is unrelated to")
    for k, (a, b) in WORDING.items():
        out = F.when((kind == k) & (direction == "OUTGOING"), a).when((kind == k) & (direction == "INCOMING"), b).otherwise(out)
    return out


def narrative(kind: Column, direction: Column, status_col: Column, other: Column, description: Column) -> Column:
    said = F.concat_ws(" ", F.lit("This paper"), phrase(kind, direction), other)
    return F.when(status_col == "PENDING_REVIEW", F.concat(F.lit("Needs review: "), said)).when(kind == "UNRELATED", said).otherwise(F.concat_ws(". ", said, description))


def fill_audit(relations: DataFrame, version: str = "legacy-v0") -> DataFrame:
    return relations.withColumn("audit_version", F.coalesce(F.nullif("audit_version", F.lit("")), F.lit(version))).withColumn("audit_status", F.coalesce("audit_status", F.lit("PENDING_REVIEW")))


def audit_query(title: Column, other_title: Column, abstract: Column) -> Column:
    return T.jtrim(F.concat_ws(" ", title, other_title, F.substring(abstract, 1, 800)))
