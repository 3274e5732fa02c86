"""Sinks. A replacement is a change of a versioned store, or a table at a new path; readers never see half of one."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.audit import upsert
from marginalia.sources.store import Change, Store

STAGE_TABLES = {"PERSIST": ("sections",), "SYMBOLS": ("symbols",), "CITATIONS": ("links", "references"), "EMBEDDING": ("chunks",), "AUDIT": ("relations",)}


def replace_chunks(store: Store, chunks: DataFrame, expected: DataFrame | None = None) -> int:
    """Replaces the chunks of the papers in `chunks`, if every one has its vector; the number of chunks. Papers of `expected` without chunks lose theirs.

    `chunks` is computed once, into the store, so a provider of vectors runs once. The files of other papers are not touched, and all papers change in one version.
    """
    spark, beside = chunks.sparkSession, f"{store.path}/data/incoming-{uuid.uuid4().hex}"
    base = store.version()
    try:
        chunks.write.parquet(beside)
        told = spark.read.schema(chunks.schema).parquet(beside)
        found = told.agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("vectors")).first()
        if found["n"] > found["vectors"]:
            raise ValueError("a chunk has no vector")
        store.change(Change("chunks", told, "paper_id", expected, settled=True), base=base)
        return found["n"]
    finally:
        store._fs.delete(store._path(beside), True)


def replace_relations(store: Store, relations: DataFrame) -> int:
    """Replaces the relations of (source, target, audit_version), all others of the same sources stay; the store's version."""
    base, key = store.version(), ["source", "target", "audit_version"]
    if "relations" not in base["tables"]:
        return store.change(Change("relations", relations, "source"), base=base)
    old = store.read_keys("relations", relations.select("source"), base["version"])
    return store.change(Change("relations", upsert(old, relations, *key), "source"), base=base)


def reset_from(store: Store, stage: str, papers: DataFrame, key: str = "paper_id") -> int:
    """Deletes what was derived for papers from `stage` on, in all tables as one version; the store's version."""
    base = store.version()
    gone = [t for t in downstream_of(stage) if t in base["tables"]]
    none = {t: store.read(t, base["version"]).limit(0) for t in gone}
    return store.change(*[Change(t, none[t], base["tables"][t]["key"], papers.select(F.col(key).alias(base["tables"][t]["key"]))) for t in gone], base=base)


def write_upsert(old: DataFrame, new: DataFrame, path: str, *key: str) -> None:
    upsert(old, new, *key).write.parquet(path)


def remove(old: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    return old.join(keys.select(*key), list(key), "left_anti")


def append_log(rows: DataFrame, path: str) -> None:
    """Stage runs, agent steps, events, evaluation records."""
    rows.write.mode("append").parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def decision_report(decisions: DataFrame) -> DataFrame:
    """doc, value: a line a decision, tab-separated, as the text writer takes it."""
    line = F.concat_ws("\t", F.col("ln").cast("string"), "kind", "action", F.col("level").cast("string"), F.format_number("confidence", 2), "reason", "line")
    return decisions.select("doc", "ln", line.alias("value"))


def metadata_json(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def report_lines(decisions: DataFrame, header: dict[str, str], warnings: list[str]) -> DataFrame:
    """value: a report whole, as the text writer takes it: key=value lines, warnings, then the decisions in order, in one file a document set."""
    spark = decisions.sparkSession
    top = [f"{k}={v}" for k, v in header.items()] + [f"WARNING {w}" for w in warnings]
    first = spark.createDataFrame([(0, k, x) for k, x in enumerate(top)], "part int, ln long, value string") if top else None
    rest = decision_report(decisions).select(F.lit(1).alias("part"), F.col("ln").cast("long").alias("ln"), "doc", "value")
    rows = rest if first is None else first.select("part", "ln", F.lit(None).cast(rest.schema["doc"].dataType).alias("doc"), "value").unionByName(rest)
    return rows.orderBy("part", "doc", "ln").select("value")


def put_memory(old: DataFrame, new: DataFrame, key: str = "session_id", content: str = "messages") -> DataFrame:
    """old with the memories of new in place; an empty memory is refused."""
    if new.filter(F.coalesce(F.size(content) == 0, F.lit(True))).limit(1).count():
        raise ValueError("a memory must not be empty")
    return upsert(old, new, key)


def write_report(rows: DataFrame, path: str) -> None:
    """CSV files with a header, each with a byte order mark at its start."""
    rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def fill_embeddings(rows: DataFrame, embed: Column, column: str = "embedding") -> DataFrame:
    return rows.withColumn(column, F.coalesce(F.col(column), embed))


def downstream_of(stage: str) -> list[str]:
    """The derived tables that a rerun from `stage` computes anew."""
    names = list(STAGE_TABLES)
    return [t for s in names[names.index(stage) :] for t in STAGE_TABLES[s]] if stage in names else [t for s in names for t in STAGE_TABLES[s]]
