"""Stage tables that know their inputs: a run computes the stages that are stale, for the papers that are stale, and no other.

Every stage reads tables of a store and writes one, all kept by paper. Beside it stands its ledger, `runs_<stage>`: for each paper the fingerprint of what the
stage last read of it, and whether that went well. A stage's rows and its ledger change in one version, so neither is ever ahead of the other. The
version that a stage last read to the end is a mark of the store: only papers in files that are new since then are looked at, and of
these only those whose fingerprint changed are computed. A stage that fails leaves FAILED for the papers it was at, and the run ends; the next
run finds the stages before it fresh and begins there.

Defined results: a paper that left all inputs of a stage leaves its table and ledger; a paper without rows from a stage is COMPLETED with none; a fingerprint
does not depend on the order of rows and counts repeated ones; a stage of another version is stale for all papers.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.sources.store import Change, Store

KEY = "paper_id"
DONE, FAILED = "COMPLETED", "FAILED"


@dataclass(frozen=True)
class Stage:
    """work: from the tables it reads, restricted to some papers, the rows of its table for these, with KEY."""

    name: str
    reads: tuple[str, ...]
    work: Callable[[dict[str, DataFrame]], DataFrame]
    version: str = "1"

    @property
    def table(self) -> str:
        return self.name.lower()

    @property
    def ledger(self) -> str:
        return f"runs_{self.table}"


def fingerprints(rows: DataFrame, key: str = KEY) -> DataFrame:
    """key, print: of all rows of each key, whatever their order. Partial sums, so a key with very many rows is no load."""
    names = [c for c in rows.columns if c != key]
    told = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])) if names else F.lit("")
    one = rows.select(key, F.xxhash64(told).alias("a"), F.xxhash64(F.lit(1), told).alias("b"))
    sums = one.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").cast("decimal(20,0)")).alias("s"), F.bit_xor("b").alias("x"))
    return sums.select(key, F.md5(F.concat_ws("|", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")).cast("binary")).alias("print"))


def input_print(prints: dict[str, DataFrame], version: str, key: str = KEY) -> DataFrame:
    """key, input_print: the fingerprints (key, print) of a stage's inputs as one."""
    each = [df.select(key, F.struct(F.lit(name).alias("name"), "print").alias("p")) for name, df in sorted(prints.items())]
    # a row an input, so the list of a key is as long as the stage's inputs
    together = reduce(lambda a, b: a.unionByName(b), each).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return together.select(key, F.md5(F.concat(F.lit(f"{version}|"), F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["name"], x["print"])), "|")).cast("binary")).alias("input_print"))


def stale(stages: Sequence[Stage], prints: dict[str, DataFrame], ledgers: dict[str, DataFrame], key: str = KEY) -> DataFrame:
    """key, stage, reason: what a run would compute, and why: NEW, CHANGED, FAILED or UPSTREAM.

    prints: (key, print) of each table that stages read, as they are; ledgers: (key, input_print, status) by stage. A stage whose own inputs are as they
    were is stale by UPSTREAM where a stage that it reads from is stale.
    """
    found: dict[str, DataFrame] = {}
    for s in stages:
        now = input_print({n: prints[n] for n in s.reads if n in prints}, s.version, key)
        both = now.join(ledgers[s.name].select(key, F.col("input_print").alias("was"), "status"), key, "left")
        own = F.when(F.col("was").isNull(), "NEW").when(F.col("status") != DONE, FAILED).when(F.col("was") != F.col("input_print"), "CHANGED")
        told = both.select(key, own.alias("own"))
        above = [found[t.name].select(key) for t in stages if t.table in s.reads and t.name in found]
        if above:
            upstream = reduce(lambda a, b: a.unionByName(b), above).distinct().withColumn("up", F.lit(True))
            told = told.join(upstream, key, "full").select(key, F.coalesce("own", F.when(F.col("up"), "UPSTREAM")).alias("own"))
        found[s.name] = told.filter("own is not null").select(key, F.lit(s.name).alias("stage"), F.col("own").alias("reason"))
    return reduce(lambda a, b: a.unionByName(b), found.values())


def changed_papers(store: Store, name: str, since: int, until: dict, key: str = KEY) -> DataFrame | None:
    """Papers that may differ in a table between two versions: those in files that only one of them lists. Null where no file differs."""
    now = until["tables"][name]["files"]
    before = store.version(since)["tables"].get(name, {"files": []})["files"] if since in (0, *store.versions()) else []
    old, new = {f["file"] for f in before}, {f["file"] for f in now}
    parts = [(until, [f for f in now if f["file"] not in old])]
    if gone := [f for f in before if f["file"] not in new]:
        parts.append((store.version(since), gone))
    read = [store._files(v["tables"][name], files).select(key) for v, files in parts if files]
    return reduce(lambda a, b: a.unionByName(b), read).distinct() if read else None


def _todo(store: Store, stage: Stage, base: dict, force: DataFrame | None) -> DataFrame | None:
    """paper, input_print (null where the paper is gone) of what the stage has to compute; null if its inputs are the files that it read last."""
    mark = base["marks"].get(f"read:{stage.name}", {})
    since = mark.get("store", 0) if mark.get("version") == stage.version else 0
    parts = [p for n in stage.reads if (p := changed_papers(store, n, since, base)) is not None]
    if force is not None:
        parts.append(force.select(KEY))
    if not parts:
        return None
    papers = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    now = input_print({n: fingerprints(store.read_keys(n, papers, base["version"])) for n in stage.reads}, stage.version)
    told = papers.join(now, KEY, "left")
    if stage.ledger not in base["tables"]:
        return told.filter("input_print is not null")
    last = store.read_keys(stage.ledger, papers, base["version"]).select(KEY, F.col("input_print").alias("was"), "status")
    both = told.join(last, KEY, "left")
    same = (F.col("input_print") == F.col("was")) & (F.col("status") == DONE) | F.col("input_print").isNull() & F.col("was").isNull()
    wanted = ~F.coalesce(same, F.lit(False))
    if force is not None:
        forced = force.select(KEY).distinct().withColumn("forced", F.lit(True))
        both = both.join(forced, KEY, "left")
        wanted = wanted | F.coalesce("forced", F.lit(False))
    return both.filter(wanted).select(KEY, "input_print")


def run(store: Store, stages: Sequence[Stage], force: tuple[str, DataFrame] | None = None, log: Callable[[str, str, int], None] = lambda *_: None) -> dict[str, int]:
    """Runs stages in order; the number of papers computed by stage. force: a stage to begin with whatever its ledger says, and the papers to rerun.

    log gets (stage, RUNNING, COMPLETED, FAILED or FRESH, papers). A failure is kept in the ledger and raised.
    """
    done: dict[str, int] = {}
    for stage in stages:
        base = store.version()
        todo = _todo(store, stage, base, force[1] if force and force[0] == stage.name else None)
        mark = {f"read:{stage.name}": {"store": base["version"], "version": stage.version}}
        # computed once: what is read for these papers, and what the ledger says of them, is the same list
        todo = None if todo is None else todo.transform(lambda df: _aside(store, df, stage.name))
        n = todo.count() if todo is not None else 0
        done[stage.name] = n
        if not n:
            log(stage.name, "FRESH", 0)
            if base["marks"].get(f"read:{stage.name}") != mark[f"read:{stage.name}"] and todo is not None:
                store.change(base=base, marks=mark)
            continue
        log(stage.name, "RUNNING", n)
        ledger = todo.filter("input_print is not null").select(KEY, "input_print")
        told = lambda status: Change(stage.ledger, ledger.select("*", F.lit(status).alias("status"), F.lit(int(time.time())).alias("at")), KEY, todo.select(KEY))  # noqa: B023, E731
        try:
            rows = stage.work({r: store.read_keys(r, todo.select(KEY), base["version"]) for r in stage.reads})
            store.change(Change(stage.table, rows, KEY, todo.select(KEY)), told(DONE), base=base, marks=mark)
        except Exception:
            store.change(told(FAILED), base=base)
            log(stage.name, FAILED, n)
            raise
        log(stage.name, DONE, n)
    return done


def _aside(store: Store, df: DataFrame, tag: str) -> DataFrame:
    """df as a table beside the store's files; vacuum removes it."""
    path = f"{store.path}/data/todo-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return store.spark.read.schema(df.schema).parquet(path)

