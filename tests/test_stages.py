"""Stage tables: what a retry, a changed paper and a rerun compute."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import references, stages
from marginalia.operators.stages import Stage
from marginalia.sources.store import Change, Store


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, f"file://{tmp_path}/store", rows_a_file=20)
    rows = [(p, s, f"section {s} of paper {p} cites [{p % 4 + 1}] and [{s + 1}-{s + 2}]") for p in range(60) for s in range(2)]
    out.change(Change("sections", spark.createDataFrame(rows, "paper_id long, idx long, content string"), "paper_id"))
    return out


def graph(seen, broken=()):
    """SYMBOLS and CITATIONS read sections, SUMMARY reads both; seen gets (stage, papers) as they are computed."""

    def work(name, read, f):
        def go(tables):
            seen.append((name, sorted(r.paper_id for r in tables[read].select("paper_id").distinct().collect())))
            if name in broken:
                raise RuntimeError("broken")
            return f(tables)

        return go

    symbols = lambda t: t["sections"].select("paper_id", F.substring("content", 1, 9).alias("symbol"))
    links = lambda t: references.citation_links(t["sections"], "paper_id", "idx", "content").withColumnRenamed("doc", "paper_id")
    counts = lambda t: t["citations"].groupBy("paper_id").agg(F.count("*").alias("links")).join(t["symbols"].groupBy("paper_id").agg(F.count("*").alias("symbols")), "paper_id")
    return [Stage("SYMBOLS", ("sections",), work("SYMBOLS", "sections", symbols)), Stage("CITATIONS", ("sections",), work("CITATIONS", "sections", links)), Stage("SUMMARY", ("symbols", "citations"), work("SUMMARY", "symbols", counts))]


def test_a_retry_begins_at_the_stage_that_failed(store):
    seen = []
    with pytest.raises(RuntimeError, match="broken"):
        stages.run(store, graph(seen, {"CITATIONS"}))
    assert [(n, len(p)) for n, p in seen] == [("SYMBOLS", 60), ("CITATIONS", 60)]
    assert {r.status for r in store.read("runs_citations").collect()} == {"FAILED"} and store.read("symbols").count() == 120
    seen.clear()
    assert stages.run(store, graph(seen)) == {"SYMBOLS": 0, "CITATIONS": 60, "SUMMARY": 60}
    assert [n for n, _ in seen] == ["CITATIONS", "SUMMARY"]
    assert {r.status for r in store.read("runs_citations").collect()} == {"COMPLETED"} and store.read("summary").count() == 60
    seen.clear()
    assert stages.run(store, graph(seen)) == {"SYMBOLS": 0, "CITATIONS": 0, "SUMMARY": 0} and seen == []


def test_a_changed_paper_is_computed_alone(spark, store):
    seen = []
    stages.run(store, graph(seen))
    seen.clear()
    # paper 7 changes, paper 8 is written again as it was, paper 9 goes, paper 100 comes
    same = store.read("sections").filter("paper_id = 8")
    rows = spark.createDataFrame([(7, 0, "now it cites [9]"), (100, 0, "a new one")], "paper_id long, idx long, content string").unionByName(same)
    store.change(Change("sections", rows, "paper_id", spark.createDataFrame([(9,)], "paper_id long")))
    assert stages.run(store, graph(seen)) == {"SYMBOLS": 3, "CITATIONS": 3, "SUMMARY": 3}
    assert seen[0] == ("SYMBOLS", [7, 100]) and seen[1] == ("CITATIONS", [7, 100]) and seen[2][1] == [7, 100]
    assert [r.ref_index for r in store.read("citations").filter("paper_id = 7").collect()] == ["9"]
    for name in ("symbols", "citations", "runs_symbols", "runs_summary"):
        assert store.read(name).filter("paper_id = 9").count() == 0
    assert store.read("symbols").filter("paper_id = 100").count() == 1 and store.read("symbols").filter("paper_id = 8").count() == 2
    # a table may change where the next stage's input does not: symbols of paper 10 stay, its citations do not
    store.change(Change("sections", spark.createDataFrame([(10, 0, "section 0 of paper 10 cites [5]"), (10, 1, "section 1 now")], "paper_id long, idx long, content string"), "paper_id"))
    assert stages.run(store, graph([])) == {"SYMBOLS": 1, "CITATIONS": 1, "SUMMARY": 1}


def test_rerun_and_new_version(spark, store):
    stages.run(store, graph([]))
    papers = spark.createDataFrame([(3,), (4,)], "paper_id long")
    assert stages.run(store, graph([]), force=("CITATIONS", papers)) == {"SYMBOLS": 0, "CITATIONS": 2, "SUMMARY": 0}  # the same rows again: nothing below is stale
    first, *rest = graph([])
    assert stages.run(store, [Stage(first.name, first.reads, first.work, "2"), *rest]) == {"SYMBOLS": 60, "CITATIONS": 0, "SUMMARY": 0}


def test_stale_says_why(spark):
    told = [Stage("A", ("source",), None), Stage("B", ("a",), None), Stage("C", ("source",), None)]
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    prints = {"source": frame([(k, f"p{k}") for k in range(5)], "paper_id long, print string"), "a": frame([(k, f"a{k}") for k in range(5)], "paper_id long, print string")}
    was = {r.paper_id: r.input_print for r in stages.input_print({"source": prints["source"]}, "1").collect()}
    of_a = {r.paper_id: r.input_print for r in stages.input_print({"a": prints["a"]}, "1").collect()}
    ledger = "paper_id long, input_print string, status string"
    ledgers = {
        "A": frame([(0, was[0], "COMPLETED"), (1, "old", "COMPLETED"), (2, was[2], "FAILED"), (4, was[4], "COMPLETED")], ledger),
        "B": frame([(k, of_a[k], "COMPLETED") for k in range(4)], ledger), "C": frame([(k, was[k], "COMPLETED") for k in range(5)], ledger),
    }
    got = {(r.paper_id, r.stage): r.reason for r in stages.stale(told, prints, ledgers).collect()}
    assert got == {(1, "A"): "CHANGED", (2, "A"): "FAILED", (3, "A"): "NEW", (1, "B"): "UPSTREAM", (2, "B"): "UPSTREAM", (3, "B"): "UPSTREAM", (4, "B"): "NEW"}
