"""The versioned store: what a change rewrites, who may commit, what readers see."""

import pytest
from pyspark.sql import functions as F

from marginalia.sources import writers
from marginalia.sources.store import Change, Conflict, Spans, Store


def files(store, name, number=None):
    return {f["file"]: (f["least"], f["most"]) for f in store.version(number)["tables"][name]["files"]}


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, f"file://{tmp_path}/store", rows_a_file=400)
    # 400 papers of 5 chunks, and one paper with a third of all rows
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, F.col("id") % 400).otherwise(250).alias("paper_id"), F.col("id").alias("chunk"), F.lit(0).alias("turn"))
    out.change(Change("chunks", rows.repartition(3), "paper_id"))
    return out


def test_a_change_rewrites_only_the_files_that_hold_its_keys(spark, store):
    before = files(store, "chunks")
    assert len(before) >= 4
    new = spark.createDataFrame([(k, 10_000 + k, 1) for k in range(4)], "paper_id long, chunk long, turn int")  # 1 % of the papers
    assert store.change(Change("chunks", new, "paper_id")) == 2
    after = files(store, "chunks")
    touched = {f for f, (least, most) in before.items() if least <= 3 and most >= 0}
    assert set(before) - set(after) == touched and len(touched) < len(before) / 2
    now = store.read("chunks")
    assert now.filter("paper_id < 4").count() == 4 and now.filter("turn = 1").count() == 4
    assert now.filter("paper_id >= 4").count() == 3000 - 20
    # the version before still reads
    assert store.read("chunks", 1).count() == 3000 and store.read("chunks", 1).agg(F.max("turn")).first()[0] == 0


def test_spans_hardly_overlap(spark, store):
    for k in range(4):
        new = spark.createDataFrame([(p, p, k + 1) for p in (7 * k, 250, 399, 1000 + k, -k - 1)], "paper_id long, chunk long, turn int")
        store.change(Change("chunks", new, "paper_id", spark.createDataFrame([(100 + k,)], "paper_id long")))
    told = store.version()["tables"]["chunks"]
    spans = Spans(told["files"])
    assert max(len(spans.holding(k)) for k in range(400) if k != 250) <= 3
    assert all(set(spans.holding(k)) == {i for i, f in enumerate(spans.files) if f["least"] <= k <= f["most"]} for k in range(-9, 1010, 3))
    got = {r.paper_id: (r.n, r.t) for r in store.read("chunks").groupBy("paper_id").agg(F.count("*").alias("n"), F.max("turn").alias("t")).collect()}
    assert got[250] == (1, 4) and got[399] == (1, 4) and got[1003] == (1, 4) and got[-1] == (1, 1) and got[14] == (1, 3) and 101 not in got and got[300] == (5, 0)
    assert sum(f["rows"] for f in told["files"]) == sum(n for n, _ in got.values())
    keys = spark.createDataFrame([(250,), (1003,), (77_777,)], "paper_id long")
    assert sorted(r.paper_id for r in store.read_keys("chunks", keys).collect()) == [250, 1003]


def test_two_writers_cannot_both_commit(spark, store):
    base = store.version()
    row = lambda t: spark.createDataFrame([(5, 1, t)], "paper_id long, chunk long, turn int")
    assert store.change(Change("chunks", row(8), "paper_id"), base=base) == 2
    with pytest.raises(Conflict):
        Store(spark, store.path).change(Change("chunks", row(9), "paper_id"), base=base)
    assert [r.turn for r in store.read("chunks").filter("paper_id = 5").collect()] == [8]
    assert store.versions() == [1, 2]


def test_a_writer_that_dies_leaves_the_store_as_it_was(spark, store, monkeypatch):
    def die(*_):
        raise KeyboardInterrupt

    row = spark.createDataFrame([(5, 1, 7)], "paper_id long, chunk long, turn int")
    monkeypatch.setattr(Store, "_publish", die)
    with pytest.raises(KeyboardInterrupt):
        store.change(Change("chunks", row, "paper_id"))
    monkeypatch.undo()
    assert store.read("chunks").count() == 3000 and store.versions() == [1]
    assert store.change(Change("chunks", row, "paper_id")) == 2
    left = len(list(store._walk(f"{store.path}/data")))
    assert store.vacuum(keep=1) > 0
    assert len([f for f in store._walk(f"{store.path}/data") if f.endswith(".parquet")]) == len(files(store, "chunks")) < left
    assert store.read("chunks").filter("turn = 7").count() == 1 and store.read("chunks").count() == 2996


def test_defined_results(spark, store):
    schema = "paper_id long, chunk long, turn int"
    none = spark.createDataFrame([], schema)
    assert store.change(Change("chunks", none, "paper_id")) == 1  # nothing changes, nothing is committed
    for t in (spark.createDataFrame([(None, 1, 1)], schema),):
        with pytest.raises(ValueError):
            store.change(Change("chunks", t, "paper_id"))
        with pytest.raises(ValueError):
            store.change(Change("other", t, "paper_id"))
    with pytest.raises(KeyError):
        store.read("none such")
    assert store.change(Change("empty", none, "paper_id")) == 2 and store.read("empty").collect() == [] and store.read("empty").columns == ["paper_id", "chunk", "turn"]
    assert store.change(Change("empty", spark.createDataFrame([(3, 1, 1)], schema), "paper_id"), marks={"batch": 4}) == 3
    assert store.version()["marks"] == {"batch": 4} and store.read("empty").count() == 1
    names = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("é", 4)], "name string, n int")
    store.change(Change("names", names, "name"))
    store.change(Change("names", spark.createDataFrame([("b", 9)], "name string, n int"), "name"))
    assert sorted((r.name, r.n) for r in store.read("names").collect()) == [("a", 2), ("b", 9), ("é", 4)]


def test_relations_and_cascade(spark, store):
    schema = "source long, target long, audit_version string, type string"
    writers.replace_relations(store, spark.createDataFrame([(1, 2, "v1", "USES"), (1, 3, "v1", "USES"), (2, 3, "v1", "USES")], schema))
    writers.replace_relations(store, spark.createDataFrame([(1, 2, "v1", "EXTENDS"), (1, 2, "v2", "USES")], schema))
    assert sorted(map(tuple, store.read("relations").collect())) == [(1, 2, "v1", "EXTENDS"), (1, 2, "v2", "USES"), (1, 3, "v1", "USES"), (2, 3, "v1", "USES")]
    store.change(Change("symbols", spark.createDataFrame([(1, "x"), (2, "y")], "paper_id long, symbol string"), "paper_id"))
    before = store.version()["version"]
    papers = spark.createDataFrame([(1,)], "paper_id long")
    assert writers.reset_from(store, "EMBEDDING", papers) == before + 1  # chunks and relations, as one version
    assert store.read("chunks").filter("paper_id = 1").count() == 0 and store.read("chunks").filter("paper_id = 2").count() == 5
    assert [r.source for r in store.read("relations").collect()] == [2] and store.read("symbols").count() == 2
    assert store.read("chunks", before).filter("paper_id = 1").count() == 5
