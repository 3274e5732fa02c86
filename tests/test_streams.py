"""Leases and sessions by timers, and the event sink that takes a batch once."""

import json
import time

import pytest
from pyspark.sql import functions as F

from marginalia.streaming import jobs, sink

REQUESTS = "job string, worker string, action string"
EVENTS = "session_id string, step bigint, type string, content string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))


def wait(query, done, seconds=90):
    until = time.time() + seconds
    while not done() and time.time() < until:
        assert query.exception() is None, query.exception()
        time.sleep(0.3)
    assert done()


def test_a_dead_workers_lease_expires_and_a_rival_gets_it(rocks, tmp_path):
    spark, folder = rocks, tmp_path / "in"
    feed(spark, folder, [("j", "a", "acquire"), ("j", "b", "acquire"), ("k", "a", "acquire"), ("k", "a", "release"), ("k", "b", "acquire"), ("k", "a", "renew")], REQUESTS)
    stream = jobs.leases(spark.readStream.schema(REQUESTS).json(str(folder)), lease_ms=6000)
    query = stream.writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    told = lambda: [tuple(r) for r in spark.table("leases").collect()]
    try:
        wait(query, lambda: len(told()) >= 6)
        assert [r[1:] for r in told()[:6] if r[0] == "j"] == [("a", "acquire", True), ("b", "acquire", False)]
        assert [r[1:] for r in told()[:6] if r[0] == "k"] == [("a", "acquire", True), ("a", "release", True), ("b", "acquire", True), ("a", "renew", False)]
        wait(query, lambda: ("j", "a", "expire", True) in told() and ("k", "b", "expire", True) in told())
        feed(spark, folder, [("j", "b", "acquire")], REQUESTS)
        wait(query, lambda: ("j", "b", "acquire", True) in told())
        assert told().count(("j", "a", "expire", True)) == 1
    finally:
        query.stop()


def test_a_session_ends_after_its_limit(rocks, tmp_path):
    spark, folder = rocks, tmp_path / "in"
    feed(spark, folder, [("s", 2, "ACTION", "b"), ("s", 1, "THOUGHT", "a"), ("s", 1, "THOUGHT", "again"), ("t", 1, "FINAL", "end"), ("t", 2, "ACTION", "late")], EVENTS)
    stream = jobs.sessions(spark.readStream.schema(EVENTS).json(str(folder)), limit_ms=6000)
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    told = lambda: [tuple(r) for r in spark.table("sessions").collect()]
    try:
        wait(query, lambda: ("s", 3, "TIMEOUT", None) in told())
        feed(spark, folder, [("s", 4, "ACTION", "after the end"), ("u", 1, "THOUGHT", "new")], EVENTS)
        wait(query, lambda: ("u", 1, "THOUGHT", "new") in told())
        assert [r for r in told() if r[0] == "s"][:2] == [("s", 1, "THOUGHT", "a"), ("s", 2, "ACTION", "b")] or [r[3] for r in told() if r[:2] == ("s", 1)] == ["again"]
        assert sorted(r[1] for r in told() if r[0] == "s") == [1, 2, 3]
        assert [r for r in told() if r[0] == "t"] == [("t", 1, "FINAL", "end")]
    finally:
        query.stop()


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    feed(spark, folder, [("s", 2, "x", "zwei"), ("s", 1, "x", "eins"), ("t", 1, "y", None)], EVENTS)
    stream = lambda: spark.readStream.schema(EVENTS).json(str(folder))
    sink.write_events(stream(), str(out), str(tmp_path / "cp"), once=True).awaitTermination(60)
    rows = lambda: sorted(map(tuple, sink.read_events(spark, str(out), EVENTS).collect()))
    first = rows()
    assert first == [("s", 1, "x", "eins"), ("s", 2, "x", "zwei"), ("t", 1, "y", None)]
    # the driver died after the batch's commit and before Spark noted it: the same batch comes again
    for note in (tmp_path / "cp" / "commits").iterdir():
        note.unlink()
    sink.write_events(stream(), str(out), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert rows() == first
    listed = {n for p in (out / "batches").glob("*.json") for n in json.loads(p.read_text())}
    assert {p.name for p in (out / "parts").iterdir()} == listed
    feed(spark, folder, [("s", 3, "x", "drei")], EVENTS)
    sink.write_events(stream(), str(out), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert len(rows()) == 4
    # a batch that fails leaves nothing
    bad = stream().withColumn("content", F.raise_error(F.lit("broken")).cast("string"))
    feed(spark, folder, [("s", 4, "x", "vier")], EVENTS)
    query = sink.write_events(bad, str(out), str(tmp_path / "cp"), once=True)
    with pytest.raises(Exception, match="broken"):
        query.awaitTermination(60)
    assert len(rows()) == 4 and len(list((out / "parts").iterdir())) == len({n for p in (out / "batches").glob("*.json") for n in json.loads(p.read_text())})
    assert sink.read_events(spark, str(tmp_path / "none"), EVENTS).collect() == []
