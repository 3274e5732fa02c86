import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.sources import readers, writers
from marginalia.sources.store import Store
from marginalia.streaming import jobs


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.pdf").write_bytes(b"")
    (r,) = readers.stored_files(spark, str(tmp_path)).collect()
    assert (r.name, r.file_size) == ("a.pdf", 4)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/doc.md", "hello")
        z.writestr("x/other.md", "there")
    rows = readers.zip_entries(spark, str(tmp_path / "a.zip")).withColumns({"doc": F.lit(1), "stem": F.lit("doc")})
    (r,) = readers.choose_markdown(rows, "doc", "entry", "stem").collect()
    assert bytes(r.content) == b"hello"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../evil.md", "x")
    with pytest.raises(Exception, match="outside"):
        readers.zip_entries(spark, str(tmp_path / "b.zip")).collect()
    with pytest.raises(ValueError):
        readers.parse_files(rows, "none such")


def test_evaluation_set(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"id":"a","type":"FACTUAL","question":"q","paperId":1,"expectedHeading":"h"}\n\n{"id":"","type":"x","question":"q","paperId":0,"expectedHeading":"h"}\n')
    assert [r.id for r in readers.evaluation_set(spark, str(tmp_path / "e.jsonl")).collect()] == ["a"]
    (tmp_path / "j.json").write_text('[{"question":"q","answer":"a","contexts":["' + "c" * 40000 + '"],"ground_truth":"g"}]')
    (r,) = readers.judge_samples(spark, str(tmp_path / "j.json")).collect()
    assert (r.user_input, r.response, len(r.retrieved_contexts[0]), r.reference) == ("q", "a", 30000, "g")


def test_replace_chunks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    make = lambda rows: spark.createDataFrame(rows, "paper_id long, chunk_index int, embedding array<float>")
    writers.replace_chunks(store, make([(1, 0, [1.0]), (1, 1, [1.0]), (2, 0, [2.0])]))
    writers.replace_chunks(store, make([(1, 0, [3.0])]), spark.createDataFrame([(2,)], "paper_id long"))
    assert [(r.paper_id, r.chunk_index) for r in store.read("chunks").collect()] == [(1, 0)]
    with pytest.raises(ValueError):
        writers.replace_chunks(store, make([(1, 0, None)]))
    assert writers.replace_chunks(store, make([]), spark.createDataFrame([(1,)], "paper_id long")) == 0
    assert store.read("chunks").collect() == []


def test_state_machine_stream(spark, tmp_path):
    rows = [("j", 1, "UPLOADED"), ("j", 2, "PARSING"), ("j", 3, "READY"), ("j", 4, "PARSED"), ("k", 1, "FAILED"), ("k", 2, "UPLOADED")]
    spark.createDataFrame(rows, "job string, seq long, status string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("job string, seq long, status string").json(str(tmp_path / "in"))
    q = jobs.state_machine(stream).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.job, r.seq, r.before, r.after, r.legal) for r in spark.table("told").collect())
    assert got == [("j", 1, None, "UPLOADED", True), ("j", 2, "UPLOADED", "PARSING", True), ("j", 3, "PARSING", "READY", False), ("j", 4, "PARSING", "PARSED", True), ("k", 1, None, "FAILED", True), ("k", 2, "FAILED", "UPLOADED", True)]
