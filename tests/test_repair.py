"""Outline repair, evidence shapes, providers, leases and sinks, one hand-written case for each rule."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import chunking, evidence, outline, providers, structure
from marginalia.sources import writers
from marginalia.sources.store import Store
from marginalia.streaming import jobs


def test_lost_headings(spark):
    text = ["Title", "2 Methods are described here. The text goes on", "some words", "2.1 Data", "3. Compute the sum", "3.1 x", "4 Results", "5 Other", "5.1 y", "[1] A. Author, 2001", "[2] B", "6 Late", "6.1 z"]
    rows = spark.createDataFrame([("d", k, x) for k, x in enumerate(text)], "doc string, ln int, line string")
    got = [r.line for r in outline.recover_headings(rows).orderBy("ln", "part").collect()]
    want = ["Title", "## 2. Methods are described here.", "The text goes on", "some words", "2.1 Data", "3. Compute the sum", "3.1 x", "4 Results", "## 5. Other", "5.1 y", "## References", *text[9:]]
    assert got == want
    named = spark.createDataFrame([(1, 0, "## References"), (1, 1, "[1] x"), (1, 2, "7 After"), (1, 3, "7.1 y")], "doc int, ln int, line string")
    assert [r.line for r in outline.recover_headings(named).orderBy("ln").collect()] == ["## References", "[1] x", "7 After", "7.1 y"]
    assert outline.recover_headings(rows.limit(0)).collect() == []


def test_outline_repair(spark):
    cases = {
        # a chapter line told again, with its title, within the last four kept
        "twice": [("Chapter 1", 1), ("Basics", 2), ("Chapter 1. Basics", 2), ("Chapter 2. More", 2)],
        "far": [("Chapter 1", 1), ("Basics", 2), *[(f"s{k}", 2) for k in range(2, 6)], ("Chapter 1. Basics", 2)],
        "kept only": [("Chapter 1", 1), ("Basics", 2), ("x", 2), ("Chapter 1. Basics", 2), ("y", 2), ("Chapter 1. Basics", 2)],
        # a numbered section without its parent goes up, unless the heading before can be that parent
        "childless": [("Abstract", 2), ("3.1 Data", 3)], "owner": [("Methods", 2), ("3.1 Data", 3), ("3.2 More", 3)],
        "others": [("3 Methods", 2), ("3.1 Data", 3), ("4.1 Other", 3), (None, 2)], "acknowledged": [("Acknowledgements", 2), ("5.1 x", 4)],
        "raised owns": [("Title", 1), ("2.1 A", 3), ("2.2 B", 3)], "chapter": [("Chapter 4", 2), ("4.1 x", 3)],
    }
    rows = spark.createDataFrame([(d, k, h, v) for d, told in cases.items() for k, (h, v) in enumerate(told)], "doc string, idx int, header string, level int")
    got = {}
    for r in outline.repair(rows).orderBy("doc", "idx").collect():
        got.setdefault(r.doc, []).append((r.header, r.level))
    want = {d: list(told) for d, told in cases.items()}
    want["twice"] = [("Chapter 1", 1), ("Basics", 2), ("Chapter 2. More", 2)]
    want["kept only"] = [("Chapter 1", 1), ("Basics", 2), ("x", 2), ("y", 2)]
    want["childless"][1], want["acknowledged"][1], want["others"][2], want["chapter"][1] = ("3.1 Data", 2), ("5.1 x", 2), ("4.1 Other", 2), ("4.1 x", 2)
    want["raised owns"] = [("Title", 1), ("2.1 A", 2), ("2.2 B", 2)]
    assert got == want
    assert {(r.doc, r.idx): r.parent_idx for r in outline.repair_with_parents(rows).filter("doc = 'owner'").collect()} == {("owner", 0): None, ("owner", 1): 0, ("owner", 2): 0}


def test_markers(spark):
    rows = spark.createDataFrame([("## 2.1 Data",), ("A. Proofs",), ("IV. Results",), ("Chapter 3 Ends",), ("Plain words",)], "line string")
    number, rest = outline.marker("line")
    assert [tuple(r) for r in rows.select(number, rest).collect()] == [("2.1", "Data"), ("A.", "Proofs"), ("IV.", "Results"), ("Chapter 3", "Ends"), ("", "Plain words")]


def test_evidence_shapes(spark):
    rows = spark.createDataFrame([("SECTION", "s1", 1, "h", "p > h", None, "q", 0.5, "t"), ("SYMBOL", None, 1, "x", None, None, "q", 0.4, "t"), ("REFERENCE", None, 2, "title", None, "[3]", "q", 0.3, "t")], "evidence_type string, section_id string, paper_id int, heading string, heading_path string, reference_index string, quote string, fusion_score double, paper_title string")
    assert [tuple(r) for r in evidence.legacy_sections(rows).collect()] == [("s1", 1, "p > h", "q", 0.5, "t")]
    assert [tuple(r) for r in evidence.legacy_symbols(rows).collect()] == [(1, "x", "q", 0.4, "t")]
    assert [tuple(r) for r in evidence.legacy_references(rows).collect()] == [(2, "[3]", "title", "q", 0.3, "t")]
    payloads = ['[{"evidenceKey":"SECTION:1","headingPath":"A > B","quote":"said"},{"evidenceKey":"SYMBOL:2"}]', "[]", None, "not json", "[broken"]
    told = [r[0] for r in spark.createDataFrame([(p,) for p in payloads], "p string").select(evidence.audit_evidence_text("supporting", "p")).collect()]
    assert told == ["  supporting:\n  - [SECTION:1] A > B | said\n  - [SYMBOL:2] legacy | legacy", "", "", "  supporting: unavailable (legacy audit payload)", "  supporting: unavailable (legacy audit payload)"]


def test_chunk_tail_counts_text_only():
    units = ["a" * 2700, "b" * 200, "c" * 200, "d" * 2000]
    first, second = chunking.pack("\n\n".join(units))
    assert first == "\n\n".join(units[:3]) and second == "\n\n".join(units[1:])


def test_string_documents(spark):
    docs = spark.createDataFrame([("x", "# A title of words\n\n## Abstract\n\ntext")], "id string, text string")
    got = structure.decide_headings(structure.line_flags(structure.lines(docs, "id", "text")))
    assert {r.doc for r in got.collect()} == {"x"}
    where = chunking.locate_pages(spark.createDataFrame([("x", 0, "several words that are long enough")], "doc string, chunk_index int, content string"), spark.createDataFrame([("x", 0, "first page", 0), ("x", 1, "several words that are long enough", 1)], "doc string, seq int, text string, page_index int"))
    assert [(r.page_start, r.page_end) for r in where.collect()] == [(2, 2)]


def test_providers(spark):
    asked = spark.createDataFrame([("q1", "h"), ("q2", "")], "question string, history string")

    def rewrite(question, history):
        if not history:
            raise RuntimeError
        return f"{question} {history}"

    assert [r.query for r in providers.rewrite_query(asked, rewrite).orderBy("question").collect()] == ["q1 h", "q2"]
    assert [r.query for r in providers.rewrite_query(asked).orderBy("question").collect()] == ["q1", "q2"]
    snippets = spark.createDataFrame([(1, "[2]", 1, "b"), (1, "[2]", 0, "a"), (1, "[3]", 0, "c")], "doc int, ref_index string, seq int, snippet string")
    assert {r.ref_index: r.summary for r in providers.summarise_references(snippets, lambda i, s: i + "".join(s)).collect()} == {"[2]": "[2]ab", "[3]": "[3]c"}
    texts = spark.createDataFrame([("a", "b"), ("a", None), (None, "b"), (None, "")], "known string, found string")
    assert [r.abstract for r in providers.fuse_abstracts(texts, lambda a, b: a + b).collect()] == ["ab", "a", "b", None]
    judged = providers.judge_answers(spark.createDataFrame([(1,), (2,)], "sample int"), lambda metric, r: 2.0 if r["sample"] == 1 else 1 / 0)
    assert [r.faithfulness for r in judged.orderBy("sample").collect()] == [1.0, None] and providers.judge_summary(judged).first().samples == 2
    assert providers.dispatch([lambda k=k: k for k in range(5)]) == [0, 1, 2, 3, 4]
    with pytest.raises(RuntimeError):
        providers.dispatch([lambda: 0] * 25)


def test_relation_audit(spark):
    pairs = spark.createDataFrame([(1, 2, "t1", "t2", "a", "v1", "v2"), (1, 3, "t1", "t3", "a", "v1", None), (1, 4, "t1", "t4", "a", "v1", "v4")], "source int, target int, title string, other_title string, abstract string, source_version string, target_version string")
    found = spark.createDataFrame([(1, 2, f"SECTION:{k}", "q", 1.0 - k / 20) for k in range(12)] + [(1, 3, "SECTION:0", "q", 1.0)], "source int, target int, evidence_key string, quote string, score double")

    def judge(pair, pieces):
        assert [p["evidence_key"] for p in pieces] == [f"SECTION:{k}" for k in range(8)] or len(pieces) == 1
        keys = ["SECTION:7", "SECTION:9", "SECTION:7"] if pair["target"] == 2 else ["SECTION:5"]
        return {"type": "supports", "reason": "r", "confidence": 0.9, "supporting": keys}

    got = {r.target: r for r in providers.audit_relations(pairs, found, judge).collect()}
    assert (got[2].type, got[2].supporting, got[2].audit_status, got[2].audit_version) == ("SUPPORTS", ["SECTION:7"], "CONFIRMED", "source=v1;target=v2")
    assert (got[3].supporting, got[3].audit_status, got[3].audit_version) == ([], "PENDING_REVIEW", "source=v1;target=")
    assert (got[4].type, got[4].confidence, got[4].audit_status) == ("UNRELATED", 0.0, "PENDING_REVIEW")


def test_heartbeat():
    assert jobs.heartbeat_seconds() == 30 and jobs.heartbeat_seconds(10, 900) == 200 and jobs.heartbeat_seconds(120, 1) == 5



def test_sinks(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(x):
        calls.add(1)
        return [float(x)]

    rows = spark.createDataFrame([(1, 0), (1, 1)], "paper_id long, chunk_index int").withColumn("embedding", F.udf(embed, "array<float>")("chunk_index"))
    store = Store(spark, str(tmp_path / "store"))
    assert writers.replace_chunks(store, rows) == 2 and calls.value == 2
    assert not [p for p in (tmp_path / "store" / "data").iterdir() if p.name.startswith("incoming")]
    writers.write_report(spark.createDataFrame([(1, "x")], "a int, b string").coalesce(1), str(tmp_path / "report"))
    assert next((tmp_path / "report").glob("part-*")).read_bytes() == b"\xef\xbb\xbfa,b\n1,x\n"
    told = spark.createDataFrame([("d", 1, "SECTION", "HEADING", 2, 0.9, "why", "Methods")], "doc string, ln int, kind string, action string, level int, confidence double, reason string, line string")
    lines = [r.value for r in writers.report_lines(told, {"title": "t"}, ["no references"]).collect()]
    assert lines[:2] == ["title=t", "WARNING no references"] and lines[2].split("\t")[1] == "SECTION"
    old = spark.createDataFrame([("s", ["a"]), ("t", ["b"])], "session_id string, messages array<string>")
    assert {r.session_id: r.messages for r in writers.put_memory(old, spark.createDataFrame([("s", ["c"])], old.schema)).collect()} == {"s": ["c"], "t": ["b"]}
    with pytest.raises(ValueError):
        writers.put_memory(old, spark.createDataFrame([("s", [])], old.schema))


def test_linked_papers(spark):
    works = spark.createDataFrame([(1, "f"), (2, "g"), (3, None)], "id int, fingerprint string")
    papers = spark.createDataFrame([(9, "f"), (7, "f"), (8, None)], "paper_id int, fingerprint string")
    assert {r.id: r.linked_paper_id for r in evidence.link_papers(works, papers).collect()} == {1: 7, 2: None, 3: None}


def test_abstracts(spark):
    long = "Words before. " * 30 + "In this paper we say it."
    cases = {
        "named": [("Title", "x"), ("Abstract", "the text"), ("Introduction", "y")],
        "named but empty, then scanned": [("Title", "ABSTRACT in the first section is not taken " + "x" * 80), ("Abstract", ""), ("a", "b"), ("c", "d")],
        "first section": [("Title", "some words abstract: of this"), ("Next", "y")],
        "up to the introduction": [("T", "z" * 120), ("U", "w" * 90 + " abstract here it is introduction not this"), ("V", "x"), ("W", "y")],
        "by a cue": [("T", "z" * 120), ("U", "short\n\n" + long), ("V", "x"), ("W", "y")],
        "too late": [("T", "x"), ("U", "y"), ("V", long), ("W", "z")],
    }
    rows = [(d, k, h, t) for d, some in cases.items() for k, (h, t) in enumerate(some)]
    got = {r.doc: r.abstract for r in structure.abstracts(spark.createDataFrame(rows, "doc string, idx int, header string, content string")).collect()}
    assert got["named"] == "the text" and got["too late"] == structure.NO_ABSTRACT and got["by a cue"].endswith("we say it.")
    assert got["first section"].endswith("of this") and got["named but empty, then scanned"].startswith("in the first section")
    assert "here it is" in got["up to the introduction"] and "not this" not in got["up to the introduction"]


def test_kinds(spark):
    from marginalia.functions import text as T

    rows = spark.createDataFrame([("12 apples",), ("12. Apples",), ("Proof. It follows",), ("Table of contents",), ("3. Compute it",)], "line string")
    assert [r[0] for r in rows.select(T.line_kind("line", F.lit(False))).collect()] == ["BODY", "SECTION", "THEOREM_LIKE", "THEOREM_LIKE", "LIST_ITEM"]
