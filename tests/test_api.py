import json

import pytest

from marginalia.api import Library, react
from marginalia.operators import lexical


@pytest.fixture(scope="module")
def library(spark):
    make = spark.createDataFrame
    tables = {
        "papers": make([(1, "Graph search", [1.0, 0.0]), (2, "Cooking", None)], "id long, title string, embedding array<float>"),
        "sections": make([("s1", 1, "Methods", "All methods of the paper.", None, 0), ("s2", 1, "Search", "We search graphs by walking.", "s1", 1), ("s3", 1, "End", "Done.", "s1", 2)], "id string, paper_id long, header string, content string, parent_id string, idx int"),
        "chunks": make([("c1", 1, "s1", "Methods", None, None, "All methods of the paper.", [0.0, 1.0]), ("c2", 1, "s2", "Methods > Search", 2, 3, "We search graphs by walking.", [1.0, 0.1])], "id string, paper_id long, section_id string, heading_path string, page_start int, page_end int, content string, embedding array<float>"),
        "symbols": make([(5, 1, "G", "\\mathcal{G}", "a graph", "G=(V,E)", ["s2"], None)], "id long, paper_id long, symbol string, latex string, description string, definition_formula string, source_ids array<string>, embedding array<float>"),
        "references": make([(7, 1, "12", "raw text", "A title", "its abstract", 70)], "id long, paper_id long, ref_index string, raw_text string, title string, abstract string, global_ref_id long"),
        "works": make([(70, "A title", "its abstract on graphs", 9, [0.9, 0.1]), (71, "Other", "x", None, None)], "id long, title string, abstract string, citation_count long, embedding array<float>"),
        "links": make([(1, "s2", "12")], "paper_id long, section_id string, ref_index string"),
        "relations": make([(1, 2, "USES", "CONFIRMED", "It does")], "source long, target long, type string, audit_status string, description string"),
    }
    return Library(spark, tables, lambda text: [1.0, 0.0])


def test_search(library):
    rows = library.search("searching graphs").collect()
    assert rows[0].evidence_key == "SECTION:c2" and rows[0].channels == ["TEXT_SECTION", "VECTOR_SECTION"]
    assert rows[0].quote == "We search graphs by walking." and rows[0].page_start == 2
    assert library.search("g", mode="fulltext").first().evidence_key == "SYMBOL:5"
    failing = Library(library.spark, library.tables, lambda text: 1 / 0)
    assert failing.search("graphs").first().channels == ["TEXT_SECTION"]
    with pytest.raises(ZeroDivisionError):
        failing.search("graphs", mode="vector")


def test_reading(library):
    read = library.read_section("s2")
    assert [e["evidence_key"] for e in read.evidence] == ["SECTION:s2", "SYMBOL:5", "REFERENCE:1:12"]
    assert "Path: Methods > Search" in read.content and "Parent: Methods" in read.content and "Previous: s1  Next: s3" in read.content
    assert library.lookup_reference(1, "12").evidence[0]["evidence_key"] == "REFERENCE:1:12"
    assert json.loads(library.paper_outline(1).content)[0]["children"][0]["id"] == "s2"
    assert library.check_relations(2).content == "This paper is used by paper 1. It does"
    assert library.top_cited(1).content == "Other (None)"


def test_tools(library):
    found = library.call("search_library", '{"query": "graphs", "paper_id": "paper 1"}')
    keys = [e["evidence_key"] for e in found.evidence]
    assert "SECTION:s2" in keys and len(keys) == len(set(keys))
    assert library.call("find_papers", "graph").content == "1: Graph search"
    assert library.call("odd").content == "unknown tool: odd"
    says = iter(["no json", '{"action": "read_section", "input": "s2"}', '{"answer": "by walking"}'])
    done = react(library, lambda messages: next(says), "how?")
    assert done.content == "by walking" and len(done.evidence) == 3


def test_lexical():
    assert [lexical.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "happy", "generalization", "running")] == ["caress", "poni", "relat", "hop", "happi", "gener", "run"]
    q = lexical.parse_query('graph "random walk" -cooking or tea')
    assert lexical.rank(q, [], lexical.terms("a graph with random walks")) > 0
    assert lexical.rank(q, [], lexical.terms("a graph with walks at random")) is None
    assert lexical.rank(q, [], lexical.terms("a graph, random walks and cooking")) is None
    assert lexical.rank(q, [], lexical.terms("tea")) > 0
    near, far = (lexical.rank(lexical.parse_query("graph walk"), [], lexical.terms(t)) for t in ("graph walk", "graph of a very long walk"))
    assert near > far
