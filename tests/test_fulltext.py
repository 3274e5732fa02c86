import random

import pytest

from marginalia.operators import lexical

QUERIES = [(1, "alpha beta"), (2, '"random walk" -graph'), (3, 'beta or "alpha gamma"'), (4, "-alpha"), (5, "the of"), (6, 'alpha "alpha beta" gamma'), (7, '"alpha beta alpha" walk'), (8, ""), (9, "alpha alpha"), (10, None)]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(1)
    words = ["alpha", "beta", "gamma", "the", "walks", "walking", "Random", "of", "graphs", "été,", "中文"]
    rows = [(k, " ".join(draw.choices(words, k=draw.randrange(4))), " ".join(draw.choices(words, k=draw.randrange(30)))) for k in range(200)]
    return rows + [(200, None, "alpha beta"), (201, "alpha", None), (202, "", ""), (203, None, None), (204, "alpha", "beta " * 5000)]


def by_rank(texts, config):
    """Each text against each query, one after another."""
    found = {}
    for qid, query in QUERIES:
        parsed = lexical.parse_query(query or "", config)
        for k, heading, body in texts:
            score = lexical.rank(parsed, lexical.terms(heading, config), lexical.terms(body, config))
            if score is not None:
                found[qid, k] = pytest.approx(score, abs=2e-9)
    return found


@pytest.mark.parametrize("config", ["english", "simple"])
@pytest.mark.parametrize("terms", [1000, 2])
def test_index_ranks_as_text_by_text(spark, texts, config, terms, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", terms)  # below and above the bound on what is sent to every task
    rows = spark.createDataFrame([*texts, (None, "alpha", "beta")], "id bigint, heading string, body string")
    queries = spark.createDataFrame(QUERIES, "qid int, query string")
    lexical.write_index(lexical.index(rows, "id", "heading", "body", config), f"{tmp_path}/index")
    got = {(r.qid, r.id): r.lexical_score for r in lexical.match(spark.read.parquet(f"{tmp_path}/index"), queries, config).collect()}
    assert got == by_rank(texts, config)


def test_search_without_an_index(spark, texts):
    rows = spark.createDataFrame(texts, "id bigint, heading string, body string")
    got = {r.id: r.lexical_score for r in lexical.search(rows, QUERIES[1][1], "id", "heading", "body").collect()}
    assert got == {k: score for (qid, k), score in by_rank(texts, "english").items() if qid == 2}
    assert lexical.search(rows, "the", "id", "heading", "body").count() == 0


def test_shortest_stretches(spark):
    # a at 0, 3; b at 1, 5: stretches 0..1, 1..3 and 3..5
    text, parsed = ["a", "b", "x", "a", "x", "b"], lexical.parse_query("a b", "simple")
    assert lexical.rank(parsed, [], text) == pytest.approx(0.4 * (1 + 1 / 2 + 1 / 2))  # one more than the places in between that hold none
    pair = lexical.parse_query("graph walk", "simple")
    near, wide = (lexical.rank(pair, [], lexical.terms(t, "simple")) for t in ("graph walk", "graph a b walk " + "c " * 9 + "graph a b walk"))
    assert near == pytest.approx(0.4) and wide == pytest.approx(0.4 * (1 / 3 + 1 / 3 + 1 / 10))  # one pair side by side before two that are four wide


def test_empty_table(spark):
    none = spark.createDataFrame([], "id bigint, heading string, body string")
    assert lexical.match(lexical.index(none, "id", "heading", "body"), spark.createDataFrame(QUERIES, "qid int, query string")).count() == 0


def test_portions_hold_every_row(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "PORTION", 5)
    told = [["a", "b"], [], ["c"] * 9, ["d", "e"], ["f"], ["g", "h"], [], ["i"] * 5, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(told, pa.list_(pa.string()))], ["id", "h"])
    parts = list(lexical._portions(batch, "h"))
    assert [x for p in parts for x in p.column("id").to_pylist()] == list(range(9)) and all(p.num_rows == 1 or sum(map(len, p.column("h").to_pylist())) <= 5 for p in parts)
    found = [r for p in parts for r in lexical._postings(p.column("id"), p.column("h"), "h", False).to_pylist()]
    assert found == lexical._postings(batch.column("id"), batch.column("h"), "h", False).to_pylist() and len(parts) < 9
