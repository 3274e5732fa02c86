"""Properties of single operators on small hand-written rows."""

import random
import re
import uuid
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.operators import audit, chunking, evaluate, ingest, knn, library, references, retrieval, structure
from marginalia.plans import catalogue


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def test_chunks_fit_and_are_deterministic(spark):
    text = "\n\n".join(" ".join(f"{p}{k}" for k in range(80)) + "." for p in ("alpha", "beta", "gamma"))
    rows = spark.createDataFrame([("s1", text), ("s2", None)], "id string, content string")
    a, b = (chunking.chunks(rows, most=800, overlap=100).orderBy("chunk_index").collect() for _ in range(2))
    assert a == b and len(a) > 1 and all(len(r.content) <= 800 and r.section_id == "s1" for r in a)
    digest = bytearray(md5(f"s1|0|{a[0].content_hash}".encode()).digest())
    digest[6], digest[8] = digest[6] & 0x0F | 0x30, digest[8] & 0x3F | 0x80
    assert a[0].chunk_id == str(uuid.UUID(bytes=bytes(digest)))


def test_heading_path_and_cycle(spark):
    rows = spark.createDataFrame([(1, None, "Parent"), (2, 1, "Child"), (3, 4, "A"), (4, 3, "B"), (5, 99, "Orphan")], "id long, parent_id long, header string")
    paths = {r.id: r.heading_path for r in structure.heading_paths(rows).collect()}
    assert paths[2] == "Parent > Child" and paths[5] == "Orphan" and paths[3] == "B > A" and paths[4] == "A > B"


def test_heading_path_of_any_depth(spark):
    up = {k: k - 1 or None for k in range(1, 41)} | {50: 51, 51: 52, 52: 50, 53: 50, 54: 53}
    want = {}
    for k in up:
        seen, at = [], k
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        want[k] = (" > ".join(f"h{x}" for x in reversed(seen)), len(seen))
    rows = spark.createDataFrame([(1, k, p, f"h{k}", k) for k, p in up.items()], "doc long, id long, parent_id long, header string, idx long")
    assert {r.id: (r.heading_path, r.level) for r in structure.heading_paths(rows).collect()} == want
    chain = structure.depth_first(rows.filter("id <= 40"), "doc", "id", "parent_id", "idx")
    assert {r.id: r.position for r in chain.collect()} == {k: k for k in range(1, 41)}


def test_depth_first_below_twelve_levels(spark):
    # two chains of 20 under one root, their idx interleaved
    up = {1: None} | {k: max(k - 2, 1) for k in range(2, 42)}
    rows = spark.createDataFrame([(1, k, p, k) for k, p in up.items()], "doc long, id long, parent_id long, idx long")
    got = structure.depth_first(rows, "doc", "id", "parent_id", "idx").orderBy("position").collect()
    assert [r.id for r in got] == [1, *range(2, 42, 2), *range(3, 42, 2)]


def candidates(spark, rows):
    return spark.createDataFrame(rows, "qid long, channel string, channel_seq int, weight double, rank int, evidence_key string, evidence_type string, semantic_score double, lexical_score double")


def test_two_channels_come_first(spark):
    c = candidates(spark, [(1, "TEXT_SECTION", 2, 1.0, 1, "SECTION:T", "SECTION", None, 0.9), (1, "TEXT_SECTION", 2, 1.0, 2, "SECTION:S", "SECTION", None, 0.5), (1, "VECTOR_SECTION", 5, 1.0, 1, "SECTION:V", "SECTION", 0.9, None), (1, "VECTOR_SECTION", 5, 1.0, 2, "SECTION:S", "SECTION", 0.8, None), (1, "VECTOR_SECTION", 5, 1.0, 3, "  ", "SECTION", 0.8, None)])
    got = retrieval.fuse(c).orderBy("position").collect()
    assert [r.evidence_key for r in got] == ["SECTION:S", "SECTION:T", "SECTION:V"]
    assert got[0].channels == ["TEXT_SECTION", "VECTOR_SECTION"] and got[1].semantic_score == 0.0
    assert got[0].fusion_score == pytest.approx(2 / 62)


def test_expansion_gate(spark):
    rows = [(1, "SECTION:a", "SECTION", 1, 2.0), (1, "SECTION:b", "SECTION", 2, 1.0), (2, "SECTION:a", "SECTION", 1, 1.1), (2, "SECTION:b", "SECTION", 2, 1.0), (2, "SECTION:c", "SECTION", 3, 0.9), (3, "SYMBOL:x", "SYMBOL", 1, 1.0)]
    e = spark.createDataFrame(rows, "qid long, evidence_key string, evidence_type string, position int, fusion_score double")
    assert sorted((r.qid, r.section_key) for r in retrieval.expansions(e).collect()) == [(1, "SECTION:a"), (2, "SECTION:a"), (2, "SECTION:b")]


def test_requests():
    assert retrieval.request(" x ", None, 0.99)[:3] == ("x", None, 0.95)
    with pytest.raises(ValueError):
        retrieval.request("  ")
    with pytest.raises(ValueError):
        retrieval.mode_of("odd")


def test_page_location(spark):
    blocks = spark.createDataFrame([(1, 0, "the first page has some words of its own", 0), (1, 1, "second page text is found here by its words alone", 1)], "doc long, seq int, text string, page_index int")
    c = spark.createDataFrame([(1, 0, "second page text  is found here"), (1, 1, "nothing of this can be located anywhere")], "doc long, chunk_index int, content string")
    got = {r.chunk_index: (r.page_start, r.page_end) for r in chunking.locate_pages(c, blocks).collect()}
    assert got == {0: (2, 2), 1: (None, None)}


def test_page_location_order_and_anchors(spark):
    same = "the very same words stand on both of these pages here"
    long = " ".join(f"w{k}" for k in range(60))
    pages = [same, long, same, "the last page"]
    blocks = spark.createDataFrame([(1, k, x, k) for k, x in enumerate(pages)] + [(1, 9, " \n ", 9)], "doc long, seq int, text string, page_index int")
    told = [same, same, same, long[:150] + " another end " + "x" * 40, long[:90] + " another end of it", "too short", None, long + "  " + same + " the  last page", same]
    c = spark.createDataFrame([(1, k, x) for k, x in enumerate(told)] + [(2, 0, same)], "doc long, chunk_index int, content string")
    got = {(r.doc, r.chunk_index): (r.page_start, r.page_end) for r in chunking.locate_pages(c, blocks).collect()}
    none = (None, None)
    # one after another, then from the beginning; by the short anchor; not by fewer characters than it; over pages
    assert [got[1, k] for k in range(9)] == [(1, 1), (3, 3), (1, 1), (2, 2), none, none, none, (2, 4), (3, 3)] and got[2, 0] == none


def located(blocks, told):
    """Plain code for one document: (start, end) for each chunk."""
    bare = lambda x: re.sub(r"[ \t\n\x0b\f\r]+", " ", x or "").strip("".join(map(chr, range(33))))
    spans, source, after, out = [], "", 0, []
    for text, page in blocks:
        if bare(text):
            source += " " if source else ""
            spans.append((len(source), len(source) + len(bare(text)), page + 1))
            source += bare(text)
    page = lambda at: next((p for a, z, p in spans if a <= at < z), None)
    for t in map(bare, told):
        hit = source.find(t[:180], after) if len(t) >= 24 else -1
        hit = source.find(t[:100], after) if hit < 0 and len(t) > 100 else hit
        hit = source.find(t[: 100 if len(t) > 100 else 180]) if hit < 0 and len(t) >= 24 else hit
        after = hit + 1 if hit >= 0 else after
        out.append((page(hit), page(max(hit, min(len(source), hit + len(t)) - 1))) if hit >= 0 else (None, None))
    return out


def test_page_location_against_plain_code(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(("alpha", "beta", "the", "größe", "\U0001d54f", "word,", "of", "\\E", "(.*", "\x01", "")) for _ in range(r.randint(0, 60))) for _ in range(9)]
    pages, rows = {}, {}
    for doc in range(60):
        pages[doc] = [(r.choice(texts) + r.choice(("", " \n", "\t\x02", "\u00a0")), k // 3) for k in range(r.randint(1, 20))]
        whole = r.choice((" ", "  \n")).join(x for x, _ in pages[doc])
        cuts = [r.randint(0, len(whole)) for _ in range(25)]
        rows[doc] = [whole[a : a + r.choice((20, 24, 90, 100, 101, 150, 180, 181, 500))] + r.choice(("", "", " and more that is not there")) for a in cuts]
    blocks = spark.createDataFrame([(doc, k, x, p) for doc in pages for k, (x, p) in enumerate(pages[doc])], "doc long, seq int, text string, page_index int")
    chunks = spark.createDataFrame([(doc, k, x) for doc in rows for k, x in enumerate(rows[doc])], "doc long, chunk_index int, content string")
    got = {(x.doc, x.chunk_index): (x.page_start, x.page_end) for x in chunking.locate_pages(chunks, blocks).collect()}
    assert got == {(doc, k): x for doc in pages for k, x in enumerate(located(pages[doc], rows[doc]))}
    assert len(set(got.values())) > 10


def test_page_location_searches_once(spark):
    blocks = spark.createDataFrame([(1, 0, "a page", 0)], "doc long, seq int, text string, page_index int")
    chunks = spark.createDataFrame([(1, 0, "a text")], "doc long, chunk_index int, content string")
    plan = chunking.locate_pages(chunks, blocks)._jdf.queryExecution().optimizedPlan().toString()
    # the short anchor from here, the long one, the short one from the beginning: none is written out again where its place is used
    assert plan.count("locate(") == 3


def test_collapse(spark):
    r = random.Random(3)
    told = ["".join(r.choice(" \t\n\x0b\f\r\x00\x1f\x85\u00a0ab") for _ in range(r.randint(0, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in told], "x string").select("x", T.collapse("x").alias("got"), T.jtrim(F.regexp_replace("x", r"\s+", " ")).alias("plain"))
    assert not rows.filter("not got <=> plain").collect()


def test_citations(spark):
    numbers = {
        "see [1, 3-5] and <sup>7</sup>, $^{9}$ or ^{11,12}; reversed [9-4]": ["1", "11", "12", "3", "4", "5", "7", "9"], "[007] [1 2] [3-] [-4] [5-6-] [1-2-3] [x1]": ["007", "5", "6"],
        "[1-1001] [1-1002]": None, "<sup> 2 </sup> $ ^{3}$ [4": ["2", "3"], "": [],
    }
    for text, want in numbers.items():
        got = one(spark, T.numeric_citations(F.lit(text)))
        assert got == want if want is not None else (len(got), "1001" in got, "1002" in got) == (1001, True, False)
    years = {
        "Smith et al. (2001a) and Jones and Roe (1999)": ["Jones 1999", "Smith 2001a"], "Smith et al. (2019; 2020)": ["Smith 2019", "Smith 2020"], "In 2019 we saw. Since 1999": [],
        "Müller and Kaya (2018a, 2018b)": ["Müller 2018a", "Müller 2018b"], "Jones and Roe, 1999": [], "Smith et al (2001)": [], "Smith(1850)": ["Smith 1850"], "Roe (2001, p. 4)": [],
    }
    for text, want in years.items():
        assert one(spark, T.author_year_citations(F.lit(text))) == want


def test_a_reference_line_is_searched_once_for_its_number(spark):
    plan = references.entries(spark.createDataFrame([(1, "[1] A")], "d int, t string"), "d", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<sup>") == 1


def test_reference_entries(spark):
    texts = [
        "[1] First work\ngoes on. [2] Second Work.\nSmith, J. (2001) Third.", "12 R. 50586 2. R. C. Other; 3. Next one", "J. T. Beale (1984). Title\nBeale et al. (1985) More\nno (1986)entry", "words\n\nand more",
        "$^4$ Four\n$^{5}$ Five\n<sup>6</sup> Six\n7.Seven\n8",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, t string")
    got = [(r.doc, r.ref_index, r.raw_text) for r in references.entries(rows, "doc", "t").orderBy("doc", "seq").collect()]
    assert got == [
        (0, "1", "First work goes on. [2] Second Work."), (0, "Smith 2001", "Smith, J. (2001) Third."), (1, "12", "R. 50586"), (1, "2", "R. C. Other;"), (1, "3", "Next one"),
        (2, "Beale 1984", "J. T. Beale (1984). Title"), (2, "Beale 1985", "Beale et al. (1985) More no (1986)entry"), (4, "4", "Four"), (4, "5", "Five"), (4, "6", "Six"), (4, "7", "Seven"), (4, "8", ""),
    ]


def test_symbols_and_reference_sections(spark):
    rows = spark.createDataFrame([(1, k, s, "what", 1) for k, s in enumerate(["pi", "PI", "=", "-", "E", "i", "1", "0", "2", "π", "∞", " x "])], "doc long, seq int, symbol string, description string, root int")
    assert sorted(r.symbol for r in references.merge_symbols(rows).collect()) == ["2", "x", "π", "∞"]
    told = [("a", 0, "Notes", "long text"), ("a", 1, "References", "text"), ("b", 0, "Acknowledgments", "x"), ("b", 1, "Literature cited", "longer"), ("c", 0, "One", "x"), ("c", 1, "Two", "x"), ("d", 0, "REFERENCES", "xx"), ("d", 1, "Bibliography", "yy")]
    rows = spark.createDataFrame(told, "doc string, idx int, header string, content string")
    assert {r.doc: r.idx for r in references.reference_section(rows, "doc", "header", "content", "idx").collect()} == {"a": 0, "b": 0, "c": 1, "d": 0}



def test_symbol_merge(spark):
    rows = [(1, 1, " x ", "null", "r1"), (1, 2, "x", "abc", "r2"), (1, 3, "x", "abcd", "r3"), (1, 4, "x", "much longer words", "r4"), (1, 5, "1", "one", "r1"), (1, 6, "averylongsymbol", "s", "r1")]
    (r,) = references.merge_symbols(spark.createDataFrame(rows, "doc long, seq int, symbol string, description string, root string")).collect()
    assert (r.symbol, r.description, r.scopes, r.is_global) == ("x", "much longer words", ["r1", "r2", "r3", "r4"], True)


def test_audit(spark):
    keys = spark.createDataFrame([(1, 2, ["SECTION:fake", "SECTION:b", "SECTION:a", "SECTION:b"])], "source long, target long, keys array<string>")
    evidence = spark.createDataFrame([(1, 2, "SECTION:a"), (1, 2, "SECTION:b")], "source long, target long, evidence_key string")
    assert [(r.evidence_key, r.seq) for r in audit.cited(keys, evidence).orderBy("seq").collect()] == [("SECTION:b", 1), ("SECTION:a", 2)]
    assert one(spark, audit.status(F.lit(0.9), F.lit(0), F.lit(0))) == "PENDING_REVIEW"
    assert one(spark, audit.status(F.lit(0.65), F.lit(0), F.lit(1))) == "CONFIRMED"
    assert one(spark, audit.status(F.lit(0.64), F.lit(3), F.lit(1))) == "PENDING_REVIEW"


def test_transitions(spark):
    assert ingest.is_legal("READY", "PARSED") and ingest.is_legal("PARSED", "PARSED") and not ingest.is_legal("UPLOADED", "READY") and not ingest.is_legal(None, "READY")
    stages = ingest.stage_table(spark).collect()
    assert len(stages) == 10 and [r.stage for r in stages if not r.rerun] == ["UPLOAD", "PARSE"]
    assert one(spark, ingest.legal(F.lit(None).cast("string"), F.lit("READY"))) is False


def test_headings(spark):
    lines = ["# A Title of Words", "", "## Abstract", "We do things.", "", "1. Introduction", "1 Introduction", "", "Theorem 1 holds here", "1. Compute the sum", "", "1.2 Details", "", "Page 3 of 9", "", "# A Title of Words", "", "References", "[1] A work"]
    rows = structure.line_flags(spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc long, ln int, line string"))
    got = {r.line: (r.action, r.level) for r in structure.decide_headings(rows).collect() if r.ln != 15}
    assert got["# A Title of Words"] == ("HEADING", 1) and got["## Abstract"] == ("HEADING", 2) and got["1. Introduction"] == ("HEADING", 2)
    assert got["1 Introduction"][0] == "TEXT"  # a bare number without a dot opens no section; a lost one comes back by the outline
    assert got["1.2 Details"] == ("HEADING", 3) and got["References"] == ("HEADING", 2)
    assert got["Theorem 1 holds here"][0] == "TEXT" and got["1. Compute the sum"][0] == "TEXT" and got["[1] A work"][0] == "TEXT"
    assert got["Page 3 of 9"][0] == "TEXT"  # a page's own line goes when sections are read
    assert "Page 3" not in " ".join(r.content for r in structure.sections(rows.select("doc", "ln", "line")).collect())
    assert all(r.reason for r in structure.decide_headings(rows).collect())


def test_marked_lines_keep_all_text(spark, tmp_path):
    words = lambda n, tag: " ".join(f"{tag}{k}" for k in range(n))
    texts = [words(200, "a"), "\n".join(words(30, x) for x in "bcdefghij"), "short\n\n  one\n" + "x" * 100, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = catalogue.marked(spark, f"file://{tmp_path}").orderBy("doc", "ln").collect()
    assert len({(r.doc, r.ln) for r in got}) == len(got)
    for k, text in enumerate(texts):
        mine = [r.line for r in got if r.doc == k]
        bare = "".join(re.sub(r"^#+ ", "", x) for x in mine)
        assert re.sub(r"\s", "", bare) == re.sub(r"\s", "", text or "")
    first = [r.line for r in got if r.doc == 0]
    assert first[0] == "# " + words(200, "a")[:60].rsplit(" ", 1)[0] and len(first) == 2


def test_sections_and_parents(spark):
    lines = ["intro text", "# T", "a line", "goes on.", "new one", "## B", "### C", "## D"]
    s = structure.sections(spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc long, ln int, line string"))
    assert {r.idx: (r.header, r.content) for r in s.collect()} == {0: ("", "intro text"), 1: ("T", "a line goes on.\nnew one"), 2: ("B", ""), 3: ("C", ""), 4: ("D", "")}
    assert {r.idx: r.parent_idx for r in structure.parents(s).collect()} == {0: None, 1: None, 2: 1, 3: 2, 4: 1}


def test_neighbours(spark):
    rows = spark.createDataFrame([(k, [float(k == j) + 0.1 * (k % 2) for j in range(4)]) for k in range(4)] + [(9, None)], "id long, embedding array<float>")
    got = knn.nearest(rows, rows, k=2, above=0.05).collect()
    assert all(r.id != r.neighbour and r["rank"] <= 2 for r in got) and {r.id for r in got} == {0, 1, 2, 3}


def test_neighbours_with_many_ties(spark):
    draw = np.random.default_rng(4)
    one, other = draw.random(16), draw.random(16)
    vectors = {k: other if k % 3 == 0 else one if k < 60 else draw.random(16) for k in draw.permutation(120).tolist()}
    m = np.array([vectors[k] for k in range(120)], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    want = {(k, j, r) for k in range(120) for r, j in enumerate(sorted((j for j in range(120) if j != k), key=lambda j: (-round(s[k, j], 9), j))[:3], 1)}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()], "id long, embedding array<float>")
    for block in (2048, 50):
        assert {(r.id, r.neighbour, r["rank"]) for r in knn.nearest(rows, rows, k=3, above=0.1, block=block).collect()} == want


def test_metrics_and_scores(spark):
    ranks = spark.createDataFrame([(0,), (1,), (6,), (11,)], "first_rank int")
    m = evaluate.metrics(ranks).first()
    assert (m.recall_5, m.recall_10, m.mrr_10) == (0.25, 0.5, round((1 + 1 / 6) / 4, 6))
    assert one(spark, V.threshold(F.lit(None).cast("double"))) == 0.4 and one(spark, V.confidence(F.lit(1.7))) == 1.0


def test_quotes(spark):
    text = "x " * 400 + "needle " + "y " * 400
    got = one(spark, T.quote(F.lit(text), F.lit("the needle")))
    assert "needle" in got and got.startswith("...") and got.endswith("...") and len(got) == 706
    assert one(spark, T.quote(F.lit("short  text"), F.lit("q"))) == "short text"


def test_fingerprint(spark):
    assert one(spark, T.fingerprint(F.array(F.lit(" O'Neil "), F.lit("Abel")), F.lit(2001))) == md5(b"abel|oneil|2001|").hexdigest()
    assert one(spark, T.fingerprint(F.lit(None).cast("array<string>"), F.lit(None).cast("int"))) == md5(b"unknown|0000|").hexdigest()


def test_resuming():
    assert library.resume_from("EMBEDDING") == ["EMBEDDING", "AUDIT", "FINALIZE"]
    with pytest.raises(ValueError):
        library.resume_from(None, "PARSE")
    log = []
    with pytest.raises(KeyError):
        library.run_stages(["PARSE", "AUDIT"], {"PARSE": lambda: 1, "AUDIT": lambda: {}["x"]}, lambda *a: log.append(a[:2]))
    assert log == [("PARSE", "RUNNING"), ("PARSE", "COMPLETED"), ("AUDIT", "RUNNING"), ("AUDIT", "FAILED")]


def test_line_splits(spark):
    head, body = library.split_numbered(F.lit("1.2 A heading of words. The text goes on"))
    assert (one(spark, head), one(spark, body)) == ("1.2 A heading of words.", "The text goes on")
    head, body = library.split_standard(F.lit("Acknowledgements: We thank all"))
    assert (one(spark, head), one(spark, body)) == ("Acknowledgements", "We thank all")
    assert one(spark, library.upper_share(F.lit("ABc"))) == pytest.approx(2 / 3) and one(spark, library.latin_words(F.lit("an x word 中文"))) == 2
    assert one(spark, library.reference_like(F.lit("[3] A. Author, 2001"))) and not one(spark, library.reference_like(F.lit("plain words 2001")))


def test_provider_errors_give_no_rows(spark):
    def provider(title, text):
        if title == "bad":
            raise ValueError
        return [{"symbol": "x", "description": text}]

    rows = spark.createDataFrame([(1, "good", "t"), (2, "bad", "u")], "id long, title string, body string")
    assert [tuple(r) for r in library.extract(rows, provider, "symbol string, description string", "id", "title", "body").collect()] == [(1, "x", "t")]
