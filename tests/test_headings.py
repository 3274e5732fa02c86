import pytest

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import structure

FRONT = ["# A Title of Some Words", "## Abstract", "We do things."]


def decided(spark, lines):
    rows = spark.createDataFrame([("d", k, x) for k, x in enumerate(lines)], "doc string, ln int, line string")
    return [(r.action, r.level, r.heading, r.body) for r in structure.decide_headings(structure.line_flags(rows)).orderBy("ln").collect()]


@pytest.mark.parametrize(
    "lines, want",
    [
        (["## 2. Data"], [("HEADING", 2, "2. Data", None)]),
        (["## 2.1.3 Deep"], [("HEADING", 4, "2.1.3. Deep", None)]),
        (["2.1.3 Deep"], [("HEADING", 3, "2.1.3. Deep", None)]),  # bare: always 3
        (["## § 3. Sign"], [("HEADING", 2, "3. Sign", None)]),
        (["## A. Letter", "## I. Roman", "## IV. More", "## C. Also a letter"], [("HEADING", 3, "A. Letter", None), ("HEADING", 2, "I. Roman", None), ("HEADING", 2, "IV. More", None), ("HEADING", 3, "C. Also a letter", None)]),
        # below level 3, a number that does not go on is a step of it, unless it names a main section
        (["## 3. Data", "## 3.1 Rows", "## 1. First", "## 3.2 More", "## 2. Results", "## 3.3 More", "## 4. Next"], [("HEADING", 2, "3. Data", None), ("HEADING", 3, "3.1. Rows", None), ("HEADING", 4, "1. First", None), ("HEADING", 3, "3.2. More", None), ("HEADING", 2, "2. Results", None), ("HEADING", 3, "3.3. More", None), ("HEADING", 2, "4. Next", None)]),
        (["### Odd heading", "#### The Algorithm", "# Plain"], [("HEADING", 3, "Odd heading", None), ("HEADING", 4, "The Algorithm", None), ("HEADING", 2, "Plain", None)]),
        (["## Appendix A: Proofs", "## 1. Lemmas", "## Other"], [("HEADING", 2, "Appendix A. Proofs", None), ("HEADING", 3, "1. Lemmas", None), ("HEADING", 3, "Other", None)]),
        (["4. RESULTS AND MORE", "4. Things we saw", "4. Method used here. We went on."], [("HEADING", 2, "4. RESULTS AND MORE", None), ("TEXT", 0, None, None), ("SPLIT", 2, "4. Method used here.", "We went on.")]),
        (["Acknowledgements: we thank all."], [("SPLIT", 2, "Acknowledgements", "we thank all.")]),
        (["## References", "## Appendix B. More", "[1] A work"], [("HEADING", 2, "References", None), ("TEXT", 0, None, None), ("TEXT", 0, None, None)]),
        (["Contents", "1 Data 3", "## Method", "## Methodology", "more"], [("DROP", 0, None, None), ("DROP", 0, None, None), ("DROP", 0, None, None), ("HEADING", 2, "Methodology", None), ("TEXT", 0, None, None)]),
        (["# A Title of Some Words"], [("DROP", 0, None, None)]),
    ],
)
def test_rules(spark, lines, want):
    assert decided(spark, FRONT + lines)[3:] == want


def test_patterns_stand_once_in_the_plan(spark):
    plan = structure.line_flags(spark.createDataFrame([("d", 0, "x")], "doc string, ln int, line string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\s{2,}") <= 4, "a line's blanks are folded in heading_text, in heading_key and, where it has a number, in kind_of"


def test_words_and_trims(spark):
    cases = {"one two three": 3, "one two": 2, "a b c d": 0, "x1y ab-c de": 2, "one 2 two 中文 tré": 3, "one two FREE": 2, "  ab\n cd\tef ": 3, "x" * 100_000: 1, "a " * 50_000: 0, "": 0}
    rows = spark.createDataFrame(list(cases.items()), "t string, n int")
    got = rows.select("n", T.latin_words(F.col("t")).alias("m"), *[T.has_latin_words(F.col("t"), k).alias(f"h{k}") for k in (1, 2, 3)], T.jtrim(F.concat(F.lit("\x00 \n"), "t", F.lit("\u00a0\x1f\r"))).alias("u")).collect()
    assert all(r.m == r.n and [r.h1, r.h2, r.h3] == [r.n >= k for k in (1, 2, 3)] and r.u[-1] == "\u00a0" and r.u[0] not in "\x00 \n" for r in got)


def test_before_the_title(spark):
    got = decided(spark, ["", "## Abstract", "short", "a bare line of words", "", "Abstract. It all goes.", "## Odd"])
    assert [a for a, *_ in got] == ["DROP", "DROP", "DROP", "HEADING", "TEXT", "SPLIT", "HEADING"]
    assert got[5] == ("SPLIT", 2, "Abstract", "It all goes.")
    assert decided(spark, ["# A Title of Some Words", "## Odd"])[1][0] == "DROP"  # an odd heading before the abstract


def test_long_lines(spark):
    lines = FRONT + ["7" * 200_000, "## " + "9" * 6000 + ". Far", "x" * 200_000, None]
    assert [a for a, *_ in decided(spark, lines)][3:] == ["TEXT", "HEADING", "TEXT", "TEXT"]


def test_rendered(spark):
    rows = spark.createDataFrame([("d", k, x) for k, x in enumerate([*FRONT, "4. Method used here. We went on."])], "doc string, ln int, line string")
    decisions = structure.decide_headings(structure.line_flags(rows))
    assert structure.normalised_markdown(decisions).first().markdown == "# A Title of Some Words\n## Abstract\nWe do things.\n## 4. Method used here.\nWe went on."
    report = structure.outline_report(decisions).first()
    assert (report.n_headings, report.has_title, report.has_references) == (3, True, False) and report.mean_confidence == pytest.approx((0.98 + 0.99 + 0.84) / 3)


#: (after the references, line, kind): what decides is written out, not taken from the library.
KINDS = [
    (False, "", "BODY"), (False, "plain words", "BODY"), (True, "[3] A work of note", "REFERENCE_ITEM"), (True, "$^{3}$ A work", "REFERENCE_ITEM"), (True, "4. A work", "REFERENCE_ITEM"), (True, "Smith, J. A work", "REFERENCE_ITEM"),
    (True, "lower case goes on", "BODY"), (False, "[3] A work", "BODY"), (False, "Contents", "NOISE"), (False, "## A Preprint", "NOISE"), (False, "Published online: 3 May", "NOISE"), (False, "Cite as: x", "NOISE"),
    (False, "![a](b.png)", "NOISE"), (False, "12 may 2020 10:11:12", "NOISE"), (False, "All rights reserved", "NOISE"), (False, "Received: today", "NOISE"), (False, "Theorem 2 holds", "THEOREM_LIKE"), (False, "Fig. 3", "THEOREM_LIKE"),
    (False, "Tables are", "BODY"), (False, "## ABSTRACT", "ABSTRACT"), (False, "Abstract. We do", "ABSTRACT"), (False, "Abstract *", "ABSTRACT"), (False, "Bibliography", "REFERENCES"), (False, "7. References", "SECTION"),
    (False, "Appendix A: Proofs", "APPENDIX"), (False, "Appendices", "BODY"), (False, "Chapter 3", "SECTION"), (False, "Part 3", "BODY"), (False, "§ 3. Sign", "SECTION"), (False, "§ 3 Sign", "BODY"), (False, "2.1 Data", "SUBSECTION"),
    (False, "2.1. Data", "SUBSECTION"), (False, "2. Data", "SECTION"), (False, "1. Draw a sample", "LIST_ITEM"), (False, "1. Solve it", "LIST_ITEM"), (False, "## 1. Draw a sample", "SECTION"), (False, "1. For each", "SECTION"),
    (False, "IV. Results", "SECTION"), (False, "B. Proofs", "SUBSECTION"), (False, "C. Proofs", "SECTION"), (False, "Acknowledgment", "SECTION"), (False, "ORCID iDs", "SECTION"), (False, "Data availability", "SECTION"),
    (False, "### Methods", "UNCERTAIN"), (False, "Methods", "BODY"), (False, "Introduction", "BODY"), (False, '"Quoted  words"', "BODY"), (False, "####### Seven", "BODY"), (False, "“References”", "REFERENCES"),
]


def test_kinds(spark):
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(KINDS)], "n int, after boolean, line string, kind string")
    got = rows.withColumn("found", T.line_kind("line", F.col("after"))).orderBy("n").collect()
    assert [(r.after, r.line, r.found) for r in got] == KINDS


def test_page_noise(spark):
    noise = ["© 2020 Them", "8", "Page 8", "8 of 12", "J. Phys.A 2024", "Smith et al. 2019", "Journal 055201", "Nature, Smith et al", "# Smith et al", "# 055201-3", "Downloaded from there"]
    kept = ["", None, "[1] Journal 2020", "1. Nature 2020", "(2) Science 2001", "## 2. Nature 2020", "## References", "In 2020 we", "Journal", "article 055201", "J. Phys. 2024", "x" * 100 + " Journal of 2020 et al", "18 things on Page 8 of it"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(noise + kept)], "n int, line string")
    assert [r[0] for r in rows.orderBy("n").select(T.page_noise("line")).collect()] == [True] * len(noise) + [False] * len(kept)


def test_titles(spark):
    docs = {
        "first of either": (["text", "## Odd *name*", "# Later"], "Odd name"), "sections": (["## Abstract", "## Introduction to it", "## Authors", "## Index", "# **The** Title"], "The Title"),
        "page": (["# Smith et al 2020", "# Real"], "Real"), "none": (["#no", "### deep"], "Untitled Paper"), "led": (["  ## In", "# x"], "In"),
    }
    rows = spark.createDataFrame([(d, k, x) for d, (told, _) in docs.items() for k, x in enumerate(told)], "doc string, ln int, line string")
    assert {r.doc: r.title for r in structure.titles(rows).collect()} == {d: t for d, (_, t) in docs.items()}
