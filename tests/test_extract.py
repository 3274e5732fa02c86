"""Symbols and metadata by rules, through SQL and the DataFrame API."""

import pytest

from marginalia.operators import extract


def test_definitions():
    cases = {
        "Let x denote the rate of decay. It falls.": [("x", "the rate of decay")], "where $\\alpha_i$ is the weight of item $i$, and so on": [("\\alpha_i", "the weight of item $i$")],
        "Denote by N the number of rows; then go.": [("N", "the number of rows")], "The mean over all is denoted by m_k.": [("m_k", "The mean over all")], "Let us be the first. Where is the end": [],
        "where x is the start and y is the end, here z represents an odd one": [("x", "the start and y is the end"), ("z", "an odd one")], "Let  λ  be\na spread": [("λ", "a spread")], "": [], None: [],
        "let it be. x is the best": [],
    }
    for text, want in cases.items():
        assert [(s, d) for s, _, d in extract.definitions(text)] == want, text


def test_articles_are_words():
    for end in ("words with a", "palabras de la", "one of the", "an"):
        assert [x[0::2] for x in extract.definitions(f"{end}\nThe mean of it is denoted by m_k. Go on")] == [("m_k", "The mean of it")], end
    told = "thing and a is a word, and b is a start, where a is the end, and $a$ is the rest"
    assert [x[0::2] for x in extract.definitions(told)] == [("b", "a start"), ("a", "the end"), ("a", "the rest")]
    assert [x[0::2] for x in extract.definitions("data rate is denoted by r, the beta rate is denoted by b.")] == [("b", "the beta rate")]


def test_metadata():
    cases = {
        "Altafini, C. and Beale, J. T. (1984). On the flow of things. Physica D 7, 1999": (1984, ["Altafini", "Beale"], "On the flow of things"),
        'R. C. Budzinski, S. R. Lopes, "Temporal patterns of it all," Phys. Rev. E 99, 2019': (2019, ["Budzinski", "Lopes"], "Temporal patterns of it all"),
        "J.-P. Müller & O'Neil, A. A title without a year": (None, ["Müller", "O'Neil"], "A title without a year"), "": (None, [], None), None: (None, [], None),
    }
    for text, want in cases.items():
        assert extract.metadata(text) == want, text


def test_as_table_functions(spark):
    extract.register(spark)
    spark.createDataFrame([(1, "Let q be a start", "where x is the end."), (2, None, None), (3, "t", "no definition here")], "id int, title string, body string").createOrReplaceTempView("told")
    rows = spark.sql("SELECT t.id, x.symbol, x.description FROM told t, LATERAL extract_symbols(t.title, t.body) x").collect()
    assert sorted(map(tuple, rows)) == [(1, "q", "a start"), (1, "x", "the end")]
    assert sorted((r.id, r.symbol) for r in extract.symbols(spark.table("told"), "id", "title", "body").collect()) == [(1, "q"), (1, "x")]
    raw = spark.createDataFrame([(1, "Beale, J. (1984). A title of it. X"), (2, None)], "id int, raw string")
    assert sorted(map(tuple, extract.reference_metadata(raw, "id", "raw").collect())) == [(1, 1984, ["Beale"], "A title of it"), (2, None, [], None)]
    with pytest.raises(Exception, match="a text is wanted"):
        spark.sql("SELECT x.* FROM told t, LATERAL extract_symbols(t.title, t.id) x").collect()
