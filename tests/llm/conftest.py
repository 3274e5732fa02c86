import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, recipe string, spans string, fp string, score string, size string, cum string"


@pytest.fixture(scope="session")
def documents():
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    draw = random.Random(5)
    words = ["alpha", "beta", "Gamma", "été", "中文", "don't", "x1", "--", "password=hunter22", "a@b.example", "+49 30 1234567"]
    texts = [None, "", "   \n\t", "one", "two words", "A b\tC\nd"]
    texts += [" ".join(draw.choices(words, k=draw.randrange(1, 60))) for _ in range(40)]
    texts.append(" ".join(draw.choices(words, k=6000)))
    texts += [texts[10], texts[10].replace(" ", "  "), texts[11] + " ", texts[12].upper()]
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None) for k, t in enumerate(texts, 1)]
    rows.append(rows[20])
    return [(*r, "a", "b", "c", "d", "e", "f", "g") for r in rows]


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
