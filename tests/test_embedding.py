"""The hashed embedding: equal in Spark and Python, near for near texts, and enough to run the vector channels."""

import math

import pytest
from pyspark.sql import functions as F

from marginalia.functions import embedding
from marginalia.functions import vectors as V

TEXTS = [None, "", "  --  ", "One", "one two three", "One, two;  three!", "Größe und Maß", "中文 文本 x1", "a b a b a b", " ".join(f"w{k % 97}" for k in range(5000))]


def test_the_same_in_spark_and_python(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    got = {r.id: list(r.embedding) for r in embedding.hashed(rows, "k", "t").collect()}
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        assert got[k] == pytest.approx(embedding.vector(text), abs=1e-12)
        assert math.isclose(sum(x * x for x in got[k]), 1.0 if k > 2 else 0.0, abs_tol=1e-9)
    assert got[4] == got[5] and embedding.hashed(rows.limit(0), "k", "t").collect() == []
    small = {r.id: list(r.embedding) for r in embedding.hashed(rows, "k", "t", dims=8, grams=3).collect()}
    assert small[9] == pytest.approx(embedding.vector(TEXTS[9], 8, 3), abs=1e-12)


def test_near_texts_are_near(spark):
    base = [f"word{k}" for k in range(100)]
    texts = {0: base, 1: [*base[:90], *[f"other{k}" for k in range(10)]], 2: [f"far{k}" for k in range(100)]}
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "k int, t string")
    told = embedding.hashed(rows, "k", "t")
    asked = F.array(*map(F.lit, embedding.vector(" ".join(base))))
    score = {r.id: r.s for r in told.select("id", V.cosine(F.col("embedding"), asked).alias("s")).collect()}
    assert score[0] == pytest.approx(1) and score[1] > 0.75 and abs(score[2]) < 0.3
