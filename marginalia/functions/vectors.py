"""Column functions over array<float> vectors, and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD, LEAST, MOST = 0.40, 0.20, 0.95


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def threshold(x: Column) -> Column:
    """Within [0.20, 0.95]; 0.40 when missing."""
    return F.least(F.greatest(F.coalesce(x, F.lit(THRESHOLD)), F.lit(LEAST)), F.lit(MOST))


def confidence(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def best_score(a: Column, b: Column) -> Column:
    return F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))


def render(v: Column) -> Column:
    return F.to_json(v)


def parse(text: Column) -> Column:
    return F.from_json(text, "array<float>")
