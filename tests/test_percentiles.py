"""Nearest-rank percentiles against a sorted list."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import evaluate


@pytest.mark.parametrize("kind", ["spread", "ties", "magnitudes", "whole"])
def test_percentiles_against_sorting(spark, monkeypatch, kind):
    monkeypatch.setattr(evaluate, "FEW", 20)
    monkeypatch.setattr(evaluate, "CUTS", 10)
    draw = random.Random(kind)
    values = {
        "spread": [draw.random() for _ in range(5000)], "ties": [float(draw.choice([1, 1, 1, 2, 7])) for _ in range(3000)] + [draw.random() for _ in range(500)],
        "magnitudes": [draw.choice([-1, 1]) * 10.0 ** draw.randrange(-300, 300) for _ in range(3000)], "whole": [draw.randrange(10**15) for _ in range(3000)],
    }[kind]
    rows = spark.createDataFrame([(x,) for x in [*values, None]], f"x {'long' if kind == 'whole' else 'double'}")
    shares = {"a": 0.0, "b": 0.001, "c": 0.5, "d": 0.95, "e": 1.0}
    got = evaluate.percentiles(rows, "x", shares).first()
    assert tuple(got) == tuple(sorted(values)[max(1, math.ceil(s * len(values))) - 1] for s in shares.values())


def test_no_values(spark):
    assert tuple(evaluate.percentiles(spark.range(0).select(F.col("id").alias("x")), "x").first()) == (None, None)
    assert tuple(evaluate.percentiles(spark.range(1), "id").first()) == (0, 0)
