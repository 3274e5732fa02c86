"""A deterministic embedding without a model: signed feature hashing of word n-grams, the same in Spark and in Python.

Words are runs of letters and digits in lower case; n-grams of 1 to GRAMS words are hashed by XXH64 (seed 42). The hash's lowest bits give the dimension, its
highest bit the sign. Sums are divided by their length, so the inner product of two embeddings is their cosine.

Defined results: a null text and one without words have the zero vector; equal texts have equal vectors, in Spark and in Python.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS, GRAMS, SEED = 256, 2, 42
#: Fixed value: what parts words, as the full-text terms have it.
APART = r"[^\p{L}\p{N}]+"


def grams_of(text: Column, grams: int = GRAMS) -> Column:
    """All n-grams of 1 to `grams` words, repeats included."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), APART), lambda w: w != "")

    def runs(words: Column, n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.array_join(F.slice(words, k, n), " "))

    def of(words: Column) -> Column:
        return F.concat(words, *[runs(words, n) for n in range(2, grams + 1)])

    return F.element_at(F.transform(F.array(words), of), 1)


def hashed(rows: DataFrame, id_col: str, text_col: str, dims: int = DIMS, grams: int = GRAMS) -> DataFrame:
    """id, embedding (array of double, of length 1) for every id of rows; rows that share an id are one text, in sum. In the JVM, with partial sums."""
    told = rows.select(F.col(id_col).alias("id"), F.explode(grams_of(F.col(text_col), grams)).alias("gram")).select("id", F.xxhash64("gram").alias("h"))
    sums = told.groupBy("id", F.pmod("h", F.lit(dims)).cast("int").alias("at")).agg(F.sum(F.when(F.col("h") < 0, -1).otherwise(1)).alias("n"))
    vectors = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("n"), F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("length"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.when(F.col("length") > 0, F.coalesce(F.try_element_at("n", k), F.lit(0)) / F.col("length")).otherwise(0.0))
    ids = rows.select(F.col(id_col).alias("id")).distinct()
    return ids.join(vectors.select("id", spread.alias("embedding")), "id", "left").select("id", F.coalesce("embedding", F.array_repeat(F.lit(0.0), dims)).alias("embedding"))


def vector(text: str | None, dims: int = DIMS, grams: int = GRAMS) -> list[float]:
    """The same of one text, for a query."""
    import regex
    import xxhash

    words = [w for w in regex.split(APART, (text or "").lower()) if w]
    counts: Counter[int] = Counter()
    for n in range(1, grams + 1):
        for k in range(len(words) - n + 1):
            h = xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), SEED)
            signed = h - (1 << 64) if h >> 63 else h
            counts[signed % dims] += -1 if signed < 0 else 1
    length = math.sqrt(sum(x * x for x in counts.values()))
    return [counts[k] / length if length else 0.0 for k in range(dims)]
