"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

Each text is normalised (ASCII white space deleted) and cut where its own content says so: a chunk has
CHUNK_MIN characters at least and ends at the next boundary character, or at CHUNK_MAX. A chunk's identifier is its
64-bit hash, verified against the content: distinct (hash, content) rows are counted, and hashes that stand
for more than one content get an ordinal beside the hash. A text's recipe is the ordered list of its chunks'
identifiers; two texts are equal when their recipes are. Chunks cross the network once (each task sends its distinct
chunks), documents never do: after the first pass all work is on recipes.

Defined results: a null text counts as empty; a null doc_id is one id, after all others; all empty texts are equal to one another; rows that repeat a doc_id
carry the same verdict if their texts are equal, count once each in group_size, and share `kept`, while drop_exact_duplicates keeps one row of them;
an empty table gives an empty table; texts of any length are chunked whole; ids may be any bigint; other
columns are ignored, and names such as `recipe` or `kept` may be among them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import ROW, discard, materialise, one_of_each, row_key, text_or_empty

CHUNK_MIN, CHUNK_MAX = 256, 4096
#: A chunk may end after one of these: sentence ends of several scripts, and some digits and letters, for texts without.
BOUNDARY = r"[.!?;|。！？।؟]"
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def chunks(norm: Column) -> Column:
    """Every character of norm, in order, in chunks; no chunk for the empty text."""
    pattern = rf"(?s).{{{CHUNK_MIN - 1},{CHUNK_MAX - 1}}}?{BOUNDARY}|.{{1,{CHUNK_MAX}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, id_col: str, text_col: str, identifier: Callable[[Column], Column], carried: list[Column]) -> DataFrame:
    """doc_id, n_points, sha, recipe and carried columns, each text read once; identifiers verified.

    A recipe is its chunks' identifiers in order, and for identifiers that stand for several contents the numbers of theirs by place.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("__text"), *carried)
    carried = [c for c in base.columns if c in ROW]
    cut = base.select("*", normalised(F.col("__text")).alias("__norm")).select("*", chunks(F.col("__norm")).alias("__chunks"))
    no_patch = F.array().cast("array<struct<pos:int,n:int>>")
    recipe = lambda patch: F.struct(F.transform("__chunks", lambda c: identifier(c)).alias("chunks"), patch.alias("patch")).alias("recipe")
    told = ["doc_id", F.length("__text").cast("long").alias("n_points"), F.sha2(F.col("__norm").cast("binary"), 256).alias("sha")]
    digest = materialise(cut.select(*told, recipe(no_patch), *carried), "recipes")
    # distinct (identifier, content): a hash aggregate on both sides of one shuffle
    distinct = cut.select(F.explode("__chunks").alias("chunk")).select(identifier(F.col("chunk")).alias("h"), "chunk").distinct()
    clashing = materialise(distinct.groupBy("h").count().filter("count > 1").select("h"), "clashes")
    if clashing.isEmpty():
        discard(spark, clashing)
        return digest
    # The exact way for hashes that stand for several contents: number the contents, and put the numbers into recipes.
    rows = cut.select("doc_id", F.xxhash64("__text").alias("t"), F.posexplode("__chunks").alias("pos", "chunk")).withColumn("h", identifier(F.col("chunk")))
    hit = rows.join(clashing, "h", "left_semi")
    numbers = hit.select("h", "chunk").distinct().withColumn("n", F.row_number().over(W.partitionBy("h").orderBy("chunk")))
    patch = hit.join(numbers, ["h", "chunk"]).select("doc_id", "t", F.struct("pos", "n").alias("p")).distinct().groupBy("doc_id", "t").agg(F.array_sort(F.collect_list("p")).alias("patch"))
    patch = patch.withColumnsRenamed({"doc_id": "p_id", "t": "p_t"})
    joined = cut.join(patch, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.xxhash64("__text") == F.col("p_t")), "left")
    discard(spark, digest)
    return materialise(joined.select(*told, recipe(F.coalesce("patch", no_patch)), *carried), "recipes")


def groups(digest: DataFrame) -> DataFrame:
    """One row for each distinct recipe: partial aggregation keeps a hot group from moving. best.doc_id: the row that stays; ROW beside it, if carried."""
    carried = [c for c in ROW if c in digest.columns]
    best = F.min(F.struct((-F.col("n_points")).alias("fewest"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", *carried))
    found = digest.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    return found.select("recipe", F.col("best.doc_id").alias("keep_id"), "group_size", *[F.col(f"best.{c}").alias(c) for c in carried])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifier: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and n_points, for every row of docs.

    The join reads two written tables, so both of its sides have an exchange of their own and a hot recipe's rows are
    split by adaptive execution.
    """
    digest = recipes(docs, id_col, text_col, identifier, [])
    keep = materialise(groups(digest), "groups")
    return digest.join(keep, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "n_points")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all columns of docs: the one of the most code points, then of the smallest id
    (null after all others), then of the smaller row hash. Decided by row: ids may repeat or be null."""
    digest = recipes(docs, id_col, text_col, F.xxhash64, row_key(docs))
    chosen = materialise(groups(digest).select(*ROW), "kept")
    return one_of_each(docs, chosen, digest)
