"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order (by md5 of doc_id), gone through `repeats` times.
A document's virtual finish time is its source's cumulative size up to and with it, divided by the source's target.
All queues are merged by finish time, and the merged order is cut at the total budget. Whole documents are taken.

No prefix sum is taken in one task over a whole source: sizes are summed by (source, hash range) first, ranges are
added up over at most RANGES rows a source, and the rest is a window within one range. The merged order is dealt the
same way, by ranges of virtual time, so only the range in which the budget ends is ordered row by row.

Defined results: a null text has size 0; a null source is a source, after all others; documents of size 0 finish at
their predecessor's time and take 0 words; equal times are ordered by source, md5, doc_id; rows that repeat a doc_id are
documents of their own, ordered within one range; null ids are shuffled by their text; sources of size 0 have target 0; an empty table gives an empty
table; texts of any length are counted whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import ROW, materialise, one_of_each, row_key, text_or_empty

#: Hash ranges of one source: three hexadecimal digits of md5.
RANGE_DIGITS = 3
#: Ranges of virtual time. All targets are met at time 1.
TIME_RANGES = 4096
COPIES = "__marginalia_copies"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: list[int], share_num: int, share_den: int, repeats: int) -> DataFrame:
    """source, source_size, rank_no, target for a table (source, source_size).

    Filling by weight under caps has a closed form: in order of cap / weight, the capped sources are a prefix. Each
    row tests itself against what is left after the caps before it. One row a source; no row of a document is here.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sources.select("*", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).alias("rank_no"))
    w = ranked.withColumn("w", F.element_at(cycle, (F.pmod(F.col("rank_no") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    w = w.filter("source_size > 0").withColumn("cap", F.col("source_size") * repeats)
    order = W.orderBy((F.col("cap") / F.col("w")), "rank_no")
    every = W.partitionBy()
    run = w.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("w_left"),
    )
    # capped: w * (total * share - before) / w_left > cap, in whole numbers
    run = run.withColumn("capped", F.col("w") * (F.col("total") * share_num - F.col("before") * share_den) > F.col("cap") * F.col("w_left") * share_den)
    free = run.select("*", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)).alias("cap_sum"), F.sum(F.when(~F.col("capped"), F.col("w"))).over(every).alias("w_free"))
    shared = (F.col("w") * (F.col("total") * share_num - F.col("cap_sum") * share_den)).cast("double") / (F.col("w_free") * share_den).cast("double")
    full = free.select("rank_no", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))
    return ranked.join(full, "rank_no", "left").select("source", "source_size", "rank_no", F.coalesce("target", F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: list[int], share_num: int = 3, share_den: int = 2, repeats: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carried: Sequence[Column] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (= copies * size) and carried for every row of docs.

    weights: of the sources in code point order, repeated as often as needed. share_num / share_den: the total budget as
    a share of all sizes. repeats: how often a document may be taken.
    """
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("no id "), F.md5(text_or_empty(text_col).cast("binary"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_or_empty(text_col)).alias("size"), F.md5(name.cast("binary")).alias("mark"), *carried)
    carried = rows.columns[4:]
    sized = materialise(rows, "sizes")
    sized = sized.withColumn("part", F.substring("mark", 1, RANGE_DIGITS))
    ranges = materialise(sized.groupBy("source", "part").agg(F.sum("size").alias("range_size")), "ranges")
    shares = materialise(targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share_num, share_den, repeats), "targets")
    # at most 16 ** RANGE_DIGITS rows of one source meet here
    upto = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = materialise(ranges.select("source", "part", F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("base")).join(shares, ranges["source"].eqNullSafe(shares["source"])).select(ranges["source"], "part", "base", "source_size", "rank_no", "target"), "starts")
    key = (sized["source"].eqNullSafe(starts["source"])) & (sized["part"] == starts["part"])
    placed = sized.join(starts, key).select("doc_id", "size", "mark", sized["part"], "base", "source_size", "rank_no", "target", *carried)
    within = W.partitionBy("rank_no", "part").orderBy("mark", "doc_id", "size", *carried).rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = materialise(placed.select("doc_id", "size", "source_size", "rank_no", "target", "mark", *carried, (F.col("base") + F.sum("size").over(within)).alias("cum")), "queued")
    passes = queued.filter("target > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("pass_no"))
    finish = (F.col("source_size") * F.col("pass_no") + F.col("cum")).cast("double") / F.col("target")
    timed = passes.withColumn("finish", finish).withColumn("slot", F.least(F.floor(F.col("finish") * TIME_RANGES), F.lit(TIME_RANGES * (repeats + 2))))
    slots = timed.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    # a row a range of time: TIME_RANGES * (repeats + 2) rows at most
    total = shares.agg(F.sum("source_size").alias("total"))
    cut = slots.select("slot", "slot_size", F.sum("slot_size").over(W.orderBy("slot")).alias("upto")).crossJoin(total)
    budget = F.expr(f"(total * {share_num}) div {share_den}")
    last = cut.withColumn("budget", budget).filter("upto > budget").agg(F.min_by(F.struct("slot", (F.col("budget") - (F.col("upto") - F.col("slot_size"))).alias("left")), "slot").alias("m")).select("m.slot", "m.left").first()
    at, left = (last[0], last[1]) if last and last[0] is not None else (TIME_RANGES * (repeats + 2) + 1, 0)
    fine = W.partitionBy("slot").orderBy("finish", "rank_no", "mark", "doc_id", "size", "pass_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = timed.filter(F.col("slot") == at).select("doc_id", "rank_no", "size", "cum", "mark", "source_size", "target", F.sum("size").over(fine).alias("run")).filter(F.col("run") <= left)
    keys = ["doc_id", "rank_no", "size", "cum"]
    extra = edge.groupBy(*keys).agg(F.count(F.lit(1)).alias("extra"))
    # passes wholly before the last range of time: a count from the row itself
    sure = sum((F.when(F.floor((F.col("source_size") * p + F.col("cum")).cast("double") / F.col("target") * TIME_RANGES) < at, 1).otherwise(0) for p in range(repeats)), F.lit(0))
    out = queued.join(extra.withColumnsRenamed({k: f"x_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"x_{k}")) for k in keys], "left")
    copies = F.when(F.col("target") > 0, sure + F.coalesce("extra", F.lit(0))).otherwise(0).cast("int")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *carried).withColumn("taken", F.col("copies") * F.col("size"))


def mixture(docs: DataFrame, weights: list[int], id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed documents themselves: each row of docs as often as it is taken, decided by row. Rows of size 0 go."""
    told = materialise(mix(docs, weights, id_col=id_col, carried=row_key(docs), **options).select(*ROW, "copies", "size"), "copies")
    taken = told.filter("copies > 0 and size > 0").groupBy(*ROW).agg(F.sum("copies").cast("int").alias(COPIES))
    # a row that repeats in every column stands once here, and takes the copies of all
    once = one_of_each(docs, taken, told, carry=[COPIES])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return once.select(F.explode(F.array_repeat(row, F.col(COPIES))).alias("row")).select("row.*")
