"""Exact top-k inner products by vector-approximation files.

Vectors are dealt to blocks of about BLOCK rows. An approximation file holds, for each block and dimension, BINS equal cells over the block's own range,
and each vector's cells, one byte a dimension. The first pass reads those only: they give the highest and lowest score that each
vector can have, and a vector whose highest is below a query's k-th best lowest is out. The second pass reads exact vectors for what is
left, by (block, place). Queries come in blocks too; a task carries each query's bounds from one block to the next.

Components are whole numbers (floor(scale * x)), so scores are exact. Ties go to the smaller id. Where a vector is so large that a score of it could
leave the whole numbers of a double (ROOM), its scores are worked out in whole numbers of any size instead, block by block: those of large queries with all
vectors, and of the other queries with large vectors. Such a task keeps each query's k best only.

Defined results: vectors that are null or hold null or non-finite components take no part, nor rows with a null id; a
query sees every row but those with its own id; queries that share an id are one query, whose list is the best of both; vectors of another length than the query's are not
compared; repeated rows are candidates each, but one query; fewer than k candidates give fewer rows; an empty table gives no rows; a score beyond 64 bits counts
as the nearest that they hold; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import fractions
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import few_rows_a_batch, materialise

BLOCK, QUERY_BLOCK, BINS, LARGE_BLOCK = 2048, 512, 256, 256
ROOM = float(1 << 50)
#: Queries whose best rows a task holds before it sends them on.
HELD = 100_000
FILE = "n_dims int, block bigint, ids binary, low binary, width binary, cells binary"


def fitting(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x (array of double) of the rows that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fit = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(finite)
    return fit.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("x"))


def is_large(scale: int) -> Column:
    """Could a score of two vectors like this one leave the whole numbers that a double holds, with room for bounds. Vectors without components have no cells either."""
    most = F.coalesce(F.array_max(F.transform("x", F.abs)), F.lit(0.0)) * scale + 1
    return (F.size("x") == 0) | (F.size("x") * most * most >= ROOM)


def whole(rows: DataFrame, scale: int) -> DataFrame:
    """id and v (array of bigint) from id and x."""
    return rows.select("id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def first_of_equals(rows: DataFrame, k: int) -> DataFrame:
    """rows without those that no query can list: of equal vectors, only the k + 1 smallest ids (one may be the query's own), each k times at
    most, can be among the k best. A hot vector is cut within each task before it moves."""
    ids, copies = W.partitionBy("v").orderBy("id"), W.partitionBy("v", "id").orderBy("id")
    near = rows.withColumn("at", F.dense_rank().over(ids)).filter(F.col("at") <= k + 1)
    return near.withColumn("at", F.row_number().over(copies)).filter(F.col("at") <= k).select("id", "v")


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, exact at any size."""
    return np.array([int(scale * fractions.Fraction(v) // 1) for v in x.tolist()], object)


def exact_scores(asked: DataFrame, rows: DataFrame, k: int, scale: int) -> DataFrame:
    """query_id, vec_id, score: the k best rows (id, x) of each query (id, x), in whole numbers of any size, blocks of queries against blocks of rows."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = max(1, -(-df.count() // LARGE_BLOCK))
        dealt = df.select(F.size("x").alias("n_dims"), F.pmod(F.xxhash64("id", "x", F.monotonically_increasing_id()), F.lit(n)).alias("block"), "id", "x")
        return dealt.groupBy("n_dims", "block").agg(F.collect_list(F.struct("id", "x")).alias(name)).drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, others in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = [r["id"] for r in others]
                table = [whole_numbers(np.array(r["x"]), scale) for r in others]
                out = []
                for q in queries:
                    mine = whole_numbers(np.array(q["x"]), scale)
                    found = ((int(mine @ v) if v.size else 0, i) for v, i in zip(table, ids) if i != q["id"])
                    told = sorted(((-min(max(s, -(1 << 63)), (1 << 63) - 1), i) for s, i in found))[:k]
                    out += [(q["id"], i, -s) for s, i in told]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    met = blocks(asked, "queries").join(blocks(rows, "others"), "n_dims").select("queries", "others")
    with few_rows_a_batch(asked.sparkSession, 1):
        return materialise(met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint"), "large")


def approximation_file(rows: DataFrame, block_rows: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """For rows (id, v): one row of cells for each block of rows, and the exact vectors by (n_dims, block, place)."""
    n_blocks = max(1, -(-rows.count() // block_rows))
    # the vector is part of the hash: rows that repeat an id spread over blocks
    dealt = rows.select(F.size("v").alias("n_dims"), F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(n_blocks)).alias("block"), "id", "v")
    dealt = materialise(dealt.withColumn("place", F.row_number().over(W.partitionBy("n_dims", "block").orderBy("id", "v")) - 1), "exact")
    whole_rows = pa.schema([("n_dims", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "low", "width", "cells"))])

    def build(group: pa.Table) -> pa.Table:
        n_dims = group["n_dims"][0].as_py()
        order = np.argsort(group["place"].to_numpy())
        exact = pa.concat_arrays([c.flatten() for c in group["v"].chunks]).to_numpy().reshape(-1, n_dims)[order]
        low = exact.min(axis=0)
        width = np.maximum(1, -(-(exact.max(axis=0) - low + 1) // BINS))
        cells = ((exact - low) // width).astype(np.uint8)
        row = {"n_dims": n_dims, "block": group["block"][0].as_py(), "ids": group["id"].to_numpy()[order].tobytes(), "low": low.tobytes(), "width": width.tobytes(), "cells": cells.tobytes()}
        return pa.Table.from_pylist([row], schema=whole_rows)

    cells = dealt.groupBy("n_dims", "block").applyInArrow(build, FILE)
    return materialise(cells, "approximation"), dealt


class Bounds:
    """The candidates so far of the queries of one block: rows whose highest possible score reaches the k-th best certain one."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.q = q.astype(np.float64)
        self.certain: list[np.ndarray] = [np.zeros(0)] * ids.size  # the k best lower bounds
        self.held: list[np.ndarray] = [np.zeros((3, 0))] * ids.size  # upper bounds, blocks, places

    def scan(self, block: int, ids: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> None:
        # a score lies between its value at the cells' middles and that plus or minus the query's reach over half a cell
        half = (width - 1) / 2
        middle = self.q @ (cells * width.astype(np.float64)).T + (self.q @ (low + half))[:, None]
        reach = (np.abs(self.q) @ half)[:, None]
        for at in range(self.ids.size):
            most, own = middle[at] + reach[at], ids == self.ids[at]
            if own.any():
                most = np.where(own, -np.inf, most)
            best = np.concatenate([self.certain[at], most - 2 * reach[at]])
            if best.size > self.k:
                best = np.partition(best, best.size - self.k)[best.size - self.k :]
            self.certain[at] = best
            some = np.flatnonzero((most >= self.bar(at)) & (most > -np.inf))
            if some.size:
                held = np.hstack([self.held[at], [most[some], np.full(some.size, block), some]])
                self.held[at] = held[:, held[0] >= self.bar(at)]

    def bar(self, at: int) -> float:
        # bounds are sums of halves, exact in doubles
        return self.certain[at].min() if self.certain[at].size == self.k else -np.inf


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows. queries: which rows are queries.

    First pass: each block of queries scans the cells of every block of vectors, and a task keeps each query's candidates. The k-th best lower bound of a
    query over all tasks then rules out most of them. Second pass: exact vectors are read for what is left only,
    by (block, place).
    """
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    fit, asking = fitting(vectors, id_col, vector_col), fitting(vectors.filter(queries), id_col, vector_col)
    scored = _by_cells(fit.filter(~is_large(scale)), asking.filter(~is_large(scale)), k, scale)
    large = fit.filter(is_large(scale))
    if not large.isEmpty():
        asking = asking.dropDuplicates(["id", "x"])
        scored = scored.unionByName(exact_scores(asking.filter(is_large(scale)), fit, k, scale)).unionByName(exact_scores(asking.filter(~is_large(scale)), large, k, scale))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _by_cells(fit: DataFrame, asking: DataFrame, k: int, scale: int) -> DataFrame:
    """query_id, vec_id, score of the rows that may be among each query's k best."""
    spark = fit.sparkSession
    rows = materialise(first_of_equals(whole(fit, scale), k), "vectors")
    files, exact = approximation_file(rows)
    asked = whole(asking, scale).dropDuplicates(["id", "v"])
    n_parts = max(1, -(-asked.count() // QUERY_BLOCK))
    # a query's number tells vectors of one id apart
    asked = materialise(asked.select(F.size("v").alias("n_dims"), F.pmod(F.xxhash64("id", "v"), F.lit(n_parts)).alias("part"), "id", "v", F.xxhash64("v").alias("q_hash")), "asked")
    parts = pa.schema([("n_dims", pa.int32()), ("part", pa.int64()), ("q_ids", pa.binary()), ("q_hash", pa.binary()), ("q", pa.binary())])

    def pack(group: pa.Table) -> pa.Table:
        q = pa.concat_arrays([c.flatten() for c in group["v"].chunks]).to_numpy()
        row = {"n_dims": group["n_dims"][0].as_py(), "part": group["part"][0].as_py(), "q_ids": group["id"].to_numpy().tobytes(), "q_hash": group["q_hash"].to_numpy().tobytes(), "q": q.tobytes()}
        return pa.Table.from_pylist([row], schema=parts)

    packed = asked.groupBy("n_dims", "part").applyInArrow(pack, "n_dims int, part bigint, q_ids binary, q_hash binary, q binary")
    blocks = files.select("n_dims", "block")
    # each block of queries goes to each block of vectors: the query set is stated, and the vectors do not move again
    meetings = packed.join(blocks, "n_dims").join(files, ["n_dims", "block"])
    ordered = meetings.sortWithinPartitions("n_dims", "part").select("n_dims", "part", "q_ids", "q_hash", "q", "block", "ids", "low", "width", "cells")

    names, kinds = ["n_dims", "query_id", "q_hash", "bar", "most", "block", "place"], [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[Bounds, np.ndarray]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for (n, _), (bounds, hashes) in held.items():
                for at, query in enumerate(bounds.ids.tolist()):
                    most, block, place = bounds.held[at]
                    same = [np.full(most.size, x) for x in (n, query, hashes[at], bounds.bar(at))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*same, most, block.astype(np.int64), place.astype(np.int32)], kinds)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                n, key = r["n_dims"], (r["n_dims"], r["part"])
                if key not in held:
                    if sum(b.ids.size for b, _ in held.values()) >= HELD:
                        yield from send()
                        held.clear()
                    ids = np.frombuffer(r["q_ids"], np.int64)
                    held[key] = Bounds(ids, np.frombuffer(r["q"], np.int64).reshape(-1, n), k), np.frombuffer(r["q_hash"], np.int64)
                held[key][0].scan(r["block"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["low"], np.int64), np.frombuffer(r["width"], np.int64), np.frombuffer(r["cells"], np.uint8).reshape(-1, n))
        yield from send()

    # a row of a meeting is some hundred KB: few a batch, for this pass alone
    with few_rows_a_batch(spark, 8):
        near = materialise(ordered.mapInArrow(run, "n_dims int, query_id bigint, q_hash bigint, bar double, most double, block bigint, place int"), "candidates")
    bar = near.groupBy("n_dims", "query_id", "q_hash").agg(F.max("bar").alias("least"))
    left = near.join(bar, ["n_dims", "query_id", "q_hash"]).filter("most >= least").select("n_dims", "query_id", "q_hash", "block", "place")
    query = asked.select("n_dims", F.col("id").alias("query_id"), "q_hash", F.col("v").alias("q"))
    both = left.join(exact, ["n_dims", "block", "place"]).join(query, ["n_dims", "query_id", "q_hash"])
    score = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    return both.select("query_id", F.col("id").alias("vec_id"), score.alias("score"))
