"""Nearest neighbours by cosine, set against set, in blocks of vectors multiplied as matrices.

nearest() is exact and compares all blocks with all blocks; nearest_listed() compares each row with the lists of an inverted index
that lie nearest to it, so its work grows with rows x probes x rows a list.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a side that meet at a time; of a row's candidates for its k best in single precision, so many times k at most are worked out one by one.
BLOCK, FEW = 2048, 16
#: Bytes of the left vectors that a task holds, about.
HELD = 32 << 20


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles, a null as no number. All are of one length."""
    n = len(vectors)
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and (m.size % n or np.ptp(np.diff(vectors.offsets.to_numpy()))):
        raise ValueError("vectors are of one length")
    return m.reshape(n, -1)


def _unit_doubles(vectors: pa.Array) -> np.ndarray:
    m = _matrix(vectors)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def best(s: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
    """A mask of each row's k best by similarity rounded to 9 places, then by smaller id."""
    if ids.size <= k:
        return np.ones(s.shape, bool)
    order = np.argsort(ids, kind="stable")
    r = np.floor(s[:, order] * 1e9 + 0.5)
    least = -np.partition(-r, k - 1, axis=1)[:, k - 1 : k]
    over, tie = r > least, r == least
    out = np.empty(s.shape, bool)
    out[:, order] = over | tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - over.sum(axis=1, keepdims=True))
    return out


class _Best:
    """The k best so far of some left rows, as right blocks come: single precision tells which pairs can be among them, doubles decide."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, k: int, above: float) -> None:
        self.ids, self.m, self.k, self.above = ids, m, k, above
        self.small, self.slack = m.astype(np.float32), (m.shape[1] + 8) * 2.0**-23
        self.least = np.full(ids.size, above)
        self.kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))  # row, rounded similarity, id, similarity

    def meet(self, ids: np.ndarray, m: np.ndarray, small: np.ndarray, rows: np.ndarray | None = None) -> None:
        """rows: places of the left rows that meet this block; by default all."""
        at = np.arange(self.ids.size) if rows is None else rows
        s = (self.small if rows is None else self.small[at]) @ small.T
        fit = s >= (self.least[at] - self.slack).astype(np.float32)[:, None]
        many = np.flatnonzero(np.count_nonzero(fit, axis=1) > FEW * self.k)
        fit[many] = False
        parts = [np.nonzero(fit)]
        for a in range(0, many.size, 256):
            some = many[a : a + 256]
            t = self.m[at[some]] @ m.T
            t[(self.ids[at[some]][:, None] == ids) | np.isnan(t)] = -np.inf
            r, c = np.nonzero(best(t, self.k, ids) & (t > self.above))
            parts.append((some[r], c))
        row, col = (np.concatenate(x) for x in zip(*parts))
        exact = np.einsum("ij,ij->i", self.m[at[row]], m[col])
        good = (exact > self.above) & (self.ids[at[row]] != ids[col])
        if good.any():
            found = (at[row][good], np.floor(exact[good] * 1e9 + 0.5), ids[col][good], exact[good])
            self.keep(*(np.concatenate(x) for x in zip(self.kept, found)))

    def keep(self, row: np.ndarray, rounded: np.ndarray, ids: np.ndarray, exact: np.ndarray) -> None:
        order = np.lexsort((ids, -rounded, row))
        row = row[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(row.size) - np.repeat(first, np.diff(np.append(first, row.size)))
        stays = place < self.k
        self.kept = (row[stays], *(x[order][stays] for x in (rounded, ids, exact)))
        last = place == self.k - 1
        self.least[row[last]] = np.maximum(self.above, (rounded[order][last] - 1) / 1e9)


def _ranked(left: DataFrame, right: DataFrame, cells: int, k: int, above: float, meets: Callable[[np.ndarray, int], np.ndarray] | None = None, groups: int = 1) -> DataFrame:
    """The k best of each left row, by (cell, id, v) of the left and (cell, list, id, v) of the right.

    A cell's rows are dealt to one task and come sorted, left ones first: these are held, in chunks of BLOCK rows, and right ones pass by in blocks of
    at most BLOCK, so a task holds the left rows of one cell. With meets, which gives the lists of each left vector among a cell's (every one of `groups`), only rows with a block's list meet it.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, lists = None, [], []

        def results() -> Iterator[pa.RecordBatch]:
            for x in held:
                row, _, ids, exact = x.kept
                yield pa.RecordBatch.from_arrays([pa.array(x.ids[row]), pa.array(ids), pa.array(exact)], ["id", "neighbour", "similarity"])

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "list")])
            for a, z in _runs(key):
                if key[0, a] != cell:
                    yield from results()
                    cell, held, lists = key[0, a], [], []
                part = batch.slice(a, z - a)
                ids, m = part.column("id").to_numpy(), _unit_doubles(part.column("v"))
                if key[1, a] < 0:
                    held.append(_Best(ids, m, k, above))
                    if meets:
                        lists.append(meets(m, int(cell)))
                    continue
                small = m.astype(np.float32)
                for x, own in zip(held, lists or [None] * len(held)):
                    rows = None if own is None else np.flatnonzero(own[:, key[1, a] // groups])
                    if rows is None or rows.size:
                        x.meet(ids, m, small, rows)
        yield from results()

    both = left.select("cell", F.lit(-1).alias("list"), "id", "v").unionByName(right.select("cell", "list", "id", "v"))
    # a number of partitions of its own, and few cells that share one: small cells are much work, and are not to be put together
    dealt = both.repartition(4 * cells, "cell").sortWithinPartitions("cell", "list")
    found = dealt.mapInArrow(multiply, "id bigint, neighbour bigint, similarity double")
    order = W.partitionBy("id").orderBy(F.round("similarity", 9).desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of stretches of BLOCK rows or less whose keys are equal."""
    ends = np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1
    for a, z in zip([0, *ends], [*ends, key.shape[1]]):
        yield from ((b, min(b + BLOCK, z)) for b in range(a, z, BLOCK))


def _rows(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))


def _grid(spark: SparkSession, n_left: int, n_right: int, dims: int, block: int) -> tuple[int, int]:
    """Groups of left and of right rows. Each row goes to all groups of the other side, so cells are about as many as keep all cores at work, and
    more only where a left group would pass HELD bytes."""
    cells = 4 * spark.sparkContext.defaultParallelism
    most_left, most_right = (max(1, -(-n // block)) for n in (n_left, n_right))
    lefts = min(most_left, math.ceil(math.sqrt(cells * n_left / max(1, n_right))), cells)
    lefts = max(1, lefts, math.ceil(n_left * dims * 4 / HELD))
    return lefts, max(1, min(most_right, math.ceil(cells / lefts)))


def _dims(rows: DataFrame) -> int:
    first = rows.select(F.size("v")).first()
    return first[0] if first else 1


def nearest(left: DataFrame, right: DataFrame, k: int = 3, above: float = 0.4, id_col: str = "id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """id, neighbour, similarity, rank: each left row's k nearest right rows of another id with similarity over `above`.

    Groups of the left meet groups of the right, each pair in a task of its own, which returns k rows a left row at most. `block`: rows of a group at least.
    """
    a, b = (_rows(d, id_col, vector_col) for d in (left, right))
    lefts, rights = _grid(left.sparkSession, a.count(), b.count(), _dims(a), block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = a.select("*", every(rights).alias("r")).select((hashed(lefts) * rights + F.col("r")).alias("cell"), "id", "v")
    return _ranked(spread, b.select("*", every(lefts).alias("l")).select((F.col("l") * rights + hashed(rights)).alias("cell"), F.lit(0).alias("list"), "id", "v"), lefts * rights, k, above)


#: Rows that the lists' centres are fitted on, about, by hash; rows a list, about; lists at most; rounds of their fit.
SAMPLE, LIST_ROWS, MOST_LISTS, ROUNDS = 20_000, 1000, 4096, 12
#: The share of true neighbours that a query's lists must hold, as measured by brute force on about so many queries.
RECALL, MEASURED = 0.95, 500


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), np.float32(1e-30))


def centres(rows: DataFrame, id_col: str = "id", vector_col: str = "embedding", sample: int = SAMPLE, list_rows: int = LIST_ROWS) -> np.ndarray:
    """Unit centres of lists, by spherical k-means over `sample` to twice `sample` rows, chosen by a hash of their ids: the same rows give the same centres."""
    some = rows.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    n = some.count()
    chosen = some.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // sample))) == 0).limit(2 * sample)  # the limit only binds where ids repeat
    pdf = chosen.toPandas().sort_values("id", kind="stable")
    m = _unit(pdf["v"]) if len(pdf) else np.zeros((0, 0), np.float32)
    m = m[np.isfinite(m).all(axis=1)]
    found = m[np.random.default_rng(0).permutation(len(m))[: max(1, min(MOST_LISTS, n // list_rows, len(m)))]]
    if not len(found):
        return found
    for _ in range(ROUNDS):
        nearest_one = np.concatenate([(m[a : a + BLOCK] @ found.T).argmax(axis=1) for a in range(0, len(m), BLOCK)])
        sums = np.zeros_like(found)
        np.add.at(sums, nearest_one, m)
        held = np.bincount(nearest_one, minlength=len(found))[:, None] > 0
        found = np.where(held, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), np.float32(1e-30)), found)
    return found


def _lists(m: np.ndarray, found: np.ndarray, probes: int) -> np.ndarray:
    """A mask of the `probes` lists nearest to each unit vector."""
    s = m.astype(np.float32) @ found.T
    out = np.zeros(s.shape, bool)
    np.put_along_axis(out, np.argpartition(-s, probes - 1, axis=1)[:, :probes], True, axis=1)
    return out


def _listed(rows: DataFrame, id_col: str, vector_col: str, found: np.ndarray, probes: int, groups: int) -> DataFrame:
    """r, list, id, v: each row with its nearest list and that list's group (probes of 0), or with every group that has one of its `probes` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                own = _lists(_unit_doubles(part.column("v")), found, max(probes, 1))
                if probes:
                    row, r = np.nonzero(np.stack([own[:, g::groups].any(axis=1) for g in range(groups)], axis=1))
                    at = np.full(row.size, -1)
                else:
                    row, at = np.nonzero(own)
                    r = at % groups
                again = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(at, pa.int32()), again.column("id"), again.column("v")], ["r", "list", "id", "v"])

    return _rows(rows, id_col, vector_col).mapInArrow(run, "r int, list int, id bigint, v array<float>")


def enough_probes(left: DataFrame, right: DataFrame, found: np.ndarray, k: int = 3, above: float = 0.4, id_col: str = "id", vector_col: str = "embedding", recall: float = RECALL, queries: int = MEASURED) -> int:
    """How many lists a query must read so that they hold `recall` of the true neighbours of about `queries` rows, found by brute force over all rows."""
    rows = [d.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")) for d in (left, right)]
    some = rows[0].filter(F.pmod(F.xxhash64("id"), F.lit(max(1, rows[0].count() // queries))) == 0).limit(2 * queries)
    true = nearest(some, rows[1], k, above, "id", "v").select("id", "neighbour")
    both = true.join(some, "id").join(rows[1].select(F.col("id").alias("neighbour"), F.col("v").alias("w")), "neighbour").select("v", "w").limit(4 * queries * k).toPandas()
    if not len(both):
        return 1
    s, held = _unit(both["v"]) @ found.T, (_unit(both["w"]) @ found.T).argmax(axis=1)
    place = np.sort((s > s[np.arange(len(s)), held][:, None]).sum(axis=1))
    return int(place[math.ceil(recall * len(place)) - 1]) + 1


def nearest_listed(left: DataFrame, right: DataFrame, k: int = 3, above: float = 0.4, id_col: str = "id", vector_col: str = "embedding", probes: int | None = None, block: int = BLOCK, found: np.ndarray | None = None) -> DataFrame:
    """As nearest(), over every row of both sides, but each left row meets only the `probes` lists nearest to it, by default enough_probes().

    With probes of at least the number of lists the result is that of nearest(). The tests hold its recall at 0.9 or more. Vectors
    are of one length; rows without id or vector take no part. A hot list is cut into blocks, on both sides.
    """
    found = centres(right, id_col, vector_col) if found is None else found
    if not len(found):
        return left.sparkSession.createDataFrame([], "id bigint, neighbour bigint, similarity double, rank int")
    probes = enough_probes(left, right, found, k, above, id_col, vector_col) if probes is None else probes
    probes = min(probes, len(found))
    a, b = (_rows(d, id_col, vector_col) for d in (left, right))
    lefts, rights = _grid(left.sparkSession, a.count(), b.count(), found.shape[1], block)
    rights = min(rights, len(found))
    hashed = F.pmod(F.xxhash64("id"), F.lit(lefts)).cast("int")
    spread = _listed(left, id_col, vector_col, found, probes, rights).select((hashed * rights + F.col("r")).alias("cell"), "id", "v")
    again = F.explode(F.sequence(F.lit(0), F.lit(lefts - 1)))
    held = _listed(right, id_col, vector_col, found, 0, rights).select("*", again.alias("l")).select((F.col("l") * rights + F.col("r")).alias("cell"), "list", "id", "v")
    return _ranked(spread, held, lefts * rights, k, above, lambda m, cell: _lists(m, found, probes)[:, cell % rights :: rights], rights)
