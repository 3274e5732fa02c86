"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within RADIUS = 3 bits meet half way. The 64 bits are cut into three blocks; whatever three bits
differ, some block holds one of them (or none differ), and outside it at most two differ. So every fingerprint
emits, for each block left out, its other bits and all variants of them with one bit flipped: two fingerprints within
the radius then share a variant, and variants have 42 bits or more, so that chance meetings stay rare at any size. Variants
are shuffled, and each task verifies the fingerprints that meet on a variant over all 64 bits. A task keeps what it
finds as a forest, so it returns fewer links than it has fingerprints, however many pairs a hot group has.

Fingerprints are made distinct first: copies never meet one another. Links are joined to components by hooking every
node to its smallest neighbour and contracting, with a table in the shared folder after each round.

Defined results: a null or empty text has fingerprint 0, linked like any other; a null doc_id is one id, after all others; a text of fewer words than a shingle
is one shingle; rows that repeat a doc_id are linked each by their own text; an empty table gives an empty table; texts of any
length are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import ROW, bounded_batches, discard, materialise, one_of_each, row_key

RADIUS, SHINGLE, SEED = 3, 3, 42
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Groups of up to so many fingerprints are compared by shifts of the whole batch, larger ones by a search of their own.
SMALL = 48
#: Shingles hashed at a time, and links held before they are made a forest.
SHINGLES_AT_ONCE, LINKS_AT_ONCE = 1 << 16, 1 << 20


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned 64-bit integer."""
    import xxhash

    digest = xxhash.xxh64_digest
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    a, b = starts[: len(words) - shingle + 1].tolist(), (starts + sizes)[shingle - 1 :].tolist()
    bits = np.zeros(64, np.int64)
    for k in range(0, len(a), SHINGLES_AT_ONCE):
        some = b"".join([digest(joined[x:y], SEED) for x, y in zip(a[k : k + SHINGLES_AT_ONCE], b[k : k + SHINGLES_AT_ONCE])])
        bits += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(a)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carried: Sequence[Column] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed bigint) and carried (bigint columns) for every row of docs."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carried)
    names = ["doc_id", "fp", *rows.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x or "", shingle) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def balls() -> list[tuple[int, int]]:
    """(kept bits, flipped bits and the block's mark) of each variant."""
    out = []
    for k, (a, b) in enumerate(BLOCKS):
        block = ((1 << b) - 1) ^ ((1 << a) - 1)
        mark = (k + 1) << a
        out += [(signed(~block & (1 << 64) - 1), signed(flip ^ mark)) for flip in (0, *(1 << i for i in range(64) if not a <= i < b))]
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components by links from each node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, up = at[: a.size], at[a.size :], np.arange(nodes.size)
    while True:
        x, y = up[u], up[v]
        if (x == y).all():
            break
        low = np.minimum(x, y)
        np.minimum.at(up, x, low)
        np.minimum.at(up, y, low)
        while not np.array_equal(further := up[up], up):
            up = further
    moved = np.flatnonzero(up != np.arange(nodes.size))
    return nodes[moved], nodes[up[moved]]


class Links:
    def __init__(self) -> None:
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.n = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if a.size:
            self.a.append(a)
            self.b.append(b)
            self.n += a.size
            if self.n > LINKS_AT_ONCE:
                a, b = self.close()
                self.a, self.b, self.n = [a], [b], 0

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return forest(np.concatenate(self.a), np.concatenate(self.b))


def spread(fp: np.ndarray, links: Links) -> None:
    """Links one large group: from each fingerprint reached, to those not reached yet."""
    left = np.unique(fp)
    while left.size:
        queue, left = [left[:1]], left[1:]
        while queue and left.size:
            seeds = queue.pop()
            for seed in seeds:
                near = np.bitwise_count(left ^ seed) <= RADIUS
                if near.any():
                    found, left = left[near], left[~near]
                    links.add(np.full(found.size, seed), found)
                    queue.append(found)


def meet(key: np.ndarray, fp: np.ndarray, links: Links) -> None:
    """Verifies whole groups of rows, in order of key."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, key.size))
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        spread(fp[s : s + n], links)
    few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    key, fp = key[few], fp[few]
    for shift in range(1, min(SMALL, key.size)):
        at = np.flatnonzero(key[shift:] == key[:-shift])
        if not at.size:
            break
        a, b = fp[at], fp[at + shift]
        near = np.bitwise_count(a ^ b) <= RADIUS
        links.add(a[near], b[near])


def whole_groups(batches: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """Arrays in order of the first, cut so that no value of the first is in two of the pieces given."""
    held: list[tuple[np.ndarray, ...]] = []
    for some in batches:
        if not some[0].size:
            continue
        if some[0][0] == some[0][-1] and (not held or held[-1][0][-1] == some[0][0]):
            held.append(some)  # still inside one large group
            continue
        cut = int(np.searchsorted(some[0], some[0][-1]))
        held.append(tuple(x[:cut] for x in some))
        yield [np.concatenate(x) for x in zip(*held)]
        held = [tuple(x[cut:] for x in some)]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def verified_links(distinct: DataFrame) -> DataFrame:
    """a, b: links that join all fingerprints within the radius of one another, for distinct fp."""
    variants = F.inline(F.array(*[F.struct(F.lit(k).alias("keep"), F.lit(x).alias("flip")) for k, x in balls()]))
    keyed = distinct.select("fp", variants).select((F.col("fp").bitwiseAND(F.col("keep"))).bitwiseXOR(F.col("flip")).alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links()
        for key, fp in whole_groups((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches):
            meet(key, fp, links)
        a, b = links.close()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b)."""
    spark, maps = links.sparkSession, []
    links = materialise(links.distinct(), "links")
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        up = materialise(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("up")), "up")
        over = up.select(F.col("node").alias("up"), F.col("up").alias("root"))
        hop = materialise(up.join(over, "up").select("node", "root"), "hop")
        ends = links.join(hop.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(hop.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        after = materialise(ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        discard(spark, links)
        discard(spark, up)
        maps.append(hop)
        links = after
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found


def labelled(digest: DataFrame, links: DataFrame) -> DataFrame:
    """fp and root (a fingerprint of its component, the same for all) of every fingerprint in digest."""
    distinct = digest.select("fp").distinct()
    joined = components(links).withColumnRenamed("node", "fp")
    return materialise(distinct.join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "labelled")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) for every row of docs."""
    digest = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(digest.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = labelled(distinct, verified_links(distinct.select("fp")))
    named = distinct.join(roots, "fp")
    smallest = materialise(named.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    of = materialise(roots.join(smallest, "root").select("fp", "component_id"), "components")
    return digest.join(of, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """One row of each component, with all columns of docs: the one of the smallest id (null after all others), then of the smaller row
    hash. Decided by row: ids may repeat or be null.

    digest: doc_id, fp and the row's key for every row of docs, where they are at hand; more: further links (a, b) of fingerprints.
    """
    if digest is None:
        digest = materialise(fingerprints(docs, id_col, text_col, carried=row_key(docs)), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *ROW)).alias("first")
    distinct = materialise(digest.groupBy("fp").agg(first), "distinct")
    links = verified_links(distinct.select("fp"))
    roots = labelled(distinct, links if more is None else links.union(more))
    best = distinct.join(roots, "fp").groupBy("root").agg(F.min("first").alias("best"))
    return one_of_each(docs, materialise(best.select(*[F.col(f"best.{c}").alias(c) for c in ROW]), "kept"), digest)


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
