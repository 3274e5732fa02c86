"""Near copies by the similarity of their sets of five-word shingles, for the pipeline's near_dedup stage.

Two texts are linked when their sets have a Jaccard similarity of SIMILARITY or more. Fingerprints alone cannot tell that: at 0.8 about ten
of their bits differ. One pass over the texts gives each its fingerprint and LANES minima of its set. Candidates meet on one of BANDS
keys of ROWS minima each: a pair at 0.8 meets nowhere in 3 of a million cases (0.5904 ** 24). Sets of FEW shingles or more take the minimum
of each of LANES ranges of hashes, smaller ones that of LANES permutations, and sets near FEW take both, so that any two that may be similar share a kind.

Candidates are verified on the whole sets, in two rounds. First each set with the smallest of each bucket it is in: so a large group
of near copies costs links in proportion to its size. Then, in the buckets that still have several components, a task compares sets of different components whose
minima agree in AGREE lanes or more (a pair at 0.8 agrees in fewer in 1 of 7,000 cases, at 0.85 in 1 of 5 million). It returns
the links that join components, fewer than the sets it holds. Large buckets are compared in cells of about PART by PART sets, dealt to tasks of their own.

Defined results: words are those of simhash; a text of fewer words than a shingle is one shingle; null and empty texts have no set; an empty
table has no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import ROW, bounded_batches, discard, materialise, row_key
from marginalia.llm.simhash import SEED, components, fingerprint, whole_groups

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 4
LANES, AGREE, FEW, PART = BANDS * ROWS, 62, 500, 1024
#: Shingles hashed at a time; words longer than this stand by their hash, so that places within a slice stay small.
AT_ONCE, LONG_WORD = 1 << 14, 1 << 10
#: Shingles of other sets that one set is compared with at a time.
SLICE = 1 << 20
#: Bits of the table of rows whose sets are needed: 8 MB at most, at any size of the input.
BITS = 1 << 26

_draw = np.random.default_rng(SEED)
_odd = lambda n: _draw.integers(1, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1)
FLIP, TIMES, MIX, BYTE = _odd(LANES), _odd(LANES), _odd(LANES), _odd(256)
STEP = int(_odd(1)[0])
BACK = pow(STEP, -1, 1 << 64)
RANGE = (np.arange(LANES, dtype=np.uint64) * np.uint64((1 << 64) // LANES)).astype(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(STEP, 1 << 16), _powers(BACK, 1 << 16)


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of lower-case words: a polynomial over their bytes, mixed."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    if max(map(len, words)) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else b"\0" + xxhash.xxh64_digest(w, SEED) for w in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = max(len(words) - WORDS + 1, 1)
    first, last = starts[:n], ends[min(WORDS, len(words)) - 1 :]
    data, out = np.frombuffer(b" ".join(words) + b" ", np.uint8), []
    at = 0
    while at < n:
        # as many shingles as fit the table of powers
        upto = min(n, at + AT_ONCE, int(np.searchsorted(last, first[at] + _UP.size - 1, side="right")))
        a, b = first[at:upto] - first[at], last[at:upto] - first[at]
        some = data[first[at] : last[upto - 1]]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[some] * _UP[: some.size], dtype=np.uint64)])
        h = (total[b] - total[a]) * _DOWN[a] + (b - a).astype(np.uint64)
        h = (h ^ h >> np.uint64(31)) * MIX[0]
        h = (h ^ h >> np.uint64(29)) * MIX[1]
        out.append(h ^ h >> np.uint64(32))
        at = upto
    return np.unique(np.concatenate(out))


def minima(hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The LANES minima of a set, by permutations (kind 0), by ranges (kind 1), or both."""
    out = []
    if hashes.size * 4 <= FEW * 5:
        out.append((0, ((hashes[:, None] ^ FLIP) * TIMES).min(axis=0)))
    if hashes.size >= FEW:
        at = np.searchsorted(hashes, RANGE)
        least = hashes[np.minimum(at, hashes.size - 1)]
        # an empty range borrows from the next that is not, marked by the distance
        empty = np.flatnonzero(at == np.append(at[1:], hashes.size))
        for k in empty[::-1].tolist():
            least[k : k + 1] = least[(k + 1) % LANES] ^ MIX[2:3]
        out.append((1, least))
    return out


def lanes_of(low: np.ndarray) -> bytes:
    """16 bits of each minimum."""
    return ((low ^ low >> np.uint64(29)) * MIX >> np.uint64(48)).astype(np.uint16).tobytes()


def band_keys(low: np.ndarray) -> np.ndarray:
    mixed = (low ^ low >> np.uint64(29)) * MIX
    keys = (mixed ^ mixed >> np.uint64(32)).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) * TIMES[:BANDS]
    return (keys ^ keys >> np.uint64(31)).view(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: doc_id, its key, fp, sid (the hash of its set, null without words), n (the set's size), and its minima and band keys by kind."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(docs), F.col(text_col).alias("text"))
    kinds = pa.list_(pa.struct([("kind", pa.int32()), ("lanes", pa.binary()), ("keys", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            fp, sid, size, told = [], [], [], []
            for text in batch.column(3).to_pylist():
                hashes = shingle_set(_words(text))
                low = minima(hashes) if hashes.size else []
                fp.append(fingerprint(text or ""))
                sid.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63) if hashes.size else None)
                size.append(hashes.size)
                told.append([{"kind": k, "lanes": lanes_of(x), "keys": band_keys(x).tolist()} for k, x in low])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sid, pa.int64()), pa.array(size, pa.int32()), pa.array(told, kinds)], names=["doc_id", *ROW, "fp", "sid", "n", "kinds"]
            )

    schema = f"doc_id bigint, {ROW[0]} bigint, {ROW[1]} bigint, fp bigint, sid bigint, n int, kinds array<struct<kind:int,lanes:binary,keys:array<bigint>>>"
    return materialise(rows.mapInArrow(run, schema), "sketches")


def _sets(docs: DataFrame, told: DataFrame, needed: DataFrame, text_col: str) -> DataFrame:
    """sid and its hashes, for the sids needed, from one row of docs each.

    A table of bits (BITS at most, so at most 2,048 rows of 4 KB) tells nearly all other rows apart before any text moves.
    """
    one = told.join(needed.hint("merge"), "sid", "left_semi").groupBy("sid").agg(F.min(F.struct(*ROW)).alias("row")).select("sid", "row.*")
    one = materialise(one, "needed")
    bit = F.pmod(F.col(ROW[0]), F.lit(BITS)) + 1
    bucket, place = F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit)
    table = one.select(bucket, place.alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    keyed = docs.select(F.col(text_col).alias("text"), *row_key(docs)).select("*", bucket, place.cast("int").alias("place"))
    # a proven bound on what is broadcast: BITS / 32768 rows of 4 KB
    told_bit = F.expr("getbit(cast(conv(hex(substring(bits, cast(place div 8 + 1 as int), 1)), 16, 10) as int), place % 8) = 1")
    near = keyed.join(F.broadcast(table), "bucket").filter(told_bit)
    rows = near.select("text", *ROW).join(one.hint("merge"), ROW).select("sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(_words(text)).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["sid", "hashes"])

    # rows that repeat in every column share a key
    return rows.mapInArrow(run, "sid bigint, hashes array<bigint>").dropDuplicates(["sid"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sids whose sets are similar."""
    left, right = (sets.select(F.col("sid").alias(k), F.col("hashes").alias(f"h{k}"), F.size("hashes").alias(f"n{k}")).hint("merge") for k in ("a", "b"))
    both = F.size(F.array_intersect("ha", "hb"))
    # sizes first: sets whose sizes are too far apart cannot be similar
    fit = (F.least("na", "nb") >= F.lit(SIMILARITY) * F.greatest("na", "nb") - 1e-9) & (both >= F.lit(SIMILARITY) * (F.col("na") + F.col("nb") - both) - 1e-9)
    return pairs.join(left, "a").join(right, "b").filter(fit).select("a", "b")


def _similar(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of others, sorted sets like mine, are similar to it."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    hit = mine[np.minimum(np.searchsorted(mine, flat), mine.size - 1)] == flat
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both >= SIMILARITY * (mine.size + sizes - both) - 1e-9


def _cell(part: np.ndarray, sid: np.ndarray, root: np.ndarray, n: np.ndarray, lanes: np.ndarray, sets: np.ndarray, own: bool) -> Iterator[tuple[int, int]]:
    """Links that join the components of one cell: within its part, or between its two. Fewer than its rows."""
    root = root.copy()
    for k in range(sid.size):
        other = np.flatnonzero(root != root[k])
        other = other[other > k] if own else other[part[other] > part[k]]
        fit = (n[other] >= SIMILARITY * n[k] - 1e-9) & (n[k] >= SIMILARITY * n[other] - 1e-9)
        other = other[fit]
        other = other[(lanes[other] == lanes[k]).sum(axis=1) >= AGREE]
        step = max(1, SLICE // max(int(n[k]), 1))
        for at in range(0, other.size, step):
            some = other[at : at + step]
            some = some[root[some] != root[k]]
            for j in some[_similar(sets[k], list(sets[some]))].tolist() if some.size else ():
                if root[j] != root[k]:
                    yield int(sid[k]), int(sid[j])
                    root[root == root[j]] = root[k]


def _across(cells: DataFrame) -> DataFrame:
    """a, b: links that join all similar sets of different components, of rows (cell, own, part, sid, root, n, lanes, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                if b.num_rows:
                    lanes = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint16).reshape(-1, LANES)
                    cuts, flat = b.column(7).offsets.to_numpy(), b.column(7).values.to_numpy().view(np.uint64)
                    sets = np.empty(b.num_rows, object)
                    sets[:] = [flat[x:y] for x, y in zip(cuts.tolist(), cuts[1:].tolist())] if b.num_rows > 1 else [None]
                    if b.num_rows == 1:
                        sets[0] = flat[cuts[0] : cuts[1]]
                    yield (*(b.column(k).to_numpy() for k in (0, 2, 3, 4, 5)), lanes, sets, b.column(1).to_numpy(zero_copy_only=False))

        for cell, part, sid, root, n, lanes, sets, own in whole_groups(arrays()):
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), cell.size]
            found = [pair for x, y in zip(cuts, cuts[1:]) if y - x > 1 for pair in _cell(part[x:y], sid[x:y], root[x:y], n[x:y], lanes[x:y], sets[x:y], bool(own[x]))]
            if found:
                yield pa.RecordBatch.from_pydict({"a": [min(x) for x in found], "b": [max(x) for x in found]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    dealt = cells.select("cell", "own", "part", "sid", "root", "n", "lanes", "hashes")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint").distinct()


def similar_links(docs: DataFrame, told: DataFrame, text_col: str = "text") -> DataFrame:
    """a, b: links between fingerprints that join all texts of docs with similar sets. told: sketches(docs)."""
    spark = docs.sparkSession
    some = told.filter("sid is not null")
    first = some.groupBy("sid").agg(F.min("fp").alias("first"))
    same = materialise(some.select("sid", "fp").distinct().join(first.hint("merge"), "sid").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b")), "same")
    keys = some.select("sid", F.explode("kinds").alias("k")).select("sid", F.col("k.kind").alias("kind"), F.explode("k.keys").alias("key"))
    buckets = materialise(keys.distinct(), "buckets")
    shared = buckets.groupBy("kind", "key").agg(F.min("sid").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = materialise(buckets.join(shared.hint("merge"), ["kind", "key"]).select("kind", "key", "sid", "least", "m"), "members")
    discard(spark, buckets)
    stars = members.filter("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b")).distinct()
    sets = materialise(_sets(docs, some, members.select("sid").distinct(), text_col), "sets")
    links = materialise(_verified(materialise(stars, "stars"), sets), "similar")
    root = components(links).select(F.col("node").alias("sid"), "root")
    at = materialise(members.join(root.hint("merge"), "sid", "left").select("kind", "key", "sid", "m", F.coalesce("root", "sid").alias("root")), "rooted")
    discard(spark, members)
    open_keys = at.groupBy("kind", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("kind", "key")
    minima_of = some.groupBy("sid").agg(F.first(F.struct("n", "kinds")).alias("s")).select("sid", "s.n", F.explode("s.kinds").alias("k")).select("sid", "n", "k.kind", "k.lanes")
    several = at.join(open_keys.hint("merge"), ["kind", "key"], "left_semi").join(minima_of.hint("merge"), ["sid", "kind"]).join(sets.hint("merge"), "sid")
    # each bucket in cells of about PART by PART sets at most
    parts = F.ceil(F.col("m") / PART).cast("int")
    dealt = several.withColumn("part", F.pmod(F.xxhash64("sid", F.lit(3)), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    cells = dealt.select(F.xxhash64("kind", "key", low, high).alias("cell"), (low == high).alias("own"), "part", "sid", "root", "n", "lanes", "hashes")
    more = materialise(_across(cells), "across")
    discard(spark, sets)
    names = lambda k: first.select(F.col("sid").alias(k), F.col("first").alias(f"f{k}"))
    found = links.union(more).join(names("a").hint("merge"), "a").join(names("b").hint("merge"), "b").filter("fa <> fb")
    return materialise(found.select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).union(same), "similar-links")
