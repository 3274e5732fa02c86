"""Jaccard join of the documents' sets of five-word shingles: every link at SIMILARITY or more, exactly.

Rare-first prefix filtering. Shingles are ordered by the class of their document frequency (its binary digits, TOP at most), then by key, KEY_BITS of their
hash. Two sets that link share a key among the first n - ceil(0.8 n) + 1 of each, so only those prefixes are joined. Shingles of one
document alone come first and can meet nothing: a document with as many of them as its prefix is long has no partner, and no row of it moves on.

Frequencies. A task gathers the sets of CHUNK shingles and sends, for each of as many ranges of keys as the corpus needs, one block of sorted
keys with the documents that hold them, packed. A range's task adds up the frequencies and answers each block with the keys that occur elsewhere too; the
answers of a chunk meet again and give its documents' prefixes. A key in HOT documents of one chunk is of the TOP class wherever it is: its
documents are told there, and the block carries its count alone.

Candidates. Keys that several sets share are lists. Each member is first paired with the list's smallest, pairs are made distinct and verified once on whole
sets, and links are contracted to components. Then, in the lists that still hold several components, members outside the largest component are compared with all
others of another component: by length and position, which needs no set; then, where a row has a partner left, by suffix and on whole sets. Only links that join components come
back, fewer than rows. Lists of equal members are compared once. A list is cut in parts of PART_BYTES of sets, and pairs of parts are dealt to tasks of
their own, so no task holds a whole list; rows of the largest component are copied only for the parts of the others.

The filters are exact bounds on the overlap: sizes; with the common key at ranks i and j, what may come before (unique shingles cannot) and after it; and for the
suffix, counts of both sets by RANGES ranges of hashes. Sets and shingles are known by 64-bit hashes.

Defined results: words are those of simhash, A-Z lower-cased; a text of fewer words than a shingle is one shingle; null and empty texts and texts without words
have an empty set and link with nothing; equal sets link; rows that repeat a doc_id are linked each by their own text; a null doc_id stays null and is
smaller than no other; an empty table gives an empty table; other columns are ignored, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import ROW, bounded_batches, discard, materialise, row_key
from marginalia.llm.shingles import _sets, shingle_set
from marginalia.llm.simhash import SEED, components, whole_groups

#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
KEY_BITS, HOT, TOP = 48, 128, 7
#: Shingles that a task gathers before it sends them, and shingles of one range of keys.
CHUNK, RANGE_SIZE = 1 << 20, 1 << 20
PART_BYTES, RANGES = 16 << 20, 64
#: Shingles of other sets that one set is compared with at a time.
SLICE = 1 << 20


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def enough(overlap, both_sizes):
    """Whether an overlap of sets with these sizes in all is a link."""
    return (100 + PERCENT) * overlap >= PERCENT * both_sizes


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integers by planes of bytes, compressed: high bytes that are zero cost nothing."""
    import zstandard

    planes = [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    sizes = np.array([len(planes), *(a.size for a in arrays)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(data)
    k = int.from_bytes(plain[:8], "little")
    out, at = [], 8 * (k + 1)
    for n in np.frombuffer(plain, "<u8", k, 8).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(plain, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").reshape(-1))
        at += 8 * n
    return out


def steps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


def set_id(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def shingles_of(text: str | None) -> np.ndarray:
    return shingle_set((text or "").encode().lower().split())


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the row's key, sid (the hash of its set, null if empty) and n (the set's size) for every row of docs."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(docs), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(x) for x in batch.column(3).to_pylist()]
            ids = pa.array([set_id(x) if x.size else None for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], ids, pa.array([x.size for x in sets], pa.int64())], names=["doc_id", *ROW, "sid", "n"])

    return materialise(rows.mapInArrow(run, f"doc_id bigint, {ROW[0]} bigint, {ROW[1]} bigint, sid bigint, n bigint"), "sized")


class Chunk:
    """Sets gathered by a task, each once."""

    def __init__(self, ranges: int) -> None:
        self.ranges, self.width = ranges, (1 << KEY_BITS) // ranges + 1
        self.clear()

    def clear(self) -> None:
        self.sids: dict[int, int] = {}
        self.sizes: list[int] = []
        self.keys: list[np.ndarray] = []
        self.total = 0

    def add(self, hashes: np.ndarray) -> None:
        sid = set_id(hashes)
        if sid not in self.sids:
            self.sids[sid] = len(self.sids)
            self.sizes.append(hashes.size)
            self.keys.append(np.unique(hashes >> np.uint64(64 - KEY_BITS)))
            self.total += self.keys[-1].size

    def close(self) -> list[tuple[int, int, int, bytes]]:
        """Rows (range, chunk, blocks, data): a block for each range, and the chunk's own, of range -1, that says how many blocks there are."""
        if not self.sids:
            return []
        sids = np.fromiter(self.sids, np.int64, len(self.sids)).view(np.uint64)
        distinct = np.fromiter(map(len, self.keys), np.int64, len(self.keys))
        keys, docs = np.concatenate(self.keys), np.repeat(np.arange(sids.size), distinct)
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(first, keys.size))
        hot = counts >= HOT
        told = np.repeat(hot, counts)
        chunk = set_id(sids)
        unique, cold_docs = keys[first], docs[~told]
        listed = np.where(hot, 0, counts)
        upto = np.concatenate([[0], np.cumsum(listed)])
        cuts = np.searchsorted(unique, np.arange(self.ranges + 1, dtype=np.uint64) * np.uint64(self.width))
        out = []
        for k in range(self.ranges):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                out.append((k, chunk, 0, pack(steps(unique[a:b]), counts[a:b], cold_docs[upto[a] : upto[b]])))
        own = pack(sids, np.array(self.sizes), distinct, keys[told], docs[told])
        return [*out, (-1, chunk, len(out), own)]


def _blocks(texts: DataFrame, ranges: int) -> DataFrame:
    """The rows of all chunks of texts. Spread: where a block's range, or a chunk's own row, is dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(ranges)

        def rows() -> Iterator[pa.RecordBatch]:
            found = chunk.close()
            chunk.clear()
            for at in range(0, len(found), 64):
                some = found[at : at + 64]
                columns = [pa.array(x, kind) for x, kind in zip(zip(*some), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "chunk", "blocks", "data"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                hashes = shingles_of(text)
                if hashes.size:
                    chunk.add(hashes)
                    if chunk.total >= CHUNK:
                        yield from rows()
        yield from rows()

    found = texts.mapInArrow(run, "place bigint, chunk bigint, blocks bigint, data binary")
    return found.withColumn("spread", F.when(F.col("place") >= 0, F.col("place")).otherwise(F.col("chunk")))


def answer(blocks: list[bytes]) -> list[bytes]:
    """For each block of one range: the keys that other documents hold too, their classes, and the documents of the block that hold them."""
    told = [unpack(x) for x in blocks]
    keys = [np.cumsum(x[0], dtype=np.uint64) for x in told]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    frequency = np.bincount(at, np.concatenate([x[1] for x in told]).astype(np.float64)).astype(np.int64)
    classes = np.minimum(np.frexp(frequency.astype(np.float64))[1] - 1, TOP)
    out, begin = [], 0
    for mine, (_, counts, docs) in zip(keys, told):
        my = classes[at[begin : begin + mine.size]]
        begin += mine.size
        listed = np.where(counts >= HOT, 0, counts).astype(np.int64)
        shared = (my > 0) & (listed > 0)
        out.append(pack(steps(mine[shared]), my[shared], listed[shared], docs[np.repeat(shared, listed)]))
    return out


def _answers(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["place", "chunk", "blocks", "data"], (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        place, chunks, held = None, [], []

        def rows() -> Iterator[pa.RecordBatch]:
            if held:
                columns = ([place] * len(held), chunks, [0] * len(held), answer(held))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=names)

        for batch in batches:
            own = batch.filter(pa.compute.less(batch.column(0), 0))
            if own.num_rows:
                yield own.select(names)
            for k, chunk, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if k < 0:
                    continue
                if k != place:
                    yield from rows()
                    place, chunks, held = k, [], []
                chunks.append(chunk)
                held.append(data)
        yield from rows()

    return blocks.repartition("spread").sortWithinPartitions("spread", "chunk").mapInArrow(run, "place bigint, chunk bigint, blocks bigint, data binary")


def chunk_prefixes(own: bytes, answers: list[bytes]) -> tuple[np.ndarray, ...]:
    """key, sid, n, alone (shingles of no other document) and place of each prefix shingle that another document holds."""
    sids, sizes, distinct, hot_keys, hot_docs = unpack(own)
    keys, classes, docs = [hot_keys], [np.full(hot_keys.size, TOP, np.uint64)], [hot_docs]
    for data in answers:
        gaps, kind, counts, who = unpack(data)
        keys.append(np.repeat(np.cumsum(gaps, dtype=np.uint64), counts.astype(np.int64)))
        classes.append(np.repeat(kind, counts.astype(np.int64)))
        docs.append(who)
    key, kind, doc = np.concatenate(keys), np.concatenate(classes), np.concatenate(docs).astype(np.int64)
    order = np.lexsort((key, kind, doc))
    key, doc = key[order], doc[order]
    held = np.bincount(doc, minlength=sids.size)
    alone = distinct.astype(np.int64) - held
    place = np.arange(doc.size) - np.repeat(np.cumsum(held) - held, held) + alone[doc]
    n = sizes.astype(np.int64)
    wanted = place < (n - (PERCENT * n + 99) // 100 + 1)[doc]
    doc = doc[wanted]
    return key[wanted].view(np.int64), sids[doc].view(np.int64), n[doc], alone[doc], place[wanted]


def postings(texts: DataFrame, ranges: int) -> DataFrame:
    """key, sid, n, alone, place of the shared prefix shingles of all distinct sets. texts: one column, read in an order that does not change."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, own, expected, answers = None, None, 0, []

        def rows() -> Iterator[pa.RecordBatch]:
            if chunk is None:
                return
            # a chunk sent twice, by a task that ran again, is the same each time
            found = dict(answers)
            if own is None or len(found) != expected:
                raise RuntimeError("a chunk's answers are not complete: its texts came in another order when a task ran again")
            columns = chunk_prefixes(own, list(found.values()))
            for at in range(0, columns[0].size, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in columns], names=["key", "sid", "n", "alone", "place"])

        for batch in batches:
            for k, c, blocks, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != chunk:
                    yield from rows()
                    chunk, own, expected, answers = c, None, 0, []
                if k < 0:
                    own, expected = data, blocks
                else:
                    answers.append((k, data))
        yield from rows()

    met = _answers(_blocks(texts, ranges)).repartition("chunk").sortWithinPartitions("chunk", "place")
    return materialise(met.mapInArrow(run, "key bigint, sid bigint, n bigint, alone bigint, place bigint").distinct(), "postings")


def may_link(a: str, b: str) -> Column:
    """The length and position filters for two members of a list, each a struct of n, alone and place."""
    col = lambda side, name: F.col(f"{side}.{name}")
    small, large = F.least(col(a, "n"), col(b, "n")), F.greatest(col(a, "n"), col(b, "n"))
    before = F.least(*(col(s, "place") - col(s, "alone") for s in (a, b)))
    after = F.least(*(col(s, "n") - col(s, "place") for s in (a, b)))
    return (100 * small >= PERCENT * large) & enough(before + after, small + large)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sids whose whole sets link."""
    left, right = (sets.select(F.col("sid").alias(k), F.col("hashes").alias(f"h{k}")).hint("merge") for k in ("a", "b"))
    both = F.size(F.array_intersect("ha", "hb")).cast("long")
    return pairs.join(left, "a").join(right, "b").filter(enough(both, F.size("ha") + F.size("hb"))).select("a", "b")


def overlaps(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    hit = mine[np.minimum(np.searchsorted(mine, flat), mine.size - 1)] == flat
    return np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)


class Cell:
    """Rows of a list that are compared in one task. kind 0: members outside the largest component with those in it; 1: the former with one another."""

    def __init__(self, kind: int, part: np.ndarray, largest: np.ndarray, sid: np.ndarray, root: np.ndarray, n: np.ndarray, alone: np.ndarray, place: np.ndarray) -> None:
        self.kind, self.part, self.largest, self.sid, self.root, self.n, self.alone, self.place = kind, part, largest, sid, root.copy(), n, alone, place
        self.one_part = part.min() == part.max()

    def asking(self) -> list[int]:
        return np.flatnonzero(~self.largest).tolist()

    def partners(self, k: int) -> np.ndarray:
        """Rows of other components that row k is compared with and that pass the length and position filters."""
        other = self.root != self.root[k]
        other &= self.largest if self.kind == 0 else (self.sid > self.sid[k]) if self.one_part else (self.part > self.part[k])
        other = np.flatnonzero(other)
        n, both = self.n[other], self.n[other] + self.n[k]
        before = np.minimum(self.place[other] - self.alone[other], self.place[k] - self.alone[k])
        after = np.minimum(n - self.place[other], self.n[k] - self.place[k])
        return other[(100 * np.minimum(n, self.n[k]) >= PERCENT * np.maximum(n, self.n[k])) & enough(before + after, both)]

    def meeting(self) -> np.ndarray:
        """Which rows have a partner, or are one."""
        met = np.zeros(self.sid.size, bool)
        for k in self.asking():
            found = self.partners(k)
            met[found] = True
            met[k] |= found.size > 0
        return met

    def links(self, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Links that join the components, fewer than the rows."""
        ranges = np.array([np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=RANGES) for x in sets])
        for k in self.asking():
            other = self.partners(k)
            other = other[enough(np.minimum(ranges[other], ranges[k]).sum(axis=1), self.n[other] + self.n[k])]
            step = max(1, SLICE // max(int(self.n[k]), 1))
            for at in range(0, other.size, step):
                some = other[at : at + step]
                some = some[self.root[some] != self.root[k]]
                if some.size:
                    for j in some[enough(overlaps(sets[k], [sets[x] for x in some.tolist()]), self.n[some] + self.n[k])].tolist():
                        if self.root[j] != self.root[k]:
                            yield int(self.sid[k]), int(self.sid[j])
                            self.root[self.root == self.root[j]] = self.root[k]


#: Columns of a cell's rows.
CELL = ["cell", "kind", "part", "largest", "sid", "root", "n", "alone", "place"]


def _cells(batches: Iterator[pa.RecordBatch], with_sets: bool) -> Iterator[tuple[int, Cell, list[np.ndarray]]]:
    """(number, cell, sets) of whole cells, from rows in order of cell."""

    def arrays() -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            if b.num_rows:
                columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(CELL))]
                if with_sets:
                    cuts, flat = b.column(len(CELL)).offsets.to_numpy().tolist(), b.column(len(CELL)).values.to_numpy().view(np.uint64)
                    sets = np.empty(b.num_rows, object)
                    for k in range(b.num_rows):
                        sets[k] = flat[cuts[k] : cuts[k + 1]]
                    columns.append(sets)
                yield tuple(columns)

    for cell, kind, *rest in whole_groups(arrays()):
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), cell.size]
        for x, y in zip(cuts, cuts[1:]):
            yield int(cell[x]), Cell(int(kind[x]), *(v[x:y] for v in rest[:7])), list(rest[7][x:y]) if with_sets else []


def _meeting(cells: DataFrame) -> DataFrame:
    """cell, sid: the rows of cells that have a partner by length and position. Only their sets are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, cell, _ in _cells(batches, False):
            found = cell.sid[cell.meeting()]
            if found.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(found.size, number)), pa.array(found)], names=["cell", "sid"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "cell bigint, sid bigint")


def _across(cells: DataFrame) -> DataFrame:
    """a, b: links that join all linked sets of different components, from rows of cells with their hashes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell, sets in _cells(batches, True):
            found = list(cell.links(sets))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f(p) for p in found], pa.int64()) for f in (min, max)], schema=schema)

    return cells.select(*CELL, "hashes").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint").distinct()


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of cells (CELL) of lists (key, sid, root, n, alone, place) with several components."""
    by_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"))
    by_key = by_root.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("size").alias("size"), F.max(F.struct("m", "root", "size")).alias("top"))
    parts = lambda size: F.greatest(F.ceil(size * 8 / PART_BYTES), F.lit(1)).cast("int")
    shape = by_key.filter("roots > 1").select("key", F.col("top.root").alias("main"), parts(F.col("top.size")).alias("of_main"), parts(F.col("size") - F.col("top.size")).alias("of_rest"))
    # lists of the same members are compared once
    names = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("sid", F.lit(7))).alias("x"))
    once = names.groupBy("m", "s", "x").agg(F.min("key").alias("key")).select("key")
    told = rows.join(shape.join(once.hint("merge"), "key").hint("merge"), "key").withColumn("largest", F.col("root") == F.col("main"))
    mine = F.pmod(F.xxhash64("sid", F.lit(3)), F.when(F.col("largest"), F.col("of_main")).otherwise(F.col("of_rest"))).cast("int")
    spot = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    part = F.col("part")
    in_main = each("of_rest", lambda q: spot(0, part, q))
    in_rest = F.concat(each("of_main", lambda p: spot(0, p, part)), each("of_rest", lambda q: spot(1, F.least(part, q), F.greatest(part, q))))
    spots = told.withColumn("part", mine).withColumn("spot", F.explode(F.when(F.col("largest"), in_main).otherwise(in_rest)))
    cell = F.xxhash64("key", "spot.kind", "spot.x", "spot.y").alias("cell")
    return spots.select(cell, F.col("spot.kind").alias("kind"), *CELL[2:])


def links(docs: DataFrame, told: DataFrame, text_col: str = "text") -> DataFrame:
    """a, b: links of sids that join all distinct sets of docs that link. told: sized(docs)."""
    spark = docs.sparkSession
    total = told.agg(F.sum("n")).first()[0] or 0
    lists = postings(docs.select(text_col), max(1, -(-total // RANGE_SIZE)))
    member = F.struct("sid", "n", "alone", "place")
    shared = lists.groupBy("key").agg(F.min(member).alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", "least")
    members = materialise(lists.join(shared.hint("merge"), "key").select("key", "least", *lists.columns[1:]), "members")
    discard(spark, lists)
    stars = members.withColumn("me", member).filter(F.col("sid") != F.col("least.sid")).filter(may_link("least", "me"))
    stars = materialise(stars.select(F.col("least.sid").alias("a"), F.col("sid").alias("b")).distinct(), "stars")
    sets = materialise(_sets(docs, told.filter("sid is not null"), members.select("sid").distinct(), text_col), "sets")
    found = materialise(verified(stars, sets), "verified")
    root = components(found).select(F.col("node").alias("sid"), "root")
    at = materialise(members.join(root.hint("merge"), "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("root"), "n", "alone", "place"), "rooted")
    open_keys = at.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    cells = materialise(dealt(at.join(open_keys.hint("merge"), "key", "left_semi")), "cells")
    met = materialise(_meeting(cells), "meeting")
    more = materialise(_across(cells.join(met.hint("merge"), ["cell", "sid"]).join(sets.hint("merge"), "sid")), "across")
    for done in (members, stars, sets, at, cells, met):
        discard(spark, done)
    return found.union(more)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable) for every row of docs."""
    told = sized(docs, id_col, text_col)
    root = components(links(docs, told, text_col)).select(F.col("node").alias("sid"), "root")
    first = told.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first"))
    named = materialise(first.join(root.hint("merge"), "sid", "left").select("sid", "first", F.coalesce("root", "sid").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialise(named.join(least.hint("merge"), "root").select("sid", "component_id"), "components")
    linked = told.join(of.hint("merge"), "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(told.filter("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
