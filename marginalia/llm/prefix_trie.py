"""The trie of conversations by their prefixes, with what sharing each prefix saves.

Naming by prefix doubling. Distinct turns get dense names, then every aligned block of two blocks gets one from the names of its halves, so blocks of 1, 2, 4, ...
turns are named in as many rounds as the longest conversation has binary digits. A prefix of d turns is the row of blocks that the binary
digits of d call for, largest first: its group comes from the group of the prefix without the last block, and that block's name. So
round j groups the prefixes whose length has j ones. The group is known by its smallest member, which with the depth names the node.

Nothing is summed by walking the tree. A turn is saved where its conversation is not the smallest member of its node; a node's savings are those of its members'
turns from its depth on, its leaves are the members that stand for a leaf, its children the members that stand for one at the next depth. All are sums by node
of sums along a conversation.

Hot keys: a node may have all conversations, and a conversation a third of all turns. Groups are counted by partial aggregation and joined back by merge joins,
which Spark splits where they are skewed. Turns are numbered over ranges of all turns, and sums along a conversation are made in blocks of BLOCK turns and a row a block. Ids of the
conversations that end at a node are joined to text in pieces of PIECE after one global sort; a task then hashes the pieces in order, one at a time.

Turns are equal when the SHA-256 of role and text is: no text moves after the first pass.

Defined results: rows without a conversation id belong to no conversation; null roles and texts are empty; turns come in order of turn (null first), then of their
hash, so rows that repeat are turns of their own; a conversation without turns is a member of the root; an empty table has no node; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_batches, discard, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations that share a leader's first turns, and the most turns they may share.
LEADER_EVERY, SHARED = 20, 4
BLOCK, PIECE = 1024, 4096
#: Bits of the row number that monotonically_increasing_id gives within a task.
ROW_BITS = 33


def task_of(at: str) -> Column:
    return F.shiftright(at, ROW_BITS)


def dense_names(keys: DataFrame, tag: str) -> DataFrame:
    """keys (each once) with `name`, 0 and up without gaps."""
    found = materialise(keys.withColumn("at", F.monotonically_increasing_id()), tag)
    counts = found.groupBy(task_of("at").alias("task")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("task", (F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    # a row a task of the write above: bounded by the number of shuffle partitions
    named = found.withColumn("task", task_of("at")).join(F.broadcast(before), "task")
    return named.select(*keys.columns, (F.col("before") + F.col("at").bitwiseAND((1 << ROW_BITS) - 1)).alias("name"))


def shared_turns() -> Column:
    """How many turns a conversation takes from its leader."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, d from 1, digest, words, len) and the conversations (conv_id, len), each begun with its leader's first turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    ordered = narrow.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    ordered = materialise(ordered.select("conv_id", F.monotonically_increasing_id().alias("at"), "digest", "words"), "ordered")
    # a row for each conversation and task that holds some of it
    heads = ordered.groupBy("conv_id", task_of("at").alias("task")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    heads = heads.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    heads = materialise(heads, "heads")
    sizes = heads.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))
    leaders = sizes.select(F.col("conv_id").alias("leader"), F.col("n_turns").alias("of_leader"))
    known = sizes.select("conv_id", "n_turns", shared_turns().alias("h"), (F.col("conv_id") - F.col("conv_id") % LEADER_EVERY).alias("leader")).join(leaders.hint("merge"), "leader", "left")
    given_n = F.least("h", F.coalesce("of_leader", F.lit(0)))
    known = materialise(known.select("conv_id", "leader", "h", given_n.alias("given"), (given_n + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("len")), "rebuilt")
    spots = heads.join(known.hint("merge"), "conv_id").select("conv_id", "task", (F.col("before") - F.col("first")).alias("shift"), "h", "given", "len")
    placed = ordered.withColumn("task", task_of("at")).join(spots.hint("merge"), ["conv_id", "task"]).withColumn("place", F.col("at") + F.col("shift"))
    own = placed.filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("given") + 1).alias("d"), "digest", "words", "len")
    firsts = placed.filter((F.col("conv_id") % LEADER_EVERY == 0) & (F.col("place") < SHARED)).select(F.col("conv_id").alias("leader"), "place", "digest", "words")
    taken = known.join(firsts.hint("merge"), "leader").filter("place < h").select("conv_id", (F.col("place") + 1).alias("d"), "digest", "words", "len")
    return materialise(own.unionByName(taken), "turns"), known.select("conv_id", "len")


def named_blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """By level k: conv_id, i, name, words (of the last turn), len, for the aligned blocks of 2 ** k turns."""
    names = dense_names(turns.select("digest").distinct(), "turn-names")
    first = turns.join(names.hint("merge"), "digest").select("conv_id", (F.col("d") - 1).alias("i"), "name", "words", "len")
    levels = [materialise(first, "blocks")]
    while 1 << len(levels) <= longest:
        half = lambda k, c: F.max(F.when(F.col("i") % 2 == k, F.col(c)))
        both = levels[-1].groupBy("conv_id", F.shiftright("i", 1).alias("half")).agg(half(0, "name").alias("a"), half(1, "name").alias("b"), half(1, "words").alias("words"), F.max("len").alias("len"))
        pairs = materialise(both.filter("b is not null"), "pairs")
        names = dense_names(pairs.select("a", "b").distinct(), "block-names")
        levels.append(materialise(pairs.join(names.hint("merge"), ["a", "b"]).select("conv_id", F.col("half").alias("i"), "name", "words", "len"), "blocks"))
        discard(turns.sparkSession, pairs)
    return levels


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """conv_id, d, node (smallest member), n_convs, words, len, inner (whether the node has children), for every prefix of every conversation but the empty one."""
    levels, spark = named_blocks(turns, longest), turns.sparkSession
    steps = [b.filter("i % 2 = 0").select("conv_id", F.shiftleft(F.col("i") + 1, k).alias("d"), F.lit(1 << k).cast("long").alias("size"), "name", "words", "len") for k, b in enumerate(levels)]
    blocks = steps[0]
    for more in steps[1:]:
        blocks = blocks.unionByName(more)
    found: list[DataFrame] = []
    for ones in range(1, longest.bit_length() + 1):
        now = blocks.filter(F.bit_count("d") == ones)
        if found:
            last = found[-1].select("conv_id", F.col("d").alias("upto"), F.col("node").alias("head"))
            now = now.withColumn("upto", F.col("d") - F.col("size")).join(last.hint("merge"), ["conv_id", "upto"]).drop("upto")
        else:
            now = now.withColumn("head", F.lit(-1).cast("long"))
        key = ["d", "head", "name"]
        groups = now.groupBy(*key).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), (F.max("len") > F.first("d")).alias("inner"))
        found.append(materialise(now.join(groups.hint("merge"), key).select("conv_id", "d", "node", "n_convs", "words", "len", "inner"), "prefixes"))
    for b in levels:
        discard(spark, b)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def ends_hashes(ends: DataFrame) -> DataFrame:
    """d, node and ends_sha256: the hash of the ids of ends (d, node, conv_id) in ascending order, joined by commas."""
    bounded_batches(ends.sparkSession)
    key = ["d", "node"]
    ordered = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").withColumn("at", F.monotonically_increasing_id())
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = ordered.groupBy(*key, F.expr(f"at div {PIECE}").alias("piece")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out = []
            for d, n, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if (d, n) == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (d, n), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["d", "node", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=["d", "node", "ends_sha256"])

    return pieces.repartition(*key).sortWithinPartitions(*key, "piece").mapInArrow(run, "d bigint, node bigint, ends_sha256 string")


def nodes(rows: DataFrame) -> DataFrame:
    """The trie's nodes from all prefixes, the empty one of every conversation included."""
    rep = F.col("conv_id") == F.col("node")
    told = rows.select(
        "conv_id", "d", "node", "n_convs", "len", F.expr(f"d div {BLOCK}").alias("block"), rep.alias("rep"),
        F.when(rep, 0).otherwise(F.col("words")).alias("saved"), (rep & ~F.col("inner") & (F.col("d") == F.col("len"))).cast("long").alias("leaf"),
    )
    # what later blocks of a long conversation hold
    sums = told.filter(F.col("len") >= BLOCK).groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    tails = sums.select("conv_id", "block", F.sum("s").over(later).alias("later_saved"), F.sum("l").over(later).alias("later_leaf"))
    # the first and last row of a block are seen by its neighbours too
    beside = F.when((F.col("d") % BLOCK == 0) & (F.col("d") > 0), F.array(F.lit(0), F.lit(-1))).when(F.col("d") % BLOCK == BLOCK - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    seen = told.withColumn("beside", F.explode(beside)).withColumn("block", F.col("block") + F.col("beside")).withColumn("own", F.col("beside") == 0)
    here = Window.partitionBy("conv_id", "block").orderBy("d")
    whole, upto = Window.partitionBy("conv_id", "block"), here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = lambda c: F.when(F.col("own"), F.col(c)).otherwise(0)
    onward = lambda c: F.sum(mine(c)).over(whole) - F.sum(mine(c)).over(upto) + F.col(c) + F.coalesce(F.col(f"later_{c}"), F.lit(0))
    along = seen.join(tails, ["conv_id", "block"], "left").select(
        "conv_id", "d", "node", "n_convs", "rep", "own", F.lag("node").over(here).alias("parent"), F.lead("rep").over(here).alias("child"), onward("saved").alias("saved"), onward("leaf").alias("leaves"),
    ).filter("own")
    return along.groupBy("d", "node").agg(
        F.max(F.when(F.col("rep"), F.col("parent"))).alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.sum(F.coalesce(F.col("child").cast("long"), F.lit(0))).alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, d (1 and up without gaps), digest, words, len; sizes: conv_id and len of every conversation, those without turns too.
    """
    root = sizes.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), F.max("len").alias("longest")).first()
    longest = int(root.longest or 0)
    long = lambda x: F.lit(x).cast("long")
    rows = sizes.select("conv_id", long(0).alias("d"), long(root.least).alias("node"), long(root.n).alias("n_convs"), long(0).alias("words"), "len", F.lit(longest > 0).alias("inner"))
    if longest:
        rows = rows.unionByName(prefixes(turns, longest))
    found = nodes(rows).join(ends_hashes(rows.filter("d = len").select("d", "node", "conv_id")).hint("merge"), ["d", "node"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        F.col("node").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
