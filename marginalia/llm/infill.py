"""Fill-in-the-middle documents: each text cut in prefix, middle and suffix by code points, and rearranged around sentinels.

The code points and their offsets come from the tokenizers library's Split pre-tokenizer, one isolated regex match a code point, no
training. A match never depends on what stands before it, so a text is matched by its segments between spaces, and the offsets of a
segment are kept by each worker (KEPT segments at most, then new ones are matched each time). The length of a text's offset
array gives n; the offsets at the two drawn ranks give the slices. Segments longer than AT_ONCE are matched in slices, so memory is bounded by
the text itself.

The draw is by id alone: h1 to h4 are the first four 8-digit groups of the hex SHA-256 of `seed:id`. h1 and h2 modulo n + 1 rank the two cuts, h3 decides
whether the text stays plain, h4 the order of the parts. A rerun, or a task run again, gives the same output.

Defined results: a null text is empty; an empty text and one that holds a sentinel stay plain; a null id is drawn as an empty number and stays null; rows that
repeat are each rearranged, alike; texts of any length are cut whole; an empty table gives an empty table; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import BATCH_ROWS, bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One match a code point, line ends included.
CODE_POINT = r"[^\n]|\n"
#: Segments that a worker keeps matched, their greatest length, and code points matched in one call.
KEPT, LONGEST_KEPT, AT_ONCE = 300_000, 64, 4096


class Matched(dict):
    """Segment -> the offset at which each of its code points starts."""

    def __init__(self) -> None:
        from tokenizers import Regex, pre_tokenizers

        super().__init__()
        self.split = pre_tokenizers.Split(Regex(CODE_POINT), "isolated").pre_tokenize_str

    def __missing__(self, segment: str) -> Sequence[int]:
        if len(segment) > AT_ONCE:
            slices = range(0, len(segment), AT_ONCE)
            return np.concatenate([np.array(self.starts(segment[at : at + AT_ONCE])) + at for at in slices])
        offsets = self.starts(segment)
        if len(self) < KEPT and len(segment) <= LONGEST_KEPT:
            self[segment] = offsets
        return offsets

    def starts(self, segment: str) -> list[int]:
        return [start for _, (start, _) in self.split(segment)]


@functools.cache
def matched() -> Matched:
    return Matched()


class Offsets:
    """The offset array of a text, by segments: its length, and the offset at any rank."""

    def __init__(self, text: str) -> None:
        known = matched()
        self.parts = list(map(known.__getitem__, text.split(" ")))
        space = len(known[" "])
        #: the rank after each segment and the space that follows it
        self.upto = np.cumsum(np.fromiter(map(len, self.parts), np.int64, len(self.parts)) + space)
        self.n = int(self.upto[-1]) - space

    def at(self, rank: int) -> int:
        """Where the unit of that rank starts; the end of the text for rank n."""
        k = int(np.searchsorted(self.upto, rank, side="right"))
        if k == len(self.parts):
            return self.n
        before = int(self.upto[k - 1]) if k else 0
        part = self.parts[k]
        return before + (int(part[rank - before]) if rank - before < len(part) else len(part))


def draws(row_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearranged(row_id: int | None, text: str, seed: int, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output."""
    offsets = Offsets(text)
    h1, h2, h3, h4 = draws(row_id, seed)
    if not text or h3 % 100 >= plain_from or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return offsets.n, "plain", None, None, text
    a, b = (offsets.at(rank) for rank in sorted((h1 % (offsets.n + 1), h2 % (offsets.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return offsets.n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return offsets.n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """id, n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, one row for every row of docs.

    plain_from: texts drawn at this or above, of 100, stay plain; spm_below: of the others, those drawn below this, of 100, have the suffix first.
    """
    bounded_batches(docs.sparkSession)
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(at, BATCH_ROWS)
                rows = [rearranged(k, text or "", seed, plain_from, spm_below) for k, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(x, kind).cast(pa.string() if kind == pa.large_string() else kind) for x, kind in zip(zip(*rows), kinds))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text rebuilt from an output and its form alone. No part holds a sentinel, so the sentinels cut the output."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    order: dict[str, Sequence[int]] = {"psm": (2, 4, 3), "spm": (3, 4, 2)}
    told = F.when(F.col(form) == "plain", F.col(output))
    for name, places in order.items():
        told = told.when(F.col(form) == name, F.concat(*[F.element_at(parts, k) for k in places]))
    return told
