"""Spans in texts: finders by kind, and the columns that queries derive from them.

A span is (start, kind, end) with offsets in code points, end exclusive.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_batches

SPAN = "struct<kind:string,start:int,end:int>"
Found = list[tuple[int, str, int]]


def ordered(spans: Found, kinds: tuple[str, ...]) -> Found:
    """By start, then kind as listed."""
    place = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[0], place[s[1]], s[2]))


def covered(spans: Found) -> list[tuple[int, int]]:
    """What spans cover, as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def overlapping(ranges: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Those of disjoint ranges in order that overlap [a, b)."""
    first = bisect.bisect_right(ranges, a, key=lambda r: r[1])
    return ranges[first : bisect.bisect_left(ranges, b, lo=first, key=lambda r: r[0])]


def find_spans(docs: DataFrame, finder: Callable[[], Callable[[str], Found]], kinds: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end, in order) for every row of docs. finder() is called once a task."""
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for a, k, b in ordered(find(x), kinds)] if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, f"doc_id bigint, spans array<{SPAN}>")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(kinds: tuple[str, ...]) -> list[Column]:
    """base_sha256 of the base kinds' spans, and spans of all kinds, as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return [F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")]
