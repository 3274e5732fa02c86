"""Sections to chunks: packing with overlap, ids, page spans and page location."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T

MOST, OVERLAP, LEAST_MOST, VERSION = 3200, 400, 800, "paragraph-pack-1"
ANCHOR, SHORT_ANCHOR, LEAST_LOCATED = 180, 100, 24
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")


def pack(text: str | None, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most `most` characters, from paragraphs, sentences or slices, each seeded with the tail of the one before."""
    most = max(most, LEAST_MOST)
    overlap = min(max(overlap, 0), most // 3)
    units: list[str] = []
    for paragraph in re.split(r"\n\s*\n+", (text or "").replace("\r\n", "\n").replace("\r", "\n")):
        if not (paragraph := paragraph.strip()):
            continue
        for part in [paragraph] if len(paragraph) <= most else SENTENCE.split(paragraph):
            units += [part[k : k + most] for k in range(0, len(part), most)]
    out: list[str] = []
    held: list[str] = []

    def size(parts: list[str]) -> int:
        return sum(map(len, parts)) + 2 * max(len(parts) - 1, 0)

    for unit in units:
        if held and size([*held, unit]) > most:
            out.append("\n\n".join(held).strip())
            tail: list[str] = []
            for part in reversed(held):
                if not tail and len(part) > overlap:
                    tail = [part[-overlap:]] if overlap else []
                    break
                # the tail's own length: separators do not count here
                if len(part) + sum(map(len, tail)) > overlap:
                    break
                tail.insert(0, part)
            held = tail if size([*tail, unit]) <= most else []
        held.append(unit)
    last = "\n\n".join(held).strip()
    if last and (not out or out[-1] != last):
        out.append(last)
    return out


def chunks(sections: DataFrame, id_col: str = "id", text_col: str = "content", most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """section_id, chunk_index, content, chunk_id, content_hash, token_count, version: one section is one row's fold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(s, i, c) for s, t in zip(pdf["section_id"], pdf["t"]) for i, c in enumerate(pack(t, most, overlap))]
            yield pd.DataFrame(rows, columns=["section_id", "chunk_index", "content"])

    packed = sections.select(F.col(id_col).cast("string").alias("section_id"), F.col(text_col).alias("t")).mapInPandas(run, "section_id string, chunk_index int, content string")
    return with_ids(packed)


def with_ids(packed: DataFrame) -> DataFrame:
    return packed.select("*", T.chunk_id(F.col("section_id"), F.col("chunk_index"), F.col("content")).alias("chunk_id"), F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), T.token_estimate("content").alias("token_count"), F.lit(VERSION).alias("version"))


def page_spans(blocks: DataFrame, doc_col: str, seq_col: str, text_col: str, page_col: str) -> DataFrame:
    """doc, seq, page (from 1), start, end: where each text block lies in the document's joined text."""
    # asked of the text as it is, else each line is collapsed for the question and again for the answer
    flat = blocks.filter(F.col(text_col).rlike(r"[^\x00-\x20]")).select(F.col(doc_col).alias("doc"), F.col(seq_col).alias("seq"), (F.col(page_col) + 1).cast("int").alias("page"), T.collapse(text_col).alias("t"))
    before = F.coalesce(F.sum(F.length("t") + 1).over(W.partitionBy("doc").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return flat.select("doc", "seq", "page", before.cast("long").alias("start"), (before + F.length("t")).cast("long").alias("end"), "t")


def locate_pages(chunk_rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc, chunk_index, page_start, page_end. chunk_rows: doc, chunk_index, content; blocks: doc, seq, text, page_index.

    A chunk is found by its first ANCHOR characters, from just after where the chunk before was found; else by its first SHORT_ANCHOR from there; else by the
    last of these from the beginning. Chunks of fewer than LEAST_LOCATED characters and those not found have no pages, nor has an offset between two blocks. A document's
    text, spans and anchors are a row, as long as the document; the chunks are searched in their order by a fold in the JVM.
    """
    spans = page_spans(blocks, "doc", "seq", "text", "page_index")
    texts = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "page", "t"))).alias("spans"))
    texts = texts.select(
        "doc", F.array_join(F.transform("spans", lambda x: x["t"]), " ").alias("source"), F.transform("spans", lambda x: x.dropFields("t")).alias("spans"),
        F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda k: k < F.size("spans")).alias("strides"), F.element_at("spans", -1)["end"].alias("n"),
    )
    flat = chunk_rows.select("doc", "chunk_index", T.collapse("content").alias("t")).select("doc", "chunk_index", F.length("t").alias("size"), F.substring("t", 1, ANCHOR).alias("anchor"))
    told = flat.select("doc", F.struct("chunk_index", F.when(F.col("size") >= LEAST_LOCATED, F.col("anchor")).alias("anchor"), "size").alias("c")).groupBy("doc").agg(F.array_sort(F.collect_list("c")).alias("chunks"))
    both = told.join(texts, "doc", "left")

    def find(text: Column, before: Column, anchor: Column) -> Column:
        """hit, and the rest of the text from just after it on; null where the anchor is not in it."""
        # asked first: `contains` goes by the first byte, `locate` compares at each character
        at = F.when(F.contains(text, anchor), F.call_function("locate", anchor, text))
        return T.let(at, lambda k: F.when(k > 0, F.struct((before + k - 1).alias("hit"), F.substr(text, k + 1).alias("rest"))))

    def fold(source: Column) -> Column:
        def step(state: Column, c: Column) -> Column:
            def far(near: Column) -> Column:
                # where the long anchor stands the short one does: none of it is before, and where that is nowhere the long one is not either
                long = F.when(F.startswith(near["rest"], F.substring(c["anchor"], 2, ANCHOR)), near).otherwise(F.coalesce(find(near["rest"], near["hit"] + 1, c["anchor"]), near))
                return F.when(near.isNotNull(), long).otherwise(find(source, F.lit(0), short))

            def held(at: Column) -> Column:
                row = F.struct(c["chunk_index"].alias("chunk_index"), at["hit"].alias("hit"), c["size"].alias("size"))
                return F.struct(F.coalesce(at["hit"] + 1, state["after"]).alias("after"), F.coalesce(at["rest"], state["rest"]).alias("rest"), F.concat(state["found"], F.array(row)).alias("found"))

            short = F.substring(c["anchor"], 1, SHORT_ANCHOR)
            return T.let(T.let(find(state["rest"], state["after"], short), far), held)

        empty = F.struct(F.lit(0).alias("after"), source.alias("rest"), F.array().cast("array<struct<chunk_index:int,hit:int,size:int>>").alias("found"))
        return F.aggregate("chunks", empty, step)["found"]

    def page(at: Column) -> Column:
        """Of the last span that begins at this place or before, found by halves."""
        last = F.aggregate("strides", F.lit(0), lambda k, more: F.when(F.get("spans", k + more)["start"] <= at, k + more).otherwise(k))
        return T.let(F.get("spans", last), lambda x: F.when(at < x["end"], x["page"]))

    found = both.select("doc", "spans", "strides", "n", T.let(F.col("source"), fold).alias("found"))
    # least and greatest pass over nulls: a chunk that was not found has no end either
    last = lambda f: F.when(f["hit"].isNotNull(), F.greatest(f["hit"], F.least(f["hit"] + f["size"], F.col("n")) - 1))
    paged = found.select("doc", F.explode(F.transform("found", lambda f: F.struct(f["chunk_index"].alias("chunk_index"), page(f["hit"]).alias("page_start"), page(last(f)).alias("page_end")))).alias("f"))
    return paged.select("doc", "f.*")
