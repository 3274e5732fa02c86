"""Views of a library of papers: filters, orders, contexts, and model calls as injected providers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.ingest import CORE, RERUN_FROM, STAGES

#: A mark for each status.
MARKS = {"UPLOADED": "up", "PARSING": "busy", "PARSED": "text", "AUDITING": "busy", "READY": "ok", "FAILED": "error"}


def with_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is in a table of ids."""
    return rows.join(ids.select(F.col(id_col)).distinct(), id_col, "left_semi")


def titled(rows: DataFrame, part: str, title: str = "title") -> DataFrame:
    return rows.filter(F.lower(title).contains(part.strip().lower()))


def symbols_like(symbols: DataFrame, word: str, *columns: str) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(word.lower()), F.lit(False))
    return symbols.filter(hit)


def whole_metadata(rows: DataFrame, surnames: str = "surnames", year: str = "year") -> DataFrame:
    """ok: a surname at least, and a year other than 0."""
    return rows.withColumn("ok", F.coalesce((F.size(surnames) > 0) & (F.col(year) != 0), F.lit(False)))


def current_outgoing(relations: DataFrame, paper_id: int, version: str) -> DataFrame:
    return relations.filter((F.col("source") == paper_id) & (F.col("audit_version") == version))


def citing_sections(links: DataFrame, sections: DataFrame) -> DataFrame:
    """paper_id, ref_index, section_ids: where each reference is cited."""
    joined = links.join(sections.select(F.col("id").alias("section_id"), "idx"), "section_id")
    told = joined.groupBy("paper_id", "ref_index").agg(F.array_sort(F.collect_set(F.struct("idx", "section_id"))).alias("s"))
    return told.select("paper_id", "ref_index", F.transform("s", lambda x: x["section_id"]).alias("section_ids"))


def roots(sections: DataFrame) -> DataFrame:
    return sections.filter(F.col("parent_id").isNull()).orderBy("paper_id", "idx")


def newest_artifact(files: DataFrame, doc: str, path: str, modified: str, stem: str) -> DataFrame:
    """Each document's artifact: of its own name first, then the newest."""
    own = F.element_at(F.split(path, "/"), -1) == F.concat(F.col(stem), F.lit(".md"))
    order = W.partitionBy(doc).orderBy(own.desc(), F.col(modified).desc(), path)
    return files.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def workspaces(stored: DataFrame, rebuilt: DataFrame, key: str, updated: str) -> DataFrame:
    """Stored rows, and rebuilt ones whose key is not stored, newest first."""
    return stored.unionByName(rebuilt.join(stored.select(key), key, "left_anti"), allowMissingColumns=True).orderBy(F.col(updated).desc_nulls_last(), key)


def metadata_context(sections: DataFrame, doc: str, idx: str, header: str, content: str, n: int = 3) -> DataFrame:
    """doc, context: headers and bodies of the first n sections, in order."""
    first = sections.withColumn("__n", F.row_number().over(W.partitionBy(doc).orderBy(idx))).filter(F.col("__n") <= n)
    told = first.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("__n", F.concat_ws("\n", header, content).alias("t")))).alias("r"))
    return told.select(F.col(doc).alias("doc"), F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("context"))


def status_mark(status: Column) -> Column:
    out = F.lit("?")
    for k, v in MARKS.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def reference_like(text: Column) -> Column:
    """Whether a line reads like a reference: a number or author first, and a year."""
    return text.rlike(r"^(?:\[\d+\]|\d+\.|[A-Z][A-Za-z'’\-]+,)\s.*\b(?:19|20)\d{2}[a-z]?\b")


def outline_key(level: Column, header: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), header)


def upper_share(text: Column) -> Column:
    """Upper-case letters among letters; 0 with fewer than three."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters >= 3, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters).otherwise(F.lit(0.0))


def latin_words(text: Column) -> Column:
    """Words with two Latin letters or more."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: F.length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 2))


def split_numbered(line: Column) -> tuple[Column, Column]:
    """Heading and body of `1.2 A heading. The text goes on`."""
    pattern = r"^(\d+(?:\.\d+)*\.?\s+[A-Z][^.]{6,96}\.)\s+(\S.*)$"
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(line, pattern, 2), F.lit(""))


def split_standard(line: Column) -> tuple[Column, Column]:
    """Heading and body where a line opens with the name of an end section."""
    pattern = r"(?i)^(acknowledge?ments?|data availability)\s*[:.\-—]\s*(\S.*)$"
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(line, pattern, 2), F.lit(""))


def extract(rows: DataFrame, provider: Callable[[str, str], list[dict]], schema: str, id_col: str, title: str, body: str) -> DataFrame:
    """id and the provider's rows for each (title, text); an error of the provider gives no rows.

    schema: that of the provider's rows, as a DDL string.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, a, b in zip(pdf["k"], pdf["a"], pdf["b"]):
                try:
                    out += [(key, *(r.get(n) for n in names)) for r in provider(a, b)]
                except Exception:
                    continue
            yield pd.DataFrame(out, columns=["id", *names])

    return rows.select(F.col(id_col).alias("k"), F.col(title).alias("a"), F.col(body).alias("b")).mapInPandas(run, f"id {kind}, {schema}")


def resume_from(failed_stage: str | None, chosen: str | None = None) -> list[str]:
    """The stages that a retry (from the failed stage) or a rerun (from a chosen one) goes through; earlier tables are reused."""
    stage = chosen or failed_stage
    if stage not in STAGES:
        raise ValueError(f"no stage to resume from: {stage}")
    if chosen and STAGES.index(chosen) < RERUN_FROM:
        raise ValueError(f"a rerun cannot start at {chosen}")
    return list(STAGES[STAGES.index(stage) :])


def post_processing() -> list[str]:
    return list(STAGES[CORE:])


def run_stages(stages: list[str], work: dict[str, Callable[[], DataFrame]], log: Callable[[str, str, str | None], None]) -> dict[str, DataFrame]:
    """Runs stages in order, telling the log of start, completion and failure; a failure ends the run."""
    done: dict[str, DataFrame] = {}
    for stage in stages:
        if stage not in work:
            continue
        log(stage, "RUNNING", None)
        try:
            done[stage] = work[stage]()
        except Exception as e:
            log(stage, "FAILED", str(e)[:500])
            raise
        log(stage, "COMPLETED", None)
    return done


def blank_free(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(~T.blank(column))
