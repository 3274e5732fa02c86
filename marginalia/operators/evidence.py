"""Evidence in other shapes: the three legacy results, embedding inputs, audit payloads, bounded context, links to papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T

PREVIEW = 500
EVIDENCE = "array<struct<evidenceKey:string,headingPath:string,quote:string>>"


def legacy_sections(evidence: DataFrame) -> DataFrame:
    shape = {"id": "section_id", "paper_id": "paper_id", "header": "heading_path", "content": "quote", "score": "fusion_score", "source_paper_title": "paper_title"}
    return evidence.filter("evidence_type = 'SECTION'").select(*[F.col(b).alias(a) for a, b in shape.items()])


def legacy_symbols(evidence: DataFrame) -> DataFrame:
    shape = {"paper_id": "paper_id", "symbol": "heading", "description": "quote", "score": "fusion_score", "source_paper_title": "paper_title"}
    return evidence.filter("evidence_type = 'SYMBOL'").select(*[F.col(b).alias(a) for a, b in shape.items()])


def legacy_references(evidence: DataFrame) -> DataFrame:
    shape = {"paper_id": "paper_id", "ref_id": "reference_index", "title": "heading", "abstract_text": "quote", "score": "fusion_score", "source_paper_title": "paper_title"}
    return evidence.filter("evidence_type = 'REFERENCE'").select(*[F.col(b).alias(a) for a, b in shape.items()])


def _said(x: Column | str) -> Column:
    return F.coalesce(x if isinstance(x, Column) else F.col(x), F.lit(""))


def chunk_embedding_text(heading_path: Column | str, content: Column | str) -> Column:
    return F.concat(F.lit("Heading path: "), _said(heading_path), F.lit("\nContent: "), _said(content))


def section_embedding_text(header: Column | str, content: Column | str) -> Column:
    """The header and the first PREVIEW characters."""
    return F.concat(F.lit("Section: "), _said(header), F.lit("\nContent: "), F.substring(_said(content), 1, PREVIEW))


def symbol_embedding_text(symbol: Column | str, meaning: Column | str, latex: Column | str, formula: Column) -> Column:
    """The definition is named only where there is one."""
    told = F.concat(F.lit("Symbol: "), _said(symbol), F.lit("; Meaning: "), _said(meaning), F.lit("; LaTeX Representation: "), _said(latex))
    return F.when(formula.isNotNull(), F.concat(told, F.lit("; Definition Formula: "), formula)).otherwise(told)


def audit_evidence_text(label: str, payload: Column | str, missing: str = "legacy") -> Column:
    """The evidence that a relation cites, a line each; nothing for none, and a note for a payload that is no JSON array."""
    raw = T.jtrim(F.coalesce(payload if isinstance(payload, Column) else F.col(payload), F.lit("")))
    items = F.from_json(raw, EVIDENCE, {"mode": "PERMISSIVE"})
    line = lambda e: F.concat(F.lit("  - ["), _said(e["evidenceKey"]), F.lit("] "), F.coalesce(e["headingPath"], F.lit(missing)), F.lit(" | "), F.coalesce(e["quote"], F.lit(missing)))
    told = F.array_join(F.concat(F.array(F.lit(f"  {label}:")), F.transform(items, line)), "\n")
    broken = ~raw.startswith("[") | ~raw.endswith("]") | items.isNull()
    return F.when(raw.isin("", "[]"), F.lit("")).when(broken, F.lit(f"  {label}: unavailable (legacy audit payload)")).when(F.size(items) == 0, F.lit("")).otherwise(told)


def joined_versions(source: Column | str, target: Column | str) -> Column:
    return F.concat(F.lit("source="), _said(source), F.lit(";target="), _said(target))


def bounded(value: Column | str, n: int) -> Column:
    """Trimmed, and its first n characters."""
    return F.substring(T.jtrim(value), 1, n)


def one_line(value: Column | str, n: int) -> Column:
    return F.regexp_replace(bounded(value, n), r"[\r\n]+", " ")


def link_papers(canonical: DataFrame, papers: DataFrame, on: str = "fingerprint") -> DataFrame:
    """canonical works with linked_paper_id: the smallest id of the papers here with the same fingerprint, else null."""
    known = papers.filter(F.col(on).isNotNull()).groupBy(on).agg(F.min("paper_id").alias("linked_paper_id"))
    return canonical.join(known, on, "left")
