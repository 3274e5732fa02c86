"""The seven tools over a library of tables, and their registry."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions import vectors as V
from marginalia.operators import audit, lexical, references, retrieval, structure

EVIDENCE_CHARS, PREVIEW_CHARS, TOP_CITED = 1600, 500, 5


@dataclass
class ToolResult:
    content: str
    evidence: list[dict] = field(default_factory=list)


@dataclass
class Library:
    """Tables by name (papers, sections, chunks, symbols, references, works, links, relations), and an embedding function."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    embed: Callable[[str], list[float]] | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def scoped(self, name: str, paper_id: int | None) -> DataFrame:
        return self[name] if paper_id is None else self[name].filter(F.col("paper_id") == paper_id)

    # retrieval

    def candidates(self, query: str, paper_id: int | None, least: float, mode: str, limit: int) -> DataFrame:
        none = F.lit(None).cast("double")
        found: list[DataFrame] = []

        def add(rows: DataFrame, name: str) -> None:
            if "semantic_score" not in rows.columns:
                rows = rows.withColumn("semantic_score", none)
            if "lexical_score" not in rows.columns:
                rows = rows.withColumn("lexical_score", none)
            found.append(retrieval.channel(rows.withColumn("qid", F.lit(0)), name, limit))

        chunks, symbols, refs = (self.scoped(n, paper_id) for n in ("chunks", "symbols", "references"))
        works = refs.join(self["works"].select(F.col("id").alias("global_ref_id"), F.col("title").alias("w_title"), F.col("abstract").alias("w_abstract"), F.col("embedding").alias("w_embedding")), "global_ref_id")
        if mode != "vector":
            hit = (F.lower("symbol") == query.lower()) | (F.lower("latex") == query.lower())
            add(symbols.filter(hit).select("id", F.lit(1.0).alias("lexical_score")), "EXACT_SYMBOL")
            add(lexical.search(chunks, query, "id", "heading_path", "content"), "TEXT_SECTION")
            add(lexical.search(symbols, query, "id", "symbol", "description", "simple"), "TEXT_SYMBOL")
            add(lexical.search(works, query, "id", "w_title", "w_abstract"), "TEXT_REFERENCE")
        if mode != "fulltext" and self.embed is not None:
            try:
                q = V.literal(self.embed(query))
            except Exception:
                if mode == "vector":
                    raise
                q = None  # text channels alone
            for rows, column, name in ((chunks, "embedding", "VECTOR_SECTION"), (symbols, "embedding", "VECTOR_SYMBOL"), (works, "w_embedding", "VECTOR_REFERENCE")) if q is not None else ():
                add(rows.filter(F.col(column).isNotNull()).select("id", V.cosine(F.col(column), q).alias("semantic_score")).filter(F.col("semantic_score") >= least), name)
        if not found:
            raise ValueError("no channel: vector mode needs an embedding function")
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def search(self, query: str, paper_id: int | None = None, threshold: float | None = None, mode: str = "hybrid", limit: int = retrieval.RESULTS) -> DataFrame:
        """Fused evidence with text, path, pages and quote."""
        query, paper_id, least, limit = retrieval.request(query, paper_id, threshold, limit)
        fused = retrieval.fuse(self.candidates(query, paper_id, least, retrieval.mode_of(mode), retrieval.CANDIDATES), limit)
        sections = self["chunks"].select(F.concat(F.lit("SECTION:"), F.col("id").cast("string")).alias("evidence_key"), "paper_id", "section_id", "heading_path", "page_start", "page_end", "content")
        symbols = self["symbols"].select(F.concat(F.lit("SYMBOL:"), F.col("id").cast("string")).alias("evidence_key"), "paper_id", F.concat_ws(" ", "description", F.concat(F.lit("Definition: "), "definition_formula")).alias("content"))
        refs = self["references"].select(F.concat(F.lit("REFERENCE:"), F.col("id").cast("string")).alias("evidence_key"), "paper_id", F.coalesce(F.nullif(T.jtrim("abstract"), F.lit("")), "raw_text").alias("content"))
        texts = sections.unionByName(symbols, allowMissingColumns=True).unionByName(refs, allowMissingColumns=True)
        return fused.join(texts, "evidence_key", "left").withColumn("quote", T.quote(F.coalesce("content", F.lit("")), F.lit(query))).drop("content").orderBy("position")

    def search_library(self, query: str, paper_id: int | None = None, threshold: float | None = None) -> ToolResult:
        rows = [r.asDict() for r in self.search(query, paper_id, threshold).collect()]  # RESULTS rows at most
        sections = list(dict.fromkeys(r["section_id"] for r in rows if r["evidence_type"] == "SECTION" and r["section_id"]))
        scores = [next(r["fusion_score"] for r in rows if r["section_id"] == s) for s in sections]
        n = min(retrieval.EXPANSIONS, len(sections))
        if n > 1 and scores[0] > 0 and (scores[1] <= 0 or scores[0] / scores[1] >= retrieval.GATE):
            n = 1
        lines = [f"{r['position']}. [{r['evidence_type']}] {r['heading_path'] or ''}{pages(r['page_start'], r['page_end'])} score {r['fusion_score']:.6f}\n{r['quote']}" for r in rows]
        evidence = [r | {"accessed_via": "search_library"} for r in rows]
        for section in sections[:n]:
            read = self.read_section(section)
            lines.append(read.content)
            evidence += read.evidence
        return ToolResult("\n\n".join(lines) or "no evidence", list({e["evidence_key"]: e for e in reversed(evidence)}.values())[::-1])

    # reading

    def paper_outline(self, paper_id: int) -> ToolResult:
        rows = self["sections"].filter(F.col("paper_id") == paper_id).select("id", "parent_id", "header", "idx").orderBy("idx").collect()  # one paper's
        nodes = {r.id: {"id": r.id, "header": r.header, "children": []} for r in rows}
        roots = []
        for r in rows:
            (nodes[r.parent_id]["children"] if r.parent_id in nodes and r.parent_id != r.id else roots).append(nodes[r.id])
        return ToolResult(json.dumps(roots, ensure_ascii=False))

    def read_section(self, section_id: str) -> ToolResult:
        own = self["sections"].filter(F.col("id") == section_id).first()
        if own is None:
            return ToolResult(f"no section {section_id}")
        paper = self["sections"].filter(F.col("paper_id") == own.paper_id)
        path = structure.heading_paths(paper.select("id", "parent_id", "header")).filter(F.col("id") == section_id).first().heading_path
        near = structure.siblings(paper, "paper_id", "id", "idx").filter(F.col("id") == section_id).first()
        parent = paper.filter(F.col("id") == own.parent_id).select("header", T.abbreviate("content", PREVIEW_CHARS).alias("t")).first()
        symbols = self["symbols"].filter((F.col("paper_id") == own.paper_id) & F.array_contains("source_ids", section_id)).orderBy("id").collect()
        links = self["links"].filter(F.col("section_id") == section_id).select("paper_id", "ref_index").distinct()
        refs = self["references"].join(links, ["paper_id", "ref_index"]).dropDuplicates(["id"]).orderBy("ref_index").collect()
        evidence = [{"evidence_key": f"SECTION:{section_id}", "evidence_type": "SECTION", "paper_id": own.paper_id, "heading_path": path, "quote": (own.content or "")[:EVIDENCE_CHARS], "accessed_via": "read_section"}]
        evidence += [{"evidence_key": f"SYMBOL:{s.id}", "evidence_type": "SYMBOL", "paper_id": own.paper_id, "heading_path": path, "quote": " ".join(x for x in (s.description, s.definition_formula and f"Definition: {s.definition_formula}") if x), "accessed_via": "read_section"} for s in symbols]
        evidence += [{"evidence_key": f"REFERENCE:{r.paper_id}:{r.ref_index}", "evidence_type": "REFERENCE", "paper_id": own.paper_id, "heading_path": path, "quote": (r.abstract or "").strip() or r.raw_text, "accessed_via": "read_section"} for r in refs]
        blocks = [f"Path: {path}", *[f"{s.symbol}: {s.description}" for s in symbols], *([f"Parent: {parent.header}\n{parent.t}"] if parent else []), own.content or "", *[f"[{r.ref_index}] {r.title}" for r in refs], f"Previous: {near.previous_id}  Next: {near.next_id}"]
        return ToolResult("\n\n".join(blocks), evidence)

    def lookup_reference(self, paper_id: int, ref_index: str) -> ToolResult:
        found = references.by_index(self["references"].filter(F.col("paper_id") == paper_id), str(ref_index)).orderBy("id").first()
        if found is None:
            return ToolResult(f"no reference {ref_index} in paper {paper_id}")
        said = (found.abstract or "").strip() or found.raw_text or ""
        return ToolResult(f"{found.title}\n{said}", [{"evidence_key": f"REFERENCE:{paper_id}:{ref_index}", "evidence_type": "REFERENCE", "paper_id": paper_id, "quote": said, "accessed_via": "lookup_reference"}])

    def check_relations(self, paper_id: int) -> ToolResult:
        both = audit.both_ways(self["relations"]).filter(F.col("paper_id") == paper_id)
        said = audit.narrative(F.col("type"), F.col("direction"), F.col("audit_status"), F.concat(F.lit("paper "), "other_id"), F.coalesce("description", F.lit("")))
        rows = both.select("other_id", "direction", said.alias("said")).orderBy("direction", "other_id").collect()
        return ToolResult("\n".join(r.said for r in rows) or "no relations")

    def find_papers(self, query: str, threshold: float | None = None) -> ToolResult:
        least = V.THRESHOLD if threshold is None else min(max(threshold, V.LEAST), V.MOST)
        papers = self["papers"].withColumn("score", V.cosine(F.col("embedding"), V.literal(self.embed(query))) if self.embed else F.lit(None).cast("double"))
        rows = papers.filter((F.col("score") > least) | F.col("title").ilike(f"%{query}%")).orderBy(F.col("score").desc_nulls_first(), "id").select("id", "title").limit(retrieval.CANDIDATES).collect()
        return ToolResult("\n".join(f"{r.id}: {r.title}" for r in rows) or "no papers")

    def top_cited(self, limit: int = TOP_CITED) -> ToolResult:
        rows = self["works"].orderBy(F.col("citation_count").desc_nulls_first(), "id").select("title", "citation_count").limit(max(1, limit)).collect()
        return ToolResult("\n".join(f"{r.title} ({r.citation_count})" for r in rows))

    # dispatch

    def call(self, name: str, arguments: str = "") -> ToolResult:
        """A tool by name; arguments are a JSON object, or plain text for the first parameter."""
        if name not in TOOLS:
            return ToolResult(f"unknown tool: {name}")
        tool = TOOLS[name]
        try:
            told = json.loads(arguments) if arguments.strip() else {}
        except ValueError:
            told = arguments.strip()
        if not isinstance(told, dict):
            told = {tool.parameters[0]: told}
        if "paper_id" in told and not isinstance(told["paper_id"], int):
            digits = "".join(c for c in str(told["paper_id"]) if c.isdigit())
            told["paper_id"] = int(digits) if digits else None
        return getattr(self, name)(**told)


def pages(first: int | None, last: int | None) -> str:
    return "" if first is None else f" (p. {first})" if last in (None, first) else f" (pp. {first}-{last})"


@dataclass(frozen=True)
class Tool:
    description: str
    parameters: tuple[str, ...]


TOOLS = {
    "search_library": Tool("ranked evidence for a question, with the best sections in full", ("query", "paper_id", "threshold")),
    "paper_outline": Tool("a paper's tree of sections", ("paper_id",)),
    "read_section": Tool("a section with its path, symbols, parent, references and neighbours", ("section_id",)),
    "lookup_reference": Tool("one reference of a paper", ("paper_id", "ref_index")),
    "check_relations": Tool("a paper's audited relations", ("paper_id",)),
    "find_papers": Tool("papers by title or meaning", ("query", "threshold")),
    "top_cited": Tool("the most cited works", ("limit",)),
}


def react(library: Library, think: Callable[[list[str]], str], question: str, steps: int = 20, keep: int = 30) -> ToolResult:
    """A reason/act loop: think(messages) answers with a JSON object of an action or a final answer; the last step must answer."""
    messages, evidence = [f"Question: {question}"], {}
    for step in range(1, steps + 1):
        if len(messages) > keep:
            del messages[2:4]
        said = think(messages + (["Answer now."] if step == steps else []))
        try:
            told = json.loads(said[said.index("{") : said.rindex("}") + 1])
        except ValueError:
            messages.append("The answer was no JSON object.")
            continue
        if told.get("answer") is not None or step == steps:
            return ToolResult(str(told.get("answer", "")), list(evidence.values()))
        result = library.call(str(told.get("action")), json.dumps(told.get("input", {})) if not isinstance(told.get("input"), str) else told["input"])
        for e in result.evidence:
            evidence.setdefault(e["evidence_key"], e)
        messages += [f"Action: {told.get('action')}", f"Observation: {result.content[:5000]}"]
    return ToolResult("", list(evidence.values()))
