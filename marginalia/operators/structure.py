"""Outlines and lines: paths, trees, neighbours, line flags, heading decisions, sections."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.lineage import cut


def heading_paths(sections: DataFrame, id_col: str = "id", parent_col: str = "parent_id", header_col: str = "header") -> DataFrame:
    """id, heading_path (root > ... > own) and level, however deep; a row that repeats an ancestor stops there.

    An unknown parent makes a root. Each round joins every path with that of its next ancestor, so known paths double in
    length: one equi-join and a checkpoint a doubling, until no row has an ancestor left to add.
    """
    base = sections.select(F.col(id_col).alias("id"), F.col(parent_col).alias("next"), F.col(header_col).alias("header"))
    now = cut(base.select("id", "next", F.array("header").alias("path"), F.array("id").alias("seen")))  # own first
    while not now.filter("next is not null").isEmpty():
        up = now.select(F.col("id").alias("p_id"), F.col("next").alias("p_next"), F.col("path").alias("p_path"), F.col("seen").alias("p_seen"))
        again = F.get(F.array_intersect("p_seen", "seen"), F.lit(0))  # the first ancestor met a second time
        more = F.when(again.isNull(), F.size("p_seen")).otherwise(F.array_position("p_seen", again).cast("int") - 1)
        joined = now.join(up, F.col("next") == F.col("p_id"), "left").withColumn("more", F.coalesce(more, F.lit(0))).withColumn("done", F.col("p_id").isNull() | again.isNotNull())
        now = cut(joined.select(
            "id", F.when(~F.col("done"), F.col("p_next")).alias("next"), F.when(F.col("more") > 0, F.concat("path", F.slice("p_path", F.lit(1), F.col("more")))).otherwise(F.col("path")).alias("path"),
            F.when(F.col("more") > 0, F.concat("seen", F.slice("p_seen", F.lit(1), F.col("more")))).otherwise(F.col("seen")).alias("seen"),
        ))
    return now.select("id", F.array_join(F.reverse("path"), " > ").alias("heading_path"), F.size("path").alias("level"), F.reverse("seen").alias("ancestry"))


def depth_first(sections: DataFrame, doc_col: str, id_col: str, parent_col: str, idx_col: str) -> DataFrame:
    """doc, id, position: depth-first order with children by idx, from a sortable path of indices."""
    keyed = sections.select(F.col(doc_col).alias("doc"), F.col(id_col).alias("id"), F.col(parent_col).alias("parent_id"), F.lpad(F.col(idx_col).cast("string"), 12, "0").alias("header"))
    paths = heading_paths(keyed).select("id", "heading_path")
    return keyed.join(paths, "id").select("doc", "id", F.row_number().over(W.partitionBy("doc").orderBy("heading_path", "id")).alias("position"))


def outline_nodes(sections: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """id, parent (null when unknown: a root) and children, in order."""
    ids = sections.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent_id"))
    known = ids.join(ids.select(F.col("id").alias("parent")), F.col("parent_id") == F.col("parent"), "left").select("id", "parent")
    children = known.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    return known.join(children, "id", "left").select("id", "parent", F.coalesce("children", F.array().cast("array<bigint>")).alias("children"))


def siblings(sections: DataFrame, doc_col: str, id_col: str, idx_col: str) -> DataFrame:
    w = W.partitionBy(doc_col).orderBy(idx_col, id_col)
    return sections.select(doc_col, id_col, F.lag(id_col).over(w).alias("previous_id"), F.lead(id_col).over(w).alias("next_id"))


def lines(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """doc, ln (from 0), line."""
    return docs.select(F.col(doc_col).alias("doc"), F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\r\n?", "\n"), "\n")).alias("ln", "line"))


def line_flags(rows: DataFrame) -> DataFrame:
    """blank_before, blank_after (true at the edges), after_references (not of its own line), text and key (see heading_text, heading_key) and kind."""
    w = W.partitionBy("doc").orderBy("ln")
    # dealt by document first: the window needs that anyway, and the patterns then run in all tasks, once a line, as text and key pass the window
    rows = rows.repartition("doc").select("*", T.heading_text("line").alias("text")).select("*", T.heading_key("text").alias("key"))
    empty = F.coalesce(T.blank("line"), F.lit(True))
    is_ref = F.col("key").isin(*T.REFERENCES)
    flagged = rows.select(
        "*", F.coalesce(F.lag(empty).over(w), F.lit(True)).alias("blank_before"), F.coalesce(F.lead(empty).over(w), F.lit(True)).alias("blank_after"),
        F.coalesce(F.max(is_ref).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False)).alias("after_references"),
    )
    return flagged.withColumn("kind", T.kind_of(F.col("line"), F.col("text"), F.col("key"), F.col("after_references")))


DECISION = "ln int, line string, kind string, action string, level int, confidence double, reason string, heading string, body string"
#: How titles of main sections begin, subheadings that stand below the heading before, text after a heading's first sentence, letters that
#: count as Roman numbers.
MAJOR = ("introduction", "background", "method", "model", "experiment", "result", "discussion", "conclusion", "summary")
LOCAL, SENTENCE, ROMAN_LETTERS = re.compile(r"(?:the )?algorithm|method\s+\d+\.?"), re.compile(r"(.{8,100}?\.)\s+([A-Z].+)"), "IVX"
NUMBERING = re.compile(r"(?P<decimal>\d+(?:\.\d+)+)\.?\s+|(?P<numbered>\d{1,9})\.\s+|§\s*(?P<sign>\d+)\.\s+|(?P<letter>[A-Z])\.\s+|(?P<roman>[IVXLCDM]+)\.\s+")
CHAPTER_LINE, MAIN_NUMBER = re.compile(r"(?i)chapter\s+\d+\b"), re.compile(r"(\d{1,9})[.\s]\s+.")
LEAST_CAPITALS, UPPER = 3, 0.65
#: Kinds of marked lines that end a noise block.
RESTART = ("ABSTRACT", "REFERENCES", "SECTION", "SUBSECTION", "APPENDIX")


def decide_headings(flags: DataFrame) -> DataFrame:
    """Which lines are headings, and at what level: a fold over each document's lines.

    action is HEADING, SPLIT (the line holds a heading and the text after it), TEXT or DROP; heading and body are what a HEADING or SPLIT gives. The state
    carried is the title, the abstract, the references, a noise block, the appendix, the last level and the last main
    number; a task folds its documents one after another, as batches come, so no document is held whole.
    """
    title = T.is_title(F.col("text"), F.col("key"), F.col("kind"))
    wordy = F.when(title, T.has_latin_words(F.col("text"), T.TITLE_WORDS))
    rows = flags.select("doc", "ln", "line", "kind", "text", "key", T.is_standard(F.col("key")).alias("standard"), title.alias("title"), wordy.alias("wordy"))
    return rows.repartition("doc").sortWithinPartitions("doc", "ln").mapInPandas(_decide, f"doc {flags.schema['doc'].dataType.simpleString()}, {DECISION}")


def _decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    doc, fold = None, Outline()
    for pdf in frames:
        out = []
        for r in pdf.itertuples():
            if r.doc != doc:
                doc, fold = r.doc, Outline()
            out.append((r.doc, r.ln, r.line or "", r.kind, *fold.decide(Line(r.line or "", r.kind, r.text or "", r.key or "", r.standard is True, r.title is True, r.wordy is True))))
        yield pd.DataFrame(out, columns=["doc", "ln", "line", "kind", "action", "level", "confidence", "reason", "heading", "body"])


class Line(NamedTuple):
    """A line with what its text says by itself: text and key, whether it names a standard section, may be a title, has words enough for a bare one."""

    line: str
    kind: str
    text: str
    key: str
    standard: bool
    title: bool
    wordy: bool

    @property
    def marks(self) -> int:
        found = re.match(r"[\x00-\x20]*(#{1,6})\s+\S", self.line)
        return len(found[1]) if found else 0


def _major(title: str) -> bool:
    """Does a numbered title name a main section: by its first word, or in capitals throughout; a step of an algorithm never does."""
    words = title.lower().split()
    if not words or words[0] in T.IMPERATIVE:
        return False
    capitals, letters = (sum(map(test, title)) for test in (str.isupper, str.isalpha))
    return title.lower().startswith(MAJOR) or capitals >= max(LEAST_CAPITALS, math.ceil(UPPER * letters))


class Outline:
    """What a document's lines so far say about the next one."""

    def __init__(self) -> None:
        self.title: str | None = None
        self.abstract = self.references = self.noise = self.appendix = False
        self.last, self.main = 1, 0

    def decide(self, x: Line) -> tuple[str, int, float, str, str | None, str | None]:
        """(action, level, confidence, reason, heading, body) of the next line."""
        if x.kind == "BODY" and x.line[:1].isalnum() and self.title is not None and not self.noise:  # most lines: not blank, no mark, no heading's form
            return ("TEXT", 0, 0.98, "inside the references", None, None) if self.references else ("TEXT", 0, 0.65, "body", None, None)
        marks = x.marks
        if self.noise and not (x.text and marks and x.kind not in ("NOISE", "THEOREM_LIKE") and (x.kind in RESTART or x.standard or x.title)):
            return "DROP", 0, 0.98, "inside a noise block", None, None
        self.noise = False
        if not x.text:
            return ("DROP", 0, 1.0, "blank before the title", None, None) if self.title is None else ("TEXT", 0, 1.0, "blank", None, None)
        if x.kind == "NOISE":
            self.noise = x.key in T.BLOCK_OPENERS
            return "DROP", 0, 0.99, "noise", None, None
        if self.title is None:
            if x.title and (marks or x.wordy):
                self.title = x.key
                return "HEADING", 1, 0.98 if marks else 0.82, "marked title" if marks else "bare title", x.text, None
            return "DROP", 0, 0.75, "before the title", None, None
        if marks and self.title and x.key == self.title:
            return "DROP", 0, 0.95, "repeats the title", None, None
        if marks and x.kind == "UNCERTAIN" and not self.abstract:
            return "DROP", 0, 0.88, "uncertain heading before the abstract", None, None
        if self.references and x.kind != "REFERENCES":
            return "TEXT", 0, 0.98, "inside the references", None, None
        found = self.after_title(x, marks)
        if found[0] in ("HEADING", "SPLIT"):
            self.follow(x.kind, found[1], found[4])
        return found

    def follow(self, kind: str, level: int, heading: str) -> None:
        """The state after a heading."""
        self.last = level
        self.references |= kind == "REFERENCES"
        self.abstract |= kind == "ABSTRACT"
        self.appendix = kind == "APPENDIX" or self.appendix and level > 2
        if level == 2 and (number := MAIN_NUMBER.match(heading)):
            self.main = int(number[1])

    def after_title(self, x: Line, marks: int) -> tuple[str, int, float, str, str | None, str | None]:
        text, kind = x.text, x.kind
        number = NUMBERING.match(text)
        form = number.lastgroup if number else None
        if kind in ("THEOREM_LIKE", "LIST_ITEM", "REFERENCE_ITEM"):
            return "TEXT", 0, 0.95, "a statement, step or reference, not a heading", None, None
        if kind == "ABSTRACT":
            inline = re.match(T.INLINE_ABSTRACT, text)
            return self.headed(2, 0.99, "abstract", "Abstract", inline[2].strip() if inline else "")
        if kind == "REFERENCES":
            return self.headed(2, 0.99, "references", "References", "")
        if kind == "APPENDIX":
            named = re.match(r"(?i)(appendix\s+[A-Z])[:.]?\s+(.+)$", text)
            head, body = self.sentence(named[2]) if named else (text, "")
            return self.headed(2, 0.92, "appendix", f"{named[1]}. {head}" if named else head, body)
        if kind == "SECTION" and (end := re.match(T.END_SECTION, x.key)):
            return self.headed(2, 0.9, "an end section", end[0].title(), re.sub(r"^[:.]\s*", "", text[len(end[0]) :].strip()))
        head, body = self.parts(text, number)
        if marks:
            return self.headed(self.level(x, number, marks), 0.9, "marked heading", head, body)
        if kind == "SUBSECTION" and form == "decimal":
            return self.headed(3, 0.86, "bare decimal subsection", head, body)
        sure = _major(text[number.end() :]) if form == "numbered" else form in ("roman", "letter") or x.standard
        if kind == "SECTION" and sure:
            return self.headed(self.level(x, number, 0), 0.84, "bare section", head, body)
        return "TEXT", 0, 0.65, "body", None, None

    def headed(self, level: int, sure: float, why: str, heading: str, body: str) -> tuple[str, int, float, str, str | None, str | None]:
        return ("SPLIT" if body else "HEADING"), level, sure, why, heading, body or None

    def sentence(self, text: str) -> tuple[str, str]:
        """A heading and the text after its first sentence."""
        split = SENTENCE.fullmatch(text)
        return (split[1], split[2]) if split else (text, "")

    def parts(self, text: str, number: re.Match | None) -> tuple[str, str]:
        """Heading and body of a numbered line; others are heading throughout."""
        if not number or number.lastgroup not in ("decimal", "numbered", "sign"):
            return text, ""
        head, body = self.sentence(text[number.end() :])
        return f"{number[number.lastgroup]}. {head}", body

    def level(self, x: Line, number: re.Match | None, marks: int) -> int:
        """A heading's level by its own form, then by the headings before; marks is 0 for bare lines."""
        text, form = x.text, number.lastgroup if number else None
        if x.standard or CHAPTER_LINE.match(text) or form in ("sign", "roman"):
            return 2
        if form == "decimal":
            return min(number["decimal"].count(".") + 2, 4)
        if form == "letter":
            return 2 if number["letter"] in ROMAN_LETTERS else 3
        if form == "numbered":
            if self.appendix:
                return 3
            goes_on = 0 < self.main < int(number["numbered"])
            return 4 if marks and not goes_on and self.last >= 3 and not _major(text[number.end() :]) else 2
        if self.appendix:
            return 3
        if self.last >= 3 and LOCAL.fullmatch(x.key):
            return min(self.last + 1, 4)
        return min(max(marks, 2), 4)


def outline_report(decisions: DataFrame) -> DataFrame:
    """doc, n_headings, mean_confidence (0 if none), has_title, has_references."""
    heading = F.col("action").isin("HEADING", "SPLIT")
    return decisions.groupBy("doc").agg(
        F.count_if(heading).alias("n_headings"), F.coalesce(F.avg(F.when(heading, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"),
        F.bool_or(heading & (F.col("level") == 1)).alias("has_title"), F.bool_or(heading & (F.col("kind") == "REFERENCES")).alias("has_references"),
    )


def normalised_markdown(decisions: DataFrame) -> DataFrame:
    heading = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("heading"))
    text = F.when(F.col("action").isin("HEADING", "SPLIT"), F.concat_ws("\n", heading, F.col("body"))).otherwise(F.col("line"))
    kept = decisions.filter("action <> 'DROP'").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ln", text.alias("t")))).alias("rows"))
    return kept.select("doc", F.array_join(F.transform("rows", lambda r: r["t"]), "\n").alias("markdown"))


def sections(rows: DataFrame) -> DataFrame:
    """doc, idx, header, level, content from lines: a new section at each `#` heading; a line joins the one before unless
    that ends a sentence. The part before the first heading is section 0, if it has text."""
    w = W.partitionBy("doc").orderBy("ln")
    # text and key pass a window before the filter that tests them, so their patterns run once a line
    heading = r"^\s*(#{1,9})\s+(\S.*)$"
    told = rows.repartition("doc").select("*", F.col("line").rlike(heading).alias("is_heading"), T.page_noise("line").alias("noise"))
    numbered = told.select("*", F.sum(F.col("is_heading").cast("int")).over(w).alias("idx")).filter("is_heading or not noise")
    body = numbered.filter(~F.col("is_heading") & ~T.blank("line")).select("doc", "idx", "ln", T.jtrim("line").alias("t"))
    inner = W.partitionBy("doc", "idx").orderBy("ln")
    joiner = F.when(F.lag("t").over(inner).isNull(), F.lit("")).when(F.lag("t").over(inner).rlike(r"[.!?:;]$"), F.lit("\n")).otherwise(F.lit(" "))
    text = body.select("doc", "idx", F.struct("ln", F.concat(joiner, "t").alias("t")).alias("r")).groupBy("doc", "idx").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    content = text.select("doc", "idx", F.array_join(F.transform("rows", lambda r: r["t"]), "").alias("content"))
    heads = numbered.filter("is_heading").select("doc", "idx", T.jtrim(F.regexp_extract("line", heading, 2)).alias("header"), F.length(F.regexp_extract("line", heading, 1)).alias("level"))
    both = heads.join(content, ["doc", "idx"], "full").select("doc", "idx", F.coalesce("header", F.lit("")).alias("header"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("content", F.lit("")).alias("content"))
    return both


def parents(rows: DataFrame) -> DataFrame:
    """doc, idx, level, parent_idx: the nearest earlier section of a lower level of 1 or more; none for levels up to 1."""
    w = W.partitionBy("doc").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    before = [F.max(F.when(F.col("level") == k, F.col("idx"))).over(w).alias(f"__l{k}") for k in range(1, 9)]
    at = rows.select("*", *before)
    pick = F.greatest(*[F.when(F.col("level") > k, F.col(f"__l{k}")) for k in range(1, 9)])
    return at.select("doc", "idx", "level", F.when(F.col("level") > 1, pick).alias("parent_idx"))


#: Headings of the second level that are no titles, and how others of them begin.
NOT_TITLES, NOT_TITLES_START = ("abstract", "index"), ("introduction", "author")


def titles(rows: DataFrame, default: str = "Untitled Paper") -> DataFrame:
    """doc, title: of the lines that are no page's own, the first `# ` heading or the first `## ` heading that names no section, whichever comes first; else the default."""
    line = T.jtrim("line")
    bare = T.jtrim(F.regexp_replace(F.regexp_replace(line, r"^#+\s*", ""), "[*_]", ""))
    named = F.lower(bare).isin(*NOT_TITLES)
    for start in NOT_TITLES_START:
        named = named | F.lower(bare).startswith(start)
    fits = (line.startswith("# ") | line.startswith("## ") & ~named) & ~T.page_noise("line")
    found = rows.groupBy("doc").agg(F.min(F.when(fits, F.struct("ln", bare.alias("title")))).alias("a"))
    return found.select("doc", F.coalesce("a.title", F.lit(default)).alias("title"))


#: Phrases of a paragraph that is an abstract without saying so, and the answer where there is none.
CUES, NO_ABSTRACT = ("IN THIS PAPER", "WE PROPOSE", "STUDY", "RESULTS SHOW"), "Abstract Not Found"


def abstracts(rows: DataFrame, missing: str = NO_ABSTRACT) -> DataFrame:
    """doc, abstract from sections (doc, idx, header, content).

    (a) The first section named so: its text. (b) Without one, the first section from the word on. (c) Where both give nothing, in the first half of
    the sections, of 100 characters or more: from the word up to the introduction, or the first paragraph of 301 to 2,499 characters with a cue.
    """
    w = W.partitionBy("doc").orderBy("idx")
    at = rows.select("doc", "idx", "content", F.upper("header").contains("ABSTRACT").alias("named"), F.row_number().over(w).alias("place"), F.count(F.lit(1)).over(W.partitionBy("doc")).alias("n"))
    up = F.upper("content")
    from_word = F.when(up.contains("ABSTRACT"), F.substr("content", F.instr(up, "ABSTRACT")))
    intro = F.instr(F.upper("word"), "INTRODUCTION")
    upto = F.when(intro > 0, F.substring("word", F.lit(1), intro - 1)).otherwise(F.col("word"))
    cued = lambda p: F.length(p).between(301, 2499) & F.reduce(F.array(*map(F.lit, CUES)), F.lit(False), lambda found, cue: found | F.upper(p).contains(cue))
    paragraph = F.try_element_at(F.filter(F.split("content", "\n\n"), cued), F.lit(1))
    at = at.withColumn("word", from_word)
    scan = (F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") / 2))) & (F.length("content") >= 100)
    told = at.groupBy("doc").agg(
        F.min(F.when(F.col("named"), F.struct("idx", F.col("content").alias("t")))).alias("a"), F.max(F.when(F.col("place") == 1, F.col("word"))).alias("b"),
        F.min(F.when(scan & F.coalesce("word", paragraph).isNotNull(), F.struct("idx", F.when(F.col("word").isNotNull(), upto).otherwise(paragraph).alias("t")))).alias("c"),
    )
    explicit = F.when(F.col("a").isNotNull(), F.nullif(F.col("a.t"), F.lit(""))).otherwise(F.col("b"))
    return told.select("doc", F.coalesce(T.clean_abstract(F.coalesce(explicit, F.nullif(F.col("c.t"), F.lit("")))), F.lit(missing)).alias("abstract"))
