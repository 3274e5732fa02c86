"""Outline repair: headings that a parser lost, chapter lines told twice, levels of numbered sections.

A line is parsed once, by `parsed`, into its form, its numbers and its title; every rule asks these fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.structure import parents

#: Numbers at the start of a line: a path of two or more needs a dot or a blank after it, a single one a blank, with or without a dot.
NUMBERS = r"^((?i:chapter)\s+)?(\d+(?:\.\d+)+(?=[.\s])|\d+(?=\.?\s|\.?$))\.?\s*"
#: Where a heading's first sentence may end, in characters, and how many headings back a chapter may have been told.
SENTENCE_FROM, SENTENCE_TO, LOOK_BACK = 8, 100, 4
#: Headings that own no numbered children.
CHILDLESS, CHILDLESS_START = ("abstract", "references", "bibliography"), ("acknowledg", "appendix")
MOST_BARE = 99


def marker(line: Column | str) -> tuple[Column, Column]:
    """The numbering of a heading line and what follows it; an empty numbering where there is none."""
    text = T.heading_text(line)
    pattern = r"^((?i:chapter)\s+\d+\.?|§\s*\d+(?:\.\d+)*|\d+(?:\.\d+)*\.?|[IVXLCDM]+\.|[A-Z]\.)\s+(.*)$"
    return F.regexp_extract(text, pattern, 1), F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 2)).otherwise(text)


def normal_kind(kind: Column, text: Column, level: Column) -> Column:
    """A heading's kind after its level is known: numbered lines deeper than 2 are subsections, and single letters stand below sections."""
    single = text.rlike(r"^[A-HJ-UWYZ]\.\s")
    return F.when((kind == "SECTION") & ((level >= 3) | single), "SUBSECTION").when((kind == "SUBSECTION") & (level <= 2) & ~single, "SECTION").otherwise(kind)


def words_of(text: Column) -> Column:
    """A heading's words alone, in lower case."""
    return T.jtrim(F.regexp_replace(F.lower(text), r"[\W_]+", " "))


def parsed(text: Column) -> Column:
    """form (chapter, path, number or plain), numbers, title and words of a line's text."""
    numbers = F.transform(F.split(F.nullif(F.regexp_extract(text, NUMBERS, 2), F.lit("")), r"\."), lambda x: x.try_cast("int"))
    chapter = F.regexp_extract(text, NUMBERS, 1) != ""
    form = F.when(numbers.isNull(), "plain").when(chapter, "chapter").when(F.size(numbers) > 1, "path").otherwise("number")
    return F.struct(form.alias("form"), numbers.alias("numbers"), F.regexp_replace(text, NUMBERS, "").alias("title"), words_of(text).alias("words"))


def first_sentence(title: Column) -> tuple[Column, Column]:
    """A title up to the end of its first sentence, and the text after it: null where nothing follows."""
    ends = F.regexp_instr(F.substr(title, F.lit(SENTENCE_FROM + 1)), F.lit(r"\.\s+[A-Z]."))
    cut = F.when(ends.between(1, SENTENCE_TO - SENTENCE_FROM + 1), ends + SENTENCE_FROM)
    return F.when(cut.isNull(), title).otherwise(F.substr(title, F.lit(1), cut)), F.ltrim(F.substr(title, cut + 1))


def recover_headings(lines: DataFrame) -> DataFrame:
    """doc, ln, part, line of lines (doc, ln, line), with headings where a parser lost them.

    A bare `n Title` becomes a heading when the next numbered line after it is `n.m`, before any other main number and the references:
    one look ahead by window. Text after its first sentence becomes a line of its own. The first item of a list of references that
    has no heading gets one. A document's lines are in one window, as its order needs.
    """
    w = W.partitionBy("doc").orderBy("ln")
    rows = lines.select("doc", "ln", "line", T.heading_text("line").alias("t"), F.col("line").rlike(r"^\s*#{1,6}\s+\S").alias("marked")).select("*", parsed(F.col("t")).alias("p"))
    refs = T.heading_key("t").isin(*T.REFERENCES)
    rows = rows.select("*", refs.alias("refs"), F.col("t").rlike(r"^(?:\[\d+\]|\$\^(?:\d+|\{\d+\})\$)\s*\S").alias("item"))
    # what the next line that bears on the outline is: the first number of a path, or none of them
    told = F.when(F.col("refs") | (F.col("p.form") == "number"), F.lit(-1)).when(F.col("p.form") == "path", F.col("p.numbers")[0])
    rows = rows.select(
        "*", F.min(F.when(F.col("refs") | F.col("item"), F.col("ln"))).over(W.partitionBy("doc")).alias("ends"),
        F.first(told, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("ahead"),
    )
    title, number = T.collapse("p.title"), F.col("p.numbers")[0]
    cited = title.rlike(r"\b(?:19|20)\d{2}\b") & title.rlike(r"(?i)\bet al\b|\bpp\.|\bvol\.|\bdoi\b")
    order = F.element_at(F.split(words_of(title), " "), 1).isin(*T.IMPERATIVE)
    bare = (F.col("p.form") == "number") & ~F.col("marked") & (number <= MOST_BARE) & title.rlike("^[A-Z]") & ~order & ~cited
    lost = F.coalesce(bare & (F.col("ahead") == number) & (F.col("ends").isNull() | (F.col("ln") < F.col("ends"))), F.lit(False))
    head, rest = first_sentence(title)
    heading = F.concat(F.lit("## "), number.cast("string"), F.lit(". "), head)
    opened = (F.col("ln") == F.col("ends")) & F.col("item") & ~F.col("refs")
    parts = F.when(lost, F.array_compact(F.array(heading, rest))).when(opened, F.array(F.lit("## References"), F.col("line"))).otherwise(F.array("line"))
    return rows.select("doc", "ln", F.posexplode(parts).alias("part", "line"))


def repair(sections: DataFrame) -> DataFrame:
    """sections (doc, idx, header, level) of documents, without chapter lines told twice, and with numbered sections that have no parent raised to level 2.

    `Chapter n. Title` goes where `Chapter n` and `Title` stand among the LOOK_BACK headings kept before it. A section `n.m` of level 3 or more has a parent
    where `n` was a section of level 2, or where the heading just before is a plain one of level 2 that may own it, which then is
    `n`. A fold in the JVM over a document's outline, which is as long as its headings are many; only what changes is kept in its state.
    """
    p = parsed(F.trim(F.coalesce("header", F.lit(""))))
    row = F.struct("idx", "header", "level", p.alias("p"), words_of(p["title"]).alias("of_title"))
    docs = sections.groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.struct(
        F.array().cast("array<string>").alias("last"), F.lit(False).alias("owner"), F.array().cast("array<int>").alias("known"),
        F.array().cast("array<bigint>").alias("gone"), F.array().cast("array<bigint>").alias("raised"),
    )

    def step(s: Column, x: Column) -> Column:
        first = F.get(x["p"]["numbers"], F.lit(0))
        told = F.concat(F.lit("chapter "), first.cast("string"))
        twice = (x["p"]["form"] == "chapter") & (x["of_title"] != "") & F.array_contains(s["last"], told) & F.array_contains(s["last"], x["of_title"])
        orphan = (x["p"]["form"] == "path") & (x["level"] >= 3) & ~F.array_contains(s["known"], first)
        raised = orphan & ~s["owner"]
        second = raised | (x["level"] == 2)
        names = F.when(orphan & s["owner"] | second & (x["p"]["form"] == "number"), F.array(first)).otherwise(F.array().cast("array<int>"))
        childless = x["p"]["words"].isin(*CHILDLESS)
        for start in CHILDLESS_START:
            childless = childless | x["p"]["words"].startswith(start)
        at = F.array(x["idx"].cast("bigint"))
        after = F.struct(
            F.slice(F.concat(F.array(x["p"]["words"]), s["last"]), 1, LOOK_BACK).alias("last"), (second & (x["p"]["form"] == "plain") & ~childless).alias("owner"), F.array_union(s["known"], names).alias("known"),
            s["gone"].alias("gone"), F.when(raised, F.concat(s["raised"], at)).otherwise(s["raised"]).alias("raised"),
        )
        dropped = F.struct(s["last"].alias("last"), s["owner"].alias("owner"), s["known"].alias("known"), F.concat(s["gone"], at).alias("gone"), s["raised"].alias("raised"))
        return F.when(F.coalesce(twice, F.lit(False)), dropped).otherwise(after)

    told = docs.select("doc", "rows", F.aggregate("rows", empty, step).alias("s")).select("doc", "s", F.explode("rows").alias("x"))
    level = F.when(F.array_contains("s.raised", F.col("x.idx").cast("bigint")), F.lit(2)).otherwise(F.col("x.level")).cast(sections.schema["level"].dataType)
    return told.filter(~F.array_contains("s.gone", F.col("x.idx").cast("bigint"))).select("doc", "x.idx", "x.header", level.alias("level"))


def repair_with_parents(sections: DataFrame) -> DataFrame:
    """The same with the parent of each section found anew."""
    fixed = repair(sections)
    return fixed.join(parents(fixed).select("doc", "idx", "parent_idx"), ["doc", "idx"])
