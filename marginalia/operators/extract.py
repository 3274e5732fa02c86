"""Symbols and bibliographic metadata by rules, as table functions: what runs where no model is injected.

Both are Python UDTFs that name their own columns (`analyze`), so they join laterally in SQL and in the DataFrame API:
    SELECT s.id, x.* FROM sections s, LATERAL extract_symbols(s.title, s.content) x
Each call sees one row's text; whole texts are read, in time linear in them.

Defined results: null and empty texts give no symbols, and metadata without year, surnames and title; a symbol that a text defines again comes again, as symbols are merged
elsewhere (references.merge_symbols).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: A symbol: mathematics between dollars, or one letter, with a mark under it or not.
SYMBOL = r"(?:\$(?P<latex{0}>[^$\n]{{1,60}})\$|(?P<bare{0}>[A-Za-zΑ-Ωα-ω](?:_\{{?[A-Za-z0-9]+\}}?)?))"
#: What a description runs up to: the end of a clause, or what another definition begins with.
TOLD = r"(?P<told{0}>(?:the|a|an|its|their|some|any)\s[^.,;:\n]{{2,160}}?)(?=[.,;:\n]|\s+and\s+(?:where|let)\b|$)"
#: Sentences that define a symbol, symbol first or last. An article is a word on the line of what it goes with; after `and`, a letter that is a word by itself is no symbol without a mark.
DEFINITIONS = (
    rf"\b[Ll]et\s+{SYMBOL.format(1)}\s+(?:denote|be|represent|stand\s+for)\s+{TOLD.format(1)}",
    rf"\b(?:[Ww]here|[Hh]ere|and(?!\s+[aAI]\s))\s+{SYMBOL.format(2)}\s+(?:is|are|denotes?|represents?|stands\s+for)\s+{TOLD.format(2)}",
    rf"\b[Dd]enote\s+by\s+{SYMBOL.format(3)}\s+{TOLD.format(3)}",
    rf"(?P<told4>\b(?:[Tt]he|[Aa]n?)[^\S\n][^.,;:\n]{{2,160}}?)\s+(?:is|are)\s+denoted\s+(?:by|as)\s+{SYMBOL.format(4)}(?![A-Za-z])",
)
DEFINITION = re.compile("|".join(DEFINITIONS))
YEAR = re.compile(r"\b((?:19|20)\d{2})[a-z]?\b")
QUOTED = re.compile(r"[“\"]([^”\"]{8,300})[”\"]")
INITIALS, SURNAME = r"(?:[A-Z]\.[\s-]*)+", r"[A-Z][A-Za-zÀ-ÿ'’\-]+"
#: `Surname, A. B.` or `A. B. Surname`.
AUTHOR = re.compile(rf"(?P<first>{SURNAME}),\s*{INITIALS}|{INITIALS}\s*(?P<last>{SURNAME})")


def definitions(text: str | None) -> Iterator[tuple[str, str, str]]:
    """(symbol, latex, description) of each sentence that defines a symbol, in order."""
    for m in DEFINITION.finditer(text or ""):
        found = m.groupdict()
        latex = next((found[f"latex{k}"] for k in range(1, 5) if found[f"latex{k}"]), None)
        bare = next((found[f"bare{k}"] for k in range(1, 5) if found[f"bare{k}"]), None)
        told = next(found[f"told{k}"] for k in range(1, 5) if found[f"told{k}"])
        yield (latex or bare).strip(), (latex or bare).strip(), " ".join(told.split())


def metadata(raw: str | None) -> tuple[int | None, list[str], str | None]:
    """(year, surnames, title) of a reference's text: authors stand before the title, the title in quotes or as the sentence after the authors or the year."""
    text = " ".join((raw or "").split())
    years = list(YEAR.finditer(text))
    bracketed = [m for m in years if text[m.start() - 1 : m.start()] == "("]
    year = (bracketed or years)[-1] if years else None
    quoted = QUOTED.search(text)
    authors: list[str] = []
    at = 0
    for m in AUTHOR.finditer(text, 0, quoted.start() if quoted else len(text)):
        # authors are a list: commas, `and`, `&` and nothing else between them
        if authors and re.fullmatch(r"(?:[\s,;&]|and|et al\.?)*", text[at : m.start()]) is None:
            break
        authors.append(m["first"] or m["last"])
        at = m.end()
    if quoted:
        title = quoted[1].rstrip(".,")
    else:
        start = year.end() if year and year in bracketed and year.start() - at < 12 else at
        rest = re.sub(r"^[\s.,;:)\]]+", "", text[start:])
        title = re.split(r"(?<=[^\s.]{2})[.?!](?=\s|$)", rest, maxsplit=1)[0].strip(" ,") or None
    return int(year[1]) if year else None, authors, title


def _texts(*arguments: AnalyzeArgument) -> None:
    for a in arguments:
        if a.dataType.typeName() not in ("string", "void"):
            raise ValueError(f"a text is wanted, not {a.dataType.simpleString()}")


class ExtractSymbols:
    """(title, text) -> rows of symbol, latex, description."""

    @staticmethod
    def analyze(title: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        _texts(title, text)
        return AnalyzeResult(StructType().add("symbol", StringType()).add("latex", StringType()).add("description", StringType()))

    def eval(self, title: str | None, text: str | None):
        yield from definitions(title)
        yield from definitions(text)


class ExtractReference:
    """raw text -> one row of year, surnames, title."""

    @staticmethod
    def analyze(raw: AnalyzeArgument) -> AnalyzeResult:
        _texts(raw)
        return AnalyzeResult(StructType().add("year", IntegerType()).add("surnames", ArrayType(StringType())).add("title", StringType()))

    def eval(self, raw: str | None):
        yield metadata(raw)


def register(spark: SparkSession) -> None:
    """extract_symbols(title, text) and extract_reference(raw) for SQL."""
    spark.udtf.register("extract_symbols", F.udtf(ExtractSymbols))
    spark.udtf.register("extract_reference", F.udtf(ExtractReference))


def symbols(sections: DataFrame, id_col: str, title: str, text: str) -> DataFrame:
    """id, symbol, latex, description."""
    rows = sections.select(F.col(id_col).alias("id"), F.col(title).alias("title"), F.col(text).alias("text"))
    return rows.lateralJoin(F.udtf(ExtractSymbols)(F.col("title").outer(), F.col("text").outer())).select("id", "symbol", "latex", "description")


def reference_metadata(references: DataFrame, id_col: str, raw: str) -> DataFrame:
    """id, year, surnames, title."""
    rows = references.select(F.col(id_col).alias("id"), F.col(raw).alias("raw"))
    return rows.lateralJoin(F.udtf(ExtractReference)(F.col("raw").outer())).select("id", "year", "surnames", "title")
