"""Column functions over text. Regular expressions are Java's."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTE_LENGTH, QUOTE_LEAD, QUOTE_TERM = 700, 233, 4


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def jtrim(x: Column | str) -> Column:
    """Strips every character up to U+0020 at both ends."""
    return F.btrim(_c(x), F.lit("".join(map(chr, range(33)))))


def collapse(x: Column | str) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    # a single space is no match, as it would only be replaced by itself
    return jtrim(F.regexp_replace(_c(x), r"\s(?:\s+|(?<! ))", " "))


def blank(x: Column | str) -> Column:
    return _c(x).isNull() | (jtrim(x) == "")


def abbreviate(x: Column | str, n: int) -> Column:
    return F.when(F.length(_c(x)) > n, F.concat(F.substring(_c(x), 1, n), F.lit("..."))).otherwise(_c(x))


def query_terms(q: Column | str, least: int = 1) -> Column:
    """Distinct lower-case runs of letters and digits of `least` characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(q)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quote(text: Column | str, query: Column | str, n: int = QUOTE_LENGTH, lead: int = QUOTE_LEAD) -> Column:
    """A window of n characters around the first query term of four characters or more."""

    def window(flat: Column, match: Column) -> Column:
        size = F.length(flat)
        start = F.greatest(F.lit(0), match - lead)
        end = F.least(size, start + n)
        start = F.when(end - start < n, F.greatest(F.lit(0), end - n)).otherwise(start)
        return F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), F.substr(flat, start + 1, end - start), F.when(end < size, F.lit("...")).otherwise(F.lit("")))

    def first(flat: Column) -> Column:
        found = let(F.lower(flat), lambda low: F.filter(F.transform(query_terms(query, QUOTE_TERM), lambda t: F.instr(low, t)), lambda p: p > 0))
        return F.coalesce(F.array_min(found) - 1, F.lit(0))

    return let(collapse(text), lambda flat: F.when(F.length(flat) <= n, flat).otherwise(let(first(flat), lambda match: window(flat, match))))


def token_estimate(x: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(_c(x)) + 3) / 4)).cast("int")


def name_uuid(key: Column) -> Column:
    """The version-3 UUID of a name without a name space."""
    m = F.md5(key.cast("binary"))
    variant = F.lpad(F.lower(F.hex(F.conv(F.substring(m, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128))), 2, "0")
    return F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.concat(F.lit("3"), F.substring(m, 14, 3)), F.concat(variant, F.substring(m, 19, 2)), F.substring(m, 21, 12))


def chunk_id(section_id: Column, index: Column, content: Column) -> Column:
    return name_uuid(F.concat_ws("|", section_id.cast("string"), index.cast("string"), F.sha2(content.cast("binary"), 256)))


def fingerprint(surnames: Column, year: Column) -> Column:
    """MD5 of sorted bare surnames and the year; a missing list is `unknown`, a missing year 0000."""
    bare = F.array_sort(F.transform(surnames, lambda s: F.regexp_replace(F.lower(jtrim(s)), "[^a-z0-9]", "")))
    names = F.when(surnames.isNull() | (F.size(surnames) == 0), F.lit("unknown")).otherwise(F.array_join(bare, "|"))
    return F.md5(F.concat(names, F.lit("|"), F.coalesce(year.cast("string"), F.lit("0000")), F.lit("|")).cast("binary"))


# citations ------------------------------------------------------------------------------------------------------

#: The four forms of a numeric citation, an author's name, an author with years in parentheses, and the longest range of numbers.
NUMERIC = r"\[[\d\s,\-–]+\]|<sup>[\d\s,\-–]+</sup>|\$\^\{[\d\s,\-–]+\}\$|\^\{[\d\s,\-–]+\}"
NAME, YEAR, SPAN_LIMIT = r"[A-Z][a-zA-Z\-À-ÿ]+", r"\d{4}[a-z]?", 1000
AUTHOR_YEARS = rf"{NAME}(?:\s+et\s+al\.|\s+and\s+{NAME})?\s*\({YEAR}(?:[,;]\s*{YEAR})*\)"


def expand_numbers(listing: Column) -> Column:
    """`1, 3-5` becomes 1, 3, 4, 5, as text; a reversed range, one of more than SPAN_LIMIT numbers and a part of other form give none."""

    def numbers(part: Column) -> Column:
        ends = F.transform(F.split(F.regexp_replace(part, "[-–—]+$", ""), "[-–—]"), lambda x: F.trim(x).try_cast("int"))
        first, last = F.element_at(ends, 1), F.element_at(ends, -1)
        fit = (F.size(ends) == 2) & (last >= first) & (last - first <= SPAN_LIMIT)
        ranged = F.when(fit, F.transform(F.sequence(first, last), lambda n: n.cast("string")))
        return F.coalesce(F.when(part.rlike(r"^\d+$"), F.array(part)).when(part.rlike("[-–—]"), ranged), F.array().cast("array<string>"))

    return F.flatten(F.transform(F.split(listing, "[,，]"), lambda part: numbers(jtrim(part))))


def matches(text: Column, pattern: str, *hints: str) -> Column:
    """All matches of a pattern, which needs one of hints: texts without any are told by a search of plain strings."""
    hinted = reduce(lambda a, b: a | b, [text.contains(h) for h in hints])
    return F.when(hinted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))


def numeric_citations(text: Column | str) -> Column:
    """Sorted distinct reference numbers, as text, cited in any numeric form: one scan finds all forms."""
    bare = lambda m: F.regexp_replace(m, r"</?sup>|[\[\]{}$^]", "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(matches(_c(text), NUMERIC, "[", "<sup>", "^{"), lambda m: expand_numbers(bare(m))))))


def author_year_citations(text: Column | str) -> Column:
    """Sorted distinct `Surname 1999a`, the first author with each year in the parentheses."""

    def keys(m: Column) -> Column:
        return let(F.regexp_extract(m, NAME, 0), lambda name: F.transform(F.regexp_extract_all(m, F.lit(YEAR), F.lit(0)), lambda year: F.concat_ws(" ", name, year)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(matches(_c(text), AUTHOR_YEARS, "("), keys))))


def citations(text: Column | str) -> Column:
    return F.array_union(numeric_citations(text), author_year_citations(text))


# headings -------------------------------------------------------------------------------------------------------

#: Forms of a line, each with what it has to hold after its number or name.
MARKED, DECIMAL, NUMBERED = r"^#{1,6}\s+(?=\S)", r"^\d+(?:\.\d+)+\.?\s+.", r"^\d+\.\s+."
SECTION_SIGN, ROMAN, LETTER, CHAPTER = r"^§\s*\d+\.\s+.", r"^[IVXLCDM]+\.\s+.", r"^[A-Z]\.\s+.", r"(?i)^chapter\s+\d+\b"
THEOREM_LIKE = r"(?i)^(?:theorem|lemma|proposition|definition|corollary|remark|example|proof|fig\.?|figure|table)\b"
REFERENCE_ITEM = r"^(?:\[\d+\]|\$\^\{?\d+\}?\$|\d+\.|[A-Z][a-zA-ZÀ-ÿ'\-]+,?\s+[A-Z].*)\s+.+$"
INLINE_ABSTRACT, END_SECTION = r"(?i)^(abstract)\s*[:.]\s+(.+)$", r"^(?:acknowledgements|acknowledgments|data availability)"
#: First words of a step of an algorithm; keys of the references; keys of standard sections, and how others of them begin.
IMPERATIVE = ("sample", "set", "obtain", "denote", "choose", "draw", "generate", "repeat", "return", "compute", "solve", "let")
REFERENCES, STANDARD, STANDARD_START = ("references", "bibliography"), ("abstract", "references"), ("acknowledg", "data availability", "orcid", "appendix")
#: Headings of a publisher's own, those of them that open a block of such text, and front matter by its beginning, a part of it, or the whole.
BLOCK_OPENERS = ("paper", "affiliations", "contents", "aip advances", "why publish with us", "you may also like", "articles you may be interested in")
NOISE_HEADINGS = (*BLOCK_OPENERS, "a preprint", "preprint", "cc creative commons", "common deed", "commons deed")
FRONT_START = ("to cite this article", "view the article online", "check for updates", "research article |", "cite as:", "submitted:", "published online:", "received:", "accepted:")
FRONT_PART = ("creative commons", "commons deed", "legal code", "disclaimer", "all rights reserved", "著作权", "저작권", "비영리")
FRONT_WHOLE = r"^(?:chorus|aip publishing|learn more|\d{1,2}\s+[a-z]+\s+\d{4}\s+\d{1,2}:\d{2}:\d{2})$"
IMAGE = r"^!\[[^\]]*\]\([^)]+\)\s*$"
#: What a page's header or footer holds, what it never looks like, and how long it may be.
JOURNAL = (
    r"(?i)\b(?:Chaos|Vol\.|No\.|pp\.|doi|ISSN|ISBN|Phys\.|Math\.|Theor\.|Rev\.|Lett\.|Proc\.|Conf\.|Physics|Institute|University|Society|Journal|Transactions|IEEE|ACM|Springer|Elsevier|Nature|Science)\b"
)
RIGHTS, PAGE_NUMBER = r"(?i)©|\(c\)|copyright|downloaded from|rights reserved", r"(?i)^(?:page\s*)?\d+(?:\s*of\s*\d+)?$"
YEAR_WORD, ET_AL, ARTICLE_ID = r"\b(?:19|20)\d{2}\b", r"(?i)\bet\s+al\b", r"\b\d{5,7}(?:-\d+)?\b"
ENTRY_LIKE, NUMBERED_HEADING = r"^(?:\[\d+\]|\d+\.|\(\d+\))", r"^#{1,6}\s+(?:\d+(?:\.\d+)*|[IVXLCDM]+|[A-Z])\.\s+."
STANDARD_HEADING, LONGEST_NOISE, LONGEST_PAGE = r"(?i)^#{1,6}\s+(?:abstract|references|acknowledge?ments?|data availability|appendix\b.*)$", 120, 20
TITLE_LENGTH, TITLE_WORDS, QUOTES = 8, 3, 3


def clean(x: Column | str) -> Column:
    """Longer runs of white space become one blank; ends are trimmed; quotes around the whole go, up to QUOTES pairs."""

    def bare(text: Column) -> Column:
        inner = text
        for _ in range(QUOTES):
            inner = let(inner, lambda t: F.when(t.rlike(r'(?s)^(?:".*"|“.*”)$'), jtrim(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t))
        return F.when(text.startswith('"') | text.startswith("“"), inner).otherwise(text)

    return let(jtrim(F.regexp_replace(_c(x), r"\s{2,}", " ")), bare)


def heading_text(line: Column | str) -> Column:
    """The line without marks of a heading."""
    return clean(F.when(jtrim(line).startswith("#"), F.regexp_replace(jtrim(line), MARKED, "")).otherwise(jtrim(line)))


def clean_title(text: Column) -> Column:
    """A title without the marks that publishers put after it."""

    def bare(told: Column) -> Column:
        without = F.regexp_replace(F.regexp_replace(F.regexp_replace(told, r"\s+\*$", ""), r"(?i)\s+(?:FREE|EP)$", ""), r"\s*[☐☑✓✔]\s*$", "")
        return F.when(F.right(told, F.lit(6)).rlike(r"(?i)(?:\s\*|\s(?:FREE|EP)|[☐☑✓✔]\s*)$"), jtrim(without)).otherwise(told)

    return let(clean(text), bare)


def heading_key(text: Column | str) -> Column:
    """A heading's text for comparison."""
    return F.lower(clean_title(F.when(_c(text).startswith("#"), F.regexp_replace(_c(text), r"^#+\s*", "")).otherwise(_c(text))))


def is_standard(key: Column) -> Column:
    return reduce(lambda found, start: found | key.startswith(start), STANDARD_START, key.isin(*STANDARD))


def is_front_matter(text: Column) -> Column:

    def front(low: Column) -> Column:
        return reduce(lambda a, b: a | b, [low.startswith(x) for x in FRONT_START] + [low.contains(x) for x in FRONT_PART]) | low.rlike(FRONT_WHOLE)

    return let(F.lower(text), front) | (text.startswith("!") & text.rlike(IMAGE))


def is_noise(text: Column, key: Column) -> Column:
    """Is a line, by its text and key, a publisher's own."""
    return ~blank(text) & (key.isin(*NOISE_HEADINGS) | is_front_matter(text))


def page_noise(line: Column | str) -> Column:
    """Is a line a page's header or footer. Entries of a list and headings of sections never are."""
    x = jtrim(line)
    year, journal, others, number = x.rlike(YEAR_WORD), x.rlike(JOURNAL), x.rlike(ET_AL), x.rlike(ARTICLE_ID)
    page = (F.length(x) < LONGEST_PAGE) & x.rlike(PAGE_NUMBER)
    pairs = (year & (journal | others)) | (journal & (number | others)) | (x.startswith("#") & (journal | number | others))
    return F.coalesce((F.length(x) <= LONGEST_NOISE) & (x != "") & (x.rlike(RIGHTS) | page | pairs) & ~x.rlike(ENTRY_LIKE) & ~x.rlike(NUMBERED_HEADING) & ~x.rlike(STANDARD_HEADING), F.lit(False))


def is_title(text: Column, key: Column, kind: Column) -> Column:
    """May a line of that kind be the paper's title."""
    fits = (F.length(clean_title(text)) >= TITLE_LENGTH) & ~is_standard(key) & (key != "index")
    return ~blank(text) & (kind != "NOISE") & fits & ~text.rlike(rf"{NUMBERED}|{ROMAN}|{LETTER}")


def latin_words(text: Column) -> Column:
    return F.size(F.filter(F.split(clean_title(text), r"\s+"), lambda w: w.rlike("[A-Za-z]{2}")))


def has_latin_words(text: Column, n: int) -> Column:
    """latin_words(text) >= n, told from as much of the text as that takes."""
    return clean_title(text).rlike(rf"^(?:[^A-Za-z]*+(?:[A-Za-z](?![A-Za-z])[^A-Za-z]*+)*+[A-Za-z]{{2}}\S*+){{{n}}}")


def line_kind(line: Column | str, after_references: Column) -> Column:
    """One of twelve kinds; the first that fits."""
    text = heading_text(line)
    return kind_of(_c(line), text, heading_key(text), after_references)


def kind_of(line: Column, text: Column, key: Column, after_references: Column) -> Column:
    """line_kind() from a line's text and key, where they are at hand."""
    marked = jtrim(line).rlike(MARKED)
    first = F.lower(F.regexp_extract(clean(F.regexp_replace(text, r"^\d+\.\s+", "")), r"^(\S+)", 1))
    numbered = F.when(first.isin(*IMPERATIVE) & ~marked, "LIST_ITEM").otherwise("SECTION")
    rules = [
        (blank(text), F.lit("BODY")),
        (after_references & text.rlike(REFERENCE_ITEM), F.lit("REFERENCE_ITEM")),
        (is_noise(text, key), F.lit("NOISE")),
        (text.rlike(THEOREM_LIKE), F.lit("THEOREM_LIKE")),
        ((key == "abstract") | text.rlike(INLINE_ABSTRACT), F.lit("ABSTRACT")),
        (key.isin(*REFERENCES), F.lit("REFERENCES")),
        (key.startswith("appendix"), F.lit("APPENDIX")),
        (text.rlike(CHAPTER) | text.rlike(SECTION_SIGN), F.lit("SECTION")),
        (text.rlike(DECIMAL), F.lit("SUBSECTION")),
        (text.rlike(NUMBERED), numbered),
        (text.rlike(ROMAN), F.lit("SECTION")),
        (text.rlike(LETTER), F.lit("SUBSECTION")),
        (is_standard(key), F.lit("SECTION")),
        (marked, F.lit("UNCERTAIN")),
    ]
    return reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), F.lit("BODY"))


def clean_abstract(x: Column | str) -> Column:
    """Without labels, rights, key words, addresses and runs of blanks."""
    out = F.regexp_replace(_c(x), r"(?i)^\s*(?:abstract|summary)\s*[:.\-—]?\s*", "")
    for pattern in (r"(?is)\s*(?:key\s?words|index terms)\s*[:—-].*$", r"(?i)©[^\n]*|all rights reserved\.?", r"\S+@\S+\.\S+", r"https?://\S+", r"(?i)\bdoi:\s*\S+"):
        out = F.regexp_replace(out, pattern, "")
    return collapse(out)


def json_object(x: Column | str) -> Column:
    """The first object in a model's answer: code fences go, then first brace to last."""
    return F.nullif(F.regexp_extract(F.regexp_replace(_c(x), r"```(?:json)?", ""), r"(?s)\{.*\}", 0), F.lit(""))


def no_description(x: Column | str) -> Column:
    return _c(x).isNull() | F.lower(jtrim(x)).isin("", "null", "none")


def relation_type(x: Column | str) -> Column:
    kind = F.upper(jtrim(x))
    return F.when(kind.isin("SUPPORTS", "CONTRADICTS", "EXTENDS", "USES", "COMPARES", "UNRELATED"), kind).otherwise("UNRELATED")
