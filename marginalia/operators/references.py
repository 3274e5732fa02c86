"""References: entries, citation links, canonical works, symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T

#: How a numbered entry begins, an entry by author and year, and a number that opens an entry within a line.
NUMBERED = r"^(?:<sup>(\d+)</sup>|\[(\d+)\]|\$\^\{?(\d+)\}?\$|(\d+)\.?)\s*"
AUTHOR_YEAR, GLUED = r"^([A-Z][a-zA-Z\-.].*?)\s*\((\d{4}[a-z]?)\)[.\s]", r"(?<=[\s.;])(\d+\.\s+)(?=[A-Z])"
SYMBOL_LENGTH, SCOPES = 10, 3
#: Symbols that say nothing, in lower case; what a reference section's heading holds.
TRIVIAL, REFERENCE_NAMES = ("pi", "e", "i", "=", "+", "-", "0", "1"), ("REFERENCE", "BIBLIOGRAPHY", "NOTES", "ACKNOWLEDGMENTS")


def surname(author: Column) -> Column:
    """An author's surname: what stands before the first comma, else the last word that is not of `et al.`."""
    words = F.filter(F.split(author, r"\s+"), lambda w: w != "")
    named = F.filter(words, lambda w: ~F.lower(w).isin("et", "al."))
    last = F.coalesce(F.try_element_at(named, F.lit(-1)), author)
    return F.regexp_replace(F.when(F.contains(author, F.lit(",")), F.substring_index(author, ",", 1)).otherwise(last), r"[^a-zA-Z\-]", "")


def entries(refs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """doc, seq, ref_index, raw_text: glued entries are broken, and lines that start none continue the one before.

    A numbered entry's text comes without its number; an entry by author and year is known as `Surname 1999a`. Lines before the first entry are of none.
    """
    broken = F.split(F.regexp_replace(F.col(text_col), GLUED, "\n$1"), "\n")
    rows = refs.select(F.col(doc_col).alias("doc"), F.posexplode(broken).alias("ln", "line")).filter(~T.blank("line")).withColumn("line", T.jtrim("line"))
    rows = rows.withColumn("mark", F.regexp_extract("line", NUMBERED, 0))  # one search a line: its number and its rest follow from what was found
    number = F.nullif(F.regexp_extract("mark", r"\d+", 0), F.lit(""))
    author = F.when(F.col("line").rlike(AUTHOR_YEAR), F.concat_ws(" ", T.let(F.regexp_extract("line", AUTHOR_YEAR, 1), surname), F.regexp_extract("line", AUTHOR_YEAR, 2)))
    rows = rows.withColumn("number", number).withColumn("ref_index", F.coalesce("number", author))
    rows = rows.withColumn("line", F.when(F.col("number").isNotNull(), F.substr("line", F.length("mark") + 1)).otherwise(F.col("line"))).drop("mark")
    rows = rows.withColumn("seq", F.sum(F.col("ref_index").isNotNull().cast("int")).over(W.partitionBy("doc").orderBy("ln"))).filter("seq > 0")
    told = rows.groupBy("doc", "seq").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("rows"), F.max("ref_index").alias("ref_index"))
    text = T.jtrim(F.array_join(F.transform("rows", lambda r: r["line"]), " "))
    return told.select("doc", F.col("seq").cast("int").alias("seq"), "ref_index", text.alias("raw_text"))


def citation_links(sections: DataFrame, doc_col: str, id_col: str, text_col: str) -> DataFrame:
    """doc, section_id, ref_index: each once."""
    return sections.select(F.col(doc_col).alias("doc"), F.col(id_col).alias("section_id"), F.explode(T.citations(text_col)).alias("ref_index")).distinct()


def canonicalise(references: DataFrame, canonical: DataFrame, on: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(references with global_ref_id, canonical rows to insert): an equi-join, and an anti-join for what is new."""
    known = references.join(canonical.select(on, F.col("id").alias("global_ref_id")), on, "left")
    new = references.join(canonical.select(on), on, "left_anti").select(on).distinct().select(F.xxhash64(on).alias("id"), on)
    return known.withColumn("global_ref_id", F.coalesce("global_ref_id", F.xxhash64(on))), new


def cited_works(links: DataFrame, references: DataFrame, canonical: DataFrame) -> DataFrame:
    """doc, section_id, ref_index, title: the canonical title, else the reference's own; each reference once a section."""
    refs = references.join(canonical.select(F.col("id").alias("global_ref_id"), F.col("title").alias("known_title")), "global_ref_id", "left")
    return links.join(refs, ["doc", "ref_index"]).select("doc", "section_id", "ref_index", F.coalesce("known_title", "title").alias("title")).distinct()


def by_index(references: DataFrame, index: str) -> DataFrame:
    """References with that index, bare or in brackets."""
    return references.filter(F.col("ref_index").isin(index, f"[{index}]"))


def popularity(references: DataFrame, key: str) -> DataFrame:
    return references.groupBy(key).agg(F.count(F.lit(1)).alias("citation_count"))


def reference_section(sections: DataFrame, doc_col: str, header_col: str, text_col: str, idx_col: str) -> DataFrame:
    """Each document's reference section: the longest of those named so (the first, on ties), else the last section."""
    named = F.coalesce(F.upper(header_col).rlike("|".join(REFERENCE_NAMES)), F.lit(False))
    order = W.partitionBy(doc_col).orderBy(named.desc(), F.when(named, F.length(F.coalesce(text_col, F.lit("")))).desc_nulls_last(), F.when(named, F.col(idx_col)).asc_nulls_last(), F.col(idx_col).desc())
    return sections.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def symbol_candidates(sections: DataFrame, doc_col: str, header_col: str, text_col: str, idx_col: str) -> DataFrame:
    """Sections to scan for symbols: 50 characters or more, and named so or in the first 70 % of the outline."""
    n = F.count(F.lit(1)).over(W.partitionBy(doc_col))
    named = F.upper(header_col).rlike("METHOD|MODEL|PRELIMINAR|NOTATION") | F.col(header_col).contains("FORMULATION")
    return sections.withColumn("__n", n).filter((F.length(text_col) >= 50) & (named | (F.col(idx_col) < F.col("__n") * 0.7))).drop("__n")


def merge_symbols(rows: DataFrame) -> DataFrame:
    """doc, symbol, description, scopes, is_global from (doc, seq, symbol, description, root): one row a trimmed symbol.

    A description takes the place of the one held when it is valid and that is not, or is over 5 characters longer: a fold
    over each symbol's rows in order, in the JVM.
    """
    fit = rows.select("*", T.jtrim("symbol").alias("s")).filter((F.length("s") <= SYMBOL_LENGTH) & (F.col("s") != "") & ~F.lower("s").isin(*TRIVIAL))
    grouped = fit.groupBy("doc", F.col("s").alias("symbol")).agg(F.array_sort(F.collect_list(F.struct("seq", "description"))).alias("rows"), F.array_sort(F.collect_set("root")).alias("scopes"))

    def step(held, row):
        new = row["description"]
        better = ~T.no_description(new) & (T.no_description(held) | (F.length(new) > F.length(held) + 5))
        return F.when(better, new).otherwise(held)

    merged = F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), F.element_at("rows", 1)["description"], step)
    return grouped.select("doc", "symbol", merged.alias("description"), "scopes", (F.size("scopes") > SCOPES).alias("is_global"))
