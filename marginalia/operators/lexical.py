"""Full-text match and rank: `english` (stemmed, without stop words) and `simple` terms, web-style queries, cover density.

index() makes one row a term and field of a row, without a shuffle; write_index() sorts them by term, so that a set of queries reads
little but its own terms. match() ranks in the JVM: one shuffle by query and row, whatever the number of queries.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: English stop words.
STOP = frozenset("a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split())
HEADING_WEIGHT, BODY_WEIGHT = 1.0, 0.4


def _measure(stem: str) -> int:
    return len(re.findall("vc", re.sub("(v+)|(c+)", lambda m: "v" if m[1] else "c", "".join("v" if c in "aeiou" or c == "y" and k and stem[k - 1] not in "aeiou" else "c" for k, c in enumerate(stem)))))


def _vowel(stem: str) -> bool:
    return any(c in "aeiou" or c == "y" and k for k, c in enumerate(stem))


def _short(stem: str) -> bool:
    return bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", stem))


#: The suffix rules of Porter (1980), steps 2 to 4.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replace(word: str, rules: dict[str, str]) -> str:
    for end in sorted(rules, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + rules[end] if _measure(stem) > 0 else word
    return word


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (end := next((e for e in ("ed", "ing") if word.endswith(e)), None)) and _vowel(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"([^aeioulsz])\1$", word):
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP_2), STEP_3)
    for end in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def terms(text: str | None, config: str = "english") -> list[str]:
    """Terms by position; a stop word is an empty string and keeps its position."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return words if config == "simple" else ["" if w in STOP else stem(w) for w in words]


def parse_query(query: str, config: str = "english") -> list[list[tuple[tuple[str, ...], bool]]]:
    """Alternatives (`or`) of conjunctions of (phrase, wanted); quotes make phrases, a minus excludes."""
    out: list[list[tuple[tuple[str, ...], bool]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            out.append([])
            continue
        found = (tuple(t for t in terms(phrase or word, config) if t), not minus)
        if found[0] and found not in out[-1]:
            out[-1].append(found)
    return [x for x in out if any(wanted for _, wanted in x)]


def _places(phrase: tuple[str, ...], at: list[str]) -> list[int]:
    return [k for k in range(len(at) - len(phrase) + 1) if tuple(at[k : k + len(phrase)]) == phrase]


def rank(query: list[list[tuple[tuple[str, ...], bool]]], heading: list[str], body: list[str]) -> float | None:
    """Cover density of one text, or None where the query does not match; match() gives the same for all rows of an index.

    Each shortest stretch that holds the start of all phrases of an alternative adds its weight over one more than the places in it that hold none.
    """
    best = None
    for parts in query:
        wanted = [p for p, w in parts if w]
        if any(_places(p, heading) or _places(p, body) for p, w in parts if not w) or not all(_places(p, heading) or _places(p, body) for p in wanted):
            continue
        score = 0.0
        for at, weight in ((heading, HEADING_WEIGHT), (body, BODY_WEIGHT)):
            where, last, done = [_places(p, at) for p in wanted], [-1] * len(wanted), -1
            for k in sorted({k for places in where for k in places}):
                last = [k if k in places else before for places, before in zip(where, last)]
                if min(last) > done:
                    done = min(last)
                    score += weight / (1 + max(k - done + 1 - len(wanted), 0))
        for p in wanted if score == 0 else ():  # spread over heading and body
            score += HEADING_WEIGHT * 0.1 if _places(p, heading) else BODY_WEIGHT * 0.1
        best = max(best or 0.0, score)
    return best


#: So many query terms at most are sent to every task and to the scan as a list; larger sets are joined by shuffle.
TERMS = 1000


#: Words of a batch that are grouped at a time, about: a text of more is taken alone.
PORTION = 200_000


def _portions(batch: pa.RecordBatch, field: str) -> Iterator[pa.RecordBatch]:
    """A batch in stretches of rows with PORTION words or less, or one row."""
    sizes = batch.column(field).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < sizes.size:
        before = ends[a] - sizes[a]
        z = max(a + 1, int(np.searchsorted(ends, before + PORTION, side="right")))
        yield batch.slice(a, z - a)
        a = z


def _postings(ids: pa.Array, words: pa.ListArray, field: str, english: bool) -> pa.RecordBatch:
    """id, field, term, at of a batch: words by number, then one stable sort by row and term."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    coded = words.flatten().dictionary_encode()
    codes, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(codes.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if english:  # a stop word goes and keeps its position
        numbers: dict[str, int] = {}
        again = np.array([-1 if w in STOP else numbers.setdefault(stem(w), len(numbers)) for w in known], np.int64)
        codes, known = again[codes] if codes.size else codes, list(numbers)
        row, at, codes = (x[codes >= 0] for x in (row, at, codes))
    key = row * max(1, len(known)) + codes
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    picked = order[first]
    places = pa.ListArray.from_arrays(pa.array(np.append(first, order.size), pa.int32()), pa.array(at[order], pa.int32()))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row[picked])), pa.array([field] * picked.size, pa.string()), pa.array(known, pa.string()).take(pa.array(codes[picked])), places], ["id", "field", "term", "at"])


def index(rows: DataFrame, id_col: str, heading_col: str, body_col: str, config: str = "english") -> DataFrame:
    """id, field (h or b), term, at: a row for each distinct term of a heading or body, with its positions in order.

    Ids are distinct; rows without an id take no part, null texts are empty. Words are cut in the JVM; an Arrow function groups
    positions by term where the texts are, so nothing is shuffled.
    """
    words = [F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias(field) for field, c in (("h", heading_col), ("b", body_col))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field in ("h", "b"):
                for part in _portions(batch, field):
                    yield _postings(part.column("id"), part.column(field), field, config != "simple")

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *words).mapInArrow(run, f"id {kind}, field string, term string, at array<int>")


def write_index(postings: DataFrame, path: str) -> None:
    """Sorted by term over all files, then by id: a term's rows are few row groups, and a very frequent term is in many files."""
    postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("errorifexists").parquet(path)


def query_terms(queries: DataFrame, config: str = "english") -> DataFrame:
    """A row for each term of queries (qid, query): its alternative, phrase (part), place in the phrase, and whether it is wanted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for qid, query in zip(pdf["qid"], pdf["query"]):
                for alternative, parts in enumerate(parse_query(query or "", config)):
                    ordered = sorted(parts, key=lambda p: not p[1])  # wanted ones first: their numbers are places in an array
                    n_wanted = sum(wanted for _, wanted in parts)
                    out += [(qid, alternative, part, wanted, len(phrase), n_wanted, k, term) for part, (phrase, wanted) in enumerate(ordered) for k, term in enumerate(phrase)]
            yield pd.DataFrame(out, columns=["qid", "alternative", "part", "wanted", "n_terms", "n_wanted", "offset", "term"])

    kind = queries.schema["qid"].dataType.simpleString()
    return queries.select("qid", "query").mapInPandas(run, f"qid {kind}, alternative int, part int, wanted boolean, n_terms int, n_wanted int, offset int, term string")


def _density(hits: Column, n: Column, weight: float) -> Column:
    """The sum over shortest stretches that hold all n parts of weight / (1 + places in between that hold none of them), from sorted (at, part): one pass. Parts next to one
    another give the whole weight, however many they are; a part told twice within a stretch counts as a place in between."""
    none, start = F.lit(-1), F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("now"), F.lit(-1).alias("done"), F.lit(0.0).alias("score"))

    def step(s: Column, x: Column) -> Column:
        least = F.array_min(s["last"])
        whole = (x["at"] != s["now"]) & (least > s["done"])  # all hits of the position before are in
        return F.struct(
            F.transform(s["last"], lambda v, j: F.when(j == x["part"], x["at"]).otherwise(v)).alias("last"), x["at"].alias("now"),
            F.when(whole, least).otherwise(s["done"]).alias("done"), (s["score"] + F.when(whole, F.lit(weight) / (1 + F.greatest(s["now"] - least + 1 - n, F.lit(0)))).otherwise(F.lit(0.0))).alias("score"),
        )

    end = F.array(F.struct(F.lit(2**31 - 1).alias("at"), none.alias("part")))
    return F.aggregate(F.concat(hits, end), start, step, lambda s: s["score"])


def match(postings: DataFrame, queries: DataFrame, config: str = "english") -> DataFrame:
    """qid, id, lexical_score (9 places) of the rows that match, by an index and queries (qid, query); qids are distinct.

    The scan gets the terms of a small set of queries as a filter. A row's postings for a query meet in one place, as many as
    the query has terms, twice; a frequent term is spread by id.
    """
    wanted_terms = query_terms(queries, config)
    some = [r[0] for r in wanted_terms.select("term").distinct().limit(TERMS + 1).collect()]
    if len(some) <= TERMS and wanted_terms.limit(TERMS + 1).count() <= TERMS:
        joined = postings.filter(F.col("term").isin(some)).join(F.broadcast(wanted_terms), "term")
    else:
        joined = postings.join(wanted_terms.hint("merge"), "term")
    by = ["qid", "id", "alternative", "n_wanted"]
    moved = lambda x: F.transform(x["at"], lambda p: p - x["offset"])
    # one shuffle serves the three groupings: each has the query and the row among its keys
    parts = joined.repartition("qid", "id").groupBy(*by, "part", "wanted", "n_terms", "field").agg(F.collect_list(F.struct("offset", "at")).alias("words"))
    starts = F.aggregate(F.slice("words", F.lit(2), F.size("words")), moved(F.col("words")[0]), lambda a, x: F.array_intersect(a, moved(x)))
    places = parts.filter(F.size("words") == F.col("n_terms")).withColumn("at", starts).filter(F.size("at") > 0)
    held = lambda field: F.array_sort(F.flatten(F.collect_list(F.when(F.col("wanted") & (F.col("field") == field), F.transform("at", lambda p: F.struct(p.alias("at"), F.col("part").alias("part")))))))
    told = places.groupBy(*by).agg(
        F.bool_or(~F.col("wanted")).alias("barred"), F.size(F.collect_set("part")).alias("n"), F.size(F.collect_set(F.when(F.col("field") == "h", F.col("part")))).alias("n_heading"),
        held("h").alias("h"), held("b").alias("b"),
    ).filter(~F.col("barred") & (F.col("n") == F.col("n_wanted")))
    score = _density(F.col("h"), F.col("n"), HEADING_WEIGHT) + _density(F.col("b"), F.col("n"), BODY_WEIGHT)
    spread = 0.1 * (HEADING_WEIGHT * F.col("n_heading") + BODY_WEIGHT * (F.col("n") - F.col("n_heading")))  # over heading and body
    scored = told.withColumn("score", score).select("qid", "id", F.when(F.col("score") > 0, F.col("score")).otherwise(spread).alias("score"))
    return scored.groupBy("qid", "id").agg(F.round(F.max("score"), 9).alias("lexical_score"))


def one_query(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([(0, query)], "qid int, query string")


def search(rows: DataFrame, query: str, id_col: str, heading_col: str, body_col: str, config: str = "english") -> DataFrame:
    """id, lexical_score of the rows that match one query, without a stored index: only rows that hold a term in some form are indexed."""
    parsed = parse_query(query, config)
    if not parsed:
        return rows.select(F.col(id_col).alias("id"), F.lit(0.0).alias("lexical_score")).limit(0)
    # stems are prefixes of their words but for a last letter, so this filter lets every match through
    heads = {t[: max(2, len(t) - 1)] for alternative in parsed for p, wanted in alternative if wanted for t in p}
    both = F.lower(F.concat_ws(" ", heading_col, body_col))
    near = functools.reduce(lambda a, b: a | b, [both.contains(h) for h in sorted(heads)])
    return match(index(rows.filter(near), id_col, heading_col, body_col, config), one_query(rows.sparkSession, query), config).select("id", "lexical_score")
