"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers.

The base kinds (assign, access, hex) are patterns. Beyond them, long strings without white space are scored by
first-order character models, one trained on labelled random strings, the others on what is ordinary: labelled identifiers, and the words of the documents
themselves, in whatever languages they are. A word of the documents is labelled ordinary by its form: letters alone, between WORD_FROM and SHORTEST_RANDOM - 1 of them,
which no span can be; the pairs of letters of all such words in all texts are counted, a table of 128 by 128. The better ordinary model counts, pair by pair, and an ordinary
string may also repeat a character or go on to the next of the alphabet (RUN). A string whose log-likelihood ratio is at least RATIO in all and PER_CHARACTER on average is a span
of kind `random`. Where a string as a whole is none, its best-scoring part of SHORTEST_RANDOM characters or more is, if that reaches
both, out to the next of / + = _ - on both sides; the rest is scored again. A string in the form of a UUID is none. The samples are a parameter; by default they are
drawn from a fixed seed by labelled_samples().

Defined results: null and empty texts have no spans; whole texts are scanned, at any length in time linear in their spans; repeated rows are scanned each, and null
ids stay null; of a string that overlaps base spans, the parts outside them are scored; of equally good parts the first counts; spans of several kinds may share a start
and stand in the order of KINDS; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_batches
from marginalia.llm.spans import Found, covered, find_spans, overlapping

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
#: The base patterns, and their shortest secrets.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
SHORTEST = {"assign": 6, "access": 20}
SHORTEST_RANDOM = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PIECE = re.compile(r"[A-Za-z0-9]+|[+/_=-]+")
RATIO, PER_CHARACTER, SEED, SAMPLES = 12.0, 0.6, 20240501, 4000
#: How often an ordinary string repeats a character or goes on to the next, as rules, padding and alphabets do.
RUN = 0.1
#: Words of the documents that are ordinary by their form, and a form that is no secret.
WORD_FROM = 4
WORD = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z]{{{WORD_FROM},{SHORTEST_RANDOM - 1}}}(?![A-Za-z0-9+/_=-])")
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
#: How often a word of an identifier is shortened.
SHORTENED = 0.15
#: Common words of identifiers, for the ordinary class.
WORDS = """access account action active add address admin agent alert all alpha angle api app apply area array async attr audio author auto average back base batch begin block body bool border box branch buffer build button byte cache call cancel card case cell change char check child class clean clear click client clone close cloud code color column command comment commit common config connect console content context control convert copy core count create current custom data date debug default delete depth detail device dialog dict diff digest disk display document domain double down draft drop duration edit element email empty enable encode end engine entity entry enum error event exception execute exit export extra factory fail field file filter final find first fixed flag float flush folder font footer form format frame from function get global graph group handle hash header height help hidden history host hour http icon image import index info init inner input insert instance int item iterator job join json key kind label language last layer layout left length level library limit line link list listener load local lock log login long loop main manager map mark mask match max media member memory menu merge message method min mode model module month mouse name native network new next node none notify null number object offset open option order origin outer output owner package page panel parent parse part pass path pattern payload pending person phone pixel place plain player plugin point policy pool port position post prefix previous price print private process product profile progress project property protocol proxy public query queue quick random range rank rate read ready record redirect reference region register relation release reload remote remove render repeat replace report request require reset resize resolve resource response rest result return right role root rotate route row rule run sample save scale scan schedule scope score screen script scroll search second section select send sequence server service session set shape share shift show signal simple single size skip slot small sort sound source space split stack stage start state static status step stop storage store stream string style submit success suffix sum switch symbol sync system table tag target task template test text theme thread time title toggle token tool top total trace track transaction transform tree trigger type unit unknown update upload upper url user util valid value variable vector verify version video view visible wait warning watch web weight width window with word work wrap write year zone""".split()


def shortened(word: str, draw: random.Random) -> str:
    """A word as identifiers shorten it: its first letters, or its consonants."""
    return word[: draw.randrange(3, 5)] if draw.random() < 0.5 else word[0] + "".join(c for c in word[1:] if c not in "aeiou")


def labelled_samples(n: int = SAMPLES, seed: int = SEED, words: Sequence[str] = WORDS) -> tuple[list[str], list[str]]:
    """(random strings, ordinary identifiers), the same for the same seed."""
    draw = random.Random(seed)
    letters = string.ascii_letters + string.digits
    alphabets = (letters, letters + "+/", letters + "-_", string.ascii_lowercase + string.digits)
    secrets = ["".join(draw.choices(draw.choice(alphabets), k=draw.randrange(20, 48))) for _ in range(n)]
    plain = []
    for _ in range(n):
        some = [shortened(w, draw) if draw.random() < SHORTENED else w for w in draw.choices(words, k=draw.randrange(3, 7))]
        style = draw.randrange(5)
        joined = "_".join(some) if style == 0 else "-".join(some) if style == 1 else "/".join(some) if style == 2 else "".join(w.capitalize() for w in some)
        joined = joined.upper() if style == 4 else joined
        end = draw.random()
        plain.append(joined + (str(draw.randrange(2100)) if end < 0.4 else f"_0x{draw.randrange(16):04x}" if end < 0.45 else ""))
    return secrets, plain


def pairs(samples: Iterable[str]) -> np.ndarray:
    """How often each ASCII character follows each."""
    out = np.zeros((128, 128))
    for s in samples:
        codes = np.frombuffer(s.encode("ascii"), np.uint8)
        np.add.at(out, (codes[:-1], codes[1:]), 1)
    return out


def model(pair: np.ndarray) -> np.ndarray:
    """Probabilities of each ASCII character after each, with a little of each character's own rate and of all."""
    single = pair.sum(axis=0) + 0.1
    single /= single.sum()
    return (pair + 8 * single) / (pair.sum(axis=1, keepdims=True) + 8)


def ratios(secrets: Iterable[str], plain: Iterable[str], words: np.ndarray | None = None) -> np.ndarray:
    """The log-likelihood ratio of each ASCII character after each. words: the documents' own table, see word_pairs."""
    ordinary = model(pairs(plain))
    if words is not None and words.sum():
        ordinary = np.maximum(ordinary, model(words))
    ordinary = (1 - RUN) * ordinary
    at = np.arange(128)
    ordinary[at, at] += RUN
    ordinary[at[:-1], at[1:]] += RUN
    return np.log(model(pairs(secrets))) - np.log(ordinary)


def word_pairs(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each ASCII character follows each in the ordinary words of all texts. A task sends its own table, 128 by 128 at most, and so does the sum to the driver."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(128 * 128, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    codes = np.frombuffer("\n".join(WORD.findall(text)).encode(), np.uint8).astype(np.int64)
                    total += np.bincount(codes[:-1] * 128 + codes[1:], minlength=total.size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["pair", "n"])

    found = docs.select(text_col).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(128 * 128)
    out[[r.pair for r in found]] = [r.n for r in found]
    table = out.reshape(128, 128)
    table[10], table[:, 10] = 0, 0  # the line ends between words
    return table


def best_part(score: np.ndarray, least: int) -> tuple[int, int, float]:
    """(first, end, sum) of the slice of score with the greatest sum, of least entries or more."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    low = np.minimum.accumulate(total[: total.size - least])
    end = int(np.argmax(total[least:] - low))
    first = int(np.argmin(total[: end + 1]))
    return first, end + least, float(total[end + least] - total[first])


def random_part(word: str, score: np.ndarray) -> tuple[int, int] | None:
    """Where the best-scoring part of word is that reaches RATIO and PER_CHARACTER, if one does."""
    if score.sum() >= max(RATIO, PER_CHARACTER * score.size):
        return 0, len(word)
    # above PER_CHARACTER on average: a sum over what exceeds it; parts of one character more always reach RATIO
    for least in (SHORTEST_RANDOM - 1, SHORTEST_RANDOM):
        if score.size >= least:
            first, end, over = best_part(score - PER_CHARACTER, least)
            if over >= 0 and over + PER_CHARACTER * (end - first) >= RATIO - 1e-9:
                pieces = [m.span() for m in PIECE.finditer(word)]
                return max(a for a, b in pieces if a <= first < b), min(b for a, b in pieces if a <= end < b)
    return None


def random_spans(text: str, a: int, b: int, table: np.ndarray) -> Found:
    out, left = [], [(a, b)]
    while left:
        a, b = left.pop()
        if b - a >= SHORTEST_RANDOM:
            codes = np.frombuffer(text[a:b].encode("ascii"), np.uint8)
            if part := random_part(text[a:b], table[codes[:-1], codes[1:]]):
                out.append((a + part[0], "random", a + part[1]))
                left += [(a, a + part[0]), (a + part[1], b)]
    return out


def base_spans(text: str) -> Found:
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= SHORTEST["access"]]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def finder(secrets: list[str], plain: list[str], words: np.ndarray | None = None) -> Callable[[str], Found]:
    table = ratios(secrets, plain, words)

    def find(text: str) -> Found:
        found = base_spans(text)
        taken, more = covered(found), []
        for m in CANDIDATE.finditer(text):
            if UUID.fullmatch(m[0]):
                continue
            at = m.start()
            for a, b in overlapping(taken, at, m.end()):
                more += random_spans(text, at, a, table)
                at = b
            more += random_spans(text, at, m.end(), table)
        return found + more

    return find


def secrets_in(docs: DataFrame, samples: tuple[list[str], list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans for every row of docs."""
    secrets, plain = samples or labelled_samples()
    words = word_pairs(docs, text_col)
    return find_spans(docs, lambda: finder(secrets, plain, words), KINDS, id_col, text_col)
