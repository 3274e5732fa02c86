"""Personal data by weak supervision.

Patterns give the base kinds (email, ip, card, phone). Beyond them, candidate spans of further kinds (phone and card numbers that a
base pattern ran past, national numbers, bank accounts, names after a title) are voted on by labelers: the shape, a gazetteer, the words around, a
check sum. Expectation-maximisation over the votes of all documents' candidates estimates each labeler's reliability, kind by kind, and gives every
pattern of votes a probability; a logistic model over the span's features is trained on those (on SAMPLE_ROWS distinct rows at most, about, by hash)
and decides, everywhere, which candidates are spans.

Defined results: null and empty texts have no spans; whole texts are scanned, at any length in time linear in their spans; repeated rows are scanned
each, and null ids stay null; a candidate that overlaps a base span is left out; spans that share a start stand in the order of KINDS; without
candidates the prior weights stand; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_batches, discard, materialise
from marginalia.llm.spans import Found, covered, find_spans, overlapping

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("local_phone", "card_number", "national_id", "account", "name")
KINDS = (*BASE_KINDS, *MORE_KINDS)
#: Distinct rows of features that the classifier is fitted on, about; ACCEPT: the least probability of a span.
SAMPLE_ROWS, ACCEPT, ROUNDS = 20_000, 0.9, 50

#: The base patterns. Look-behinds only spare starts inside a run whose first start has failed already.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

CANDIDATES = {
    "local_phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
    "card_number": re.compile(r"(?<![0-9A-Za-z])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}(?![0-9A-Za-z])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "account": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "name": re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?"),
}
#: Words that go with each kind, and first names.
CONTEXT = {
    "local_phone": ("phone", "call", "tel", "mobile", "cell", "fax", "contact"),
    "card_number": ("card", "visa", "credit", "debit", "payment"),
    "national_id": ("ssn", "social security", "national id", "insurance", "identity"),
    "account": ("iban", "account", "bank", "konto", "transfer", "compte", "cuenta"),
    "name": ("name", "contact", "signed", "dear", "regards", "patient", "customer"),
}
AGAINST = ("version", "isbn", "issue", "page", "figure", "chapter", "volume", "part no", "model", "order no")
FIRST_NAMES = frozenset("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter Paul Maria Jose Juan Carlos Luis Ana Hans Klaus Ursula Jean Pierre Marie Claude Sophie".split())
#: First digits of card issuers.
ISSUERS = ("4", "51", "52", "53", "54", "55", "2", "34", "37", "36", "6")
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> Found:
    out, ended = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            a = m.start()
            while a > ended and text[a - 1] in LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, "email", m.end()))
                ended = m.end()
    out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end()))
    if "+" in text:
        out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


def account_checks(word: str) -> bool:
    word = word.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in word[4:] + word[:4])) % 97 == 1


def votes(text: str, a: int, kind: str, b: int) -> tuple[int, ...]:
    """Each labeler's vote: 1 for, -1 against, 0 none. Shape, gazetteer, context for, context against."""
    word, before = text[a:b], text[max(0, a - WINDOW) : a].lower()
    around = before + " " + text[b : b + WINDOW].lower()
    digits = "".join(c for c in word if c.isdigit())
    if kind == "local_phone":
        shape = 1 if digits[-7] in "23456789" else -1
    elif kind == "card_number":
        shape = 1 if luhn(digits) else -1
    elif kind == "national_id":
        shape = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "account":
        shape = 1 if account_checks(word) else -1
    else:
        shape = 1
    known = word[0] == "+" or kind == "card_number" and digits.startswith(ISSUERS) or kind == "name" and any(w in FIRST_NAMES for w in word.split())
    gazetteer = 1 if known else -1 if kind != "name" and len(set(digits)) <= 2 else 0
    return shape, gazetteer, 1 if any(w in around for w in CONTEXT[kind]) else 0, -1 if any(w in before for w in AGAINST) else 0


def candidates(text: str, taken: Found) -> Found:
    out = [(m.start(), kind, m.end()) for kind, pattern in CANDIDATES.items() for m in pattern.finditer(text)]
    ranges = covered(taken) if out else []
    return [c for c in out if not overlapping(ranges, c[0], c[2])]


def features(text: str, a: int, kind: str, b: int) -> list[float]:
    word, v = text[a:b], votes(text, a, kind, b)
    n = max(len(word), 1)
    return [1.0, *(float(kind == k) for k in MORE_KINDS), *map(float, v), n / 30, sum(map(str.isdigit, word)) / n, sum(map(str.isupper, word)) / n, float(text[max(0, a - 2) : a].strip() == ":")]


def reliabilities(patterns: Counter) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over vote patterns: each pattern's probability of being personal data."""
    keys = list(patterns)
    if not keys:
        return {}
    v, n = np.array(keys), np.array([patterns[k] for k in keys], float)
    p = 1 / (1 + np.exp(-1.5 * v.sum(axis=1)))
    for _ in range(ROUNDS):
        prior = np.clip((p * n).sum() / n.sum(), 0.01, 0.99)
        odds = np.full(len(keys), np.log(prior / (1 - prior)))
        for k in range(v.shape[1]):
            for vote in (-1, 0, 1):
                at = v[:, k] == vote
                if at.any():
                    yes = ((p * n)[at].sum() + 1) / ((p * n).sum() + 3)
                    no = (((1 - p) * n)[at].sum() + 1) / (((1 - p) * n).sum() + 3)
                    # a vote for is never held against, nor the other way round
                    odds[at] += np.clip(np.log(yes / no), *((-4, 0), (-0.5, 0.5), (0, 4))[vote + 1])
        p = 1 / (1 + np.exp(-odds))
    return dict(zip(keys, p.tolist()))


def prior() -> np.ndarray:
    """Weights to start from: one labeler's vote is not enough, two are, and one against outweighs one for."""
    return np.array([-2.0, *[0.0] * len(MORE_KINDS), *[2.5] * 4, *[0.0] * 4])


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Newton steps on the logistic loss for soft labels of rows that count n times, with a ridge towards the prior weights."""
    w = first = prior()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        w = w - np.linalg.solve(hessian, x.T @ (n * (p - y)) + (w - first))
    return w


def fit(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The span classifier's weights. The votes of all documents' candidates give the labelers' reliabilities, kind by kind; the model is fitted on
    about SAMPLE_ROWS of the distinct rows of features, chosen by hash, each by its count."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: Counter = Counter()
            for text in batch.column(0).to_pylist():
                for a, kind, b in candidates(text, base_spans(text)) if text else ():
                    rows[kind, votes(text, a, kind, b), tuple(features(text, a, kind, b))] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in rows], pa.string()), pa.array([list(k[1]) for k in rows], pa.list_(pa.int32())), pa.array([list(k[2]) for k in rows], pa.list_(pa.float64())), pa.array(list(rows.values()), pa.int64())],
                names=["kind", "votes", "features", "n"],
            )

    found = docs.select(text_col).mapInArrow(run, "kind string, votes array<int>, features array<double>, n bigint")
    rows = materialise(found.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")), "votes")
    known: dict[tuple, float] = {}
    patterns: dict[str, Counter] = {}
    # at most 3 ** 4 patterns of votes a kind
    for r in rows.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect():
        patterns.setdefault(r["kind"], Counter())[tuple(r["votes"])] = r["n"]
    for kind, counted in patterns.items():
        known |= {(kind, v): p for v, p in reliabilities(counted).items()}
    if not known:
        return prior()
    part = min(1.0, SAMPLE_ROWS / max(rows.count(), 1))
    told = rows.filter(F.pmod(F.xxhash64("kind", "votes", "features"), F.lit(1 << 30)) < int(part * (1 << 30))).orderBy("kind", "votes", "features").collect()
    discard(docs.sparkSession, rows)
    if not told:
        return prior()
    return logistic(np.array([r["features"] for r in told]), np.array([known[r["kind"], tuple(r["votes"])] for r in told]), np.array([float(r["n"]) for r in told]))


def finder(weights: np.ndarray) -> Callable[[str], Found]:
    def find(text: str) -> Found:
        found = base_spans(text)
        more = candidates(text, found)
        return found + [c for c in more if 1 / (1 + np.exp(-np.clip(np.dot(features(text, *c), weights), -30, 30))) >= ACCEPT]

    return find


def personal_data_in(docs: DataFrame, weights: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans for every row of docs."""
    learnt = fit(docs, text_col) if weights is None else weights
    return find_spans(docs, lambda: finder(learnt), KINDS, id_col, text_col)
