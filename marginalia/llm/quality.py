"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken over whole texts. Trees are grown on histograms of binned statistics, from a bounded sample of labelled
rows (SAMPLE, chosen by hash of the id among all labelled rows), and flattened into arrays: a batch's rows walk
all trees at once in numpy.

Defined results: null and empty texts have statistics of zeros and a score like any other; a label that is null or
whose document is missing teaches nothing, of several labels of one document the lowest counts, of several texts of one labelled id the least;
without two kinds of labels every score is the labels' share (0.5 without labels); repeated rows are scored each, and null ids stay null; equal
statistics score alike; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_batches

#: Labelled rows that the trees are grown on, about and at most twice.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, SHRINK = 80, 4, 64, 0.15, 8, 1.0
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "white", "punctuation", "symbol", "exclamation", "bar", "not_ascii",
    "repeated_lines", "repeated_line_bytes", "line_bytes", "distinct_words", "top_word", "upper_words", "short_words", "stops", "repeated_pairs",
    "entropy", "odd_ends", "long_words", "control", "letters", "line_ends",
)

UPPER, LOWER, DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
SYMBOLS = np.frombuffer(b"#$%&*+<=>@\\^_`{|}~", np.uint8)
STOPS = np.frombuffer(b".?", np.uint8)


def statistics(text: str) -> np.ndarray:
    out = np.zeros(len(STATISTICS))
    data = text.encode()
    if not data:
        return out
    n = len(data)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = count / n
    words, lines = data.split(), data.split(b"\n")
    w = max(len(words), 1)
    letters = count[UPPER].sum() + count[LOWER].sum()
    seen, seen_words = Counter(lines), Counter(words)
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    again = [(k, len(x)) for x, k in seen.items() if k > 1 and x]
    some = share[share > 0]
    ends = Counter(x[-1] for x in words)
    out[:] = (
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / w, count[UPPER].sum() / max(letters, 1), share[DIGIT].sum(), share[[9, 10, 11, 12, 13, 32]].sum(),
        share[PUNCTUATION].sum(), share[SYMBOLS].sum(), share[33], share[124], share[128:].sum(),
        1 - len(seen) / len(lines), sum((k - 1) * size for k, size in again) / n, n / len(lines), len(seen_words) / w, max(seen_words.values(), default=0) / w,
        sum(k for x, k in seen_words.items() if x.isupper()) / w, sum(k for x, k in seen_words.items() if len(x) <= 3) / w, share[STOPS].sum() * n / w, 1 - pairs / max(w - 1, 1),
        -(some * np.log2(some)).sum(), sum(k for c, k in ends.items() if c < 128 and not chr(c).isalnum() and c not in b".,") / w,
        sum(k for x, k in seen_words.items() if len(x) > 25) / w, share[:9].sum() + share[14:32].sum(), letters / n, len(lines) / w,
    )
    return out


class Trees:
    """Flattened trees: node arrays over all trees, and each tree's root."""

    def __init__(self, base: float) -> None:
        self.base, self.roots = base, np.zeros(0, np.int64)
        self.feature = self.left = self.right = np.zeros(0, np.int64)
        self.limit = self.value = np.zeros(0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not self.roots.size or not len(x):
            return np.full(len(x), self.base)
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts trees on the logistic loss, second order, by histograms."""
    mean = float(y.mean()) if y.size else 0.5
    trees = Trees(float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / np.clip(1 - mean, 1e-6, 1 - 1e-6))))
    if not y.size or not 0 < mean < 1:
        return trees
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    flat = bins + np.arange(x.shape[1]) * BINS
    raw, nodes, roots = np.full(y.size, trees.base), [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, 0, 0, 0.0])
        open_nodes = [(len(nodes) - 1, np.arange(y.size), 0)]
        while open_nodes:
            at, rows, depth = open_nodes.pop()
            G, H = g[rows].sum(), h[rows].sum()
            nodes[at] = [0, np.inf, at, at, -RATE * G / (H + SHRINK)]
            if depth == DEPTH or rows.size < 2 * LEAST:
                continue
            cells = flat[rows].ravel()
            size = x.shape[1] * BINS
            shape = (x.shape[1], BINS)
            gs = np.bincount(cells, np.repeat(g[rows], x.shape[1]), size).reshape(shape).cumsum(axis=1)
            hs = np.bincount(cells, np.repeat(h[rows], x.shape[1]), size).reshape(shape).cumsum(axis=1)
            ns = np.bincount(cells, minlength=size).reshape(shape).cumsum(axis=1)
            gain = gs**2 / (hs + SHRINK) + (G - gs) ** 2 / (H - hs + SHRINK) - G**2 / (H + SHRINK)
            gain[(ns < LEAST) | (rows.size - ns < LEAST)] = 0
            f, b = divmod(int(gain.argmax()), BINS)
            if gain[f, b] <= 1e-6:
                continue
            go = bins[rows, f] <= b
            a = len(nodes)
            nodes += [[0] * 5, [0] * 5]
            nodes[at] = [f, float(edges[f][b]), a, a + 1, 0.0]
            open_nodes += [(a, rows[go], depth + 1), (a + 1, rows[~go], depth + 1)]
        trees.feature, trees.left, trees.right = (np.array([n[k] for n in nodes], np.int64) for k in (0, 2, 3))
        trees.limit, trees.value = (np.array([n[k] for n in nodes], float) for k in (1, 4))
        trees.roots = np.array(roots[-1:])
        raw += trees.raw(x) - trees.base
    trees.roots = np.array(roots)
    return trees


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees from the labelled rows that are not held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
    part = min(1.0, SAMPLE / max(known.count(), 1))
    sample = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(part * (1 << 30))).limit(2 * SAMPLE)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
    rows = rows.groupBy("__id").agg(F.min("__label").alias("__label"), F.min(F.coalesce("__text", F.lit(""))).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(x or "").tolist() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(stats, pa.list_(pa.float64()))], names=["id", "label", "stats"])

    found = rows.mapInArrow(run, "id bigint, label int, stats array<double>").toArrow().sort_by("id")
    x = np.array(found["stats"].to_pylist(), float).reshape(-1, len(STATISTICS))
    return grow(x, np.array(found["label"].to_pylist(), float))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: better) for every row of docs."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(1).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is `least` or more, with all columns of docs."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(trees.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
