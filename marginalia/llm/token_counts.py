"""Token counts at every prefix of a text, by prefix dynamic programming.

A sequence of byte-pair tokens is the encoding of its text exactly when each adjacent pair is the encoding of the
pair's own text. So the last token of a prefix's encoding is the one token that ends the prefix and fits the last token of the
prefix before it, and count[j] = count[j - len(token)] + 1. The table of a pre-token is worked out once a worker, the
fit of a pair of tokens once as well (by the tokenizers library's model); a text's table is its pre-tokens' tables
in a row. It is kept as one signed byte for each byte of the text: the change of the count at that byte, so
count(text[:j]) is the sum of the first j bytes, at every j that ends a code point.

Where white space before a word is cut, a prefix tokenises otherwise than the full text: the white space and the
word are one unit here, whose table says what each of its prefixes gives alone. A special token's string counts 1
where it is complete, and as ordinary text before.

Defined results: null and empty texts have 0 tokens and an empty table; whole texts count at any length; repeated
rows are counted each, and null ids stay null; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_batches
from marginalia.llm.pretokens import LONG, SHORT, WHITE_SPACE, pieces

#: Distinct units that a worker keeps, and pairs of tokens.
KEPT, KEPT_PAIRS, LONGEST_KEPT = 250_000, 300_000, 64
BLANKS = b"\x20\t\n\x0b\x0c\r"
BLANK, WHITE = frozenset(BLANKS), frozenset(map(chr, WHITE_SPACE))
CONTRACTIONS = frozenset(f"'{x}".encode() for x in (*SHORT, *LONG))


def printable() -> str:
    """The byte-level alphabet: the character that stands for each byte, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


class Prefixes(dict):
    """Unit bytes -> the changes of its token count, one signed byte each."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.model = tokenizer.model
        #: Each token, and each end of one: whether it is a token itself.
        self.known: dict[str, bool] = {}
        for token in tokenizer.get_vocab(with_added_tokens=False):
            for k in range(1, len(token)):
                self.known.setdefault(token[k:], False)
            if len(self.model.tokenize(token)) == 1:
                self.known[token] = True
        self.show = dict(enumerate(printable()))
        #: token -> token that may follow -> whether the two are the encoding of their text
        self.fit: dict[str, dict[str, bool]] = {"": {}}
        self.n_pairs = 0

    def fits(self, a: str, b: str) -> bool:
        found = not a or [x.value for x in self.model.tokenize(a + b)] == [a, b]
        if self.n_pairs < KEPT_PAIRS:
            self.fit.setdefault(a, {})[b] = found
            self.n_pairs += 1
        return found

    def walk(self, texts: list[str]) -> Iterator[list[int]]:
        """Tokens of each prefix of each text (in the byte-level alphabet, from the empty prefix on). What a text shares with the
        one before it is not worked out again, so sorted texts are best."""
        known, fit = self.known.get, self.fit
        before, last, count = "", [""], [0]
        for text in texts:
            same, most = 0, min(len(text), len(before))
            while same < most and text[same] == before[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :]
            for j in range(same + 1, len(text) + 1):
                for i in range(j - 1, -1, -1):
                    token = text[i:j]
                    if whole := known(token):
                        prior = last[i]
                        after = fit.get(prior)
                        fine = after.get(token) if after is not None else None
                        if self.fits(prior, token) if fine is None else fine:
                            last.append(token)
                            count.append(count[i] + 1)
                            break
                    elif whole is None:
                        raise ValueError(f"no token of the vocabulary ends {text[:j]!r}")
            before = text
            yield count

    def counts(self, piece: bytes) -> list[int]:
        """Tokens of each prefix of one pre-token, in bytes."""
        return next(self.walk([piece.decode("latin-1").translate(self.show)]))[1:]

    def learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """The tables of units."""
        out, plain = {}, {}
        for unit in new:
            if unit in CONTRACTIONS or unit[0] >= 128 or unit[0] in BLANK and not (unit[0] == 0x20 and unit[1:2].isalnum()):
                out[unit] = self.changes(self.unit(unit))
            else:
                plain[unit.decode("latin-1").translate(self.show)] = unit
        texts = sorted(plain)
        for text, count in zip(texts, self.walk(texts)):
            out[plain[text]] = self.changes(count[1:], count[0])
        return out

    @staticmethod
    def changes(counts: list[int], first: int = 0) -> bytes:
        """Each count less the one before, as signed bytes. One more byte of text changes a count by more only where a merge of over 127 tokens comes undone."""
        steps = [b - a for a, b in zip([first, *counts], counts)]
        if steps and not (min(steps) >= -128 and max(steps) <= 127):
            raise ValueError("a count changes by more than a signed byte holds")
        return bytes([x & 255 for x in steps])

    def tables(self, rows: list[list[bytes]]) -> list[bytes]:
        learnt = self.learn(set(filterfalse(self.__contains__, chain.from_iterable(rows))))
        self.update(learnt)
        out = [b"".join(map(self.__getitem__, row)) for row in rows]
        full = len(self) > KEPT
        for x in learnt:
            if full or len(x) > LONGEST_KEPT:
                del self[x]
        return out

    def unit(self, unit: bytes) -> list[int]:
        if unit in CONTRACTIONS:  # its prefixes are an apostrophe and letters
            alone = self.counts(b"'")[0]
            return [alone, *(alone + x for x in self.counts(unit[1:-1])), self.counts(unit)[-1]]
        if unit[0] not in BLANK and unit[0] < 128 or unit[0] == 0x20 and unit[1:2].isalnum():
            return self.counts(unit)
        text = unit.decode()
        n = next((k for k, c in enumerate(text) if c not in WHITE), len(text))
        if n in (0, len(text)) or n == 1 and text[0] == " ":
            return self.counts(unit)
        # n white space characters, of which the last goes with the word (a space) or stands alone
        whole = self.counts(text[:n].encode())
        before = len(text[: n - 1].encode())
        base = whole[before - 1] if before else 0
        if text[n - 1] == " ":
            return whole + [base + x for x in self.counts(unit[before:])[1:]]
        base += self.counts(unit[before : len(whole)])[-1]
        return whole + [base + x for x in self.unit(unit[len(whole) :])]


@functools.cache
def prefixes(path: str) -> Prefixes:
    return Prefixes(path)


def blank(piece: bytes) -> bool:
    """Whether a pre-token is white space only."""
    if piece[0] not in BLANK and piece[0] < 128:
        return False
    return piece.strip(BLANKS) == b"" or not piece.isascii() and WHITE.issuperset(piece.decode())


def units(parts: list[bytes]) -> list[bytes]:
    """Pre-tokens, with each run of white space joined to the pre-token that took its last character."""
    hits = [k for k, p in enumerate(parts) if p.isspace() or not p.isascii() and blank(p)]
    if not hits:
        return parts
    out, at = [], 0
    for k in hits:
        if k < at:
            continue
        out += parts[at:k]
        at = k + 1
        while at < len(parts) and blank(parts[at]):
            at += 1
        at = min(at + 1, len(parts))
        out.append(b"".join(parts[k:at]))
    return out + parts[at:]


def tables(texts: list[str], path: str) -> list[bytes]:
    """Each text's table. Up to its last byte a special token's string is ordinary text, so it is counted as such
    behind the part before it, and the last byte's change then makes it one token."""
    known = prefixes(path)
    mark = known.special[0] if known.special else None
    plain, where, ended = [], [], []
    for k, text in enumerate(texts):
        parts = text.split(mark) if mark and mark in text else [text]
        for part in parts[:-1]:
            plain.append(part + mark)
            ended.append(len(part.encode()))
        plain.append(parts[-1])
        ended.append(-1)
        where += [k] * len(parts)
    out: list[list[bytes]] = [[] for _ in texts]
    for k, before, table in zip(where, ended, known.tables([units(p) for p in pieces(plain)])):
        if before >= 0:
            changes = np.frombuffer(table, np.int8).copy()
            changes[-1] = int(changes[:before].sum()) + 1 - int(changes[:-1].sum())
            table = changes.tobytes()
        out[k].append(table)
    return [b"".join(x) for x in out]


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and changes (the table: a signed byte for each byte of the text) for every row of docs."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tables([x or "" for x in batch.column(1).to_pylist()], path)
            counts = [int(np.frombuffer(x, np.int8).sum()) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.binary())], names=[id_col, "n_bytes", "n_tokens", "changes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, changes binary")


def count_at(changes: bytes, n_bytes: int) -> int:
    """Tokens of the first n_bytes bytes of the text."""
    return int(np.frombuffer(changes, np.int8)[:n_bytes].sum())


def longest_within(changes: bytes, text: str, budget: int) -> str:
    """The longest prefix of the text, in whole code points, of at most `budget` tokens."""
    data = np.frombuffer(text.encode(), np.uint8)
    ends = np.append((data[1:] & 0xC0) != 0x80, True) if data.size else np.zeros(0, bool)
    fine = np.flatnonzero(ends & (np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64) <= budget))
    return data[: fine[-1] + 1].tobytes().decode() if fine.size else ""


def over_limit(limit: int) -> Column:
    return F.col("n_tokens") > limit
