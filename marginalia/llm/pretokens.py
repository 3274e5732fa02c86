"""Vectorised pre-tokenisation for byte-level BPE, without regular expressions.

The pattern of the public byte-level vocabularies is a small automaton over code point classes. Texts of a batch are
joined, turned into an array of classes (with one code point of look-ahead folded in), and cut into rows. Each row's
transition functions are composed column by column, all rows at once (composition is associative); entering states
are threaded through the rows' functions; a second pass gives each position's state, and a table tells from state
and class whether a token starts there.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

#: Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The pattern's contractions, after the apostrophe.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

# classes of code points
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# symbols of the automaton: classes with their look-ahead
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_SPACE_LAST, S_WHITE_LAST, S_WHITE_MORE, S_NONE = range(9)
# states: the token that the last position belongs to
NONE, LETTERS, NUMBERS, OTHERS, PREFIX, WHITES, ONE_LEFT, TWO_LEFT, ENDED = range(9)
N_STATES = 9
#: Columns in a row of the scan.
COLUMNS = 256
#: Code points that are scanned together; longer texts are cut where a word ends.
LIMIT = 1 << 20


@functools.cache
def classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    return table


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol * N_STATES + state], and whether a token starts at the symbol."""
    to, starts = np.zeros((9, N_STATES), np.uint8), np.ones((9, N_STATES), bool)

    def rule(symbol: int, opened: int, continued: dict[int, int]) -> None:
        to[symbol] = opened
        for state, then in continued.items():
            to[symbol, state], starts[symbol, state] = then, False

    rule(S_LETTER, LETTERS, {LETTERS: LETTERS, PREFIX: LETTERS, ONE_LEFT: ENDED, TWO_LEFT: ONE_LEFT})
    rule(S_NUMBER, NUMBERS, {NUMBERS: NUMBERS, PREFIX: NUMBERS})
    rule(S_OTHER, OTHERS, {OTHERS: OTHERS, PREFIX: OTHERS})
    rule(S_SHORT, ONE_LEFT, {OTHERS: OTHERS, PREFIX: OTHERS})
    rule(S_LONG, TWO_LEFT, {OTHERS: OTHERS, PREFIX: OTHERS})
    rule(S_SPACE_LAST, PREFIX, {})
    rule(S_WHITE_LAST, WHITES, {})
    rule(S_WHITE_MORE, WHITES, {WHITES: WHITES})
    for state in range(N_STATES):
        to[S_NONE, state], starts[S_NONE, state] = state, False
    return to.ravel(), starts.ravel()


def symbols(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The automaton's symbols; ends: positions after each text, where look-ahead stops."""
    kind = classes()[cp]
    white = kind >= SPACE
    after = np.empty_like(white)  # white space or the end follows
    after[:-1] = white[1:]
    after[-1:] = True
    last = ends[(ends > 0)] - 1
    after[last] = True
    out = kind.copy()
    out[kind == SPACE] = S_SPACE_LAST
    out[kind == WHITE] = S_WHITE_LAST
    out[white & after] = S_WHITE_MORE
    marks = np.flatnonzero(cp == 0x27)
    if marks.size:
        stop = ends[np.searchsorted(ends, marks, side="right")]
        for tails, symbol in ((SHORT, S_SHORT), (LONG, S_LONG)):
            for tail in tails:
                fits = marks + len(tail) < stop
                for k, c in enumerate(tail):
                    at = np.minimum(marks + 1 + k, cp.size - 1)
                    fits &= cp[at] == ord(c)
                out[marks[fits]] = symbol
    return out


def token_starts(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in cp where a token starts. Texts are cp[0:ends[0]], cp[ends[0]:ends[1]], ..."""
    if not cp.size:
        return np.zeros(0, np.int64)
    to, starts = automaton()
    sym = symbols(cp, ends)
    first = np.concatenate([[0], ends[:-1]])
    first = np.unique(first[first < cp.size])
    rows = -(-cp.size // COLUMNS)
    grid = np.full(rows * COLUMNS, S_NONE, np.uint8)
    grid[: cp.size] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, COLUMNS).T).astype(np.int32) * N_STATES
    fresh = np.zeros(rows * COLUMNS, bool)
    fresh[first] = True
    fresh = np.ascontiguousarray(fresh.reshape(rows, COLUMNS).T)
    some = fresh.any(axis=1)
    # each row's transition functions, composed from left to right
    f = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for c in range(COLUMNS):
        if some[c]:
            f[fresh[c]] = NONE
        f = to[grid[c][:, None] + f]
    state, enter = 0, np.empty(rows, np.uint8)
    for r, row in enumerate(f.tolist()):
        enter[r] = state
        state = row[state]
    begins = np.empty((COLUMNS, rows), bool)
    for c in range(COLUMNS):
        if some[c]:
            enter[fresh[c]] = NONE
        at = grid[c] + enter
        begins[c] = starts[at]
        enter = to[at]
    return np.flatnonzero(begins.T.ravel()[: cp.size])


def segments(text: str, limit: int = LIMIT) -> list[str]:
    """The text in pieces of about `limit`, cut between a word and white space, where a token always ends."""
    if len(text) <= limit:
        return [text]
    white, out, at = set(map(chr, WHITE_SPACE)), [], 0
    while at < len(text):
        cut = at + limit
        while cut < len(text) and not (text[cut] in white and text[cut - 1] not in white):
            cut += 1
        out.append(text[at:cut])
        at = cut
    return out


def pieces(texts: list[str]) -> list[list[bytes]]:
    """Each text's pre-tokens as UTF-8 bytes, in order; together they are the text."""
    out: list[list[bytes]] = [[] for _ in texts]
    held: list[tuple[int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        for part in segments(text):
            if size + len(part) > LIMIT and held:
                _scan(held, out)
                held, size = [], 0
            held.append((k, part))
            size += len(part)
    if held:
        _scan(held, out)
    return out


def _scan(held: list[tuple[int, str]], out: list[list[bytes]]) -> None:
    joined = "".join(part for _, part in held)
    if not joined:
        return
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(part) for _, part in held])
    begin = token_starts(cp, ends)
    data = joined.encode()
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    offset = np.concatenate([[0], np.cumsum(width)])
    at = offset[begin].tolist()
    at.append(len(data))
    found = [data[a:b] for a, b in zip(at, at[1:])]
    upto = np.searchsorted(begin, ends).tolist()
    a = 0
    for (k, _), b in zip(held, upto):
        out[k].extend(found[a:b])
        a = b
