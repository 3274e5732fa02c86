"""Byte-level BPE encoding and decoding.

Pre-tokens come from the vectorised scan of pretokens.py; each distinct pre-token is merged once a worker and kept
(up to KEPT of them, then new ones are merged each time). Encoding returns the ids and each token's end in bytes,
so a range of bytes can be decoded without the rest.

Defined results: null and empty texts have no ids and decode to empty bytes; special strings are ordinary text; texts
are encoded whole at any length; repeated rows are encoded each; a null id stays null; an empty table gives an empty table; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marginalia.llm.common import bounded_batches
from marginalia.llm.pretokens import pieces

#: Distinct pre-tokens that a worker keeps merged, and their greatest length.
KEPT, LONGEST_KEPT = 300_000, 64


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks(path), special_tokens={})


class Merged(dict):
    """Pre-token bytes -> ids as little-endian uint32 bytes."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.merge = encoding(path)._encode_single_piece
        self.update({k: np.uint32(v).tobytes() for k, v in ranks(path).items()})

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(self.merge(piece), np.uint32).tobytes()
        if len(self) < KEPT and len(piece) <= LONGEST_KEPT:
            self[piece] = ids
        return ids


@functools.cache
def merged(path: str) -> Merged:
    return Merged(path)


@functools.cache
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes by id, and their lengths."""
    known = ranks(path)
    out = [b""] * (max(known.values()) + 1)
    for token, i in known.items():
        out[i] = token
    return out, np.array([len(x) for x in out], np.uint32)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    known = merged(path)
    return [b"".join(map(known.__getitem__, p)) for p in pieces(texts)]


def ends_of(ids: bytes, path: str) -> bytes:
    """Each token's end in bytes of the text, as little-endian uint32."""
    return np.cumsum(vocabulary(path)[1][np.frombuffer(ids, np.uint32)], dtype=np.uint32).tobytes()


def decode_ids(ids: bytes, path: str) -> bytes:
    return b"".join(map(vocabulary(path)[0].__getitem__, np.frombuffer(ids, np.uint32).tolist()))


def decode_range(ids: bytes, ends: bytes, start: int, stop: int, path: str) -> bytes:
    """Bytes start to stop of the text, from the tokens that cover them only."""
    upto = np.frombuffer(ends, np.uint32)
    a, b = int(np.searchsorted(upto, start, side="right")), int(np.searchsorted(upto, stop, side="left")) + 1
    begin = int(upto[a - 1]) if a else 0
    return decode_ids(ids[4 * a : 4 * b], path)[start - begin : stop - begin]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids and token_ends (both little-endian uint32), one row for every row of docs."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encode_texts([x or "" for x in batch.column(1).to_pylist()], path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([ends_of(x, path) for x in ids], pa.binary())], names=[id_col, "n_tokens", "ids", "token_ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary, token_ends binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encoded with `decoded` (bytes) in place of token_ends; every other column stays."""
    bounded_batches(encoded.sparkSession)
    rows = encoded.drop("token_ends")
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([decode_ids(x, path) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructType

    return rows.mapInArrow(run, StructType(list(rows.schema)).add("decoded", BinaryType()))
