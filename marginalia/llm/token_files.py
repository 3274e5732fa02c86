"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames, one for each document (its ids as little-endian unsigned 32-bit
integers, with zstandard's own content checksum), then a skippable frame with the documents' ids, then the seek table of
the public seekable format: a skippable frame with each frame's compressed size, size and XXH64 checksum, and a footer
at the very end. Any zstandard reader reads such a file whole; `read_documents` opens the end of it, and then only the
frames asked for.

Files are written by Spark's text writer, whose commit protocol keeps a lost or repeated task from leaving a second copy
and which reaches any store that Spark reaches: a row is one file's bytes, and the line's end is the format's last
four bytes. Files are in ascending order of document id, by name.

Defined results: null and empty texts have the end id alone; a null doc_id comes first; repeated rows are written each, next to one another,
ordered by their text's hash; an empty table gives no files; texts of any length are encoded whole and make one frame each; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_batches, materialise, new_path, text_or_empty

#: Fixed values of the zstandard and seekable formats.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: A file is closed at this many compressed bytes.
FILE_BYTES = 32 << 20
#: Distinct words that a worker keeps encoded, and their greatest length.
KEPT, LONGEST_KEPT = 400_000, 64
#: Texts whose words are made distinct together, by rows and bytes.
GATHER_ROWS, GATHER_BYTES = 4000, 16 << 20
#: Marks that may end a word. Letters below LATIN_END but for DOTTED are single letters in lower case too, and never compose with what precedes them.
TAIL, LATIN_END, DOTTED = ".,!?;:|$%*&#", "\u0250", "\u0130"
#: The steps and the pattern of vocabularies that are encoded by words.
STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else the next of 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + k for k, b in enumerate(rest)}


def by_words(tokenizer) -> bool:
    """Whether a text's ids are its words' ids in a row, letter case aside: the vocabulary's own rules say so."""
    told = json.loads(tokenizer.to_str())
    parts = [*(told["normalizer"] or {}).get("normalizers", []), *(told["pre_tokenizer"] or {}).get("pretokenizers", [])]
    plain = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and t["content"][0] == "<" and t["content"][-1] == ">" and len(t["content"].split()) == 1 for t in told["added_tokens"])
    return plain and [p["type"] for p in parts] == STEPS and parts[3]["pattern"] == {"Regex": PRE_TOKEN} and bool(told["model"].get("end_of_word_suffix")) and not parts[4]["use_regex"] and not parts[4]["add_prefix_space"]


class Words:
    """Texts -> ids as little-endian uint32 bytes, by the tokenizers library.

    Where the vocabulary's rules cut at white space anyway (by_words), a text's ids are its words' ids in a row: a batch's words are made
    distinct by Arrow, only words not met before go to the library, and ids are gathered by numpy. Any other
    vocabulary encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words(self.tokenizer)
        self.known: dict[bytes, bytes] = {b"": b""}
        self.cores: dict[str, bytes] = {"": b""}
        self.letters = byte_letters()

    def alone(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word or text, by the whole tokenizer."""
        return (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))

    def letters_only(self, words: list[str]) -> Iterator[bytes]:
        """The same for lower-case words of Latin letters: each is one pre-token that the normaliser leaves alone, so
        only the library's merging is called."""
        merge = self.tokenizer.model.tokenize
        for word in words:
            yield array("I", [t.id for t in merge(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words. Marks of TAIL after a Latin letter or number are a pre-token of their own (no other letter is cut off:
        normalising may leave a combining mark at its end, which joins what follows), and Latin letters are
        made lower case by the normaliser anyway, so words share what the library encodes."""
        parts: dict[bytes, tuple[str, str]] = {}
        letters, rest, known = set(), set(), self.cores
        for w in new:
            word = w.decode()
            core = word.rstrip(TAIL)
            last = core[-1:]
            if not (last.isalnum() and last < LATIN_END and last != DOTTED):
                core = word
            if core.isascii():
                plain = core.isalpha()
                if plain or "<" not in core:
                    core = core.lower()
            elif plain := core.isalpha() and max(core) < LATIN_END and DOTTED not in core:
                core = core.lower()
            tail = word[len(core) :]
            parts[w] = core, tail
            if core not in known:
                (letters if plain else rest).add(core)
            if tail not in known:
                rest.add(tail)
        learnt = {}
        for some, how in ((list(letters), self.letters_only), (list(rest), self.alone)):
            learnt |= dict(zip(some, how(some)))
        known.update(learnt)
        out = {w: known[core] + known[tail] for w, (core, tail) in parts.items()}
        if len(known) > KEPT:
            for x in learnt:
                del known[x]
        else:
            for x in learnt:
                if len(x) > LONGEST_KEPT:
                    del known[x]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        if not self.by_words:
            return list(self.alone(texts.to_pylist()))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        distinct, codes, bounds = coded.dictionary, coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
        place = np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1].tolist() if len(distinct) else [0]
        data = distinct.buffers()[2].to_pybytes() if len(distinct) and distinct.buffers()[2] else b""
        words = [data[a:b] for a, b in zip(place, place[1:])]
        found = list(map(self.known.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        learnt = self.learn(new)
        found = [learnt[w] if ids is None else ids for w, ids in zip(words, found)]
        if len(self.known) < KEPT:
            self.known.update((w, ids) for w, ids in learnt.items() if len(w) <= LONGEST_KEPT)
        # the ids of all words in a row, gathered from the ids of the distinct ones
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, table = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), "<u4")
        size = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = table[np.repeat(starts[codes] - upto[:-1], size) + np.arange(upto[-1])]
        cuts = upto[bounds - bounds[0]].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


@functools.cache
def words(path: str) -> Words:
    return Words(path)


class FileBuilder:
    """Gathers frames, and gives the bytes of a file without the four of its end."""

    def __init__(self) -> None:
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True).compress
        self.frames: list[bytes] = []
        self.rows: list[tuple[int | None, int, int, int]] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.compress(ids)
        self.frames.append(frame)
        self.rows.append((doc_id, len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.size += len(frame)

    def close(self) -> bytes:
        # a byte for each document says whether it has an id
        known = bytes(r[0] is not None for r in self.rows)
        index = np.array([r[0] or 0 for r in self.rows], "<i8").tobytes() + known
        index = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        entries = [(a, b, c) for _, a, b, c in self.rows] + [(len(index), 0, 0)]
        table = b"".join(struct.pack("<III", *e) for e in entries)
        head = struct.pack("<II", SKIPPABLE_TABLE, len(table) + 9)
        return b"".join([*self.frames, index, head, table, struct.pack("<IB", len(entries), 0x80)])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= GATHER_ROWS or size >= GATHER_BYTES:
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def write_ids(docs: DataFrame, encode: Callable[[pa.Array], list[bytes]], end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every row of docs, in ascending order of id, to files below path."""
    bounded_batches(docs.sparkSession)
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = FileBuilder()
        gc.disable()  # the words kept are many small objects without cycles
        try:
            for batch in gathered(batches):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                    out.add(doc_id, ids + end)
                    if out.size >= FILE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([out.close()], pa.binary())], names=["file"])
                        out = FileBuilder()
        finally:
            gc.enable()
        if out.rows:
            yield pa.RecordBatch.from_arrays([pa.array([out.close()], pa.binary())], names=["file"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    files = ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", struct.pack("<I", FOOTER_MAGIC).decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def seek_table(f: BinaryIO) -> tuple[list[int | None], np.ndarray]:
    """Document ids (none for a null id), and for each its frame's (offset, size, ids' size, checksum), from the end of a file."""
    f.seek(-9, os.SEEK_END)
    n, kind, magic = struct.unpack("<IBI", f.read(9))
    if magic != FOOTER_MAGIC or kind != 0x80:
        raise ValueError("not a seekable file with checksums")
    f.seek(-(9 + 12 * n), os.SEEK_END)
    table = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
    offset = np.concatenate([[0], np.cumsum(table[:, 0])])
    f.seek(int(offset[n - 1]) + 8)
    ids, known = np.frombuffer(f.read(8 * (n - 1)), "<i8").tolist(), f.read(n - 1)
    return [x if there else None for x, there in zip(ids, known)], np.column_stack([offset[: n - 1], table[: n - 1]])


def read_documents(f: BinaryIO, wanted: set[int | None] | None = None) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids as bytes) of the documents wanted, or of all; no other frame is read. Checksums are held."""
    import xxhash
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    ids, frames = seek_table(f)
    for doc_id, (at, size, full, checksum) in zip(ids, frames.tolist()):
        if wanted is None or doc_id in wanted:
            f.seek(at)
            data = decompress(f.read(size), max_output_size=full)
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                raise ValueError(f"checksum of document {doc_id}")
            yield doc_id, data


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, at (place in the file), n_tokens, crc32 and ids of every document in the files below path."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        names = ["doc_id", "file", "at", "n_tokens", "ids_crc32", "ids"]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                size = 0
                for at, (doc_id, data) in enumerate(read_documents(io.BytesIO(content.as_buffer()))):
                    rows.append((doc_id, name, at, len(data) // 4, zlib.crc32(data), data))
                    size += len(data)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema)

    schema = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("at", pa.int32()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, "doc_id bigint, file string, at int, n_tokens bigint, ids_crc32 bigint, ids binary")


def with_starts(documents: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before, over all files. Prefix sums by file, then within a file."""
    rows = materialise(documents.drop("ids"), "documents")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    # one row a file of FILE_BYTES; the numbers of its part and of the file within the part give its place
    number = [F.regexp_extract("file", pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)")]
    base = files.select("file", F.coalesce(F.sum("file_tokens").over(W.orderBy(*number).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    upto = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    within = rows.withColumn("start", F.sum("n_tokens").over(upto) - F.col("n_tokens"))
    return within.join(base, "file").withColumn("start", F.col("base") + F.col("start")).drop("base")


def tokenise_to_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Encodes docs by a tokenizers file into files below path, and returns what the files hold, with starts."""
    path = path or new_path(docs.sparkSession, "token-files")
    write_ids(docs, lambda texts: words(tokenizer).encode(texts), end_id, path)
    return with_starts(read_ids(docs.sparkSession, path))
