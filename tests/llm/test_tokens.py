import hashlib
import io
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import byte_bpe, exact_dedup, mixing, pretokens, queries, token_counts, token_files
from marginalia.llm.common import row_key

ALPHABET = ["a", "b", "'", "s", "re", "'s", "'ll", " ", "  ", "\n", "\t", "1", "٣", "é", "中", "!", " ", " ", "😀", "_", "\x1c", "\x85", "ſ", "<|endoftext|>", "hello", "ing", "\r\n"]


def texts(n, most):
    draw = random.Random(11)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(most))) for _ in range(n)] + ["", " ", "  ", "'s", " 's", "\n\nfoo"]


def test_byte_bpe_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})
    some = texts(3000, 40)
    for text, ids in zip(some, byte_bpe.encode_texts(some, path)):
        assert np.frombuffer(ids, np.uint32).tolist() == library.encode_ordinary(text)
        assert byte_bpe.decode_ids(ids, path) == text.encode()
        assert byte_bpe.decode_range(ids, byte_bpe.ends_of(ids, path), 2, 9, path) == text.encode()[2:9]


def test_segments_end_where_tokens_do():
    text = " ".join(texts(300, 20))
    parts = pretokens.segments(text, 50)
    assert len(parts) > 10 and "".join(parts) == text
    assert sum(pretokens.pieces(parts), []) == pretokens.pieces([text])[0]


def test_bpe_query_rows(docs, documents, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in rows) == sorted((r[0], (r[1] or "").encode()) for r in documents)
    assert byte_bpe.decode(byte_bpe.encode(empty, path), path).collect() == []


def test_prefix_counts_equal_the_library(docs, documents, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    some = texts(300, 14)
    for text, table in zip(some, token_counts.tables(some, path)):
        want = [len(e) for e in library.encode_batch([text[:j] for j in range(len(text) + 1)], add_special_tokens=False)]
        assert [token_counts.count_at(table, len(text[:j].encode())) for j in range(len(text) + 1)] == want
        cut = token_counts.longest_within(table, text, 3)
        assert cut == max((text[:j] for j, n in enumerate(want) if n <= 3), key=len)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.prefix_counts(docs, path).collect())
    assert got == sorted((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False))) for r in documents)
    assert token_counts.prefix_counts(empty, path).collect() == []


def test_token_files(spark, docs, documents, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    some = texts(1000, 30)
    assert [np.frombuffer(x, np.uint32).tolist() for x in token_files.words(path).encode(pa.array(some))] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    out = f"file://{tmp_path}/ids"
    got = token_files.tokenise_to_files(docs, path, 2, out).orderBy("start").collect()
    start = 0
    for r, d in zip(got, sorted(documents, key=lambda d: d[0])):
        ids = library.encode(d[1] or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(documents)
    # one document's frame alone, and the file as any zstandard reader sees it
    name = next(p for p in sorted((tmp_path / "ids").glob("part-*")))
    with name.open("rb") as f:
        ids, _ = token_files.seek_table(f)
        (one,) = token_files.read_documents(f, {int(ids[0])})
        every = b"".join(x for _, x in token_files.read_documents(f))
    assert one[1] == every[: len(one[1])]
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(name.read_bytes()), read_across_frames=True).read() == every


def test_every_id_comes_back(spark):
    """Null ids come first, then the least bigint: neither is taken for the other."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(-(2**63), "least"), (None, "none"), (3, "three"), (2**63 - 1, "most"), (None, "none too"), (0, None)], "doc_id bigint, text string")
    got = [r.doc_id for r in token_files.tokenise_to_files(docs, path, 2).orderBy("start").collect()]
    assert got == [None, None, -(2**63), 0, 3, 2**63 - 1]


def test_maps_and_repeated_rows(spark):
    rows = [(1, "a b", {"x": 1, "y": 2}), (1, "a b", {"y": 2, "x": 1}), (2, "a  b", None), (3, "c", {})]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra map<string,int>")
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [(2, "a  b"), (3, "c")]


def test_mixture(docs, documents, empty):
    rows = mixing.mix(docs, [3, 1, 2]).collect()
    assert len(rows) == len(documents)
    total, by = sum(r["size"] for r in rows), {}
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (size, target), some in by.items():
        assert target <= 2 * size and abs(sum(r.taken for r in some) - target) <= 2 * max(r["size"] for r in some)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs, [3, 1, 2]).collect()))
    assert mixing.mix(empty, [3, 1, 2]).collect() == []
    assert mixing.mixture(docs, [3, 1, 2]).columns == docs.columns


def same_as_library(some, path):
    library = Tokenizer.from_file(path)
    got = token_files.Words(path).encode(pa.array(some))
    return [t for t, x, e in zip(some, got, library.encode_batch(some, add_special_tokens=False)) if np.frombuffer(x, "<u4").tolist() != e.ids]


def test_words_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    for some in (["plain words", "of letters", "x"], ["क़लम qalam", "İstanbul ﬁne ＡＢ Ω ǅ ｶﾞ 한글", "zebra apple's été don't3x"], ["", " ", "$$$ ...", "<|endoftext|>.", "<|ENDOFTEXT|>!"], ["z" * 300 + " " + "y" * 70 + "."] * 2):
        assert same_as_library(some, path) == []


def test_marks_after_every_letter():
    """Normalising may leave a combining mark at a word's end, which joins the marks that follow."""
    path = public_tokenizers.path("word_bpe_49k.json")
    chars = [c for c in map(chr, range(0x3100)) if unicodedata.category(c)[0] in "LMN"] + ["\uac00", "\U00010400", "\U0001d400"]
    assert same_as_library([c + "." for c in chars] + ["Xy" + c + "!?" for c in chars] + ["é" + c + "a|" for c in chars], path) == []
    assert same_as_library(["İ.", "फ़.", "ড়!", "İstanbul'a, İİ;"], path) == []


def test_other_vocabularies_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_files.Words(path).by_words
    assert same_as_library(["Hello  World\n\n x", "ABC abc", ""], path) == []


def test_starts_follow_file_numbers(spark):
    rows = [(f"part-{n}-x-c{c}.txt", 0, 10 * k + c + 1) for k, n in enumerate(("00000", "99999", "100000")) for c in (0, 999, 1000)]
    found = token_files.with_starts(spark.createDataFrame([(f, a, n, b"") for f, a, n in rows], "file string, at int, n_tokens bigint, ids binary")).collect()
    starts, total = {}, 0
    for f, _, n in rows:
        starts[f], total = total, total + n
    assert {r.file: r.start for r in found} == starts


def test_digests_of_queries(spark):
    """The derived columns of op4 and op8 against the libraries, over a whole table."""
    path, limit = public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.TOKEN_LIMIT
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})
    counter = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op8_byte_bpe(spark, sf).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    over = 0
    for r in queries.op4_token_counts(spark, sf).collect():
        n = len(counter.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > limit)
        over += r.over_limit
    assert over


def test_mixture_decides_by_row(spark):
    """Rows that share an id take their own copies; rows that repeat whole take those of all."""
    rows = [(7, f"words of row {k} " * (1 + k % 5), f"s{k % 3}") for k in range(40)] + [(None, f"no id {k}", "s1") for k in range(20)] + [(8, "the very same row", "s2")] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("__pass", F.lit(1)).withColumn("__copies", F.lit(2))
    told = mixing.mix(docs, [3, 1, 2], carried=[*row_key(docs), F.col("text")]).collect()
    want = Counter()
    for r in told:
        want[r.text] += r.copies
    got = mixing.mixture(docs, [3, 1, 2])
    assert got.columns == docs.columns
    assert Counter(r.text for r in got.collect()) == +want
