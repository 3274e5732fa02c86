"""Fill-in-the-middle against plain slices, and the offsets against one match a code point over the whole text."""

import hashlib
import random

from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from marginalia.llm import infill


def plain(row_id, text):
    text, mark = text or "", hashlib.sha256(f"1:{'' if row_id is None else row_id}".encode()).hexdigest()
    h = [int(mark[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_offsets_are_those_of_the_whole_text():
    draw = random.Random(1)
    whole = pre_tokenizers.Split(Regex(infill.CODE_POINT), "isolated").pre_tokenize_str
    signs = ["a", "é", "é", " ", "  ", "\n", "\r\n", "中", "😀", "👩‍🚀", "\x00", " ", "　", "<", "ß", "x" * 70]
    for k in range(120):
        text = "".join(draw.choices(signs, k=draw.randrange(0, 200))) if k else "y" * (2 * infill.AT_ONCE + 7)
        starts, found = [a for _, (a, _) in whole(text)], infill.Offsets(text)
        assert starts == list(range(len(text))) and found.n == len(starts)
        assert [found.at(r) for r in range(found.n + 1)] == [*starts, len(text)]


def test_rows_against_plain_code(spark):
    draw = random.Random(2)
    texts = [None, "", " ", "<P>", "a <M> b", "<", "<S", "no sentinel < P >", "中文 text\n\n\t😀", "long " * 30_000, "w" * 50_000]
    texts += ["".join(draw.choices("ab <>PSM\n é😀", k=draw.randrange(1, 80))) for _ in range(150)]
    rows = [(k if k % 11 else -k, t, "x", "y") for k, t in enumerate(texts)] + [(None, "null id", "x", "y"), (3, "<P>", "x", "y"), (2**62, "large", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n string, output string")
    got = infill.fill_in_middle(docs)
    told = got.collect()
    assert sorted(map(tuple, told), key=repr) == sorted(((r[0], *plain(r[0], r[1])) for r in rows), key=repr)
    again = {(r.doc_id, r.text) for r in got.select("doc_id", infill.restored().alias("text")).collect()}
    assert again == {(r[0], r[1] or "") for r in rows}
    assert {r.form for r in told} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.limit(0)).collect() == []


def test_other_shares_and_seeds(spark):
    docs = spark.range(400).select(F.col("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    forms = {r.form: r["count"] for r in infill.fill_in_middle(docs, "id", "t", seed=7, plain_from=50, spm_below=100).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "spm"} and 140 < forms["plain"] < 260
