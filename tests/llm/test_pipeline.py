"""run() against a brute-force version of its stages, on a small fixture folder."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from marginalia.llm import byte_bpe, mixing, quality
from tests.llm.test_dedup import WHITE, brute_components, brute_fingerprint

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    draw = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    good = [" ".join(draw.choices(words, k=draw.randrange(30, 90))) + "." for _ in range(90)]
    bad = ["!! ".join(draw.choices(words, k=40)).upper() + "!!" for _ in range(40)]
    texts = good + bad + [g + " \n" for g in good[:15]] + [g.replace(" ", "  ") for g in good[:5]] + [None, ""]
    out = tmp_path_factory.mktemp("tables")
    rows = [(k, t, "en", None if k % 9 == 0 else f"s{k % 4}", len(t or "")) for k, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{out}/documents.parquet")
    spark.createDataFrame([(k, int(k <= 90), 0) for k in range(1, 131)], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{out}/labels.parquet")
    return f"file://{out}"


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = trees.score(np.array([quality.statistics(r[1] or "") for r in rows])) >= 0.5
    rows = [r for r, g in zip(rows, good) if g]
    assert {r[0] for r in rows} >= set(range(1, 91)) and not {r[0] for r in rows} & set(range(91, 131))
    groups = defaultdict(list)
    for r in rows:
        groups[WHITE.sub("", r[1] or "")].append((-len(r[1] or ""), r[0]))
    kept = {min(g)[1] for g in groups.values()}
    rows = [r for r in rows if r[0] in kept]
    of = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    rows = [r for r in rows if of[r[0]] == r[0]]
    taken = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), [3, 1, 2]).collect() if r["size"]}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})
    want = sorted((r[0], tuple(library.encode_ordinary(r[1]))) for r in rows for _ in range(taken.get(r[0], 0)))
    got = sorted((r.doc_id, tuple(np.frombuffer(r.ids, np.uint32).tolist())) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and len(got) > 50


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
