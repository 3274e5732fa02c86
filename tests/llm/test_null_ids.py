"""A null doc_id is one id: no operator fails on it, and none of its rows is lost."""

import public_tokenizers
import pytest

from marginalia.llm import byte_bpe, exact_dedup, mixing, pii, secret_scan, simhash, token_counts, token_files

ROWS = [(None, "a text of its own without an id, long enough"), (1, "copied words here"), (None, "copied  words here too"), (2, "something else entirely"), (3, "copied words\nhere"), (None, None)]


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame([(d, t, "en", "s", 0) for d, t in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_dedup(some):
    found = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_duplicates(some).collect()}
    assert len(found) == 6 and all(r.kept is not None for r in found.values())
    kept = exact_dedup.drop_exact_duplicates(some)
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for d, t in ROWS if d != 3)
    assert sorted(r.text or "" for r in simhash.drop_near_duplicates(kept).collect()) == sorted(t or "" for d, t in ROWS if d != 3)
    assert simhash.near_duplicates(some).count() == len(ROWS)


def test_others(spark, some, tmp_path):
    assert mixing.mix(some, [3, 1, 2]).count() == len(ROWS)
    assert {r.text for r in mixing.mixture(some, [3, 1, 2]).collect()} <= {t for _, t in ROWS}
    bpe = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert byte_bpe.decode(byte_bpe.encode(some, bpe), bpe).count() == len(ROWS)
    assert token_counts.prefix_counts(some, public_tokenizers.path("byte_bpe_50k.json")).count() == len(ROWS)
    assert pii.personal_data_in(some).count() == secret_scan.secrets_in(some).count() == len(ROWS)
    files = token_files.tokenise_to_files(some, public_tokenizers.path("word_bpe_49k.json"), 2, f"file://{tmp_path}/ids").orderBy("start").collect()
    assert [r.doc_id for r in files] == [None, None, None, 1, 2, 3]
