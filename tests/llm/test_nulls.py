"""Nulls in any column, repeated rows and clashing names: each operator returns a row for each row, and doesn't crash."""

import pytest

from gleanery.llm import bpe_trie, exact_dedup, language_id, licenses, line_dedup, near_dup, packing, quality, token_files

TEXT = "one line of some words, which is long enough to count.\nanother line of other words, long enough as well."
ROWS = [(None, TEXT, None), (1, TEXT, "en"), (1, TEXT, "en"), (2, None, None), (None, None, "en"), (3, "", None), (3, "other", "de"), (4, "Released under the MIT License.", None)]
CLASHES = ["keep_id", "kept", "ids", "digest", "bands", "k1", "line", "pos", "removed", "_id", "_row", "_given", "_text", "key", "part", "start", "length", "sequence_id", "score", "held_out", "component_id", "_salt", "recipe"]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *[None] * len(CLASHES)) for r in ROWS], schema)


def test_exact(docs):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(ROWS) and all(r.kept is not None for r in got)
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id == 1} == {(1, 3)}


def test_near(docs):
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) and all(r.kept is not None for r in got)
    assert {r.component_id for r in got if r.doc_id == 1} == {1}


def test_tokens(docs):
    assert bpe_trie.digests(docs).count() == len(ROWS)
    files = token_files.round_trip(docs).collect()
    assert sum(r.doc_id is None for r in files) == 2 and len(files) == len(ROWS)
    assert sum(r.length for r in packing.pack(docs).collect()) == sum(r.n_tokens for r in files)


def test_text(docs):
    assert quality.assess(docs, with_text=True, carry=True).count() == len(ROWS)
    got = language_id.identify(docs, language_id.train(docs), carry=True).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (2,)} == {"und"}
    assert {r.license for r in licenses.scan(docs).collect()} == {"mit-line"}


def test_lines(docs):
    got = line_dedup.deduplicate(docs)
    assert got.count() == len(ROWS) and set(docs.columns) <= {*got.columns, "removed"}
    assert {r.cleaned for r in got.collect() if r.doc_id == 1} == {TEXT}
