"""BPE, token files and packing against the tokenizers library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from gleanery.llm import bpe_trie, packing, token_files
from gleanery.llm.vocabulary import default_path, loaded, read_spec

ALPHABET = "abcdé ß\n\t'sdmtrevl1२9_-%$漢字😀́  \r"


def texts(n, seed=1):
    pick = random.Random(seed)
    extra = ["", "", "<|endoftext|>", "x" * 300, "ab" * 200, " " * 70, "the the The"]
    return ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, 60))) + pick.choice(extra) for _ in range(n)]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [Row(doc_id=i, text=t, ids="clash", start=1.5) for i, t in enumerate(texts(300))]
    rows += [Row(doc_id=900, text=None, ids=None, start=None), Row(doc_id=901, text="long words " * 40000, ids="", start=0.0)]
    rows += [Row(doc_id=5, text="again", ids="", start=0.0)] * 2
    return spark.createDataFrame(rows).repartition(5)


@pytest.fixture(scope="module")
def expected(docs, library):
    return [(r.doc_id, r.text or "", library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.select("doc_id", "text").collect()]


def test_encoders_equal_the_library(library):
    some = texts(3000, 2)
    want = [packed(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert bpe_trie.encoder(read_spec()).encode_batch(some) == want
    assert [packed(loaded(read_spec()).encode(t)) for t in some] == want


def test_trie_survives_resets(library, monkeypatch):
    monkeypatch.setattr(bpe_trie, "MAX_NODES", 50)
    some, e = texts(500, 3), bpe_trie.TrieEncoder(loaded(read_spec()))
    got = [x for i in range(0, 500, 20) for x in e.encode_batch(some[i : i + 20])]
    assert got == [packed(x.ids) for x in library.encode_batch(some, add_special_tokens=False)]


def test_bpe_query(docs, expected, library):
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i, len(ids), hexed(packed(ids)), hexed(library.decode(ids, skip_special_tokens=False).encode())) for i, _, ids in expected)
    assert sorted(map(tuple, bpe_trie.digests(docs).collect())) == want
    back = bpe_trie.decode(bpe_trie.encode(docs))
    assert sorted(map(tuple, back.collect())) == sorted((i, t) for i, t, _ in expected)


def test_token_files(docs, expected):
    want, start = [], 0
    for i, crc, n in sorted((i, zlib.crc32(packed([*ids, 2])), len(ids) + 1) for i, _, ids in expected):
        want.append((i, n, crc))
        start += n
    got = sorted(map(tuple, token_files.round_trip(docs).collect()), key=lambda r: (r[1], r[0]))
    assert sorted((i, n, c) for i, _, n, c in got) == sorted(want)
    assert [r[0] for r in got] == sorted(r[0] for r in got)
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got])[:-1])


def test_segments_decode_alone_and_damage_shows():
    pick = np.random.default_rng(4)
    ids = np.minimum(pick.zipf(1.3, 300_000), 50_000).astype(np.uint32)
    t = token_files.Tables(token_files.quantised(np.bincount(ids, minlength=50_257)))
    block = token_files.encode_block(np.array([7]), np.array([len(ids)]), ids, t)
    _, _, n, body = token_files.open_block(block, t)
    k, points, _ = token_files.segments(body)
    assert len(points) > 2
    assert (token_files.decode_segment(body, n, 2, t) == ids[points[2][0] * k : points[3][0] * k if len(points) > 3 else n]).all()
    assert (token_files.decode_block(block, t)[2] == ids).all()
    for at in (3, 40, len(block) - 1):
        with pytest.raises(ValueError):
            token_files.decode_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :], t)


@pytest.mark.parametrize("sizes", [[], [1], [5, 5, 3], list(range(1, 300))])
def test_rans_round_trip_of_small_blocks(sizes):
    for n in sizes:
        ids = np.arange(n, dtype=np.uint32) % 7
        t = token_files.Tables(token_files.quantised(np.bincount(ids, minlength=9)))
        assert (token_files.decode_block(token_files.encode_block(np.array([1]), np.array([n]), ids, t), t)[2] == ids).all()


def check_packing(rows, expected, capacity=packing.CAPACITY):
    at, by_sequence = {}, {}
    for r in rows:
        at.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
    want = []
    for i, _, ids in expected:
        ids = [*ids, 0]
        want += [(i, k, s, n, zlib.crc32(packed(ids[s : s + n]))) for k, (s, n) in enumerate(packing.cut(len(ids), capacity))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    return len(by_sequence), sum(w[3] for w in want)


def test_packing(docs, expected):
    used, total = check_packing(packing.pack(docs).collect(), expected)
    assert used <= -(-total // packing.CAPACITY) + 1
    rows = packing.sequences(packing.pack(docs, with_ids=True)).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows) and sum(r.n_tokens for r in rows) == total


def test_packing_of_common_lengths_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_A_GROUP", 7)
    rows = [(i, "word " * (i % 3)) for i in range(200)] + [(500, "a b c " * 4000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = [(i, t, loaded(read_spec()).encode(t).tolist()) for i, t in rows]
    used, total = check_packing(got, expected)
    assert used <= -(-total // packing.CAPACITY) + 1


def test_cut():
    assert packing.cut(5, 5) == [(0, 5)]
    assert packing.cut(4, 5) == [(0, 4)]
    assert packing.cut(12, 5) == [(0, 2), (2, 5), (7, 5)]
    assert packing.cut(10, 5) == [(0, 5), (5, 5)]


def test_plan_takes_all_and_is_near_the_best():
    pick = np.random.default_rng(5)
    for size in (1, 10, 1000, 100_000):
        lengths = np.minimum(pick.lognormal(5, 1.5, size).astype(int) + 1, 2048)
        counts = np.bincount(lengths, minlength=2049)
        bins, seen = packing.plan(counts), np.zeros(2049, int)
        for times, own in bins:
            assert sum(own) <= 2048 and times > 0
            np.add.at(seen, own, times)
        assert (seen == counts).all()
        least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
        assert sum(t for t, _ in bins) <= least * 1.02 + 1
    assert len(packing.plan(np.full(2049, 10**9) * (np.arange(2049) > 0))) < 20_000


def test_two_replace_the_smallest():
    # 60 + 30 leaves 10; 21 + 19 instead of the 30 fill the bin
    counts = np.bincount([60, 30, 21, 19], minlength=101)
    assert packing.plan(counts)[0] == (1, [60, 21, 19])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for df in (bpe_trie.digests(none), token_files.round_trip(none), packing.pack(none)):
        assert df.collect() == []
