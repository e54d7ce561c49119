"""The pipeline against its parts done plainly in Python."""

import random

import pytest

import corpus_pipeline
from gleanery.llm import language_id, line_dedup, packing, quality
from gleanery.llm.vocabulary import loaded, read_spec

PARTS = {"aa": "the of ing tion er and th", "bb": "der ung sch ein ich und zu"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    pick = random.Random(8)
    sentence = lambda lang: " ".join("".join(pick.choices(PARTS[lang].split(), k=pick.randint(1, 3))) for _ in range(12)).capitalize() + "."
    rows = []
    for i in range(120):
        lang = pick.choice(list(PARTS))
        lines = [sentence(lang) for _ in range(pick.randint(5, 9))]
        rows.append([i, "\n".join(lines), lang, f"src{i % 3}", 0, "x"])
    rows[40][1] = rows[3][1]  # an exact copy
    near = rows[7][1].split(" ")
    rows[60][1] = " ".join([*near[:20], "changed", *near[20:]])  # a near copy
    rows[70][1] = "\n".join([rows[7][1].split("\n")[0], rows[70][1]])  # a repeated line
    rows[80][1] = "123 456 7890. " * 5 + "9 8 7 6. " * 20  # of no language, and repetitive
    rows[90][1] = "Home | About | News | More\n" * 3 + "too short."
    rows += [[200, None, "aa", "s", 0, "x"], [201, "", None, "s", 0, "x"], [202, sentence("aa") + "\n" + "\n".join(sentence("aa") for _ in range(6)), None, None, None, None]]
    folder = tmp_path_factory.mktemp("corpus")
    schema = "doc_id long, text string, lang string, source string, n_chars long, cleaned string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    given = texts(docs)

    one = corpus_pipeline.quality_rules(spark, docs, corpus)
    assert one.columns == columns
    measured = {i: quality.measures(t or "") for i, t in given.items()}
    assert texts(one) == {i: m["cleaned"] for i, m in measured.items() if m["kept"]}
    assert {80, 90, 200, 201}.isdisjoint(texts(one)) and len(texts(one)) > 110
    assert all(r.n_chars == len(r.text) for r in one.collect())

    two = corpus_pipeline.language(spark, one, corpus)
    filters = language_id.train(one)
    good = {i: t for i, t in texts(one).items() if (p := filters.predict(t))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE}
    assert two.columns == columns and texts(two) == good and 202 in good
    assert {r.doc_id: r.lang for r in two.collect()}[202] == "aa"

    three = corpus_pipeline.lines(spark, two, corpus)
    seen, left = set(), {}
    for i, t in sorted(texts(two).items()):
        kept = [x for x in t.split("\n") if len(x) < line_dedup.MIN_CHARS or x not in seen]
        seen.update(t.split("\n"))
        if any(x.strip() for x in kept):
            left[i] = "\n".join(kept)
    assert three.columns == columns and texts(three) == left and 40 not in left

    four = corpus_pipeline.near_duplicates(spark, three, corpus)
    assert four.columns == columns and texts(four).items() <= left.items()
    again = corpus_pipeline.near_duplicates(spark, two, corpus)
    assert 40 not in texts(again) and 60 not in texts(again) and 7 in texts(again)

    last = corpus_pipeline.packed(spark, four, corpus).collect()
    want = sum(len(loaded(read_spec()).encode(t)) + 1 for t in texts(four).values())
    assert sum(r.length for r in last) == want
    assert len({r.sequence_id for r in last}) <= -(-want // packing.CAPACITY) + 1


def test_run_is_its_stages(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus).collect()
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    strip = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert strip(rows) == strip(docs.collect())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_and_repeated_ids_in_near_dedup(spark):
    pick = random.Random(3)
    made = lambda: " ".join(f"w{pick.randrange(10_000)}" for _ in range(60))
    a, b, c, d, e = (made() for _ in range(5))
    rows = [(1, a), (1, a), (1, a + " end"), (1, b), (2, b + " end"), (3, c), (3, c)]
    rows += [(None, d), (None, d), (None, e), (None, c), (4, None), (4, None), (None, ""), (5, d + " x y z " + made())]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, _row string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    firsts = [x for x in found if x in ((1, a), (1, a + " end"))]
    assert len(firsts) == 1
    want = [*firsts, (1, b), (3, c), (None, d), (None, e), (4, None), (None, ""), rows[-1]]
    assert sorted(found, key=str) == sorted(want, key=str)
    once = spark.createDataFrame([(None, d), (7, e)], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, once, "").count() == 2
