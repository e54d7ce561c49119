"""Exact, near and line deduplication against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gleanery.llm import components, exact_dedup, line_dedup, near_dup

WS = re.compile("[\x20\x09-\x0d]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, keep_id string, k1 int").repartition(3)


def some_texts(seed, n, vocabulary=12, longest=30):
    pick = random.Random(seed)
    words = ["ab", "Cd", "é", "fg\t", "漢", "hi.", "jk", "lm", "no", "pq", "rs", "tu"][:vocabulary]
    made = []
    for _ in range(n):
        if made and pick.random() < 0.5:
            own = pick.choice(made).split(" ")
            for _ in range(pick.randint(0, 3)):
                own[pick.randrange(len(own))] = pick.choice(words)
            made.append(" ".join(own))
        else:
            made.append(" ".join(pick.choice(words) for _ in range(pick.randint(0, longest))))
    return made


@pytest.mark.parametrize("key_bits", [64, 3])
def test_exact(spark, key_bits):
    long = " ".join(some_texts(9, 900))
    texts = [*some_texts(1, 120), None, "", " ", "\n", long, long.replace(" ", "\r\n"), long + "x", long, "a b", "a  b"]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(700, "again"), (700, "again")]
    normal = [(i, WS.sub(" ", t or "")) for i, t in rows]
    want = []
    for i, t in normal:
        group = [j for j, u in normal if u == t]
        want.append((i, min(group), len(group), i == min(group), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(frame(spark, rows), key_bits).collect()]
    assert sorted(got) == sorted(want)


def test_chunks_make_up_the_text(spark):
    texts = ["", "x" * 9000, "é" * 5000, " ".join(some_texts(2, 400)), "a" * 255, "b" * 256, "c" * 4096, "d\n" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, chunks in df.select("t", F.regexp_extract_all("t", F.lit(exact_dedup.CHUNK), F.lit(0))).collect():
        assert "".join(chunks) == t and all(1 <= len(c) <= exact_dedup.MOST for c in chunks)
    same = " ".join(some_texts(3, 400))
    cut = [set(r[0]) for r in spark.createDataFrame([(same,), ("in front " + same,)], "t string").select(F.regexp_extract_all("t", F.lit(exact_dedup.CHUNK), F.lit(0))).collect()]
    assert len(cut[0] & cut[1]) > 0.5 * len(cut[0])


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    pick = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(500, j) for j in range(600, 640)] + [(pick.randrange(200, 300), pick.randrange(200, 300)) for _ in range(60)]
    pick.shuffle(links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {x for e in links for x in e}
    assert got == brute_components(nodes, links)
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_near(rows, width, percent):
    sets = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        own = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
        sets.append((i, own))
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and 100 * len(a & b) >= percent * len(a | b)]
    root = brute_components({i for i, _ in rows}, links)
    return sorted((i, len(s), root[i], root[i] == i) for i, s in sets)


@pytest.mark.parametrize("seed", [1, 2])
def test_near(spark, seed):
    pick = random.Random(seed)
    texts = some_texts(seed, 150, longest=60) + [None, "", " \n", "one", "ONE", "one two", "One  two", "É é x y z", "é é x y z"]
    base = ["w%d" % pick.randrange(50) for _ in range(60)]
    for _ in range(60):  # a large group on either side of the threshold
        own = base.copy()
        own[pick.randrange(60)] = "z%d" % pick.randrange(5)
        if pick.random() < 0.5:
            own[pick.randrange(60)] = "y%d" % pick.randrange(5)
        texts.append(" ".join(own))
    rows = list(zip(pick.sample(range(10_000), len(texts)), texts))
    rows += rows[:3]
    got = [tuple(r) for r in near_dup.near_duplicates(frame(spark, rows), width=4).collect()]
    assert sorted(got) == brute_near(rows, 4, 80)


def test_estimates_follow_the_similarity(spark):
    import numpy as np

    a, b = near_dup.permutations(near_dup.HASHES)
    pick = np.random.default_rng(1)
    rows = []
    for common in (0, 100, 200, 300, 400):
        every = pick.integers(0, 2**63, 800 - common, np.uint64)
        x, y = every[:400], np.concatenate([every[400 - common : 400], every[400:]])
        rows.append((common / (800 - common), *(near_dup.signature(near_dup.minima(near_dup.mixed(s), a, b), near_dup.BANDS, near_dup.BITS)[1].tolist() for s in (x, y))))
    df = spark.createDataFrame(rows, "real double, x array<long>, y array<long>")
    for real, estimated in df.select("real", near_dup.estimate(F.col("x"), F.col("y"))).collect():
        assert abs(real - estimated) < 0.16
    assert 0.5 < near_dup.least_estimate(0.8) < 0.65


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    pick = random.Random(edits)
    pairs = []
    for _ in range(300):
        a = "".join(pick.choice("abé") for _ in range(pick.randint(1, 12)))
        own = list(a)
        for _ in range(pick.randint(0, edits + 1)):
            at = pick.randrange(len(own) + 1)
            kind = pick.random()
            if kind < 0.4:
                own.insert(at, pick.choice("abé"))
            elif own and at < len(own):
                own[at : at + 1] = [] if kind < 0.7 else [pick.choice("abé")]
        pairs.append((a, "".join(own) or "a"))
    got = {tuple(r) for r in line_dedup.bit_parallel(spark.createDataFrame(pairs, "a string, b string"), "a", "b", edits).collect()}
    assert got == {(a, b) for a, b in pairs if distance(a, b) <= edits}


def brute_lines(rows, edits, least):
    firsts = {}
    split = [(i, (t or "").split("\n")) for i, t in rows]
    counted = lambda x: len(x) >= least and re.search("[^\x20\x09-\x0d]", x)
    for i, lines in split:
        for k, x in enumerate(lines):
            if counted(x):
                firsts[x] = min((i, k), firsts.get(x, (i, k)))
    out = []
    for i, lines in split:
        kept, exact, near = [], 0, 0
        for k, x in enumerate(lines):
            if counted(x) and (firsts[x][0] < i or x in lines[:k]):
                exact += 1
            elif counted(x) and any(firsts[y] < firsts[x] and y != x and distance(x, y) <= edits for y in firsts):
                near += 1
            else:
                kept.append(x)
        out.append((i, exact, near, "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("edits", [1, 2])
def test_lines(spark, edits):
    pick = random.Random(edits)
    pool = ["".join(pick.choice("abcdé ") for _ in range(pick.randint(3, 20))) for _ in range(30)]
    rows = [(1000, None), (1001, ""), (1002, "same line here\nsame line here\n\n\n")]
    for i in range(90):
        # a line may stand several times in a document, with or without a changed character
        lines = []
        for x in pick.choices(pool, k=pick.randint(0, 5)):
            own = list(x)
            if pick.random() < 0.5:
                own[pick.randrange(len(own))] = pick.choice("xyz")
            lines.append("".join(own))
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, pos int, removed_by string").repartition(3)
    got = line_dedup.deduplicate(docs, edits, 6).select("doc_id", "n_exact", "n_near", "cleaned")
    assert sorted(map(tuple, got.collect())) == brute_lines(rows, edits, 6)


def test_a_common_line_is_kept_once(spark):
    rows = [(i, f"The very same line, for all of them.\nAnd one of its own, number {i * 7919:08d}{'abcdefghij'[i % 10] * 5}") for i in range(200)]
    got = line_dedup.deduplicate(frame(spark, rows)).select("doc_id", "cleaned").collect()
    assert sum("very same" in r.cleaned for r in got) == 1 and len(got) == 200


def test_empty_tables(spark):
    none = frame(spark, []) if False else spark.createDataFrame([], "doc_id long, text string")
    for df in (exact_dedup.exact_duplicates(none), near_dup.near_duplicates(none), line_dedup.deduplicate(none)):
        assert df.collect() == []


def test_lines_that_differ_in_a_word(spark):
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdeé漢") for _ in range(pick.randint(2, 9)))
    least = lambda x, y: min(line_dedup.MOST_EDITS, min(len(x), len(y)) // line_dedup.CHARS_PER_EDIT)
    lines = []
    for n in [24, 26, 30, 31, 32, 33, 40, 47, 48, 50, 63, 64, 66, 79, 80, 96, 100, 111, 112, 120, 127, 128, 130, 140, 200, 255, 256, 260, 300, 511, 512, 520]:
        for _ in range(4):
            line = (" ".join(word() for _ in range(200)))[: n - 1] + "."
            lines.append(line)
            for edits in pick.sample(range(1, 11), 3):
                own, at = list(line), pick.randrange(n)
                for _ in range(edits):  # in one place or anywhere
                    k = min(at + pick.randrange(4), len(own) - 1) if edits % 2 else pick.randrange(len(own))
                    own[k : k + 1] = pick.choice([["x"], [], [own[k], "y"]])
                lines.append("".join(own))
    pick.shuffle(lines)
    rows = [(i, x) for i, x in enumerate(lines)]
    want = set()
    for i, x in rows:
        near = lambda y: 0 < abs(len(x) - len(y)) + (x != y) and abs(len(x) - len(y)) <= least(x, y) and distance(x, y) <= least(x, y)  # noqa: B023, E731
        if len(x) >= 24 and any(len(y) >= 24 and near(y) for y in lines[:i]):
            want.add(i)
    got = line_dedup.deduplicate(frame(spark, rows), min_chars=24).filter("n_near > 0").select("doc_id").collect()
    assert len(want) > 100 and {r.doc_id for r in got} == want


def test_copies_of_short_lines(spark):
    short = ["All rights reserved.", "And ornd.", "漢字の文です。", "x"]
    rows = [(i, "\n".join([*short, f"one of its own {i}"[-(i + 3) :], "", " "])) for i in range(4)] + [(9, "All rights reserved!\n\nx\nx")]
    got = {r.doc_id: (r.n_exact, r.n_near, r.cleaned) for r in line_dedup.deduplicate(frame(spark, rows)).collect()}
    assert got[0] == (0, 0, rows[0][1])
    assert all(got[i][:2] == (4, 0) and not set(short) & set(got[i][2].split("\n")) and got[i][2].endswith("\n\n ") for i in (1, 2, 3))
    assert got[9] == (2, 1, "")


def test_near_with_two_texts_of_one_id(spark):
    pick = random.Random(12)
    made = lambda: [f"w{pick.randrange(10_000)}" for _ in range(60)]
    rows, want = [], {}
    for i in range(0, 60, 3):
        one, other = made(), made()
        texts = [(i, one), (i, other), (i + 1, one[:-1] + ["x"]), (i + 2, other[:-1] + ["y"])]
        rows += [(j, " ".join(t)) for j, t in texts]
        want |= {j: [(i, j == i)] * (2 if j == i else 1) for j, _ in texts}
    got = near_dup.near_duplicates(frame(spark, rows), rows=True).collect()
    assert {j: sorted((r.component_id, r.kept) for r in got if r.doc_id == j) for j in want} == want
    sizes = {g: sum(r.group == g for r in got) for g in {r.group for r in got}}
    assert set(sizes.values()) == {2} and len(sizes) == 40


def test_few_keys_for_a_line(spark):
    pick = random.Random(5)
    lines = ["".join(pick.choice("abcdefghij klmno") for _ in range(n)) for n in (300, 400, 700, 1000) * 10]
    df = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines)], "id long, line string, size int")
    assert line_dedup.wide_keys(df).count() < 20 * len(lines)


def test_variants_under_a_key_come_once(spark):
    rows = [(7, i, True, 0, -1, 1, 20, 300 + i % 9, "x" * 20 + "y" * (280 + i % 9)) for i in range(50)]
    members = spark.createDataFrame([r[:8] for r in rows], "key long, id long, own boolean, i int, shorter int, start int, width int, size int")
    members = members.withColumn("at", F.struct(F.lit(False).alias("unknown"), F.col("id").alias("first")))
    lines = spark.createDataFrame([(r[1], r[8], r[7]) for r in rows], "id long, line string, size int")
    got = line_dedup.by_length(members, lines).collect()
    assert len(got) == 50 and all((r.before_n, r.behind_n) == (0, r.size - 20) for r in got)


def test_near_lines_that_repeat_themselves(spark):
    pick = random.Random(8)
    lines = []
    for n in (33, 70, 129, 200, 300):
        for unit in ("a", "ab", "-=-", "abcdefgh", "漢字"):
            base = list((unit * n)[:n])
            lines.append("".join(base))
            for edits in (1, 2, 5, 8, 9, 12):
                own = base.copy()
                for _ in range(edits):
                    k = pick.randrange(len(own))
                    own[k : k + 1] = pick.choice([["x"], [], [own[k], "y"]])
                lines.append("".join(own))
    lines = list(dict.fromkeys(lines))
    pick.shuffle(lines)
    least = lambda x, y: min(line_dedup.MOST_EDITS, min(len(x), len(y)) // line_dedup.CHARS_PER_EDIT)
    want = {i for i, x in enumerate(lines) if any(abs(len(x) - len(y)) <= least(x, y) and distance(x, y) <= least(x, y) for y in lines[:i])}
    got = line_dedup.deduplicate(frame(spark, list(enumerate(lines)))).filter("n_near > 0").select("doc_id").collect()
    assert len(want) > 50 and {r.doc_id for r in got} == want
