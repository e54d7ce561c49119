"""Expressions, ranking and the engine from end to end."""

import io
import json

import pytest
from pyspark.sql import functions as F

from gleanery import cli
from gleanery.engine import Engine
from gleanery.functions import display, intent, text
from gleanery.operators import bm25, knn, lookup, ranking
from gleanery.sources.store import Store, upserted
from gleanery.streaming.requests import serve_stream

FILES = {
    "internal/auth/service.go": "package auth\n\ntype AuthService struct{}\n\nfunc (s *AuthService) Login(user string) error {\n\treturn nil // authentication login token\n}\n\nfunc Logout() {}\n",
    "cmd/main.go": "package main\n\nfunc main() {\n\t// auth flow of the login\n}\n",
    "test/skip.go": "package t\nfunc Skipped() {}\n",
    "web/app.ts": "export class Router {\n  open(path: string): void { }\n}\n",
    "lib/store.py": "class Store:\n    def get(self, key):\n        return key\n",
    "node_modules/x/y.js": "function hidden() {}\n",
    "bad.py": b"\xff\xfe\x00def x(): pass",
    "notes.md": "# nothing",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, content in FILES.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, repo, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index") / "store"))
    assert e.index_repository(repo).collect() == []
    return e


def test_index_and_again(engine, repo):
    names = lambda: sorted(r.symbol_id for r in engine.store.read("symbols").collect())
    expected = sorted(["struct:internal/auth:AuthService", "method:internal/auth:AuthService.Login", "func:internal/auth:Logout", "func:cmd:main", "class:web:Router", "method:web:Router.open", "class:lib:Store", "method:lib:Store.get"])
    assert names() == expected
    engine.index_repository(repo)
    assert names() == expected and engine.store.read("embeddings").count() == 8


def test_include_tests(spark, repo, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.set_include_tests(True)
    e.index_repository(repo)
    assert "func:test:Skipped" in {r.symbol_id for r in e.store.read("symbols").collect()}


def test_search(engine):
    exact = engine.search("AuthService.Login").collect()
    assert [(r.symbol_id, r.score, r.reasons) for r in exact] == [("method:internal/auth:AuthService.Login", 1.0, ["Exact symbol match"])]
    flow = engine.search("auth flow").orderBy(*ranking.result_order()).collect()
    assert flow and flow[0].file_path == "internal/auth/service.go" and all(0.15 <= r.score <= 1 for r in flow)
    assert engine.flow("auth flow").count() == 1
    assert engine.search("").collect() is not None


def test_batches_equal_single_queries(engine, spark):
    queries = ["auth flow", "Router", "define the store", "nothing at all here"]
    batch = engine.search(spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")).collect()
    strip = lambda rows: sorted((r.symbol_id, round(r.score, 6), tuple(r.reasons)) for r in rows)
    for i, q in enumerate(queries):
        assert strip(r for r in batch if r.query_id == i) == strip(engine.search(q).collect())


def test_resolve_and_related(engine):
    found = engine.resolve_symbol("Login").collect()
    assert [(r.symbol_id, r.score, r.reasons) for r in found] == [("method:internal/auth:AuthService.Login", 1.0, ["Exact symbol lookup"])]
    assert [r.symbol_id for r in engine.resolve_symbol("class:lib:Store").collect()][0] == "class:lib:Store"
    near = engine.find_related("lib/store.py", 2).collect()
    assert near and all(r.reasons == ["Embedding similarity"] and not (r.file_path == "lib/store.py" and r.start_line <= 2 <= r.end_line) for r in near)
    assert engine.find_related("lib/store.py", 99).collect() == []


def test_serve_and_stream(engine, spark, tmp_path):
    lines = ['{"method":"search","params":{"query":"AuthService.Login"}}', "", "   ", "{bad", '{"method":"search","params":{}}', '{"method":"find_related","params":{"file":"a"}}', '{"method":"resolve_symbol"}', '{"method":"x"}', '{"method":"find_related","params":{"file":"lib/store.py","line":2}}']
    got = [json.loads(r.response) for r in engine.serve(spark.createDataFrame(list(enumerate(lines)), "request_id long, value string")).orderBy("request_id").collect()]
    assert got[0][0]["symbol_id"] == "method:internal/auth:AuthService.Login"
    assert [g["error"] for g in got[1:6]] == ["Invalid JSON", "Missing query parameter", "Missing file or line parameter", "Missing name parameter", "Unknown method"]
    assert isinstance(got[6], list) and got[6]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(lines))
    serve_stream(spark, engine, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.text(str(tmp_path / "out/*")).count() == 7


def test_cli(spark, repo, tmp_path):
    out = io.StringIO()
    base = ["-s", str(tmp_path / "s")]
    assert cli.run(spark, [*base, "index", repo], out) == 0
    assert cli.run(spark, [*base, "search", "AuthService.Login"], out) == 0
    assert cli.run(spark, [*base, "related", "lib/store.py:2"], out) == 0
    assert cli.run(spark, [*base, "related", "nocolon"], out) == 1
    assert cli.run(spark, [*base, "resolve", "qqqq"], out) == 0
    shown = out.getvalue()
    assert "Indexed 8 symbols." in shown and cli.EMPTY in shown
    assert "METHOD\n  AuthService.Login\n\n  Confidence: High (100%)\n\n  Why:\n  - Exact symbol match\n\n  Symbol:\n" in shown


def test_request_loop_and_hand_off(spark, engine, repo, tmp_path):
    base, out, told = ["-s", engine.store.path], io.StringIO(), tmp_path / "told"
    lines = ['{"method":"search","params":{"query":"AuthService.Login"}}\n', "\n", "{bad\n"]
    assert cli.run(spark, [*base, "serve", "-"], out, lines) == 0
    first, second = map(json.loads, out.getvalue().splitlines())
    assert first[0]["symbol_id"] == "method:internal/auth:AuthService.Login" and second == {"error": "Invalid JSON"}
    assert cli.run(spark, [*base, "flow", "AuthService.Login", "--to", f"sh -c 'echo $0 > {told}'"], out) == 0
    assert told.read_text().strip() == "method:internal/auth:AuthService.Login"
    assert cli.run(spark, ["-s", str(tmp_path / "i"), "init", repo, "--also", "test -d"], out) == 0


def test_results_come_in_order(engine, spark):
    queries = spark.createDataFrame([(0, "auth flow"), (1, "define the store")], "query_id long, query string")
    got = [(r.query_id, -r.score, r.symbol_id) for r in engine.search(queries).collect()]
    assert got and got == sorted(got)


def test_a_version_that_is_not_pointed_to_does_not_count(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<float>")
    s.write("embeddings", one)
    before = s.current("embeddings")
    # a write that ended before its pointer was replaced
    one.write.parquet(f"{s.path}/embeddings/unfinished")
    assert s.current("embeddings") == before and s.read("embeddings").count() == 1
    s.write("embeddings", s.read("embeddings").union(one.selectExpr("'b'", "embedding")))
    assert sorted(r.chunk_id for r in s.read("embeddings").collect()) == ["a", "b"]
    s.export_embeddings_json(str(tmp_path / "json"))
    other = Store(spark, str(tmp_path / "other"))
    other.import_embeddings_json(str(tmp_path / "json"), lines=True)
    assert sorted(map(tuple, other.read("embeddings").collect())) == [("a", [1.0]), ("b", [1.0])]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.read("chunks").count() == 0
    e = lambda *rows: spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    s.upsert_embeddings(e(("a", [1.0]), ("b", [2.0])))
    s.upsert_embeddings(e(("b", [3.0]), ("c", [4.0])))
    assert sorted((r.chunk_id, r.embedding[0]) for r in s.read("embeddings").collect()) == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
    (tmp_path / "e.json").write_text('[{"chunk":{"id":"a"},"embedding":[9.0]}]')
    s.import_embeddings_json(str(tmp_path / "e.json"))
    assert {r.chunk_id: r.embedding[0] for r in s.read("embeddings").collect()}["a"] == 9.0
    s.clear()
    assert s.read("embeddings").count() == 0
    assert upserted(e(("a", [1.0])), e()).count() == 1


def values(spark, column, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_classifier(spark):
    cases = {
        "": "Semantic", "   ": "Semantic", "foo": "Symbol", "a::b": "Symbol", "flow": "Symbol", "login flow": "Flow", "xpath of it": "Flow", "the sequence architecture": "Flow",
        "module layout": "Architecture", "define it": "Definition", "implementation of a": "Definition", "what a.b is": "Definition", "How does it": "Definition", "snake_case it": "Definition", "plain old prose": "Semantic",
    }
    assert values(spark, intent.classify, list(cases)) == list(cases.values())


def test_expansion(spark):
    got = values(spark, intent.expand, ["auth db", "my db", "an endpoint", "cache", "setting", "other"])
    assert got[0].startswith("auth db login") and got[1].startswith("my db repository") and got[2].startswith("an endpoint controller")
    assert got[3].endswith("local") and got[4].endswith("registry") and got[5] == "other"
    flow = lambda q: intent.search_text(q, intent.classify(q))
    assert values(spark, flow, ["auth of it", "auth flow"])[0] == "auth of it"


def test_display(spark):
    df = spark.createDataFrame([("file:a/b.go", "x/y.go"), ("k:m:n", "x/y.go"), ("k:n", "x/y.go"), ("bare", "x/y.go")], "s string, f string")
    kind, name = display.split_symbol_id(F.col("s"), F.col("f"))
    assert [tuple(r) for r in df.select(kind, name).collect()] == [("file", "b.go"), ("k", "n"), ("k", "n"), ("symbol", "y.go")]
    s = spark.createDataFrame([(x,) for x in (0.85, 0.851, 0.5, 0.51, 2.0, 0.865)], "s float").select(display.confidence(F.col("s")), display.shown_percent(F.col("s"))).collect()
    assert [r[0] for r in s] == ["Medium", "High", "Low", "Medium", "High", "High"] and s[4][1] == 100
    parsed = spark.createDataFrame([("a:b:12",), ("a",), ("a:x",)], "l string").select(*display.parse_location(F.col("l"))).collect()
    assert [tuple(r) for r in parsed] == [("a:b", 12, None), (None, None, "Missing file path"), (None, None, "Invalid line number")]


def test_module_path(spark):
    assert values(spark, text.module_path, ["a/b/c.go", "c.go", "./c.go", "a\\b\\c.py"]) == ["a/b", "crate", "crate", "a/b"]
    assert values(spark, lambda c: text.module_path(c, "::"), ["a/b/c.rs", "c.rs"]) == ["a::b", "crate"]


def test_terms(spark):
    got = values(spark, text.terms, ["Hello, wörld_42 x.y", "a" * 39 + " " + "b" * 40 + " " + "é" * 20, ""])
    assert got == [["hello", "wörld", "42", "x", "y"], ["a" * 39], []]


def ranked(spark, lexical, semantic, query="auth flow", kind="Flow", tests=False):
    chunk = {
        "A": ("internal/auth/service.go", 1, 9, ["method:internal/auth:AuthService.Login"]),
        "B": ("cmd/main.go", 1, 3, ["func:cmd:main"]),
        "C": ("internal/auth/service.go", 20, 30, ["struct:internal/auth:Config"]),
        "D": ("internal/auth/login_test.go", 1, 5, ["func:internal/auth:login"]),
        "E": ("lib/x.go", 1, 5, []),
    }
    schema = "query_id long, query string, intent string, id string, file_path string, start_line int, end_line int, symbols_defined array<string>, rank0 int"
    side = lambda ids: spark.createDataFrame([(0, query, kind, i, *chunk[i], n) for n, i in enumerate(ids)], schema)
    return {r.symbol_id: r for r in ranking.rank(side(lexical), side(semantic), tests).collect()}


def test_golden_ranking(spark):
    got = ranked(spark, "ABC", "CAD")
    assert list(got) == ["method:internal/auth:AuthService.Login"]
    best = got["method:internal/auth:AuthService.Login"]
    assert best.score == 1.0 and best.reasons == ["Lexical match", "Semantic match", "Identifier match boost", "Concept match boost", "Intent-based service/handler boost", "File coherence boost"]
    # a test file: 0.8 / 60 * 0.1 * 2 * 1.3 * 30 is below the floor, and no such rule holds for another file
    assert ranked(spark, "D", "", "login here", "Definition", True) == {}
    plain = ranked(spark, "B", "", "main here", "Definition", True)["func:cmd:main"]
    assert plain.reasons == ["Lexical match", "Definition boost", "Identifier match boost"] and abs(plain.score - 1) < 1e-6


def test_floor_by_rank(spark):
    """Lexical-only rows of a Flow query survive up to the twentieth place."""
    schema = "query_id long, query string, intent string, id string, file_path string, start_line int, end_line int, symbols_defined array<string>, rank0 int"
    lexical = spark.createDataFrame([(0, "a flow", "Flow", f"c{i}", f"p{i}.go", 1, 2, ["func:m:zz"], i) for i in range(50)], schema)
    none = spark.createDataFrame([], schema)
    assert ranking.rank(lexical, none).count() == 20
    assert ranking.rank(none, lexical).count() == 50
    twice = spark.createDataFrame([(0, "a flow", "Flow", "same", f"p{i}.go", 1, 2, [], i) for i in range(2)], schema)
    one = ranking.rank(twice, none).collect()
    assert len(one) == 1 and one[0].file_path == "p0.go" and one[0].symbol_id == "file:p0.go" and abs(one[0].score - (0.4 / 60 + 0.4 / 61) * 30) < 1e-6


def test_vectors(spark):
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0]), ("d", [0.0, 1.0, 0.0]), ("e", None), ("f", [-1.0, 0.0])], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 0.0])], "query_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank0, r.chunk_id, r.score) for r in knn.vector_search(q, e, 3).collect())
    assert got == [(0, 0, "a", 1.0), (0, 1, "b", 1.0), (0, 2, "c", 0.0), (1, 0, "a", 0.0), (1, 1, "b", 0.0), (1, 2, "c", 0.0)]
    assert knn.vector_search(q.limit(0), e, 3).collect() == []


def test_locate_prefers_the_innermost(spark):
    schema = "id string, file_path string, start_line int, end_line int, raw_content string, symbols_defined array<string>"
    chunks = spark.createDataFrame([("out", "f", 1, 1000, "", []), ("in", "f", 300, 320, "", []), ("other", "g", 1, 9, "", [])], schema)
    asked = spark.createDataFrame([(1, "f", 310), (2, "f", 5), (3, "f", 2000), (4, "g", 9)], "query_id long, file string, line long")
    assert {r.query_id: r.id for r in lookup.locate(asked, chunks).collect()} == {1: "in", 2: "out", 4: "other"}


def test_plans(spark):
    """The top-k is cut before the shuffle, and the path filter stays above the rank."""
    schema = "id string, file_path string, start_line int, end_line int, raw_content string, symbols_defined array<string>"
    chunks = spark.createDataFrame([("a", "vendor/f.go", 1, 2, "some text", ["func:m:some"])], schema)
    p = bm25.chunk_postings(chunks)
    q = spark.createDataFrame([(0, "some text")], "query_id long, query string")
    found = bm25.search_chunks(q, chunks, p, bm25.field_stats(chunks, p))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    filtered = found.filter(~F.contains("file_path", F.lit("vendor")))._jdf.queryExecution().optimizedPlan().toString()
    assert filtered.index("vendor") < filtered.index("Window")


def test_all_errors_are_returned(spark, repo, tmp_path, monkeypatch):
    from gleanery.sources import repository

    rows = spark.range(1500).selectExpr("concat('f', id, '.py') AS path", "'ValueError: x' AS error")
    made = rows.selectExpr("path", *(f"cast(null AS {c.split()[1]}) AS {c.split()[0]}" for c in repository.DEFINITIONS.split(", ")[1:-1]), "error")
    monkeypatch.setattr(repository, "definitions", lambda files: made)
    e = Engine(spark, str(tmp_path / "s"))
    got = e.index_repository(repo)
    assert got.columns == ["path", "error"] and got.select("path").distinct().count() == got.count() == 1500
    e.clear()
    assert e.store.read("errors").count() == 0
