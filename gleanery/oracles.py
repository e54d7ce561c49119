"""DuckDB SQL for the queries of the catalog, written on its own and not from the Spark code.

The long ones are chains of common table expressions; a query takes the chain
up to its step.
"""

from __future__ import annotations

SEARCHES = [
    "auth flow of the login", "the architecture of thing and ting", "on the of and in", "define the handler in en",
    "where is AuthService the", "main", "nothingsuchword", "cache of database module",
]
PARTS = ["small ring", "red", "Widget bolt", "blue.bolt", "economy:Brand#17:red.widget", "nothing"]


def values(rows: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in enumerate(rows)) + ") q(query_id, query)"


def has(text: str, words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words.split()) + ")"


def terms(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND strlen(x) < 40)"


def intent(q: str) -> str:
    return f"""CASE WHEN trim({q}) = '' THEN 'Semantic' WHEN NOT regexp_matches(trim({q}), '\\s') THEN 'Symbol'
  WHEN {has(f'lower({q})', 'flow lifecycle path sequence')} THEN 'Flow'
  WHEN {has(f'lower({q})', 'architecture module crate relationship dependency')} THEN 'Architecture'
  WHEN {has(f'lower({q})', 'define definition implement signature')} THEN 'Definition'
  WHEN regexp_matches({q}, '::|[._A-Z]') THEN 'Definition' ELSE 'Semantic' END"""


def expand(q: str) -> str:
    low = f"lower({q})"
    return f"""CASE WHEN {has(low, 'auth authentication')} THEN {q} || ' login jwt token middleware authorize verify access session identity permission oauth'
  WHEN {has(low, 'database db')} THEN {q} || ' repository gorm sql transaction query storage client connection migration schema'
  WHEN {has(low, 'api endpoint')} THEN {q} || ' controller handler route request response gateway payload'
  WHEN {has(low, 'cache')} THEN {q} || ' redis memcached ttl evict storage buffer local'
  WHEN {has(low, 'config setting')} THEN {q} || ' environment variable yaml json property flag registry' ELSE {q} END"""


def search_text(q: str) -> str:
    return f"CASE WHEN ({intent(q)}) IN ('Flow', 'Architecture') THEN {expand(q)} ELSE {q} END"


DOCS = """docs AS (SELECT doc_id, text, doc_id // 6 AS f,
  ['internal/auth', 'vendor/lib', 'cmd', 'pkg/generated', 'src/testdata', 'lib/mock', 'dist/app', 'web', 'core/examples', 'api', 'node_modules/x'][(doc_id // 6) % 11 + 1] AS folder,
  ['AuthService.login', 'main', 'UserHandler', 'store.get', 'config', 'apiRouter.add', 'helper', 'TokenCache.put'][doc_id % 8 + 1] AS name,
  ['method', 'func', 'struct', 'method', 'func', 'method', 'func', 'method'][doc_id % 8 + 1] AS kind FROM documents WHERE text IS NOT NULL),
chunks AS (SELECT doc_id, sha256(text) AS id, folder || '/' || f || ['.go', '_test.go', '.py'][f % 3 + 1] AS file_path, (doc_id % 6 * 100 + 1)::INT AS start_line,
  (doc_id % 6 * 100 + len(string_split(text, chr(10))))::INT AS end_line, text, kind || ':' || folder || ':' || name AS symbol_id, name FROM docs)"""

POSTINGS = f"""fields AS (SELECT doc_id, 'content' AS field, {terms('text')} AS ts FROM chunks UNION ALL SELECT doc_id, 'symbols', {terms('symbol_id')} FROM chunks),
postings AS (SELECT field, doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT field, doc_id, len(ts) AS dl, unnest(ts) AS term FROM fields) GROUP BY field, doc_id, term),
stats AS (SELECT field, sum(tf) / (SELECT count(*) FROM chunks) AS avgdl, (SELECT count(*) FROM chunks) AS n FROM postings GROUP BY field),
dfs AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term)"""


def lexical(asked: str) -> str:
    """lex(query_id, score, rank0, chunk columns) of a relation q(query_id, query)."""
    return f"""qt AS (SELECT DISTINCT query_id, unnest({terms('query')}) AS term FROM {asked}),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM qt JOIN postings USING (term) JOIN dfs USING (field, term) JOIN stats USING (field) GROUP BY query_id, doc_id),
lex AS (SELECT * FROM (SELECT bm.query_id, score, c.*, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, file_path, start_line, end_line) - 1)::INT AS rank0
  FROM bm JOIN chunks c USING (doc_id)) WHERE rank0 < 50)"""


VECTORS = """vecs AS (SELECT id, arg_min(embedding::DOUBLE[], doc_id) AS e FROM chunks JOIN embeddings ON doc_id = vec_id GROUP BY id),
firsts AS (SELECT id, min({'p': file_path, 's': start_line, 'e': end_line, 'y': symbol_id}) AS c FROM chunks GROUP BY id)"""

SEMANTIC = f"""{VECTORS},
sem AS (SELECT query_id, id, c.p AS file_path, c.s AS start_line, c.e AS end_line, c.y AS symbol_id, rank0 FROM (
  SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) - 1)::INT AS rank0 FROM (
    SELECT v.vec_id // 50 AS query_id, vecs.id, round(list_cosine_similarity(v.embedding::DOUBLE[], vecs.e), 9) AS s
    FROM embeddings v, vecs WHERE v.vec_id % 50 = 0 AND v.vec_id < {50 * len(SEARCHES)})) JOIN firsts USING (id) WHERE rank0 < 50)"""

ASKED = f"""asked AS (SELECT query_id, query, {intent('query')} AS intent FROM {values(SEARCHES)}),
texts AS (SELECT query_id, {search_text('query')} AS query FROM asked)"""

WEIGHTS = "CASE intent WHEN 'Symbol' THEN [0.95, 0.05] WHEN 'Definition' THEN [0.8, 0.2] WHEN 'Flow' THEN [0.4, 0.6] WHEN 'Architecture' THEN [0.3, 0.7] ELSE [0.1, 0.9] END"

FUSED = f"""parts AS (SELECT query_id, id, file_path, start_line, end_line, symbol_id, rank0, 0 AS side FROM lex
  UNION ALL SELECT query_id, id, file_path, start_line, end_line, symbol_id, rank0, 1 FROM sem),
fused AS (SELECT query_id, id, sum((({WEIGHTS})[side + 1]::FLOAT / (60 + rank0)::FLOAT)::FLOAT)::FLOAT AS score,
  arg_min({{'p': file_path, 's': start_line, 'e': end_line, 'y': symbol_id}}, side * 1000 + rank0) AS c, any_value(query) AS query, any_value(intent) AS intent,
  concat_ws('; ', CASE WHEN bool_or(side = 0) THEN 'Lexical match' END, CASE WHEN bool_or(side = 1) THEN 'Semantic match' END) AS reasons
  FROM parts JOIN asked USING (query_id) GROUP BY query_id, id),
s0 AS (SELECT query_id, id, score, c.p AS file_path, c.s AS start_line, c.e AS end_line, c.y AS symbol_id, query, intent, reasons,
  lower(split_part(c.y, ':', -1)) AS tail, lower(c.p) AS path,
  list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '') AS tokens, intent IN ('Semantic', 'Flow', 'Architecture') AS concept FROM fused)"""


def times(before: str, after: str, hit: str, factor: str, reason: str) -> str:
    return f"""{after} AS (SELECT * REPLACE (CASE WHEN {hit} THEN score * ({factor})::FLOAT ELSE score END AS score,
  CASE WHEN {hit} THEN reasons || '; ' || {reason} ELSE reasons END AS reasons) FROM {before})"""


_P = [
    (has("path", "vendor node_modules"), "0.01", "Vendor/node_modules penalty"),
    (has("path", "generated .pb.go"), "0.05", "Generated code penalty"),
    ("(regexp_matches(path, '(_test\\.go|\\.test\\.ts|_test\\.rs|_test\\.py)$') OR contains(path, 'testdata'))", "0.1", "Test/testdata penalty"),
    (has("path", "mock test"), "0.2", "Mock/Test directory penalty"),
    (has("path", "fixtures examples target build dist"), "0.1", "Fixtures/Examples/Build penalty"),
]
_FACTOR = "CASE " + " ".join(f"WHEN {h} THEN {f}" for h, f, _ in _P) + " END"
_REASON = "CASE " + " ".join(f"WHEN {h} THEN '{r}'" for h, _, r in _P) + " END"
_TOKEN = "len(list_filter(tokens, lambda x: contains(tail, x))) > 0"
_ENTRY = has("tail", "service handler controller router interface api")
STEPS = {
    "noise_suppression": times("s0", "s1", f"({_REASON}) IS NOT NULL", _FACTOR, f"({_REASON})"),
    "definition_boost": times("s1", "s2", "(tail = lower(query) OR list_has_any(string_split(tail, '.'), tokens))", "2.0", "'Definition boost'"),
    "identifier_boost": times("s2", "s3", _TOKEN, "1.3", "'Identifier match boost'"),
    "concept_boost": times("s3", "s4", f"(concept AND {_TOKEN})", "1.5", "'Concept match boost'"),
    "intent_boost": times("s4", "s5", f"(concept AND {_ENTRY})", "2.5", "'Intent-based service/handler boost'"),
    "generic_penalty": times("s5", "s6", "(concept AND tail IN ('main', 'new', 'init', 'test', 'helper', 'util', 'config'))", "0.2", "'Generic symbol penalty'"),
    "file_coherence": "s6n AS (SELECT *, count(*) OVER (PARTITION BY query_id, file_path) AS n FROM s6),\n"
    + times("s6n", "s7", "n > 1", "1.0::FLOAT + (n - 1)::FLOAT * 0.05::FLOAT", "'File coherence boost'"),
}
NORMAL = """s8 AS (SELECT * REPLACE (least(score / ((1.0::FLOAT / 60::FLOAT) * 2::FLOAT), 1.0::FLOAT) AS score) FROM s7)"""
RESULT = "query_id, symbol_id, round(score::DOUBLE, 6) AS score, file_path, start_line, end_line, reasons"
CANDIDATE = "query_id, id, file_path, start_line, round(score::DOUBLE, 8) AS score, reasons"
BASE = ",\n".join([DOCS, POSTINGS, ASKED, lexical("texts"), SEMANTIC, FUSED])


def chain(last: str) -> str:
    names = list(STEPS)
    return "WITH " + ",\n".join([BASE, *(STEPS[n] for n in names[: names.index(last) + 1])])


ORACLES = {name: f"{chain(name)}\nSELECT {CANDIDATE} FROM s{i}" for i, name in enumerate(STEPS, 1)}
ORACLES["rrf_fusion"] = f"WITH {BASE}\nSELECT {CANDIDATE} FROM s0"
ORACLES["fusion_reasons"] = f"WITH {BASE}\nSELECT query_id, reasons, count(*) AS n FROM s0 GROUP BY query_id, reasons"
ORACLES["normalize_and_floor"] = f"{chain('file_coherence')},\n{NORMAL}\nSELECT {RESULT} FROM s8 WHERE score >= 0.15::FLOAT"

# search(): noise goes before the other steps, and exact symbols before all
_NOISE = has("lower(file_path)", "vendor node_modules mock test generated .pb.go fixtures examples")
_EXACT = f"""exact AS (SELECT * FROM (SELECT query_id, symbol_id, 1.0::DOUBLE AS score, file_path, start_line, end_line, 'Exact symbol match' AS reasons,
  row_number() OVER (PARTITION BY query_id ORDER BY (symbol_id = query AND name = query) DESC, file_path, start_line, symbol_id, end_line) AS k
  FROM asked JOIN chunks ON symbol_id = query OR name = query WHERE intent = 'Symbol') WHERE k <= 25)"""
ORACLES["hybrid_search"] = (
    f"WITH {BASE.replace('s0 AS (', 's00 AS (')},\ns0 AS (SELECT * FROM s00 WHERE NOT {_NOISE}),\n"
    + ",\n".join(STEPS.values())
    + f",\n{NORMAL},\n{_EXACT}\nSELECT {RESULT} FROM s8 WHERE score >= 0.15::FLOAT AND query_id NOT IN (SELECT query_id FROM exact)"
    + "\nUNION ALL SELECT query_id, symbol_id, score, file_path, start_line, end_line, reasons FROM exact"
)
_ALL = values(SEARCHES)
ORACLES["bm25_multi_query"] = f"WITH {DOCS},\n{POSTINGS},\n{lexical(_ALL)}\nSELECT query_id, rank0, round(score, 6) AS score, id, file_path, start_line FROM lex"
ORACLES["bm25_search"] = f"WITH {DOCS},\n{POSTINGS},\n{lexical(values(SEARCHES[:1]))}\nSELECT rank0, id, file_path, start_line FROM lex"
ORACLES["tokenize_terms"] = f"WITH {DOCS},\n{POSTINGS}\nSELECT field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY field, term"
ORACLES["corpus_stats"] = f"WITH {DOCS},\n{POSTINGS}\nSELECT field, n, round(avgdl, 6) AS avgdl FROM stats"


def symbol_search(rows: str, asked: str) -> str:
    """hits(query_id, rank0, score, symbol columns): BM25 on names, and the exact id."""
    return f"""sym AS ({rows}),
keyed AS (SELECT *, row_number() OVER () AS k FROM sym),
sp AS (SELECT k, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT k, len({terms('name')}) AS dl, unnest({terms('name')}) AS term FROM keyed) GROUP BY k, term),
st AS (SELECT (SELECT count(*) FROM sym) AS n, (SELECT sum(tf) FROM sp) / (SELECT count(*) FROM sym) AS avgdl),
sd AS (SELECT term, count(*) AS df FROM sp GROUP BY term),
sq AS (SELECT query_id, query FROM {asked}),
named AS (SELECT query_id, k, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM (SELECT DISTINCT query_id, unnest({terms('query')}) AS term FROM sq) JOIN sp USING (term) JOIN sd USING (term), st GROUP BY query_id, k),
ided AS (SELECT query_id, k, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS score FROM (
  SELECT query_id, k, count(*) OVER (PARTITION BY query_id) AS df FROM sq JOIN keyed ON symbol_id = query), st),
summed AS (SELECT query_id, k, sum(score) AS score FROM (SELECT * FROM named UNION ALL SELECT * FROM ided) GROUP BY query_id, k),
hits AS (SELECT * FROM (SELECT query_id, score, keyed.*, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, symbol_id, file_path, start_line, end_line) - 1)::INT AS rank0
  FROM summed JOIN keyed USING (k)) WHERE rank0 < 25)"""


_PART = """SELECT lower(p_type) || ':' || p_brand || ':' || replace(p_name, ' ', '.') AS symbol_id, replace(p_name, ' ', '.') AS name,
  p_brand || '/' || p_partkey || '.go' AS file_path, p_size AS start_line, p_size + 1 AS end_line FROM part"""
ORACLES["symbol_bm25_resolve"] = f"WITH {symbol_search(_PART, values(PARTS))}\nSELECT query_id, rank0, round(score, 6) AS score, symbol_id, file_path FROM hits"
ORACLES["symbol_exact"] = f"""SELECT query_id, rank0, symbol_id, file_path, start_line FROM (SELECT *,
  (row_number() OVER (PARTITION BY query_id ORDER BY (symbol_id = query AND name = query) DESC, file_path, start_line, symbol_id, end_line) - 1)::INT AS rank0
  FROM {values(PARTS)} JOIN ({_PART}) ON symbol_id = query OR name = query) WHERE rank0 < 25"""
_SYMBOLS = "SELECT symbol_id, name, file_path, start_line, end_line FROM chunks"
ORACLES["resolve_symbol"] = f"""WITH {DOCS},\n{symbol_search(_SYMBOLS, _ALL)}
SELECT query_id, symbol_id, 1.0::DOUBLE AS score, file_path, start_line, end_line, 'Exact symbol lookup' AS reasons FROM hits"""


def nearest(where: str, other: str, k: int) -> str:
    return f"""SELECT query_id, vec_id, rank0, round(score, 6) AS score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1)::INT AS rank0 FROM (
  SELECT q.vec_id AS query_id, o.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], o.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q, {other} o WHERE {where})) WHERE rank0 < {k}"""


ORACLES["vector_topk"] = nearest("q.vec_id % 50 = 0", "embeddings", 10)
ORACLES["vector_dim_guard"] = nearest("q.vec_id % 50 = 0", "(SELECT * FROM embeddings WHERE vec_id % 2 = 0)", 5)
ORACLES["cosine_pairs"] = """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1"""
_SHORT = "regexp_extract(text, '^\\S+(?: \\S+){0,2}', 0)"
ORACLES["classify_intent"] = f"SELECT conv_id, turn, {intent('text')} AS intent, {intent(_SHORT)} AS short_intent FROM conversations WHERE text IS NOT NULL"
ORACLES["intent_weights"] = f"""SELECT intent, n, round(({WEIGHTS})[1]::FLOAT::DOUBLE, 6) AS alpha, round(({WEIGHTS})[2]::FLOAT::DOUBLE, 6) AS beta
FROM (SELECT {intent('text')} AS intent, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1)"""
ORACLES["expand_query"] = f"""SELECT conv_id, turn, sha256(x) AS expanded_sha256, (length(x) - length(text))::BIGINT AS added
FROM (SELECT *, {search_text('text')} AS x FROM conversations WHERE text IS NOT NULL)"""
_POSITIONS = "pos AS (SELECT doc_id AS query_id, file_path AS file, start_line AS line FROM chunks WHERE doc_id % 50 = 0)"
_LOCATED = """located AS (SELECT * FROM (SELECT query_id, file, line, c.*, row_number() OVER (PARTITION BY query_id ORDER BY end_line - start_line, start_line, id) AS k
  FROM pos JOIN chunks c ON file = file_path AND line BETWEEN start_line AND end_line) WHERE k = 1)"""
ORACLES["locate_chunk"] = f"WITH {DOCS},\n{_POSITIONS},\n{_LOCATED}\nSELECT query_id, id, file_path, start_line, end_line FROM located"
ORACLES["find_related"] = f"""WITH {DOCS},\n{VECTORS},\n{_POSITIONS},\n{_LOCATED},
near AS (SELECT * FROM (SELECT query_id, file, line, b.id, round(list_cosine_similarity(a.e, b.e), 9) AS s,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.id) AS k
  FROM located JOIN vecs a USING (id), vecs b) WHERE k <= 20)
SELECT query_id, c.y AS symbol_id, round(s::FLOAT::DOUBLE, 6) AS score, c.p AS file_path, c.s AS start_line, c.e AS end_line, 'Embedding similarity' AS reasons
FROM near JOIN firsts USING (id) WHERE NOT (c.p = file AND line BETWEEN c.s AND c.e)"""
ORACLES["point_get"] = f"WITH {DOCS}\nSELECT id, file_path, start_line FROM chunks WHERE id = (SELECT arg_min(id, doc_id) FROM chunks)"
ORACLES["scan_skip_filter"] = f"""SELECT page_id, regexp_extract(path, '\\.([^./]+)$', 1) AS ext,
  {has('path', '/.git/ /node_modules/ /vendor/ /target/ /build/ /dist/ /test/ /mock/ /generated/')} AS skipped,
  {has('lower(path)', 'vendor node_modules mock test generated .pb.go fixtures examples')} AS noise
FROM (SELECT page_id, regexp_replace(url, '^https?:/', '') AS path FROM pages)"""
ORACLES["module_path"] = """SELECT page_id, m AS module, replace(m, '/', '::') AS rust_module, 'func:' || m || ':f' AS symbol_id FROM (
  SELECT page_id, CASE WHEN d IN ('', '.') THEN 'crate' ELSE d END AS m FROM (
    SELECT page_id, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS d FROM (
      SELECT page_id, replace(regexp_replace(url, '^https?://[^/]*/?', ''), chr(92), '/') AS p FROM pages)))"""
ORACLES["symbol_id_split"] = """SELECT p_partkey, form, upper(CASE form WHEN 0 THEN 'file' WHEN 3 THEN 'symbol' ELSE p_type END) AS kind,
  CASE form WHEN 0 THEN p_name || '.go' WHEN 3 THEN p_brand || '.rs' ELSE p_name END AS name,
  CASE form WHEN 0 THEN 'src/' || p_name || '.go' ELSE p_name END AS tail FROM part, (SELECT unnest([0, 1, 2, 3])::INT AS form)"""
ORACLES["location_parse"] = """SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN 'a/b' || o_custkey || '.go' WHEN 3 THEN 'c:d' END AS file,
  CASE WHEN o_orderkey % 4 IN (0, 3) THEN o_orderkey END AS line,
  CASE o_orderkey % 4 WHEN 1 THEN 'Missing file path' WHEN 2 THEN 'Invalid line number' END AS error FROM orders"""
ORACLES["confidence_label"] = """SELECT l_orderkey, l_linenumber, CASE WHEN p > 85 THEN 'High' WHEN p > 50 THEN 'Medium' ELSE 'Low' END AS confidence
FROM (SELECT *, least((l_quantity / 37)::FLOAT * 100::FLOAT, 100) AS p FROM lineitem)"""
ORACLES["line_range"] = """SELECT p_brand || '/' || p_partkey || '.go' AS file_path, p_size || '-' || (p_size + 1) AS lines, p_size::VARCHAR AS line FROM part"""
ORACLES["content_hash"] = "SELECT sha256(text) AS id, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1"
ORACLES["embedding_upsert"] = """SELECT vec_id::VARCHAR AS chunk_id, round((CASE WHEN vec_id % 2 = 0 THEN embedding[-1] ELSE embedding[1] END)::DOUBLE, 6) AS first, len(embedding)::INT AS dimension FROM embeddings
UNION ALL SELECT 'n' || vec_id, round(embedding[1]::DOUBLE, 6), len(embedding)::INT FROM embeddings WHERE vec_id % 2 = 0"""
ORACLES["json_requests"] = """SELECT event_id, CASE k WHEN 0 THEN 'search' WHEN 1 THEN 'search' WHEN 2 THEN 'find_related' WHEN 3 THEN 'find_related' WHEN 6 THEN 'resolve_symbol' WHEN 7 THEN 'other' END AS method,
  CASE k WHEN 0 THEN event_type END AS query, CASE k WHEN 6 THEN event_type END AS name, CASE k WHEN 2 THEN 'f' || user_id || '.go' WHEN 3 THEN 'x' END AS file,
  CASE k WHEN 2 THEN user_id END AS line,
  CASE k WHEN 1 THEN 'Missing query parameter' WHEN 3 THEN 'Missing file or line parameter' WHEN 5 THEN 'Invalid JSON' WHEN 7 THEN 'Unknown method' END AS error
FROM (SELECT *, event_id % 8 AS k FROM events) WHERE k <> 4"""
ORACLES["symbols_join_split"] = """SELECT p_partkey, p_brand || ' ' || p_type || ' ' || replace(p_name, ' ', '.') AS symbols,
  len(string_split(p_brand || ' ' || p_type || ' ' || replace(p_name, ' ', '.'), ' '))::INT AS n, p_brand AS first, 'file:' || p_name AS fallback FROM part"""

#: What stands in the catalog's small sources: symbol, path, first and last line, text.
DEFINED = [
    ("interface:inventory:Counter", "inventory/shelf.go", 3, 5, "type Counter interface {\n\tCount(item string) int\n}"),
    ("struct:inventory:Shelf", "inventory/shelf.go", 7, 9, "type Shelf struct {\n\titems map[string]int\n}"),
    ("method:inventory:Shelf.Count", "inventory/shelf.go", 11, 13, "func (s Shelf) Count(item string) int {\n\treturn s.items[item]\n}"),
    ("func:inventory:Empty", "inventory/shelf.go", 15, 15, "func Empty() Shelf { return Shelf{} }"),
    ("class:tools:Report", "tools/report.py", 1, 3, "class Report:\n    def lines(self):\n        return []"),
    ("method:tools:Report.lines", "tools/report.py", 2, 3, "def lines(self):\n        return []"),
    ("func:tools:total", "tools/report.py", 6, 7, "def total(numbers):\n    return sum(numbers)"),
    ("enum:engine::src:Fuel", "engine/src/tank.rs", 1, 1, "pub enum Fuel { Wood, Coal }"),
    ("struct:engine::src:Tank", "engine/src/tank.rs", 3, 5, "pub struct Tank {\n    level: u32,\n}"),
    ("method:engine::src:Tank.fill", "engine/src/tank.rs", 8, 10, "pub fn fill(&mut self, by: u32) {\n        self.level += by;\n    }"),
    ("func:engine::src:drained", "engine/src/tank.rs", 13, 13, "fn drained(t: &Tank) -> bool { t.level == 0 }"),
    ("class:page:Clock", "page/clock.js", 1, 3, "class Clock {\n  tick() { this.t += 1 }\n}"),
    ("method:page:Clock.tick", "page/clock.js", 2, 2, "tick() { this.t += 1 }"),
    ("func:page:start", "page/clock.js", 4, 4, "function start(clock) { return setInterval(() => clock.tick(), 1000) }"),
    ("interface:page:Shape", "page/shape.ts", 1, 1, "interface Shape { area(): number }"),
    ("method:page:Shape.area", "page/shape.ts", 1, 1, "area(): number"),
    ("class:page:Square", "page/shape.ts", 2, 4, "class Square implements Shape {\n  area(): number { return this.side * this.side }\n}"),
    ("method:page:Square.area", "page/shape.ts", 3, 3, "area(): number { return this.side * this.side }"),
    ("func:page:sum", "page/shape.ts", 5, 5, "function sum(shapes: Shape[]): number { return 0 }"),
]
_DEFINED = ", ".join(f"('{y}', '{p}', {a}, {z}, '{t}')" for y, p, a, z, t in DEFINED)
ORACLES["extract_definitions"] = f"""SELECT symbol_id, file_path, start_line, end_line, sha256(t) AS id
FROM (VALUES {_DEFINED}) v(symbol_id, file_path, start_line, end_line, t)"""
_ASKED_NAMES = values(["config", "AuthService"])
ORACLES["formatted_results"] = f"""WITH {DOCS},\n{symbol_search(_SYMBOLS, _ASKED_NAMES)}
SELECT query_id, file_path, start_line, upper(split_part(symbol_id, ':', 1)) || chr(10) || '  ' || split_part(symbol_id, ':', -1) || chr(10) || chr(10)
  || '  Confidence: High (100%)' || chr(10) || chr(10) || '  Why:' || chr(10) || '  - Exact symbol lookup' || chr(10) || chr(10) || '  Symbol:' || chr(10) || '  ' || symbol_id
  || chr(10) || chr(10) || '  File:' || chr(10) || '  ' || file_path || ':' || start_line || CASE WHEN start_line = end_line THEN '' ELSE '-' || end_line END || chr(10) AS text FROM hits"""
