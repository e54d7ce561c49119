"""Registry of the engine's queries on the driver's tables, and of their SQL oracles.

The tables hold no source code, so adapters give them the engine's shape:
`documents` are chunks (paths, symbols and lines are made from doc_id), `part`
are symbols, `embeddings` pair with documents by id, `conversations` are
queries. Every query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding import HashedTokens, embed
from .functions import display, intent, text
from .operators import bm25, knn, lookup, ranking
from .plans import search as plans
from .sources import repository, requests, store

#: Parts of the made paths and symbols, by doc_id; they touch every ranking rule.
FOLDERS = ["internal/auth", "vendor/lib", "cmd", "pkg/generated", "src/testdata", "lib/mock", "dist/app", "web", "core/examples", "api", "node_modules/x"]
ENDINGS = [".go", "_test.go", ".py"]
NAMES = ["AuthService.login", "main", "UserHandler", "store.get", "config", "apiRouter.add", "helper", "TokenCache.put"]
KINDS = ["method", "func", "struct", "method", "func", "method", "func", "method"]
DOCS_A_FILE = 6
SEARCHES = [
    "auth flow of the login",
    "the architecture of thing and ting",
    "on the of and in",
    "define the handler in en",
    "where is AuthService the",
    "main",
    "nothingsuchword",
    "cache of database module",
]
PARTS_ASKED = ["small ring", "red", "Widget bolt", "blue.bolt", "economy:Brand#17:red.widget", "nothing"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def of_list(values: list[str], n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def doc_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    file = F.floor(F.col("doc_id") / DOCS_A_FILE)
    folder = of_list(FOLDERS, file)
    start = (F.pmod("doc_id", F.lit(DOCS_A_FILE)) * 100 + 1).cast("int")
    name = of_list(NAMES, F.col("doc_id"))
    return d.select(
        "doc_id",
        text.content_id(F.col("text")).alias("id"),
        F.concat(folder, F.lit("/"), file.cast("string"), of_list(ENDINGS, file)).alias("file_path"),
        start.alias("start_line"),
        (start + F.size(F.split("text", "\n")) - 1).alias("end_line"),
        F.col("text").alias("raw_content"),
        text.symbol_id(of_list(KINDS, F.col("doc_id")), folder, name).alias("symbol_id"),
        name.alias("symbol_name"),
    )


def doc_chunks(spark, sf_dir) -> DataFrame:
    return doc_parts(spark, sf_dir).select("id", "file_path", "start_line", "end_line", "raw_content", F.array("symbol_id").alias("symbols_defined"))


def doc_symbols(spark, sf_dir) -> DataFrame:
    return doc_parts(spark, sf_dir).select("symbol_id", "symbol_name", F.lit("Definition").alias("symbol_type"), "file_path", "start_line", "end_line")


def doc_embeddings(spark, sf_dir) -> DataFrame:
    """Of documents with equal text, the vector of the smallest doc_id."""
    paired = doc_parts(spark, sf_dir).join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return paired.groupBy(F.col("id").alias("chunk_id")).agg(F.min_by("embedding", "doc_id").alias("embedding"))


def doc_corpus(spark, sf_dir) -> plans.Corpus:
    """The index of all documents, persisted as an engine keeps it; equal plans share what is persisted."""
    chunks, symbols = doc_chunks(spark, sf_dir), doc_symbols(spark, sf_dir)
    postings = bm25.chunk_postings(chunks).persist(), bm25.symbol_postings(symbols).persist()
    return plans.Corpus(chunks, symbols, doc_embeddings(spark, sf_dir).persist(), *postings)


def asked(spark, queries: list[str] = SEARCHES) -> DataFrame:
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


def vectors(spark, sf_dir) -> DataFrame:
    """The vectors that stand in for the embedded SEARCHES."""
    e = table(spark, sf_dir, "embeddings").filter((F.col("vec_id") % 50 == 0) & (F.col("vec_id") < 50 * len(SEARCHES)))
    return e.select((F.col("vec_id") / 50).cast("long").alias("query_id"), "embedding")


def shown(results: DataFrame) -> DataFrame:
    """Results with reasons as a string, for comparison."""
    score = F.round(F.col("score").cast("double"), 6).alias("score")
    return results.select("query_id", "symbol_id", score, "file_path", "start_line", "end_line", F.array_join("reasons", "; ").alias("reasons"))


def part_symbols(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("."))
    return p.select(
        F.concat_ws(":", F.lower("p_type"), "p_brand", name).alias("symbol_id"),
        name.alias("symbol_name"),
        F.lit("Definition").alias("symbol_type"),
        F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("file_path"),
        F.col("p_size").alias("start_line"),
        (F.col("p_size") + 1).alias("end_line"),
    )


def scan_skip_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?:/", "").alias("path"))
    return p.select("page_id", text.extension(F.col("path")).alias("ext"), repository.skipped(F.col("path")).alias("skipped"), intent.contains_any(F.lower("path"), ranking.NOISE).alias("noise"))


def tokenize_terms(spark, sf_dir):
    p = bm25.chunk_postings(doc_chunks(spark, sf_dir))
    return p.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(spark, sf_dir):
    chunks = doc_chunks(spark, sf_dir)
    s = bm25.field_stats(chunks, bm25.chunk_postings(chunks))
    return s.select("field", "n", F.round("avgdl", 6).alias("avgdl"))


def bm25_multi_query(spark, sf_dir):
    c = doc_corpus(spark, sf_dir)
    hits = bm25.search_chunks(asked(spark), c.chunks, c.chunk_postings, c.chunk_stats)
    return hits.select("query_id", "rank0", F.round("score", 6).alias("score"), "id", "file_path", "start_line")


def bm25_search(spark, sf_dir):
    """One query, and the chunks alone without their scores."""
    c = doc_corpus(spark, sf_dir)
    return bm25.search_chunks(asked(spark, SEARCHES[:1]), c.chunks, c.chunk_postings, c.chunk_stats).select("rank0", "id", "file_path", "start_line")


def symbol_bm25_resolve(spark, sf_dir):
    s = part_symbols(spark, sf_dir)
    p = bm25.symbol_postings(s)
    hits = bm25.search_symbols(asked(spark, PARTS_ASKED), s, p, bm25.field_stats(s, p))
    return hits.select("query_id", "rank0", F.round("score", 6).alias("score"), "symbol_id", "file_path")


def symbol_exact(spark, sf_dir):
    hits = lookup.exact_symbols(asked(spark, PARTS_ASKED), part_symbols(spark, sf_dir))
    return hits.select("query_id", "rank0", "symbol_id", "file_path", "start_line")


def vector_topk(spark, sf_dir):
    """Every vector whose id is divisible by 50, against all."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return knn.vector_search(q, e, 10, "vec_id").select("query_id", "vec_id", "rank0", F.round("score", 6).alias("score"))


def vector_dim_guard(spark, sf_dir):
    """Vectors of odd ids are cut short, and so are skipped."""
    e = table(spark, sf_dir, "embeddings")
    cut = e.select("vec_id", F.when(F.col("vec_id") % 2 == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return knn.vector_search(q, cut, 5, "vec_id").select("query_id", "vec_id", "rank0", F.round("score", 6).alias("score"))


def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(knn.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("text is not null")


def classify_intent(spark, sf_dir):
    """Whole turns, and the short queries that their first words make."""
    t = turns(spark, sf_dir)
    short = F.regexp_extract("text", r"^\S+(?: \S+){0,2}", 0)
    return t.select("conv_id", "turn", intent.classify(F.col("text")).alias("intent"), intent.classify(short).alias("short_intent"))


def intent_weights(spark, sf_dir):
    t = turns(spark, sf_dir).select(intent.classify(F.col("text")).alias("intent"))
    counted = t.groupBy("intent").agg(F.count("*").alias("n"))
    w = lambda side: F.round(intent.weight(F.col("intent"), side).cast("double"), 6)
    return counted.select("intent", "n", w(0).alias("alpha"), w(1).alias("beta"))


def expand_query(spark, sf_dir):
    t = turns(spark, sf_dir)
    expanded = intent.search_text(F.col("text"), intent.classify(F.col("text")))
    return t.select("conv_id", "turn", F.sha2(expanded, 256).alias("expanded_sha256"), (F.length(expanded) - F.length("text")).cast("long").alias("added"))


def candidates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Both ranked lists of all SEARCHES."""
    c, q = doc_corpus(spark, sf_dir), plans.routed(asked(spark))
    texts = q.select("query_id", intent.search_text(F.col("query"), F.col("intent")).alias("query"))
    lexical = bm25.search_chunks(texts, c.chunks, c.chunk_postings, c.chunk_stats)
    semantic = plans.representatives(knn.vector_search(vectors(spark, sf_dir), c.embeddings, plans.SEMANTIC_K), c.chunks)
    return lexical.join(q, "query_id"), semantic.join(q, "query_id")


#: The ranking's steps behind the fusion, in order.
STEPS = {
    "noise_suppression": ranking.noise_suppression,
    "definition_boost": ranking.definition_boost,
    "identifier_boost": ranking.identifier_boost,
    "concept_boost": ranking.concept_boost,
    "intent_boost": ranking.intent_boost,
    "generic_penalty": ranking.generic_penalty,
    "file_coherence": ranking.file_coherence,
}


def candidate_rows(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "file_path", "start_line", F.round(F.col("score").cast("double"), 8).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


def rrf_fusion(spark, sf_dir):
    return candidate_rows(ranking.fuse(*candidates(spark, sf_dir)))


def fusion_reasons(spark, sf_dir):
    fused = ranking.fuse(*candidates(spark, sf_dir))
    return fused.groupBy("query_id", F.array_join("reasons", "; ").alias("reasons")).agg(F.count("*").alias("n"))


def up_to(name: str):
    def query(spark, sf_dir):
        found = ranking.fuse(*candidates(spark, sf_dir))
        for step, function in STEPS.items():
            found = function(found)
            if step == name:
                return candidate_rows(found)

    query.__doc__ = f"The ranking's steps up to {name}, tests included."
    return query


def normalize_and_floor(spark, sf_dir):
    """The whole ranking, tests included, of all SEARCHES."""
    return shown(ranking.rank(*candidates(spark, sf_dir), include_tests=True))


def hybrid_search(spark, sf_dir):
    """The flagship: search() over all documents."""
    return shown(plans.search(asked(spark), doc_corpus(spark, sf_dir), HashedTokens(), vectors=vectors(spark, sf_dir)))


def resolve_symbol(spark, sf_dir):
    return shown(plans.resolve(asked(spark), doc_corpus(spark, sf_dir)))


def positions(spark, sf_dir) -> DataFrame:
    """Of every document whose id is divisible by 50: its file and its first line."""
    d = doc_parts(spark, sf_dir).filter("doc_id % 50 = 0")
    return d.select(F.col("doc_id").alias("query_id"), F.col("file_path").alias("file"), F.col("start_line").cast("long").alias("line"))


def locate_chunk(spark, sf_dir):
    return lookup.locate(positions(spark, sf_dir), doc_chunks(spark, sf_dir)).select("query_id", "id", "file_path", "start_line", "end_line")


def find_related(spark, sf_dir):
    return shown(plans.related(positions(spark, sf_dir), doc_corpus(spark, sf_dir)))


def point_get(spark, sf_dir):
    """Chunks by a content id that exists (of the first document, asked for as a query would) and by one that doesn't."""
    chunks = doc_chunks(spark, sf_dir)
    known = table(spark, sf_dir, "documents").filter("text is not null").agg(F.min_by(text.content_id(F.col("text")), "doc_id")).first()[0]
    found = lookup.get_chunk(chunks, known or "").union(lookup.get_chunk(chunks, "0" * 64))
    return found.select("id", "file_path", "start_line")


def module_path(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]*/?", "").alias("path"))
    tail = lambda sep: text.module_path(F.col("path"), sep)
    return p.select("page_id", tail("/").alias("module"), tail("::").alias("rust_module"), text.symbol_id(F.lit("func"), tail("/"), F.lit("f")).alias("symbol_id"))


def symbol_id_split(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    forms = F.array(F.concat(F.lit("file:src/"), "p_name", F.lit(".go")), F.concat_ws(":", "p_type", "p_brand", "p_name"), F.concat_ws(":", "p_type", "p_name"), F.col("p_name"))
    made = p.select("p_partkey", F.posexplode(forms).alias("form", "symbol_id"), F.concat(F.lit("lib/"), "p_brand", F.lit(".rs")).alias("file_path"))
    kind, name = display.split_symbol_id(F.col("symbol_id"), F.col("file_path"))
    return made.select("p_partkey", "form", F.upper(kind).alias("kind"), name.alias("name"), text.symbol_tail(F.col("symbol_id")).alias("tail"))


def location_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    form = F.pmod("o_orderkey", F.lit(4))
    location = F.when(form == 0, F.concat_ws(":", F.concat(F.lit("a/b"), "o_custkey", F.lit(".go")), "o_orderkey")).when(form == 1, F.lit("nocolon"))
    location = location.when(form == 2, F.concat(F.lit("c:d:x"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("c:d:"), F.col("o_orderkey").cast("string")))
    file, line, error = display.parse_location(location)
    return o.select("o_orderkey", file.alias("file"), line.alias("line"), error.alias("error"))


def confidence_label(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 37).cast("float").alias("score"))
    return e.select("l_orderkey", "l_linenumber", display.confidence(F.col("score")).alias("confidence"))


def line_range(spark, sf_dir):
    return part_symbols(spark, sf_dir).select("file_path", display.line_range(F.col("start_line"), F.col("end_line")).alias("lines"), display.line_range(F.col("start_line"), F.col("start_line")).alias("line"))


def content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.groupBy(text.content_id(F.col("text")).alias("id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def embedding_upsert(spark, sf_dir):
    """Vectors of even ids are replaced by their reverse, and as many new ones inserted."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "vec_id")
    new = e.filter("vec_id % 2 = 0")
    new = new.select("chunk_id", F.reverse("embedding").alias("embedding")).union(new.select(F.concat(F.lit("n"), "chunk_id"), "embedding"))
    return store.upserted(e, new).select("chunk_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.size("embedding").alias("dimension"))


def json_requests(spark, sf_dir):
    """Requests made of events: good ones, and each kind of error."""
    e = table(spark, sf_dir, "events")
    form = F.pmod("event_id", F.lit(8))
    user = F.col("user_id").cast("string")
    value = (
        F.when(form == 0, F.concat(F.lit('{"method":"search","params":{"query":"'), "event_type", F.lit('"}}')))
        .when(form == 1, F.lit('{"method":"search","params":{}}'))
        .when(form == 2, F.concat(F.lit('{"method":"find_related","params":{"file":"f'), user, F.lit('.go","line":'), user, F.lit("}}")))
        .when(form == 3, F.lit('{"method":"find_related","params":{"file":"x"}}'))
        .when(form == 4, F.lit("  "))
        .when(form == 5, F.lit("{not json"))
        .when(form == 6, F.concat(F.lit('{"method":"resolve_symbol","params":{"name":"'), "event_type", F.lit('"}}')))
        .otherwise(F.lit('{"method":"other"}'))
    )
    return requests.parse(e.select("event_id", value.alias("value")), "event_id").withColumnRenamed("request_id", "event_id")


def symbols_join_split(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    joined = text.joined_symbols(F.array("p_brand", "p_type", F.replace(F.col("p_name"), F.lit(" "), F.lit("."))))
    back = text.split_symbols(joined)
    return p.select("p_partkey", joined.alias("symbols"), F.size(back).alias("n"), text.first_symbol(back, F.lit("x")).alias("first"), text.first_symbol(F.array().cast("array<string>"), F.col("p_name")).alias("fallback"))


def embed_turns(spark, sf_dir):
    """Embedding of every turn; equal texts have equal vectors of length one, or none."""
    t = turns(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    e = embed(t, HashedTokens(), "key", "text")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return e.select("key", F.size("embedding").alias("dimension"), F.round(norm, 4).alias("norm"))


#: Small sources of every language, by path.
FIXTURES = {
    "inventory/shelf.go": "package inventory\n\ntype Counter interface {\n\tCount(item string) int\n}\n\ntype Shelf struct {\n\titems map[string]int\n}\n\nfunc (s Shelf) Count(item string) int {\n\treturn s.items[item]\n}\n\nfunc Empty() Shelf { return Shelf{} }\n",
    "tools/report.py": "class Report:\n    def lines(self):\n        return []\n\n\ndef total(numbers):\n    return sum(numbers)\n",
    "engine/src/tank.rs": "pub enum Fuel { Wood, Coal }\n\npub struct Tank {\n    level: u32,\n}\n\nimpl Tank {\n    pub fn fill(&mut self, by: u32) {\n        self.level += by;\n    }\n}\n\nfn drained(t: &Tank) -> bool { t.level == 0 }\n",
    "page/clock.js": "class Clock {\n  tick() { this.t += 1 }\n}\nfunction start(clock) { return setInterval(() => clock.tick(), 1000) }\n",
    "page/shape.ts": "interface Shape { area(): number }\nclass Square implements Shape {\n  area(): number { return this.side * this.side }\n}\nexport function sum(shapes: Shape[]): number { return 0 }\n",
}


def extract_definitions(spark, sf_dir):
    """All extractors over sources written here, as chunks with their symbols."""
    files = spark.createDataFrame(list(FIXTURES.items()), "path string, content string")
    found = repository.definitions(files)
    return repository.with_ids(found).select("symbol_id", F.col("path").alias("file_path"), "start_line", "end_line", text.content_id(F.col("raw_content")).alias("id"))


def formatted_results(spark, sf_dir):
    found = plans.resolve(asked(spark, ["config", "AuthService"]), doc_corpus(spark, sf_dir))
    return found.select("query_id", "file_path", "start_line", display.formatted().alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search, scan_skip_filter, tokenize_terms, corpus_stats, bm25_search, bm25_multi_query, symbol_bm25_resolve, symbol_exact, vector_topk,
        vector_dim_guard, cosine_pairs, classify_intent, intent_weights, expand_query, rrf_fusion, fusion_reasons, normalize_and_floor, resolve_symbol,
        locate_chunk, find_related, point_get, module_path, symbol_id_split, location_parse, confidence_label, line_range, content_hash, embedding_upsert,
        json_requests, symbols_join_split, embed_turns, extract_definitions, formatted_results,
    )
} | {name: up_to(name) for name in STEPS}

from .oracles import ORACLES  # noqa: E402, F401
