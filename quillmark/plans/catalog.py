"""All queries of the library proper by name, with their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import constants as K
from quillmark.functions import text as T
from quillmark.functions import vector as V
from quillmark.operators import index, memory, search, telemetry
from quillmark.sources import tables as S
from quillmark.sources.tables import SQL_FILES, SQL_MEMORIES, SQL_SYMBOLS
from quillmark.streaming import events

QUERIES: dict = {}
ORACLE_SQL: dict = {}
QUERY = "small ring"
PATH_QUERY = "src1 en"
STOP = "(" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + ")"
SQL_TOKENS = r"list_distinct(list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND w NOT IN " + STOP + "))"
SQL_EST = r"CASE WHEN {c} = '' THEN 0 ELSE greatest(len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]{{1,4}}|[^\p{{L}}\p{{N}}_\s]|\n')), 1) END"
SQL_FNV = "printf('%016x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, strlen({c})), lambda i: ('0x' || hex({c})[2 * i + 1:2 * i + 2])::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Telemetry -------------------------------------------------------------------------------------------------------
@query("SELECT event_type AS tool_name, count(*) AS calls, round(avg(value), 6) AS avg_latency_ms, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS empty, round(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*), 6) AS empty_pct FROM events GROUP BY event_type")
def telemetry_by_tool(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.by_tool(S.tool_calls(spark, d))


@query(f"SELECT {SQL_FNV.format(c='props')} AS query_hash, n FROM (SELECT props, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY props) ORDER BY n DESC, query_hash LIMIT 5")
def telemetry_top_empty_hashes(spark, d):
    return telemetry.top_empty(S.tool_calls(spark, d))


@query("SELECT count(*) AS calls FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def telemetry_since(spark, d):
    return telemetry.since(S.tool_calls(spark, d), "2024-01-15 00:00:00")


@query(f"SELECT props, {SQL_FNV.format(c='props')} AS hash FROM (SELECT DISTINCT props FROM events)")
def fnv_hash_props(spark, d):
    return S.read(spark, d, "events").select("props").distinct().withColumn("hash", T.fnv1a64_hex(F.col("props")))


# Text ------------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, CAST({SQL_EST.format(c='text')} AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return S.read(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query(r"SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9])the($|[^a-z0-9])') AS hit FROM documents")
def word_boundary_match(spark, d):
    return S.read(spark, d, "documents").select("doc_id", T.has_word(F.col("text"), "the").alias("hit"))


@query(f"SELECT doc_id, CAST(len({SQL_TOKENS.format(c='text')}) AS BIGINT) AS words FROM documents")
def token_set_size(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.size(T.token_set(F.col("text"))).cast("long").alias("words"))


@query(f"WITH {SQL_FILES} SELECT doc_id, line_count FROM files")
def line_count(spark, d):
    return S.files(spark, d).select("doc_id", "line_count")


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1fKB', n / 1024.0::DOUBLE) ELSE printf('%.1fMB', n / 1048576.0::DOUBLE) END AS size FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def format_size(spark, d):
    return S.files(spark, d).select("doc_id", T.format_size(F.col("size_bytes")).alias("size"))


@query("SELECT p_partkey, CASE WHEN strlen(s) > 12 THEN CASE WHEN regexp_matches(substr(s, 1, 12), '[,)]') THEN regexp_extract(substr(s, 1, 12), '^(.*)[,)]', 1) ELSE substr(s, 1, 12) END || '...' ELSE s END AS sig FROM (SELECT p_partkey, p_name || '(' || p_brand || ', ' || p_type || ')' AS s FROM part)")
def truncate_signature(spark, d):
    s = F.concat("p_name", F.lit("("), "p_brand", F.lit(", "), "p_type", F.lit(")"))
    return S.read(spark, d, "part").select("p_partkey", T.truncate_sig(s, 12).alias("sig"))


@query("SELECT p_partkey, p_brand || '/b/c' AS path FROM part")
def normalize_path(spark, d):
    return S.read(spark, d, "part").select("p_partkey", T.normalize_path(F.concat(F.lit("./x/../"), "p_brand", F.lit("/./a/../b//c"))).alias("path"))


@query("SELECT doc_id, round(CASE WHEN contains(lower(text), 'the er') THEN 0.2 ELSE 0.2 * ((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'er') THEN 1 ELSE 0 END)) / 2 END::DOUBLE, 6) AS score FROM documents")
def keyword_score(spark, d):
    return S.read(spark, d, "documents").select("doc_id", F.round(T.keyword_score(F.col("text"), "the er"), 6).alias("score"))


# Index -----------------------------------------------------------------------------------------------------------
@query("SELECT lang AS extension, count(*) AS files FROM documents GROUP BY lang ORDER BY files DESC, extension LIMIT 8")
def extension_histogram(spark, d):
    return index.extension_histogram(S.files(spark, d))


@query("SELECT dir, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM (SELECT source AS dir, strlen(text) AS n FROM documents UNION ALL SELECT source || '/' || lang, strlen(text) FROM documents) GROUP BY dir")
def file_tree_dirs(spark, d):
    return index.tree_dirs(S.files(spark, d))


@query("SELECT doc_id || '' AS relative_path, CASE WHEN doc_id % 11 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents")
def changed_files_diff(spark, d):
    """The documents as an index that lacks every 11th, against a tree that lacks every 7th of the others and changed every 5th: each document is on one side at least."""
    x = S.read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("relative_path"), F.md5("text").alias("content_hash"))
    tree = x.where("doc_id % 7 <> 0 or doc_id % 11 = 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, F.concat("content_hash", F.lit("*"))).otherwise(F.col("content_hash")))
    return index.diff(x.where("doc_id % 11 <> 0"), tree)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def stale_anti_join(spark, d):
    return S.read(spark, d, "orders").join(S.read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT l_partkey AS path, count(*) AS import_count FROM lineitem GROUP BY l_partkey")
def import_in_degree(spark, d):
    return search.in_degree(S.read(spark, d, "lineitem"), "l_partkey")


@query("WITH c AS (SELECT l_partkey AS path, count(*) AS import_count FROM lineitem GROUP BY l_partkey) SELECT path, import_count, round(0.5::DOUBLE * ln(1 + import_count) / ln(1 + (SELECT max(import_count) FROM c)), 6) AS boost FROM c")
def centrality_boost(spark, d):
    return search.centrality(search.in_degree(S.read(spark, d, "lineitem"), "l_partkey")).withColumn("boost", F.round("boost", 6))


@query("""WITH p AS (SELECT doc_id, k, doc_id - k AS t, doc_id % 5 AS m FROM documents, (VALUES (5), (10)) x(k))
SELECT CASE m WHEN 0 THEN 'lib/doc_' || p.doc_id || '.py' WHEN 1 THEN 'web/doc_' || p.doc_id || '.ts' WHEN 2 THEN 'src/doc_' || p.doc_id || '.rs' WHEN 3 THEN 'app/pkg/p' || p.doc_id || '/doc.go' ELSE 'c/doc_' || p.doc_id || '.hxx' END AS relative_path,
  CASE m WHEN 0 THEN 'lib.doc_' || t WHEN 1 THEN CASE k WHEN 5 THEN './doc_' ELSE '/web/doc_' END || t WHEN 2 THEN CASE k WHEN 5 THEN 'crate::doc_' ELSE 'doc_' END || t WHEN 3 THEN CASE k WHEN 5 THEN 'pkg/p' ELSE 'app/pkg/p' END || t ELSE CASE k WHEN 5 THEN 'doc_' ELSE 'c/doc_' END || t || '.hxx' END AS import,
  CASE m WHEN 0 THEN 'lib/doc_' || t || '.py' WHEN 1 THEN 'web/doc_' || t || '.ts' WHEN 2 THEN 'src/doc_' || t || '.rs' WHEN 3 THEN 'app/pkg/p' || t || '/doc.go' ELSE 'c/doc_' || t || '.hxx' END AS resolved
FROM p JOIN documents d ON d.doc_id = t""")
def import_extract(spark, d):
    """Imports of all documents as sources in five languages, resolved to one another."""
    files = S.sources(spark, d)
    return index.resolve_imports(index.extract_imports(files), files)


@query(r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS c, generate_subscripts(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), 1) - 1 AS n FROM pages)
SELECT 'page_' || page_id || '/' || n || '.js' AS relative_path, regexp_extract(c, '^(?:const|let|var)\s+(\w+)', 1) AS name, 'const' AS kind, 1 AS start_line, 1 AS end_line, trim(c) AS signature FROM s WHERE regexp_matches(c, '^(?:const|let|var)\s+\w+')""")
def symbol_extract(spark, d):
    """Top-level symbols of the scripts in all pages, which hold one line each."""
    return index.extract_symbols(S.scripts(spark, d))


# Search ----------------------------------------------------------------------------------------------------------
SQL_NAME = "CASE WHEN lower(name) = 'small ring' THEN 5.0 WHEN contains(lower(name), 'small ring') THEN 3.0 ELSE 3.0 * ((CASE WHEN contains(lower(name), 'small') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(name), 'ring') THEN 1 ELSE 0 END)) / 2 END::DOUBLE"
SQL_FACTOR = "CASE WHEN kind IN ('function','class','method','struct','trait','impl','enum','interface','type') THEN 1.5 WHEN kind = 'export' AND end_line - start_line < 3 THEN 0.2 ELSE 1.0 END::DOUBLE"
SQL_PATH = "(CASE WHEN contains(lower({p}), 'src1 en') THEN 6 ELSE 0 END + 6 * ((CASE WHEN contains(lower({p}), 'src1') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower({p}), 'en') THEN 1 ELSE 0 END)) / 2.0)::DOUBLE"


@query(f"WITH {SQL_SYMBOLS}, h AS (SELECT symbol_id, name, w AS word, row_number() OVER (PARTITION BY w ORDER BY name, symbol_id) AS rank FROM symbols, (VALUES ('small'), ('ring')) t(w) WHERE contains(lower(name), w)) SELECT symbol_id, word, rank FROM h WHERE rank <= 100")
def like_symbol_search(spark, d):
    return search.like_words(S.symbols(spark, d), QUERY).select("symbol_id", "word", F.col("rank").cast("long").alias("rank"))


@query(rf"WITH {SQL_SYMBOLS} SELECT symbol_id, name FROM symbols WHERE regexp_matches(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), '(^| )small ri') OR regexp_matches(regexp_replace(lower(signature), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), '(^| )small ri') ORDER BY symbol_id LIMIT 100")
def phrase_prefix_match(spark, d):
    return search.phrase_prefix(S.symbols(spark, d), "small ri").select("symbol_id", "name")


@query(f"WITH {SQL_SYMBOLS} SELECT symbol_id, round({SQL_NAME} * {SQL_FACTOR}, 6) AS score FROM symbols WHERE {SQL_NAME} > 0")
def symbol_score(spark, d):
    return search.symbol_score(S.symbols(spark, d), QUERY).select("symbol_id", F.round("score", 6).alias("score"))


@query(rf"WITH {SQL_SYMBOLS} SELECT symbol_id, round(least(1.0, CASE WHEN lower(name) = 'small ring' THEN 0.5 WHEN contains(lower(name), 'small ring') OR contains('small ring', lower(name)) THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(lower(signature), '(^|[^A-Za-z0-9])small($|[^a-z0-9])') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(lower(signature), '(^|[^A-Za-z0-9])ring($|[^a-z0-9])') THEN 0.1 ELSE 0 END + CASE WHEN end_line - start_line + 1 > 10 THEN 0.05 ELSE 0 END)::DOUBLE, 6) AS relevance FROM symbols")
def symbol_relevance(spark, d):
    return search.relevance(S.symbols(spark, d), QUERY).select("symbol_id", F.round("relevance", 6).alias("relevance"))


@query(f"WITH {SQL_FILES} SELECT doc_id, round({SQL_PATH.format(p='relative_path')}, 6) AS score FROM files")
def path_match_score(spark, d):
    return S.files(spark, d).select("doc_id", F.round(search.path_score(F.col("relative_path"), PATH_QUERY), 6).alias("score"))


@query(f"WITH {SQL_SYMBOLS} SELECT name, relative_path, symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY name, relative_path ORDER BY symbol_id) AS n FROM symbols) WHERE n = 1")
def first_wins_dedupe(spark, d):
    return search.first_wins(S.symbols(spark, d), ["name", "relative_path"], ["symbol_id"]).select("name", "relative_path", "symbol_id")


SQL_HIT = "(contains(lower(x), 'import') OR contains(lower(x), 'impo') OR contains(lower(x), 'the'))"
SQL_TRIM = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
SQL_IMPORT = f"(prefix({SQL_TRIM}, 'import ') OR prefix({SQL_TRIM}, 'from ') OR prefix({SQL_TRIM}, '#include') OR (contains(x, 'require(') AND (prefix({SQL_TRIM}, 'const ' || chr(123)) OR (prefix({SQL_TRIM}, 'const ') AND contains(x, chr(125))))))"


@query(f"WITH {SQL_FILES} SELECT relative_path, CAST(len(list_filter(string_split(content, chr(10)), lambda x: {SQL_HIT} AND NOT {SQL_IMPORT})) AS BIGINT) AS code_lines, CAST(len(list_filter(string_split(content, chr(10)), lambda x: {SQL_HIT} AND {SQL_IMPORT})) AS BIGINT) AS import_lines FROM files")
def import_vs_code_lines(spark, d):
    return search.line_kinds(S.files(spark, d), "import the")


@query(f"WITH {SQL_FILES}, t AS (SELECT doc_id, extension, {SQL_EST.format(c='content')} AS tokens FROM files) SELECT * FROM (SELECT doc_id, extension, CAST(tokens AS BIGINT) AS tokens, CAST(sum(tokens) OVER (PARTITION BY extension ORDER BY doc_id) AS BIGINT) AS used FROM t) WHERE used <= 20000")
def budget_pack_prefix(spark, d):
    t = S.files(spark, d).select("doc_id", "extension", T.estimate_tokens(F.col("content")).cast("long").alias("tokens"))
    return search.pack_prefix(t, "extension", ["doc_id"], "tokens", 20000)


@query(f"""WITH RECURSIVE {SQL_FILES}, t AS (SELECT doc_id, regexp_extract(relative_path, '^(.*)/', 1) AS folder, CAST({SQL_EST.format(c='content')} AS BIGINT) AS tokens FROM files),
n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY doc_id) AS place FROM t),
r AS (SELECT folder, doc_id, place, tokens <= 3000 AS kept, CASE WHEN tokens <= 3000 THEN 3000 - tokens ELSE 3000 END AS rest FROM n WHERE place = 1
  UNION ALL SELECT n.folder, n.doc_id, n.place, n.tokens <= r.rest, CASE WHEN n.tokens <= r.rest THEN r.rest - n.tokens ELSE r.rest END FROM r JOIN n ON n.folder = r.folder AND n.place = r.place + 1)
SELECT folder, doc_id FROM r WHERE kept""")
def budget_pack_greedy(spark, d):
    t = S.files(spark, d).select("doc_id", F.col("relative_path"), T.estimate_tokens(F.col("content")).cast("long").alias("tokens"))
    t = t.withColumn("folder", F.regexp_extract("relative_path", "^(.*)/", 1))
    return search.pack_greedy(t, "folder", "doc_id", "tokens", 3000)


@query(f"""WITH {SQL_SYMBOLS}, n AS (SELECT relative_path AS path, {SQL_NAME} * {SQL_FACTOR} AS score, name, symbol_id FROM symbols WHERE {SQL_NAME} > 0),
s AS (SELECT path, sum(score) AS score, array_to_string(list(name ORDER BY symbol_id)[1:3], '|') AS symbols FROM n GROUP BY path)
SELECT path, round(score, 6) AS score, symbols FROM s""")
def accumulate_scores(spark, d):
    n = search.symbol_score(S.symbols(spark, d), QUERY).select(F.col("relative_path").alias("path"), "score", F.col("name").alias("symbol"), F.col("symbol_id").alias("ord"))
    return search.accumulate(n).select("path", F.round("score", 6).alias("score"), F.array_join("symbols", "|").alias("symbols"))


SQL_LINES = "len(list_filter(string_split(content, chr(10)), lambda x: (contains(lower(x), 'src1') OR contains(lower(x), 'en')) AND {n} " + SQL_IMPORT + "))"


@query(f"""WITH {SQL_FILES}, p AS (SELECT relative_path AS path, content, doc_id, {SQL_PATH.format(p='relative_path')} AS score FROM files),
c AS (SELECT l_partkey % 997 AS k, count(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT path, content, score + coalesce(0.5::DOUBLE * ln(1 + n) / ln(1 + (SELECT max(n) FROM c)), 0) AS score FROM p LEFT JOIN c ON c.k = p.doc_id WHERE score > 0 ORDER BY 3 DESC, 1 LIMIT 15),
k AS (SELECT path, score, {SQL_LINES.format(n='NOT')} AS code, {SQL_LINES.format(n='')} AS imports FROM t),
f AS (SELECT path, score * CASE WHEN code = 0 AND imports > 0 THEN 0.4 WHEN code > 0 AND imports = 0 THEN 1.3 ELSE 1.0 END::DOUBLE AS score FROM k)
SELECT CAST(row_number() OVER (ORDER BY score DESC, path) AS INTEGER) AS rank, path, round(score, 6) AS score, '' AS symbols FROM f ORDER BY score DESC, path LIMIT 5""")
def indexed_search_e2e(spark, d):
    files = S.files(spark, d)
    edges = S.read(spark, d, "lineitem").select((F.col("l_partkey") % 997).alias("doc_id"))
    counts = edges.groupBy("doc_id").agg(F.count("*").alias("import_count")).join(files.select("doc_id", F.col("relative_path").alias("path")), "doc_id", "right").select("path", "import_count").where("import_count is not null")
    # The largest in-degree is that of all edges, also those whose file is not there.
    most = edges.groupBy("doc_id").agg(F.count("*").alias("import_count")).agg(F.max("import_count").alias("import_count")).select(F.lit("").alias("path"), "import_count")
    return search.indexed_search(S.symbols(spark, d), files, counts.unionByName(most), PATH_QUERY)


# Vectors ---------------------------------------------------------------------------------------------------------
SQL_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in S.read(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


@query(f"WITH {SQL_Q} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 5")
def cosine_knn(spark, d):
    e = S.read(spark, d, "embeddings")
    q = F.array(*map(F.lit, _query_vector(spark, d)))
    return e.select("vec_id", V.cosine(F.col("embedding"), q).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(5).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {SQL_Q} SELECT vec_id, round(1.5 * list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE list_cosine_similarity(embedding::DOUBLE[], q) > 0.35")
def file_sim_threshold(spark, d):
    q = F.array(*map(F.lit, _query_vector(spark, d)))
    x = S.read(spark, d, "embeddings").select("vec_id", V.cosine(F.col("embedding"), q).alias("c")).where(F.col("c") > K.FILE_SIM_MIN)
    return x.select("vec_id", F.round(K.FILE_SIM_WEIGHT * F.col("c"), 6).alias("score"))


_H = "[" + ", ".join("[" + ", ".join(f"{x:.0f}" for x in (V.hadamard(64) * 8 * V.signs(64))[i]) + "]" for i in range(64)) + "]"
SQL_ROTATED = f"r AS (SELECT vec_id, list_transform({_H}::DOUBLE[][], lambda h: list_dot_product(h, embedding::DOUBLE[]) / 8 / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS r FROM embeddings)"


@query(f"WITH {SQL_ROTATED} SELECT vec_id, array_to_string(list_transform(r, lambda x: CAST(round(x * 1e6) AS BIGINT)), ',') AS rotated FROM r")
def rotate_hadamard(spark, d):
    e = S.read(spark, d, "embeddings")
    turned = F.transform(V.rotated(F.col("embedding")), lambda x: x / V.norm(F.col("embedding")))
    return e.select("vec_id", F.array_join(F.transform(turned, lambda x: F.round(x * 1e6).cast("long").cast("string")), ",").alias("rotated"))


@query(f"WITH {SQL_ROTATED} SELECT vec_id, array_to_string(list_transform(r, lambda x: CASE WHEN x > 0.1227 THEN 3 WHEN x > 0 THEN 2 WHEN x > -0.1227 THEN 1 ELSE 0 END), '') AS codes FROM r")
def quantize_2bit_codes(spark, d):
    return S.read(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(V.codes_2bit("embedding"), lambda c: c.cast("string")), "").alias("codes"))


@query(f"WITH {SQL_ROTATED}, qr AS (SELECT r AS q FROM r WHERE vec_id = 0), s AS (SELECT vec_id, list_dot_product(q, list_transform(r, lambda x: CASE WHEN x > 0.1227 THEN 0.1888 WHEN x > 0 THEN 0.0566 WHEN x > -0.1227 THEN -0.0566 ELSE -0.1888 END::DOUBLE)) AS c FROM r, qr) SELECT vec_id, round(c, 6) AS cosine FROM s ORDER BY c DESC, vec_id LIMIT 5")
def fast_cosine_topk(spark, d):
    import numpy as np

    x = S.read(spark, d, "embeddings").select("vec_id", V.codes_2bit("embedding").alias("codes"))
    return x.select("vec_id", V.code_cosine(np.array(_query_vector(spark, d)), F.col("codes")).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(5).withColumn("cosine", F.round("cosine", 6))


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.35")
def pairwise_cosine(spark, d):
    return memory.pairs_by_cosine(S.read(spark, d, "embeddings"), 0.35, "vec_id").withColumn("cosine", F.round("cosine", 6))


@query()
def qjl_signs(spark, d):
    return S.read(spark, d, "embeddings").select("vec_id", V.sign_bits_64("embedding").alias("bits"))


# Notes -----------------------------------------------------------------------------------------------------------
@query(f"WITH {SQL_MEMORIES} SELECT id, round(1 - (row_number() OVER (ORDER BY created_at DESC, id DESC) - 1) / (count(*) OVER ())::DOUBLE, 6) AS recency FROM memories")
def recency_rank(spark, d):
    return memory.recency_rank(S.memories(spark, d)).select("id", F.round("recency", 6).alias("recency"))


@query(f"""WITH {SQL_MEMORIES}, {SQL_Q}, n AS (SELECT * FROM memories ORDER BY created_at DESC, id DESC LIMIT 100),
s AS (SELECT id, created_at, 0.7 * list_cosine_similarity(embedding::DOUBLE[], q) + CASE WHEN contains(lower(content), 'the er') THEN 0.2 ELSE 0.2 * ((CASE WHEN contains(lower(content), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(content), 'er') THEN 1 ELSE 0 END)) / 2 END::DOUBLE
  + 0.05 * (1 - (row_number() OVER (ORDER BY created_at DESC, id DESC) - 1) / (count(*) OVER ())::DOUBLE) AS score FROM n, q),
t AS (SELECT * FROM s ORDER BY score DESC, created_at DESC, id DESC LIMIT 5) SELECT id, round(score, 6) AS score FROM t WHERE score > 0.15""")
def memory_recall(spark, d):
    return memory.recall(S.memories(spark, d), "the er", _query_vector(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {SQL_MEMORIES}, w AS (SELECT id, category, embedding::DOUBLE[] AS v, {SQL_TOKENS.format(c='content')} AS w FROM memories),
t AS MATERIALIZED (SELECT id, unnest(w) AS t, len(w) AS n FROM w),
i AS (SELECT a.id AS new_id, b.id AS old_id FROM t a JOIN t b ON a.t = b.t AND a.id <> b.id AND least(a.n, b.n) >= 0.5 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*))::DOUBLE >= 0.5
  UNION ALL SELECT a.id, b.id FROM w a JOIN w b ON a.id <> b.id WHERE len(a.w) = 0 AND len(b.w) = 0),
p AS (SELECT new_id, old_id, b.category AS c2, list_cosine_similarity(a.v, b.v) AS s FROM i JOIN w a ON a.id = new_id JOIN w b ON b.id = old_id),
b AS (SELECT new_id, arg_max(old_id, s) AS old_id, arg_max(c2, s) AS c2 FROM p GROUP BY new_id)
SELECT w.id AS new_id, CASE WHEN b.new_id IS NULL THEN 'inserted' WHEN c2 = category THEN 'merged' ELSE 'linked' END AS outcome, b.old_id FROM w LEFT JOIN b ON w.id = b.new_id""")
def memory_save_outcome(spark, d):
    """Each note against the others. The vectors at hand are unrelated to the texts, so the cosine gate is open here; tests hold the real gates."""
    m = S.memories(spark, d)
    return memory.save_outcomes(m, m, cosine=-1.0, jaccard=0.5)


@query(f"""WITH {SQL_MEMORIES}, m AS MATERIALIZED (SELECT id, string_split(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS t, length(content) AS n, embedding::DOUBLE[] AS v, year(created_at) * 365 + month(created_at) * 31 + day(created_at) AS day FROM memories),
p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS cosine, a.t AS ta, b.t AS tb, a.n AS na, b.n AS nb FROM m a JOIN m b ON a.id < b.id WHERE abs(a.day - b.day) >= 7 AND list_cosine_similarity(a.v, b.v) >= 0.35),
d AS (SELECT a, b, cosine, CASE WHEN greatest(na, nb) = 0 THEN 0 ELSE (len(list_filter(list_zip(ta[1:least(na, nb)], tb[1:least(na, nb)]), lambda x: x[1] <> x[2])) + abs(na - nb)) / greatest(na, nb)::DOUBLE END AS divergence FROM p)
SELECT a, b, round(cosine, 6) AS cosine, round(divergence, 6) AS divergence FROM d WHERE divergence >= 0.3""")
def contradiction_pairs(spark, d):
    return memory.contradictions(S.memories(spark, d), 0.35).select("a", "b", F.round("cosine", 6).alias("cosine"), F.round("divergence", 6).alias("divergence"))


# Streams ---------------------------------------------------------------------------------------------------------
@query("SELECT user_id AS path, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id")
def stream_debounce_compaction(spark, d):
    e = S.read(spark, d, "events")
    return events.compact_changes(e.select(F.col("user_id").alias("path"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq")))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type AS tool_name, count(*) AS calls, round(sum(value), 6) AS latency_ms FROM events GROUP BY 1, 2")
def stream_tool_windows(spark, d):
    """The events as a stream, driven to its end."""
    schema = S.read(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    calls = raw.select(F.col("event_type").alias("tool_name"), F.col("value").alias("latency_ms"), F.col("ts").cast("timestamp").alias("ts"))
    name = f"windows_{uuid.uuid4().hex}"
    at = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/quillmark"
    out = events.run_to_end(spark, events.tool_windows(calls), name, f"{at.rstrip('/')}/{name}")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


from quillmark.plans import context_catalog  # noqa: E402, F401  registers its queries here
