"""Queries over source files, contexts, lookups, quantised blobs and notes as tables; registered in the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmark.functions import code as C
from quillmark.functions import codec
from quillmark.functions import text as T
from quillmark.operators import context, index, lookup, memory, search
from quillmark.plans.catalog import ORACLE_SQL, QUERY, SQL_EST, SQL_Q, SQL_ROTATED, _query_vector, query
from quillmark.sources import tables as S
from quillmark.sources import tree
from quillmark.sources.tables import SQL_FILES, SQL_MEMORIES, SQL_SYMBOLS

SQL_SOURCES = """sources AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'lib/doc_' || doc_id || '.py' WHEN 1 THEN 'web/doc_' || doc_id || '.ts' WHEN 2 THEN 'src/doc_' || doc_id || '.rs' WHEN 3 THEN 'app/pkg/p' || doc_id || '/doc.go' ELSE 'c/doc_' || doc_id || '.hxx' END AS relative_path,
  CASE doc_id % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'ts' WHEN 2 THEN 'rs' WHEN 3 THEN 'go' ELSE 'hxx' END AS extension,
  CASE doc_id % 5 WHEN 0 THEN 'import lib.doc_' || (doc_id - 5) || ', lib.doc_' || (doc_id - 10) || chr(10)
    WHEN 1 THEN 'import a from ''./doc_' || (doc_id - 5) || '''' || chr(10) || 'import b from ''/web/doc_' || (doc_id - 10) || '''' || chr(10)
    WHEN 2 THEN 'use crate::doc_' || (doc_id - 5) || ';' || chr(10) || 'mod doc_' || (doc_id - 10) || ';' || chr(10)
    WHEN 3 THEN 'import (' || chr(10) || '  "pkg/p' || (doc_id - 5) || '"' || chr(10) || '  x "app/pkg/p' || (doc_id - 10) || '" // the second' || chr(10) || ')' || chr(10)
    ELSE '#include "doc_' || (doc_id - 5) || '.hxx"' || chr(10) || '#include "c/doc_' || (doc_id - 10) || '.hxx"' || chr(10) END || coalesce(text, '') AS content FROM documents)"""
#: Lines without their ends, and with blanks around them cut.
SQL_LINES = r"list_transform(CASE WHEN {c} = '' THEN [] WHEN suffix({c}, chr(10)) THEN string_split({c}, chr(10))[:-2] ELSE string_split({c}, chr(10)) END, lambda x: regexp_replace(x, '\r$', ''))"
SQL_TRIMMED = r"list_transform(" + SQL_LINES + r", lambda x: regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'))"
_SIZE = "CASE WHEN {n} < 1024 THEN {n} || 'B' WHEN {n} < 1048576 THEN printf('%.1fKB', round_even({n} / 1024.0::DOUBLE, 1)) ELSE printf('%.1fMB', round_even({n} / 1048576.0::DOUBLE, 1)) END"


def _heads(**by_ext: str) -> str:
    """SQL condition on a trimmed line x and its extension: it starts with one of the heads, given with '|' between them."""
    return "CASE extension " + " ".join(f"WHEN '{e}' THEN " + " OR ".join(f"prefix(x, '{h}')" for h in heads.split("|")) for e, heads in by_ext.items()) + " ELSE false END"


_IMPORT = _heads(py="import |from ", ts="import ", rs="use |mod ", go="import ", hxx="#include").replace("WHEN 'ts' THEN prefix(x, 'import ')", "WHEN 'ts' THEN prefix(x, 'import ') OR (prefix(x, 'const ') AND contains(x, 'require('))")
_DEFINITION = _heads(py="def |class ", ts="export |function |class |const |async function ", rs="pub |fn |struct |enum |trait |impl ")
_SYMBOL = _heads(py="def |class |async def ", ts="export |function |class |const |async function |interface |type |enum ", rs="pub |fn |struct |enum |trait |impl ", go="func |type ")


@query(f"WITH {SQL_SOURCES}, t AS (SELECT relative_path, extension, {SQL_TRIMMED.format(c='content')} AS l FROM sources) SELECT relative_path, " + ", ".join(f"CAST(len(list_filter(l, lambda x: {c})) AS BIGINT) AS {n}" for n, c in (("imports", _IMPORT), ("definitions", _DEFINITION), ("symbols", _SYMBOL))) + " FROM t")
def line_kinds_by_language(spark, d):
    """Import, definition and symbol lines of all documents as sources in five languages."""
    rows = F.transform(C.lines(F.col("content")), C.trim)
    n = lambda kind: F.size(F.filter(rows, lambda x: kind(x, F.col("extension")))).cast("long")
    return S.sources(spark, d).select("relative_path", n(C.is_import).alias("imports"), n(C.is_definition).alias("definitions"), n(C.is_symbol).alias("symbols"))


@query(rf"WITH {SQL_SOURCES}, t AS (SELECT relative_path, extension, content, {SQL_LINES.format(c='content')} AS l, CASE WHEN extension = 'py' THEN '#' WHEN extension IN ('ts', 'rs', 'go') THEN '//' END AS mark FROM sources) SELECT relative_path, md5(CASE WHEN mark IS NULL THEN content ELSE array_to_string(list_filter(l, lambda x: regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') <> '' AND (NOT prefix(regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), mark) OR prefix(regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), '// ...'))), chr(10)) END) AS stripped FROM t")
def comments_stripped(spark, d):
    return S.sources(spark, d).select("relative_path", F.md5(C.strip_comments(F.col("content"), F.col("extension"))).alias("stripped"))


@query("SELECT CASE doc_id % 5 WHEN 0 THEN 'lib/doc_' || doc_id || '.py' WHEN 1 THEN 'web/doc_' || doc_id || '.ts' WHEN 2 THEN 'src/doc_' || doc_id || '.rs' END AS relative_path, CASE doc_id % 5 WHEN 0 THEN 'lib.doc_' || (doc_id - 5) WHEN 1 THEN 'doc_' || (doc_id - 5) || ',doc_' || (doc_id - 10) ELSE 'crate' END AS names FROM documents WHERE doc_id % 5 < 3")
def module_names_of_heads(spark, d):
    """The modules that the import lines at the start of the sources in Python, TypeScript and Rust name (the first two lines)."""
    first = F.transform(F.slice(C.lines(F.col("content")), 1, F.when(F.col("extension") == "py", 1).otherwise(2)), C.trim)
    rows = S.sources(spark, d).where(F.col("extension").isin("py", "ts", "rs"))
    return rows.select("relative_path", F.array_join(C.module_names(F.filter(first, lambda x: C.is_import(x, F.col("extension"))), F.col("extension")), ",").alias("names"))


@query(f"WITH {SQL_FILES}, o AS (SELECT doc_id, relative_path, replace(content, chr(10), ' ') AS flat, content FROM files) SELECT doc_id, md5(CASE WHEN length(flat) > 200 THEN flat[1:200] || '...' ELSE flat END) AS oneline, md5(relative_path || ' ' || content[1:500]) AS summary, CASE WHEN regexp_matches(content, '\"[^\"]*\"') THEN regexp_extract(content, '\"([^\"]*)\"', 1) WHEN regexp_matches(content, '''[^'']*''') THEN regexp_extract(content, '''([^'']*)''', 1) END AS quoted, relative_path[1:length(relative_path) - length(split_part(relative_path, '/', 3)) - 1] AS folder, split_part(relative_path, '/', 3) AS base FROM o")
def short_texts(spark, d):
    p, c = F.col("relative_path"), F.col("content")
    return S.files(spark, d).select("doc_id", F.md5(C.oneline(c)).alias("oneline"), F.md5(C.summary_text(p, c)).alias("summary"), C.first_quoted(c).alias("quoted"), C.folder(p).alias("folder"), C.base(p).alias("base"))


@query(f"WITH {SQL_FILES}, f AS (SELECT relative_path, split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2) AS folder, size_bytes AS n FROM files) SELECT relative_path, CASE WHEN folder IS DISTINCT FROM lag(folder) OVER (PARTITION BY split_part(relative_path, '/', 1) ORDER BY relative_path) THEN folder || '/' END AS header, split_part(relative_path, '/', 3) || ' (' || {_SIZE.format(n='n')} || ')' AS label FROM f")
def file_listing(spark, d):
    return context.listing(S.files(spark, d), 3)


@query(f"WITH {SQL_FILES}, f AS (SELECT doc_id, extension, relative_path, split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2) AS folder FROM files) SELECT doc_id, CASE WHEN folder = lag(folder) OVER (PARTITION BY extension ORDER BY doc_id) THEN split_part(relative_path, '/', 3) ELSE relative_path END AS shown FROM f")
def grouped_paths(spark, d):
    return context.short_paths(S.files(spark, d), "relative_path", "doc_id", "extension").select("doc_id", "shown")


@query(f"WITH {SQL_FILES}, h AS (SELECT doc_id, relative_path, content, size_bytes, '# ' || relative_path || ' (' || len({SQL_LINES.format(c='content')}) || ' lines)' || chr(10) || chr(10) AS head, {SQL_EST.format(c='content')} AS tokens FROM files) SELECT relative_path, md5(head || CASE WHEN size_bytes > 400 THEN content[1:400] || chr(10) || chr(10) || '... [TRUNCATED — showing ~100 of ~' || tokens || ' tokens. Use ''smart'' mode or get_symbol for specific functions]' || chr(10) ELSE content END) AS shown FROM h")
def context_full(spark, d):
    return context.read_context(S.files(spark, d), "full", 100).select("relative_path", F.md5("shown").alias("shown"))


@query(f"WITH {SQL_SYMBOLS} SELECT symbol_id FROM symbols WHERE lower(name) = (SELECT lower(p_name) FROM part ORDER BY p_partkey LIMIT 1) AND relative_path ILIKE '%brand#%'")
def symbol_exact_with_hint(spark, d):
    s = S.symbols(spark, d)
    name = S.read(spark, d, "part").orderBy("p_partkey").select("p_name").first()[0]  # one name, as a caller would give it
    return lookup.exact(s, name, "Brand#").select("symbol_id")


@query(f"WITH {SQL_SYMBOLS} SELECT name, relative_path, start_line, end_line FROM symbols WHERE contains(lower(name), 'ring') ORDER BY relative_path, start_line, end_line, kind LIMIT 5")
def symbol_similar(spark, d):
    return lookup.similar(S.symbols(spark, d), "ring").select("name", "relative_path", "start_line", "end_line")


@query(f"SELECT DISTINCT symbol_id FROM (SELECT symbol_id FROM ({ORACLE_SQL['like_symbol_search']}) UNION SELECT symbol_id FROM ({ORACLE_SQL['phrase_prefix_match'].replace('small ri', 'small ring')}))")
def phrase_or_word_candidates(spark, d):
    return search.candidates(S.symbols(spark, d), QUERY).select("symbol_id")


@query(f"""WITH {SQL_FILES}, l AS (SELECT relative_path, {SQL_LINES.format(c='content')} AS l FROM files WHERE size_bytes <= 1000000),
h AS (SELECT relative_path, list_filter(range(1, len(l) + 1), lambda i: contains(lower(l[i]), 'doc_1')) AS hits FROM l),
s AS (SELECT relative_path AS path, (CASE WHEN contains(lower(relative_path), 'doc_1') THEN 5 ELSE 0 END + len(hits))::DOUBLE AS score, array_to_string(hits[1:3], ',') AS lines FROM h),
f AS (SELECT * FROM s WHERE score > 0 ORDER BY path LIMIT 500)
SELECT CAST(row_number() OVER (ORDER BY score DESC, path) AS INTEGER) AS rank, path, score, lines FROM f ORDER BY score DESC, path LIMIT 10""")
def live_search(spark, d):
    return lookup.live_search(S.files(spark, d), "doc_1", 10)


@query(f"WITH {SQL_SOURCES}, e AS (SELECT doc_id - k AS t FROM documents, (VALUES (5), (10)) x(k)) SELECT relative_path, (SELECT count(*) FROM e WHERE t = doc_id) AS import_count FROM sources")
def centrality_pipeline(spark, d):
    """Imports extracted, resolved and counted, and the counts written back to all files."""
    return index.centrality_of(S.sources(spark, d)).select("relative_path", "import_count")


@query(f"SELECT count(*) FILTER (status IN ('new', 'changed')) AS indexed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'stale') AS removed FROM ({ORACLE_SQL['changed_files_diff']})")
def index_run_statistics(spark, d):
    from quillmark.plans import catalog

    return index.run_statistics(catalog.changed_files_diff(spark, d))


@query(f"WITH {SQL_SOURCES} SELECT relative_path, extension, CAST(strlen(content) AS BIGINT) AS size_bytes, md5(content) AS content_md5 FROM sources WHERE extension <> 'hxx'")
def project_tree(spark, d):
    """All documents as sources, written as a project in the shared folder and read back as one (.hxx files are no source files there)."""
    at = (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/quillmark").removeprefix("file://").rstrip("/") + f"/tree-{uuid.uuid4().hex}"
    tree.write_tree(S.sources(spark, d), at)
    return tree.tree(spark, at).select("relative_path", "extension", "size_bytes", F.md5("content").alias("content_md5"))


@query("SELECT vec_id, 2 AS bits, 0 AS mode, 64 AS dim, 64 AS padded, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 3) AS norm, 35 AS n_bytes FROM embeddings")
def quantised_blob(spark, d):
    blob = S.read(spark, d, "embeddings").select("vec_id", codec.to_blob("embedding").alias("blob"))
    back = blob.select("vec_id", codec.from_blob("blob").alias("b"), F.octet_length("blob").alias("n_bytes"))
    return back.select("vec_id", "b.bits", "b.mode", "b.dim", "b.padded", F.round(F.col("b.norm").cast("double"), 3).alias("norm"), "n_bytes")


@query(f"WITH {SQL_ROTATED} SELECT vec_id, 35 AS n_bytes, round(sqrt(1 + 0.7979::DOUBLE * 0.7979 - 2 * 0.7979::DOUBLE / 8 * list_sum(list_transform(r, lambda x: abs(x)))), 3) AS residual_norm FROM r")
def quantised_blob_unbiased(spark, d):
    """Two bits in the unbiased mode: one for the code, one for the sign of a projection of the rest, whose norm follows from the signs of the rotated vector."""
    blob = S.read(spark, d, "embeddings").select("vec_id", codec.to_blob("embedding", 2, codec.UNBIASED).alias("blob"))
    return blob.select("vec_id", F.octet_length("blob").alias("n_bytes"), F.round(codec.from_blob("blob")["residual_norm"].cast("double"), 3).alias("residual_norm"))


@query("SELECT b AS bits, 384 AS dim, CAST((384 * greatest(1, b - 1) + 7) // 8 + 48 + 8 AS INTEGER) AS total_bytes FROM (VALUES (1), (2), (3), (4)) t(b)")
def storage_sizes(spark, d):
    return spark.createDataFrame([(b, 384, codec.storage(b, 384)["total_bytes"]) for b in (1, 2, 3, 4)], "bits int, dim int, total_bytes int")


@query(f"""WITH {SQL_MEMORIES}, {SQL_Q}, n AS (SELECT *, CASE WHEN id % 2 = 0 THEN epoch(created_at) + 86400.0 * id END AS last FROM memories ORDER BY created_at DESC, id DESC LIMIT 100),
s AS (SELECT id, created_at, 0.7 * list_cosine_similarity(embedding::DOUBLE[], q) + CASE WHEN contains(lower(content), 'the') THEN 0.2 ELSE 0 END::DOUBLE
  + 0.05 * (1 - (row_number() OVER (ORDER BY created_at DESC, id DESC) - 1) / (count(*) OVER ())::DOUBLE) + 0.05 * CASE WHEN last IS NULL THEN 0 ELSE 1 / (1 + greatest(0, (4000000000 - last) / 86400.0) / 30) END::DOUBLE AS score FROM n, q),
t AS (SELECT * FROM s ORDER BY score DESC, created_at DESC, id DESC LIMIT 20) SELECT id, round(score, 6) AS score FROM t WHERE score > 0.15""")
def memory_recall_accessed(spark, d):
    """Recall where every second note was accessed some days after it was made."""
    notes = S.memories(spark, d)
    last = F.when(F.col("id") % 2 == 0, F.unix_timestamp(F.col("created_at").cast("timestamp")) + 86400 * F.col("id"))
    return memory.recall(notes.withColumn("last_accessed_at", last), "the", _query_vector(spark, d), 20, now=4_000_000_000).select("id", F.round("score", 6).alias("score"))


@query(f"WITH c AS ({ORACLE_SQL['contradiction_pairs']}), {SQL_MEMORIES}, t AS (SELECT a, b, cosine, divergence FROM c ORDER BY cosine DESC, a, b LIMIT 20) SELECT CASE WHEN (x.created_at, a) <= (y.created_at, b) THEN a ELSE b END AS older_id, CASE WHEN (x.created_at, a) <= (y.created_at, b) THEN b ELSE a END AS newer_id, cosine AS similarity, divergence FROM t JOIN memories x ON x.id = a JOIN memories y ON y.id = b")
def contradiction_review(spark, d):
    best = memory.contradiction_review(S.memories(spark, d), 20, 0.35)
    return best.select("older_id", "newer_id", F.round("similarity", 6).alias("similarity"), F.round("divergence", 6).alias("divergence"))
