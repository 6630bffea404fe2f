"""Relations of the engine, mapped from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.format_string("%s/%s/doc_%d.txt", "source", "lang", "doc_id").alias("relative_path"), F.col("lang").alias("extension"), F.octet_length("text").cast("long").alias("size_bytes"), T.line_count(F.col("text")).cast("long").alias("line_count"), F.col("text").alias("content"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a source in one of five languages, by doc_id, that imports the two documents 5 and 10 before it and holds the text."""
    d = read(spark, sf_dir, "documents")
    forms = [
        ("py", "lib/doc_%1$d.py", "import lib.doc_%2$d, lib.doc_%3$d\n"),
        ("ts", "web/doc_%1$d.ts", "import a from './doc_%2$d'\nimport b from '/web/doc_%3$d'\n"),
        ("rs", "src/doc_%1$d.rs", "use crate::doc_%2$d;\nmod doc_%3$d;\n"),
        ("go", "app/pkg/p%1$d/doc.go", 'import (\n  "pkg/p%2$d"\n  x "app/pkg/p%3$d" // the second\n)\n'),
        ("hxx", "c/doc_%1$d.hxx", '#include "doc_%2$d.hxx"\n#include "c/doc_%3$d.hxx"\n'),
    ]
    pick = lambda make: F.element_at(F.array(*map(make, forms)), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    fill = lambda form: F.format_string(form, "doc_id", F.col("doc_id") - 5, F.col("doc_id") - 10)
    return d.select(pick(lambda f: fill(f[1])).alias("relative_path"), pick(lambda f: F.lit(f[0])).alias("extension"), F.concat(pick(lambda f: fill(f[2])), F.coalesce("text", F.lit(""))).alias("content"))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts in all pages."""
    found = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"))).alias("n", "content"))
    return found.select(F.format_string("page_%d/%d.js", "page_id", "n").alias("relative_path"), F.lit("js").alias("extension"), "content")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), F.lit(1).alias("start_line"), (F.col("p_size") + 1).alias("end_line"), F.concat_ws(" ", "p_name", "p_brand").alias("signature"), F.col("p_brand").alias("relative_path"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("tool_name"), F.col("props").alias("query"), F.length("props").alias("query_length"), F.when(F.col("event_type") == "error", 0).alias("result_count"), F.col("value").alias("latency_ms"), F.col("ts").cast("timestamp").alias("ts"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes: documents that have an embedding, dated by events a stride apart."""
    d, v, e = (read(spark, sf_dir, n) for n in ("documents", "embeddings", "events"))
    n = e.agg(F.count("*").alias("n"))
    keyed = v.crossJoin(F.broadcast(n)).select(F.col("vec_id").alias("doc_id"), "embedding", F.pmod(F.col("vec_id") * 7919, F.col("n")).alias("event_id"))  # n is one row
    return d.join(keyed, "doc_id").join(e.select("event_id", F.col("ts").alias("created_at")), "event_id").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("category"), F.col("lang").alias("tags"), "created_at", "embedding")


#: The same relations in DuckDB.
SQL_FILES = """files AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS relative_path, lang AS extension, CAST(strlen(text) AS BIGINT) AS size_bytes,
  CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END END AS BIGINT) AS line_count, text AS content FROM documents)"""
SQL_SYMBOLS = "symbols AS (SELECT p_partkey AS symbol_id, p_name AS name, lower(p_type) AS kind, 1 AS start_line, p_size + 1 AS end_line, p_name || ' ' || p_brand AS signature, p_brand AS relative_path FROM part)"
SQL_MEMORIES = "memories AS (SELECT d.doc_id AS id, d.text AS content, d.source AS category, d.lang AS tags, e.ts AS created_at, v.embedding FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id JOIN events e ON e.event_id = (v.vec_id * 7919) % (SELECT count(*) FROM events))"
