"""Line dedup by content-defined line chunks, with DataFrame functions only.

A rolling hash over the hashes of a line and the one before it decides whether a chunk ends with the line, so
boundaries depend on two lines alone and move with inserted or deleted lines. Of every chunk of two or more lines
that are not blank, the first place in the corpus (by doc_id, then place in the document) stays and all others go.
Chunks are grouped by a 128-bit identifier that is first verified by comparing the chunks' bytes over the whole
corpus (see exact_dedup); no chunk text moves after that. Texts are cut once for this, and those that lose chunks again.

A short passage is only caught so if two boundaries fall inside it. ``dedup_runs`` leaves no run out: of every two
lines that are not blank and have at most blank lines between them, if the same two lines stand in that order at an
earlier place in the corpus, both go, with the blank lines between. So every run of two or more lines that was there
before goes whole, whatever its neighbours, and the first place of every line stays. Identifiers of lines are verified
as those of chunks are.

Defined results: a null text stays null and has no lines; an empty text is one blank line; rows that share a doc_id
are treated alike (the first place stays in each); null doc_ids come first; an empty table gives an empty result;
extra columns stay, and helper columns get names that do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import materialise, scratch, table, unused
from quillmark.llm.exact_dedup import identifier, verified_seed

#: A chunk ends where the rolling hash starts with a hex digit below this: every fourth line on average.
BELOW = "4"
LEAST_LINES = 2


def line_chunks(text: Column) -> Column:
    """The chunks of a text in order; joined by line feeds they are the text. One pass of array functions, each array built once."""
    lines = F.split(text, "\n")
    hashes = F.transform(lines, F.md5)
    before = F.concat(F.array(F.lit("")), F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))
    ends = F.zip_with(before, hashes, lambda a, b: F.substring(F.md5(F.concat(a, b)), 1, 1) < BELOW)
    # \x01\x01 marks the ends. \x01 in a text is followed by \x02 meanwhile.
    escaped = F.split(F.replace(text, F.lit("\x01"), F.lit("\x01\x02")), "\n")
    marked = F.zip_with(escaped, ends, lambda line, end: F.concat(line, F.when(end, "\x01\x01").otherwise("\n")))
    whole = F.array_join(marked, "")
    body = F.when(F.endswith(whole, F.lit("\x01\x01")), F.left(whole, F.char_length(whole) - 2)).otherwise(F.left(whole, F.char_length(whole) - 1))
    return F.transform(F.split(body, "\x01\x01"), lambda c: F.replace(c, F.lit("\x01\x02"), F.lit("\x01")))


def n_lines(chunk: Column) -> Column:
    return F.char_length(chunk) - F.char_length(F.replace(chunk, F.lit("\n"), F.lit(""))) + 1


def is_multi_line(chunk: Column) -> Column:
    """Whether LEAST_LINES or more lines of it are not blank. Lines end at "\\n" alone; one pass, without going back."""
    blank = r"[\x20\x09-\x0D]*+"
    return chunk.rlike(rf"\A{blank}(?:[^\n]*+\n{blank}){{{LEAST_LINES - 1}}}[^\x20\x09-\x0D]")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id and `gone`, the places (from 0) of the chunks that an earlier place in the corpus has too."""
    pieces = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(line_chunks(F.col("text"))).alias("place", "chunk"))
    # Cutting costs most by far, so the chunks are written once; verifying and naming them read that copy.
    with scratch(docs.sparkSession):
        pieces = materialise(pieces.where(is_multi_line(F.col("chunk"))), "line-pieces")
        seed = verified_seed(pieces, "chunk")
        places = materialise(pieces.select("doc_id", "place", identifier(F.col("chunk"), seed).alias("id")), "line-chunks", keep=True)
    many = places.groupBy("id").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("id2"), "first")
    gone = places.join(many, places["id"] == F.col("id2")).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place") == F.col("first.place"))))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("gone"))


def dedup_lines(docs: DataFrame, extra: tuple[str, str, str] = ("n_lines", "n_removed_lines", "removed_chunks")) -> DataFrame:
    """docs with the repeated chunks cut from text, and three more columns (named by `extra`)."""
    key, gone, parts = unused([*docs.columns, *extra], "q_key", "q_gone", "q_parts")
    found = repeated(docs).select(F.col("doc_id").alias(key), F.col("gone").alias(gone))
    rows = docs.join(found, docs["doc_id"].eqNullSafe(F.col(key)), "left").withColumn(gone, F.coalesce(gone, F.array().cast("array<int>")))
    rows = rows.withColumn(parts, F.when(F.size(gone) > 0, line_chunks(F.col("text"))))
    kept = F.filter(parts, lambda c, i: ~F.array_contains(gone, i))
    cut = F.filter(parts, lambda c, i: F.array_contains(gone, i))
    clean = F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    removed = F.coalesce(F.aggregate(cut, F.lit(0), lambda n, c: n + n_lines(c)), F.lit(0)).cast("long")
    lines = F.coalesce(n_lines(F.col("text")), F.lit(0)).cast("long")
    return rows.select(*(clean.alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns), lines.alias(extra[0]), removed.alias(extra[1]), F.array_join(gone, ",").alias(extra[2]))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "removed_chunks", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id and `gone`, the places (from 0) of the lines of pairs that an earlier place in the corpus has too."""
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    full = F.filter(numbered, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    lines = docs.where(F.col("text").isNotNull()).select("doc_id", full.alias("full"))
    seed = verified_seed(lines.select(F.explode("full.line").alias("line")), "line")
    ids = materialise(lines.select("doc_id", F.transform("full", lambda x: F.struct(x["at"].alias("at"), identifier(x["line"], seed).alias("id"))).alias("ids")).where(F.size("ids") > 1), "line-ids")
    less = F.size("ids") - 1
    pairs = F.zip_with(F.slice("ids", F.lit(1), less), F.slice("ids", F.lit(2), less), lambda x, y: F.struct(x["at"].alias("at"), y["at"].alias("last"), F.struct(x["id"].alias("x"), y["id"].alias("y")).alias("id")))
    places = ids.select("doc_id", F.inline(pairs))
    many = places.groupBy("id").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("id2"), "first")
    gone = places.join(many, places["id"] == F.col("id2")).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))))
    runs = gone.groupBy("doc_id").agg(F.collect_set(F.struct("at", "last")).alias("runs"))
    return runs.select("doc_id", F.sort_array(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["last"]))))).alias("gone"))


def dedup_runs(docs: DataFrame, extra: tuple[str, str, str] = ("n_lines", "n_removed_lines", "removed_lines")) -> DataFrame:
    """docs with the repeated runs of lines cut from text, and three more columns (named by `extra`)."""
    key, gone, size, cut = unused([*docs.columns, *extra], "q_key", "q_gone", "q_size", "q_cut")
    found = repeated_runs(docs).select(F.col("doc_id").alias(key), F.col("gone").alias(gone))
    rows = docs.join(found, docs["doc_id"].eqNullSafe(F.col(key)), "left").withColumn(gone, F.coalesce(gone, F.array().cast("array<int>")))
    # Rows that share a doc_id may have fewer lines than the places found in the others.
    rows = rows.withColumn(size, F.coalesce(n_lines(F.col("text")), F.lit(0))).withColumn(cut, F.filter(gone, lambda i: i < F.col(size)))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    clean = F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return rows.select(*(clean.alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns), F.col(size).cast("long").alias(extra[0]), F.size(cut).cast("long").alias(extra[1]), F.array_join(cut, ",").alias(extra[2]))


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "removed_lines", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, lag(md5(line), 1, '') OVER w AS before FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
e AS (SELECT doc_id, line, n, CASE WHEN substr(md5(before || md5(line)), 1, 1) < '4' THEN 1 ELSE 0 END AS ends FROM h),
c AS (SELECT doc_id, line, n, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM e),
k AS (SELECT doc_id, place, string_agg(line, chr(10) ORDER BY n) AS chunk, count(*) AS lines, count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS full_lines FROM c GROUP BY doc_id, place),
f AS (SELECT *, CASE WHEN full_lines >= 2 THEN row_number() OVER (PARTITION BY chunk ORDER BY doc_id, place) > 1 ELSE false END AS again FROM k),
g AS (SELECT doc_id, string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT again) AS kept, sum(lines) AS n_lines,
        coalesce(sum(lines) FILTER (again), 0) AS n_removed_lines, coalesce(string_agg(CAST(CAST(place AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (again), '') AS removed_chunks
      FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(g.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n_removed_lines, 0) AS BIGINT) AS n_removed_lines, coalesce(g.removed_chunks, '') AS removed_chunks,
  CAST(CASE WHEN text IS NULL THEN NULL ELSE length(coalesce(kept, '')) END AS BIGINT) AS kept_chars, CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

OP9_RUNS_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, line, n, lead(line) OVER w AS next, lead(n) OVER w AS last FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
r AS (SELECT doc_id, n, last, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, n) > 1 AS again FROM p WHERE last IS NOT NULL),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(n, last)) AS n FROM r WHERE again),
g AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.n) FILTER (x.n IS NULL) AS kept, count(*) AS n_lines, count(x.n) AS n_removed_lines,
        coalesce(string_agg(CAST(x.n AS VARCHAR), ',' ORDER BY x.n) FILTER (x.n IS NOT NULL), '') AS removed_lines
      FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.n = x.n GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(g.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n_removed_lines, 0) AS BIGINT) AS n_removed_lines, coalesce(g.removed_lines, '') AS removed_lines,
  CAST(CASE WHEN text IS NULL THEN NULL ELSE length(coalesce(kept, '')) END AS BIGINT) AS kept_chars, CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
