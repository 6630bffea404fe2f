"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

A text without its blanks is cut at content-defined places. Each chunk gets a 128-bit identifier, and the
identifiers are verified over the whole corpus: chunk texts are grouped once (partial aggregation first, so a chunk
of many copies leaves its task once), and if one identifier stood for two texts, all are dealt anew under another
seed. With identifiers one-to-one, two texts are equal exactly when their ordered identifier lists, the recipes, are
equal; from there on only recipes move, never texts.

Defined results: a null text counts as empty, and so do texts of blanks alone (all these are one group). Of equal
texts the row with the most code points stays, then the one with the smallest doc_id (a null doc_id loses); of
repeated rows that tie in both, one stays. doc_id is an integer. Empty tables give empty results. ``keep_one`` keeps all columns of docs;
helper columns get names that do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import materialise, table, unused

#: A chunk has LEAST to MOST characters and ends, from LEAST on, behind the first place that CUT describes.
#: CUT looks at characters only, so that an insertion moves boundaries near it alone.
LEAST, MOST = 256, 4096
CUT = "(?<=[aeiou][b-df-hj-np-tv-z]{2})(?=[a-m])|(?<=[0-9.,;:!?])(?=[A-Zn-z])"
SEEDS = 8


def normal(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; replace() searches bytes and is several times as fast as a regex."""
    out = F.coalesce(text, F.lit(""))
    for blank in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def chunks(text: Column, least: int = LEAST, most: int = MOST, cut: str = CUT) -> Column:
    """The text in content-defined pieces, in order (an empty array for an empty text)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{least}}}\\z|.{{{least},{most}}}?(?:{cut}|\\z)|.{{{most}}}"), F.lit(0))


def identifier(chunk: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), chunk).alias("a"), F.xxhash64(chunk, F.lit(~seed), F.length(chunk)).alias("b"))


def clashes(pieces: DataFrame, id_col: str, piece_col: str) -> int:
    """How many identifiers stand for two or more different pieces. Pieces are compared as bytes, by grouping."""
    distinct = pieces.groupBy(id_col, piece_col).agg(F.lit(1).alias("one"))
    return distinct.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").count()


def verified_seed(pieces: DataFrame, piece_col: str, make=identifier) -> int:
    """The first seed under which identifiers of these pieces are one-to-one."""
    for seed in range(SEEDS):
        if not clashes(pieces.select(make(F.col(piece_col), seed).alias("id"), F.col(piece_col).alias("piece")), "id", "piece"):
            return seed
    raise RuntimeError(f"no seed of {SEEDS} gives one-to-one identifiers")


def classes(docs: DataFrame, make=identifier) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    text = docs.select("doc_id", normal(F.col("text")).alias("norm"), F.char_length(F.coalesce("text", F.lit(""))).alias("points"))
    seed = verified_seed(text.select(F.explode(chunks(F.col("norm"))).alias("piece")), "piece", make)
    recipe = F.transform(chunks(F.col("norm")), lambda c: make(c, seed))
    rows = materialise(text.select("doc_id", "points", recipe.alias("recipe"), F.sha2("norm", 256).alias("text_sha256")), "recipes")
    first = F.struct("points", F.bitwise_not("doc_id").alias("low"))
    groups = rows.groupBy("recipe").agg(F.max(first).alias("top"), F.count("*").alias("group_size"))
    groups = groups.select("recipe", "group_size", F.bitwise_not("top.low").alias("keep_id"), F.col("top.points").alias("keep_points"))
    joined = rows.join(groups, "recipe")
    stays = joined.doc_id.eqNullSafe(joined.keep_id) & (joined.points == joined.keep_points)
    # Rows that tie with the one that stays share its doc_id and text; one of them is taken.
    one = Window.partitionBy("doc_id", "text_sha256", "stays").orderBy("points")
    out = joined.withColumn("stays", stays).withColumn("kept", F.col("stays") & (F.row_number().over(one) == 1))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame, make=identifier) -> DataFrame:
    """docs without all but one of each group of equal texts; columns as they are. What stays is decided on recipes;
    of the documents only ids are compared with it, unless rows share a doc_id, which then meet with their texts."""
    num, sha, points = unused(docs.columns, "q_num", "q_sha", "q_points")
    rows = materialise(classes(docs, make).select(F.col("doc_id").alias(num), F.col("text_sha256").alias(sha), "kept"), "classes")
    stay = rows.where("kept").drop("kept")
    if not rows.groupBy(num).count().where("count > 1").limit(1).count():
        return docs.join(stay.select(num), docs["doc_id"].eqNullSafe(F.col(num)), "left_semi")
    marked = docs.select("*", F.sha2(normal(F.col("text")), 256).alias(sha + "_"), F.char_length(F.coalesce("text", F.lit(""))).alias(points))
    found = marked.join(stay, marked["doc_id"].eqNullSafe(F.col(num)) & (F.col(sha + "_") == F.col(sha)))
    ranked = found.withColumn(num, F.row_number().over(Window.partitionBy("doc_id", sha).orderBy(F.desc(points))))
    return ranked.where(F.col(num) == 1).select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


#: DuckDB: rows of the same normal text, the longest original first, then the smallest doc_id.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
