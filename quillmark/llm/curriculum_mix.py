"""Mixing sources to target weights as a time-varying curriculum, with DataFrame functions only.

Every source has a weight schedule over training time t in [0, 1], a line from `start` to `end`. Its integral is the
cumulative token demand; inverting it gives each taken copy of a document the training position at which its share
of the source is due. Documents are then range-sorted by position.

Targets: weights are dealt to the sources in code-point order (null last) and share `total` of all sizes; a source
stops at `cap` times its size and its excess is reshared by weight. As sources that stop stay stopped, that ends in
target = min(cap * size, level * weight), found by one pass over the sources sorted by size / weight.

Within a source documents stand in the order of a digest of doc_id. Running sums over that order are taken in two
steps, within buckets of the digest and over the buckets, so that a source of any share spreads over many tasks. A
document is taken floor(target / size) times, and once more if the middle of its place lies within the rest of the
target; the taken words of a source miss its target by half a document at most.

Defined results: null text has size 0 and is taken 0 words; a null source is a source of its own, the last; rows
repeated or tied in digest follow one another in order of doc_id and size; an empty table gives an empty result;
extra columns are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import WORD, materialise, table, unused

WEIGHTS = (3, 1, 2)
TOTAL, CAP = 1.5, 2
#: start and end of the weight schedules, dealt in turn like the weights: early, even, late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Hex digits of the digest that name a bucket: 4096 buckets a source.
DIGITS = 3
#: Words that a task of the mixed documents holds, on average: some 50 MB of text.
TASK_WORDS = 8_000_000


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """source, source_size, target, start, end for each source of (source, size). One row per source is sorted, no document."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    turn = F.array(*map(F.lit, weights))
    per = per.withColumn("rank", rank).withColumn("weight", F.get(turn, F.col("rank") % len(weights)))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    per = per.withColumns({
        "capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)),  # sizes of the sources that stop earlier
        "spent": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "all": F.sum("source_size").over(everyone),
        "weights": F.sum("weight").over(everyone),
    })
    level = (F.lit(total) * F.col("all") - F.lit(cap) * F.col("capped")) / (F.col("weights") - F.col("spent"))
    per = per.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") >= F.lit(float(cap)) * F.col("source_size"))
    final = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(everyone)
    capped = F.lit(float(cap)) * F.col("source_size")
    plan = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in schedules))
    return per.select("source", "source_size", F.when(F.col("stops"), capped).otherwise(final["level"] * F.col("weight")).alias("target"), F.get(plan, F.col("rank") % len(schedules)).alias("plan"))


def due(share: Column, start: Column, end: Column) -> Column:
    """t at which the integral of the line from start to end has reached `share` of its whole."""
    slope = end - start
    whole = (start + end) / 2
    root = (F.sqrt(start * start + 2 * slope * share * whole) - start) / slope
    return F.when(slope == 0, share).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), root)))


def places(sizes: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, any columns) with source_size, target, copies, taken and positions, one for each copy."""
    per = targets(sizes.select("source", "size"), **options)
    rows = sizes.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("bucket", F.substring("digest", 1, DIGITS))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    sums = sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), ahead.alias("ahead"))
    per = per.withColumnRenamed("source", "s3")
    starts = sums.join(F.broadcast(per) if _few(per) else per, F.col("s2").eqNullSafe(F.col("s3"))).drop("s3")
    inside = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size")
    rows = rows.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(starts, rows["source"].eqNullSafe(F.col("s2")) & (rows["bucket"] == F.col("b2")))
    place = F.col("ahead") + F.col("inside")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    rows = rows.withColumn("place", place).withColumn("whole", whole)
    more = F.when((F.col("rest") > 0) & (2 * F.col("place") + F.col("size") <= 2 * F.col("rest")), 1).otherwise(0)
    rows = rows.withColumn("rest", rest).withColumn("copies", F.col("whole") + more)
    # Copy k of a document stands k whole rounds of the source further on.
    share = lambda k: F.least(F.lit(1.0), (k * F.col("source_size") + F.col("place") + F.col("size") / 2) / F.col("target"))
    at = F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), lambda k: due(share(k), F.col("plan.start"), F.col("plan.end")))
    rows = rows.withColumn("positions", F.when((F.col("copies") > 0) & (F.col("target") > 0), at).otherwise(F.array().cast("array<double>")))
    return rows.withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).drop("digest", "bucket", "b2", "s2", "ahead", "inside", "place", "whole", "rest", "plan")


def _few(per: DataFrame, most: int = 50_000) -> bool:
    """Whether so few sources exist that a broadcast of them is small; else the join is left to shuffle."""
    return per.limit(most + 1).count() <= most


def ordered(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row for each copy, range-sorted by position (ties by doc_id), into that many tasks or as adaptive execution sees fit."""
    return rows.withColumn("position", F.explode("positions")).repartitionByRange(*([tasks] if tasks else []), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Copies of docs in training order: its columns alone, as often as the mix takes each row.

    Places are computed and range-sorted as ids and sizes; texts move twice then, to their ids and on to the task that
    their position belongs to, whatever the size. Only if rows share a doc_id do they carry their texts through."""
    keep, key, part, at = unused(docs.columns, "row", "q_key", "q_part", "q_at")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        flat = ordered(places(docs.select(F.struct("*").alias(keep), "doc_id", "source", size(F.col("text")).alias("size")), **options))
        return flat.select(*(F.col(keep).getField(c).alias(c) for c in docs.columns))
    sizes = materialise(docs.select("doc_id", "source", size(F.col("text")).alias("size")), "sizes")
    taken = materialise(places(sizes, **options).where("size(positions) > 0").select("doc_id", "positions", "taken"), "taken")
    # Ranges are as many as the words that they will hold ask for; ids alone would fit into a few.
    tasks = max(1, -(-(taken.agg(F.sum("taken")).first()[0] or 0) // TASK_WORDS))
    flat = ordered(taken, tasks).select(F.col("doc_id").alias(key), F.spark_partition_id().alias(part), F.col("position").alias(at))
    flat = materialise(flat, "positions")
    dealt = docs.join(flat, docs["doc_id"].eqNullSafe(F.col(key))).repartitionById(tasks, part)
    return dealt.sortWithinPartitions(at, "doc_id").select(*docs.columns)


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = materialise(docs.select("doc_id", "source", size(F.col("text")).alias("size")), "sizes")
    out = places(sizes).select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document that the mix takes, once for each time it is taken, in training order."""
    return mix(docs)


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CASE rank % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS a,
        CASE rank % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS b FROM s),
l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, level * weight >= 2.0::DOUBLE * source_size AS stops FROM l),
f AS (
  SELECT source, source_size, a, b, CASE WHEN stops THEN 2.0::DOUBLE * source_size
    ELSE weight * (SELECT level FROM t WHERE NOT stops ORDER BY source_size::DOUBLE / weight, rank LIMIT 1) END AS target FROM t),
p AS (
  SELECT doc_id, size, source_size, target, a, b,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
c AS (
  SELECT *, whole + CASE WHEN target - whole * source_size > 0 AND 2 * place + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END AS copies,
         least(1.0::DOUBLE, (place + size / 2.0::DOUBLE) / target) AS share FROM p)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies > 0 AND target > 0 THEN round(CASE WHEN a = b THEN share
    ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (sqrt(a * a + 2 * (b - a) * share * ((a + b) / 2)) - a) / (b - a))) END, 9) END AS position
FROM c
"""
