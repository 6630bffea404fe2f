"""Roll-ups of tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T


def by_tool(calls: DataFrame) -> DataFrame:
    empty = F.sum(F.when(F.col("result_count") == 0, 1).otherwise(0))
    return calls.groupBy("tool_name").agg(F.count("*").alias("calls"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), empty.cast("long").alias("empty"), F.round(100.0 * empty / F.count("*"), 6).alias("empty_pct")).orderBy(F.desc("calls"), "tool_name")


def top_empty(calls: DataFrame, k: int = 5) -> DataFrame:
    """The k queries that most often found nothing, by hash."""
    rows = calls.where((F.col("result_count") == 0) & F.col("query").isNotNull()).groupBy("query").agg(F.count("*").alias("n"))
    return rows.select(T.fnv1a64_hex(F.col("query")).alias("query_hash"), "n").orderBy(F.desc("n"), "query_hash").limit(k)


def since(calls: DataFrame, ts: str) -> DataFrame:
    return calls.where(F.col("ts") >= F.to_timestamp(F.lit(ts))).agg(F.count("*").alias("calls"))
