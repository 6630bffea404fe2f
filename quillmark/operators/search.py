"""Ranked retrieval over files and symbols: candidates, scores, accumulation, re-ranking, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import constants as K
from quillmark.functions import text as T
from quillmark.functions import vector as V


def query_words(query: str) -> list[str]:
    return [w for w in query.lower().split() if len(w.encode()) >= 2]


def phrase_prefix(symbols: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Symbols whose name or signature holds the query's tokens in a row, the last as a prefix."""
    import re

    tokens = [t for t in re.split(r"[^\w]+|_", query.lower()) if t]
    if not tokens:
        return symbols.limit(0)
    pattern = "(^| )" + " ".join(tokens)
    flat = lambda c: F.array_join(F.filter(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != ""), " ")
    return symbols.where(flat(F.col("name")).rlike(pattern) | flat(F.col("signature")).rlike(pattern)).orderBy("symbol_id").limit(limit)


def like_words(symbols: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Symbols whose name holds a word of the query, `limit` of each word by name."""
    words = F.explode(F.array(*map(F.lit, query_words(query)))).alias("word")
    hits = symbols.select("*", words).where(F.contains(F.lower("name"), F.col("word")))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("name", "symbol_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit)


def candidates(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols that the phrase or a word of the query finds, each once."""
    ids = phrase_prefix(symbols, query).select("symbol_id").unionByName(like_words(symbols, query).select("symbol_id")).distinct()
    return symbols.join(ids, "symbol_id", "left_semi")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def name_score(name: Column, query: str) -> Column:
    q, words = query.lower(), query_words(query)
    low = F.lower(name)
    share = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) / max(1, len(words))
    partly = F.lit(K.SUBSTRING_NAME) * share if len(words) > 1 else F.lit(0.0)
    return F.when(low == q, K.EXACT_NAME).when(F.contains(low, F.lit(q)), K.SUBSTRING_NAME).otherwise(partly)


def symbol_score(symbols: DataFrame, query: str, vector: list[float] | None = None) -> DataFrame:
    """Symbols with a score above 0: name match and, with a vector, likeness of meaning; then 1.5 times for definitions,
    0.2 times for destructured names, require() and small exports."""
    kind = F.col("kind")
    imported = F.startswith(F.col("name"), F.lit("{")) | F.startswith(F.col("name"), F.lit("[")) | F.contains("signature", F.lit("require("))
    small = (kind == "export") & (F.col("end_line") - F.col("start_line") < 3)
    factor = F.when(~imported & kind.isin(K.DEFINITION_KINDS), K.DEFINITION_FACTOR).when(imported | small, K.IMPORT_FACTOR).otherwise(1.0)
    score = name_score(F.col("name"), query)
    if vector is not None:
        near = V.cosine(F.col("embedding"), F.array(*map(F.lit, map(float, vector))))
        score = score + F.when(near > K.SYMBOL_SIM_MIN, near * K.SYMBOL_SIM_WEIGHT).otherwise(0.0)
    return symbols.withColumn("score", score * factor).where("score > 0")


def relevance(symbols: DataFrame, query: str) -> DataFrame:
    """Relevance in [0, 1] of a symbol: name, words of three and more bytes in the signature, length."""
    q, low, sig = query.lower(), F.lower("name"), F.lower("signature")
    name = F.when(low == q, 0.5).when(F.contains(low, F.lit(q)) | F.contains(F.lit(q), low), 0.3).otherwise(0.0)
    words = sum((F.when(T.has_word(sig, w), 0.1).otherwise(0.0) for w in q.split() if len(w.encode()) >= 3), F.lit(0.0))
    long_ = F.when(F.col("end_line") - F.col("start_line") + 1 > 10, 0.05).otherwise(0.0)
    return symbols.withColumn("relevance", F.least(F.lit(1.0), name + words + long_))


def path_score(path: Column, query: str) -> Column:
    """6 for the whole query in the path, and 6 times the share of its words (or their first four characters) there."""
    low, words = F.lower(path), query_words(query)
    hit = lambda w: F.contains(low, F.lit(w)) | (F.contains(low, F.lit(w[:4])) if len(w) >= 4 else F.lit(False))
    share = sum((hit(w).cast("int") for w in words), F.lit(0)) / max(1, len(words))
    return F.when(F.contains(low, F.lit(query.lower())), K.PATH_MATCH).otherwise(0.0) + K.PATH_MATCH * share


def in_degree(edges: DataFrame, target: str) -> DataFrame:
    return edges.groupBy(F.col(target).alias("path")).agg(F.count("*").alias("import_count"))


def centrality(counts: DataFrame) -> DataFrame:
    """0.5 * ln(1 + n) / ln(1 + most n); the one-row maximum is broadcast."""
    most = counts.agg(F.max("import_count").alias("most"))
    return counts.crossJoin(F.broadcast(most)).withColumn("boost", F.when(F.col("most") > 0, K.CENTRALITY_MAX * F.log1p("import_count") / F.log1p("most")).otherwise(0.0)).drop("most")


def accumulate(parts: DataFrame) -> DataFrame:
    """Score of a path, with the first three symbols in order of `ord`. parts: path, score, symbol, ord."""
    three = F.slice(F.array_sort(F.collect_list(F.when(F.col("symbol").isNotNull(), F.struct("ord", "symbol")))), 1, 3)
    # Only the first three of a path go on, so that no path gathers all its symbols in one row.
    place = F.row_number().over(Window.partitionBy("path", F.col("symbol").isNull()).orderBy("ord"))
    ranked = parts.withColumn("symbol", F.when(place <= 3, F.col("symbol")))
    return ranked.groupBy("path").agg(F.sum("score").alias("score"), F.transform(three, lambda s: s["symbol"]).alias("symbols"))


def line_kinds(files: DataFrame, query: str) -> DataFrame:
    """relative_path, code_lines and import_lines: lines that hold a word of the query (or its first four characters)."""
    words = query_words(query)

    def hit(line: Column) -> Column:
        low = F.lower(line)
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w)) | (F.contains(low, F.lit(w[:4])) if len(w) >= 4 else F.lit(False))
        return out

    def is_import(line: Column) -> Column:
        t = F.regexp_replace(line, r"^\s+|\s+$", "")
        starts = lambda *heads: reduce(lambda a, b: a | b, (F.startswith(t, F.lit(h)) for h in heads))
        return starts("import ", "from ", "#include") | F.contains(t, F.lit("require(")) & (starts("const {") | starts("const ") & F.contains(t, F.lit("}")))

    lines = F.filter(F.split("content", "\n"), hit)
    return files.select("relative_path", lines.alias("hits")).select("relative_path", F.size(F.filter("hits", lambda x: ~is_import(x))).cast("long").alias("code_lines"), F.size(F.filter("hits", is_import)).cast("long").alias("import_lines"))


def rerank(matches: DataFrame, files: DataFrame, query: str, k: int) -> DataFrame:
    """Of the best 3k matches, read the lines: 0.4 times where only imports hit, 1.3 times where only code does; the best k."""
    top = matches.orderBy(F.desc("score"), "path").limit(3 * k)
    kinds = line_kinds(files.join(F.broadcast(top.select(F.col("path").alias("relative_path"))), "relative_path", "left_semi"), query)  # 3k rows
    joined = top.join(kinds.withColumnRenamed("relative_path", "path"), "path", "left")
    factor = F.when((F.col("code_lines") == 0) & (F.col("import_lines") > 0), K.IMPORT_ONLY_FACTOR).when((F.col("code_lines") > 0) & (F.col("import_lines") == 0), K.CODE_ONLY_FACTOR).otherwise(1.0)
    return joined.withColumn("score", F.col("score") * factor).orderBy(F.desc("score"), "path").limit(k)


def pack_prefix(rows: DataFrame, group: str, order: list, cost: str, budget: int) -> DataFrame:
    """The rows of each group, in order, until the budget is passed for the first time."""
    total = F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", total).where(F.col("used") <= budget)


def pack_greedy(rows: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Each group's rows in order, leaving out those that do not fit what is left. The fold carries the rest alone and marks rows."""
    items = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c")))).alias("items"))
    kept = F.aggregate("items", F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(f"array<{dict(rows.dtypes)[order]}>").alias("ids")), lambda s, x: F.when(x["c"] <= s["left"], F.struct((s["left"] - x["c"]).alias("left"), F.concat(s["ids"], F.array(x["o"])).alias("ids"))).otherwise(s), lambda s: s["ids"])
    return items.select(group, F.explode(kept).alias(order))


def indexed_search(symbols: DataFrame, files: DataFrame, counts: DataFrame, query: str, k: int = 5) -> DataFrame:
    """rank, path, score and symbols of the k best files: symbol, path and centrality scores added, then re-ranked."""
    named = symbol_score(symbols, query).select(F.col("relative_path").alias("path"), "score", F.col("name").alias("symbol"), F.col("symbol_id").alias("ord"))
    paths = files.select(F.col("relative_path").alias("path"), path_score(F.col("relative_path"), query).alias("score"), F.lit(None).cast("string").alias("symbol"), F.lit(0).cast("long").alias("ord")).where("score > 0")
    found = accumulate(named.unionByName(paths))
    boosted = found.join(centrality(counts).drop("import_count"), "path", "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")
    best = rerank(boosted, files, query, k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "path")).alias("rank"), "path", F.round("score", 6).alias("score"), F.array_join("symbols", "|").alias("symbols"))  # k rows
