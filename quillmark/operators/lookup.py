"""Finding one symbol by its name, with fallbacks, and search over raw contents where no index is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import constants as K
from quillmark.functions import code as C
from quillmark.functions import text as T
from quillmark.functions import vector as V
from quillmark.operators import index, search

#: Contents of more bytes are not searched; so many files in order of path go on to the scores by meaning.
LIVE_BYTES, LIVE_FILES, SCAN_LINES = 1_000_000, 500, 500
SIMILAR = 5


def exact(symbols: DataFrame, name: str, hint: str | None = None) -> DataFrame:
    """Symbols of that name, whatever its case, in files whose path holds the hint, if there is one (as LIKE compares, without ASCII case)."""
    found = symbols.where(F.lower("name") == name.lower())
    return found if hint is None else found.where(F.col("relative_path").ilike(f"%{hint}%"))


def similar(symbols: DataFrame, name: str, limit: int = SIMILAR) -> DataFrame:
    """The first symbols, by path, line, kind and then id, whose name holds `name`."""
    return symbols.where(F.contains(F.lower("name"), F.lit(name.lower()))).orderBy("relative_path", "start_line", "end_line", "kind", "symbol_id").limit(limit)


def resolve_exports(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """found, with small exports replaced by the longest function of their name in their file; one row for each file and line."""
    span = F.col("end_line") - F.col("start_line")
    small = (F.lower("kind") == "export") & (span < 5)
    functions = symbols.where(F.lower("kind").isin("function", "async function", "asyncfunction")).select(F.lower("name").alias("k"), F.col("relative_path").alias("p"), F.struct(span.alias("span"), (-F.col("start_line")).alias("first")).alias("by"), F.struct("name", "kind", "start_line", "end_line", "signature").alias("f"))
    best = functions.groupBy("k", "p").agg(F.max_by("f", "by").alias("f"))
    joined = found.join(best, small & (F.lower("name") == F.col("k")) & (F.col("relative_path") == F.col("p")), "left")
    rows = joined.select("relative_path", F.col("start_line").alias("own_line"), *(F.coalesce(F.col(f"f.{c}"), F.col(c)).alias(c) for c in ("name", "kind", "start_line", "end_line", "signature")))
    return search.first_wins(rows, ["relative_path", "start_line"], ["own_line", F.desc("end_line"), "name", "kind"]).drop("own_line")


def cut_lines(rows: Column, most: int) -> Column:
    """rows joined; beyond `most` (0: all) the number of those left out."""
    whole = F.array_join(rows, "\n")
    if not most:
        return whole
    return F.when(F.size(rows) > most, F.concat(F.array_join(F.slice(rows, 1, most), "\n"), F.lit("\n// ... +"), (F.size(rows) - most).cast("string"), F.lit(" more lines (pass max_lines=0 for full)"))).otherwise(whole)


def with_code(found: DataFrame, files: DataFrame, most: int = 0) -> DataFrame:
    """found with code, the lines of each symbol; null where the file is gone."""
    rows = F.slice(C.lines(F.col("content")), F.greatest(F.col("start_line").cast("int"), F.lit(1)), F.greatest((F.col("end_line") - F.greatest("start_line", F.lit(1)) + 1).cast("int"), F.lit(0)))
    contents = files.select("relative_path", "content")
    return found.join(contents, "relative_path", "left").withColumn("code", cut_lines(rows, most)).drop("content")


def raw_match(files: DataFrame, name: str, most: int = 0) -> DataFrame:
    """relative_path, start_line, end_line and code of the first definition-like line with the name, in order of path; to the line where its braces close."""
    line = lambda x: C.trim(x["text"])
    has = lambda t, *parts: _any(F.contains(t, F.lit(p)) for p in parts)
    starts = lambda t, *heads: _any(F.startswith(t, F.lit(h)) for h in heads)
    like = lambda x: F.contains(x["text"], F.lit(name)) & F.contains(line(x), F.lit(name)) & ~starts(line(x), "import ", "const {") & (has(line(x), "function", "=>", f"exports.{name}", f"{name} =") | starts(line(x), f"const {name}", f"let {name}"))
    numbered = F.transform(C.lines(F.col("content")), lambda x, i: F.struct((i + 1).alias("at"), x.alias("text")))
    first = F.get(F.filter(numbered, like), F.lit(0))["at"]
    hit = files.where(F.contains("content", F.lit(name))).select("relative_path", "content", first.alias("start_line")).where("start_line is not null").orderBy("relative_path").limit(1)
    rest = F.slice(C.lines(F.col("content")), F.col("start_line"), SCAN_LINES + 2)
    marks = lambda x, c: F.char_length(x) - F.char_length(F.replace(x, F.lit(c), F.lit("")))

    def step(s: Column, x: Column) -> Column:
        opened, depth = s["opened"] | F.contains(x, F.lit("{")), s["depth"] + marks(x, "{") - marks(x, "}")
        return F.when(s["done"], s).otherwise(F.struct((s["n"] + 1).alias("n"), depth.alias("depth"), opened.alias("opened"), (opened & (depth <= 0)).alias("done")))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(False).alias("done"))
    n = F.aggregate(rest, zero, step, lambda s: s["n"])
    return hit.select("relative_path", "start_line", (F.col("start_line") + n - 1).alias("end_line"), cut_lines(F.slice(rest, 1, n), most).alias("code"))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def get_symbol(symbols: DataFrame | None, files: DataFrame, name: str, hint: str | None = None, most: int = 0) -> DataFrame:
    """source (index, live, text, none), relative_path, name, kind, start_line, end_line, code.

    The index's symbols of that name; else those that files hold now, whose name is or holds it; else the first
    definition-like line. Each step is only tried if the one before finds nothing, as far as one row tells.
    """
    columns = ("relative_path", "name", "kind", "start_line", "end_line", "code")
    shown = lambda found, source: with_code(found, files, most).select(F.lit(source).alias("source"), *columns)
    if symbols is not None and not (found := exact(symbols, name, hint)).isEmpty():
        return shown(resolve_exports(found, symbols), "index")
    near = files if hint is None else files.where(F.contains(F.lower("relative_path"), F.lit(hint.lower())))
    live = index.extract_symbols(near.where(F.col("extension").isin(*C.AST_EXTENSIONS))).where(F.contains(F.lower("name"), F.lit(name.lower())))
    if not live.isEmpty():
        return shown(live, "live")
    return raw_match(files, name, most).select(F.lit("text").alias("source"), "relative_path", F.lit(name).alias("name"), F.lit("match").alias("kind"), "start_line", "end_line", "code")


def live_search(files: DataFrame, query: str, k: int, vector: list[float] | None = None) -> DataFrame:
    """rank, path, score and lines (the first three numbers) of the k best files by their raw contents.

    5 for the query in the path, 1 for each line that holds it, 3 for each symbol whose name has it as a word; the
    first LIVE_FILES by path that have a score go on; with a vector, and an embedding column, likeness of meaning too.
    """
    q = query.lower()
    small = files.where((F.col("size_bytes") <= LIVE_BYTES) & F.col("content").isNotNull())
    hits = F.filter(F.transform(C.lines(F.col("content")), lambda x, i: F.struct((i + 1).alias("line"), F.contains(F.lower(x), F.lit(q)).alias("hit"))), lambda x: x["hit"])
    path = F.when(F.contains(F.lower("relative_path"), F.lit(q)), K.EXACT_NAME).otherwise(0.0)
    keep = ["embedding"] if vector is not None else []
    scored = small.select("relative_path", *keep, path.alias("by_path"), F.size(hits).alias("n"), F.transform(F.slice(hits, 1, 3), lambda x: x["line"]).alias("lines"))
    named = index.extract_symbols(small.where(F.col("extension").isin(*C.AST_EXTENSIONS))).where(T.has_word(F.lower("name"), q)).groupBy("relative_path").agg(F.count("*").alias("names"))
    scored = scored.join(named, "relative_path", "left").withColumn("score", F.col("by_path") + F.col("n") + K.SUBSTRING_NAME * F.coalesce("names", F.lit(0)))
    first = scored.where("score > 0").orderBy("relative_path").limit(LIVE_FILES)
    if vector is not None:
        near = V.cosine(F.col("embedding"), F.array(*map(F.lit, map(float, vector))))
        first = first.withColumn("score", F.col("score") + F.when(near > K.SYMBOL_SIM_MIN, near * K.SYMBOL_SIM_WEIGHT).otherwise(0.0))
    best = first.orderBy(F.desc("score"), "relative_path").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "relative_path")).alias("rank"), F.col("relative_path").alias("path"), F.round("score", 6).alias("score"), F.array_join("lines", ",").alias("lines"))  # k rows


def dispatch(symbols: DataFrame | None, files: DataFrame, counts: DataFrame | None, query: str, k: int = 5) -> DataFrame:
    """rank, path and score by the index if there is one with rows, else by the raw contents; at most 50 results."""
    k = min(k, 50)
    if symbols is not None and counts is not None and not symbols.isEmpty():
        return search.indexed_search(symbols, files, counts, query, k).select("rank", "path", "score")
    return live_search(files, query, k).select("rank", "path", "score")
