"""What a reader is shown of files: listings, overviews of a project, and files in full, as symbols or as a summary.

All of it is rows: a line of a listing or of a rendered file is a row with its place, so nothing is gathered into one
string but by whoever prints it; ``render`` does that for one file's rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import code as C
from quillmark.functions import text as T
from quillmark.operators import index, search

# fixed values
DOCS = ("ARCHITECTURE.md", "README.md", "readme.md")
STACK = (
    ("package.json", "Node.js"), ("Cargo.toml", "Rust"), ("go.mod", "Go"), ("requirements.txt", "Python"), ("pyproject.toml", "Python"), ("Gemfile", "Ruby"), ("pom.xml", "Java (Maven)"),
    ("build.gradle", "Java (Gradle)"), ("tsconfig.json", "TypeScript"), ("next.config.js", "Next.js"), ("next.config.mjs", "Next.js"), ("vite.config.ts", "Vite"), ("vite.config.js", "Vite"),
    ("tailwind.config.ts", "Tailwind CSS"), ("tailwind.config.js", "Tailwind CSS"), ("docker-compose.yml", "Docker"), ("Dockerfile", "Docker"), (".env", "Environment variables"), ("ecosystem.config.js", "PM2"),
)
SECTION_LINES, DOC_CHARS = 6, 2000
HIGH, MEDIUM, LEAST_TOKENS, BODY_LINES = 0.25, 0.05, 20, 30
MOST_BYTES = 10 << 20


def listing(files: DataFrame, depth: int) -> DataFrame:
    """relative_path, header (the folder where it differs from that of the file before, within its first path part) and label of files less than `depth` deep."""
    own = F.col("relative_path")
    shown = files.where(F.size(F.split(own, "/")) - 1 < depth).withColumn("folder", C.folder(own))
    # In order of path a folder's files stand together but for those of its own subfolders; a range of one top folder at a time keeps windows apart.
    before = F.lag("folder").over(Window.partitionBy(F.split_part(own, F.lit("/"), F.lit(1))).orderBy("relative_path"))
    header = F.when((F.col("folder") != "") & ~F.col("folder").eqNullSafe(before), F.concat("folder", F.lit("/")))
    return shown.select("relative_path", header.alias("header"), F.concat(C.base(own), F.lit(" ("), T.format_size(F.col("size_bytes")), F.lit(")")).alias("label"))


def short_paths(rows: DataFrame, path: str, order: str, group: str) -> DataFrame:
    """shown: the path, or its last part alone where its folder is that of the last row of the group that has one."""
    own = C.folder(F.col(path))
    before = F.last(F.nullif(own, F.lit("")), ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("shown", F.when((own != "") & (own == before), C.base(F.col(path))).otherwise(F.col(path)))


def doc_skeleton(text: Column, chars: int = DOC_CHARS) -> Column:
    """Of a Markdown text all headers, and up to six lines after each, without code blocks, within a budget of UTF-8 bytes."""
    more = "\n... [remaining sections omitted — use get_file_context for full content]\n"
    cut = "\n... [truncated — use get_file_context for full content]\n"

    def step(s: Column, line: Column) -> Column:
        state = lambda out, used, since, code=s["code"], done=s["done"]: F.struct(out.alias("out"), used.cast("long").alias("used"), since.cast("long").alias("since"), code.alias("code"), done.alias("done"))
        n, fence = F.octet_length(line), F.startswith(F.ltrim(line), F.lit("```"))
        over = s["used"] + n + 2 > chars
        gap = F.when(s["used"] > 0, "\n").otherwise("")
        header = F.when(over, state(F.concat(s["out"], F.lit(more)), s["used"], s["since"], done=F.lit(True))).otherwise(state(F.concat(s["out"], gap, line, F.lit("\n")), s["used"] + n + 1 + F.octet_length(gap), F.lit(0)))
        blank = F.when((s["since"] > 0) & (s["since"] < SECTION_LINES), state(F.concat(s["out"], F.lit("\n")), s["used"] + 1, s["since"] + 1)).otherwise(s)
        plain = F.when(s["since"] >= SECTION_LINES, s).when(over, state(F.concat(s["out"], F.lit(cut)), s["used"], s["since"], done=F.lit(True))).otherwise(state(F.concat(s["out"], line, F.lit("\n")), s["used"] + n + 1, s["since"] + 1))
        live = F.when(fence, state(s["out"], s["used"], s["since"], code=~s["code"])).when(s["code"], s).when(F.startswith(line, F.lit("#")), header).when(C.trim(line) == "", blank).otherwise(plain)
        return F.when(s["done"], s).otherwise(live)

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("since"), F.lit(False).alias("code"), F.lit(False).alias("done"))
    return F.aggregate(C.lines(text), start, step, lambda s: s["out"])


def overview(files: DataFrame, depth: int = 1) -> DataFrame:
    """section, place and line: the doc's skeleton, file counts, top folders and the stack of one project."""
    rank = F.array_position(F.array(*map(F.lit, DOCS)), F.col("relative_path"))
    doc = files.where(rank > 0).orderBy(rank).limit(1).select(F.lit("doc").alias("section"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("From "), "relative_path", F.lit("\n"), doc_skeleton(F.col("content"))).alias("line"))
    kinds = index.extension_histogram(files).select(F.lit("files").alias("section"), F.row_number().over(Window.orderBy(F.desc("files"), "extension")).cast("long").alias("place"), F.format_string(".%s(%d)", "extension", "files").alias("line"))  # 8 rows
    # Sorted, where the file system's order decides otherwise; ranked by names alone, which are few.
    folders = files.where(F.contains("relative_path", F.lit("/"))).select(F.concat(F.split_part("relative_path", F.lit("/"), F.lit(1)), F.lit("/")).alias("line")).distinct()
    folders = folders.select(F.lit("folders").alias("section"), F.lit(0).cast("long").alias("place"), "line")
    return doc.unionByName(kinds).unionByName(folders).unionByName(stack(files.select("relative_path")))


def stack(paths: DataFrame) -> DataFrame:
    """The marker files that stand at the root, as technologies, in order of the list; labels may repeat."""
    marks = paths.sparkSession.createDataFrame([(i, f, t) for i, (f, t) in enumerate(STACK)], "place long, relative_path string, line string")
    return paths.join(F.broadcast(marks), "relative_path").select(F.lit("stack").alias("section"), "place", "line")  # 19 rows


def read_full(files: DataFrame, tokens: int) -> DataFrame:
    """relative_path and shown: the whole text under a header, cut at the budget. Files over MOST_BYTES raise."""
    n, most = F.col("size_bytes"), tokens * 4
    text = F.when(n > MOST_BYTES, F.raise_error(F.concat(F.lit("file too large: "), "relative_path"))).otherwise(F.col("content"))
    head = F.concat(F.lit("# "), "relative_path", F.lit(" ("), F.size(C.lines(text)).cast("string"), F.lit(" lines)\n\n"))
    note = F.concat(F.lit(f"... [TRUNCATED — showing ~{tokens} of ~"), T.estimate_tokens(text).cast("string"), F.lit(" tokens. Use 'smart' mode or get_symbol for specific functions]\n"))
    return files.select("relative_path", F.when(F.octet_length(text) > most, F.concat(head, F.substring(text, 1, most), F.lit("\n\n"), note)).otherwise(F.concat(head, text)).alias("shown"))


def _fallback(files: DataFrame, kind) -> DataFrame:
    """relative_path, line number and trimmed text of the lines of a kind."""
    numbered = F.filter(F.transform(C.lines(F.col("content")), lambda x, i: F.struct((i + 1).alias("line"), C.trim(x).alias("text"))), lambda x: kind(x["text"], F.col("extension")))
    return files.select("relative_path", F.inline(numbered))


def read_symbols(files: DataFrame, sig: int = 100) -> DataFrame:
    """relative_path, line and shown: the symbols of files in a known language, else (and where none is found) their symbol-like lines."""
    found = index.extract_symbols(files)
    named = found.select("relative_path", F.col("start_line").alias("line"), F.concat(F.format_string("L%d-%d [", "start_line", "end_line"), T.short_kind(F.col("kind")), F.lit("] "), "name", F.lit(": "), T.truncate_sig(F.col("signature"), sig)).alias("shown"))
    rest = files.join(found.select("relative_path").distinct(), "relative_path", "left_anti")
    return named.unionByName(_fallback(rest, C.is_symbol).select("relative_path", "line", F.format_string("L%d: %s", "line", "text").alias("shown")))


def imports_head(files: DataFrame) -> DataFrame:
    """relative_path and head: how many import lines a file has, and the modules that they name."""
    found = F.filter(F.transform(C.lines(F.col("content")), C.trim), lambda x: C.is_import(x, F.col("extension")))
    rows = files.select("relative_path", F.size(found).alias("n"), C.module_names(found, F.col("extension")).alias("names"))
    text = F.when(F.size("names") == 0, F.format_string("Imports: %d", "n")).otherwise(F.concat(F.format_string("Imports(%d): ", "n"), F.array_join("names", ", ")))
    return rows.where("n > 0").select("relative_path", text.alias("head"))


def read_summary(files: DataFrame) -> DataFrame:
    """relative_path, line and shown: the imports (line 0), then the signatures of the symbols, or definition lines in other languages."""
    heads = imports_head(files).select("relative_path", F.lit(0).alias("line"), F.col("head").alias("shown"))
    ast = F.col("extension").isin(*C.AST_EXTENSIONS)
    named = index.extract_symbols(files.where(ast))
    named = named.select("relative_path", F.col("start_line").alias("line"), F.concat(F.lit("["), T.short_kind(F.col("kind")), F.lit("] "), "name", F.format_string(" L%d-%d: ", "start_line", "end_line"), T.truncate_sig(F.col("signature"), 100)).alias("shown"))
    plain = _fallback(files.where(~ast), C.is_definition).select("relative_path", "line", F.format_string("L%d: %s", "line", "text").alias("shown"))
    return heads.unionByName(named).unionByName(plain)


def read_smart(files: DataFrame, query: str, tokens: int) -> DataFrame:
    """relative_path, place and shown: the symbols of each file by relevance to the query, as code, signature or not at all, within a budget a file."""
    symbols = search.relevance(index.extract_symbols(files), query).join(files.select("relative_path", "extension", "content"), "relative_path")
    code = C.strip_comments(F.array_join(F.slice(C.lines(F.col("content")), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n"), F.col("extension"))
    rows = C.lines(code)
    code = F.when(F.size(rows) > BODY_LINES + 10, F.concat(F.array_join(F.slice(rows, 1, BODY_LINES), "\n"), F.lit("\n// ... +"), (F.size(rows) - BODY_LINES).cast("string"), F.lit(" more lines"))).otherwise(code)
    head = F.concat(F.lit("["), T.short_kind(F.col("kind")), F.lit("] "), "name", F.format_string(" L%d-%d:", "start_line", "end_line"))
    sig = F.concat(head, F.lit(" "), T.truncate_sig(F.col("signature"), 100))
    dash = F.concat(F.lit("- "), sig)
    parts = symbols.select("relative_path", "start_line", "relevance", F.when(F.col("relevance") > HIGH, F.concat(head, F.lit("\n```"), "extension", F.lit("\n"), code, F.lit("\n```\n"))).alias("body"), F.when(F.col("relevance") > HIGH, T.estimate_tokens(code)).cast("long").alias("body_tokens"), F.when(F.col("relevance") > HIGH, sig).otherwise(dash).alias("sig"))
    parts = parts.where(F.col("relevance") > MEDIUM).withColumn("sig_tokens", T.estimate_tokens(F.col("sig")).cast("long"))
    top = files.select("relative_path").join(imports_head(files), "relative_path", "left")
    used = F.concat(F.lit("# "), "relative_path", F.lit("\n\n"), F.coalesce(F.concat("head", F.lit("\n\n")), F.lit("")))
    left = top.select("relative_path", (F.lit(tokens) - T.estimate_tokens(used)).cast("long").alias("left"))

    def pack(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["relevance", "start_line"], ascending=[False, True], kind="stable")
        left, out = int(x["left"].iloc[0]), []
        for r in x.itertuples():
            if left < LEAST_TOKENS:
                break
            if r.body is not None and r.body_tokens <= left:
                out.append(r.body)
                left -= int(r.body_tokens) + 10
            elif r.sig_tokens <= left:
                out.append(r.sig)
                left -= int(r.sig_tokens)
        return pd.DataFrame({"relative_path": pd.Series([key[0]] * len(out), dtype=object), "place": np.arange(len(out), dtype=np.int32), "shown": pd.Series(out, dtype=object)})

    return parts.join(left, "relative_path").groupBy("relative_path").applyInPandas(pack, "relative_path string, place int, shown string")  # the symbols of one file


def read_context(files: DataFrame, mode: str, tokens: int, query: str | None = None) -> DataFrame:
    """relative_path, and rows of what is shown of each file in that mode."""
    if mode == "full":
        return read_full(files, tokens)
    if mode == "symbols":
        return read_symbols(files)
    if mode == "summary" or mode == "smart" and not query:
        return read_summary(files)
    if mode == "smart":
        return read_smart(files, query, tokens)
    raise ValueError(f"mode is one of full, summary, smart and symbols, not {mode!r}")
