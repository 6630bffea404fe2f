"""Building and maintaining the index: diffs, imports, symbols, architecture."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import constants as K


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """relative_path and status: new, changed, unchanged or stale. Both sides: relative_path, content_hash."""
    a, b = old.select("relative_path", F.col("content_hash").alias("h1"), F.lit(True).alias("in1")), new.select("relative_path", F.col("content_hash").alias("h2"), F.lit(True).alias("in2"))
    status = F.when(F.col("in1").isNull(), "new").when(F.col("in2").isNull(), "stale").when(F.col("h1").eqNullSafe(F.col("h2")), "unchanged").otherwise("changed")
    return a.join(b, "relative_path", "full_outer").select("relative_path", status.alias("status"))


def apply_changes(table: DataFrame, deleted: DataFrame, upserts: DataFrame, key: str = "relative_path") -> DataFrame:
    """table without the deleted and replaced keys, and with the upserts."""
    gone = deleted.select(key).unionByName(upserts.select(key))
    return table.join(gone, key, "left_anti").unionByName(upserts)


_IMPORTS = {
    "py": [r"^\s*from\s+(\S+)\s+import", r"^\s*import\s+(.+)"],
    "js": [r"""^\s*import\s.*\bfrom\b.*?['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]""", r"""^\s*export\b.*\bfrom\s+['"]([^'"]+)['"]"""],
    "rs": [r"^\s*use (crate::\w+)", r"^\s*mod\s+(\w+)\s*;\s*$"],
    "go": [r'^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"', r'^\s*(?:[\w.]+\s+)?"([^"]+)"'],
    "c": [r'^\s*#\s*include\s+"([^"]+)"'],
}
_FAMILY = {**dict.fromkeys(("js", "jsx", "ts", "tsx", "mjs", "cjs"), "js"), **dict.fromkeys(("py", "pyi"), "py"), "rs": "rs", "go": "go", **dict.fromkeys(("c", "h", "cpp", "cc", "cxx", "hpp", "hxx"), "c")}


def imports_of(source: str, ext: str) -> list[str]:
    """Names that a source imports, one for each name of each import line; comments are passed over."""
    family = _FAMILY.get(ext)
    if not family:
        return []
    if family != "py":
        source = re.sub(r"/\*.*?\*/", lambda m: "\n" * m.group().count("\n"), source, flags=re.S)
    else:
        source = re.sub(r"(?m)^[ \t]*(?:from|import)\b(?:[^#\n\\]|\\\r?\n)+", lambda m: re.sub(r"\\\r?\n", " ", m.group()), source)
    out, block = [], False
    for line in source.split("\n"):
        if line.lstrip().startswith(("//",) if family != "py" else ("#",)):
            continue
        if family == "go":
            if m := re.match(r"\s*import\s*\(", line):
                out += re.findall(r'"([^"]+)"', line[m.end() :])
                block = ")" not in re.sub(r'"[^"]*"|//.*', "", line[m.end() :])
                continue
            block = block and not line.strip().startswith(")")
        for i, pattern in enumerate(_IMPORTS[family]):
            if family == "go" and i == 1 and not block:
                continue
            if m := re.search(pattern, line):
                out += re.findall(r"(?:^|,)\s*([\w.]+)", m[1].split("#")[0]) if family == "py" and i == 1 else [m[1]]
                break
    return out


_SYMBOLS = {
    "js": [("function", r"^(?:export\s+)?(?:default\s+)?function\s*\*?\s*(\w+)"), ("async function", r"^(?:export\s+)?(?:default\s+)?async\s+function\s*\*?\s*(\w+)"), ("class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^(?:export\s+)?interface\s+(\w+)"), ("type", r"^(?:export\s+)?type\s+(\w+)"), ("enum", r"^(?:export\s+)?(?:const\s+)?enum\s+(\w+)"), ("const", r"^(?:export\s+)?(?:const|let|var)\s+(\w+)"), ("export", r"^(?:module\.)?exports(?:\.(\w+))?\s*=")],
    "rs": [("function", r"^(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("async function", r"^(?:pub(?:\([^)]*\))?\s+)?async\s+fn\s+(\w+)"), ("struct", r"^(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"^(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("impl", r"^impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)")],
    "go": [("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b"), ("interface", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"), ("type", r"^type\s+(\w+)"), ("const", r"^(?:const|var)\s+(\w+)")],
    "c": [("struct", r"^(?:typedef\s+)?(?:struct|union)\s+(\w+)\s*\{"), ("enum", r"^(?:typedef\s+)?enum\s+(\w+)\s*\{"), ("function", r"^[A-Za-z_][\w\s\*]*?\b(\w+)\s*\([^;]*\)\s*\{?\s*$")],
}


def _end(lines: list[str], i: int, statement: bool = False) -> int:
    """The line on which the braces opened from line i on are closed, or i. A statement without braces may also end without a semicolon."""
    depth, opened = 0, False
    for j in range(i, len(lines)):
        depth += lines[j].count("{") - lines[j].count("}")
        opened = opened or "{" in lines[j]
        if opened and depth <= 0 or not opened and (lines[j].rstrip().endswith(";") or statement and re.search(r"[\w\])'\"`]\s*$", lines[j]) and not re.match(r"\s*[.?:|&{]", lines[j + 1] if j + 1 < len(lines) else "")):
            return j
    return len(lines) - 1 if opened else i


def _go_block(lines: list[str], i: int) -> tuple[list[tuple[str, str, int, int, str]], int]:
    """The symbols of a block `type (`, `const (` or `var (` that opens on line i, and the line that closes it."""
    word, out, j = lines[i].split("(")[0].strip(), [], i + 1
    while j < len(lines) and not lines[j].startswith(")"):
        last = j
        for kind, pattern in _SYMBOLS["go"][2:] if re.match(r"\s*\w", lines[j]) else []:
            if m := re.match(pattern, f"{word} {lines[j].strip()}"):
                depth = 0
                for last in range(j, len(lines)):
                    depth += sum(lines[last].count(c) for c in "{(") - sum(lines[last].count(c) for c in "})")
                    if depth <= 0:
                        break
                out.append((m[1], kind, j + 1, last + 1, lines[j].strip()))
                break
        j = last + 1
    return out, j


def _exported(text: str) -> str:
    """How an assignment to module.exports is named: by the keys of its object, or by what is assigned."""
    value = text.partition("=")[2].strip().rstrip(";").strip()
    if not value.startswith("{"):
        return f"module.exports = {value[:60]}"
    depth, part, parts = 0, "", []
    for c in re.sub(r"/\*.*?\*/|//[^\n]*", "", value, flags=re.S):
        depth += (c in "{[(") - (c in "}])")
        if c == "," and depth == 1 or depth == 0:
            parts.append(part)
            part = ""
        elif not (c == "{" and depth == 1 and not part and not parts):
            part += c
    keys = [m[1] for x in parts if (m := re.match(r"""\s*([\w$]+|'[^']*'|"[^"]*")\s*(?::|$)""", x))]
    return f"module.exports({', '.join(keys)})" if keys else "default"


def symbols_of(source: str, ext: str) -> list[tuple[str, str, int, int, str]]:
    """Top-level (name, kind, first line, last line, signature), lines from 1."""
    family = _FAMILY.get(ext)
    if not family:
        raise ValueError(f"no symbols are known for .{ext}")
    lines = source.split("\n")
    if family == "py":
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return []
        kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "async function", ast.ClassDef: "class"}
        return [(n.name, kinds[type(n)], n.lineno, n.end_lineno, lines[n.lineno - 1].strip()) for n in tree.body if type(n) in kinds]
    out, i = [], 0
    while i < len(lines):
        if family == "go" and re.match(r"(?:type|const|var)\s*\(", lines[i]):
            found, i = _go_block(lines, i)
            out += found
        for kind, pattern in _SYMBOLS[family] if i < len(lines) else []:
            if m := re.match(pattern, lines[i]):
                last = _end(lines, i, kind in ("const", "export"))
                out.append((m[1] or _exported("\n".join(lines[i : last + 1])), kind, i + 1, last + 1, lines[i].strip()))
                i = last
                break
        i += 1
    return out


def extract_symbols(files: DataFrame) -> DataFrame:
    """relative_path, name, kind, start_line, end_line, signature of every file in a known language."""
    def run(frames):
        for x in frames:
            rows = [(p, *s) for p, e, c in zip(x.relative_path, x.extension, x.content) if e in _FAMILY and c is not None for s in symbols_of(c, e)]
            yield pd.DataFrame(rows, columns=["relative_path", "name", "kind", "start_line", "end_line", "signature"])

    return files.select("relative_path", "extension", "content").mapInPandas(run, "relative_path string, name string, kind string, start_line int, end_line int, signature string")


def extract_imports(files: DataFrame) -> DataFrame:
    """relative_path and import, one row for each import."""
    def run(frames):
        for x in frames:
            rows = [(p, i) for p, e, c in zip(x.relative_path, x.extension, x.content) if c is not None for i in imports_of(c, e)]
            yield pd.DataFrame(rows, columns=["relative_path", "import"])

    return files.select("relative_path", "extension", "content").mapInPandas(run, "relative_path string, import string")


def with_counts(files: DataFrame, edges: DataFrame, target: str = "resolved") -> DataFrame:
    """files with import_count, rewritten for all: the edges to each, 0 where there are none."""
    counts = edges.groupBy(F.col(target).alias("relative_path")).agg(F.count("*").alias("import_count"))
    kept = files.drop("import_count") if "import_count" in files.columns else files
    return kept.join(counts, "relative_path", "left").withColumn("import_count", F.coalesce("import_count", F.lit(0)).cast("long"))


def centrality_of(files: DataFrame) -> DataFrame:
    """files with import_count, from the extraction of their imports over their resolution to the count of edges."""
    return with_counts(files, resolve_imports(extract_imports(files), files))


def run_statistics(status: DataFrame) -> DataFrame:
    """One row: how many files of a diff are indexed anew (new or changed), unchanged, and removed."""
    n = lambda *kinds: F.count(F.when(F.col("status").isin(*kinds), 1))
    return status.agg(n("new", "changed").alias("indexed"), n("unchanged").alias("unchanged"), n("stale").alias("removed"))


def is_indexed(index: DataFrame | None) -> bool:
    return index is not None and not index.isEmpty()


def extension_histogram(files: DataFrame, k: int = 8) -> DataFrame:
    return files.groupBy("extension").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "extension").limit(k)


def tree_dirs(files: DataFrame, depth: int = 2) -> DataFrame:
    """Directories less than `depth` deep, with files and bytes below them."""
    parts = F.split("relative_path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.where(F.size(parts) > 1).select(F.explode(dirs).alias("dir"), "size_bytes")
    return rows.groupBy("dir").agg(F.count("*").alias("files"), F.sum("size_bytes").cast("long").alias("bytes"))


def resolve_imports(imports: DataFrame, known: DataFrame) -> DataFrame:
    """relative_path, import, resolved: the first candidate path that is known, by the importer's language; one row for each row of imports that has one.

    A Go import means a directory that ends with it; of the .go files in all of these the least path is taken.
    """
    def run(frames):
        for x in frames:
            rows = [(p, i, n, c) for p, i in zip(x["relative_path"], x["import"]) for n, c in enumerate(import_candidates(i, p))]
            yield pd.DataFrame(rows, columns=["relative_path", "import", "rank", "path"])

    names = imports.select("relative_path", "import").distinct()
    paths = known.select(F.col("relative_path").alias("path")).distinct()
    tries = names.mapInPandas(run, "relative_path string, import string, rank int, path string")
    hits = tries.join(paths, "path").groupBy("relative_path", "import").agg(F.min_by("path", "rank").alias("resolved"))
    folders = paths.where(F.endswith("path", F.lit(".go"))).groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).agg(F.min("path").alias("path")).where("folder <> ''")
    ends = folders.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("folder")), lambda n: F.right(F.col("folder"), n))).alias("import"), "path")
    go = names.where(F.endswith("relative_path", F.lit(".go"))).join(ends.groupBy("import").agg(F.min("path").alias("resolved")), "import")
    return imports.select("relative_path", "import").join(hits.unionByName(go), ["relative_path", "import"])


def import_candidates(name: str, importer: str) -> list[str]:
    """Paths that an import may mean, best first; none for Go (see resolve_imports)."""
    folder, _, base = importer.rpartition("/")
    family = _FAMILY.get(base.rpartition(".")[2])

    def clean(p: str) -> str:
        out: list[str] = []
        for x in p.split("/"):
            out = out[:-1] if x == ".." else out if x in ("", ".") else [*out, x]
        return "/".join(out)

    if family == "js":
        if not name.startswith((".", "/")):
            return []
        at = clean(name if name.startswith("/") else f"{folder}/{name}")
        return [at, *(f"{at}.{e}" for e in ("ts", "tsx", "js", "jsx")), *(f"{at}/index.{e}" for e in ("ts", "tsx", "js", "jsx"))]
    if family == "py":
        at = name.replace(".", "/")
        return [f"{at}.py", f"{at}/__init__.py", f"{at}.pyi"]
    if family == "rs":
        at = name.removeprefix("crate::").replace("::", "/")
        return [clean(f"{folder}/{at}.rs"), clean(f"{folder}/{at}/mod.rs"), f"src/{at}.rs", f"src/{at}/mod.rs"]
    if family == "c":
        return [clean(name if name.startswith("/") else f"{folder}/{name}"), name]
    return []
