"""Text of source files as column expressions: lines, what kind they are, comments, module names, budgets, short forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
JS, PY = ("js", "jsx", "ts", "tsx", "mjs", "cjs"), ("py", "pyi")
C = ("c", "h", "cpp", "cc", "cxx", "hpp", "hxx")
IMPORT_HEADS = ((JS, ("import ",)), (PY, ("import ", "from ")), (("rs",), ("use ", "mod ")), (("go",), ("import ",)), (C, ("#include",)))
_JS_DEF = ("export ", "function ", "class ", "const ", "async function ")
_RS_DEF = ("pub ", "fn ", "struct ", "enum ", "trait ", "impl ")
DEFINITION_HEADS = ((JS, _JS_DEF), (PY, ("def ", "class ")), (("rs",), _RS_DEF))
SYMBOL_HEADS = ((JS, (*_JS_DEF, "interface ", "type ", "enum ")), (PY, ("def ", "class ", "async def ")), (("rs",), _RS_DEF), (("go",), ("func ", "type ")))
COMMENT_HEADS = ((("js", "jsx", "ts", "tsx", "mjs", "cjs", "rs", "go", "c", "cpp", "h"), "//"), (PY, "#"))
AST_EXTENSIONS = (*JS, *PY, "rs", "go", *C)


def trim(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def lines(text: Column) -> Column:
    """The lines of a text without their ends; a line feed at the end adds none."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(text == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _starts(line: Column, ext: Column, heads) -> Column:
    one = lambda own: reduce(lambda a, b: a | b, (F.startswith(line, F.lit(h)) for h in own))
    return reduce(lambda out, kv: out.when(ext.isin(*kv[0]), one(kv[1])), heads[1:], F.when(ext.isin(*heads[0][0]), one(heads[0][1]))).otherwise(False)


def is_import(line: Column, ext: Column) -> Column:
    """line: trimmed."""
    return _starts(line, ext, IMPORT_HEADS) | ext.isin(*JS) & F.startswith(line, F.lit("const ")) & F.contains(line, F.lit("require("))


def is_definition(line: Column, ext: Column) -> Column:
    return _starts(line, ext, DEFINITION_HEADS)


def is_symbol(line: Column, ext: Column) -> Column:
    return _starts(line, ext, SYMBOL_HEADS)


def strip_comments(code: Column, ext: Column) -> Column:
    """Without blank lines and lines of comments (but `// ...` stays), for languages whose comments are known."""
    mark = reduce(lambda out, kv: out.when(ext.isin(*kv[0]), F.lit(kv[1])), COMMENT_HEADS[1:], F.when(ext.isin(*COMMENT_HEADS[0][0]), F.lit(COMMENT_HEADS[0][1])))
    stays = lambda line: (trim(line) != "") & (~F.startswith(trim(line), mark) | F.startswith(trim(line), F.lit("// ...")))
    return F.when(mark.isNull(), code).otherwise(F.array_join(F.filter(lines(code), stays), "\n"))


def first_quoted(text: Column, marks: tuple[str, str] = ('"', "'")) -> Column:
    """What the first pair of the first mark encloses, else of the second; null if none does."""
    found = lambda m: F.when(text.rlike(f"{m}[^{m}]*{m}"), F.regexp_extract(text, f"{m}([^{m}]*){m}", 1))
    return F.coalesce(*map(found, marks))


def quoted_after(text: Column, word: str) -> Column:
    return F.when(F.contains(text, F.lit(word)), first_quoted(F.substr(text, F.instr(text, word) + len(word))))


def module_names(import_lines: Column, ext: Column) -> Column:
    """Short names of the modules that trimmed import lines name, each once, in order."""
    def module(line: Column) -> Column:
        py = F.when(F.startswith(line, F.lit("from ")), F.regexp_extract(line, r"^from\s+(\S*)", 1)).when(F.startswith(line, F.lit("import ")), trim(F.regexp_extract(line, "^import ([^,]*)", 1)))
        rust = F.when(F.startswith(line, F.lit("use ")), F.regexp_replace(F.split_part(F.substring(line, 5, 1 << 30), F.lit("::"), F.lit(1)), ";+$", ""))
        go = F.when(F.contains(line, F.lit('"')), F.regexp_extract(F.split_part(line, F.lit('"'), F.lit(2)), "([^/]*)$", 1))
        return F.when(ext.isin(*JS), first_quoted(line, ("'", '"'))).when(ext.isin(*PY), py).when(ext == "rs", rust).when(ext == "go", go)

    short = lambda m: F.regexp_extract(F.regexp_replace(F.regexp_replace(m, r"^(\./)+", ""), r"^(\.\./)+", ""), "([^/]*)$", 1)
    return F.array_distinct(F.filter(F.transform(F.transform(import_lines, module), short), lambda m: m.isNotNull() & (m != "")))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/", 1)


def base(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def tokens_to_chars(n: Column) -> Column:
    return n * 4


def fits_budget(tokens: Column, budget: Column) -> Column:
    return tokens <= budget


def truncate_utf8(text: Column, n: int = 8192) -> Column:
    """At most n bytes, whole characters."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(cut, "\uFFFD+$", ""))


def summary_text(path: Column, content: Column, n: int = 500, between: str = " ") -> Column:
    """What an embedding of a file is made from: its path and its first n characters."""
    return F.concat(path, F.lit(between), F.substring(content, 1, n))


def oneline(text: Column, n: int = 200) -> Column:
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def trim_date(text: Column) -> Column:
    return F.substring(text, 1, 10)


def display_cut(text: Column, n: int = 300) -> Column:
    """At most n bytes, cut before the last space of those, and '...'."""
    head = truncate_utf8(text, n)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, "(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.octet_length(text) > n, F.concat(cut, F.lit("..."))).otherwise(text)
