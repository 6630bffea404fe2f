"""Project trees, contexts, lookups with their fallbacks, blobs and note saving, on small inputs with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import code as C
from quillmark.functions import codec
from quillmark.functions import vector as V
from quillmark.operators import context, lookup, memory
from quillmark.sources import tree

FILES = "relative_path string, extension string, size_bytes long, content string"


@pytest.fixture
def project(spark, tmp_path):
    made = {
        ".gitignore": "*.md\n!README.md\n/only_root.py\nlogs/\ndeep/**/x.py\n# note\n", ".git/info/exclude": "secret.py\n", "README.md": "# Title\n\ntext\n", "other.md": "no", "only_root.py": "no", "sub/only_root.py": "a = 1\n",
        "logs/a.py": "no", "sub/.gitignore": "b?.py\n!b2.py\n", "sub/b1.py": "no", "sub/b2.py": "b = 2\n", "deep/u/v/x.py": "no", "deep/x.py": "no", "deep/y.py": "y = 1\n", "secret.py": "no", ".hidden/h.py": "no", ".env": "KEY=1",
        "node_modules/m.js": "no", "pkg/__init__.py": "", "a.PY": "no", "noext": "no", "package.json": "{}", "Cargo.toml": "", "src/big.txt": "x" * 300,
    }
    for name, text in made.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    (tmp_path / "src/bad.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "out.py").symlink_to("/etc/hosts")
    return str(tmp_path)


def test_project_tree(spark, project):
    got = {r["relative_path"]: r["content"] for r in tree.tree(spark, project, 200).collect()}
    assert got == {"Cargo.toml": "", "README.md": "# Title\n\ntext\n", "deep/y.py": "y = 1\n", "package.json": "{}", "pkg/__init__.py": "", "src/bad.txt": None, "src/big.txt": None, "sub/b2.py": "b = 2\n", "sub/only_root.py": "a = 1\n"}
    paths = spark.createDataFrame([("a/b.py",), ("a/.x/b.py",), ("dist/b.py",), ("a/b.bin",), ("b.ts",)], "p string")
    assert [r["p"] for r in paths.where(tree.watched(F.col("p"))).collect()] == ["a/b.py", "b.ts"]
    with pytest.raises(Exception, match="leads out of the project"):
        tree.write_tree(spark.createDataFrame([("../x.py", "")], "relative_path string, content string"), f"{project}/w")


def test_overview(spark, project):
    got = {(r["section"], r["line"]) for r in context.overview(tree.tree(spark, project)).collect()}
    assert ("doc", "From README.md\n# Title\ntext\n") in got and ("files", ".py(4)") in got
    assert {x for s, x in got if s == "folders"} == {"deep/", "pkg/", "src/", "sub/"} and {x for s, x in got if s == "stack"} == {"Node.js", "Rust"}


def skeleton(text, budget):
    out, code, used, since = "", False, 0, 0
    for line in text.split("\n")[: -1 if text.endswith("\n") else None] if text else []:
        n = len(line.encode())
        if line.lstrip().startswith("```"):
            code = not code
        elif code:
            pass
        elif line.startswith("#"):
            if used + n + 2 > budget:
                return out + "\n... [remaining sections omitted — use get_file_context for full content]\n"
            gap = "\n" if used else ""
            out, used, since = out + gap + line + "\n", used + len(gap) + n + 1, 0
        elif not line.strip():
            if 0 < since < 6:
                out, used, since = out + "\n", used + 1, since + 1
        elif since < 6:
            if used + n + 2 > budget:
                return out + "\n... [truncated — use get_file_context for full content]\n"
            out, used, since = out + line + "\n", used + n + 1, since + 1
    return out


def test_doc_skeleton(spark):
    rng = np.random.default_rng(3)
    parts = ["# H", "## é", "words here", "", "```", "- item", "x" * 40]
    texts = ["", "\n", *("\n".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(150))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", context.doc_skeleton(F.col("t"), 120).alias("s")).collect()
    assert all(r["s"] == skeleton(r["t"], 120) for r in rows)


PY = "import os, sys\nfrom a.b import c\n# note\ndef find_user(name):\n    # inner\n\n    return name\n\nclass Other:\n    pass\n"


def test_contexts(spark):
    files = spark.createDataFrame([("a.py", "py", len(PY), PY), ("b.txt", "txt", 3, "def\n"), ("d.js", "js", 60, "const x = require('./lib/k')\nfunction find() {\n  return 1\n}\n")], FILES)
    shown = lambda mode, *a: sorted((r["relative_path"], r["shown"]) for r in context.read_context(files, mode, *a).collect())
    assert ("a.py", "L4-7 [fn] find_user: def find_user(name):") in shown("symbols", 100)
    assert {("a.py", "Imports(2): os, a.b"), ("a.py", "[cls] Other L9-10: class Other:"), ("d.js", "Imports(1): k")} <= set(shown("summary", 100))
    smart = shown("smart", 500, "find_user")
    assert ("a.py", "[fn] find_user L4-7:\n```py\ndef find_user(name):\n    return name\n```\n") in smart and not any("Other" in s for _, s in smart)
    assert shown("smart", 10, "find_user") == []
    assert shown("full", 2)[1] == ("b.txt", "# b.txt (1 lines)\n\ndef\n")
    with pytest.raises(ValueError, match="mode is one of"):
        context.read_context(files, "other", 1)
    with pytest.raises(Exception, match="file too large"):
        context.read_full(files.withColumn("size_bytes", F.lit(11 << 20)), 1).collect()


SYMBOLS = "symbol_id long, name string, kind string, start_line int, end_line int, signature string, relative_path string"


def test_get_symbol(spark):
    js = "exports.run = run\nfunction run(a) {\n  if (a) {\n    return 1\n  }\n}\nconst other = (x) => {\n  return x }\n"
    files = spark.createDataFrame([("m/a.js", "js", len(js), js), ("z.txt", "txt", 40, "import run\nlet special = 3\nnext\n")], FILES)
    symbols = spark.createDataFrame([(1, "run", "Export", 1, 1, "exports.run = run", "m/a.js"), (2, "run", "Function", 2, 6, "function run(a)", "m/a.js"), (3, "run", "Function", 2, 4, "shorter", "m/a.js"), (4, "Running", "Class", 1, 2, "", "gone.js")], SYMBOLS)
    get = lambda *a: sorted(tuple(r) for r in lookup.get_symbol(*a).collect())
    assert get(symbols, files, "RUN", None, 2) == [("index", "m/a.js", "run", "Function", 2, 6, "function run(a) {\n  if (a) {\n// ... +3 more lines (pass max_lines=0 for full)")]
    assert get(symbols, files, "running") == [("index", "gone.js", "Running", "Class", 1, 2, None)]
    assert [r["name"] for r in lookup.similar(symbols, "un", 2).collect()] == ["Running", "run"]
    assert ("live", "m/a.js", "run", "function", 2, 6, "function run(a) {\n  if (a) {\n    return 1\n  }\n}") in get(symbols, files, "run", "nowhere") + get(None, files, "run", "M/A")
    assert get(None, files, "special") == [("text", "z.txt", "special", "match", 2, 3, "let special = 3\nnext")]
    assert get(None, files, "nothing") == []
    assert [r["path"] for r in lookup.live_search(files, "run", 5).collect()] == ["m/a.js", "z.txt"]
    assert [r["path"] for r in lookup.dispatch(None, files, None, "special").collect()] == ["z.txt"]


def test_similar_takes_ties_by_id(spark):
    """Rows that path, lines and kind leave open go by id, as they stand in the table, wherever they are read."""
    rows = [(k, f"ring {k}", "Class", 1, 2, "", "a.py") for k in range(40)]
    for order in (rows, rows[::-1]):
        assert [r["symbol_id"] for r in lookup.similar(spark.createDataFrame(order, SYMBOLS).repartition(5), "ring", 5).collect()] == [0, 1, 2, 3, 4]


def test_blobs():
    x = np.random.default_rng(5).normal(size=(6, 50))
    x[3] = 0
    for bits in (1, 2, 3, 4):
        for mode in (codec.FAST, codec.UNBIASED):
            own = bits if mode == codec.FAST else max(1, bits - 1)
            for row, blob in zip(x, codec.encode(x, bits, mode)):
                d = codec.decode(blob)
                assert (d["bits"], d["mode"], d["dim"], d["padded"]) == (bits, mode, 50, 64) and d["norm"] == pytest.approx(np.linalg.norm(row), rel=1e-6, abs=1e-9)
                assert d["codes"] == V.quantise(row[None, :], own)[0].tolist() and (d["signs"] is None) == (mode == codec.FAST or not row.any())
                assert codec.decode(blob[:-1]) is None and codec.decode(b"\x02" + blob[1:]) is None and codec.decode(blob[:2] + b"\x07" + blob[3:]) is None
    assert codec.decode(b"") is None and codec.decode(None) is None
    assert codec.storage(2, 384) == {"mse_bytes": 48, "qjl_bytes": 48, "norm_bytes": 8, "total_bytes": 104, "original_bytes": 1536, "compression_ratio": 1536 / 104}


def test_saved_notes(spark):
    schema = "id long, content string, category string, embedding array<float>, linked_id long, updated_at long"
    old = spark.createDataFrame([(1, "use redis as the cache store", "decision", [1.0, 0.0], None, 5), (2, "tabs not spaces", "style", [0.0, 1.0], None, 5)], schema)
    new = spark.createDataFrame([(10, "use redis as the cache store now", "decision", [1.0, 0.01]), (11, "use redis as the cache store", "style", [1.0, 0.0]), (12, "use redis", "decision", [1.0, 0.0]), (13, "cache", "x", [0.0, -1.0])], "id long, content string, category string, embedding array<float>")
    got = {r["id"]: (r["content"], r["linked_id"], r["updated_at"]) for r in memory.saved(old, new, 9).collect()}
    assert got == {1: ("use redis as the cache store\n— use redis as the cache store now", None, 9), 2: ("tabs not spaces", None, 5), 11: ("use redis as the cache store", 1, None), 12: ("use redis", None, None), 13: ("cache", None, None)}
    memory.checked("x", "c", "", 999)
    for bad in (("", "c", "", 0), ("x" * 51201, "c", "", 0), ("x", "c" * 101, "", 0), ("x", "c", "é" * 251, 0), ("x", "c", "", 1000)):
        with pytest.raises(ValueError):
            memory.checked(*bad)


def test_short_forms(spark):
    one = lambda c, **row: spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(c).first()[0]
    assert one(C.truncate_utf8(F.col("t"), 4), t="aéé") == "aé" and one(C.truncate_utf8(F.col("t"), 5), t="aéé") == "aéé"
    assert one(C.display_cut(F.col("t"), 8), t="one two three") == "one two..." and one(C.display_cut(F.col("t"), 5), t="abcdefgh") == "abcde..." and one(C.display_cut(F.col("t"), 9), t="short") == "short"
    assert one(C.quoted_after(F.col("t"), "from"), t="import 'x' from \"./y\"") == "./y" and one(C.first_quoted(F.col("t")), t="it's") is None
    assert one(C.trim_date(F.col("t")), t="2024-01-02 03:04") == "2024-01-02" and one(C.oneline(F.col("t"), 3), t="a\nbcd") == "a b..."
    assert one(C.module_names(F.array("a", "b"), F.lit("go")), a='import "x/y/z"', b="import q") == ["z"] and one(C.lines(F.col("t")), t="a\r\nb\n") == ["a", "b"]
