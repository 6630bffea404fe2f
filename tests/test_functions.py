import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions import vector as V
from quillmark.operators import index, memory, search


def one(spark, column, *values):
    df = spark.createDataFrame([values], ["a", "b", "c"][: len(values)]) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize("s, h", [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("hello", "a430d84680aabd0b"), ("auth flow", "7f46a3aed3bbe5cd")])
def test_fnv(spark, s, h):
    assert one(spark, T.fnv1a64_hex(F.col("a")), s) == h


@pytest.mark.parametrize("s, n", [("", 0), ("hello", 2), ("const result = await fetchData(url);", 14), ("a_b c\n", 3), ("x" * 10000, 2500), ("{}\n\n", 4)])
def test_tokens(spark, s, n):
    assert one(spark, T.estimate_tokens(F.col("a")), s) == n


@pytest.mark.parametrize("s, hit", [("target", False), ("budget", False), ("getUser", True), ("get_user", True), ("getuser(id)", False), ("forget()", False)])
def test_word(spark, s, hit):
    assert one(spark, T.has_word(F.col("a"), "get"), s) is hit


@pytest.mark.parametrize("a, b, j, d", [("Cache sessions in Redis", "cache sessions in redis.", 1.0, 0.041667), ("Plan 1: pick option 1", "Plan 2: pick option 2", 0.6, 0.095238), ("the and", "of to", 1.0, 1.0), ("Deploy on Friday", "Never deploy on Friday", 0.666667, 0.954545)])
def test_likeness(spark, a, b, j, d):
    assert one(spark, F.round(T.jaccard(T.token_set(F.col("a")), T.token_set(F.col("b"))), 6), a, b) == j
    assert one(spark, F.round(T.divergence(F.col("a"), F.col("b")), 6), a, b) == d


@pytest.mark.parametrize("n, s", [(0, "0B"), (1023, "1023B"), (1024, "1.0KB"), (1536, "1.5KB"), (1048576, "1.0MB")])
def test_size(spark, n, s):
    assert one(spark, T.format_size(F.col("a")), n) == s


@pytest.mark.parametrize("s, n, want", [("def f(alpha, beta, gamma)", 18, "def f(alpha, beta..."), ("abcdefghij", 4, "abcd..."), (")bcdefghij", 4, "...")])
def test_signature(spark, s, n, want):
    assert one(spark, T.truncate_sig(F.col("a"), n), s) == want


@pytest.mark.parametrize("s, n", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n", 1), ("a\n\n", 2)])
def test_lines(spark, s, n):
    assert one(spark, T.line_count(F.col("a")), s) == n


@pytest.mark.parametrize("p, want", [("src/./a", "src/a"), ("src/../lib/b", "lib/b"), ("../../x", "x"), ("/abs/y", "abs/y")])
def test_paths(spark, p, want):
    assert one(spark, T.normalize_path(F.col("a")), p) == want


def test_pack_codes():
    assert V.pack_codes([0, 1, 2, 3, 3], 2) == bytes([228, 3])
    assert V.pack_codes(list(range(8)), 3) == bytes([136, 198, 250])
    assert V.pack_codes([15, 1, 8], 4) == bytes([31, 8]) and V.pack_codes([1, 0, 1], 1) == bytes([5])
    for bits in (1, 2, 3, 4):
        codes = [i % 2**bits for i in range(100)]
        assert V.unpack_codes(V.pack_codes(codes, bits), bits, 100) == codes
    for bits in (0, 5):
        with pytest.raises(ValueError):
            V.pack_codes([1], bits)


def test_quantise():
    x = np.sin(np.arange(1024) * 0.1)[None, :] * 0.03
    y = np.sin(np.arange(1024) * 0.1 + 0.1)[None, :] * 0.03
    cos = lambda a, b: float((a @ b.T)[0, 0] / np.linalg.norm(a) / np.linalg.norm(b))
    back = V.dequantise(V.quantise(x), np.linalg.norm(x, axis=1), 1024)
    assert cos(x, back) > 0.7
    levels = np.array([-1.5104, -0.4528, 0.4528, 1.5104]) / 32
    fast = float(V.rotate(x)[0] @ levels[V.quantise(y)[0]] / np.linalg.norm(x))
    assert abs(fast - cos(x, y)) < 0.3
    assert not V.quantise(np.zeros((1, 8))).any()


def test_signs_of_projection():
    x = np.random.default_rng(0).normal(size=(2, 16))
    assert (V.sign_bits(x, 32) != V.sign_bits(-x, 32)).all()


def test_symbols_and_imports():
    assert [s[:2] for s in index.symbols_of("async def f():\n    pass\nclass C:\n    def g(self): pass\n", "py")] == [("f", "async function"), ("C", "class")]
    assert [s[:4] for s in index.symbols_of("export function f() {\n  return 1\n}\nclass A {}\n", "js")] == [("f", "function", 1, 3), ("A", "class", 4, 4)]
    assert index.symbols_of("", "rs") == []
    with pytest.raises(ValueError):
        index.symbols_of("x", "zig")
    assert index.imports_of("// import a from 'a'\nimport b from './b'\nconst c = require('c')\n/* import d from 'd' */\n", "js") == ["./b", "c"]
    assert index.imports_of('import (\n  "fmt"\n  x "net/http"\n)\n', "go") == ["fmt", "net/http"]
    assert index.import_candidates("./b", "web/a.js")[1:5] == ["web/b.ts", "web/b.tsx", "web/b.js", "web/b.jsx"]


def test_imports_of_each_language(spark):
    assert index.imports_of("import a.b, c as d,e  # , f\nfrom g \\\n  import h\nimport i, \\\n  j\n", "py") == ["a.b", "c", "e", "g", "i", "j"]
    assert index.imports_of('import ("fmt"; "os") // a\nvar s = "x"\nimport (\n  . "a/b" // c\n  _ "d"\n)\nvar t = "y"\n', "go") == ["fmt", "os", "a/b", "d"]
    for e in ("cxx", "hxx"):
        assert index.imports_of('#include "a.h"\n', e) == ["a.h"] and index.symbols_of("struct p {\n};\n", e)[0][0] == "p"
    rows = [("cmd/main.go", "app/pkg/auth"), ("cmd/main.go", "app/pkg/auth"), ("cmd/main.go", "pkg/auth"), ("cmd/main.go", "fmt"), ("x/a.py", "lib.s"), ("x/a.py", "lib.s"), ("x/a.py", "u")]
    rows += [("web/a.ts", "/lib/b"), ("web/a.ts", "react"), ("web/a.ts", "./w"), ("src/k/m.rs", "crate::n"), ("c/a.cxx", "b.hxx"), ("c/a.cxx", "../z.h")]
    known = ["v/app/pkg/auth/z.go", "v/app/pkg/auth/b.go", "u/pkg/auth/c.go", "u/pkg/auth/c.py", "lib/s.pyi", "src/u.py", "lib/b.tsx", "web/w/index.js", "web/w/index.ts", "src/n.rs", "src/k/n.rs", "c/b.hxx", "z.h"]
    want = [("cmd/main.go", "app/pkg/auth", "v/app/pkg/auth/b.go")] * 2 + [("cmd/main.go", "pkg/auth", "u/pkg/auth/c.go")] + [("x/a.py", "lib.s", "lib/s.pyi")] * 2
    want += [("web/a.ts", "/lib/b", "lib/b.tsx"), ("web/a.ts", "./w", "web/w/index.ts"), ("src/k/m.rs", "crate::n", "src/k/n.rs"), ("c/a.cxx", "b.hxx", "c/b.hxx"), ("c/a.cxx", "../z.h", "z.h")]
    got = index.resolve_imports(spark.createDataFrame(rows, "relative_path string, import string"), spark.createDataFrame([(k,) for k in known], "relative_path string"))
    assert sorted(map(tuple, got.select("relative_path", "import", "resolved").collect())) == sorted(want)


def test_tree(spark):
    rows = [("app/main.py", "py", "import lib.util\nfrom lib import util\n\ndef run(x):\n    return x\n\nclass App:\n    pass\n"), ("lib/util.py", "py", "# import os\nasync def go():\n    pass\n"), ("web/a.js", "js", "import x from './b'\nexport function f(a) {\n  return a\n}\nconst k = 1;\n"), ("web/b.js", "js", "class B {\n}\n"), ("src/m.rs", "rs", "use crate::n;\npub fn f() {\n}\nstruct S {\n}\n"), ("src/n.rs", "rs", "pub enum E { A }\n"), ("c/a.c", "c", '#include "a.h"\nint main(void) {\n  return 0;\n}\n'), ("c/a.h", "h", "struct p {\n int x;\n};\n")]
    tree = spark.createDataFrame(rows, "relative_path string, extension string, content string")
    got = index.resolve_imports(index.extract_imports(tree), tree).select("relative_path", "import", "resolved").collect()
    assert sorted(map(tuple, got)) == [("app/main.py", "lib.util", "lib/util.py"), ("c/a.c", "a.h", "c/a.h"), ("src/m.rs", "crate::n", "src/n.rs"), ("web/a.js", "./b", "web/b.js")]
    got = index.extract_symbols(tree).select("relative_path", "name", "kind", "start_line", "end_line").collect()
    want = [("app/main.py", "run", "function", 4, 5), ("app/main.py", "App", "class", 7, 8), ("lib/util.py", "go", "async function", 2, 3), ("web/a.js", "f", "function", 2, 4), ("web/a.js", "k", "const", 5, 5), ("web/b.js", "B", "class", 1, 2), ("src/m.rs", "f", "function", 2, 3), ("src/m.rs", "S", "struct", 4, 5), ("src/n.rs", "E", "enum", 1, 1), ("c/a.c", "main", "function", 2, 4), ("c/a.h", "p", "struct", 1, 3)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_symbol_blocks():
    go = "package p\nconst (\n\tA = iota // a\n\tB\n\n\t// C\n)\ntype (\n\tT struct {\n\t\tx int\n\t}\n\tI interface{}\n\tN = int\n)\nvar (\n\tf = g(\n\t\t1,\n\t)\n)\nfunc F() {\n}\ntype U struct {\n}\n"
    assert [s[:4] for s in index.symbols_of(go, "go")] == [("A", "const", 3, 3), ("B", "const", 4, 4), ("T", "struct", 9, 11), ("I", "interface", 12, 12), ("N", "type", 13, 13), ("f", "const", 16, 18), ("F", "function", 20, 21), ("U", "struct", 22, 23)]
    js = "module.exports = { a, b: { c: 1, d }, 'e': [f, g], // h\n  i }\nexports.j = 1;\nmodule.exports = run;\n"
    assert [s[:4] for s in index.symbols_of(js, "js")] == [("module.exports(a, b, 'e', i)", "export", 1, 2), ("j", "export", 3, 3), ("module.exports = run", "export", 4, 4)]


def test_greedy_pack(spark):
    df = spark.createDataFrame([("g", 1, 6), ("g", 2, 5), ("g", 3, 4), ("h", 1, 11)], "g string, o long, c long")
    assert sorted(map(tuple, search.pack_greedy(df, "g", "o", "c", 10).collect())) == [("g", 1), ("g", 3)]


def test_save_outcomes(spark):
    e = lambda *x: [float(v) for v in x]
    near = e(0.95, (1 - 0.95**2) ** 0.5)
    old = spark.createDataFrame([(1, "cache sessions in redis", "a", e(1, 0)), (2, "plan one pick option four", "b", e(1, 0))], "id long, content string, category string, embedding array<double>")
    new = spark.createDataFrame([(11, "Cache sessions in Redis.", "a", near), (12, "cache sessions in redis", "z", near), (13, "plan two pick option nine", "b", near), (14, "cache sessions in redis", "a", e(0, 1))], old.schema)
    assert sorted(map(tuple, memory.save_outcomes(new, old).collect())) == [(11, "merged", 1), (12, "linked", 1), (13, "inserted", None), (14, "inserted", None)]




def test_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "relative_path string, content_hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], a.schema)
    assert dict(map(tuple, index.diff(a, b).collect())) == {"x": "unchanged", "y": "changed", "z": "stale", "w": "new"}
