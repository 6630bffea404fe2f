import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quillmark.llm import best_fit_packing, bpe, curriculum_mix, exact_dedup, line_dedup, ngram_join, pii, quality_rules, queries, token_rollup, toxicity, warc
from quillmark.llm.common import new_path, table
from tests.oracle import duck, same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(3000))
EDGE = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two three", "en", None, 13), (4, "one  two three", None, "b", 14), (5, LONG, "en", "b", len(LONG)),
    (6, LONG + " end", "en", "b", len(LONG) + 4), (6, LONG + " end", "en", "b", len(LONG) + 4), (None, "lost id", "en", "c", 7), (7, " \t\n ", "en", "c", 4), (8, "x é 😀 call +1 (212) 555-0199", "de", "c", 9),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_statistics(spark, edge, none):
    def brute(text):
        w = words(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    rnd = random.Random(1)
    texts = [r[1] for r in EDGE] + ["a b c d e a b c d e a", "x\nx\n\nx y\n"] + ["".join(rnd.choices(["a", "b ", "c\n", "#", "é "], k=rnd.randint(0, 80))) for _ in range(200)] + [r[0] for r in table(spark, SF, "documents").select("text").collect()]
    for t in texts:
        assert quality_rules.stats_of((t or "").encode())[:5] == brute(t)
    assert quality_rules.judge(edge, []).count() == len(EDGE) and quality_rules.judge(none, []).count() == 0
    clash = edge.withColumn("N_WORDS", edge.doc_id)
    assert quality_rules.filter_quality(clash, []).columns == clash.columns


def test_quality_rules_learn():
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.5)
    rules = quality_rules.learn_rules(x, bad, ["mean_word", "symbol_rate"])
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= quality_rules._holds(x, ["mean_word", "symbol_rate"], r.tests)
    assert (hit == bad).mean() > 0.97 and all(r.precision >= 0.9 for r in rules)
    assert quality_rules.learn_rules(x, np.zeros(600, bool), ["mean_word", "symbol_rate"]) == []


def test_network_gradient():
    n = toxicity.Network.new(1)
    n.w = {k: v.astype(float) for k, v in n.w.items()}
    rng = np.random.default_rng(0)
    x, index, mask = rng.normal(size=(10, toxicity.INPUTS)), rng.integers(0, 10, (7, 5)), np.ones((7, 5))
    mask[5:, 2] = 0
    batch = (x, index, mask, np.array([0, 1, 0, 1, 1.0]), np.array([1, 2, 1, 2, 1.0]))
    _, g = n.gradient(*batch)
    for k, a in n.w.items():
        i = tuple(rng.integers(0, s) for s in a.shape)
        old, e = a[i], 1e-4
        a[i] = old + e
        up = n.gradient(*batch)[0]
        a[i] = old - e
        down = n.gradient(*batch)[0]
        a[i] = old
        assert abs((up - down) / 2 / e - g[k][i]) < 1e-4


def test_toxicity_held_out(spark, edge, none):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op2_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    true = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert true / (got.toxic == 1).sum() > 0.85 and true / (got.predicted == 1).sum() > 0.85
    model = toxicity.learn(["bad word", "good one", "bad thing", "fine thing"] * 3, [1, 0, 1, 0] * 3, epochs=1)
    scores = [r["score"] for r in toxicity.score(edge, model).collect()]
    assert len(scores) == len(EDGE) and all(0 <= x <= 1 for x in scores) and toxicity.score(none, model).count() == 0
    assert toxicity.learn(["a"], [0]).scores(["x", None]).tolist() == [0.0, 0.0]


def test_toxicity_windows():
    """Every passage of up to 41 words stands whole in a window."""
    for n in (1, 40, 48, 49, 55, 56, 57, 100, 333):
        starts = toxicity.windows(n)
        for size in range(1, min(n, 41) + 1):
            for a in range(n - size + 1):
                assert any(w <= a and a + size <= w + toxicity.WIDTH for w in starts)


def test_exact_dedup(spark, edge, none):
    got = {(r["doc_id"], r["kept"]): r for r in exact_dedup.classes(edge).collect()}
    assert got[(4, True)]["keep_id"] == got[(3, False)]["keep_id"] == 4 and got[(3, False)]["group_size"] == 2
    assert {k for k in got if k[0] == 6} == {(6, True), (6, False)} and got[(7, True)]["group_size"] == 3
    assert exact_dedup.classes(none).count() == 0
    assert exact_dedup.keep_one(edge).count() == sum(k[1] for k in got)
    weak = lambda c, seed: exact_dedup.identifier(c if seed else c.substr(1, 1), seed)  # noqa: E731  seed 0 clashes
    texts = spark.createDataFrame([(i, f"same start, other end {i % 3}") for i in range(9)], "doc_id long, text string")
    assert sorted(r["group_size"] for r in exact_dedup.classes(texts, weak).collect()) == [3] * 9
    t = spark.createDataFrame([(LONG * 5,), ("ab",), ("",)], "t string")
    for r in t.select("t", exact_dedup.chunks(t.t).alias("c")).collect():
        assert "".join(r["c"]) == r["t"] and all(len(x) <= exact_dedup.MOST for x in r["c"])


def test_mix(spark, edge, none):
    rows = curriculum_mix.places(edge.select("doc_id", "source", curriculum_mix.size(edge.text).alias("size"))).collect()
    assert len(rows) == len(EDGE) and all(r["taken"] <= 2 * r["size"] and len(r["positions"]) == r["copies"] for r in rows)
    assert curriculum_mix.mix(none).count() == 0 and curriculum_mix.mix(edge).columns == edge.columns
    big = curriculum_mix.op4_curriculum_mix(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "source"), "doc_id").toPandas()
    for _, g in big.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert np.isclose(big.groupby("source").target.first().sum(), 1.5 * big["size"].sum())


def test_pii(spark, edge, none):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": all(p.isdigit() and int(p) <= 255 for p in s.split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    def brute(t):
        return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t) if good(k, m.group())]

    rnd = random.Random(3)
    for _ in range(4000):
        t = "".join(rnd.choices("ab1234.@+-() %0", k=rnd.randint(0, 40)))
        assert brute(t) == pii.base_spans(t)
    model = pii.trained()
    for text, gold in pii.training_lines(150, 99):
        assert set(gold) == set(model.spans(text))
    got = {r["doc_id"]: r for r in pii.detect(edge).collect()}
    assert got[8]["spans"][0]["kind"] == "phone" and got[1]["spans"] == [] and pii.detect(none).count() == 0


def test_pii_long_mailboxes():
    model, long = pii.trained(), "a" * 30 + "." + "b" * 30
    for box in (f"{long}(at)example(dot)com", f"{long} (at) example (dot) com", f"anna.lee(at){'c' * 60}(dot)com", f"anna.lee (at) {'c' * 60} (dot) com", "anna.lee(AT)example(DOT)com", "anna.lee [At] example.com"):
        assert model.spans(f"mail {box} now") == [("email", 5, 5 + len(box))], box
    assert pii.regions("x" * 100 + "1" + "y" * 100 + " z " + "w" * 90) == [(0, 201)]
    assert pii.regions(("x" * 100 + "1") * 3) == [(0, 303)]


def test_semi_markov_sums():
    """Forward and backward sums against all segmentations of a small lattice."""
    spans = [(0, 2, "a", ("x",)), (1, 3, "a", ("y",)), (2, 4, "b", ("x", "z"))]
    m = pii.SemiMarkov({"x": 0.5, "y": 1.0, "z": -0.2, "adjacent": 0.3})

    def all_of(t):
        if t == 4:
            yield []
            return
        yield from all_of(t + 1)
        for k, s in enumerate(spans):
            if s[0] == t:
                for rest in all_of(s[1]):
                    yield [k, *rest]

    score = lambda ks: sum(m.w[f] for k in ks for f in spans[k][3]) + 0.3 * sum(spans[a][1] == spans[b][0] for a, b in zip(ks, ks[1:]))
    ways = list(all_of(0))
    z = sum(math.exp(score(w)) for w in ways)
    p, _ = m.expected(4, spans)
    for k in range(3):
        assert math.isclose(p[k], sum(math.exp(score(w)) for w in ways if k in w) / z)
    assert m.decode(4, spans) == max(ways, key=score)


def test_rollup(spark):
    r = token_rollup.TokenRollup(spark, new_path(spark, "rollup"))
    assert r.totals().count() == 0
    make = lambda *x: spark.createDataFrame(x, "source string, lang string, tokenizer_version string, kind string, n_tokens long, n_chars long, old_tokens long, old_chars long")
    first = make(("a", "en", "v1", "insert", 10, 50, None, None), (None, "en", "v1", "insert", 4, 20, None, None), ("a", "en", "v1", "insert", 1, 5, None, None))
    assert r.apply("1", first) and not r.apply("1", first)
    assert r.apply("2", make(("a", "en", "v1", "revise", 12, 50, 10, 50), (None, "en", "v1", "delete", 4, 20, None, None)))
    want = [("a", "en", "v1", 2, 13, 55)]
    assert list(map(tuple, r.totals().collect())) == want
    r.compact()
    assert not r.apply("2", first) and list(map(tuple, r.totals().collect())) == want
    assert r.apply("3", make(("a", "en", "v1", "insert", 1, 1, None, None)))
    r.compact()
    assert r.batches() == {"1", "2", "3"} and r.totals().first()["n_tokens"] == 14


def test_rollup_counts(spark):
    got = token_rollup.op6_token_counts(spark, SF).toPandas()
    enc, docs = bpe.load(*bpe.public()), table(spark, SF, "documents").toPandas()
    want = docs.assign(n=[len(enc.exact.encode(t, add_special_tokens=False).ids) for t in docs.text]).groupby(["source", "lang"]).n.agg(["size", "sum"])
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got.itertuples()} == {k: tuple(v) for k, v in want.iterrows()}


def test_rollup_changes_of_whole_table(spark, monkeypatch):
    seen, apply = [], token_rollup.TokenRollup.apply

    def spy(self, batch, changes):
        done = apply(self, batch, changes)
        seen.extend((r["kind"], r["count"], done) for r in changes.groupBy("kind").count().collect())
        return done

    monkeypatch.setattr(token_rollup.TokenRollup, "apply", spy)
    got = token_rollup.op6_token_counts(spark, SF)
    docs = table(spark, SF, "documents")
    n = docs.count()
    assert sorted(x for x in seen if x[2]) == [("delete", n, True), ("insert", n, True), ("insert", n, True), ("revise", n, True)] and len(seen) == 8
    fresh = token_rollup.count_tokens(docs).groupBy(*token_rollup.KEYS).agg({"*": "count", "n_tokens": "sum", "n_chars": "sum"})
    want = fresh.select(*token_rollup.KEYS, "count(1)", "sum(n_tokens)", "sum(n_chars)").collect()
    assert sorted(map(tuple, got.select(*token_rollup.KEYS, *token_rollup.SUMS).collect())) == sorted(map(tuple, want))


def test_bpe_routes():
    enc, rnd = bpe.load(*bpe.public()), random.Random(1)
    letters = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250), 0x2019, 0x2026, 0x3042, 0x1F600)] + [" "] * 80 + ["'s", "<|endoftext|>", "\n\n"] * 4
    for _ in range(1500):
        t = "".join(rnd.choices(letters, k=rnd.randint(0, 60)))
        assert enc.ids(t).tolist() == enc.exact.encode(t, add_special_tokens=False).ids


def test_warc(spark):
    rows = [(1, "http://a\n", "x" * 2000, 0), (2, "http://b", "x" * 2000, 0), (2, None, "x" * 2000, 0), (3, "http://c", None, 0), (None, "http://d", "y" * 999, 0), (5, "u", "\x1f\x8b\x08" * 3000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    manifest = warc.write_archives(warc.plan_records(pages), new_path(spark, "warc"))
    for split in (13, 100, 1 << 20):
        got = warc.read_archives(manifest, split).collect()
        assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in got) == [(0, "response", 0, 999), (1, "revisit", 2, 2000), (2, "response", 0, 2000), (2, "response", 0, 2000), (3, "response", 0, 0), (5, "response", 0, 12000)]
    empty = warc.write_archives(warc.plan_records(pages.limit(0)), new_path(spark, "warc"))
    assert warc.read_archives(empty).count() == 0


def test_packing(spark, edge, none):
    got = best_fit_packing.pack(best_fit_packing.tokenise(edge)).toPandas()
    enc = bpe.load(*bpe.public())
    total = 0
    for doc, text in {(r[0], r[1]) for r in EDGE}:
        ids = enc.exact.encode(text or "", add_special_tokens=False).ids + [0]
        mine = got[got.doc_id.isna() if doc is None else got.doc_id == doc].sort_values(["piece", "sequence_id"])
        copies = sum(r[0] == doc for r in EDGE)
        assert sorted(sum(map(list, mine.ids), [])) == sorted(ids * copies) and (len(ids) <= 2048 or (mine.length[mine.piece > 0] == 2048).all())
        total += len(ids) * copies
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == g.length.cumsum().to_numpy() - g.length.to_numpy()).all() and g.length.sum() <= 2048
    assert got.length.sum() == total and best_fit_packing.pack(best_fit_packing.tokenise(none)).count() == 0


def test_local_search():
    rng = np.random.default_rng(4)
    for high in (300, 1100, 2000):
        sizes = rng.integers(1, high, 900)
        first = best_fit_packing.best_fit(sizes)
        bins = best_fit_packing.local_search(sizes, first)
        assert np.bincount(bins, weights=sizes).max() <= 2048 and -(-sizes.sum() // 2048) <= bins.max() + 1 <= first.max() + 1
    sizes = np.array([1000, 1000, 1048, 1048])  # an exchange empties nothing here, but 2 bins are best
    assert best_fit_packing.pack_sizes(sizes).max() == 1


def test_toxicity_logits_of_both_ways(monkeypatch):
    """logit(), which only scores, and forward(), which trains, agree for any number of windows and any lengths."""
    rng = np.random.default_rng(4)
    network = toxicity.Network.new(3)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    for lengths in ([1], [48, 30, 100, 2, 47, 49], [3] * 20):
        words, index, mask, _ = toxicity.cut([[f"w{rng.integers(0, 40)}" for _ in range(n)] for n in lengths])
        x = np.vstack([rng.normal(0, 3, (len(words), toxicity.INPUTS)), np.zeros((1, toxicity.INPUTS))]).astype(np.float32)
        assert np.allclose(network.logit(x, index, mask), network.forward(x, index, mask)[0], atol=1e-5)
    assert len(network.logit(x, index[:, :0], mask[:, :0])) == 0


def test_line_dedup(spark, edge, none):
    assert line_dedup.dedup_lines(none).count() == 0
    clash = edge.withColumn("Q_GONE", edge.doc_id)
    assert line_dedup.dedup_lines(clash).columns[: len(clash.columns)] == clash.columns
    t = spark.createDataFrame([("a\n\nb\x01\x01c\n\x01\nd",), ("",), ("\n\n",)], "t string")
    for r in t.select("t", line_dedup.line_chunks(t.t).alias("c")).collect():
        assert "\n".join(r["c"]) == r["t"]
    block = "\n".join(f"a shared line of words number {i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"own start {i}\n{block}\nown end {i}") for i in range(5)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0]["n_removed_lines"] == 0 and all(got[i]["n_removed_lines"] > 4 for i in range(1, 5))


def test_line_runs(spark, edge, none):
    """Passages of 2 to 5 lines with different neighbours go whole, and nothing else goes."""
    assert line_dedup.dedup_runs(none).count() == 0
    clash = edge.withColumn("Q_GONE", edge.doc_id)
    assert line_dedup.dedup_runs(clash).columns[: len(clash.columns)] == clash.columns
    rows, want = [], {}
    for n in (2, 3, 4, 5):
        for v in range(10):
            passage = "\n".join(f"passage {n} {v} line {i}" for i in range(n))
            for c in range(3):
                rows.append((len(rows), f"own start {len(rows)}\n{passage}\nown end {len(rows)}"))
                want[len(rows) - 1] = (n if c else 0, f"own start {len(rows) - 1}\nown end {len(rows) - 1}" if c else rows[-1][1])
    rows += [(900, None), (901, ""), (902, "p\n \nq\nx"), (903, "y\np\n\n\nq"), (904, "p\nr\nq"), (905, "\n\n")]
    want |= {900: (0, None), 901: (0, ""), 902: (0, rows[-4][1]), 903: (4, "y"), 904: (0, "p\nr\nq"), 905: (0, "\n\n")}
    got = line_dedup.dedup_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed_lines"], r["text"]) for r in got} == want


def links_by_brute_force(rows):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def test_ngram_join(spark, edge, none):
    rnd = random.Random(5)
    rows = []
    for f in range(25):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice((3, 6, 9, 14, 30, 120)))]
        for _ in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"W{rnd.randint(0, 400)}"
            if rnd.random() < 0.3:
                w += ["the", "common", "tail", "of", "many", "texts", "here"]
            rows.append((len(rows), " ".join(w[rnd.randint(0, 1) :])))
    rows += [(900, None), (901, " "), (902, "a b"), (903, "A  b")]
    rnd.shuffle(rows)
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == links_by_brute_force(rows)
    assert ngram_join.link(none).count() == 0 and ngram_join.link(edge).count() == len(EDGE)


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", most)
    rnd = random.Random(6)
    pairs = [(i, i + 1) for i in range(100, 117)] + [(rnd.randint(-40, 40), rnd.randint(-40, 40)) for _ in range(45)]
    least = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = ngram_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(least.items())
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_group_by_centre(spark, monkeypatch):
    """Variants of one text that link with one another through shared changes, with few hubs, so that pairs across parts go by the centre."""
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    moved, plain = [], ngram_join.by_centre

    def counted(named, sets):
        links, found = plain(named, sets)
        moved.append((named.count(), links.count()))
        return links, found

    monkeypatch.setattr(ngram_join, "by_centre", counted)
    rnd = random.Random(7)
    rows = []
    for i in range(140):
        w = [f"w{k}" for k in range(60)]
        for k in rnd.sample(range(2, 58, 5), rnd.choice((0, 1, 2, 2, 3, 3, 4))):
            w[k] = f"x{k}{rnd.randint(0, 1)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == links_by_brute_force(rows)
    assert moved[0][0] > 50


def test_bands_hold_all_links():
    for a in range(1, 400):
        for b in range(a, a * 5 // 4 + 1):
            i, j = (int(np.searchsorted(ngram_join._LEAST, x, "right")) for x in (a, b))
            assert j - i <= 1 and (a + b) // 9 <= 2 * ngram_join.bands()[j - 1][1] // 9


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 50
    assert corpus_pipeline.run(spark, SF).count() > 50
    assert duck("select 1 as x", SF).x[0] == 1
