"""Pairs of notes in blocks: against brute force, and how much they move."""

import itertools

import numpy as np
import pytest

from quillmark.operators import memory, tiles

DATED = "id long, content string, embedding array<float>, created_at timestamp_ntz"
NOTES = "id long, content string, category string, embedding array<float>"


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite() / 1e6


def cosine(x, y):
    x, y = np.float32(x).astype(float), np.float32(y).astype(float)
    size = np.linalg.norm(x) * np.linalg.norm(y)
    return 0.0 if size < 1.19e-7 else float(x @ y) / size


def outcomes(new, old, least, jaccard):
    words = lambda n: set(n[1].split())
    out = set()
    for n in new:
        best = None
        for o in old if n[1] is not None else ():
            if o[0] == n[0] or o[1] is None:
                continue
            both, union = len(words(n) & words(o)), len(words(n) | words(o))
            s = cosine(n[3], o[3])
            if (both / union if union else 1.0) >= jaccard and s >= least and (best is None or (-s, o[0]) < best[:2]):
                best = (-s, o[0], o[2])
        out.add((n[0], "inserted", None) if best is None else (n[0], "merged" if best[2] == n[2] else "linked", best[1]))
    return out


def test_save_outcomes_in_blocks(spark, monkeypatch):
    """Sets of very different sizes, some of them empty, near or equal, over several blocks."""
    monkeypatch.setattr(tiles.dealt, "__defaults__", (0.0, 8000))
    rng = np.random.default_rng(5)
    families = [[f"w{x}" for x in rng.choice(3000, n, replace=False)] for n in (0, 1, 2, 3, 5, 9, 20, 60, 61, 150, 700)]

    def notes(first, n):
        out = []
        for k in range(first, first + n):
            own = families[rng.integers(len(families))]
            text = " ".join(w if rng.random() > 0.2 else f"w{rng.integers(3000)}" for w in own)
            out.append((k, None if rng.random() < 0.03 else text, "ab"[rng.integers(2)], [float(np.float32(x)) for x in rng.normal(size=6)]))
        return out

    old, new = notes(0, 160), notes(1000, 90)
    frame = lambda rows: spark.createDataFrame(rows, NOTES)
    got = set(map(tuple, memory.save_outcomes(frame(new), frame(old), 0.2, 0.5).collect()))
    assert got == outcomes(new, old, 0.2, 0.5) and {x[1] for x in got} == {"inserted", "merged", "linked"}
    both = frame(old + new)
    assert set(map(tuple, memory.save_outcomes(both, both, -1.0, 0.7).collect())) == outcomes(old + new, old + new, -1.0, 0.7)


def test_a_shared_word_moves_no_pairs(spark):
    """1500 notes with a long word in common, and nothing else: 2,248,500 candidates once went through a shuffle."""
    rows = [(k, "longestwordofall " + " ".join(f"w{k}x{i}" for i in range(6)), "a", [1.0, 0.0]) for k in range(1500)]
    notes, before = spark.createDataFrame(rows, NOTES), shuffled(spark)
    assert {r["outcome"] for r in memory.save_outcomes(notes, notes, -1.0, 0.5).collect()} == {"inserted"}
    assert shuffled(spark) - before < 6


def dated(spark, rows):
    """(id, content, embedding, day of January) as notes."""
    return spark.createDataFrame([(k, text, v, None if day is None else f"2024-01-{day:02d}") for k, text, v, day in rows], DATED.replace("timestamp_ntz", "string")).selectExpr("id", "content", "embedding", "cast(created_at as timestamp_ntz) created_at")


def contradicting(rows, least, days, least_divergence):
    low = lambda t: [c.lower() if c.isascii() else c for c in t]
    for (a, x, v, d), (b, y, w, e) in itertools.combinations(sorted(rows), 2):
        if None not in (x, y, d, e) and abs(d - e) >= days and (s := cosine(v, w)) >= least:
            n, most = min(len(x), len(y)), max(len(x), len(y))
            part = (sum(p != q for p, q in zip(low(x), low(y))) + most - n) / most if most else 0.0
            if part >= least_divergence:
                yield a, b, pytest.approx(s, abs=1e-12), pytest.approx(part, abs=1e-12)


@pytest.fixture
def odd_notes():
    rng = np.random.default_rng(8)
    parts = ["a", "A", "bc", "é", "É", "ß", "—", "語", "😀", " ", "\n", "xyz" * 9]
    texts = [None, "", "a", *("".join(rng.choice(parts, rng.integers(1, 60))) for _ in range(20))]
    some = rng.normal(size=(12, 5))
    vector = lambda: [float(np.float32(x)) for x in (some[rng.integers(12)] if rng.random() < 0.7 else rng.normal(size=5) * (rng.random() > 0.2))]
    return [(k, texts[rng.integers(len(texts))], vector(), None if rng.random() < 0.04 else int(rng.integers(1, 29))) for k in range(150)]


@pytest.mark.parametrize("least", [0.6, -0.2])
def test_contradictions_in_blocks(spark, monkeypatch, odd_notes, least):
    monkeypatch.setattr(memory, "TEXT_BLOCK_BYTES", 1500)
    notes, want = dated(spark, odd_notes), list(contradicting(odd_notes, least, 7, 0.3))
    assert sorted(map(tuple, memory.contradictions(notes, least).collect())) == want and len(want) > 100
    best = sorted(want, key=lambda x: (-round(x[2].expected, 6), x[0], x[1]))[:30]
    got = [(min(x[:2]), max(x[:2]), *x[2:]) for x in map(tuple, memory.contradiction_review(notes, 30, least).collect())]
    assert sorted(got) == sorted(best)


def test_review_takes_ties_by_id(spark):
    """Both pairs are alike by 1.000000; by more places the second is more so, and it was taken once."""
    v = [[1.0, 0.0], [1.0, 6e-4], [0.0, 1.0], [0.0, 1.0]]
    notes = dated(spark, [(k, "ab"[k % 2], v[k], 1 + k % 2 * 20) for k in range(4)])
    assert [tuple(r)[:2] for r in memory.contradiction_review(notes, 1).collect()] == [(0, 1)]


@pytest.mark.parametrize("limit", [None, 5])
def test_pairs_move_no_texts(spark, limit):
    """1200 pairs of texts of 10 kB: each pair once took both along."""
    rng = np.random.default_rng(2)
    rows = [(k, "".join(map(chr, rng.integers(33, 127, 10_000))), [1.0, 0.005 * k], 1 + 20 * (k % 2)) for k in range(70)]
    notes, key = dated(spark, rows), "spark.sql.autoBroadcastJoinThreshold"
    was, before = spark.conf.get(key), shuffled(spark)
    spark.conf.set(key, "-1")
    try:
        found = memory.contradictions(notes) if limit is None else memory.contradiction_review(notes, limit)
        assert len(found.collect()) == (1225 if limit is None else limit)
    finally:
        spark.conf.set(key, was)
    assert shuffled(spark) - before < 8
