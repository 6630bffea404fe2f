"""How the work of the n-gram join grows with a group of near copies, and families that its index by centres must not lose."""

import random

import numpy as np
import pytest

from quillmark.llm import common, ngram_join
from tests.llm.test_operators import links_by_brute_force

SCHEMA = "doc_id long, text string"


def near_copies(n, words=120, seed=3):
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for k in rnd.sample(range(words), rnd.randint(1, 3)):
            w[k] = f"x{rnd.randint(0, 5000)}"
        out.append((i, " ".join(w)))
    return out


@pytest.fixture
def pairs_given(monkeypatch):
    given, plain = [], ngram_join.verify

    def counted(pairs, sets):
        given.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(ngram_join, "verify", counted)
    return given


def test_pairs_are_linear_in_a_group(spark, pairs_given):
    sums, rest = [], []
    for n in (500, 1000):
        pairs_given.clear()
        ngram_join.link(spark.createDataFrame(near_copies(n), SCHEMA)).count()
        sums.append(sum(pairs_given))
        rest.append(pairs_given[-1])
    assert sums[1] <= 2.5 * sums[0]  # all pairs: 4
    assert rest[1] <= 5 * 1000  # all pairs across parts of these groups: some 45,000


@pytest.mark.parametrize("seed", [1, 2])
def test_families_against_brute_force(spark, monkeypatch, seed):
    """Chains, families that share a passage with other families, copies that only lack parts, one large group."""
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    rnd = random.Random(seed)
    passage = [f"p{k}" for k in range(45)]
    rows = []
    for f in range(6):
        own = [f"f{f}w{k}" for k in range(rnd.choice((40, 60, 80)))]
        base = own[:20] + passage + own[20:]
        chain = list(base)
        for i in range(30):
            w = list(base)
            if f % 3 == 0:  # each a little further from the last
                chain[rnd.randrange(len(chain))] = f"c{f}_{i}"
                w = list(chain)
            elif f % 3 == 1:  # parts lost
                at = rnd.randrange(len(w) - 12)
                del w[at : at + rnd.choice((0, 4, 8, 12))]
            for _ in range(rnd.choice((0, 1, 2, 3, 4))):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 3)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(near_copies(60, 40, seed))]
    got = ngram_join.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == links_by_brute_force(rows)


def test_nothing_is_left_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = ngram_join.link(spark.createDataFrame(near_copies(40), SCHEMA))
    assert out.count() == 40
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["linked"]
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.materialise(spark.range(3), "lost")
        1 / 0
    assert len(list(tmp_path.iterdir())) == 1


def test_a_cluster_without_a_shared_folder_raises():
    assert common._own_dir("local[8]", "test").startswith("file:///")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common._own_dir("spark://host:7077", "test")


def test_signatures_of_many_sets_stay_below_the_shingles():
    """Three million sets of prose, of which two hold a given shingle of one by accident: the shorter index has to be chosen."""
    sizes = {n: 10_000 for n in range(200, 500)}
    shingles = sum(n * many for n, many in sizes.items())
    assert ngram_join.count_signatures(sizes, 2 / shingles) <= ngram_join.PER_SHINGLE * shingles
    assert ngram_join.count_signatures(sizes, 0.02 / 350) > ngram_join.PER_SHINGLE * shingles  # where sets have much in common


def test_rounds_of_signatures(spark, monkeypatch):
    """What moves at once is bounded, and the rounds together find all links."""
    rows = near_copies(150, 40) + [(1000 + i, t) for i, (_, t) in enumerate(near_copies(150, 70, 4))] + [(5000, None), (5001, "a b c")]
    moved, plain = [], ngram_join.materialise

    def counted(df, tag, **more):
        moved.append(tag)
        return plain(df, tag, **more)

    monkeypatch.setattr(ngram_join, "materialise", counted)
    monkeypatch.setattr(ngram_join, "ROUND_ROWS", 1000)
    monkeypatch.setattr(ngram_join, "PER_SHINGLE", 0.1)
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 500)
    monkeypatch.setattr(ngram_join, "in_common", lambda rows: 0.05)
    got = ngram_join.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert moved.count("round") > 5
    assert sorted(map(tuple, got)) == links_by_brute_force(rows)


def test_rounds_of_pairs(spark, monkeypatch):
    """The sets that pairs take along at once are bounded, and the rounds together verify each pair once."""
    rows = near_copies(50, 40) + [(1000 + i, t) for i, (_, t) in enumerate(near_copies(50, 70, 4))] + [(5000, None), (5001, "a b c")]
    moved, given, plain, whole = [], [], ngram_join.materialise, ngram_join._verify

    def counted(df, tag, **more):
        moved.append(tag)
        return plain(df, tag, **more)

    def bounded(pairs, sets_a, sets_b):
        given.append((pairs.count(), sets_a.count(), sets_b.count()))
        return whole(pairs, sets_a, sets_b)

    monkeypatch.setattr(ngram_join, "materialise", counted)
    monkeypatch.setattr(ngram_join, "_verify", bounded)
    monkeypatch.setattr(ngram_join, "VERIFY_BYTES", 100_000)
    got = ngram_join.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert moved.count("verified") > 2
    assert max(n for n, _, _ in given) * 2 * 8 * 60 < 3 * 100_000 and all(b < 100 for n, _, b in given if 2 * n * 8 * 60 > 100_000)
    assert sorted(map(tuple, got)) == links_by_brute_force(rows)


def test_chance_is_that_of_the_sets(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(f"w{rnd.randrange(2)}" for _ in range(60))) for i in range(300)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ngram_join, "SAMPLE", 1)
        classes, _ = ngram_join.classify(spark.createDataFrame(rows, SCHEMA))
        got = ngram_join.in_common(classes)
    sets = {frozenset(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows}  # equal sets are one class
    wanted = sum(len(a & b) for a in sets for b in sets if a is not b) / sum(map(len, sets)) ** 2
    assert got == pytest.approx(wanted, rel=1e-6)


def test_stage_of_the_pipeline_in_rounds(spark, monkeypatch):
    """The third stage keeps one document of each component when its signatures move in rounds."""
    rows = near_copies(80, 40)
    tags, plain = [], ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, tag, **more: tags.append(tag) or plain(df, tag, **more))
    monkeypatch.setattr(ngram_join, "ROUND_ROWS", 1000)
    kept = ngram_join.stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert tags.count("round") > 1
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, _, c in links_by_brute_force(rows)})


def test_sketches_lose_no_link():
    rnd = np.random.default_rng(4)
    dropped = 0
    for n in (1, 2, 7, 63, 64, 65, 120, 500, 1030, 4097):
        for part in (0, 0.02, 0.1, 0.11, 0.12, 0.2, 0.25, 0.6):
            x = np.unique(rnd.integers(0, 2**64, n, np.uint64))
            own = rnd.integers(0, 2**64, int(n * part * rnd.uniform(0.5, 1.5)), np.uint64)
            y = np.unique(np.r_[x[int(n * part) :], own])
            same = len(np.intersect1d(x, y))
            if not len(y):
                continue
            far = [ngram_join.too_far(a, b, len(x) + len(y)) for a, b in ((ngram_join.sketch(x), ngram_join.sketch(y)), (ngram_join.sketch(y), ngram_join.sketch(x)))]
            assert far[0] == far[1]
            assert not far[0] or 100 * same < 80 * (len(x) + len(y) - same)
            dropped += far[0] and part == 0.6
    assert dropped >= 7  # of ten


def test_a_shared_passage_moves_no_sets(spark, pairs_given, monkeypatch):
    """Texts that only share a passage are told apart by their sketches."""
    rnd = random.Random(6)
    passage = [f"p{k}" for k in range(50)]
    rows = [(i, " ".join([f"w{rnd.randint(0, 10**6)}" for _ in range(40)] + passage)) for i in range(100)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(5)]
    given, whole = [], ngram_join._verify

    def counted(pairs, sets_a, sets_b):
        given.append((pairs.count(), sets_a.count()))
        return whole(pairs, sets_a, sets_b)

    monkeypatch.setattr(ngram_join, "_verify", counted)
    got = ngram_join.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == links_by_brute_force(rows)
    assert sum(pairs_given) > 100
    assert sum(n for n, _ in given) <= 0.2 * sum(pairs_given)
    assert all(n <= 2 * pairs for pairs, n in given)
