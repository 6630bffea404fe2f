"""Quality rules: decision lists learned by sequential covering, emitted as ordered Spark conditional expressions.

The statistics of a text come from ``text_stats`` (one pass, whole texts). ``learn_rules`` grows conjunctions of
thresholds on them from labelled rows, prunes each on held-back rows, removes what it covers and goes on until no
rule is precise enough. ``rules_column`` turns the ordered list into CASE WHEN .. THEN false .. ELSE true.

Defined results: null and empty texts have zero for every statistic and fail the base; repeated rows and ties each
get their own equal result; an empty table gives an empty result; extra columns stay untouched in
``filter_quality``; rows whose label or text is null are not learned from; with no labels of both kinds the list is
empty and everything that passes the base is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import small_batches, table, unused

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")
#: Features the rules may test: name -> expression over the counts. All are ratios, so that they do not depend on length.
FEATURES = {
    "mean_word": lambda c: c("word_chars") / c("n_words"),
    "symbol_rate": lambda c: c("n_symbols") / c("n_words"),
    "dup_line_rate": lambda c: c("n_dup_lines") / c("n_lines"),
    "repeat_rate": lambda c: c("n_repeat_words") / c("n_words"),
    "upper_rate": lambda c: c("n_upper") / c("word_chars"),
    "mark_rate": lambda c: c("n_marks") / c("n_words"),
    "distinct_rate": lambda c: c("n_distinct") / c("n_words"),
}


def _repeated(ids: np.ndarray, vocabulary: int, width: int = 5) -> int:
    """Words that lie in a window of `width` words which occurs twice or more."""
    n = len(ids) - width + 1
    if n < 2 or vocabulary == len(ids):
        return 0
    key = ids[:n].copy()
    size = vocabulary
    for k in range(1, width):
        if size > 2**62 // vocabulary:
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
        key = key * vocabulary + ids[k : k + n]
        size *= vocabulary
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : k + n] |= twice
    return int(covered.sum())


def stats_of(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text, given as UTF-8."""
    words = text.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    joined = b"".join(words)
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    return (
        len(words),
        len(joined.decode()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(ids, len(numbers)),
        len(lines),
        sum(map(len, (w for w in words if w.isupper()))) if upper else 0,
        joined.count(b"!") + joined.count(b"?"),
        len(numbers),
    )


def _stats_batches(batches):
    for batch in batches:
        texts = batch.column(1)
        rows = [stats_of(t.as_py() or b"") for t in texts]
        columns = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(columns[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *COUNTS])


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS (long) of each row's whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(_stats_batches, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def feature(name: str) -> Column:
    """A feature as a double; null where its denominator is 0 (rules never hold for null)."""
    value = FEATURES[name](lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0)) if c in ("n_words", "word_chars", "n_lines") else F.col(c).cast("double"))
    return value


@dataclass(frozen=True)
class Rule:
    """Rejects where every (feature, '>' or '<=', threshold) holds."""

    tests: tuple[tuple[str, str, float], ...]
    covered: int
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, cut in self.tests:
            out = out & ((feature(name) > cut) if op == ">" else (feature(name) <= cut))
        return out


def _holds(x: np.ndarray, names: list[str], tests) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, op, cut in tests:
        v = x[:, names.index(name)]
        with np.errstate(invalid="ignore"):
            ok &= (v > cut) if op == ">" else (v <= cut)
    return ok


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.9, least: int = 5, max_tests: int = 3) -> list[Rule]:
    """Sequential covering over x (rows, features); bad marks the rows to reject.

    Each rule grows on two thirds of what is left by the test with the best information gain (weighted by what it
    covers of the bad rows), is pruned from its end on the other third by (p - n) / (p + n), and is taken if it is
    at least `precision` precise and covers `least` bad rows. Thresholds are midpoints between feature values, so
    that they do not sit on a training value.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    part = np.arange(len(x)) % 3
    while True:
        grow, prune = left & (part != 2), left & (part == 2)
        if bad[grow].sum() < least:
            return rules
        tests: list[tuple[str, str, float]] = []
        on = grow.copy()
        while len(tests) < max_tests and (~bad[on]).any():
            p0, n0 = bad[on].sum(), (~bad[on]).sum()
            before = np.log2(p0 / (p0 + n0))
            best: tuple[float, tuple[str, str, float]] | None = None
            for j, name in enumerate(names):
                ok = on & ~np.isnan(x[:, j])
                v, b = x[ok, j], bad[ok]
                order = np.argsort(v, kind="stable")
                v, b = v[order], b[order]
                ends = np.flatnonzero(np.diff(v) > 0)
                if not len(ends):
                    continue
                below = np.cumsum(b)[ends]
                low_n = ends + 1 - below
                for op, p, n in (("<=", below, low_n), (">", b.sum() - below, len(b) - b.sum() - low_n)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p >= least, p * (np.log2(p / (p + n)) - before), -np.inf)
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                        best = (float(gain[k]), (name, op, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
            if best is None:
                break
            tests.append(best[1])
            on &= _holds(x, names, tests[-1:])
        if not tests:
            return rules

        def worth(t, prune=prune):
            hit = prune & _holds(x, names, t)
            p, n = bad[hit].sum(), (~bad[hit]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        hit = left & _holds(x, names, tests)
        p = int(bad[hit].sum())
        if p < least or p / hit.sum() < precision:
            return rules
        rules.append(Rule(tuple(tests), int(hit.sum()), p / int(hit.sum())))
        left &= ~hit


def rules_column(rules: list[Rule]) -> Column:
    """False where the first rule that holds rejects, else true."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **learn) -> list[Rule]:
    """Rules from at most `sample_rows` labelled rows (those with the least hash of doc_id; the bound is for the
    driver's memory, and the rows that come to it are the statistics, not texts)."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    wanted = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")  # at most sample_rows ids
    rows = text_stats(wanted).join(F.broadcast(chosen), "doc_id").where(~base_failed()).select("doc_id", "quality", *(feature(f).alias(f) for f in FEATURES)).toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES], kind="stable")
    return learn_rules(rows[list(FEATURES)].to_numpy(float), (rows["quality"] == 0).to_numpy(), list(FEATURES), **learn)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept of each row."""
    return text_stats(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules_column(rules))


def filter_quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs, all columns as they are, that the base and the rules keep."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")
    counts = unused(names, *COUNTS)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])

    def add(batches):
        for b in batches:
            rows = np.array([stats_of((t.as_py() or "").encode()) for t in b.column(at)], np.int64).reshape(b.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=[*b.schema.names, *counts])

    marked = docs.mapInArrow(add, schema)
    inner = marked.select(F.struct("*").alias("row"), *(F.col(c).alias(d) for c, d in zip(counts, COUNTS)))
    kept = inner.where(~base_failed() & rules_column(rules))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in names))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(docs, fit(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
