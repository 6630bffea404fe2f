"""Delta-maintained token counts by source, language and tokenizer version.

A batch of signed changes (insert: +1, delete: -1, revise: the old count out and the new one in) is summed to one
row per key and written as one directory of the delta log, named by the batch. The directory appears by a single
rename of a finished write, so a batch is there as a whole or not at all, and a batch that is there already is not
applied again: a repeated delivery, or a job run again after a failure, changes nothing. Totals are the sums over
the log; ``compact`` folds committed batches into one snapshot that remembers their names.

Defined results: null source or lang are keys of their own; null text has 0 tokens; repeated rows count each;
an empty batch commits and adds nothing; keys whose documents have all gone stay out of the totals; extra columns
are ignored; an unknown change kind is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe
from quillmark.llm.common import materialise, new_path, small_batches, table

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens", "n_chars")
_SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"


def count_tokens(docs: DataFrame, version: str = "byte_bpe_50k", tokenizer: tuple = ()) -> DataFrame:
    """source, lang, tokenizer_version, n_tokens and n_chars of each row's whole text."""
    small_batches(docs.sparkSession)
    how = tokenizer or bpe.public(version)

    def run(batches):
        enc = bpe.load(*how)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(2)]
            n = np.fromiter((len(enc.ids(t)) for t in texts), np.int64, len(texts))
            chars = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([version] * len(texts), pa.string()), pa.array(n), pa.array(chars)], names=[*KEYS, "n_tokens", "n_chars"])

    return docs.select("source", "lang", "text").mapInArrow(run, "source string, lang string, tokenizer_version string, n_tokens long, n_chars long")


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def batches(self) -> set[str]:
        """Names of the committed batches, folded ones included."""
        names = {f.getPath().getName() for f in self._fs.listStatus(self._at("log"))} if self._fs.exists(self._at("log")) else set()
        out = set()
        for n in names:
            if n.startswith("batch-"):
                out.add(n[6:])
            elif n.startswith("snapshot-") and self._newest() == n:
                out |= {r[0] for r in self.spark.read.text(f"{self.path}/log/{n}/names").collect()}
        return out

    def _newest(self) -> str | None:
        if not self._fs.exists(self._at("log")):
            return None
        return max((n for f in self._fs.listStatus(self._at("log")) if (n := f.getPath().getName()).startswith("snapshot-")), default=None)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits signed changes (KEYS, kind, n_tokens, n_chars, for 'revise' also old_tokens and old_chars). False if the batch was there."""
        if not batch or "/" in batch:
            raise ValueError(f"a batch name without '/' is needed, not {batch!r}")
        if batch in self.batches():
            return False
        kind = F.col("kind")
        sign = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown change "), F.coalesce(kind, F.lit("null")))).cast("int"))

        def net(name: str, old: str) -> Column:
            before = F.coalesce(F.col(old), F.lit(0)) if old in changes.columns else F.lit(0)
            value = F.coalesce(F.col(name), F.lit(0))
            return F.sum(F.when(kind == "revise", value - before).otherwise(sign * value)).cast("long").alias(name)

        delta = changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("n_docs"), net("n_tokens", "old_tokens"), net("n_chars", "old_chars"))
        self._commit(f"batch-{batch}", lambda at: delta.write.mode("overwrite").parquet(at))
        return True

    def _commit(self, name: str, write) -> None:
        """Writes aside, then renames: the only step that others can see."""
        aside = f"{self.path}/aside/{name}"
        write(aside)
        self._fs.mkdirs(self._at("log"))
        if self._fs.exists(self._at(f"log/{name}")) or not self._fs.rename(self._at(f"aside/{name}"), self._at(f"log/{name}")):
            self._fs.delete(self._at(f"aside/{name}"), True)

    def totals(self) -> DataFrame:
        """KEYS and SUMS over all committed batches."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("log"))] if self._fs.exists(self._at("log")) else []
        newest = self._newest()
        done = {r[0] for r in self.spark.read.text(f"{self.path}/log/{newest}/names").collect()} if newest else set()
        paths = [f"{self.path}/log/{n}" for n in names if n.startswith("batch-") and n[6:] not in done] + ([f"{self.path}/log/{newest}/sums"] if newest else [])
        log = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        out = log.groupBy(*KEYS).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))
        return out.where(" or ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Folds all committed batches into one snapshot; a batch file left over by a crash is known by its name and not counted twice."""
        names, old, newest = sorted(self.batches()), self._newest(), self._newest()
        number = int(newest.split("-")[1]) + 1 if newest else 1
        totals = self.totals()

        def write(at: str) -> None:
            totals.write.mode("overwrite").parquet(f"{at}/sums")
            self.spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/names")

        self._commit(f"snapshot-{number:09d}", write)
        for n in names:
            self._fs.delete(self._at(f"log/batch-{n}"), True)
        if old:
            self._fs.delete(self._at(f"log/{old}"), True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals by source, language and version after four batches over all documents, each delivered twice.

    All documents are inserted with a guess of their tokens, inserted once more with the true count, deleted once, and
    revised from the guess to the true count. The totals are those of a fresh count.
    """
    rollup = TokenRollup(spark, new_path(spark, "rollup"))
    counts = materialise(count_tokens(table(spark, sf_dir, "documents")), "token-counts")
    guess = F.floor(F.col("n_chars") / 4).cast("long") + 1
    batches = {
        "load-documents": counts.withColumns({"kind": F.lit("insert"), "n_tokens": guess}),
        "load-again": counts.withColumn("kind", F.lit("insert")),
        "delete-again": counts.withColumn("kind", F.lit("delete")),
        "revise-documents": counts.withColumns({"kind": F.lit("revise"), "old_tokens": guess, "old_chars": F.col("n_chars")}),
    }
    for name, changes in batches.items():
        for _ in range(2):
            rollup.apply(name, changes)
    return rollup.totals()
