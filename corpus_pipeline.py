"""From documents to packed training sequences, in five stages. Each is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import best_fit_packing, curriculum_mix, exact_dedup, ngram_join, quality_rules
from quillmark.llm.common import materialise, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_join", ngram_join.stage),
    ("curriculum_mix", curriculum_mix.stage),
    ("best_fit_packing", best_fit_packing.stage),
]

#: Learned rules and tokenizer ids are beyond SQL; tests hold the operators behind the stages against brute force, not the chain as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
