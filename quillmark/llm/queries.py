"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from quillmark.llm import best_fit_packing, curriculum_mix, exact_dedup, line_dedup, ngram_join, pii, quality_rules, token_rollup, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        quality_rules.op1_quality_rules,
        toxicity.op2_toxicity,
        exact_dedup.op3_exact_dedup,
        curriculum_mix.op4_curriculum_mix,
        pii.op5_pii,
        token_rollup.op6_token_counts,
        warc.op7_warc,
        best_fit_packing.op8_best_fit_packing,
        line_dedup.op9_line_dedup,
        line_dedup.op9_line_runs,
        ngram_join.op10_ngram_join,
    )
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_curriculum_mix": curriculum_mix.OP4_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op9_line_runs": line_dedup.OP9_RUNS_SQL,
}
