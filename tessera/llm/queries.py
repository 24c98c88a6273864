"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from functools import wraps

from tessera.llm import decontaminate, exact_dedup, jaccard_join, lang_id, mixing, quality, substring_dedup, token_counts, toxicity, url_filter
from tessera.llm.common import workers_find_package


def _ready(query):
    @wraps(query)
    def run(spark, sf_dir):
        workers_find_package(spark)
        return query(spark, sf_dir)

    return run


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: _ready(f)
    for f in (
        lang_id.op1_language_id,
        exact_dedup.op2_exact_dedup,
        quality.op3_quality_classifier,
        token_counts.op4_token_counts,
        url_filter.op5_url_filters,
        decontaminate.op6_decontamination,
        toxicity.op7_toxicity,
        substring_dedup.op8_substring_dedup,
        jaccard_join.op9_ngram_jaccard_join,
        mixing.op10_mixing,
        pipeline,
    )
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op5_url_filters": url_filter.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_ngram_jaccard_join": jaccard_join.ORACLE,
}
