"""Registry of the training-data queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from plantflow.llm import audio, bpe, collision_search, context_mixing, exact_dedup, filter_audit, jaccard_join, langid, mixing, passages, spelling, token_counts, toxicity

_MODULES = {
    "op1_language_id": langid,
    "op2_suffix_array_dedup": passages,
    "op3_poisson_mix": mixing,
    "op4_audio_features": audio,
    "op5_toxicity": toxicity,
    "op6_context_mixing": context_mixing,
    "op7_ngram_jaccard": jaccard_join,
    "op8_byte_bpe": bpe,
    "op9_token_counts": token_counts,
    "op10_exact_dedup": exact_dedup,
    "op11_filter_audit": filter_audit,
    "op12_collision_search": collision_search,
    "op13_spelling_variants": spelling,
}

QUERIES = {name: module.query for name, module in _MODULES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {name: module.ORACLE for name, module in _MODULES.items() if module.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
