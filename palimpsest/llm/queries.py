"""The queries of the corpus operators, with their contracts' parameters."""

from __future__ import annotations

from palimpsest.llm import bpe, decontaminate, html_text, langid, ngram_join, pii, ppm, token_counts, toxicity, vector_dedup

QUERIES = {
    "op1_language_id": langid.query,
    "op2_personal_data": pii.query,
    "op3_byte_level_bpe": bpe.query,
    "op4_benchmark_decontamination": decontaminate.query,
    "op5_vector_dedup": vector_dedup.query,
    "op6_ngram_jaccard_join": ngram_join.query,
    "op7_ppm_scores": ppm.query,
    "op8_html_text": html_text.query,
    "op9_toxicity": toxicity.query,
    "op10_token_counts": token_counts.query,
    "language_id_pages": langid.pages_query,
    "personal_data_base": pii.base_query,
    "bpe_round_trip": bpe.round_trip_query,
    "lm_tokens": ppm.tokens_query,
}

#: What SQL can express of them; the others are tested against brute force, a library or held-out rows.
ORACLES: dict[str, str] = {
    "op4_benchmark_decontamination": decontaminate.ORACLE,
    "op5_vector_dedup": vector_dedup.ORACLE,
    "op6_ngram_jaccard_join": ngram_join.ORACLE,
    "personal_data_base": pii.BASE_ORACLE,
    "bpe_round_trip": bpe.ROUND_TRIP_ORACLE,
    "lm_tokens": ppm.TOKENS_ORACLE,
}
