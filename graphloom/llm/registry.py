"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, language_id, lm_score, media_jpeg, pipeline, sentencepiece_backend, sharding, simhash, substring_dedup, suffix_dedup, wordpiece_len


QUERIES = {
    "pipeline": pipeline.run,
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_language_id": language_id.op3_language_id,
    "op4_token_counts": wordpiece_len.op4_token_counts,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_sentencepiece": sentencepiece_backend.op7_sentencepiece,
    "op8_simhash": simhash.op8_simhash,
    "op9_lm_score": lm_score.op9_lm_score,
    "op10_media_jpeg": media_jpeg.op10_media_jpeg,
}
SQL = {
    "op1_suffix_array_dedup": suffix_dedup.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op6_sharding": sharding.SQL,
    "op9_lm_score": lm_score.SQL,
}
if pipeline.ORACLE_SQL:
    SQL["pipeline"] = pipeline.ORACLE_SQL
