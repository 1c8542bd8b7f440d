"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, language_model, near_dedup, periodic_runs, quality_rules, resampling, source_mix, substring_dedup, token_files, toxicity, url_filter, warc

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_source_mix": source_mix.op4_source_mix,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_warc": warc.op8_warc,
    "op9_token_files": token_files.op9_token_files,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_resampling": resampling.op11_resampling,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_lm_scoring": language_model.op13_lm_scoring,
}
ORACLES = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op4_source_mix": source_mix.OP4_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_resampling": resampling.OP11_SQL,
    "op13_lm_scoring": language_model.OP13_SQL,
}
