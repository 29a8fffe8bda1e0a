"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import chat_format, decontaminate, line_dedup, lm_scoring, secret_scan, sentencepiece_codec, simhash, top_k, toxicity, url_filter

QUERIES = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_line_dedup": line_dedup.query,
    "op3_benchmark_decontamination": decontaminate.query,
    "op4_exact_top_k": top_k.query,
    "op5_chat_formatting": chat_format.query,
    "op6_toxicity": toxicity.query,
    "op7_url_filters": url_filter.query,
    "op8_sentencepiece": sentencepiece_codec.query,
    "op9_secret_scans": secret_scan.query,
    "op10_simhash_near_dedup": simhash.query,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op3_benchmark_decontamination": decontaminate.SQL,
    "op4_exact_top_k": top_k.SQL,
    "op5_chat_formatting": chat_format.SQL,
    "op7_url_filters": url_filter.SQL,
}
