"""Queries and SQL of the training-data operators, for the driver's registry."""

from __future__ import annotations

from . import decontaminate, html_extract, lm_score, mixing, ngram_join, quality, repeats, sharding, toxicity, url_filter

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_html": html_extract.op6_html,
    "op7_repeats": repeats.op7_repeats,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_lm_score": lm_score.op10_lm_score,
}

SQL = {
    "op1_sharding": sharding.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op3_quality": quality.OP3_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
    "op8_ngram_join": ngram_join.OP8_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
}
