"""Queries of the training-data operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

from . import bpe, chat, debruijn, decontaminate, lm, near_dup, quality, resampling, secrets, toxicity, url_filter, warc, whitening


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_warc": warc.op2_warc,
        "op3_bpe_roundtrip": bpe.op3_bpe_roundtrip,
        "op4_preferences": chat.op4_preferences,
        "op5_near_dup": near_dup.op5_near_dup,
        "op6_quality": quality.op6_quality,
        "op7_lm": lm.op7_lm,
        "op8_secrets": secrets.op8_secrets,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_resampling": resampling.op11_resampling,
        "op12_whitening": whitening.op12_whitening,
        "op13_substring_dedup": debruijn.op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_preferences": chat.OP4_SQL, "op6_quality": quality.op6_sql(), "op9_decontaminate": decontaminate.op9_sql(), "op10_url_filter": url_filter.OP10_SQL}
