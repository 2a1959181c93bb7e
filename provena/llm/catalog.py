"""Queries and oracles of this folder by name."""

from __future__ import annotations

from provena.llm import bpe, decontaminate, html, jaccard, licenses, middle, pii, pitmanyor, quality, repeats, resample, sharding, tokencount


def queries() -> dict:
    return {
        "op1_pii": pii.op1_pii,
        "op2_shards": sharding.op2_shards,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_repeats": repeats.op4_repeats,
        "op5_scores": pitmanyor.op5_scores,
        "op6_bpe": bpe.op6_bpe,
        "op7_near": jaccard.op7_near,
        "op8_tokens": tokencount.op8_tokens,
        "op9_html": html.op9_html,
        "op10_quality": quality.op10_quality,
        "op11_resample": resample.op11_resample,
        "op12_licenses": licenses.op12_licenses,
        "op13_middle": middle.op13_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": decontaminate.ORACLE,
        "op10_quality": quality.ORACLE,
        "op11_resample": resample.ORACLE,
        "op12_licenses": licenses.ORACLE,
        "op13_middle": middle.ORACLE,
    }
