"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from ctxloom.llm import ann, decontam, divergence, html_extract, kneser_ney, line_dedup, merkle, near_dedup, packing, pii, quality, suffix_dedup, url_filter


def queries():
    return {
        "op1_decontamination": decontam.query,
        "op2_ann": ann.query,
        "op3_suffix_dedup": suffix_dedup.query,
        "op4_url_filter": url_filter.query,
        "op5_line_dedup": line_dedup.query,
        "op6_pii": pii.query,
        "op7_near_dedup": near_dedup.query,
        "op8_packing": packing.query,
        "op9_html": html_extract.query,
        "op10_quality": quality.query,
        "op11_divergence": divergence.query,
        "op12_lm_scores": kneser_ney.query,
        "op13_merkle": merkle.query,
    }


def oracle_sql():
    return {
        "op1_decontamination": decontam.ORACLE,
        "op5_line_dedup": line_dedup.ORACLE,
        "op11_divergence": divergence.ORACLE,
        "op13_merkle": merkle.ORACLE,
    }
