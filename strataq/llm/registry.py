"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from strataq.llm import bpe, embeddings, extraction, fingerprint, jaccard, licenses, packing, quality, substrings, toxicity


def queries() -> dict:
    return {
        "op1_jaccard": jaccard.op1_jaccard,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_fingerprint": fingerprint.op3_fingerprint,
        "op4_bpe": bpe.op4_bpe,
        "op5_licenses": licenses.op5_licenses,
        "op6_packing": packing.op6_packing,
        "op7_substrings": substrings.op7_substrings,
        "op8_html": extraction.op8_html,
        "op9_quality": quality.op9_quality,
        "op10_embeddings": embeddings.op10_embeddings,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard": jaccard.op1_sql(),
        "op5_licenses": licenses.op5_sql(),
        "op7_substrings": substrings.op7_sql(),
        "op10_embeddings": embeddings.op10_sql(),
    }
