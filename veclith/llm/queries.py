"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, language_id, near_dedup, pieces, pii, substring_dedup, token_records, toxicity, warc


def queries() -> dict:
    return {
        "op1_token_records": token_records.query,
        "op2_pieces": pieces.query,
        "op3_substring_dedup": substring_dedup.query,
        "op4_decontaminate": decontaminate.query,
        "op5_exact_dedup": exact_dedup.query,
        "op6_language_id": language_id.query,
        "op7_toxicity": toxicity.query,
        "op8_near_dedup": near_dedup.query,
        "op9_warc": warc.query,
        "op10_pii": pii.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": decontaminate.SQL,
        "op5_exact_dedup": exact_dedup.SQL,
        "op8_near_dedup": near_dedup.SQL,
        "op9_warc": warc.SQL,
    }
