"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import collision, ctw, decontam, langid, minhash, pieces, pii, templates, toxicity, urlfilter


def queries() -> dict:
    return {
        "op1_language_id": langid.query,
        "op2_url_filter": urlfilter.query,
        "op3_minhash_dedup": minhash.query,
        "op4_toxicity": toxicity.query,
        "op5_lm_score": ctw.query,
        "op6_sentencepiece": pieces.query,
        "op7_decontamination": decontam.query,
        "op8_pii": pii.query,
        "op9_collision_nn": collision.query,
        "op10_line_dedup": templates.query,
    }


def oracle_sql() -> dict:
    return {"op2_url_filter": urlfilter.ORACLE_SQL}
