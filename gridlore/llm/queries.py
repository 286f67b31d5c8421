"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontamination, embeddings, language_model, mixing, near_duplicates, pii, quality, repeats, sharding, token_files

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_token_files": token_files.query,
    "op3_quality": quality.query,
    "op4_sharding": sharding.query,
    "op5_decontamination": decontamination.query,
    "op6_repeats": repeats.query,
    "op7_pii": pii.query,
    "op8_embeddings": embeddings.query,
    "op9_language_model": language_model.query,
    "op10_near_duplicates": near_duplicates.query,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op5_decontamination": decontamination.ORACLE,
}
