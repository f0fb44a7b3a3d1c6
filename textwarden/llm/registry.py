"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import decontaminate, language_model, near_dedup, packing, personal_data, quality_model, quality_rules, revisits, sharding, token_files
from .oracle import ORACLE_SQL

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_quality_model": quality_model.op2_quality_model,
    "op3_token_files": token_files.op3_token_files,
    "op4_revisits": revisits.op4_revisits,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_personal_data": personal_data.op6_personal_data,
    "op7_sharding": sharding.op7_sharding,
    "op8_pack": packing.op8_pack,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_language_model": language_model.op10_language_model,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
