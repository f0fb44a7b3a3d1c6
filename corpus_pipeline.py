"""A training-data pipeline of five stages: rules, near-duplicates, benchmark passages, personal data, packing.

Cases: a null or empty text has no words, so the rules reject it; rows without a doc_id are judged by their texts, are never near-duplicates
of others and are packed like any; repeated rows pass together (near-duplicates stay or go by doc_id, of which the smallest of a group
stays, so ties do not arise); extra columns pass all stages but the last, whatever they are called; an empty table
gives no pieces; a text of any length is treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textwarden.llm.decontaminate import decontaminate_stage
from textwarden.llm.near_dedup import near_dedup_stage
from textwarden.llm.packing import pack_stage
from textwarden.llm.personal_data import redact_stage
from textwarden.llm.quality_rules import quality_rules_stage
from textwarden.llm.store import drop_stored, stored

STAGES = [
    ("quality_rules", quality_rules_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("personal_data", redact_stage),
    ("packing", pack_stage),
]
#: SQL can't express Viterbi decoding, tokenizing and packing; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table; each stage's result is written and read by the next.

    A stage's table is deleted once the next one is written; the last stage has written what its result reads.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stored(before)
        before = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)
    drop_stored(docs)
    return packed
