"""The catalogue of checks as a table, its search, and code that uses what was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import CATALOGUE
from .guards import BY_ID, OnFail

SCHEMA = "id string, name string, infra string, risk_category array<string>, use_cases array<string>, content_types array<string>, owasp_refs array<string>, eu_ai_act_refs array<string>"


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, SCHEMA).withColumn("available", F.col("id").isin(list(BY_ID)))


def get(spark: SparkSession, check_id: str) -> DataFrame:
    return catalogue(spark).where(F.col("id") == check_id)


def _holds(values: str, part: str) -> Column:
    return F.exists(values, lambda x: F.contains(F.upper(x), F.lit(part.upper())))


def search(spark: SparkSession, risk_category: str | None = None, use_case: str | None = None, infra: str | None = None, content_type: str | None = None, available_only: bool = False, query: str | None = None) -> DataFrame:
    """Rows that meet every condition given; all but ``infra`` look for parts, none minds case."""
    out = catalogue(spark)
    for values, part in (("risk_category", risk_category), ("use_cases", use_case), ("content_types", content_type)):
        if part:
            out = out.where(_holds(values, part))
    if infra:
        out = out.where(F.upper("infra") == infra.upper())
    if available_only:
        out = out.where("available")
    if query:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", "name", "id")), F.lit(query.lower())))
    return out


def guard_code(ids: Sequence[str], on_fail: str = "block") -> str:
    """Python that builds a chain guard of the given ids; imports once each."""
    classes = [BY_ID[i] for i in ids if i in BY_ID]
    imports = sorted({f"from {c.__module__} import {c.__name__}" for c in classes})
    action = f"OnFail.{OnFail(on_fail).name}"
    uses = "".join(f".use({c.__name__}(), {action})" for c in classes)
    return "\n".join(["from textwarden.plans.guards import ChainGuard, OnFail", *imports, "", f"guard = ChainGuard(){uses}", ""])
