"""All rule packs at once, as a table of what fires where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or_empty
from ..operators.base import severity_name
from ..operators.core import InsecureOutput, PersonalData, PromptInjection, Toxicity


def scan_text(df: DataFrame, text: str = "text", personal: PersonalData | None = None) -> DataFrame:
    """A row for each rule that fires: the columns of ``df`` but the text, and check_name, rule, severity. Rows without a hit give none; null is an empty text.

    ``personal``: the check for personal data, if not the default one.
    """
    t = text_or_empty(F.col(text))

    def rows(check: type, hits: Column, label: str) -> Column:
        return F.transform(hits, lambda h: F.struct(F.lit(check.name).alias("check_name"), h[label].alias("rule"), severity_name(h["rank"]).alias("severity")))

    packs = [rows(p, p().hits(t), "label") for p in (PromptInjection, Toxicity, InsecureOutput)] + [rows(PersonalData, (personal or PersonalData()).found(t), "type")]
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    # The outer form and a filter after it: the inner one searches each text twice.
    return df.select(*kept, F.explode_outer(F.concat(*packs)).alias("__hit")).where("__hit is not null").select(*kept, "__hit.check_name", "__hit.rule", "__hit.severity")
