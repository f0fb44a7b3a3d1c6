"""What a check is: a function from a text column to a column of verdict structs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold_case, let, matches, rx, text_or_empty

SEVERITIES = ("low", "medium", "high", "critical")
RANK = {s: k for k, s in enumerate(SEVERITIES)}
RESULT = "struct<check_name:string,passed:boolean,severity:string,score:double,details:string,matched_patterns:array<string>,owasp_refs:array<string>,eu_ai_act_refs:array<string>,remediation:string>"


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def scale(rank: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), rank + 1)


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


class Check:
    """``check_input`` and ``check_output`` give verdict structs; ``fix``, where there is one, a repaired text."""

    name = ""
    owasp: tuple[str, ...] = ()
    eu: tuple[str, ...] = ()
    advice = ""
    has_fix = False

    def verdict(self, passed: Column | bool, score: Column | float = 0.0, severity: Column | str = "low", details: Column | None = None, patterns: Column | None = None, advice: Column | None = None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        ok = lit(passed)
        return F.struct(
            F.lit(self.name).alias("check_name"),
            ok.alias("passed"),
            lit(severity).alias("severity"),
            lit(score).cast("double").alias("score"),
            (details if details is not None else F.lit("{}")).alias("details"),
            (patterns if patterns is not None else F.array().cast("array<string>")).alias("matched_patterns"),
            strings(self.owasp).alias("owasp_refs"),
            strings(self.eu).alias("eu_ai_act_refs"),
            (advice if advice is not None else F.when(ok, "").otherwise(self.advice)).alias("remediation"),
        )

    def passing(self) -> Column:
        return self.verdict(True)

    def check_input(self, text: Column) -> Column:
        return self.evaluate(text_or_empty(text))

    def check_output(self, text: Column) -> Column:
        return self.evaluate(text_or_empty(text))

    def evaluate(self, text: Column) -> Column:
        raise NotImplementedError

    def fix(self, text: Column) -> Column:
        raise NotImplementedError(f"{self.name} repairs nothing")


def rule_hits(text: Column, rules: Sequence[tuple[str, str, str]], flags: str, read: Callable[[str, str], str] = rx) -> Column:
    """array<struct<label, rank>> of the rules (pattern, label, severity) that match, in rule order.

    A rule is searched for only where a string that it needs is there. ``read`` is rx or rx_ascii.
    """

    def found(low: Column) -> Column:
        tests = [F.when(matches(text, low, p, flags, read), F.struct(F.lit(label).alias("label"), F.lit(RANK[s]).alias("rank"))) for p, label, s in rules]
        return F.filter(F.array(*tests), lambda h: h.isNotNull())

    return let(fold_case(text), found)


def top_rank(hits: Column) -> Column:
    return F.array_max(F.transform(hits, lambda h: h["rank"]))


def labels(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["label"])


def json_of(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def renamed(hits: Column, name: str) -> Column:
    return F.transform(hits, lambda h: F.struct(h["label"].alias(name), severity_name(h["rank"]).alias("severity")))


__all__ = ["RANK", "RESULT", "SEVERITIES", "Check", "json_of", "labels", "let", "renamed", "rule_hits", "scale", "severity_name", "strings", "top_rank"]
