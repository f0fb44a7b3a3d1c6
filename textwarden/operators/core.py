"""The five core checks: injection, personal data, toxicity, invention risk, unsafe output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import rules as R
from ..functions.text import any_of, count_matches, fold_case, let, matches, rounded, rx, rx_ascii, sentences, strip, text_or_empty, words
from .base import RANK, Check, json_of, labels, renamed, rule_hits, scale, severity_name, top_rank

STRICT = (0.2, 0.5, 0.75, 1.0)
LENIENT = (0.1, 0.4, 0.7, 1.0)


def _capped(score: Column) -> Column:
    return rounded(F.least(F.lit(1.0), score), 3)


class PromptInjection(Check):
    """``ascii_words``: patterns read as RE2 does (see ``rx_ascii``), not as Python's re."""

    name = "prompt_injection"
    owasp = ("LLM01",)
    eu = ("Article 9", "Article 15")
    advice = "Reject or clean this text and keep the system prompt out of its reach."

    def __init__(self, threshold: float = 0.5, ascii_words: bool = False) -> None:
        self.threshold, self.read = threshold, rx_ascii if ascii_words else rx

    def hits(self, text: Column) -> Column:
        return rule_hits(text, R.INJECTION_INPUT, "is", self.read)

    def check_input(self, text: Column) -> Column:
        def fold(h: Column) -> Column:
            n = F.size(h)
            score = _capped(scale(top_rank(h), STRICT) + (n - 1) * 0.05)
            return F.when(n == 0, self.passing()).otherwise(self.verdict(score < self.threshold, score, severity_name(top_rank(h)), json_of(matches=renamed(h, "pattern")), labels(h)))

        return let(self.hits(text_or_empty(text)), fold)

    def check_output(self, text: Column) -> Column:
        text = text_or_empty(text)
        severity: Column = F.lit(None).cast("string")
        for p, s in reversed(R.INJECTION_OUTPUT):
            severity = F.when(text.rlike(self.read(p)), s).otherwise(severity)
        failed = lambda s: self.verdict(False, 0.9, s, F.lit('{"type":"successful_injection_in_output"}'))
        return let(severity, lambda s: F.when(s.isNull(), self.passing()).otherwise(failed(s)))


class PersonalData(Check):
    """``ascii_words``: patterns read as RE2 does (see ``rx_ascii``), not as Python's re; ``fix`` always goes by the latter."""

    name = "pii_detection"
    owasp = ("LLM06",)
    eu = ("Article 10", "Article 13")
    advice = "Remove or mask personal data before the text goes on."
    has_fix = True

    def __init__(self, threshold: float = 0.3, ascii_words: bool = False) -> None:
        self.threshold, self.read = threshold, rx_ascii if ascii_words else rx

    def found(self, text: Column) -> Column:
        """array<struct<type, severity, count, eu_risk_level, sample, rank>> of the rules that match."""

        def one(low: Column, p: str, label: str, s: str, risk: str) -> Column:
            pattern = self.read(p, "im")
            group = 1 if "(authorization|auth)" in p else 0  # a sample is the rule's group where it has one
            sample = F.concat(F.substring(F.regexp_extract(text, pattern, group), 1, 6), F.lit("***"))
            row = F.struct(F.lit(label).alias("type"), F.lit(s).alias("severity"), count_matches(text, pattern).alias("count"), F.lit(risk).alias("eu_risk_level"), sample.alias("sample"), F.lit(RANK[s]).alias("rank"))
            return F.when(matches(text, low, p, "im", self.read), row)

        return let(fold_case(text), lambda low: F.filter(F.array(*[one(low, *x) for x in R.PII]), lambda h: h.isNotNull()))

    def _check(self, text: Column, output: bool) -> Column:
        def fold(h: Column) -> Column:
            rank = F.array_max(F.transform(h, lambda x: x["rank"]))
            score = _capped(scale(rank, LENIENT) + (F.size(h) - 1) * 0.03)
            total = F.aggregate(h, F.lit(0), lambda a, x: a + x["count"])
            types = F.transform(h, lambda x: F.struct(*[x[c].alias(c) for c in ("type", "severity", "count", "eu_risk_level", "sample")]))
            details = json_of(pii_types_found=types, output_contains_pii=F.lit(True)) if output else json_of(pii_types_found=types, total_matches=total)
            failed = self.verdict(score < self.threshold, score, severity_name(rank), details, F.transform(h, lambda x: x["type"]))
            return F.when(F.size(h) == 0, self.passing()).otherwise(failed)

        return let(self.found(text_or_empty(text)), fold)

    def check_input(self, text: Column) -> Column:
        return self._check(text, False)

    def check_output(self, text: Column) -> Column:
        return self._check(text, True)

    def fix(self, text: Column) -> Column:
        return redact_rules(text)


def redact_values(text: Column, matches: Column) -> Column:
    """Each value of array<struct<value, label>>, in order, replaced by its mark wherever it stands; null and empty values are skipped."""
    known = F.filter(F.coalesce(matches, F.array().cast("array<struct<value:string,label:string>>")), lambda m: m["value"] != "")
    return F.aggregate(known, text_or_empty(text), lambda t, m: F.replace(t, m["value"], F.concat(F.lit("[REDACTED:"), F.upper(m["label"]), F.lit("]"))))


@F.pandas_udf(StringType())
def redact_rules(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Spans of all rules at once: overlapping ones give way to the first and longest, which no chain of replacements can do."""
    import re

    compiled = [(re.compile(p, re.IGNORECASE | re.MULTILINE), f"[REDACTED:{label.upper()}]") for p, label, _, _ in R.PII]

    def one(text: str | None) -> str:
        text = text or ""
        spans = sorted(((m.start(), -m.end(), k) for k, (rule, _) in enumerate(compiled) for m in rule.finditer(text)))
        out, at, end = [], 0, -1
        for start, minus, k in spans:
            if start >= end:
                out += [text[at:start], compiled[k][1]]
                at = end = -minus
        return "".join([*out, text[at:]])

    for texts in batches:
        yield texts.map(one)


class Toxicity(Check):
    """``scorer``, if given, maps a text column to P(toxic): used where no rule fires, over .92 it fails.

    ``ascii_words``: patterns read as RE2 does (see ``rx_ascii``), not as Python's re; ``fix`` always goes by the latter.
    """

    name = "toxicity"
    owasp = ("LLM02",)
    eu = ("Article 9", "Article 13")
    advice = "Block the text or put it before a person."
    has_fix = True

    def __init__(self, threshold: float = 0.5, scorer=None, ascii_words: bool = False) -> None:
        self.threshold, self.scorer, self.read = threshold, scorer, rx_ascii if ascii_words else rx

    RULES = [(p, category, severity) for category, (severity, patterns) in R.TOXIC.items() for p in patterns]

    def hits(self, text: Column) -> Column:
        return rule_hits(text, self.RULES, "is", self.read)

    def _check(self, text: Column, output: bool) -> Column:
        text = text_or_empty(text)

        def fold(h: Column) -> Column:
            score = scale(top_rank(h), STRICT)
            extra = {"source": F.lit("llm_output")} if output else {}
            failed = self.verdict(score < self.threshold, score, severity_name(top_rank(h)), json_of(categories=renamed(h, "category"), **extra), labels(h))
            return F.when(F.size(h) == 0, self._scored(text) if self.scorer else self.passing()).otherwise(failed)

        return let(self.hits(text), fold)

    def _scored(self, text: Column) -> Column:
        def fold(p: Column) -> Column:
            score = rounded(F.least(F.lit(1.0), p), 3)
            return F.when(p > 0.92, self.verdict(score < self.threshold, score, "high", json_of(ml_score=score), F.array(F.lit("ml_detected_toxicity")))).otherwise(self.passing())

        return let(F.coalesce(self.scorer(text), F.lit(0.0)), fold)

    def check_input(self, text: Column) -> Column:
        return self._check(text, False)

    def check_output(self, text: Column) -> Column:
        return self._check(text, True)

    def fix(self, text: Column) -> Column:
        """Sentences under the threshold, joined by spaces."""
        bad = [r for r in self.RULES if STRICT[RANK[r[2]]] >= self.threshold]
        patterns = [p for p, _, _ in bad]
        text = text_or_empty(text)
        kept = F.filter(sentences(text), lambda s: ~any_of(s, patterns, "is"))
        return strip(F.array_join(F.when(any_of(text, patterns, "is"), kept).otherwise(sentences(text)), " "))


class Hallucination(Check):
    name = "hallucination_risk"
    owasp = ("LLM09",)
    eu = ("Article 9", "Article 13", "Article 14")
    advice = "Ground the answer in sources, ask for citations or have a person review it."

    def __init__(self, threshold: float = 0.6) -> None:
        self.threshold = threshold

    def check_input(self, text: Column) -> Column:
        text = text_or_empty(text)
        n = let(fold_case(text), lambda low: sum((matches(text, low, p).cast("int") for p in R.BAIT), F.lit(0)))
        flagged = lambda k: self.verdict(True, 0.3, "low", json_of(hallucination_prone_request=F.lit(True), patterns=k), advice=F.lit("Add retrieved context to this request."))
        return let(n, lambda k: F.when(k > 0, flagged(k)).otherwise(self.passing()))

    def signals(self, text: Column) -> Column:
        """struct<u, f, o, w, numbers>: hedges, fabrication and over-confidence signals, weight sum, specific numbers."""
        def found(low: Column) -> Column:
            weight: Column = F.lit(0.0)
            for p, w in [*R.FABRICATION, *R.OVERCONFIDENCE]:
                weight = weight + F.when(matches(text, low, p), w).otherwise(0.0)
            count = lambda patterns: sum((matches(text, low, p).cast("int") for p in patterns), F.lit(0))
            return F.struct(
                count(R.HEDGES).alias("u"),
                count([p for p, _ in R.FABRICATION]).alias("f"),
                count([p for p, _ in R.OVERCONFIDENCE]).alias("o"),
                weight.alias("w"),
                count_matches(text, r"(?Ud)\b\d{4,}\b|\b\d+\.\d+%\b").alias("numbers"),
                F.size(words(text)).alias("words"),
            )

        return let(fold_case(text), found)

    def check_output(self, text: Column) -> Column:
        text = text_or_empty(text)

        def fold(s: Column) -> Column:
            unhedged = (s["numbers"] > 3) & (s["u"] == 0)
            damped = F.when(s["u"] > 0, s["w"] * F.greatest(F.lit(0.2), F.lit(1.0) - s["u"] * 0.15)).otherwise(s["w"])
            return let(_capped(damped + F.when(unhedged, 0.2).otherwise(0.0)), lambda risk: verdict(s, unhedged, risk))

        def verdict(s: Column, unhedged: Column, risk: Column) -> Column:
            severity = F.when(risk >= 0.8, "critical").when(risk >= 0.6, "high").when(risk >= 0.3, "medium").otherwise("low")
            details = json_of(uncertainty_markers_found=s["u"], fabrication_signals=s["f"], overconfidence_signals=s["o"], unhedged_specific_claims=F.when(unhedged, s["numbers"]), final_risk_score=risk, word_count=s["words"])
            return self.verdict(risk < self.threshold, risk, severity, details)

        return F.when(F.length(strip(text)) < 20, self.passing()).otherwise(let(self.signals(text), fold))


class InsecureOutput(Check):
    """``ascii_words``: patterns read as RE2 does (see ``rx_ascii``), not as Python's re; ``fix`` always goes by the latter."""

    name = "insecure_output"
    owasp = ("LLM02",)
    eu = ("Article 9", "Article 15")
    advice = "Never run or render this text as it is."
    has_fix = True

    def __init__(self, threshold: float = 0.4, ascii_words: bool = False) -> None:
        self.threshold, self.read = threshold, rx_ascii if ascii_words else rx

    def hits(self, text: Column) -> Column:
        return rule_hits(text, R.UNSAFE_OUTPUT, "is", self.read)

    def _check(self, text: Column, output: bool) -> Column:
        def fold(h: Column) -> Column:
            top = scale(top_rank(h), LENIENT)
            score = _capped(top + (F.size(h) - 1) * 0.05) if output else top
            details = json_of(risks_detected=renamed(h, "type")) if output else json_of(matches=renamed(h, "pattern"))
            return F.when(F.size(h) == 0, self.passing()).otherwise(self.verdict(score < self.threshold, score, severity_name(top_rank(h)), details, labels(h)))

        return let(self.hits(text_or_empty(text)), fold)

    def check_input(self, text: Column) -> Column:
        return self._check(text, False)

    def check_output(self, text: Column) -> Column:
        return self._check(text, True)

    # Fixed values: (pattern, flags, replacement), applied in order.
    REPAIRS = [
        (r"<script[^>]*>.*?</script>", "is", "[REMOVED:SCRIPT]"),
        (r"\s+on\w+\s*=\s*[\"'][^\"']*[\"']", "i", ""),
        (r"javascript\s*:", "i", "javascript_blocked:"),
        (r"(?:http|ftp|file|dict|ldap)://(?:169\.254\.169\.254|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+)[^\s]*", "i", "[BLOCKED:INTERNAL_URL]"),
        (r"`[^`]+`", "", "[REMOVED:CMD]"),
        (r"\$\([^)]+\)", "", "[REMOVED:CMD]"),
        (r"(?:\.\./){2,}|(?:\.\.\\){2,}", "", ""),
    ]

    def fix(self, text: Column) -> Column:
        out = text_or_empty(text)
        for pattern, flags, new in self.REPAIRS:
            out = F.regexp_replace(out, rx(pattern, flags), new)
        return out


CORE = (PromptInjection, PersonalData, Toxicity, Hallucination, InsecureOutput)
__all__ = ["CORE", "Hallucination", "InsecureOutput", "PersonalData", "PromptInjection", "Toxicity"]
