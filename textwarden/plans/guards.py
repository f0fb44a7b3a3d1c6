"""Guards: several checks on one text, folded into a decision.

``ParallelGuard`` puts every check on the original text. ``ChainGuard`` hands each check the text that the one
before has left. Both are projections; no row leaves its partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, text_or_empty
from ..operators.base import RESULT, Check
from ..operators.content import BanList, BiasCheck, CompetitorCheck, ProfanityFree, ReadingLevel, RedundantSentences, SensitiveTopic
from ..operators.core import Hallucination, InsecureOutput, PersonalData, PromptInjection, Toxicity
from ..operators.formats import ContainsString, EndsWith, Lowercase, OneLine, ReadingTime, RegexMatch, TwoWords, Uppercase, ValidChoices, ValidHtml, ValidJson, ValidLength, ValidPython, ValidSql, ValidUrl
from ..operators.models import GraniteGuardian, InjectionModel, IntentModel, LocalIntent, SemanticSimilarity, ToxicModel

#: Checks of a parallel guard by alias, in the order in which they run on input and on output.
INPUT_ORDER = ("injection", "pii", "toxicity", "insecure_output", "llm_intent", "local_intent", "hap", "injection_ml", "granite_guardian", "semantic_similarity")
OUTPUT_ORDER = ("pii", "toxicity", "hallucination", "insecure_output", "llm_intent", "local_intent", "hap", "injection_ml", "granite_guardian")
ALIASES: dict[str, type[Check]] = {
    "injection": PromptInjection, "pii": PersonalData, "toxicity": Toxicity, "insecure_output": InsecureOutput, "hallucination": Hallucination,
    "llm_intent": IntentModel, "local_intent": LocalIntent, "hap": ToxicModel, "injection_ml": InjectionModel, "granite_guardian": GraniteGuardian, "semantic_similarity": SemanticSimilarity,
}
CORE_ALIASES = ("injection", "pii", "toxicity", "hallucination", "insecure_output")
#: What an id of the catalogue runs.
BY_ID: dict[str, type[Check]] = {
    "prompt_injection": PromptInjection, "pii_detector": PersonalData, "toxic_language": Toxicity, "hallucination_risk": Hallucination, "insecure_output": InsecureOutput,
    "prompt_injection_ml": InjectionModel, "granite_hap": ToxicModel, "granite_guardian": GraniteGuardian, "semantic_similarity": SemanticSimilarity, "llm_intent": IntentModel, "local_intent": LocalIntent,
    "valid_json": ValidJson, "valid_html": ValidHtml, "valid_sql": ValidSql, "valid_python": ValidPython, "valid_url": ValidUrl, "valid_length": ValidLength, "valid_choices": ValidChoices, "regex_match": RegexMatch,
    "contains_string": ContainsString, "ends_with": EndsWith, "one_line": OneLine, "reading_time": ReadingTime, "uppercase": Uppercase, "lowercase": Lowercase, "two_words": TwoWords,
    "competitor_check": CompetitorCheck, "ban_list": BanList, "redundant_sentences": RedundantSentences, "sensitive_topic": SensitiveTopic, "profanity_free": ProfanityFree, "bias_check": BiasCheck, "reading_level": ReadingLevel,
}


def highest_severity(results: Column) -> Column:
    """Of failed results, the greatest by name (critical < high < low < medium), low without any."""
    failed = F.transform(F.filter(results, lambda r: ~r["passed"]), lambda r: r["severity"])
    return F.coalesce(F.array_max(failed), F.lit("low"))


def remediations(results: Column) -> Column:
    return F.transform(F.filter(results, lambda r: ~r["passed"] & (r["remediation"] != "")), lambda r: r["remediation"])


class ParallelGuard:
    """``checks``: aliases or checks; None or nothing is all, unknown aliases are left out."""

    def __init__(self, checks: Sequence[str | Check] | None = None, block_on_fail: bool = True, score_threshold: float = 0.7) -> None:
        chosen = list(checks or ALIASES)
        self.own = [c for c in chosen if isinstance(c, Check)]
        self.aliases = {c for c in chosen if isinstance(c, str)}
        self.block_on_fail, self.score_threshold = block_on_fail, score_threshold

    @classmethod
    def for_provider(cls, provider: str, **kw) -> ParallelGuard:
        """A local model's provider ("ollama") narrows to the core checks."""
        return cls(**({"checks": CORE_ALIASES} if provider == "ollama" else {}) | kw)

    def checks(self, direction: str) -> list[Check]:
        order = INPUT_ORDER if direction == "input" else OUTPUT_ORDER
        return [ALIASES[a]() for a in order if a in self.aliases] + self.own

    def results(self, text: Column, direction: str = "input") -> Column:
        """array of verdicts in order; checks that were skipped (null) are left out."""
        each = [c.check_input(text) if direction == "input" else c.check_output(text) for c in self.checks(direction)]
        if not each:
            return F.array().cast(f"array<{RESULT}>")
        return F.filter(F.array(*[e.cast(RESULT) for e in each]), lambda r: r.isNotNull())

    def fold(self, results: Column) -> Column:
        """struct<allowed, risk_score, blocked_by, highest_severity, check_results>."""

        def decide(r: Column) -> Column:
            risk = F.coalesce(F.array_max(F.transform(r, lambda x: x["score"])), F.lit(0.0))
            failed = F.transform(F.filter(r, lambda x: ~x["passed"]), lambda x: x["check_name"])
            # The first of the highest scores, if a score alone is over the threshold.
            top = F.element_at(F.filter(r, lambda x: x["score"] == risk), 1)["check_name"]
            blocked = F.when((F.size(failed) == 0) & (F.size(r) > 0) & (risk >= self.score_threshold), F.array(top)).otherwise(failed)
            return let(
                blocked,
                lambda b: F.struct(((F.size(b) == 0) | F.lit(not self.block_on_fail)).alias("allowed"), risk.alias("risk_score"), b.alias("blocked_by"), highest_severity(r).alias("highest_severity"), r.alias("check_results")),
            )

        return let(results, decide)

    def check_input(self, df: DataFrame, text: str = "text", out: str = "guard") -> DataFrame:
        return df.withColumn(out, self.fold(self.results(F.col(text), "input")))

    def check_output(self, df: DataFrame, text: str = "text", out: str = "guard") -> DataFrame:
        return df.withColumn(out, self.fold(self.results(F.col(text), "output")))

    def protect(self, df: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
        """Prompt and response of each row: guard_in, guard_out and allowed (both). A blocked prompt's response is not looked at."""
        seen = F.when(F.col("guard_in.allowed"), self.fold(self.results(F.col(response), "output")))
        both = self.check_input(df, prompt, "guard_in").withColumn("guard_out", seen)
        return both.withColumn("allowed", F.col("guard_in.allowed") & F.coalesce(F.col("guard_out.allowed"), F.lit(False)))


    def both(self, df: DataFrame, prompt: str = "prompt", response: str = "response", out: str = "guard") -> DataFrame:
        """Two rows for each one: its prompt checked as input and its response as output, told apart by ``direction``."""
        sides = self.check_input(df, prompt, out).withColumn("direction", F.lit("input")), self.check_output(df, response, out).withColumn("direction", F.lit("output"))
        return sides[0].unionByName(sides[1])


class OnFail(str, Enum):
    EXCEPTION = "exception"
    BLOCK = "block"
    FIX = "fix"
    FILTER = "filter"
    NOOP = "noop"
    REASK = "reask"


HARD = (OnFail.EXCEPTION, OnFail.BLOCK, OnFail.REASK)
VIOLATION = "struct<validator_name:string,message:string,score:double,severity:string,on_fail:string,details:string>"


@dataclass(frozen=True)
class ChainGuard:
    steps: tuple[tuple[Check, OnFail], ...] = field(default_factory=tuple)

    def use(self, check: Check, on_fail: OnFail | str = OnFail.BLOCK) -> ChainGuard:
        return replace(self, steps=(*self.steps, (check, OnFail(on_fail))))

    @classmethod
    def from_ids(cls, ids: Sequence[str], on_fail: OnFail | str = OnFail.BLOCK) -> tuple[ChainGuard, list[str]]:
        """A guard of catalogue ids, and the ids that are unknown or need arguments."""
        guard, skipped = cls(), []
        for i in ids:
            try:
                guard = guard.use(BY_ID[i](), on_fail)
            except (KeyError, TypeError):
                skipped.append(i)
        return guard, skipped

    def validate(self, df: DataFrame, text: str = "text", direction: str = "input", out: str = "validation", strict: bool = False) -> DataFrame:
        """Adds struct<passed, original_value, fixed_value, violations, check_results, needs_reask, raised, risk_score>.

        A failed step with on_fail=exception ends the row's chain: raised is true and later steps don't run.
        ``strict`` turns it into an error of the query.
        """
        made, names = df.withColumn("__value", text_or_empty(F.col(text))), []
        made = made.withColumn("__raised", F.lit(False))
        for k, (check, action) in enumerate(self.steps):
            value = F.col("__value")
            result = check.check_input(value) if direction == "input" else check.check_output(value)
            made = made.withColumn(f"__r{k}", F.when(~F.col("__raised"), result.cast(RESULT)))
            names.append(f"__r{k}")
            failed = F.coalesce(~F.col(f"__r{k}.passed"), F.lit(False))
            if action in (OnFail.FIX, OnFail.FILTER) and check.has_fix:
                made = made.withColumn("__value", F.when(failed, F.coalesce(check.fix(value), value)).otherwise(value))
            elif action is OnFail.FILTER:
                made = made.withColumn("__value", F.when(failed, _without_patterns(value, F.col(f"__r{k}.matched_patterns"))).otherwise(value))
            elif action is OnFail.EXCEPTION:
                made = made.withColumn("__raised", F.col("__raised") | failed)
        each = F.array(*[F.struct(F.col(n).alias("r"), F.lit(a.value).alias("on_fail")) for n, (_, a) in zip(names, self.steps, strict=True)])
        kind = f"array<struct<r:{RESULT},on_fail:string>>"
        run = F.filter(each.cast(kind) if names else F.array().cast(kind), lambda x: x["r"].isNotNull())
        bad = F.filter(run, lambda x: ~x["r"]["passed"])
        message = lambda r: F.when(r["remediation"] != "", r["remediation"]).otherwise(F.concat(r["check_name"], F.lit(" failed")))
        violations = F.transform(bad, lambda x: F.struct(x["r"]["check_name"].alias("validator_name"), message(x["r"]).alias("message"), x["r"]["score"].alias("score"), x["r"]["severity"].alias("severity"), x["on_fail"].alias("on_fail"), x["r"]["details"].alias("details")))
        hard = F.exists(bad, lambda x: x["on_fail"].isin([a.value for a in HARD]))
        passed = ~hard
        if strict:
            passed = F.when(F.col("__raised"), F.raise_error(F.lit("a guarded text failed"))).otherwise(passed)
        result = F.struct(
            passed.alias("passed"),
            text_or_empty(F.col(text)).alias("original_value"),
            F.col("__value").alias("fixed_value"),
            violations.alias("violations"),
            F.transform(run, lambda x: x["r"]).alias("check_results"),
            F.exists(bad, lambda x: x["on_fail"] == OnFail.REASK.value).alias("needs_reask"),
            F.col("__raised").alias("raised"),
            F.coalesce(F.array_max(F.transform(run, lambda x: x["r"]["score"])), F.lit(0.0)).alias("risk_score"),
        )
        return made.withColumn(out, result).drop("__value", "__raised", *names)


def _without_patterns(text: Column, patterns: Column) -> Column:
    """Each matched label, taken as a pattern, replaced by [FILTERED]; case counts."""
    return F.aggregate(F.coalesce(patterns, F.array().cast("array<string>")), text, lambda t, p: F.call_function("regexp_replace", t, p, F.lit("[FILTERED]")))
