"""Checks backed by a model: everything but the model itself.

A scorer is a function from columns to a column (a pandas UDF that loads its model once a worker, or an
expression). Without one, or where it gives null, a check lets the text pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, let, rounded, text_or_empty
from .base import Check, json_of

Scorer = Callable[[Column], Column]


class _Scored(Check):
    threshold = 0.5
    limit: int | None = None

    def __init__(self, scorer: Scorer | None = None, threshold: float | None = None) -> None:
        self.scorer = scorer
        self.threshold = threshold if threshold is not None else type(self).threshold

    def severity(self, score: Column) -> Column:
        return F.when(score >= 0.8, "critical").when(score >= 0.6, "high").otherwise("medium")

    def evaluate(self, text: Column) -> Column:
        if self.scorer is None:
            return self.passing()
        seen = F.left(text, F.lit(self.limit)) if self.limit else text

        def fold(p: Column) -> Column:
            score = rounded(p, 4)
            return F.when(p.isNull(), self.passing()).when(p >= self.threshold, self.verdict(False, score, self.severity(p), json_of(score=score))).otherwise(self.verdict(True, score))

        return F.when(is_blank(text), self.passing()).otherwise(let(self.scorer(seen), fold))


class ToxicModel(_Scored):
    name, owasp, advice, limit = "hap", ("LLM02",), "Block or review this text.", 2048


class InjectionModel(_Scored):
    name, owasp, advice, threshold = "injection_ml", ("LLM01",), "Reject this text.", 0.7

    def severity(self, score: Column) -> Column:
        return F.when(score >= 0.8, "critical").otherwise("high")


#: Risks that need retrieved context or a query.
RAG_RISKS = ("groundedness", "answer_relevance", "context_relevance")
TURNS = "array<struct<role:string,content:string>>"


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _given(text: Column | None) -> Column:
    """An optional column: blank is as good as none."""
    return F.nullif(text, F.lit("")) if text is not None else F.lit(None).cast("string")


class GraniteGuardian(_Scored):
    """The scorer gives map<risk, probability>; the largest counts.

    ``scorer`` sees the text alone. ``judge`` sees the conversation and the risks to look for: on input the user's turn and all risks but
    those of retrieval; on output the user's turn (``prompt``, else ``rag_query``) and the reply, behind the retrieved ``rag_context``
    if groundedness is asked for and there is one. A risk whose column is null in a row is not asked of that row.
    """

    name, owasp, advice = "granite_guardian", ("LLM01", "LLM02", "LLM06", "LLM08"), "Block or review this text."

    def __init__(self, scorer: Scorer | None = None, threshold: float = 0.5, judge: Callable[[Column, Column], Column] | None = None, risks: Sequence[str] = ("harm",), prompt: Column | None = None, rag_context: Column | None = None, rag_query: Column | None = None) -> None:
        super().__init__((lambda t: F.array_max(F.map_values(scorer(t)))) if scorer else None, threshold)
        self.judge, self.risks, self.prompt, self.context, self.query = judge, tuple(risks), prompt, rag_context, rag_query

    def conversation(self, text: Column, output: bool) -> tuple[Column, Column]:
        """The turns and the risks that the judge sees."""
        if not output:
            asked = [r for r in self.risks if r not in RAG_RISKS] or ["harm"]
            return F.array(_turn("user", text)), F.array(*map(F.lit, asked))
        context, query = _given(self.context), _given(self.query)
        said = F.array(_turn("user", F.coalesce(_given(self.prompt), query, F.lit("User request"))), _turn("assistant", text))
        if "groundedness" in self.risks:
            said = F.when(context.isNotNull(), F.concat(F.array(_turn("context", context)), said)).otherwise(said)
        needs = {"groundedness": context, "answer_relevance": query}
        asked = F.filter(F.array(*[F.when(needs[r].isNotNull(), r) if r in needs else F.lit(r) for r in self.risks]).cast("array<string>"), lambda r: r.isNotNull())
        return said.cast(TURNS), F.when(F.size(asked) > 0, asked).otherwise(F.array(F.lit("harm")))

    def _judged(self, text: Column, output: bool) -> Column:
        text = text_or_empty(text)
        if self.judge is None:
            return self.evaluate(text)
        other = GraniteGuardian(threshold=self.threshold)
        other.scorer = lambda t: F.array_max(F.map_values(self.judge(*self.conversation(t, output))))
        return other.evaluate(text)

    def check_input(self, text: Column) -> Column:
        return self._judged(text, False)

    def check_output(self, text: Column) -> Column:
        return self._judged(text, True)


def intent_window(history: Column, text: Column, limit: int = 1200) -> Column:
    """The last ``limit`` characters of "[role] content" lines and the text as the user's last line. history: array<struct<role, content>>."""
    past = F.transform(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), lambda t: F.concat(F.lit("["), t["role"], F.lit("] "), t["content"]))
    return F.right(F.array_join(F.concat(past, F.array(F.concat(F.lit("[user] "), text))), "\n"), F.lit(limit))


class LocalIntent(Check):
    """The scorer gives map<label, score>. ``labels``: label to (category, severity). The best score is reported even where the text passes."""

    name, owasp, advice = "local_intent", ("LLM01", "LLM02", "LLM06"), "Review what this conversation is after."

    def __init__(self, scorer: Scorer | None = None, labels: dict[str, tuple[str, str]] | None = None, threshold: float = 0.6, top: int = 3) -> None:
        self.scorer, self.labels, self.threshold, self.top = scorer, labels or {}, threshold, top

    def evaluate(self, text: Column) -> Column:
        if self.scorer is None:
            return self.passing()

        def fold(scores: Column) -> Column:
            ranked = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("label"))))
            best = F.array_max(F.map_values(scores))
            over = F.filter(ranked, lambda e: -e["minus"] >= self.threshold)
            severity = F.coalesce(*[F.when(F.exists(over, lambda e: e["label"].isin([k for k, (_, x) in self.labels.items() if x == s] or [""])), s) for s in ("critical", "high", "medium")], F.lit("medium"))
            details = json_of(top=F.slice(F.transform(ranked, lambda e: F.struct(e["label"].alias("label"), rounded(-e["minus"], 3).alias("score"))), 1, self.top))
            failed = self.verdict(False, rounded(best, 3), severity, details, F.transform(over, lambda e: e["label"]))
            return F.when(scores.isNull(), self.passing()).when(F.size(over) > 0, failed).otherwise(self.verdict(True, rounded(best, 3), details=details))

        return F.when(is_blank(text), self.passing()).otherwise(let(self.scorer(text), fold))


INTENT_REPLY = "struct<violations:array<string>,risk_score:double,reasoning:string>"


class IntentModel(Check):
    """The scorer gives a chat model's JSON reply; what can't be read passes. A text without violations passes with the reply's score.

    ``chat`` sees the last ``turns`` turns of the column ``history`` (array<struct<role, content>>) and the text as the user's turn; ``scorer`` the text alone.
    """

    name, owasp, advice = "llm_intent", ("LLM01", "LLM02", "LLM06"), "Review what this conversation is after."

    def __init__(self, scorer: Scorer | None = None, severities: dict[str, str] | None = None, chat: Scorer | None = None, history: Column | None = None, turns: int = 10) -> None:
        self.scorer, self.severities = scorer, severities or {}
        if chat is not None:
            self.scorer = lambda text: chat(self.messages(text, history, turns))

    @staticmethod
    def messages(text: Column, history: Column | None = None, turns: int = 10) -> Column:
        now = F.array(_turn("user", text)).cast(TURNS)
        if history is None:
            return now
        past = F.coalesce(history.cast(TURNS), F.array().cast(TURNS))
        return F.concat(F.slice(past, F.greatest(F.lit(1), F.size(past) - turns + 1), turns), now)

    def evaluate(self, text: Column) -> Column:
        if self.scorer is None:
            return self.passing()

        def fold(r: Column) -> Column:
            found = F.coalesce(r["violations"], F.array().cast("array<string>"))
            risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r["risk_score"], F.lit(0.0))))
            score = F.greatest(F.lit(0.5), risk)
            known = [F.when(F.exists(found, lambda v: v.isin([k for k, x in self.severities.items() if x == s] or [""])), s) for s in ("critical", "high", "medium", "low")]
            failed = self.verdict(False, score, F.coalesce(*known, F.lit("high")), json_of(violations=found, reasoning=r["reasoning"]), found)
            calm = self.verdict(True, risk, details=json_of(reasoning=F.coalesce(r["reasoning"], F.lit(""))))
            return F.when(r.isNull(), self.passing()).when(F.size(found) == 0, calm).otherwise(failed)

        return F.when(is_blank(text), self.passing()).otherwise(let(F.from_json(self.scorer(text), INTENT_REPLY), fold))


class SemanticSimilarity(Check):
    """The scorer gives the cosine to the nearest stored vector (see ``nearest``). Output is never looked at; a passing text keeps its similarity as score."""

    name, advice = "semantic_similarity", "This text is close to a known attack."

    def __init__(self, scorer: Scorer | None = None, threshold: float = 0.72) -> None:
        self.scorer, self.threshold = scorer, threshold

    def evaluate(self, text: Column) -> Column:
        if self.scorer is None:
            return self.passing()

        def fold(s: Column) -> Column:
            score = rounded(F.greatest(F.lit(0.0), s), 4)
            severity = F.when(s >= 0.85, "critical").otherwise("high")
            return F.when(s.isNull(), self.passing()).when(s >= self.threshold, self.verdict(False, score, severity, json_of(similarity=score))).otherwise(self.verdict(True, score))

        return F.when(is_blank(text), self.passing()).otherwise(let(self.scorer(text), fold))

    def check_output(self, text: Column) -> Column:
        return self.passing()


#: Vectors of a library that is sent to all tasks at most, and of a block of a larger one.
LIBRARY_ROWS, BLOCK_ROWS = 10_000, 1_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, library: DataFrame, id_col: str, vector: str, library_id: str) -> DataFrame:
    """Each row's most similar library vector by cosine: id, nearest_id, similarity. Ties go to the smaller library id.

    A small library (36 prompts in the stock setting) becomes a single broadcast row, so each row is scored in place,
    without a shuffle. A larger one is dealt into blocks of about BLOCK_ROWS, each row meets each block, and the best of
    its blocks are reduced to one; equal rows are searched once.
    """
    lib = library.select(F.col(library_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    rows = lib.limit(LIBRARY_ROWS + 1).collect()
    v = F.col("v")
    length = F.sqrt(dot(v, v))
    scores = F.transform(F.col("lib"), lambda l: F.struct(F.when(length > 0, dot(v, l["v"]) / length).otherwise(0.0).alias("s"), (-l["i"]).alias("i")))
    best = F.array_max(scores)
    asked = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    if len(rows) > LIBRARY_ROWS:
        unit = F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(0.0))
        block = F.pmod(F.xxhash64("i", "v"), F.lit(-(-lib.count() // BLOCK_ROWS)))
        blocks = lib.distinct().groupBy(block.alias("block")).agg(F.collect_list(F.struct("i", unit.alias("v"))).alias("lib")).select("lib")
        once = asked.groupBy("id", "v").agg(F.count("*").alias("n"))
        found = once.crossJoin(blocks.hint("shuffle_replicate_nl")).select("id", "v", "n", best.alias("b")).groupBy("id", "v").agg(F.first("n").alias("n"), F.max("b").alias("b"))
        answers = found.select("id", "b", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("id", "b")
    else:
        unit = []
        for r in sorted(rows, key=lambda r: r.i):
            norm = sum(x * x for x in r.v) ** 0.5
            unit.append((r.i, [x / norm if norm else 0.0 for x in r.v]))
        answers = asked.crossJoin(F.broadcast(df_literal(vectors, unit))).select("id", best.alias("b"))
    return answers.select(F.col("id").alias(id_col), (-F.col("b.i")).alias("nearest_id"), F.col("b.s").alias("similarity"))


def df_literal(like: DataFrame, unit: Sequence[tuple[int, Sequence[float]]]) -> DataFrame:
    """One row holding the whole library."""
    return like.sparkSession.createDataFrame([([(i, list(map(float, v))) for i, v in unit],)], "lib array<struct<i:long,v:array<double>>>")


def text_scorer(fn: Scorer) -> Scorer:
    return lambda text: fn(text_or_empty(text))
