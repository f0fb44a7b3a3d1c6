"""Content validators: names, banned words, redundancy, topics, profanity, bias, reading level."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import any_of, count_matches, fold_case, let, matches, quote, rounded, rx, sentences, strip, text_or_empty
from .base import Check, json_of


def _word(name: str) -> str:
    return r"\b" + quote(name) + r"\b"


def _matching(text: Column, named: Sequence[tuple[str, str]], flags: str = "i") -> Column:
    """Names whose pattern matches, in order; nothing is searched singly where none can match."""
    if not named:
        return F.array().cast("array<string>")
    tests = lambda low: F.array(*[F.when(matches(text, low, p, flags), F.lit(n)) for n, p in named])
    return let(fold_case(text), lambda low: F.filter(tests(low), lambda x: x.isNotNull()))


class CompetitorCheck(Check):
    name, owasp, advice, has_fix = "competitor_check", ("LLM09",), "Take other brands out of the text.", True

    def __init__(self, competitors: Sequence[str] | None = None) -> None:
        self.competitors = list(competitors or R.COMPETITORS)

    def evaluate(self, text: Column) -> Column:
        def fold(found: Column) -> Column:
            score = F.least(F.lit(1.0), F.size(found) * 0.3)
            return F.when(F.size(found) == 0, self.passing()).otherwise(self.verdict(False, score, "medium", json_of(competitors_mentioned=found), found))

        return let(_matching(text, [(c, _word(c)) for c in self.competitors]), fold)

    def fix(self, text: Column) -> Column:
        """Without the sentences that name one; the text itself if nothing would be left."""
        text = text_or_empty(text)
        kept = F.filter(sentences(text), lambda s: ~any_of(s, [_word(c) for c in self.competitors]))
        return F.coalesce(F.nullif(strip(F.array_join(kept, " ")), F.lit("")), text)


class BanList(Check):
    name, owasp, advice, has_fix = "ban_list", ("LLM08",), "Take the banned words out.", True

    def __init__(self, banned_words: Sequence[str] = (), case_sensitive: bool = False) -> None:
        self.banned, self.flags = list(banned_words), "" if case_sensitive else "i"

    def evaluate(self, text: Column) -> Column:
        failed = lambda found: self.verdict(False, 1.0, "high", json_of(banned_words_found=found), found)
        return let(_matching(text, [(w, _word(w)) for w in self.banned], self.flags), lambda f: F.when(F.size(f) == 0, self.passing()).otherwise(failed(f)))

    def fix(self, text: Column) -> Column:
        out = text_or_empty(text)
        for w in self.banned:
            out = F.regexp_replace(out, rx(_word(w), self.flags), "[FILTERED]")
        return out


def _sentence_sets(text: str) -> tuple[list[str], list[set[str]]]:
    import re

    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    return parts, [set(re.findall(r"\w+", s.lower())) for s in parts]


def similar_pairs(sets: list[set[str]], least: float) -> Iterator[tuple[int, int, float]]:
    """(earlier, later, Jaccard) of all pairs with Jaccard >= least > 0.

    Two such sets share one of their first rare tokens, so only these are looked up, not all pairs.
    """
    import math
    from collections import Counter, defaultdict

    often = Counter(t for s in sets for t in s)
    index: dict[str, list[int]] = defaultdict(list)
    for j, s in enumerate(sets):
        # The product rounds up at most; one token more keeps the bound safe.
        prefix = sorted(s, key=lambda t: (often[t], t))[: len(s) - max(1, math.ceil(least * len(s) - 1e-9)) + 1]
        for i in sorted({i for t in prefix for i in index[t]}):
            both = len(s & sets[i])
            if both and (sim := both / (len(s) + len(sets[i]) - both)) >= least:
                yield i, j, sim
        for t in prefix:
            index[t].append(j)


PAIRS = "array<struct<i:int,j:int,similarity:double>>"


class RedundantSentences(Check):
    name, advice, has_fix = "redundant_sentences", "Shorten the text.", True

    def __init__(self, similarity: float = 0.85) -> None:
        self.similarity = similarity

    def pairs(self, text: Column) -> Column:
        least = self.similarity

        @F.pandas_udf(PAIRS)
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield texts.map(lambda t: [{"i": i, "j": j, "similarity": round(s, 3)} for i, j, s in sorted(similar_pairs(_sentence_sets(t or "")[1], least))])

        return found(text)

    def evaluate(self, text: Column) -> Column:
        def fold(p: Column) -> Column:
            return F.when(F.size(p) == 0, self.passing()).otherwise(self.verdict(False, F.least(F.lit(1.0), F.size(p) * 0.25), "low", json_of(redundant_pairs=p)))

        return let(self.pairs(text), fold)

    def fix(self, text: Column) -> Column:
        """Each sentence that is not too similar to one kept before."""
        least = self.similarity

        @F.pandas_udf("string")
        def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            def one(t: str | None) -> str:
                parts, sets = _sentence_sets(t or "")
                like: dict[int, list[int]] = {}
                for i, j, _ in similar_pairs(sets, least):
                    like.setdefault(j, []).append(i)
                keep: list[int] = []
                held: set[int] = set()
                for j in range(len(parts)):
                    if held.isdisjoint(like.get(j, ())):
                        keep.append(j)
                        held.add(j)
                return " ".join(parts[j] for j in keep)

            for texts in batches:
                yield texts.map(one)

        return kept(text)


class SensitiveTopic(Check):
    name, owasp, eu, advice = "sensitive_topic", ("LLM08",), ("Article 9",), "Add the disclaimers these topics need."

    def __init__(self, topics: Sequence[str] | None = None) -> None:
        self.topics = [t for t in R.TOPICS if not topics or t in topics]

    def evaluate(self, text: Column) -> Column:
        failed = lambda f: self.verdict(False, F.least(F.lit(1.0), F.size(f) * 0.35), "medium", json_of(sensitive_topics=f))
        named = [(t, "|".join(f"(?:{p})" for p in R.TOPICS[t])) for t in self.topics]
        return let(_matching(text, named), lambda f: F.when(F.size(f) == 0, self.passing()).otherwise(failed(f)))


class ProfanityFree(Check):
    name, owasp, advice, has_fix = "profanity_free", ("LLM08",), "Filter profanity before the text is served.", True

    def count(self, text: Column) -> Column:
        each = sum((count_matches(text, rx(p)) for p in R.PROFANITY), F.lit(0))
        return F.when(any_of(text, R.PROFANITY), each).otherwise(0)

    def evaluate(self, text: Column) -> Column:
        return let(self.count(text), lambda n: F.when(n == 0, self.passing()).otherwise(self.verdict(False, 1.0, "high", json_of(profanity_count=n))))

    def fix(self, text: Column) -> Column:
        """First letters stay, stars stand for the rest. All patterns are whole words, so words are masked one by one."""
        text = text_or_empty(text)
        whole = rx("^(?:" + "|".join(f"(?:{p})" for p in R.PROFANITY) + r")\z")
        masked = lambda w: F.when(w.rlike(whole), F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), F.length(w) - 1))).otherwise(w)
        pieces = F.regexp_extract_all(text, F.lit(r"(?sU)(\w+|\W+)"), 1)
        return F.when(any_of(text, R.PROFANITY), F.array_join(F.transform(pieces, masked), "")).otherwise(text)


class BiasCheck(Check):
    name, owasp, eu, advice = "bias_check", ("LLM08",), ("Article 9", "Article 10"), "Have the wording reviewed for fairness."

    def evaluate(self, text: Column) -> Column:
        failed = lambda f: self.verdict(False, F.least(F.lit(1.0), F.size(f) * 0.4), "high", json_of(bias_categories=f))
        return let(_matching(text, R.BIAS), lambda f: F.when(F.size(f) == 0, self.passing()).otherwise(failed(f)))


class ReadingLevel(Check):
    name, eu, advice = "reading_level", ("Article 13",), "Write for the readers that are meant."

    def __init__(self, low: float = 0.0, high: float = 12.0) -> None:
        self.low, self.high = low, high

    @staticmethod
    def grade(text: Column) -> Column:
        """Flesch-Kincaid grade, from counts over the whole text.

        A word has as many syllables as vowel runs, one less if it ends in e and has more than one, at least one.
        """
        small = F.lower(text)
        n = count_matches(text, r"(?U)\w+")
        runs = count_matches(small, "[aeiou]+")
        none = count_matches(small, r"(?U)(?<!\w)[^aeiou\W]+(?!\w)")
        # Ends in e behind a vowel that a consonant follows: more than one run.
        silent = count_matches(small, r"(?U)(?<!\w)\w*?[aeiou][^aeiou\W]\w*?e(?!\w)")
        s = F.greatest(F.lit(1), count_matches(text, "[.!?]+"))
        syllables = runs + none - silent
        return F.when(n == 0, 0.0).otherwise(F.lit(0.39) * (n / s) + F.lit(11.8) * (syllables / n) - 15.59)

    def evaluate(self, text: Column) -> Column:
        def fold(g: Column) -> Column:
            ok = g.between(self.low, self.high)
            score = F.least(F.lit(1.0), F.when(g > self.high, F.abs(g - self.high) / 10.0).otherwise(F.abs(F.lit(self.low) - g) / 5.0))
            bounds = {"min_grade": F.lit(self.low), "max_grade": F.lit(self.high)}
            return F.when(ok, self.verdict(True, details=json_of(grade_level=g))).otherwise(self.verdict(False, score, "low", json_of(grade_level=g, **bounds)))

        return let(rounded(self.grade(text), 1), fold)


CONTENT = (CompetitorCheck, BanList, RedundantSentences, SensitiveTopic, ProfanityFree, BiasCheck, ReadingLevel)
__all__ = ["CONTENT", "BanList", "BiasCheck", "CompetitorCheck", "ProfanityFree", "ReadingLevel", "RedundantSentences", "SensitiveTopic"]
