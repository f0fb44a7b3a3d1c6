"""Format validators. Those that need a real parser run it in Arrow batches; all others are expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_blank, let, lines, rounded, strip, text_or_empty, words
from .base import Check, json_of


def _parser(error_of: Callable[[str], str | None]):
    """A column function giving the error of each text, null where there is none."""

    @F.pandas_udf("string")
    def errors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: error_of(t or ""))

    return errors


def json_error(text: str) -> str | None:
    import json

    try:
        json.loads(text.strip())
    except (ValueError, RecursionError) as e:
        return str(e)
    return None


def html_error(text: str) -> str | None:
    from html.parser import HTMLParser

    parser = HTMLParser()
    try:
        parser.feed(text)
        parser.close()
    except Exception as e:  # the parser's own failures are what is asked for
        return str(e)
    return None


def python_error(text: str) -> str | None:
    """What the compiler says against a text. One that is nested too deeply for it to read or translate is refused as well; a lack of memory stays an error."""
    import re
    import warnings

    code = re.sub(r"^```(?:python)?\n?", "", text.strip())
    code = re.sub(r"\n?```$", "", code)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(code, "<text>", "exec")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        if isinstance(e, MemoryError) and "too complex" not in str(e):
            raise
        return f"{getattr(e, 'lineno', None) or 0}:{e}"
    return None


def sql_error(schema: Sequence[str] = ()) -> Callable[[str], str | None]:
    """Against an empty database, or one with the given CREATE statements. Text that is no single statement is skipped: the error is "skip"."""

    def error(text: str) -> str | None:
        import sqlite3

        con = sqlite3.connect(":memory:")
        try:
            for statement in schema:
                con.execute(statement)
            con.execute(f"EXPLAIN {text.strip()}")
        except sqlite3.OperationalError as e:
            return str(e)
        except (sqlite3.Error, sqlite3.Warning, ValueError):
            return "skip"
        finally:
            con.close()
        return None

    return error


class _Parsed(Check):
    owasp = ("LLM02",)
    error_of: Callable[[str], str | None]

    def error(self, text: Column) -> Column:
        return _parser(type(self).error_of)(text)

    def evaluate(self, text: Column) -> Column:
        return let(self.error(text), lambda e: F.when(e.isNull(), self.passing()).otherwise(self.verdict(False, 1.0, "high", json_of(error=e))))


class ValidJson(_Parsed):
    name, advice = "valid_json", "The text must be JSON."
    error_of = staticmethod(json_error)


class ValidHtml(_Parsed):
    name, advice = "valid_html", "The text must be HTML."
    error_of = staticmethod(html_error)


class ValidPython(_Parsed):
    name, advice = "valid_python", "The text must be Python."
    error_of = staticmethod(python_error)

    def evaluate(self, text: Column) -> Column:
        def failed(e: Column) -> Column:
            return self.verdict(False, 1.0, "high", json_of(error=F.regexp_extract(e, r"(?s)^\d+:(.*)$", 1), line=F.regexp_extract(e, r"^(\d+):", 1).cast("int")))

        return let(self.error(text), lambda e: F.when(e.isNull(), self.passing()).otherwise(failed(e)))


class ValidSql(_Parsed):
    """A null verdict is a check that was skipped."""

    name, advice = "valid_sql", "The text must be one SQL statement."

    def __init__(self, schema: Sequence[str] = ()) -> None:
        self.schema = tuple(schema)

    def error(self, text: Column) -> Column:
        return _parser(sql_error(self.schema))(text)

    def evaluate(self, text: Column) -> Column:
        return let(self.error(text), lambda e: F.when(e == "skip", F.lit(None)).when(e.isNull(), self.passing()).otherwise(self.verdict(False, 1.0, "high", json_of(error=e))))


class _Simple(Check):
    """Passes where ``holds``; fails with one score and severity."""

    severity = "medium"

    def holds(self, text: Column) -> Column:
        raise NotImplementedError

    def details(self, text: Column) -> Column:
        return F.lit("{}")

    def evaluate(self, text: Column) -> Column:
        return F.when(self.holds(text), self.passing()).otherwise(self.verdict(False, 1.0, self.severity, self.details(text)))


class ValidUrl(Check):
    name, advice = "valid_url", "The text must be a URL with scheme and host."

    def __init__(self, require_https: bool = False) -> None:
        self.require_https = require_https

    def evaluate(self, text: Column) -> Column:
        def fold(url: Column) -> Column:
            scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]+", 1))
            out = F.when(scheme == "", self.verdict(False, 1.0, "medium", json_of(error=F.lit("no scheme or host"), url=url)))
            if self.require_https:
                out = out.when(scheme != "https", self.verdict(False, 0.8, "medium", json_of(url=url, scheme=scheme)))
            return out.otherwise(self.passing())

        return let(strip(text), fold)


class ValidLength(_Simple):
    name, advice = "valid_length", "The text must be of the allowed length."

    def __init__(self, low: int = 0, high: int = 10_000) -> None:
        self.low, self.high = low, high

    def evaluate(self, text: Column) -> Column:
        details = json_of(length=F.length(text))
        return F.when(F.length(text).between(self.low, self.high), self.verdict(True, details=details)).otherwise(self.verdict(False, 1.0, "medium", details))


class ValidChoices(_Simple):
    name, advice = "valid_choices", "The text must be one of the choices."

    def __init__(self, choices: Sequence[str], case_sensitive: bool = False) -> None:
        self.choices, self.case_sensitive = list(choices), case_sensitive

    def holds(self, text: Column) -> Column:
        if self.case_sensitive:
            return strip(text).isin(self.choices)
        return F.lower(strip(text)).isin([c.lower() for c in self.choices])

    def details(self, text: Column) -> Column:
        return json_of(value=strip(text), allowed=F.array(*map(F.lit, self.choices)).cast("array<string>"))


class RegexMatch(_Simple):
    name, advice = "regex_match", "The text must match the pattern."

    def __init__(self, pattern: str, full_match: bool = False) -> None:
        self.pattern, self.full_match = pattern, full_match

    def holds(self, text: Column) -> Column:
        return text.rlike(f"(?Ud)^(?:{self.pattern})\\z" if self.full_match else f"(?Ud){self.pattern}")

    def details(self, text: Column) -> Column:
        return json_of(pattern=F.lit(self.pattern))


class ContainsString(_Simple):
    name, advice = "contains_string", "The text must hold the given part."

    def __init__(self, part: str, case_sensitive: bool = False) -> None:
        self.part, self.case_sensitive = part, case_sensitive

    def holds(self, text: Column) -> Column:
        return F.contains(text, F.lit(self.part)) if self.case_sensitive else F.contains(F.lower(text), F.lit(self.part.lower()))

    def details(self, text: Column) -> Column:
        return json_of(required_substring=F.lit(self.part))


class EndsWith(_Simple):
    name, advice = "ends_with", "The text must end as asked."

    def __init__(self, suffix: str, case_sensitive: bool = False) -> None:
        self.suffix, self.case_sensitive = suffix, case_sensitive

    def holds(self, text: Column) -> Column:
        return F.endswith(strip(text), F.lit(self.suffix)) if self.case_sensitive else F.endswith(F.lower(strip(text)), F.lit(self.suffix.lower()))

    def details(self, text: Column) -> Column:
        return json_of(required_suffix=F.lit(self.suffix))


class OneLine(_Simple):
    name, advice, severity, has_fix = "one_line", "The text must be one line.", "low", True

    @staticmethod
    def filled(text: Column) -> Column:
        return F.filter(lines(text), lambda x: ~is_blank(x))

    def holds(self, text: Column) -> Column:
        return F.size(self.filled(text)) <= 1

    def details(self, text: Column) -> Column:
        return json_of(line_count=F.size(self.filled(text)))

    def fix(self, text: Column) -> Column:
        return F.array_join(F.transform(self.filled(text_or_empty(text)), strip), " ")


class ReadingTime(Check):
    name, advice = "reading_time", "The text takes too long to read."
    WORDS_PER_MINUTE = 238  # fixed value

    def __init__(self, max_minutes: float = 5.0) -> None:
        self.max_minutes = max_minutes

    def evaluate(self, text: Column) -> Column:
        def fold(n: Column) -> Column:
            minutes = n / F.lit(self.WORDS_PER_MINUTE)
            said = {"word_count": n, "estimated_minutes": rounded(minutes, 2)}
            score = F.least(F.lit(1.0), (minutes - self.max_minutes) / self.max_minutes)
            return F.when(minutes <= self.max_minutes, self.verdict(True, details=json_of(**said))).otherwise(self.verdict(False, score, "low", json_of(**said, max_minutes=F.lit(self.max_minutes))))

        return let(F.size(words(text)), fold)


class Uppercase(_Simple):
    name, advice, severity, has_fix = "uppercase", "The text must be upper case.", "low", True

    def holds(self, text: Column) -> Column:
        return text == F.upper(text)

    def fix(self, text: Column) -> Column:
        return F.upper(text_or_empty(text))


class Lowercase(_Simple):
    name, advice, severity, has_fix = "lowercase", "The text must be lower case.", "low", True

    def holds(self, text: Column) -> Column:
        return text == F.lower(text)

    def fix(self, text: Column) -> Column:
        return F.lower(text_or_empty(text))


class TwoWords(_Simple):
    name, advice, severity = "two_words", "The text must be two words.", "low"

    def holds(self, text: Column) -> Column:
        return F.size(words(text)) == 2

    def details(self, text: Column) -> Column:
        return json_of(word_count=F.size(words(text)))


FORMATS = (ValidJson, ValidHtml, ValidSql, ValidPython, ValidUrl, ValidLength, ValidChoices, RegexMatch, ContainsString, EndsWith, OneLine, ReadingTime, Uppercase, Lowercase, TwoWords)
