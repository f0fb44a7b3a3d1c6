"""Checks of one's own: from an expression, or from a Python function run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import Check, let


class ColumnCheck(Check):
    """``score`` maps the text column to a score from 0 to 1; a text fails from ``threshold`` on."""

    def __init__(self, name: str, score: Callable[[Column], Column], threshold: float = 0.5, severity: str = "medium", owasp: Sequence[str] = (), eu: Sequence[str] = (), advice: str = "") -> None:
        self.name, self.score, self.threshold, self.severity = name, score, threshold, severity
        self.owasp, self.eu, self.advice = tuple(owasp), tuple(eu), advice

    def evaluate(self, text: Column) -> Column:
        def fold(s: Column) -> Column:
            return F.when(s.isNull(), F.lit(None)).when(s >= self.threshold, self.verdict(False, s, self.severity)).otherwise(self.verdict(True, s))

        return let(self.score(text).cast("double"), fold)


class ArrowCheck(ColumnCheck):
    """The score comes from a Python function of one text. A function that raises skips the check for that text."""

    def __init__(self, name: str, score_of: Callable[[str], float], **kw) -> None:
        def scored(text: Column) -> Column:
            @F.pandas_udf("double")
            def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                def one(t: str | None) -> float | None:
                    try:
                        return float(score_of(t or ""))
                    except Exception:  # whatever goes wrong, the check is skipped
                        return None

                for texts in batches:
                    yield texts.map(one)

            return run(text)

        super().__init__(name, scored, **kw)
