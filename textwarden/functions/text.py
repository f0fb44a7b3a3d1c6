"""Text expressions with the exact meaning the checks need, all on the JVM side.

Patterns run as Java regular expressions with Unicode classes and case folding, Unix lines only.
``let`` binds a column once, however often the result uses it: the optimizer may otherwise copy an
expression, and with it hundreds of pattern searches, into each of its uses.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prefilter import DIGIT, required

SENTENCE_END = r"(?U)(?<=[.!?])\s+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def rx(pattern: str, flags: str = "i") -> str:
    """A pattern with its flags: i case-blind, s dot matches newlines, m multi-line anchors."""
    return f"(?{flags}uUd)" + pattern


_TOKEN = re.compile(r"\\.|\(\?[A-Za-z]*[:=!)]|\[\^?|.", re.DOTALL)
_FOLDS = {"s": "\u017f", "k": "\u212a"}  # what equals an ASCII letter but for its case, and is none


def rx_ascii(pattern: str, flags: str = "i") -> str:
    """A pattern as RE2 reads it, which DuckDB uses: words, digits and white space are ASCII,
    so a word ends before an accented letter; case is folded as in ``rx`` but for the dotless and the dotted i."""
    out, members = [], None
    for token in _TOKEN.findall(pattern):
        if members is not None and token != "]":
            members.append(token)
        elif members is not None:
            listed = re.compile("[" + "".join(members) + "]", re.IGNORECASE | re.ASCII)
            out.append("".join(r"\t\n\f\r " if m == r"\s" else m for m in members) + "".join(x for c, x in _FOLDS.items() if "i" in flags and listed.match(c)) + "]")
            members = None
        elif token[0] == "[":
            out.append(token)
            members = []
        elif token == r"\b":
            out.append(r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
        elif token == r"\s":
            out.append(r"[\t\n\f\r ]")
        elif "i" in flags and (token == r"\w" or token.lower() in _FOLDS):
            out.append(f"[{token}{_FOLDS.get(token.lower()) or ''.join(_FOLDS.values())}]")
        else:
            out.append(token)
    return f"(?{flags}d)" + "".join(out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fold_case(text: Column) -> Column:
    """Lower case, and the four characters that equal an ASCII letter but for their case as that letter."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def gate(folded: Column, pattern: str) -> Column | None:
    """True wherever a pattern can match, told by plain strings; None if nothing tells."""
    sets = required(pattern)
    if not sets:
        return None
    holds = lambda x: folded.rlike(r"\p{Nd}") if x == DIGIT else F.contains(folded, F.lit(x))
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(holds, sorted(x))) for x in sets])


def matches(text: Column, folded: Column, pattern: str, flags: str = "i", read: Callable[[str, str], str] = rx) -> Column:
    """Whether a pattern matches; ``folded`` is fold_case(text), bound once by the caller; ``read`` is rx or rx_ascii."""
    test, open_ = text.rlike(read(pattern, flags)), gate(folded, pattern)
    return test if open_ is None else open_ & test


def any_of(text: Column, patterns: Sequence[str], flags: str = "i") -> Column:
    """True if any pattern matches."""
    return let(fold_case(text), lambda low: reduce(lambda a, b: a | b, [matches(text, low, p, flags) for p in patterns], F.lit(False)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), 1)


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def quote(literal: str) -> str:
    """A literal as a pattern."""
    return "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in literal)


def rounded(value: Column, digits: int) -> Column:
    """Rounded on the exact binary value, half to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits)).cast("double")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))
