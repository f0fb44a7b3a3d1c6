"""What a text must hold for a pattern to match: plain strings that are cheap to look for.

A search for dozens of case-blind Unicode patterns costs microseconds a character, one for a plain string about
a nanosecond. ``required`` reads a pattern's syntax tree for sets of strings of which every match holds
one each, so a pattern runs only on texts that can match it. The test is necessary, never sufficient: results are the same.
"""

from __future__ import annotations

import re
from functools import cache
from re import _constants as op  # the standard library's own parser of its patterns
from re import _parser

#: Stands for any decimal digit.
DIGIT = "\0digit"
SHORTEST = 3


#: How likely a text holds a string of so many letters by chance, and what a pattern's search costs in string searches.
_CHANCE = {3: 0.4, 4: 0.15, 5: 0.05}
_SEARCH = 60


def _cost(strings: frozenset[str]) -> float:
    chance = sum(0.5 if x == DIGIT else _CHANCE.get(len(x), 0.02) for x in strings)
    return len(strings) + _SEARCH * min(1.0, chance)


def _best(options: list[frozenset[str]]) -> list[frozenset[str]]:
    usable = {o for o in options if o and all(x == DIGIT or len(x) >= SHORTEST for x in o)}
    return sorted(usable, key=lambda o: (_cost(o), sorted(o)))


def _of(items) -> list[frozenset[str]]:
    """Sets of strings; a match holds one string of each set."""
    options: list[frozenset[str]] = []
    run = ""
    for kind, value in items:
        if kind is op.LITERAL and chr(value).lower().isascii() and chr(value) != "\0":
            run += chr(value).lower()
            continue
        if run:
            options.append(frozenset([run]))
            run = ""
        if kind is op.SUBPATTERN:
            options += _of(value[3])
        elif kind is op.BRANCH:
            each = [_best(_of(x)) for x in value[1]]
            if all(each):
                options.append(frozenset().union(*[x[0] for x in each]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
            options += _of(value[2])
        elif kind is op.IN and all(k is op.RANGE and v == (48, 57) or k is op.CATEGORY and v is op.CATEGORY_DIGIT for k, v in value):
            options.append(frozenset([DIGIT]))
    if run:
        options.append(frozenset([run]))
    return options


@cache
def required(pattern: str) -> tuple[frozenset[str], ...]:
    """At most two sets of lower-case strings (or DIGIT): every case-blind match holds a string of each."""
    return tuple(_best(_of(_parser.parse(pattern, re.IGNORECASE)))[:2])
