"""Words that every match of a pattern must hold, read off the pattern: a search for them is far cheaper than the pattern."""

from __future__ import annotations

import re
import warnings
from functools import cache
from re import _constants as K
from re import _parser

#: A finite set of strings grows to so many at most before it is cut into two.
_MOST = 24
_Words = frozenset[str]


def _plain(c: str) -> bool:
    """Its lower case is the same in Java and Python, and in any surroundings."""
    return c.isascii() or "а" <= c.lower() <= "я" or "一" <= c <= "鿿"


def _chars(members: list) -> _Words | None:
    """The lower-case characters of a small class; None for others."""
    out = set()
    for op, value in members:
        if op is not K.LITERAL or not _plain(chr(value)):
            return None
        out.add(chr(value).lower())
    return frozenset(out) if len(out) <= 4 else None


def _tested(words: _Words) -> _Words | None:
    """The words without those that hold another one; None if one is too short to tell anything."""
    if not words or min(map(len, words)) < 2:
        return None
    return frozenset(w for w in words if not any(v != w and v in w for v in words))


def _weight(words: _Words) -> tuple:
    """Least for the test that most texts fail and that costs least: no short words, few of them, long ones."""
    return min(map(len, words)) < 4, len(words), -min(map(len, words)), sorted(words)


def _best(tests: list[_Words]) -> _Words | None:
    return min(tests, key=_weight) if tests else None


def _item(op, value) -> tuple[_Words | None, list[_Words]]:
    """The strings that a part of the pattern stands for, if they are few, else None; and sets of which each match holds a word."""
    if op is K.LITERAL and _plain(chr(value)):
        return frozenset({chr(value).lower()}), []
    if op is K.IN:
        return _chars(value), []
    if op is K.AT:
        return frozenset({""}), []
    if op is K.SUBPATTERN:
        return _sequence(value[3])
    if op is K.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(words is not None for words, _ in parts):
            return frozenset().union(*(words for words, _ in parts)), []
        chosen = [_best(tests + ([t] if words and (t := _tested(words)) else [])) for words, tests in parts]
        return None, [t] if all(chosen) and (t := _tested(frozenset().union(*chosen))) else []
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, most, inner = value
        words, tests = _sequence(inner)
        if words is not None and (least, most) in ((0, 1), (1, 1)):
            return words | {""} if least == 0 else words, []
        return None, (tests + ([t] if words and (t := _tested(words)) else [])) if least else []
    return None, []


def _sequence(parsed) -> tuple[_Words | None, list[_Words]]:
    run, whole, tests = frozenset({""}), True, []

    def end() -> None:
        nonlocal run
        if t := _tested(run):
            tests.append(t)
        run = frozenset({""})

    for op, value in parsed:
        words, more = _item(op, value)
        if words is not None and len(run) * len(words) <= _MOST:
            run = frozenset(a + b for a in run for b in words)
            continue
        whole = False
        end()
        tests += more
        if words is not None and len(words) <= _MOST:
            run = words
        elif words is not None and (t := _tested(words)):
            tests.append(t)
    if whole:
        return run, []
    end()
    return None, tests


@cache
def needed(pattern: str) -> tuple[_Words, ...]:
    """Sets of lower-case words; the lower case of each text that matches holds one word of every set. Empty where nothing can be told."""
    if re.search(r"&&|\[[^\]]*\[|\\[QEpPxuzZGhHRvVNX0-9c]|\(\?[a-z]*[xu]|\(\?[<!=>(]|\(\?P", pattern):
        return ()  # written otherwise in Java and in Python
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            words, tests = _sequence(_parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return ()
    if words is not None:
        tests = [t] if (t := _tested(words)) else []
    return tuple(sorted(set(tests), key=_weight))
