"""What a text must hold for a pattern to match: literals that are looked for before the pattern itself runs.

A pattern's required literals are read off its syntax tree: clauses of which each must be met, a clause being met by any one of
its strings. They are a necessary condition only, so a test by them and then by the pattern gives what the pattern gives.
Looking for a string in the bytes of a text is far cheaper than a pattern that tries each position, and most texts hold none.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that a run of literals may stand for, strings in a clause, clauses of a pattern, and the least length of a string.
RUN, CLAUSE, CLAUSES, SHORTEST = 8, 24, 2, 2

Clause = frozenset[str]


def _letters(token, value) -> Clause | None:
    """The characters (in lower case) that a token stands for, if they are few and ASCII."""
    if token is op.LITERAL:
        return frozenset([chr(value).lower()]) if value < 128 else None
    if token is op.IN and all(t is op.LITERAL and v < 128 for t, v in value):
        return frozenset(chr(v).lower() for _, v in value)
    return None


def _best(clauses: list[Clause]) -> Clause | None:
    fit = [c for c in clauses if c and len(c) <= CLAUSE and min(map(len, c)) >= SHORTEST]
    return max(fit, key=lambda c: (min(min(map(len, c)), 6), -len(c)), default=None)


def _read(tokens) -> tuple[Clause | None, list[Clause]]:
    """The strings that a sequence stands for, if they are all of it, and the clauses that it needs."""
    run: Clause | None = frozenset([""])
    whole, clauses = True, []

    def end() -> None:
        nonlocal run, whole
        if run and run != {""}:
            clauses.append(run)
        run, whole = frozenset([""]), False

    def add(more: Clause) -> None:
        nonlocal run
        if len(run) * len(more) > RUN:
            end()
        run = frozenset(a + b for a in run for b in more)

    for token, value in tokens:
        letters = _letters(token, value)
        if letters:
            add(letters)
        elif token in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue  # takes no text
        elif token is op.SUBPATTERN or token is op.ATOMIC_GROUP:
            strings, inner = _read(value[-1] if token is op.SUBPATTERN else value)
            if strings is not None and len(strings) <= RUN:
                add(strings)
            else:
                end()
                clauses.extend(inner if strings is None else [strings])
        elif token is op.BRANCH:
            parts = [_read(p) for p in value[1]]
            if all(s is not None for s, _ in parts) and len(frozenset().union(*(s for s, _ in parts))) <= RUN:
                add(frozenset().union(*(s for s, _ in parts)))
            else:
                end()
                needs = [_best(inner if s is None else [s, *inner]) for s, inner in parts]
                if all(needs):
                    clauses.append(frozenset().union(*needs))
        elif token in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            end()
            strings, inner = _read(value[2])
            clauses.extend(inner if strings is None else [strings])
        else:
            end()
    strings = run if whole else None
    if not whole:
        end()
    return strings, clauses


@functools.cache
def required(pattern: str) -> tuple[Clause, ...]:
    """The clauses of a pattern worth testing, in lower case; none if it has no required literal or is not understood."""
    try:
        strings, clauses = _read(parser.parse(pattern))
    except (re.error, OverflowError):
        return ()
    clauses = [strings] if strings is not None else clauses
    picked: list[Clause] = []
    while len(picked) < CLAUSES and (c := _best([x for x in clauses if x not in picked])):
        picked.append(c)
    return tuple(picked)


def may_match(low: Column, pattern: str) -> Column | None:
    """Whether a text, given in lower case, holds what the pattern requires; ``None`` if that is nothing."""
    out = None
    for clause in required(pattern):
        # a string that holds another one of the clause says nothing more
        least = [x for x in sorted(clause) if not any(y != x and y in x for y in clause)]
        found = F.contains(low, F.lit(least[0]))
        for x in least[1:]:
            found = found | F.contains(low, F.lit(x))
        out = found if out is None else out & found
    return out


def bounds(pattern: str) -> str:
    """The pattern with ``\\b`` between ASCII word characters and all else, as ``\\w`` has it: Java 17's own also takes letters of any script as words."""
    return re.sub(r"\\(.)", lambda m: r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))" if m[1] == "b" else m[0], pattern, flags=re.DOTALL)


def rlike(text: Column, low: Column, pattern: str, flags: str = "i") -> Column:
    """``text RLIKE pattern`` that runs the pattern only where ``low`` (the text in lower case) may match."""
    full = text.rlike(bounds(f"(?{flags}){pattern}" if flags else pattern))
    maybe = may_match(low, pattern)
    return full if maybe is None else F.coalesce(F.when(maybe, full), F.when(text.isNotNull(), F.lit(False)))


def with_lower(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(text, lower(text))`` as one expression that computes both once; null for a null text."""
    both = F.array(F.struct(text.alias("t"), F.lower(text).alias("low")))
    return F.when(text.isNotNull(), F.get(F.transform(both, lambda x: body(x["t"], x["low"])), F.lit(0)))
