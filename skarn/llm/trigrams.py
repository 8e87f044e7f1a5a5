"""Boolean trigram queries derived from regular expressions.

A query is a conjunction of clauses; a clause is a set of alternatives of which one must hold;
an alternative is a set of trigrams that must all occur in the lower-cased text.  It follows
from the parsed pattern: runs of the pattern with few possible strings give alternatives, what
can match anything else ends a run.  A pattern without a run of three characters has no clause.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser as P

#: A run with more possible strings than this is cut; a cut only weakens the query.
MAX_STRINGS = 64

Alternative = frozenset[str]
Clause = frozenset[Alternative]


def grams(text: str) -> Alternative:
    """The fewest trigrams that cover the string: every third, and the last."""
    return frozenset(text[k : k + 3] for k in {*range(0, len(text) - 2, 3), len(text) - 3})


def _strings(node) -> set[str] | None:
    """All strings that a piece of a pattern can match, if they are few."""
    op, arg = node
    if op is K.LITERAL:
        return {chr(arg).lower()}
    if op is K.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is K.LITERAL:
                found.add(chr(value).lower())
            elif kind is K.RANGE and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found
    if op is K.SUBPATTERN:
        return _sequence(arg[-1])
    if op is K.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, inner = arg
        one = _sequence(inner) if high is not K.MAXREPEAT and high <= 4 else None
        if one is None:
            return None
        found, grown = (set(), {""})
        for k in range(int(high) + 1):
            if k >= low:
                found |= grown
            grown = {a + b for a in grown for b in one}
            if len(grown) > MAX_STRINGS:
                return None
        return found
    return {""} if op is K.AT else None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _clauses(nodes) -> list[Clause]:
    out: list[Clause] = []
    run = {""}

    def close() -> None:
        nonlocal run
        if all(len(s) >= 3 for s in run):
            every = set(map(grams, run))
            out.append(frozenset(a for a in every if not any(b < a for b in every)))
        run = {""}

    for node in nodes:
        more = _strings(node)
        if more is not None and len(run) * len(more) <= MAX_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        close()
        if more is not None and len(more) <= MAX_STRINGS:
            run = more
        elif node[0] is K.SUBPATTERN:
            out += _clauses(node[1][-1])
        elif node[0] in (K.MAX_REPEAT, K.MIN_REPEAT) and node[1][0] >= 1:
            out += _clauses(node[1][2])
    close()
    return out


def query(pattern: str) -> list[Clause]:
    """The clauses that every match of ``pattern`` implies; empty if any text may match."""
    return list(dict.fromkeys(_clauses(P.parse(pattern, re.ASCII))))
