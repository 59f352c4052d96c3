"""Boolean trigram conditions that every match of a regular expression satisfies.

A condition is a list of alternatives, each a set of lower-case trigrams; a
text without all trigrams of at least one alternative cannot match. ``None``
means that the expression has no mandatory trigram.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse

#: Most strings a part may stand for before it counts as unknown text.
MOST = 32

Condition = list[frozenset[str]] | None


def _strings(part) -> set[str] | None:
    """All strings that a parsed expression can stand for, or None if too many."""
    known = {""}
    for op, arg in part:
        one = _one(op, arg)
        if one is None:
            return None
        known = {a + b for a in known for b in one}
        if len(known) > MOST:
            return None
    return known


def _one(op, arg) -> set[str] | None:
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.SUBPATTERN:
        return _strings(arg[-1])
    if op is sre.BRANCH:
        each = [_strings(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op is sre.IN:
        chars = set()
        for kind, value in arg:
            if kind is not sre.LITERAL:
                return None
            chars.add(chr(value).lower())
        return chars if len(chars) <= MOST else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
        inner = _strings(arg[2])
        if inner is None:
            return None
        known, out = {""}, set()
        for n in range(arg[1] + 1):
            if n >= arg[0]:
                out |= known
            known = {a + b for a in known for b in inner}
            if len(known) + len(out) > MOST:
                return None
        return out
    return {""} if op is sre.AT else None


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _conditions(part) -> list[Condition]:
    """One condition for each stretch of the expression that is known text."""
    found: list[Condition] = []
    run: set[str] | None = {""}

    def close() -> None:
        nonlocal run
        if run and all(len(s) >= 3 for s in run):
            found.append([_trigrams(s) for s in sorted(run)])
        run = {""}

    for op, arg in part:
        one = _one(op, arg)
        if one is not None and len(run) * len(one) <= MOST:
            run = {a + b for a in run for b in one}
            continue
        close()
        if one is not None:
            run = one
        elif op is sre.SUBPATTERN:
            found += _conditions(arg[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            found += _conditions(arg[2])
        elif op is sre.BRANCH:
            each = [condition(x) for x in arg[1]]
            if None not in each:
                found.append([a for c in each for a in c])
    close()
    return found


def condition(parsed) -> Condition:
    """The most selective condition of an expression: the one whose weakest alternative is longest."""
    found = _conditions(parsed)
    if not found:
        return None
    best = max(found, key=lambda c: (min(map(len, c)), -len(c)))
    # An alternative that contains another adds nothing.
    return [a for a in dict.fromkeys(best) if not any(b < a for b in best)]


def mandatory(pattern: str) -> Condition:
    """The trigram condition of a pattern, letters taken without case."""
    return condition(sre_parse.parse(pattern))
