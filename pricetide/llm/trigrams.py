"""Boolean trigram queries from regular expressions, over text with A-Z lower-cased."""

from __future__ import annotations

import itertools
import re._constants as kind
import re._parser as parser
from dataclasses import dataclass
from typing import Any

#: Alternatives of an exact part that are spelled out before it is taken as unknown.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Query:
    """`op` is "all" (of `parts` and `trigrams`), "any" (of `parts`) or "every" text."""

    op: str
    trigrams: frozenset[str] = frozenset()
    parts: tuple["Query", ...] = ()


EVERY = Query("every")


def conjunction(parts: list[Query]) -> Query:
    trigrams: frozenset[str] = frozenset()
    rest: list[Query] = []
    for part in parts:
        if part.op == "all":
            trigrams |= part.trigrams
            rest += part.parts
        elif part.op == "any":
            rest.append(part)
    unique = tuple(dict.fromkeys(rest))
    return Query("all", trigrams, unique) if trigrams or unique else EVERY


def disjunction(parts: list[Query]) -> Query:
    if not parts or any(p.op == "every" for p in parts):
        return EVERY
    # A part that asks for all that another asks for, and more, adds nothing.
    unique = tuple(
        p
        for p in dict.fromkeys(parts)
        if not any(q != p and not q.parts and q.op == "all" and q.trigrams <= p.trigrams for q in parts)
    )
    return unique[0] if len(unique) == 1 else Query("any", parts=unique)


def of_strings(strings: set[str]) -> Query:
    """Texts that hold one of the strings hold the trigrams of one of them."""
    return disjunction(
        [
            Query("all", frozenset(s[i : i + 3] for i in range(len(s) - 2))) if len(s) > 2 else EVERY
            for s in sorted(strings)
        ]
    )


def _strings(item: tuple[Any, Any]) -> set[str] | None:
    """All strings that a node matches, if they are few."""
    op, value = item
    if op is kind.LITERAL:
        return {chr(value).lower()} if value < 128 else {chr(value)}
    if op is kind.IN:
        found: set[str] = set()
        for inner, v in value:
            if inner is kind.LITERAL:
                found.add(chr(v).lower() if v < 128 else chr(v))
            elif inner is kind.RANGE and v[1] - v[0] < MOST_STRINGS:
                found |= {chr(c).lower() if c < 128 else chr(c) for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= 4 else None
    if op is kind.SUBPATTERN:
        return _sequence_strings(value[-1])
    if op is kind.BRANCH:
        each = [_sequence_strings(b) for b in value[1]]
        return None if any(e is None for e in each) else set().union(*each)
    if op is kind.MAX_REPEAT and value[1] == 1:
        inner_strings = _sequence_strings(value[2])
        return None if inner_strings is None else inner_strings | ({""} if value[0] == 0 else set())
    if op is kind.AT:
        return {""}
    return None


def _sequence_strings(items: Any) -> set[str] | None:
    found = {""}
    for item in items:
        more = _strings(item)
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a, b in itertools.product(found, more)}
    return found


def _node(item: tuple[Any, Any]) -> Query:
    """What a text that a node of unknown strings matches must hold."""
    op, value = item
    if op is kind.SUBPATTERN:
        return _sequence(value[-1])
    if op is kind.BRANCH:
        return disjunction([_sequence(b) for b in value[1]])
    if op is kind.MAX_REPEAT and value[0] > 0:
        return _sequence(value[2])
    return EVERY


def _sequence(items: Any) -> Query:
    parts, run = [], {""}
    for item in items:
        more = _strings(item)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a, b in itertools.product(run, more)}
            continue
        parts.append(of_strings(run))
        run = more if more is not None else {""}
        if more is None:
            parts.append(_node(item))
    parts.append(of_strings(run))
    return conjunction(parts)


def trigram_query(pattern: str) -> Query:
    """The query that every text with a match of `pattern` satisfies once A-Z are lower-cased."""
    return _sequence(parser.parse(pattern))


def all_trigrams(query: Query) -> set[str]:
    return set(query.trigrams).union(*(all_trigrams(p) for p in query.parts))
