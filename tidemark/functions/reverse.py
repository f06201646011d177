"""The pattern of the same events in reverse order."""

from __future__ import annotations

from tidemark.functions.pattern import Alt, Drop, Empty, Mapped, Named, Pattern, Rep, Seq, Step


def reversed_pattern(p: Pattern) -> Pattern:
    """Matches a list of events just if ``p`` matches it read backwards, on as many
    paths; values and captures play no part."""
    if isinstance(p, (Step, Empty)):
        return p
    if isinstance(p, Seq):
        return Seq(tuple(reversed_pattern(q) for q in reversed(p.parts)))
    if isinstance(p, Alt):
        return Alt(tuple(reversed_pattern(q) for q in p.branches))
    if isinstance(p, Rep):
        return Rep(reversed_pattern(p.body), p.min, p.max)
    if isinstance(p, (Named, Mapped, Drop)):
        return reversed_pattern(p.body)
    raise TypeError(f"not a pattern: {p!r}")
