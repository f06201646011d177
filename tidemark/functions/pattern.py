"""Pattern building blocks.

A pattern is a small immutable tree of Python objects whose leaves are
Spark Column predicates.  Nothing here touches data: the tree is compiled
on the driver into a step table (``tidemark.plans.automaton``) and a
symbol column (one bit per distinct predicate), and all data work then
runs in Spark.

Combinators (the user surface):

    step(name, predicate)      one event that satisfies ``predicate``
    lit(column, value)         one event whose ``column`` equals ``value``
    completed(value)           the empty sequence, giving ``value``
    fail(message)              a step that never matches
    a >> b  / a.then(b)        a, then directly b
    a.keep_left(b)             both in sequence, keep a's captures
    a.keep_right(b)            both in sequence, keep b's captures
    a | b   / a.or_(b)         either branch; both advance together
    a.optional()               a or nothing
    a.repeated()               zero or more a
    a.one_or_more()            one or more a
    a.named(branch)            name a top-level branch (reported as ``alt``)
    a.map(fn), a.as_(v)        a part's value; the match's is ``result`` (O9, O10)
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Pattern:
    """Base class; subclasses are frozen dataclasses."""

    # -- syntax -----------------------------------------------------------
    def then(self, other: "Pattern") -> "Pattern":
        return Seq(_flat(self, Seq) + _flat(other, Seq))

    def __rshift__(self, other: "Pattern") -> "Pattern":
        return self.then(other)

    def keep_left(self, other: "Pattern") -> "Pattern":
        return Seq(_flat(self, Seq) + _flat(Drop(other), Seq))

    def keep_right(self, other: "Pattern") -> "Pattern":
        return Seq(_flat(Drop(self), Seq) + _flat(other, Seq))

    def or_(self, other: "Pattern") -> "Pattern":
        return Alt(_flat(self, Alt) + _flat(other, Alt))

    def __or__(self, other: "Pattern") -> "Pattern":
        return self.or_(other)

    def optional(self) -> "Pattern":
        return Rep(self, 0, 1)

    def repeated(self) -> "Pattern":
        return Rep(self, 0, None)

    def one_or_more(self) -> "Pattern":
        return Rep(self, 1, None)

    def named(self, branch: str) -> "Pattern":
        return Named(self, branch)

    def map(self, fn) -> "Pattern":
        """This part's value is ``fn(captures)``, a Column built from the
        captured columns (``captures[step][column]``) and from the value of
        what is mapped (``captures.value``: maps of maps, branches)."""
        return Mapped(self, fn)

    def as_(self, value: Any) -> "Pattern":
        """This part's value is the constant ``value``."""
        return Mapped(self, lambda _caps: F.lit(value))

    # -- introspection ----------------------------------------------------
    def steps(self) -> list["Step"]:
        out: list[Step] = []
        _collect_steps(self, out)
        return out


@dataclass(frozen=True, eq=False)
class Step(Pattern):
    """One event satisfying ``predicate`` (O1 literal, O2 pattern, O4 error).

    ``name`` labels the step in ``fail_expected`` and in captures.
    ``column``/``value`` are set for literal steps, so the matcher can show
    the offending value of a failed event by default.  ``project`` holds
    columns computed on the event taken as this step (O2).
    """

    name: str
    predicate: Column | None  # None = never matches (O4)
    column: str | None = None
    value: Any = None
    project: tuple[tuple[str, Column], ...] = ()


@dataclass(frozen=True, eq=False)
class Seq(Pattern):
    parts: tuple[Pattern, ...]


@dataclass(frozen=True, eq=False)
class Alt(Pattern):
    branches: tuple[Pattern, ...]


@dataclass(frozen=True, eq=False)
class Rep(Pattern):
    body: Pattern
    min: int
    max: int | None  # None = unbounded


@dataclass(frozen=True, eq=False)
class Empty(Pattern):
    """The empty sequence with a constant result (O3)."""

    value: Any = None


@dataclass(frozen=True, eq=False)
class Named(Pattern):
    body: Pattern
    branch: str


@dataclass(frozen=True, eq=False)
class Mapped(Pattern):
    """Matches like ``body``; ``fn(captures)`` is the match's result."""

    body: Pattern
    fn: Any


@dataclass(frozen=True, eq=False)
class Drop(Pattern):
    """Matches like ``body`` but its captures are not kept."""

    body: Pattern


def _flat(p: Pattern, kind: type) -> tuple[Pattern, ...]:
    if isinstance(p, kind):
        return p.parts if kind is Seq else p.branches
    return (p,)


def _collect_steps(p: Pattern, out: list) -> None:
    if isinstance(p, Step):
        out.append(p)
    elif isinstance(p, Seq):
        for q in p.parts:
            _collect_steps(q, out)
    elif isinstance(p, Alt):
        for q in p.branches:
            _collect_steps(q, out)
    elif isinstance(p, (Rep, Named, Drop, Mapped)):
        _collect_steps(p.body, out)


# -- values -------------------------------------------------------------------

class Captures(dict):
    """``captures[step][column]``, and in ``value`` the value of the mapped part."""

    value: Column | None = None


def has_value(p: Pattern) -> bool:
    """Does a match of ``p`` give a value (a map, a constant, ``completed(v)``)?"""
    if isinstance(p, Mapped):
        return True
    if isinstance(p, Empty):
        return p.value is not None
    if isinstance(p, Seq):
        return any(has_value(q) for q in p.parts)
    if isinstance(p, Alt):
        return any(has_value(q) for q in p.branches)
    return isinstance(p, (Rep, Named)) and has_value(p.body)


def value_column(p: Pattern, captures: dict, taken) -> Column:
    """The value of a match of ``p``.

    A sequence's value is that of its one part that has one, or a struct
    ``_1, _2, ...`` of several; an alternation's is that of the branch taken
    (``taken(node, branch)``, a Column), a repeated part's that of its last
    round, NULL without one.
    """
    if isinstance(p, Mapped):
        caps = Captures(captures)
        caps.value = value_column(p.body, captures, taken)
        return p.fn(caps)
    if isinstance(p, Named):
        return value_column(p.body, captures, taken)
    if isinstance(p, Empty):
        return F.lit(p.value)
    if isinstance(p, Seq):
        got = [value_column(q, captures, taken) for q in p.parts if has_value(q)]
        if len(got) > 1:
            return F.struct(*[v.alias(f"_{i}") for i, v in enumerate(got, 1)])
        return got[0] if got else F.lit(None)
    if isinstance(p, (Alt, Rep)) and has_value(p):
        parts = p.branches if isinstance(p, Alt) else (p.body,)
        out = next((value_column(q, captures, taken) for q in parts if not q.steps()), F.lit(None))
        for i in reversed(range(len(parts))):
            if parts[i].steps():
                out = F.when(taken(p, i), value_column(parts[i], captures, taken)).otherwise(out)
        return out
    return F.lit(None)


# -- constructors -----------------------------------------------------------

def step(name: str, predicate: Column, **project: Column) -> Step:
    """One event for which ``predicate`` holds (NULL counts as false).  Each
    ``project`` column is computed on that event and captured under its name,
    as ``captures[name][...]`` and as the column ``<name>_<...>`` (O2)."""
    return Step(name, predicate, project=tuple(project.items()))


def lit(column: str, value: Any, name: str | None = None) -> Step:
    """One event whose ``column`` equals ``value`` (null-safe)."""
    return Step(str(value) if name is None else name,
                F.col(column).eqNullSafe(F.lit(value)), column, value)


def completed(value: Any = None) -> Empty:
    return Empty(value)


def fail(message: str) -> Step:
    """A step that never matches; failures name ``message`` as expected."""
    return Step(message, None)


def seq(*parts: Pattern) -> Pattern:
    out: tuple[Pattern, ...] = ()
    for p in parts:
        out += _flat(p, Seq)
    return out[0] if len(out) == 1 else Seq(out)


def alt(*branches: Pattern) -> Pattern:
    out: tuple[Pattern, ...] = ()
    for p in branches:
        out += _flat(p, Alt)
    return out[0] if len(out) == 1 else Alt(out)
