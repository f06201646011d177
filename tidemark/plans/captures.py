"""Captured values along the paths of an open attempt.

Steps may share events (``A B | A C`` over ``A``), so what a step captured is
known only when one path ends the match.  Every live path of the table state
has its own registers; an event hands a path's registers on to the paths
that continue it.  Their number is that of live positions, a few, and their
size doesn't grow with the attempt.

Inside a block of a hot key the registers that a walk began with aren't
known: those of a path are the changes since, and the path of the start
state that they are changes to (``joined``).
"""

from __future__ import annotations

import pickle
from typing import Any, NamedTuple

from tidemark.plans.automaton import StepTable


class Capture(NamedTuple):
    """One output column: the column number captured at some positions."""

    name: str
    index: int
    positions: frozenset[int]


class Registers(NamedTuple):
    values: dict[int, Any]  # capture number -> value
    flags: int  # branches taken
    source: int = -1  # path of the block's start state, -1 for none
    kept: int = 0  # flags of ``source`` that hold on


NONE = [Registers({}, 0)]


def dumped(paths: list[Registers]) -> bytes:
    """Registers as plain tuples: the library may itself be shipped by value, and
    then its classes aren't the same in two processes."""
    return pickle.dumps([tuple(r) for r in paths])


def loaded(data: bytes) -> list[Registers]:
    return [Registers(*r) for r in pickle.loads(data)]


class Tracker:
    """Hands registers from event to event."""

    def __init__(self, table: StepTable, captures: list[Capture]):
        self.table = table
        self.at: dict[int, list[tuple[int, int]]] = {}
        for j, c in enumerate(captures):
            for q in c.positions:
                self.at.setdefault(q, []).append((j, c.index))
        self.n = len(captures)
        #: nothing to track: callers skip the work
        self.on = bool(captures) or any(p.took for p in table.positions)

    def step(self, state: int, sym: int, paths: list[Registers], columns: list, i: int,
             restart: bool = True) -> list[Registers]:
        """Registers after event ``i``; of the match alone if it ends here.  Without
        ``restart`` nothing ends before the input does."""
        out = []
        for q, src in (self.table.sources if restart else self.table.open_sources)(state, sym):
            old = paths[src]
            got = self.at.get(q)
            values = old.values
            if got:
                values = {**values, **{j: columns[c][i] for j, c in got}}
            pos = self.table.positions[q]
            out.append(Registers(values, old.flags & ~pos.left | pos.took, old.source, old.kept & ~pos.left))
        return out


def unknown(table: StepTable, state: int) -> list[Registers]:
    """Registers of a walk that begins in ``state``: changes to those of its paths."""
    return [Registers({}, 0, i, -1) for i in range(len(table.states[state]))]


def joined(before: list[Registers], changes: list[Registers]) -> list[Registers]:
    """Registers after a block, from those before it and the block's changes."""
    return [c if c.source < 0 else Registers({**before[c.source].values, **c.values},
                                             before[c.source].flags & c.kept | c.flags) for c in changes]
