"""The step table walked over a batch of events with numpy.

An event that takes every state of the table to one state (most events that
fail, whatever was open) tells the state after it, whatever came before.  Such
events, first events of a key and events after a timeout cut a batch into
segments whose first state is known, and all segments are walked side by side,
one array step for the j-th event of each.  Segments longer than most are
finished one by one.
"""

from __future__ import annotations

import numpy as np

from tidemark.plans.automaton import START, StepTable

#: Entries (states times symbols of a batch) of a table that is looked up whole.
_ENTRIES = 1 << 16
#: Segments walked side by side at least.
_ABREAST = 8


class Walked:
    """``before``: the state each event meets; ``code``, ``branch`` and ``label`` of each step;
    ``after``: the state after the last event."""

    __slots__ = ("before", "code", "branch", "label", "after")

    def __init__(self, before, code, branch, label, after):
        self.before, self.code, self.branch, self.label, self.after = before, code, branch, label, after


def _table(table: StepTable, syms: list[int]) -> np.ndarray | None:
    """(state, symbol, [next, status, branch, label]) of all states the symbols reach."""
    rows, s = [], 0
    while s < len(table.states):
        if len(table.states) * len(syms) > _ENTRIES:
            return None
        rows.append([table.move(s, y) for y in syms])
        s += 1
    return np.array(rows, np.int64).reshape(len(rows), len(syms), 4)


def walk(table: StepTable, sym: np.ndarray, known: np.ndarray, first: np.ndarray) -> Walked:
    """Walk events with symbols ``sym``; where ``known`` (the first event at least) the
    state an event meets is that in ``first``."""
    syms, at = np.unique(sym, return_inverse=True)
    moves = _table(table, syms.tolist())
    if moves is None:
        return _one_by_one(table, sym, known, first)
    n, nxt = len(sym), moves[:, :, 0]
    constant = (nxt == nxt[0]).all(0)
    known, first = known.copy(), first.copy()
    told = constant[at[:-1]] & ~known[1:]
    known[1:] |= told
    first[1:][told] = nxt[0][at[:-1]][told]
    start = np.flatnonzero(known)
    length = np.diff(np.append(start, n))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    before = np.empty(n, np.int64)
    state = first[start]
    j, live = 0, len(start)
    while live >= _ABREAST:
        rows = start[:live] + j
        before[rows] = state
        state = nxt[state, at[rows]]
        j += 1
        live = int(np.searchsorted(-length, -j, side="left"))  # segments longer than j
        state = state[:live]
    step, seen = nxt.tolist(), at.tolist() if live else []
    for k in range(live):
        s = int(state[k])
        for r in range(int(start[k]) + j, int(start[k] + length[k])):
            before[r] = s
            s = step[s][seen[r]]
    took = moves[before, at]
    return Walked(before, took[:, 1], took[:, 2], took[:, 3], int(took[-1, 0]))


def _one_by_one(table: StepTable, sym: np.ndarray, known: np.ndarray, first: np.ndarray) -> Walked:
    before, took, s = [], [], START
    for y, k, f in zip(sym.tolist(), known.tolist(), first.tolist()):
        s = f if k else s
        before.append(s)
        took.append(table.move(s, y))
        s = took[-1][0]
    t = np.array(took, np.int64)
    return Walked(np.array(before, np.int64), t[:, 1], t[:, 2], t[:, 3], s)


def late(times: list, last, newk: np.ndarray, timeout: int) -> np.ndarray:
    """Events that come more than ``timeout`` after the one before, both with a time."""
    out = np.zeros(len(times), bool)
    for i, (t, p) in enumerate(zip(times, [last, *times[:-1]])):
        out[i] = not newk[i] and t is not None and p is not None and t - p > timeout
    return out
