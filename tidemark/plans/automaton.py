"""Compile a pattern into a small step table.

The pattern tree is turned into a position automaton (one position per
step occurrence; Glushkov's construction), and that into a deterministic
table over *symbols*.  A symbol is the bit set of the distinct predicates
an event satisfies, computed JVM-side as one integer column, so the table
is indexed by ``(state, symbol)``.

A table state records which positions are live and on how many paths
(capped at 2: one path is a match, two paths are an ambiguity).  The
matching rules are those of the cut matcher (SURVEY §3.4):

* after each event, if exactly one path can end here -> SUCCESS, restart;
* if no path is live any more                       -> FAILURE, restart,
  the event is spent (not retried as a first event);
* if two or more paths end here (ambiguity)         -> INCOMPLETE and go
  on with the live paths (``on_ambiguity='reference'``), or AMBIGUOUS and
  restart (``on_ambiguity='flag'``);
* otherwise                                          -> INCOMPLETE.

The empty sequence never matches on its own: completion is only asked
after an event has been taken.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.pattern import (
    Alt, Drop, Empty, Mapped, Named, Pattern, Rep, Seq, Step, has_value,
)

INCOMPLETE, SUCCESS, FAILURE, AMBIGUOUS = 0, 1, 2, 3
STATUS_NAMES = ("INCOMPLETE", "SUCCESS", "FAILURE", "AMBIGUOUS")
START = 0
#: Next steps of one state whose combinations are all walked (4,096 of them).
MAX_COMBINED = 12
#: Distinct predicates of a pattern: one bit each of a long.
MAX_PREDICATES = 63


@dataclass
class _Pos:
    name: str
    pred: int  # index into predicates, -1 = never matches
    branch: int  # top-level branch index
    keep: bool  # captures kept (False under Drop)
    project: tuple[str, ...] = ()  # names of the step's own columns
    took: int = 0  # flags of the choices an event here takes
    left: int = 0  # flags of the other branches of those choices


class StepTable:
    """Deterministic step table for one pattern; picklable, built lazily."""

    def __init__(self, pattern: Pattern, on_ambiguity: str = "reference"):
        if on_ambiguity not in ("reference", "flag"):
            raise ValueError("on_ambiguity must be 'reference' or 'flag'")
        self.on_ambiguity = on_ambiguity
        self.predicates: list[Column] = []
        self._pred_keys: dict[str, int] = {}
        self.positions: list[_Pos] = [_Pos("<start>", -1, -1, False)]
        self.follow: list[set[int]] = [set()]
        self.branch_names: list[str] = []

        #: (choice, branch) -> flag; kept for choices that decide a value
        self._flags: dict[tuple[int, int], int] = {}
        self._rounds: list[Rep] = []
        self._chosen: list[tuple[int, int]] = [(0, 0)]  # (took, left) around the part being built
        top = pattern
        while isinstance(top, (Mapped, Named)):
            top = top.body
        branches = top.branches if isinstance(top, Alt) else (pattern,)
        first: set[int] = set()
        last: set[int] = set()
        nullable = False
        for b, br in enumerate(branches):
            self.branch_names.append(_branch_name(br))
            choice = top if isinstance(top, Alt) and has_value(top) else None
            n, f, l = self._build_branch(choice, b, br, b, True)
            nullable |= n
            first |= f
            last |= l
        self.nullable = nullable
        self.follow[0] = first
        self.last = frozenset(last)
        self.top_is_alt = isinstance(top, Alt)
        # shift/pos masks: predicate bit of each position
        self._bit = [0] + [
            (1 << p.pred) if p.pred >= 0 else 0 for p in self.positions[1:]
        ]
        self.states: list[tuple[tuple[int, int], ...]] = [((0, 1),)]
        self._ids = {self.states[0]: 0}
        self._rows: list[dict[int, tuple[int, int, int, int]]] = [{}]
        self.labels: list[str | None] = [None]
        self._label_ids: dict[str | None, int] = {None: 0}
        self._expected: list[str | None] = [self._expected_of(self.states[0])]
        self._open: dict[tuple[int, int], int] = {}
        self._sources: dict[tuple[int, int], tuple] = {}
        self._open_sources: dict[tuple[int, int], tuple] = {}

    # -- construction -----------------------------------------------------
    def _pred(self, c: Column) -> int:
        key = str(c)
        if key not in self._pred_keys:
            if len(self.predicates) == MAX_PREDICATES:
                raise ValueError(f"a pattern has at most {MAX_PREDICATES} distinct predicates")
            self._pred_keys[key] = len(self.predicates)
            self.predicates.append(c)
        return self._pred_keys[key]

    def _new_pos(self, s: Step, branch: int, keep: bool) -> int:
        pred = -1 if s.predicate is None else self._pred(s.predicate)
        took, left = self._chosen[-1]
        self.positions.append(_Pos(s.name, pred, branch, keep, tuple(n for n, _ in s.project), took, left))
        self.follow.append(set())
        return len(self.positions) - 1

    def flag(self, choice: Pattern, i: int) -> int:
        """The bit that tells that branch ``i`` of a choice was taken."""
        k = (id(choice), i)
        if k not in self._flags:
            if len(self._flags) == MAX_PREDICATES:
                raise ValueError(f"at most {MAX_PREDICATES} branches may decide a value")
            self._flags[k] = 1 << len(self._flags)
        return self._flags[k]

    def _build_branch(self, choice: Pattern | None, i: int, p: Pattern, branch: int, keep: bool):
        """Build branch ``i`` of ``choice`` (None: it decides no value)."""
        if choice is None or not keep:
            return self._build(p, branch, keep)
        took, left = self._chosen[-1]
        n = len(choice.branches) if isinstance(choice, Alt) else 1
        others = sum(self.flag(choice, j) for j in range(n) if j != i)
        self._chosen.append((took | self.flag(choice, i), left | others))
        out = self._build(p, branch, keep)
        self._chosen.pop()
        return out

    def _build(self, p: Pattern, branch: int, keep: bool):
        """Return (nullable, first, last); fills ``self.follow``."""
        if isinstance(p, Step):
            i = self._new_pos(p, branch, keep)
            return False, {i}, {i}
        if isinstance(p, Empty):
            return True, set(), set()
        if isinstance(p, (Named, Mapped)):
            return self._build(p.body, branch, keep)
        if isinstance(p, Drop):
            return self._build(p.body, branch, False)
        if isinstance(p, Alt):
            n, f, l = False, set(), set()
            for i, q in enumerate(p.branches):
                qn, qf, ql = self._build_branch(p if has_value(p) else None, i, q, branch, keep)
                n, f, l = n or qn, f | qf, l | ql
            return n, f, l
        if isinstance(p, Seq):
            return self._sequence([(q, False) for q in p.parts], branch, keep)
        if isinstance(p, Rep) and has_value(p) and keep and not self._within(p):
            self._rounds.append(p)
            out = self._build_branch(p, 0, p, branch, keep)
            self._rounds.pop()
            return out
        if isinstance(p, Rep):
            # unfold: body{min} then (body?){max-min} or body*
            if p.max is None:
                star_n, star_f, star_l = self._build(p.body, branch, keep)
                for x in star_l:
                    self.follow[x] |= star_f
                n, f, l = self._sequence([(p.body, False)] * p.min, branch, keep)
                for x in l:
                    self.follow[x] |= star_f
                return n, (f | star_f) if n else f, l | star_l
            return self._sequence([(p.body, False)] * p.min + [(p.body, True)] * (p.max - p.min), branch, keep)
        raise TypeError(f"not a pattern: {p!r}")

    def _sequence(self, parts: list[tuple[Pattern, bool]], branch: int, keep: bool):
        """Parts one after another; those marked may be left out."""
        n, f, l = True, set(), set()
        for q, optional in parts:
            qn, qf, ql = self._build(q, branch, keep)
            qn = qn or optional
            for x in l:
                self.follow[x] |= qf
            f = f | qf if n else f
            l = (l | ql) if qn else ql
            n = n and qn
        return n, f, l

    def _within(self, p: Rep) -> bool:
        return bool(self._rounds) and self._rounds[-1] is p

    # -- symbols ----------------------------------------------------------
    def symbol_column(self) -> Column:
        """Bit set of satisfied predicates; NULL predicates count as false."""
        if not self.predicates:
            return F.lit(0).cast("long")
        bits = [
            F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))
            for i, c in enumerate(self.predicates)
        ]
        out = bits[0]
        for b in bits[1:]:
            out = out.bitwiseOR(b)
        # the narrowest integer that holds every bit: less to shuffle and ship
        k = len(self.predicates)
        return out.cast("byte" if k <= 7 else "short" if k <= 15 else "int" if k <= 31
                        else "long")

    # -- table ------------------------------------------------------------
    def _expected_of(self, st) -> str | None:
        names = sorted({self.positions[q].name for p, _ in st for q in self.follow[p]})
        return ",".join(names) if names else None

    def _label(self, name: str | None) -> int:
        if name not in self._label_ids:
            self._label_ids[name] = len(self.labels)
            self.labels.append(name)
        return self._label_ids[name]

    def _state_id(self, st) -> int:
        i = self._ids.get(st)
        if i is None:
            i = len(self.states)
            self._ids[st] = i
            self.states.append(st)
            self._rows.append({})
            self._expected.append(self._expected_of(st))
        return i

    def move(self, s: int, sym: int) -> tuple[int, int, int, int]:
        """(next state, status, branch of the match or -1, label id)."""
        row = self._rows[s]
        hit = row.get(sym)
        if hit is not None:
            return hit
        counts: dict[int, int] = {}
        for p, c in self.states[s]:
            for q in self.follow[p]:
                if sym & self._bit[q]:
                    counts[q] = min(2, counts.get(q, 0) + c)
        new = tuple(sorted(counts.items()))
        acc = [(q, c) for q, c in new if q in self.last]
        n_acc = min(2, sum(c for _, c in acc))
        names = sorted({self.positions[q].name for q, _ in new})
        label = self._label("|".join(names) if names else None)
        if not new:
            hit = (START, FAILURE, -1, 0)
        elif n_acc == 1:
            hit = (START, SUCCESS, self.positions[acc[0][0]].branch,
                   self._label(self.positions[acc[0][0]].name))
        elif n_acc >= 2 and self.on_ambiguity == "flag":
            hit = (START, AMBIGUOUS, -1, label)
        else:
            hit = (self._state_id(new), INCOMPLETE, -1, label)
        row[sym] = hit
        return hit

    def sources(self, s: int, sym: int) -> tuple[tuple[int, int], ...]:
        """Where paths come from: (position, index in ``states[s]`` of the path it
        goes on) of the one that ends the match, or of every live position of
        the next state in its order.  A match ends on one path, so each of its
        events has one source; which of two is named for another doesn't matter."""
        key = (s, sym)
        hit = self._sources.get(key)
        if hit is None:
            new: dict[int, int] = {}
            for i, (p, _) in enumerate(self.states[s]):
                for q in self.follow[p]:
                    if sym & self._bit[q]:
                        new.setdefault(q, i)
            if self.move(s, sym)[1] == SUCCESS:
                new = {q: i for q, i in new.items() if q in self.last}
            hit = self._sources[key] = tuple(sorted(new.items()))
        return hit

    def advance(self, s: int, sym: int) -> int:
        """Whole-input step without restart: next state, or -1 when dead."""
        key = (s, sym)
        hit = self._open.get(key)
        if hit is not None:
            return hit
        counts: dict[int, int] = {}
        for p, c in self.states[s]:
            for q in self.follow[p]:
                if sym & self._bit[q]:
                    counts[q] = min(2, counts.get(q, 0) + c)
        new = tuple(sorted(counts.items()))
        hit = self._state_id(new) if new else -1
        self._open[key] = hit
        return hit

    def open_sources(self, s: int, sym: int) -> tuple[tuple[int, int], ...]:
        """As ``sources`` for ``advance``: where each live position of the next state
        comes from, in the state's order."""
        key = (s, sym)
        hit = self._open_sources.get(key)
        if hit is None:
            new: dict[int, int] = {}
            for i, (p, _) in enumerate(self.states[s]):
                for q in self.follow[p]:
                    if sym & self._bit[q]:
                        new.setdefault(q, i)
            hit = self._open_sources[key] = tuple(sorted(new.items()))
        return hit

    def accepting_index(self, s: int) -> int:
        """Index in ``states[s]`` of the path that ends there; -1 for none."""
        return next((i for i, (q, _) in enumerate(self.states[s]) if q in self.last), -1)

    def _complete(self, step: Callable[[int, int], object], present: Callable[[], list[int]]) -> int:
        """Number every state that ``step`` reaches, before the table is shipped.

        Where a state leads depends only on the predicates of the steps that may
        come next, so its combinations of those stand for all symbols; only
        a state with very many is walked by the symbols ``present`` in the data.
        """
        syms = None
        i = 0
        while i < len(self.states):
            bits = sorted({self._bit[q] for p, _ in self.states[i] for q in self.follow[p]} - {0})
            if len(bits) <= MAX_COMBINED:
                for r in range(1 << len(bits)):
                    step(i, sum(b for k, b in enumerate(bits) if r >> k & 1))
            else:
                syms = present() if syms is None else syms
                for y in syms:
                    step(i, y)
            i += 1
        return len(self.states)

    def complete_open(self, present: Callable[[], list[int]]) -> int:
        """Number every state reachable by ``advance`` (no restarts)."""
        return self._complete(self.advance, present)

    def complete_all(self, present: Callable[[], list[int]]) -> int:
        """Number every state reachable by ``move``."""
        return self._complete(self.move, present)

    def state_key(self, s: int) -> str:
        """Process-independent name of a state (ids are built lazily per
        process, so only this form may be stored outside one process)."""
        return ",".join(f"{p}:{c}" for p, c in self.states[s])

    def state_from_key(self, key: str) -> int:
        st = tuple(tuple(int(x) for x in pc.split(":")) for pc in key.split(","))
        return self._state_id(st)

    def accepting_paths(self, s: int) -> int:
        """Paths that can end in state ``s`` (0, 1 or 2 = ambiguous)."""
        if s == START:
            return 1 if self.nullable else 0
        return min(2, sum(c for q, c in self.states[s] if q in self.last))

    def __getstate__(self):
        # Columns hold JVM handles; executors only need the table.
        d = dict(self.__dict__)
        d["predicates"] = None
        d["_pred_keys"] = None
        return d

    def expected(self, s: int) -> str | None:
        return self._expected[s]

    def first_mask(self) -> int:
        m = 0
        for q in self.follow[0]:
            m |= self._bit[q]
        return m

    def symbols_in(self, df) -> list[int]:
        """The symbols in ``df``'s ``_sym`` column: one distinct aggregate, one row
        per combination of predicates that holds together."""
        return sorted(int(r[0]) for r in df.select("_sym").distinct().collect())


def _branch_name(p: Pattern) -> str:
    while isinstance(p, Mapped):
        p = p.body
    if isinstance(p, Named):
        return p.branch
    return " ".join(s.name for s in p.steps())
