"""Matches from every start event, in one pass against time.

Two attempts in the same table state have the same future, so what becomes of
an attempt is a function of its state and place.  Walking a key from its last
event to its first, each event maps the table's states to states after it, to
a match that ends here, or to nothing; composed with what is known of the
events after it, that tells for every state, hence for the start state of every
event, which event ends the match.  Nothing but one entry per table state is
carried from event to event, however many attempts are open.

Within an Arrow batch the maps are composed by pointer doubling over numpy
arrays, in as many rounds as the binary logarithm of the longest attempt.

Hot keys are cut into ordered blocks.  Pass 1 gives the map of every block, a
fold from the last block back gives each block what follows it, and pass 2
resolves the block's own starts.  Questions with one answer per key need only
pass 1 and the fold.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.automaton import INCOMPLETE, START, SUCCESS, StepTable
from tidemark.plans.frames import apply_frames, map_frames, records
from tidemark.plans.skew import HotKeys, broadcast_blocks

NONE, MATCH, STATE = 0, 1, 2
#: Cells (rows times states) resolved at once.
_CELLS = 1 << 20


class Outcome:
    """What becomes of an attempt in each state: nothing, a match that ends with
    the event ``end`` (a tuple), or the state ``ref`` where the block ends;
    ``n`` counts the events taken on the way."""

    __slots__ = ("kind", "n", "end", "ref")

    def __init__(self, kind, n, end, ref):
        self.kind, self.n, self.end, self.ref = kind, n, end, ref

    @classmethod
    def nothing(cls, states: int) -> Outcome:
        return cls(np.zeros(states, np.int8), np.zeros(states, np.int64), [None] * states, np.zeros(states, np.int64))

    @classmethod
    def open(cls, states: int) -> Outcome:
        return cls(np.full(states, STATE, np.int8), np.zeros(states, np.int64), [None] * states, np.arange(states))

    def plain(self) -> tuple:
        return self.kind.tolist(), self.n.tolist(), list(self.end), self.ref.tolist()

    @classmethod
    def of(cls, t: tuple) -> Outcome:
        return cls(np.array(t[0], np.int8), np.array(t[1], np.int64), list(t[2]), np.array(t[3], np.int64))

    def then(self, later: Outcome) -> Outcome:
        """This block's outcomes, its open states continued by ``later``."""
        out = Outcome(self.kind.copy(), self.n.copy(), list(self.end), self.ref.copy())
        for s in np.flatnonzero(self.kind == STATE).tolist():
            q = int(self.ref[s])
            out.kind[s], out.end[s], out.ref[s] = later.kind[q], later.end[q], later.ref[q]
            out.n[s] = self.n[s] + later.n[q]
        return out


class _Resolved:
    """Outcomes of every (row, state) of a batch in reverse order of time."""

    def __init__(self, table: StepTable, sym: np.ndarray, edge: np.ndarray, cut: np.ndarray, bounds: dict[int, Outcome], ends):
        # ``edge``: rows with no event after them in the batch (what follows is in ``bounds``,
        # or nothing); ``cut``: rows whose next event comes too late
        n, states = len(sym), len(table.states)
        syms, at = np.unique(sym, return_inverse=True)
        moves = np.array([[table.move(s, int(y))[:2] for s in range(states)] for y in syms.tolist()], np.int64).reshape(-1, states, 2)
        nxt, code = moves[at, :, 0], moves[at, :, 1]
        node = np.arange(n * states).reshape(n, states)
        after = (np.arange(n) - 1)[:, None] * states + nxt
        stop = (code != INCOMPLETE) | edge[:, None] | cut[:, None]
        ptr = np.where(stop, node, after).reshape(-1)
        while True:
            far = ptr[ptr]
            if np.array_equal(far, ptr):
                break
            ptr = far
        self.states, self.ptr, self.bounds, self.ends = states, ptr, bounds, ends
        self.nxt, self.code, self.cut = nxt, code, cut
        place = np.full(n, -1)
        for i, r in enumerate(bounds):
            place[r] = i
        self.place = place
        size = len(bounds)
        self.b_kind = np.array([b.kind for b in bounds.values()], np.int8).reshape(size, states)
        self.b_n = np.array([b.n for b in bounds.values()], np.int64).reshape(size, states)
        self.b_ref = np.array([b.ref for b in bounds.values()], np.int64).reshape(size, states)
        self.b_list = list(bounds.values())

    def of(self, rows: np.ndarray, state: int):
        """(kind, n, row of the end or -1, place of the bound, its state, ref)."""
        last = self.ptr[rows * self.states + state]
        r, s = last // self.states, last % self.states
        q = self.nxt[r, s]
        hit = self.code[r, s] == SUCCESS
        through = (self.code[r, s] == INCOMPLETE) & (self.place[r] >= 0) & ~self.cut[r]
        place = np.where(through, self.place[r], -1)
        safe = np.maximum(place, 0)
        if len(self.b_list):
            kind = np.where(hit, MATCH, np.where(through, self.b_kind[safe, q], NONE))
            more = np.where(through, self.b_n[safe, q], 0)
            ref = np.where(through, self.b_ref[safe, q], 0)
        else:
            kind, more, ref = np.where(hit, MATCH, NONE), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        return kind, rows - r + 1 + more, np.where(hit, r, -1), place, q, ref

    def end_of(self, end_row: int, place: int, q: int):
        return self.ends(end_row) if end_row >= 0 else self.b_list[place].end[q]

    def outcome(self, row: int) -> Outcome:
        out = Outcome.nothing(self.states)
        rows = np.array([row])
        for s in range(self.states):
            kind, n, end_row, place, q, ref = (x[0] for x in self.of(rows, s))
            out.kind[s], out.n[s], out.ref[s] = kind, n, ref
            if kind == MATCH:
                out.end[s] = self.end_of(int(end_row), int(place), int(q))
        return out


def _kernel(tables: list[StepTable], keys: list[str], gkeys: list[str], orders: list[str], keep: list[str], mode: str,
            max_gap: int | None, names: list[str], first_only: bool):
    """``mode``: 'starts' (a row per start with a match), 'groups' (a row per key),
    'blocks' (a row per block: its outcomes)."""
    from tidemark.operators.matcher import _group_starts, _norm

    masks = [t.first_mask() for t in tables]
    shown = orders + keep
    many = len(tables)

    def kernel(it):
        gkey = None
        carry: list[Outcome] = []  # outcomes from the first event met of the group on
        first = [(NONE, 0)] * many  # what becomes of an attempt that starts there
        found = [False] * many
        open_: list[set] = [set() for _ in range(many)]
        t_end = t_start = None  # times of the last and the first event met of the group

        def group_row():
            if mode == "blocks":
                return gkey + (pickle.dumps(([c.plain() for c in carry], found, [sorted(o) for o in open_], t_end, t_start)),)
            hits = [k == MATCH for k, _ in first]
            return gkey + tuple(hits if first_only else found) + tuple(n if h else None for h, (_, n) in zip(hits, first))

        for whole in it:
            step = max(1, _CELLS // max(len(t.states) for t in tables))
            for lo in range(0, len(whole), step):
                pdf = whole.iloc[lo:lo + step]
                n = len(pdf)
                newk, gcols = _group_starts(pdf, gkeys, gkey)
                edge = newk.copy()
                edge[0] = True
                cut = np.zeros(n, bool)
                tt = pdf["_t"].tolist() if max_gap is not None else None
                if tt is not None:
                    for r, (a, b) in enumerate(zip(tt, [t_start, *tt[:-1]])):
                        cut[r] = not newk[r] and a is not None and b is not None and b - a > max_gap
                marks = pdf["_m_next"].tolist() if "_m_next" in pdf.columns else None
                cols = [pdf[c].to_numpy(dtype=object) for c in shown]

                def ends(r, cols=cols):
                    return tuple(_norm(c[r]) for c in cols)

                cuts = [0, *(np.flatnonzero(newk[1:]) + 1).tolist(), n]
                last = np.array(cuts[1:]) - 1
                per_table = []
                for j, t in enumerate(tables):
                    size = len(t.states)
                    bounds = {}
                    for r in np.flatnonzero(edge).tolist():
                        if not newk[r]:
                            bounds[r] = carry[j]
                        elif mode == "blocks":
                            bounds[r] = Outcome.open(size)
                        elif marks is not None and marks[r] is not None:
                            bounds[r] = Outcome.of(pickle.loads(marks[r]))
                    sym = pdf[f"_sym{j}"].to_numpy().astype(np.int64)
                    res = _Resolved(t, sym, edge, cut, bounds, ends)
                    may = np.flatnonzero(sym & masks[j])
                    if mode == "starts":
                        out = _starts(res, may, pdf, keys, orders, keep, cols)
                        if out is not None:
                            yield out
                        per_table.append((res, may, None, None, None, None))
                    else:
                        kind, _, _, _, _, ref = res.of(may, START)
                        k1, n1 = res.of(last, START)[:2]
                        per_table.append((res, may, kind, ref, k1.tolist(), n1.tolist()))
                rows = []
                for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if newk[a]:
                        if gkey is not None and mode != "starts":
                            rows.append(group_row())
                        gkey = tuple(_norm(c[a]) for c in gcols)
                        found, open_ = [False] * many, [set() for _ in range(many)]
                        t_end = None if tt is None else tt[a]
                    if mode != "starts":
                        first = [(p[4][g], p[5][g]) for p in per_table]
                        for j, (_, may, kind, ref, _, _) in enumerate(per_table):
                            x, y = np.searchsorted(may, (a, b))
                            if y > x:
                                found[j] = found[j] or bool((kind[x:y] == MATCH).any())
                                if mode == "blocks":
                                    open_[j].update(ref[x:y][kind[x:y] == STATE].tolist())
                    if b == n or mode == "blocks":
                        carry = [p[0].outcome(b - 1) for p in per_table]
                    t_start = None if tt is None else tt[b - 1]
                if rows:
                    yield records(rows, names)
        if gkey is not None and mode != "starts":
            yield records([group_row()], names)

    return kernel


def _starts(res: _Resolved, may: np.ndarray, pdf: pd.DataFrame, keys, orders, keep, cols) -> pd.DataFrame | None:
    """A row for each of the rows ``may`` that starts a match."""
    kind, n, end_row, place, q, _ = res.of(may, START)
    ok = kind == MATCH
    if not ok.any():
        return None
    rows, n, end_row, place, q = may[ok], n[ok], end_row[ok], place[ok], q[ok]
    out: dict[str, Any] = {k: pdf[k].to_numpy(dtype=object)[rows] for k in keys}
    beyond = np.flatnonzero(end_row < 0)
    tail = [res.b_list[int(place[i])].end[int(q[i])] for i in beyond]
    ends = []
    for j, c in enumerate(cols):
        v = c[np.maximum(end_row, 0)]
        for i, e in zip(beyond.tolist(), tail):
            v[i] = e[j]
        ends.append(v)
    for j, c in enumerate(orders + keep):
        out[f"start_{c}"] = cols[j][rows]
    for j, c in enumerate(orders + keep):
        out[f"end_{c}"] = ends[j]
    out["n_events"] = n
    return pd.DataFrame(out)


def _fold(tables_n: int, keys: list[str], max_gap: int | None, names: list[str], first_only: bool, answers: bool, forward: bool = True):
    """Per key, from the last block back: what follows each block, or the answer."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", ascending=not forward, kind="stable")
        key = tuple(pdf[k].iloc[0] for k in keys)
        after: list[Outcome] | None = None
        found = [False] * tables_n
        t_next = None
        rows = []
        for blk, data in zip(pdf["_blk"].tolist(), pdf["out"].tolist()):
            outs, hit, open_, t_end, t_start = pickle.loads(data)
            outs = [Outcome.of(o) for o in outs]
            late = max_gap is not None and t_next is not None and t_end is not None and t_next - t_end > max_gap
            if after is None or late:
                after = [Outcome.nothing(len(o.kind)) for o in outs]
            if not answers:
                rows.append(key + (int(blk), pickle.dumps(after[0].plain())))
            for j in range(tables_n):
                found[j] = found[j] or hit[j] or any(after[j].kind[q] == MATCH for q in open_[j])
            after = [o.then(a) for o, a in zip(outs, after)]
            t_next = t_start
        if answers:
            hits = [bool(c.kind[START] == MATCH) for c in after] if first_only else found
            rows = [key + tuple(hits) + tuple(int(c.n[START]) if c.kind[START] == MATCH else None for c in after)]
        return records(rows, names)

    return fn


def _source(df: DataFrame, tables: list[StepTable], keys, orders, keep, time: Column | None) -> DataFrame:
    cols = [F.col(f"`{c}`") for c in dict.fromkeys([*keys, *orders, *keep])]
    cols += [t.symbol_column().alias(f"_sym{j}") for j, t in enumerate(tables)]
    if time is not None:
        cols.append(time.alias("_t"))
    return df.select(*cols)


def _against(orders: list[str], forward: bool) -> list[Column]:
    """The order the kernel walks in: against that of the attempts."""
    return [F.col(f"`{o}`").desc_nulls_last() if forward else F.col(f"`{o}`").asc_nulls_first() for o in orders]


def _sorted(df: DataFrame, group: list[str], orders: list[str], forward: bool = True) -> DataFrame:
    part = df.repartition(*group) if group else df.repartition(1)
    return part.sortWithinPartitions(*[f"`{g}`" for g in group], *_against(orders, forward))


def _complete(tables: list[StepTable], src: DataFrame) -> None:
    for j, t in enumerate(tables):
        t.complete_all(lambda j=j, t=t: t.symbols_in(src.withColumnRenamed(f"_sym{j}", "_sym")))


def _blocks(tables, hot, src_schema, keys, orders, keep, max_gap, forward=True):
    """(blocked rows as the kernel walks them, outcome of every block)."""
    hot = hot.withColumnRenamed("_sk_blk", "_blk")
    part = _sorted(hot, [*keys, "_blk"], orders, forward)
    schema = T.StructType([src_schema[k] for k in keys] + [T.StructField("_blk", T.LongType()), T.StructField("out", T.BinaryType())])
    return part, map_frames(part, _kernel(tables, keys, [*keys, "_blk"], orders, keep, "blocks", max_gap, schema.names, False), schema)


def starts(df: DataFrame, table: StepTable, keys: list[str], orders: list[str], keep: Sequence[str] = (),
           time: Column | None = None, max_gap: int | None = None, strategy: str = "auto") -> DataFrame:
    """Key columns, start_<c> and end_<c> for each order and ``keep`` column, n_events:
    one row for every event that starts a match."""
    keep = [c for c in dict.fromkeys(keep) if c not in orders]
    src = _source(df, [table], keys, orders, keep, time)
    _complete([table], src)
    fields = [src.schema[k] for k in keys]
    for pre in ("start_", "end_"):
        fields += [T.StructField(pre + c, src.schema[c].dataType) for c in [*orders, *keep]]
    schema = T.StructType([*fields, T.StructField("n_events", T.LongType())])

    def plain(d: DataFrame) -> DataFrame:
        return map_frames(_sorted(d, keys, orders), _kernel([table], keys, keys, orders, keep, "starts", max_gap, schema.names, False), schema)

    hk = None if strategy == "plain" else HotKeys(df, keys, orders, force=strategy == "block")
    if not hk:
        return plain(src)
    cold, hot = hk.split(src)
    part, outcomes = _blocks([table], hot, src.schema, keys, orders, keep, max_gap)
    marks = T.StructType([src.schema[k] for k in keys] + [T.StructField("_blk", T.LongType()), T.StructField("_m_next", T.BinaryType())])
    group = keys if keys else [F.lit(0).alias("_all")]
    after = apply_frames(outcomes.groupBy(*group), _fold(1, keys, max_gap, marks.names, False, False), marks)
    after = broadcast_blocks(after, hk.n_blocks)
    same = [part[c].eqNullSafe(after[c]) for c in [*keys, "_blk"]]
    walked = part.join(after, same, "inner").select(*[part[c] for c in part.columns], after["_m_next"])
    walked = walked.sortWithinPartitions(*keys, "_blk", *_against(orders, True))
    out = map_frames(walked, _kernel([table], keys, [*keys, "_blk"], orders, keep, "starts", max_gap, schema.names, False), schema)
    return plain(cold).unionByName(out) if keys else out


def answers(df: DataFrame, tables: list[StepTable], keys: list[str], orders: list[str], *, first_only: bool,
            forward: bool = True, time: Column | None = None, max_gap: int | None = None, strategy: str = "auto") -> DataFrame:
    """Key columns, hit0.. (does each pattern match from the key's first event, or with
    ``first_only=False`` from any), n0.. (events of the match from the first): one row a key.
    ``forward=False`` reads the events backwards, the last one first."""
    src = _source(df, tables, keys, orders, (), time)
    _complete(tables, src)
    k = len(tables)
    schema = T.StructType([src.schema[c] for c in keys] + [T.StructField(f"hit{j}", T.BooleanType()) for j in range(k)]
                          + [T.StructField(f"n{j}", T.LongType()) for j in range(k)])

    def plain(d: DataFrame) -> DataFrame:
        return map_frames(_sorted(d, keys, orders, forward), _kernel(tables, keys, keys, orders, [], "groups", max_gap, schema.names, first_only), schema)

    hk = None if strategy == "plain" else HotKeys(df, keys, orders, force=strategy == "block")
    if not hk:
        return plain(src)
    cold, hot = hk.split(src)
    _, outcomes = _blocks(tables, hot, src.schema, keys, orders, [], max_gap, forward)
    group = keys if keys else [F.lit(0).alias("_all")]
    out = apply_frames(outcomes.groupBy(*group), _fold(k, keys, max_gap, schema.names, first_only, True, forward), schema)
    return plain(cold).unionByName(out) if keys else out
