"""Hot-key plan for nested depth (O21): a block scan for a counter.

The nesting walk keeps a counter, so it has no finite table to summarise a
block with.  What an open attempt does on entering a block depends only on
the block's leading runs, though:

* on the way down with depth ``d``: the leading closing events (``c0`` of
  them) either bring it to 0 (a match) or an event that is not a closing
  one ends it (a failure), or the block ends first;
* on the way up: ``u`` leading opening events, then ``c`` closing events;
  the match needs ``d + u`` of them.

After the attempt ends, the walk is a walk from the start state beginning
at one of six rows of the block (a start-state walk that begins inside a
run of closing events is the same as one beginning after that run, as each
such event is spent at once).  Pass 1 walks every block once, for all six
beginnings at the same time (walks that meet in the start state merge),
and keeps the run lengths; a per-key fold over these block summaries gives
every block its incoming walk state; pass 2 re-walks each block from it and
emits the matches.  No event of a hot key is ever held in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.frames import apply_frames, map_frames, records
from tidemark.plans.skew import broadcast_blocks

OPEN, CLOSE = 1, 2


class _Walk:
    __slots__ = ("phase", "d", "peak", "steps", "matches", "attempts", "start")

    def __init__(self):
        self.phase = self.d = self.peak = self.steps = self.matches = self.attempts = 0
        self.start: tuple = ()

    def step(self, s: int, row) -> None:
        if self.phase == 0:
            self.attempts += 1
            if s == OPEN:
                self.phase, self.d, self.peak, self.steps = 1, 1, 1, 1
                self.start = row()
            return
        self.steps += 1
        if s == OPEN and self.phase == 1:
            self.d += 1
            self.peak = self.d
        elif s == CLOSE:
            self.d -= 1
            self.phase = 2
            if self.d == 0:
                self.matches += 1
                self.phase = 0
        else:
            self.phase = 0


def summary_kernel(keys, orders):
    """Per (key, block): run lengths and, for each walk beginning ``p``,
    the walk's end state and number of matches."""
    from tidemark.operators.sequential import _keyed_rows
    from tidemark.operators.matcher import _norm

    gkeys = keys + ["_sk_blk"]
    no = len(orders)
    names = list(gkeys) + ["p", "n_rows", "c0", "u", "u1sym", "c", "end_phase", "end_d",
                           "end_peak", "end_steps", "n_match", "n_att"] + [f"s{j}" for j in range(no)]

    def kernel(it):
        g = None
        for flags, kv, vals, n in _keyed_rows(it, gkeys, orders + ["_sym"]):
            ov, sy = vals[:-1], vals[-1]
            out = []
            for i in range(n):
                if flags[i]:
                    if g is not None:
                        out.extend(g.finish())
                    g = _Group(tuple(_norm(c[i]) for c in kv), no)
                g.row(sy[i], lambda i=i: tuple(c[i] for c in ov))
            if out:
                yield records(out, columns=names)
        if g is not None:
            yield records(g.finish(), columns=names)

    return kernel


class _Group:
    """Streaming summary of one block."""

    def __init__(self, gkey: tuple, no: int):
        self.gkey, self.no = gkey, no
        self.r = 0
        self.c0, self.c0_open = 0, True
        self.u, self.u_open, self.u1sym = 0, True, -1
        self.c, self.c_open = 0, False
        self.walks: list[_Walk] = []
        self.alias: dict[int, tuple[_Walk, int, int]] = {}  # beginning -> (walk, offsets of matches and attempts)
        self.sched: dict[int, list[int]] = {}  # row -> beginnings activated there

    def _activate(self, p: int) -> None:
        if p in self.alias:
            return
        rep = next((w for w in self.walks if w.phase == 0), None)
        if rep is None:
            rep = _Walk()
            self.walks.append(rep)
        self.alias[p] = (rep, -rep.matches, -rep.attempts)

    def row(self, s: int, row) -> None:
        self.r += 1
        r = self.r
        if r == 1:
            self._activate(1)
        if self.c0_open:
            if s == CLOSE:
                self.c0 += 1
            else:
                self.c0_open = False
                self._activate(r)  # c0 + 1
                self.sched.setdefault(r + 1, []).append(r + 1)  # c0 + 2
        if self.u_open:
            if s == OPEN:
                self.u += 1
            else:
                self.u_open = False
                self.u1sym = s
                self.sched.setdefault(r + 1, []).append(r + 1)  # u + 2
                if s == CLOSE:
                    self.c, self.c_open = 1, True
        elif self.c_open:
            if s == CLOSE:
                self.c += 1
            else:
                self.c_open = False
                self._activate(r)  # u + c + 1
                self.sched.setdefault(r + 1, []).append(r + 1)  # u + c + 2
        for p in self.sched.pop(r, ()):
            self._activate(p)
        # walks that meet in the start state go on as one
        starts = [w for w in self.walks if w.phase == 0]
        if len(starts) > 1:
            head = starts[0]
            for w in starts[1:]:
                for p, (t, off, more) in list(self.alias.items()):
                    if t is w:
                        self.alias[p] = (head, off + w.matches - head.matches, more + w.attempts - head.attempts)
                self.walks.remove(w)
        for w in self.walks:
            w.step(s, row)

    def finish(self) -> list[tuple]:
        runs = (self.r, self.c0, self.u, self.u1sym, self.c)
        out = []
        for p, (w, off, more) in sorted(self.alias.items()):
            start = w.start if w.phase != 0 else (None,) * self.no
            out.append(self.gkey + (p,) + runs
                       + (w.phase, w.d, w.peak, w.steps, w.matches + off, w.attempts + more) + tuple(start))
        return out


def compose(keys, no: int):
    """Per key, in block order: each block's incoming walk state; after the last
    block, as block -1, the state at the end of the key."""
    names = list(keys) + ["_sk_blk", "_m_phase", "_m_d", "_m_peak", "_m_steps", "_m_match", "_m_att"] \
        + [f"_m_s{j}" for j in range(no)]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        from tidemark.operators.matcher import _norm

        key = tuple(_norm(pdf[k].iloc[0]) for k in keys)
        phase = d = peak = steps = match = att = 0
        start: tuple = (None,) * no
        out = []
        for b, g in pdf.groupby("_sk_blk", sort=True):
            first = g.iloc[0]
            L, c0, u, u1, c = (int(first[x]) for x in ("n_rows", "c0", "u", "u1sym", "c"))
            walks = {int(r["p"]): r for _, r in g.iterrows()}
            out.append(key + (int(b), phase, d, peak, steps, match, att) + tuple(start))
            p = None  # beginning of the start-state walk after the open attempt
            if phase == 0:
                p = 1
            elif phase == 2:  # down, depth d
                if d <= c0:
                    # closing events left over are attempts of their own that fail
                    match, att, p = match + 1, att + c0 - d, c0 + 1
                elif c0 < L:
                    p = c0 + 2
                else:
                    d, steps = d - L, steps + L
            else:  # up, depth d
                if u == L:
                    d, peak, steps = d + L, d + L, steps + L
                elif u1 != CLOSE:
                    p = u + 2
                else:
                    top = d + u
                    if c >= top:
                        match, att, p = match + 1, att + c - top, u + c + 1
                    elif u + c < L:
                        p = u + c + 2
                    else:
                        phase, d, peak, steps = 2, top - c, top, steps + L
            if p is None:
                continue
            w = walks.get(p) if p <= L else None
            if w is None:  # the walk begins after the block: nothing happens
                phase, d, peak, steps, start = 0, 0, 0, 0, (None,) * no
                continue
            match += int(w["n_match"])
            att += int(w["n_att"])
            phase, d, peak, steps = (int(w["end_phase"]), int(w["end_d"]),
                                     int(w["end_peak"]), int(w["end_steps"]))
            start = tuple(_norm(w[f"s{j}"]) for j in range(no)) if phase else (None,) * no
        out.append(key + (-1, phase, d, peak, steps, match, att) + tuple(start))
        return records(out, columns=names)

    return fn


def scan(src: DataFrame, hot: DataFrame, keys, orders, n_blocks: int, extra=()) -> tuple[DataFrame, DataFrame]:
    """(hot rows, sorted by block, with the walk state their block begins in as ``_m_*``;
    the state of every hot key at its end).  ``hot`` carries ``_sk_blk``; ``extra``
    columns ride along."""
    no = len(orders)
    part = keys + ["_sk_blk"]
    blocks = hot.select(*keys, *orders, "_sym", *extra, "_sk_blk").repartition(*part) \
        .sortWithinPartitions(*part, *orders)
    sum_schema = T.StructType(
        [src.schema[k] for k in keys] + [T.StructField("_sk_blk", T.LongType())]
        + [T.StructField(x, T.LongType()) for x in
           ("p", "n_rows", "c0", "u", "u1sym", "c", "end_phase", "end_d", "end_peak",
            "end_steps", "n_match", "n_att")]
        + [T.StructField(f"s{j}", src.schema[o].dataType) for j, o in enumerate(orders)])
    summary = map_frames(blocks, summary_kernel(keys, orders), sum_schema)
    mark_schema = T.StructType(
        [src.schema[k] for k in keys] + [T.StructField("_sk_blk", T.LongType())]
        + [T.StructField(x, T.LongType()) for x in
           ("_m_phase", "_m_d", "_m_peak", "_m_steps", "_m_match", "_m_att")]
        + [T.StructField(f"_m_s{j}", src.schema[o].dataType) for j, o in enumerate(orders)])
    group = keys if keys else [F.lit(0).alias("_all")]
    states = apply_frames(summary.groupBy(*group), compose(keys, no), mark_schema)
    markers = broadcast_blocks(states.where("_sk_blk >= 0"), n_blocks)
    cond = [blocks[c].eqNullSafe(markers[c]) for c in part]
    walked = (blocks.join(markers, cond, "inner")
              .select(*[blocks[c] for c in blocks.columns],
                      *[markers[c] for c in markers.columns if c.startswith("_m_")])
              .sortWithinPartitions(*part, *orders))
    return walked, states.where("_sk_blk < 0").drop("_sk_blk")


def run(src: DataFrame, hot: DataFrame, keys, orders, fields, schema, n_blocks: int, final: str = "none"):
    """Matches of the hot rows (``hot`` carries ``_sk_blk``)."""
    from tidemark.operators.sequential import _nested_kernel

    part = keys + ["_sk_blk"]
    walked, ends = scan(src, hot, keys, orders, n_blocks)
    out = map_frames(walked, _nested_kernel(keys, part, orders, "none", blocks=True),
                     T.StructType(list(schema.fields) + [T.StructField("_sk_blk", T.LongType())])) \
        .select(*[f.name for f in fields])
    if final != "complete":
        return out
    values = {"match_no": F.col("_m_match") + 1, "n_events": F.lit(0), "depth": F.lit(0)}
    empty = ends.where("_m_phase = 0").select(
        *keys, *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields[len(keys):]])
    return out.unionByName(empty)
