"""Hot-key plan: the two-pass block scan (strategy S3, SURVEY §4.3).

A key with a large share of all rows must not be matched in one task.
Such keys are cut into ordered blocks of about ``tidemark.blockRows``
rows (``tidemark.plans.skew``), and:

1. pass 1 walks every block once, for *every* start state of the step
   table at the same time (walks that meet in the start state merge, so
   the cost is about one walk), and emits a few rows of summary per block:
   end state, attempts and matches started, the open attempt;
2. a short per-key scan over the block summaries (blocks, not events)
   gives each block its incoming state and counters;
3. pass 2 walks each block again from its known start and emits exact
   rows.

Cold keys take the plain one-shuffle sorted pass.

Pass 1 and pass 2 partition the same stored rows by ``(key, block)``, so
Spark reuses that exchange.

Published idea: data-parallel finite-state machines (Mytkowicz, Musuvathi
and Schulte, ASPLOS 2014).
"""

from __future__ import annotations

import pickle
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.automaton import INCOMPLETE, START, SUCCESS
from tidemark.plans.captures import NONE, Tracker, dumped, joined, loaded, unknown
from tidemark.plans.frames import apply_frames, map_frames, records
from tidemark.plans.skew import HotKeys, broadcast_blocks


def run(prep, mode: str, schema: T.StructType, *, final: str = "ended",
        tracked: Tracker | None = None, strategy: str = "auto",
        shared: tuple[DataFrame, int, str] | None = None, sums: list[str] = ()) -> DataFrame:
    """``shared``: (rows of hot keys, cut and sorted by block, the number of blocks, the
    symbol column): several patterns read one such frame, whose exchange Spark reuses."""
    from tidemark.operators import matcher as M

    keys, orders = prep.keys, prep.orders
    table = prep.table

    def plain(d: DataFrame, blocks: bool = False) -> DataFrame:
        if blocks:
            part = d.repartition(*keys, "_blk").sortWithinPartitions(*keys, "_blk", *orders)
        elif keys:
            part = d.repartition(*keys).sortWithinPartitions(*keys, *orders)
        else:
            part = d.repartition(1).sortWithinPartitions(*orders)
        if mode == "events":
            fn = M._events_kernel(table, keys, orders + prep.carry, prep.has_show, final,
                                  blocks, timeout=prep.timeout, sums=sums)
        else:
            fn = M._cut_kernel(tracked, keys, orders, schema.names, blocks, timeout=prep.timeout)
        return map_frames(part, fn, schema)

    if strategy == "plain":
        return plain(prep.df)
    if shared is not None:
        cold, hot_part, n_blocks = None, None, shared[1]
    elif "_sk_blk" in prep.df.columns:  # rows already cut into blocks
        cold, hot_part, n_blocks = None, prep.df, prep.n_blocks
    else:
        hk = HotKeys(prep.src, keys, orders, force=strategy == "block")
        if not hk:
            return plain(prep.df)
        n_blocks = hk.n_blocks
        cold, hot_part = hk.split(prep.df)
        cold = cold if keys else None
    if shared is not None:
        part, sym = shared[0], shared[2]
        table.complete_all(lambda: table.symbols_in(part.withColumnRenamed(sym, "_sym")))
    else:
        table.complete_all(lambda: table.symbols_in(hot_part))
        hot_part = hot_part.withColumnRenamed("_sk_blk", "_blk")
        part, sym = hot_part.repartition(*keys, "_blk").sortWithinPartitions(*keys, "_blk", *orders), "_sym"

    def named(fn):
        """The kernel on frames whose symbol column has its own name: a projection
        before the kernel would give every pattern an exchange of its own."""
        return fn if sym == "_sym" else lambda it: fn(pdf.rename(columns={sym: "_sym"}) for pdf in it)

    # pass 1: block summaries for every start state
    sum_fields = [prep.field[k] for k in keys] + [
        T.StructField("_blk", T.LongType()),
        T.StructField("q", T.IntegerType()),
        T.StructField("end_q", T.IntegerType()),
        T.StructField("n_att", T.LongType()),
        T.StructField("n_match", T.LongType()),
        T.StructField("steps", T.LongType()),
        T.StructField("started", T.BooleanType()),
        T.StructField("t_first", T.LongType()),
        T.StructField("t_last", T.LongType()),
    ] + [T.StructField(f"s{j}", prep.field[o].dataType) for j, o in enumerate(orders)] \
      + [T.StructField("paths", T.BinaryType()), T.StructField("sums", T.BinaryType())]  # as the kernels pickle them
    tracked = tracked or Tracker(table, [])
    summary = map_frames(
        part, named(_summary_kernel(tracked, keys, orders, prep.timeout, len(sums))),
        T.StructType(sum_fields))

    # per-key scan over blocks
    mark_fields = [prep.field[k] for k in keys] + [
        T.StructField("_blk", T.LongType()),
        T.StructField("_m_state", T.IntegerType()),
        T.StructField("_m_att", T.LongType()),
        T.StructField("_m_match", T.LongType()),
        T.StructField("_m_steps", T.LongType()),
        T.StructField("_m_last", T.BooleanType()),
        T.StructField("_m_t", T.LongType()),
    ] + [T.StructField(f"_m_s{j}", prep.field[o].dataType) for j, o in enumerate(orders)] \
      + [T.StructField("_m_paths", T.BinaryType()), T.StructField("_m_sums", T.BinaryType())]
    group = keys if keys else [F.lit(0).alias("_all")]
    markers = apply_frames(
        summary.groupBy(*group), _compose(keys, len(orders), prep.timeout), T.StructType(mark_fields))
    markers = broadcast_blocks(markers, n_blocks)

    # pass 2: walk each block from its known start
    cond = [part[c].eqNullSafe(markers[c]) for c in keys + ["_blk"]]
    walked = (part.join(markers, cond, "inner")
              .select(*[part[c] for c in part.columns],
                      *[markers[c] for c in markers.columns if c.startswith("_m_")])
              .sortWithinPartitions(*keys, "_blk", *orders))
    if mode == "events":
        fn = M._events_kernel(table, keys, orders + prep.carry, prep.has_show, final, True,
                              timeout=prep.timeout, sums=sums)
    else:
        fn = M._cut_kernel(tracked, keys, orders, schema.names, True, timeout=prep.timeout)
    hot_out = map_frames(walked, named(fn), schema)
    if cold is None:
        return hot_out
    return plain(cold).unionByName(hot_out)


def _summary_kernel(tracked, keys, orders, timeout=None, n_sums: int = 0):
    from tidemark.operators.matcher import _captured, _group_starts, _norm

    table = tracked.table
    gkeys = keys + ["_blk"]
    n_states = len(table.states)

    class Walk:
        __slots__ = ("state", "att", "match", "steps", "started", "start", "paths", "sums")

        def __init__(self, q):
            self.state, self.att, self.match, self.steps = q, 0, 0, 0
            self.started = False
            self.start: tuple = tuple([None] * len(orders))
            self.paths = unknown(table, q) if tracked.on else NONE
            self.sums = [0] * n_sums

    def flush(gkey, walks, alias, t_first, t_last):
        out = []
        for q in range(n_states):
            tgt, d_att, d_match = alias[q]
            w = walks[tgt]
            out.append(gkey + (q, w.state, w.att + d_att, w.match + d_match, w.steps,
                               w.started, t_first, t_last) + w.start
                       + (dumped(w.paths) if tracked.on else None, pickle.dumps(w.sums) if n_sums else None))
        return out

    def kernel(it):
        gkey = None
        walks: list[Walk] = []
        alias: list[tuple[int, int, int]] = []
        active: list[int] = []
        t_first = t_last = None
        for pdf in it:
            n = len(pdf)
            if n == 0:
                continue
            newk, gcols = _group_starts(pdf, gkeys, gkey)
            sym = pdf["_sym"].to_numpy().tolist()
            ocols = [pdf[o].tolist() for o in orders]
            ccols = [c.tolist() for c in _captured(pdf)]
            scols = [pdf[f"_sum{j}"].tolist() for j in range(n_sums)]
            tt = pdf["_t"].tolist() if timeout is not None else [None] * n
            newk_l = newk.tolist()
            rows = []
            for i in range(n):
                if newk_l[i]:
                    if gkey is not None:
                        rows.extend(flush(gkey, walks, alias, t_first, t_last))
                    gkey = tuple(_norm(c[i]) for c in gcols)
                    walks = [Walk(q) for q in range(n_states)]
                    alias = [(q, 0, 0) for q in range(n_states)]
                    active = list(range(n_states))
                    t_first = t_last = tt[i]
                # a gap longer than the timeout drops every open attempt
                timed_out = (timeout is not None and tt[i] is not None and t_last is not None
                             and tt[i] - t_last > timeout)
                t_last = tt[i]
                # walks that meet in the start state go on as one
                at_start = [a for a in active if walks[a].state == START]
                if len(at_start) > 1:
                    head = walks[at_start[0]]
                    for a in at_start[1:]:
                        w = walks[a]
                        for q in range(n_states):
                            if alias[q][0] == a:
                                alias[q] = (at_start[0], alias[q][1] + w.att - head.att,
                                            alias[q][2] + w.match - head.match)
                        active.remove(a)
                y = sym[i]
                for a in active:
                    w = walks[a]
                    if timed_out:
                        w.state = START
                    if w.state == START:
                        w.att += 1
                        w.steps = 0
                        w.started = True
                        w.start = tuple(c[i] for c in ocols)
                        w.paths = NONE
                        w.sums = [0] * n_sums
                    w.steps += 1
                    if n_sums:
                        w.sums = [a + c[i] for a, c in zip(w.sums, scols)]
                    nxt, code, br, lab = table.move(w.state, y)
                    if tracked.on and code == INCOMPLETE:
                        w.paths = tracked.step(w.state, y, w.paths, ccols, i)
                    if code == SUCCESS:
                        w.match += 1
                    w.state = nxt
            if rows:
                yield _frame(rows, keys, orders)
        if gkey is not None:
            yield _frame(flush(gkey, walks, alias, t_first, t_last), keys, orders)

    return kernel


def _frame(rows, keys, orders) -> pd.DataFrame:
    cols = list(keys) + ["_blk", "q", "end_q", "n_att", "n_match", "steps", "started",
                         "t_first", "t_last"] \
        + [f"s{j}" for j in range(len(orders))] + ["paths", "sums"]
    return records(rows, cols)


def _compose(keys, n_orders: int, timeout=None):
    """Per key: fold the block summaries in block order (blocks, not rows)."""
    from tidemark.operators.matcher import _norm

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_blk", "q"], kind="stable")
        blks = pdf["_blk"].to_numpy()
        uniq = np.unique(blks)
        n_q = int(pdf["q"].max()) + 1
        idx = {b: i for i, b in enumerate(uniq)}
        end_q = pdf["end_q"].to_numpy().reshape(len(uniq), n_q)
        n_att = pdf["n_att"].to_numpy().reshape(len(uniq), n_q)
        n_match = pdf["n_match"].to_numpy().reshape(len(uniq), n_q)
        steps = pdf["steps"].to_numpy().reshape(len(uniq), n_q)
        started = pdf["started"].to_numpy().reshape(len(uniq), n_q)
        t_first, t_last = ([_norm(t) for t in pdf[c].tolist()[::n_q]] for c in ("t_first", "t_last"))
        svals = [pdf[f"s{j}"].tolist() for j in range(n_orders)]
        pvals, sums = pdf["paths"].tolist(), pdf["sums"].tolist()
        key = tuple(pdf[k].iloc[0] for k in keys)
        state, att, match, stp = START, 0, 0, 0
        start: tuple[Any, ...] = tuple([None] * n_orders)
        paths = NONE
        total: list = []  # running sums of the open attempt
        out = []
        prev_t = None
        for b in uniq:
            bi = idx[b]
            if timeout is not None and state != START and prev_t is not None \
                    and t_first[bi] is not None and t_first[bi] - prev_t > timeout:
                state, stp = START, 0  # the open attempt timed out at the edge
                start, paths = tuple([None] * n_orders), NONE
            out.append(key + (int(b), state, att, match, stp, bi == len(uniq) - 1,
                              None if prev_t is None else int(prev_t))
                       + start + (dumped(paths), pickle.dumps(total)))
            prev_t = t_last[bi] if timeout is not None else None
            r = bi * n_q + state
            att += int(n_att[bi, state])
            match += int(n_match[bi, state])
            nxt = int(end_q[bi, state])
            if nxt == START:
                stp, start, paths = 0, tuple([None] * n_orders), NONE
            elif started[bi, state]:
                stp = int(steps[bi, state])
                start = tuple(s[r] for s in svals)
            else:
                stp += int(steps[bi, state])
            if sums[r] is not None:
                own = pickle.loads(sums[r])
                carried = total and nxt != START and not started[bi, state]
                total = [] if nxt == START else [a + b for a, b in zip(total, own)] if carried else own
            if nxt != START and pvals[r] is not None:
                paths = joined(paths, loaded(pvals[r]))
            state = nxt
        cols = list(keys) + ["_blk", "_m_state", "_m_att", "_m_match", "_m_steps",
                             "_m_last", "_m_t"] + [f"_m_s{j}" for j in range(n_orders)] \
            + ["_m_paths", "_m_sums"]
        return records(out, cols)

    return fn
