"""Keyed sorted passes with small custom state.

Each operator is one ``repartition(key)`` + ``sortWithinPartitions(key,
order)`` + ``mapInPandas`` with O(1) state per key carried across Arrow
batches; only the columns the step needs are shipped to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.pattern import Pattern
from tidemark.operators.matcher import _as_list, _group_starts, _norm
from tidemark.plans.automaton import START, SUCCESS, StepTable
from tidemark.plans.frames import apply_frames, map_frames, records
from tidemark.plans.skew import HotKeys, _with_blocks


def _sorted(df: DataFrame, keys: list[str], orders: list[str]) -> DataFrame:
    d = df.repartition(*keys) if keys else df.repartition(1)
    return d.sortWithinPartitions(*(keys + orders))


def _keyed_rows(it, keys, cols):
    """Yield (is_new_key, key, batch_index, row values...) per batch."""
    prev = None
    for pdf in it:
        if len(pdf) == 0:
            continue
        newk, kcols = _group_starts(pdf, keys, prev)
        vals = [pdf[c].tolist() for c in cols]
        flags = newk.tolist()
        keyvals = [c.tolist() for c in kcols]
        yield flags, keyvals, vals, len(pdf)
        prev = tuple(_norm(c[-1]) for c in kcols)


# ---------------------------------------------------------------------------
# O21 nested depth
# ---------------------------------------------------------------------------

def nested_depth(df: DataFrame, open_: Column, close: Column, partition_by,
                 order_by, final: str = "none", strategy: str = "auto") -> DataFrame:
    """Matches of ``S = open S close | empty`` under cut semantics.

    From the start an opening event climbs; the first closing event turns
    down; the match ends when the depth is back to 0, giving the peak depth.
    Any other event -- including an opening one on the way down -- fails
    and is spent.  Output: key columns, ``match_no``, ``start_<o>``,
    ``end_<o>``, ``n_events``, ``depth``.  ``final='complete'`` adds, per
    key, the empty match (depth 0, no events) when no attempt is open at the
    end, as the older driver completes at end of input.  Per-event statuses and
    the whole-input form are in ``tidemark.operators.nested``.

    Hot keys: the block scan of ``tidemark.plans.nestscan`` (a block's
    effect on an open attempt depends only on its leading runs, so blocks
    are summarised in one pass, folded per key, and re-walked from their
    known incoming state); no run of events has to stay in one task.
    """
    keys, orders = _as_list(partition_by), _as_list(order_by)
    sym = (F.when(F.coalesce(open_, F.lit(False)), F.lit(1))
           .when(F.coalesce(close, F.lit(False)), F.lit(2)).otherwise(F.lit(0)))
    src = df.select(*keys, *orders, sym.alias("_sym"))
    fields = [df.schema[k] for k in keys] + [T.StructField("match_no", T.LongType())]
    fields += [T.StructField(f"start_{o}", df.schema[o].dataType) for o in orders]
    fields += [T.StructField(f"end_{o}", df.schema[o].dataType) for o in orders]
    fields += [T.StructField("n_events", T.LongType()), T.StructField("depth", T.LongType())]
    schema = T.StructType(fields)
    hk = None
    if strategy != "plain":
        hk = HotKeys(df, keys, orders, force=strategy == "block")
    if not hk:
        return map_frames(
            _sorted(src, keys, orders), _nested_kernel(keys, keys, orders, final), schema)
    cold, hot = hk.split(src)
    out_cold = map_frames(
        _sorted(cold, keys, orders), _nested_kernel(keys, keys, orders, final), schema)
    from tidemark.plans import nestscan

    out_hot = nestscan.run(df, hot, keys, orders, fields, schema, hk.n_blocks, final)
    return out_cold.unionByName(out_hot) if keys else out_hot


def _nested_kernel(keys, gkeys, orders, final, blocks: bool = False):
    """Nesting walk per group; with ``blocks`` each group (a block of a hot
    key) starts from the walk state in its ``_m_*`` columns."""
    nk = len(keys)
    no = len(orders)
    marks = ["_m_phase", "_m_d", "_m_peak", "_m_steps", "_m_match"] \
        + [f"_m_s{j}" for j in range(no)] if blocks else []
    extra = len(gkeys) - nk
    names = list(keys) + ["match_no"] + [f"start_{o}" for o in orders] \
        + [f"end_{o}" for o in orders] + ["n_events", "depth"] + list(gkeys[nk:])
    empty = (None,) * (2 * len(orders)) + (0, 0)

    def kernel(it):
        gkey = None
        phase = depth = peak = steps = match_no = 0  # phase 0 start, 1 up, 2 down
        start: tuple = ()
        for flags, kv, vals, n in _keyed_rows(it, gkeys, orders + ["_sym"] + marks):
            ov, sy, mv = vals[:no], vals[no], vals[no + 1:]
            rows = []
            for i in range(n):
                if flags[i]:
                    if gkey is not None and final == "complete" and phase == 0:
                        rows.append(gkey[:nk] + (match_no + 1,) + empty)
                    gkey = tuple(_norm(c[i]) for c in kv)
                    phase = depth = peak = steps = match_no = 0
                    if blocks:
                        phase, depth, peak, steps, match_no = (int(m[i]) for m in mv[:5])
                        start = tuple(_norm(mv[5 + j][i]) for j in range(no))
                s = sy[i]
                if phase == 0:
                    if s == 1:
                        phase, depth, peak, steps = 1, 1, 1, 1
                        start = tuple(c[i] for c in ov)
                    continue
                steps += 1
                if s == 1 and phase == 1:
                    depth += 1
                    peak = depth
                elif s == 2:
                    depth -= 1
                    phase = 2
                    if depth == 0:
                        match_no += 1
                        rows.append(gkey[:nk] + (match_no,) + start
                                    + tuple(c[i] for c in ov) + (steps, peak)
                                    + gkey[nk:])
                        phase = 0
                else:
                    phase = 0  # failure; the event is spent
            if rows:
                yield records(rows, columns=names)
        if gkey is not None and final == "complete" and phase == 0:
            yield records([gkey[:nk] + (match_no + 1,) + empty
                                             + (None,) * extra], columns=names)

    return kernel


# ---------------------------------------------------------------------------
# P12 stateful fold
# ---------------------------------------------------------------------------

def fold(df: DataFrame, partition_by, order_by, columns: Sequence[str],
         init: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, list]],
         end: Callable[[Any], list], schema: T.StructType, *,
         reset: Column | None = None, combine: Callable[[Any, Any], Any] | None = None,
         strategy: str = "auto") -> DataFrame:
    """P12 (our definition): per key, in order, ``state, rows = step(state,
    row)`` for every event, then ``end(state)`` at the end of the key.
    Emitted rows are tuples for ``schema`` *without* the key columns, which
    are prepended.  Only ``columns`` are shipped to Python.

    ``reset`` (optional boolean column): before a row where it holds, the
    running state is ended (``end`` is called) and started again with
    ``init()``.  Segments between resets are then independent, so a hot key
    is split: its blocks are walked from their first reset row, and each
    block's head is walked with the previous block that has one.

    ``combine`` (optional): the state after some events and then others, from the
    state after the first and the state of the others alone, folded from
    ``init()``.  A hot key's blocks are then folded apart, combined in order to the
    state each begins with, and walked again from it for their rows.  States
    must pickle.  Without either a key is one sequential walk (one task per key).
    A stream form is ``tidemark.streaming.fold``.
    """
    keys, orders = _as_list(partition_by), _as_list(order_by)
    cols = list(dict.fromkeys(list(columns)))
    sel = [*keys, *[c for c in dict.fromkeys(orders + cols) if c not in keys]]
    src = df.select(*sel, *([F.coalesce(reset, F.lit(False)).alias("_reset")]
                            if reset is not None else []))
    out_schema = T.StructType([df.schema[k] for k in keys] + list(schema.fields))
    names = [f.name for f in out_schema.fields]
    hk = None
    if (reset is not None or combine is not None) and strategy != "plain":
        hk = HotKeys(df, keys, orders, force=strategy == "block")
    kern = _fold_kernel(keys, keys, cols, init, step, end, names, reset is not None)
    if not hk:
        return map_frames(_sorted(src, keys, orders), kern, out_schema)
    cold, hot = hk.split(src)
    out_cold = map_frames(_sorted(cold, keys, orders), kern, out_schema)
    if reset is not None:
        homed = _rehome(hot, keys, orders, F.col("_reset"), hk)
        part = homed.repartition(*keys, "_home").sortWithinPartitions(*keys, "_home", *orders)
        hot_kern = _fold_kernel(keys, keys + ["_home"], cols, init, step, end, names, True)
    else:
        part = _with_states(hot, src, keys, orders, cols, init, step, combine, hk)
        hot_kern = _fold_kernel(keys, keys + ["_sk_blk"], cols, init, step, end, names, False, blocks=True)
    out_hot = map_frames(part, hot_kern, out_schema)
    return out_cold.unionByName(out_hot) if keys else out_hot


def _with_states(hot: DataFrame, src: DataFrame, keys, orders, cols, init, step, combine, hk) -> DataFrame:
    """The blocked rows in order, each block's with the state it begins with
    (``_m_state``) and whether it is its key's last (``_m_last``)."""
    import pickle

    gkeys = keys + ["_sk_blk"]
    part = hot.repartition(*gkeys).sortWithinPartitions(*gkeys, *orders)
    key_fields = [src.schema[k] for k in keys] + [T.StructField("_sk_blk", T.LongType())]

    def alone(it):
        """Every block folded from ``init()``."""
        gkey = state = None
        for flags, kv, vals, n in _keyed_rows(it, gkeys, cols):
            rows = []
            for i in range(n):
                if flags[i]:
                    if gkey is not None:
                        rows.append(gkey + (pickle.dumps(state),))
                    gkey, state = tuple(_norm(c[i]) for c in kv), init()
                state, _ = step(state, {c: v[i] for c, v in zip(cols, vals)})
            if rows:
                yield records(rows, gkeys + ["state"])
        if gkey is not None:
            yield records([gkey + (pickle.dumps(state),)], gkeys + ["state"])

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_sk_blk", kind="stable")
        key = tuple(_norm(pdf[k].iloc[0]) for k in keys)
        blocks, states = pdf["_sk_blk"].tolist(), pdf["state"].tolist()
        now, out = pickle.dumps(init()), []
        for j, (blk, state) in enumerate(zip(blocks, states)):
            out.append(key + (int(blk), now, j == len(blocks) - 1))
            now = pickle.dumps(combine(pickle.loads(now), pickle.loads(state)))
        return records(out, gkeys + ["_m_state", "_m_last"])

    folded = map_frames(part, alone, T.StructType([*key_fields, T.StructField("state", T.BinaryType())]))
    group = keys if keys else [F.lit(0).alias("_all")]
    marks = apply_frames(folded.groupBy(*group), before, T.StructType(
        [*key_fields, T.StructField("_m_state", T.BinaryType()), T.StructField("_m_last", T.BooleanType())]))
    marks = marks.select(*[F.col(c).alias(f"_sk_h{i}") for i, c in enumerate(gkeys)], "_m_state", "_m_last")
    same = [part[c].eqNullSafe(marks[f"_sk_h{i}"]) for i, c in enumerate(gkeys)]
    return part.join(marks, same).select(*[part[c] for c in part.columns], "_m_state", "_m_last").sortWithinPartitions(*gkeys, *orders)


def _rehome(hot: DataFrame, keys, orders, restart: Column, hk) -> DataFrame:
    """Assign each hot row the block whose walk takes it: its own block from
    the block's first restart row on, else the previous block that has a
    restart row (or the key's first block).  A walk may start at its home's
    first row because that row restarts it (or begins the key)."""
    part = keys + ["_sk_blk"]
    at = F.struct(*[F.col(o) for o in orders])
    heads = hot.groupBy(*part).agg(F.min(F.when(restart, at)).alias("_fr"))
    wk = Window.partitionBy(*keys).orderBy("_sk_blk")
    heads = (heads
             .withColumn("_prev_home", F.last(F.when(F.col("_fr").isNotNull(),
                                                      F.col("_sk_blk")), ignorenulls=True)
                         .over(wk.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("_first", F.min("_sk_blk").over(Window.partitionBy(*keys))))
    return (_with_blocks(hot, heads, part, hk.n_blocks)
            .withColumn("_home", F.when(F.col("_fr").isNotNull() & (at >= F.col("_fr")),
                                        F.col("_sk_blk"))
                        .otherwise(F.coalesce("_prev_home", "_first")))
            .drop("_fr", "_prev_home", "_first", "_sk_blk"))


def _fold_kernel(keys, gkeys, cols, init, step, end, names, has_reset: bool, blocks: bool = False):
    """``blocks``: each group begins with the state in ``_m_state``, and only a key's
    last one ends it."""
    import pickle

    nk = len(keys)
    extra = (["_reset"] if has_reset else []) + (["_m_state", "_m_last"] if blocks else [])

    def kernel(it):
        gkey = None
        state = None
        last = True
        for flags, kv, vals, n in _keyed_rows(it, gkeys, cols + extra):
            resets = vals[len(cols)] if has_reset else None
            rows = []
            for i in range(n):
                if flags[i]:
                    if gkey is not None and last:
                        rows.extend(gkey[:nk] + tuple(r) for r in end(state))
                    gkey = tuple(_norm(c[i]) for c in kv)
                    state = pickle.loads(vals[-2][i]) if blocks else init()
                    last = bool(vals[-1][i]) if blocks else True
                elif resets is not None and resets[i]:
                    rows.extend(gkey[:nk] + tuple(r) for r in end(state))
                    state = init()
                state, emitted = step(state, {c: v[i] for c, v in zip(cols, vals)})
                rows.extend(gkey[:nk] + tuple(r) for r in emitted)
            if rows:
                yield records(rows, columns=names)
        if gkey is not None and last:
            rows = [gkey[:nk] + tuple(r) for r in end(state)]
            if rows:
                yield records(rows, columns=names)

    return kernel


# ---------------------------------------------------------------------------
# P13 sequence timeout (batch form)
# ---------------------------------------------------------------------------

def match_cut_timeout(df: DataFrame, pattern: Pattern, partition_by, order_by,
                      time_col: str, timeout: str | int, **kw) -> DataFrame:
    """P13 (our definition): ``match_cut`` where an open attempt whose next
    event comes more than ``timeout`` after its last event is dropped first;
    that event is then tried from the start.  Same plans as ``match_cut``
    (hot keys included)."""
    from tidemark.operators.matcher import match_cut

    return match_cut(df, pattern, partition_by, order_by, time_col=time_col,
                     timeout=timeout, **kw)


# ---------------------------------------------------------------------------
# P18 many patterns in one pass
# ---------------------------------------------------------------------------

def _many_blocks(hot: DataFrame, patterns: dict[str, Pattern], keys, orders, n_blocks: int) -> list[DataFrame]:
    """The matches of each pattern among rows cut into blocks (``_sk_blk``)."""
    from tidemark.operators.matcher import _Prepared
    from tidemark.plans import blockscan
    from tidemark.plans.captures import Tracker

    preps = {name: _Prepared(hot, p, keys, orders, None, (), None, "reference", want_show=False) for name, p in patterns.items()}
    syms = [prep.table.symbol_column().alias(f"_sym{j}") for j, prep in enumerate(preps.values())]
    part = (hot.select(*keys, *orders, *syms, F.col("_sk_blk").alias("_blk"))
            .repartition(*keys, "_blk").sortWithinPartitions(*keys, "_blk", *orders))
    out = []
    for j, (name, prep) in enumerate(preps.items()):
        fields = [prep.field[c] for c in keys] + [T.StructField("match_no", T.LongType())]
        fields += [T.StructField(pre + o, prep.field[o].dataType) for pre in ("start_", "end_") for o in orders]
        fields += [T.StructField("n_events", T.LongType()), T.StructField("alt", T.StringType())]
        m = blockscan.run(prep, "cut", T.StructType(fields), tracked=Tracker(prep.table, []), shared=(part, n_blocks, f"_sym{j}"))
        out.append(m.select(*keys, F.lit(name).alias("pattern"), *[f.name for f in fields if f.name not in (*keys, "alt")]))
    return out


def match_many(df: DataFrame, patterns: dict[str, Pattern], partition_by,
               order_by, strategy: str = "auto") -> DataFrame:
    """P18 (our definition): several cut matchers over one read, one shuffle
    and one sort.  Each pattern is matched independently.  Output: key
    columns, ``pattern``, ``match_no``, ``start_<o>``, ``end_<o>``,
    ``n_events``.

    Hot keys: their rows are cut into blocks once, dealt and sorted in one exchange
    that all patterns' block scans read; cold keys share the single pass.
    """
    keys, orders = _as_list(partition_by), _as_list(order_by)
    if strategy != "plain":
        hk = HotKeys(df, keys, orders, force=strategy == "block")
        if hk:
            cold, hot = hk.split(df)
            out = match_many(cold, patterns, keys, orders, strategy="plain") if keys else None
            for m in _many_blocks(hot, patterns, keys, orders, hk.n_blocks):
                out = m if out is None else out.unionByName(m)
            return out
    tables = {name: StepTable(p) for name, p in patterns.items()}
    syms = [t.symbol_column().alias(f"_sym{i}") for i, t in enumerate(tables.values())]
    src = df.select(*keys, *orders, *syms)
    fields = [df.schema[k] for k in keys] + [T.StructField("pattern", T.StringType()),
                                            T.StructField("match_no", T.LongType())]
    fields += [T.StructField(f"start_{o}", df.schema[o].dataType) for o in orders]
    fields += [T.StructField(f"end_{o}", df.schema[o].dataType) for o in orders]
    fields += [T.StructField("n_events", T.LongType())]
    names = [f.name for f in fields]
    tlist = list(tables.items())
    k = len(tlist)

    def kernel(it):
        key = None
        states = [START] * k
        steps = [0] * k
        match_no = [0] * k
        starts: list[tuple] = [()] * k
        cols = orders + [f"_sym{i}" for i in range(k)]
        no = len(orders)
        for flags, kv, vals, n in _keyed_rows(it, keys, cols):
            ov = vals[:no]
            rows = []
            for i in range(n):
                if flags[i]:
                    key = tuple(_norm(c[i]) for c in kv)
                    states, steps, match_no = [START] * k, [0] * k, [0] * k
                for j in range(k):
                    name, table = tlist[j]
                    if states[j] == START:
                        steps[j] = 0
                        starts[j] = tuple(c[i] for c in ov)
                    steps[j] += 1
                    nxt, code, _, _ = table.move(states[j], vals[no + j][i])
                    if code == SUCCESS:
                        match_no[j] += 1
                        rows.append(key + (name, match_no[j]) + starts[j]
                                    + tuple(c[i] for c in ov) + (steps[j],))
                    states[j] = nxt
            if rows:
                yield records(rows, columns=names)

    return map_frames(_sorted(src, keys, orders), kernel, T.StructType(fields))
