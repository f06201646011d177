"""Cut matcher over keyed, ordered event tables.

Physical plan (strategy S2, SURVEY §4.3):

    select(key, order, symbol[, show, captures])   -- pruned, JVM-side
      -> repartition(key)                           -- one shuffle
      -> sortWithinPartitions(key, order)           -- spills if needed
      -> map_frames(step-table walk)                -- O(1) state per key

Only the narrow symbol column and the columns asked for go through
Python.  Keys are never collected: a key's rows stream through one
sorted pass, a few integers of state carried across Arrow batches.  Keys
heavy enough to overload one task are split into ordered blocks and
matched with the two-pass block scan of ``tidemark.plans.blockscan``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.pattern import Captures, Pattern, has_value, value_column
from tidemark.plans.automaton import (
    AMBIGUOUS, FAILURE, INCOMPLETE, START, STATUS_NAMES, SUCCESS, StepTable,
)
from tidemark.plans.captures import NONE, Capture, Registers, Tracker, dumped, joined, loaded, unknown
from tidemark.plans.frames import apply_frames, map_frames, records
from tidemark.plans.walk import late, walk

STATUS_FIELDS = [
    T.StructField("status", T.StringType()),
    T.StructField("attempt_id", T.LongType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("alt", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("fail_expected", T.StringType()),
    T.StructField("fail_got", T.StringType()),
]


def _as_list(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


def own_names(df: DataFrame, results: Sequence[str], *lists) -> tuple:
    """``df`` and the lists of its columns under names that clash with no result: a column
    named as a result comes as ``in_<name>``, a dot in a name as an underscore."""
    taken, used = {r.lower() for r in results}, {c.lower() for c in df.columns}
    new: dict[str, str] = {}
    for c in dict.fromkeys(c for cols in lists for c in cols):
        name = c.replace(".", "_") if c in df.columns else c
        if name.lower() in taken:
            name = f"in_{name}"
        while name != c and name.lower() in used | {n.lower() for n in new.values()}:
            name += "_"
        if name != c:
            new[c] = name
    out = df.withColumns({n: F.col(f"`{c}`") for c, n in new.items()}) if new else df
    return (out, *[[new.get(c, c) for c in cols] for cols in lists])


def default_show(pattern: Pattern) -> Column | None:
    """Literal-only patterns over one column show that column on failure."""
    cols = {s.column for s in pattern.steps() if s.predicate is not None}
    if len(cols) == 1 and None not in cols:
        return F.col(cols.pop()).cast("string")
    return None


class _Prepared:
    """Pruned, keyed, sorted input of one matcher run."""

    def __init__(self, df: DataFrame, pattern: Pattern, partition_by, order_by,
                 show: Column | None, captures: Sequence[str], where_key: Column | None,
                 on_ambiguity: str, carry: Sequence[str] = (),
                 time_col: str | None = None, timeout: str | int | None = None,
                 want_show: bool = True, project: bool | None = None, sums: dict[str, Column] | None = None):
        from tidemark.operators.windows import duration_micros, time_number

        self.table = StepTable(pattern, on_ambiguity)
        self.timeout = None if timeout is None else duration_micros(timeout)
        if self.timeout is not None and time_col is None:
            raise ValueError("timeout needs time_col")
        self.keys = _as_list(partition_by)
        self.orders = _as_list(order_by)
        if not self.orders:
            raise ValueError("order_by is required: a match needs a total order")
        #: columns to capture, then the steps' own
        self.captures = list(captures)
        project = not want_show if project is None else project
        own = {} if not project else {(s.name, n): c for s in pattern.steps() for n, c in s.project}
        self.carry = [c for c in carry if c not in self.keys + self.orders]
        if where_key is not None:
            df = df.filter(where_key)  # safe: a key filter never changes adjacency
        self.src = df
        if show is None and want_show:
            show = default_show(pattern)
        # the shown event is only needed for failure rows: cut output has none
        self.has_show = want_show and show is not None
        sel = [F.col(c) for c in self.keys + self.orders + self.carry]
        sel.append(self.table.symbol_column().alias("_sym"))
        if self.has_show:
            sel.append(show.cast("string").alias("_show"))
        exprs = [F.col(c) for c in self.captures] + list(own.values())
        for i, c in enumerate(exprs):
            sel.append(c.alias(f"_cap{i}"))
        self.exprs = exprs
        kept: dict[str, set[int]] = {}
        for q, p in enumerate(self.table.positions):
            if p.keep:
                kept.setdefault(p.name, set()).add(q)
        self.caps: list[Capture] = []
        for name in sorted(kept):
            at = frozenset(kept[name])
            self.caps += [Capture(f"{name}_{c}", i, at) for i, c in enumerate(self.captures)]
            self.caps += [Capture(f"{name}_{n}", len(self.captures) + i, at)
                          for i, (s, n) in enumerate(own) if s == name]
        #: captures[step][column], as value functions see them
        self.named = {name: {c: F.col(f"{name}_{c}") for c in [*self.captures, *[n for s, n in own if s == name]]}
                      for name in kept}
        for i, c in enumerate((sums or {}).values()):
            sel.append(F.coalesce(c, F.lit(0)).alias(f"_sum{i}"))
        if self.timeout is not None:
            sel.append(time_number(time_col, df).alias("_t"))
        #: rows that come cut into blocks keep them
        self.n_blocks = 0
        if "_sk_blk" in df.columns:
            sel.append(F.col("_sk_blk"))
            self.n_blocks = 1 << 62
        self.df = df.select(*sel)
        self.field = {f.name: f for f in df.schema.fields}

    def sorted(self) -> DataFrame:
        if self.keys:
            d = self.df.repartition(*self.keys)
        else:
            d = self.df.repartition(1)
        return d.sortWithinPartitions(*(self.keys + self.orders))


# ---------------------------------------------------------------------------
# per-event statuses
# ---------------------------------------------------------------------------

def match_events(df: DataFrame, pattern: Pattern, partition_by, order_by, *,
                 show: Column | None = None, final: str = "ended",
                 on_ambiguity: str = "reference", where_key: Column | None = None,
                 strategy: str = "auto", carry: Sequence[str] = (),
                 time_col: str | None = None, timeout: str | int | None = None,
                 sums: dict[str, Column] | None = None) -> DataFrame:
    """One status row per event, plus one end-of-input row per key.

    Output: key columns, order columns, ``status`` (INCOMPLETE, SUCCESS,
    FAILURE, AMBIGUOUS, ENDED), ``attempt_id`` (1-based, per key), ``step``
    (events taken in the attempt so far), ``alt`` (top-level branch of a
    SUCCESS), ``label`` (step name(s) the event was taken as),
    ``fail_expected`` (sorted step names), ``fail_got`` (shown event).

    ``final='ended'``: the end row has status ENDED, order columns NULL,
    ``step`` = events of the open attempt.  ``final='complete'``: the end row
    completes the open attempt instead: SUCCESS if the pattern is nullable
    and no attempt is open, else FAILURE.  ``final='none'`` omits it.
    ``carry`` columns ride along (NULL on end rows); keep them few.  Columns named
    as a result come as ``in_<name>``, dots in names as underscores.
    ``sums`` (P20, output on a partial match): running sums of whole numbers or
    decimals over the events of the attempt so far (NULLs count as 0), carried with
    the walk, across blocks too; NULL on end rows.
    ``timeout`` (P13, our definition): an open attempt whose next event
    comes more than ``timeout`` after its last event (by ``time_col``) is
    dropped, and that event is tried from the start.  Next to an event without
    a time there is no gap.
    """
    if final not in ("ended", "complete", "none"):
        raise ValueError("final must be 'ended', 'complete' or 'none'")
    sums = sums or {}
    df, partition_by, order_by, carry = own_names(
        df, [f.name for f in STATUS_FIELDS] + list(sums), _as_list(partition_by), _as_list(order_by), carry)
    prep = _Prepared(df, pattern, partition_by, order_by, show, (), where_key,
                     on_ambiguity, carry, time_col, timeout, sums=sums)
    added = []
    for i, name in enumerate(sums):
        kind = prep.df.schema[f"_sum{i}"].dataType
        if not isinstance(kind, (T.IntegralType, T.DecimalType)):
            raise ValueError("sums are of whole numbers or decimals")
        added.append(T.StructField(name, T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.LongType()))
    schema = T.StructType(
        [prep.field[c] for c in prep.keys + prep.orders + prep.carry] + STATUS_FIELDS + added)
    from tidemark.plans import single
    pos = single.single_event_positions(pattern, prep.table) if strategy != "plain" and not sums else None
    if pos is not None:
        if show is None:
            show = default_show(pattern)
        out = single.events(prep, pos, schema, final, show, strategy)
    elif strategy in ("auto", "block"):
        from tidemark.plans import blockscan
        out = blockscan.run(prep, "events", schema, final=final, strategy=strategy, sums=list(sums))
    else:
        fn = _events_kernel(prep.table, prep.keys, prep.orders + prep.carry, prep.has_show,
                            final, timeout=prep.timeout, sums=list(sums))
        out = map_frames(prep.sorted(), fn, schema)
    if final == "ended":
        return _or_if_empty(out, prep, schema, {"status": "ENDED", "step": 0})
    if final == "complete":
        end = {"status": "SUCCESS"} if prep.table.nullable else {
            "status": "FAILURE", "fail_expected": prep.table.expected(START), "fail_got": "<end of input>"}
        return _or_if_empty(out, prep, schema, {"attempt_id": 1, "step": 0, **end})
    return out


def _or_if_empty(out: DataFrame, prep: _Prepared, schema: T.StructType, values: dict) -> DataFrame:
    """``out``; for keyless input without any event, which is one key all the same, one row."""
    if prep.keys:
        return out
    none = prep.src.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return out.unionByName(none.select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]))


def _group_starts(pdf: pd.DataFrame, keys: list[str], prev_key) -> tuple[np.ndarray, list]:
    """Flags of rows that begin a new group (key change), NULL-safe."""
    n = len(pdf)
    newk = np.zeros(n, dtype=bool)
    cols = [pdf[k].to_numpy() for k in keys]
    for k, c in zip(keys, cols):
        na = pdf[k].isna().to_numpy()
        ne = np.asarray(c[1:] != c[:-1], dtype=bool)
        newk[1:] |= np.where(na[1:] & na[:-1], False, ne | (na[1:] != na[:-1]))
    first = tuple(_norm(c[0]) for c in cols)
    newk[0] = prev_key is None or first != prev_key
    return newk, cols


def _series(values: list, dtype) -> pd.Series:
    """A column in the dtype of its source, NULL-capable."""
    kind = getattr(dtype, "kind", "O")
    if kind in "iu":
        return pd.Series(values, dtype=f"{'U' if kind == 'u' else ''}Int{dtype.itemsize * 8}")
    if kind == "b":
        return pd.Series(values, dtype="boolean")
    if kind in "mM":
        return pd.Series(values, dtype=dtype)
    return pd.Series(values, dtype=object if kind == "O" else None)


def _norm(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    return v.item() if isinstance(v, np.generic) else v


class _Carry:
    """Walk state of one key (or block of a key) between rows and batches."""

    __slots__ = ("key", "state", "attempt", "match_no", "steps", "start", "paths", "last",
                 "last_t", "row", "sums")

    def __init__(self, key):
        self.key = key
        self.state, self.attempt, self.match_no, self.steps = START, 0, 0, 0
        self.start: tuple = ()
        self.paths: list[Registers] = NONE
        self.last = True  # last block of its key: emits the end row
        self.last_t = None  # time of the previous event (timeouts)
        self.row = 0  # its first row in the batch
        self.sums: list = []  # running sums of the open attempt

    def load_marker(self, pdf: pd.DataFrame, i: int, n_orders: int):
        self.state = int(pdf["_m_state"].iat[i])
        self.attempt = int(pdf["_m_att"].iat[i])
        self.match_no = int(pdf["_m_match"].iat[i])
        self.steps = int(pdf["_m_steps"].iat[i])
        self.last = bool(pdf["_m_last"].iat[i])
        self.start = tuple(_norm(pdf[f"_m_s{j}"].iat[i]) for j in range(n_orders))
        if pdf["_m_paths"].iat[i] is not None:
            self.paths = loaded(pdf["_m_paths"].iat[i])
        if "_m_sums" in pdf.columns and pdf["_m_sums"].iat[i] is not None:
            self.sums = pickle.loads(pdf["_m_sums"].iat[i])
        if "_m_t" in pdf.columns:
            self.last_t = _norm(pdf["_m_t"].iat[i])
            if self.last_t is not None:
                self.last_t = int(self.last_t)


def _events_kernel(table: StepTable, keys, orders, has_show: bool, final: str,
                   blocks: bool = False, timeout: int | None = None, sums: Sequence[str] = ()):
    names = STATUS_NAMES
    branch_names = table.branch_names
    top_alt = table.top_is_alt
    gkeys = keys + (["_blk"] if blocks else [])
    nk = len(keys)
    status_arr = np.asarray(names, dtype=object)
    alt_arr = np.asarray([None] + (branch_names if top_alt else [None] * len(branch_names)),
                         dtype=object)

    def end_row(c: _Carry):
        if final == "ended":
            return ("ENDED", None, c.steps if c.state != START else 0,
                    None, None, None, None)
        if c.state == START and table.nullable:
            return ("SUCCESS", c.attempt + 1, 0, None, None, None, None)
        if c.state == START:
            return ("FAILURE", c.attempt + 1, 0, None, None, table.expected(START),
                    "<end of input>")
        return ("FAILURE", c.attempt, c.steps, None, None, table.expected(c.state),
                "<end of input>")

    def kernel(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: _Carry | None = None
        gprev = None
        ends: list[tuple] = []
        for pdf in it:
            n = len(pdf)
            if n == 0:
                continue
            newk, gcols = _group_starts(pdf, gkeys, gprev)
            batch = _Batch(table, pdf, newk, carry, blocks, timeout, 0)
            totals = _running(pdf, batch, len(sums)) if sums else []
            firsts = batch.firsts
            for j, i in enumerate(firsts):
                if newk[i]:
                    if carry is not None:
                        if j:
                            batch.leave(carry, i)
                        if carry.last and final != "none":
                            ends.append((carry.key, end_row(carry)))
                    gprev = tuple(_norm(c[i]) for c in gcols)
                    carry = batch.carries[j]
                    carry.key = gprev[:nk]
            batch.leave(carry, n)
            failed = batch.code == FAILURE
            out = pdf[keys + orders].copy()
            out["status"] = status_arr[batch.code]
            out["attempt_id"] = batch.attempt
            out["step"] = batch.step.astype(np.int32)
            won = batch.code == SUCCESS
            out["alt"] = alt_arr[np.where(won, batch.branch, -1) + 1]
            out["label"] = np.asarray(table.labels, dtype=object)[np.where(failed, 0, batch.label)]
            expected = np.asarray([None] + [table.expected(q)
                                            for q in range(len(table.states))], dtype=object)
            out["fail_expected"] = expected[np.where(failed, batch.before, -1) + 1]
            if has_show:
                out["fail_got"] = np.where(failed, pdf["_show"].to_numpy(dtype=object), None)
            else:
                out["fail_got"] = None
            for name, total in zip(sums, totals):
                out[name] = pd.Series(total, index=out.index, dtype=object)
            yield out
            if len(ends) >= 10_000:
                yield _end_frame(ends, keys, orders, sums)
                ends = []
        if carry is not None and carry.last and final != "none":
            ends.append((carry.key, end_row(carry)))
        if ends:
            yield _end_frame(ends, keys, orders, sums)

    return kernel


def _running(pdf: pd.DataFrame, batch: "_Batch", n: int) -> list[list]:
    """Sums over each event's attempt so far; the carried keys keep those of their last event."""
    out = [pdf[f"_sum{j}"].tolist() for j in range(n)]
    begun = (batch.before == START).tolist()
    for j, total in enumerate(out):
        for c, a, b in zip(batch.carries, batch.firsts, [*batch.firsts[1:], len(pdf)]):
            now = c.sums[j] if j < len(c.sums) else 0
            for r in range(a, b):
                now = total[r] if begun[r] else now + total[r]
                total[r] = now
    for c, b in zip(batch.carries, [*batch.firsts[1:], len(pdf)]):
        c.sums = [total[b - 1] for total in out]
    return out


class _Batch:
    """A batch walked: statuses, attempts and steps of its events, and the state of
    each key (or block) as it enters and leaves."""

    def __init__(self, table: StepTable, pdf: pd.DataFrame, newk: np.ndarray, carry: _Carry | None, blocks: bool,
                 timeout: int | None, n_orders: int):
        n = len(pdf)
        self.firsts = np.flatnonzero(newk | (np.arange(n) == 0)).tolist()
        self.carries: list[_Carry] = []
        for i in self.firsts:
            if newk[i]:
                c = _Carry(())
                if blocks:
                    c.load_marker(pdf, i, n_orders)
            else:
                c = carry
            self.carries.append(c)
        sym = pdf["_sym"].to_numpy().astype(np.int64)
        known, first = np.zeros(n, bool), np.full(n, START, np.int64)
        at = np.array(self.firsts)
        known[at] = True
        first[at] = [c.state for c in self.carries]
        self.times = pdf["_t"].tolist() if timeout is not None else None
        if timeout is not None:
            is_late = late(self.times, carry.last_t if carry is not None else None, newk, timeout)
            for j, i in enumerate(self.firsts):  # a block knows the time before it
                p, t = self.carries[j].last_t, self.times[i]
                is_late[i] = p is not None and t is not None and t - p > timeout
            known |= is_late
            first[is_late] = START
        w = walk(table, sym, known, first)
        self.before, self.code, self.branch, self.label, self.after = w.before, w.code, w.branch, w.label, w.after
        self.nxt = table
        begin = w.before == START
        place = np.arange(n)
        group = np.cumsum(newk | (place == 0)) - 1
        base = np.array([c.attempt for c in self.carries])
        steps = np.array([c.steps for c in self.carries])
        count = np.cumsum(begin)
        before_group = count[at] - begin[at]
        self.attempt = base[group] + count - before_group[group]
        #: row on which each event's attempt began, or -1: before this batch
        self.begun = np.maximum.accumulate(np.where(begin, place, -1))
        self.begun = np.where(self.begun >= at[group], self.begun, -1)
        self.step = np.where(self.begun >= 0, place - self.begun + 1, steps[group] + place - at[group] + 1)
        self.sym = sym

    def leave(self, carry: _Carry, end: int) -> None:
        """The state of the key whose last event here is the one before row ``end``."""
        r = end - 1
        carry.attempt, carry.steps = int(self.attempt[r]), int(self.step[r])
        carry.state = self.nxt.move(int(self.before[r]), int(self.sym[r]))[0]
        if self.times is not None:
            carry.last_t = self.times[r]


def _end_frame(ends, keys, orders, sums=()) -> pd.DataFrame:
    cols: dict[str, list] = {k: [e[0][j] for e in ends] for j, k in enumerate(keys)}
    for o in orders:
        cols[o] = [None] * len(ends)
    for j, f in enumerate(STATUS_FIELDS):
        cols[f.name] = [e[1][j] for e in ends]
    for name in sums:
        cols[name] = [None] * len(ends)
    return pd.DataFrame(cols, dtype=object)


# ---------------------------------------------------------------------------
# one row per match
# ---------------------------------------------------------------------------

def match_cut(df: DataFrame, pattern: Pattern, partition_by, order_by, *,
              capture: Sequence[str] = (), on_ambiguity: str = "reference",
              where_key: Column | None = None, strategy: str = "auto",
              result: Callable[[dict], Column] | None = None,
              time_col: str | None = None, timeout: str | int | None = None) -> DataFrame:
    """Non-overlapping matches, earliest completion first.

    Output: key columns, ``match_no`` (1-based per key), ``start_<o>`` and
    ``end_<o>`` for each order column, ``n_events``, ``alt``, and for every
    kept step name ``s`` and captured column ``c`` a column ``s_c``: the
    value of ``c`` at the event taken as step ``s`` on the path that matched
    (the last one, if the step repeats; ``match_lists`` gives all), also for
    the columns of ``step(..., c=...)``.  A pattern with values (``map``,
    ``as_``, ``completed(v)``) gives a ``result`` column
    (``value_column``); ``result`` maps the captures to it instead.
    ``timeout``: as in ``match_events`` (P13).
    """
    df, partition_by, order_by = own_names(df, ["match_no", "n_events", "alt", "result"], _as_list(partition_by), _as_list(order_by))
    prep = _Prepared(df, pattern, partition_by, order_by, None, capture, where_key,
                     on_ambiguity, (), time_col, timeout, want_show=False)
    table = prep.table
    fields = [prep.field[c] for c in prep.keys] + [T.StructField("match_no", T.LongType())]
    for pre in ("start_", "end_"):
        for o in prep.orders:
            fields.append(T.StructField(pre + o, prep.field[o].dataType))
    fields += [T.StructField("n_events", T.LongType()), T.StructField("alt", T.StringType())]
    fields += [T.StructField(c.name, prep.df.schema[f"_cap{c.index}"].dataType) for c in prep.caps]
    tracked = Tracker(table, prep.caps)
    flagged = result is None and has_value(pattern)
    if flagged:
        fields.append(T.StructField("_flags", T.LongType()))
    schema = T.StructType(fields)
    from tidemark.plans import single
    pos = single.single_event_positions(pattern, table) if strategy != "plain" else None
    if pos is not None:
        out = single.cut(prep, pos, schema, strategy)
    elif strategy in ("auto", "block"):
        from tidemark.plans import blockscan
        out = blockscan.run(prep, "cut", schema, tracked=tracked, strategy=strategy)
    else:
        fn = _cut_kernel(tracked, prep.keys, prep.orders, schema.names, timeout=prep.timeout)
        out = map_frames(prep.sorted(), fn, schema)
    if result is not None:
        return out.withColumn("result", result(Captures(prep.named)))
    if not flagged:
        return out
    value = value_column(pattern, prep.named, lambda node, i: F.col("_flags").bitwiseAND(F.lit(table.flag(node, i))) != 0)
    return out.withColumn("result", value).drop("_flags")


def match_lists(df: DataFrame, pattern: Pattern, partition_by, order_by, columns: Sequence[str], *,
                on_ambiguity: str = "reference", where_key: Column | None = None, strategy: str = "auto",
                time_col: str | None = None, timeout: str | int | None = None) -> DataFrame:
    """All events of every match (O13): key columns, ``match_no``, ``n_events`` and
    ``events``, an array in order of structs of ``step`` (its number), ``label``
    (step name, several where an event was shared) and ``columns``.

    The status rows of one attempt are one group, so a match is gathered where
    its events are, and a key's matches are spread over tasks.
    """
    keys, orders = _as_list(partition_by), _as_list(order_by)
    cols = list(dict.fromkeys(columns))
    ev = match_events(df, pattern, keys, orders, final="none", on_ambiguity=on_ambiguity, where_key=where_key,
                      strategy=strategy, carry=cols, time_col=time_col, timeout=timeout)
    row = F.struct("step", "label", *[F.col(c) for c in cols])
    got = (ev.where(F.col("status").isin("INCOMPLETE", "SUCCESS")).groupBy(*keys, "attempt_id")
           .agg(F.sort_array(F.collect_list(row)).alias("events"),
                F.bool_or(F.col("status") == "SUCCESS").alias("_done")).where("_done"))
    from tidemark.plans.skew import keyed_window

    numbered = keyed_window(got, keys, ["attempt_id"], lambda d, part: d, row_number=True, strategy=strategy)
    return numbered.select(*keys, F.col("_rn").alias("match_no"), F.size("events").cast("long").alias("n_events"), "events")


def _cut_kernel(tracked: Tracker, keys, orders, names, blocks: bool = False,
                timeout: int | None = None):
    table = tracked.table
    branch_names = table.branch_names
    top_alt = table.top_is_alt
    gkeys = keys + (["_blk"] if blocks else [])
    nk, no, nc = len(keys), len(orders), tracked.n
    cap_names = names[nk + 1 + 2 * no + 2:]  # captures, then flags

    def kernel(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: _Carry | None = None
        gprev = None
        for pdf in it:
            n = len(pdf)
            if n == 0:
                continue
            newk, gcols = _group_starts(pdf, gkeys, gprev)
            batch = _Batch(table, pdf, newk, carry, blocks, timeout, no)
            # order and capture values are read only where a match starts or
            # ends: no per-row Python objects for them
            ocols = [pdf[o].to_numpy() for o in orders]
            ccols = _captured(pdf)

            def paths_at(c: _Carry, a: int, r: int, batch=batch, ccols=ccols) -> list[Registers]:
                """Registers after row ``r`` of the attempt that began on row ``a`` (-1: before)."""
                paths, i = (NONE, a) if a >= 0 else (c.paths, c.row)
                for i in range(i, r + 1):
                    paths = tracked.step(int(batch.before[i]), int(batch.sym[i]), paths, ccols, i)
                return paths

            won = np.flatnonzero(batch.code == SUCCESS)
            begun, ended = batch.begun.tolist(), 0
            mkeys: list[tuple] = []
            mnos: list[int] = []
            mstarts: list[tuple] = []
            mends: list[int] = won.tolist()
            msteps: list[int] = batch.step[won].tolist()
            malts: list = [branch_names[b] if top_alt else None for b in batch.branch[won].tolist()]
            mcaps: list[Registers] = []
            for j, i in enumerate(batch.firsts):
                if newk[i]:
                    gprev = tuple(_norm(c[i]) for c in gcols)
                    carry = batch.carries[j]
                    carry.key = gprev[:nk]
                carry.row = i
                end = batch.firsts[j + 1] if j + 1 < len(batch.firsts) else n
                while ended < len(mends) and mends[ended] < end:
                    r = mends[ended]
                    a = begun[r]
                    carry.match_no += 1
                    mkeys.append(carry.key)
                    mnos.append(carry.match_no)
                    mstarts.append(tuple(c[a] for c in ocols) if a >= 0 else carry.start)
                    if cap_names:
                        mcaps.append(paths_at(carry, a, r)[0])
                    ended += 1
                batch.leave(carry, end)
                if carry.state != START and end == n:  # the open attempt goes on in the next batch
                    a = begun[n - 1]
                    if tracked.on:
                        carry.paths = paths_at(carry, a, n - 1)
                    if a >= 0:
                        carry.start = tuple(c[a] for c in ocols)
            if mnos:
                out: dict[str, Any] = {}
                for j, k in enumerate(keys):
                    out[k] = _series([mk[j] for mk in mkeys], pdf[k].dtype)
                out["match_no"] = np.asarray(mnos, dtype=np.int64)
                idx = np.asarray(mends, dtype=np.int64)
                for j, o in enumerate(orders):
                    out[f"start_{o}"] = _series([st[j] for st in mstarts], pdf[o].dtype)
                for j, o in enumerate(orders):
                    out[f"end_{o}"] = ocols[j][idx]
                out["n_events"] = np.asarray(msteps, dtype=np.int64)
                out["alt"] = malts
                for j, c in enumerate(cap_names):
                    got = [m.values.get(j) if j < nc else m.flags for m in mcaps]
                    out[c] = pd.Series([_norm(v) for v in got], dtype=object)
                yield pd.DataFrame(out)

    return kernel


def _captured(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [pdf[c].to_numpy() for c in pdf.columns if c.startswith("_cap")]


# ---------------------------------------------------------------------------
# chained phases
# ---------------------------------------------------------------------------

def match_chain(df: DataFrame, patterns: Sequence[Pattern], partition_by, order_by, *,
                capture: Sequence[Sequence[str]] | None = None,
                strategy: str = "auto") -> DataFrame:
    """The matches of one pattern are the events of the next.

    Phase ``i+1`` reads phase ``i``'s ``match_cut`` rows, ordered by their
    ``end_<o>`` columns, under the same key.  ``capture[i]`` lists the
    columns phase ``i`` captures (phase ``i+1`` may capture any output
    column of phase ``i``).  A key hot in a later phase is hot in the first
    (a phase never has more rows per key than its input), so the plan is
    chosen once on the source and a chain of cold keys runs no detection
    on intermediate results (which would recompute them).
    """
    from tidemark.plans.skew import HotKeys

    keys, orders = _as_list(partition_by), _as_list(order_by)
    capture = list(capture) if capture is not None else [()] * len(patterns)
    if strategy == "auto":
        hot = bool(HotKeys(df, keys, orders))
        later = "auto" if hot else "plain"
    else:
        later = strategy
    out = df
    for i, p in enumerate(patterns):
        out = match_cut(out, p, keys, orders, capture=capture[i],
                        strategy=strategy if i == 0 else later)
        orders = [f"end_{o}" for o in orders]
    return out


# ---------------------------------------------------------------------------
# whole-input match
# ---------------------------------------------------------------------------

def match_whole(df: DataFrame, pattern: Pattern, partition_by, order_by, *,
                show: Column | None = None, where_key: Column | None = None,
                capture: Sequence[str] = (), result: Callable[[dict], Column] | None = None,
                strategy: str = "auto") -> DataFrame:
    """Does each key's whole ordered input match the pattern?

    No restart after a completion: an event after a finished match is an
    error.  One row per key: ``status`` SUCCESS or FAILURE, ``n_events``,
    ``fail_step`` (1-based index of the first event that could not be taken,
    NULL if the input ran out first), ``fail_expected``, ``fail_got``.

    ``capture``, ``result`` and the pattern's own columns and values as for
    ``match_cut``: the columns ``<step>_<c>`` and ``result``, NULL on failure.

    Hot keys: each block is walked once from every state at the same time
    (walks in the same state merge); a per-key fold over the block
    summaries gives the answer, so no second pass is needed.
    """
    from tidemark.plans.skew import HotKeys

    df, partition_by, order_by = own_names(df, ["status", "n_events", "fail_step", "fail_expected", "fail_got", "result"],
                                           _as_list(partition_by), _as_list(order_by))
    prep = _Prepared(df, pattern, partition_by, order_by, show, capture, where_key,
                     "reference", project=True)
    table = prep.table
    keys = prep.keys
    flagged = result is None and has_value(pattern)
    tracked = Tracker(table, prep.caps)
    fields = [prep.field[c] for c in keys] + [
        T.StructField("status", T.StringType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("fail_step", T.LongType()),
        T.StructField("fail_expected", T.StringType()),
        T.StructField("fail_got", T.StringType()),
    ] + [T.StructField(c.name, prep.df.schema[f"_cap{c.index}"].dataType) for c in prep.caps]
    if flagged:
        fields.append(T.StructField("_flags", T.LongType()))
    schema = T.StructType(fields)

    def valued(out: DataFrame) -> DataFrame:
        done = F.col("status") == "SUCCESS"
        if result is not None:
            return out.withColumn("result", F.when(done, result(Captures(prep.named))))
        if not flagged:
            return out
        value = value_column(pattern, prep.named, lambda node, i: F.col("_flags").bitwiseAND(F.lit(table.flag(node, i))) != 0)
        return out.withColumn("result", F.when(done, value)).drop("_flags")

    hk = None
    if strategy != "plain":
        hk = HotKeys(prep.src, keys, prep.orders, force=strategy == "block")
    kernel = _whole_kernel(tracked, keys, prep.has_show, schema.names, flagged)
    empty = dict(zip(schema.names[len(keys):], _whole_finish(tracked, (), START, 0, None, NONE, flagged)))
    if not hk:
        return valued(_or_if_empty(map_frames(prep.sorted(), kernel, schema), prep, schema, empty))
    cold, hot = hk.split(prep.df)
    out_cold = map_frames(cold.repartition(*keys).sortWithinPartitions(*keys, *prep.orders),
                          kernel, schema) if keys else None
    table.complete_open(lambda: table.symbols_in(hot))
    sum_schema = T.StructType([prep.field[c] for c in keys] + [
        T.StructField("_blk", T.LongType()), T.StructField("q", T.IntegerType()),
        T.StructField("end_q", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("fail_i", T.LongType()), T.StructField("fail_expected", T.StringType()),
        T.StructField("fail_got", T.StringType()), T.StructField("paths", T.BinaryType())])
    summary = map_frames(
        hot.withColumnRenamed("_sk_blk", "_blk")
        .repartition(*keys, "_blk").sortWithinPartitions(*keys, "_blk", *prep.orders),
        _whole_summary(tracked, keys, prep.has_show), sum_schema)
    group = keys if keys else [F.lit(0).alias("_all")]
    out_hot = apply_frames(
        summary.groupBy(*group), _whole_compose(tracked, keys, schema.names, flagged), schema)
    return valued(out_hot if out_cold is None else out_cold.unionByName(out_hot))


def _whole_finish(tracked: Tracker, key, state, n, fail, paths, flagged: bool):
    table = tracked.table
    nothing = (None,) * (tracked.n + flagged)
    if fail is not None:
        return key + ("FAILURE", n) + fail + nothing
    ways = table.accepting_paths(state)
    if ways == 1:
        i = table.accepting_index(state) if state != START else -1
        # without events only constants and choices of nothing have a value
        got = paths[i] if i >= 0 and tracked.on else NONE[0]
        captured = tuple(_norm(got.values.get(j)) for j in range(tracked.n))
        return key + ("SUCCESS", n, None, None, None) + captured + ((got.flags,) if flagged else ())
    exp = table.expected(state) if ways == 0 else "global ambiguity"
    return key + ("FAILURE", n, None, exp, "<end of input>") + nothing


def _whole_kernel(tracked: Tracker, keys, has_show: bool, names, flagged: bool):
    table = tracked.table

    def kernel(it):
        prev_key = None
        state, n_ev, fail, paths = START, 0, None, NONE
        for pdf in it:
            n = len(pdf)
            if n == 0:
                continue
            newk, kcols = _group_starts(pdf, keys, prev_key)
            sym = pdf["_sym"].to_numpy().tolist()
            shown = pdf["_show"].tolist() if has_show else None
            ccols = _captured(pdf)
            newk_l = newk.tolist()
            rows = []
            for i in range(n):
                if newk_l[i]:
                    if prev_key is not None:
                        rows.append(_whole_finish(tracked, prev_key, state, n_ev, fail, paths, flagged))
                    prev_key = tuple(_norm(c[i]) for c in kcols) if keys else ()
                    state, n_ev, fail, paths = START, 0, None, NONE
                n_ev += 1
                if fail is not None:
                    continue
                nxt = table.advance(state, sym[i])
                if nxt < 0:
                    fail = (n_ev, table.expected(state),
                            shown[i] if shown is not None else None)
                else:
                    if tracked.on:
                        paths = tracked.step(state, sym[i], paths, ccols, i, restart=False)
                    state = nxt
            if rows:
                yield records(rows, columns=names)
        if prev_key is not None:
            yield records(
                [_whole_finish(tracked, prev_key, state, n_ev, fail, paths, flagged)], columns=names)

    return kernel


def _whole_summary(tracked: Tracker, keys, has_show: bool):
    """Per (key, block) and start state: end state (-1 dead), rows, where and why
    the walk died, and the changes to the registers of its paths."""
    table = tracked.table
    gkeys = keys + ["_blk"]
    n_states = len(table.states)
    cols = list(keys) + ["_blk", "q", "end_q", "n", "fail_i", "fail_expected", "fail_got", "paths"]

    def flush(gkey, cur, fails, n, paths):
        out = []
        for q in range(n_states):
            f = fails.get(q)
            if f is not None:
                out.append(gkey + (q, -1, n) + f + (None,))
            else:
                out.append(gkey + (q, cur[q], n, None, None, None, dumped(paths[q]) if tracked.on else None))
        return out

    def kernel(it):
        gkey = None
        cur: list[int] = []
        fails: dict[int, tuple] = {}
        paths: list[list[Registers]] = []
        n = 0
        for pdf in it:
            if len(pdf) == 0:
                continue
            newk, gcols = _group_starts(pdf, gkeys, gkey)
            sym = pdf["_sym"].to_numpy().tolist()
            shown = pdf["_show"].tolist() if has_show else None
            ccols = _captured(pdf)
            newk_l = newk.tolist()
            rows = []
            for i in range(len(pdf)):
                if newk_l[i]:
                    if gkey is not None:
                        rows.extend(flush(gkey, cur, fails, n, paths))
                    gkey = tuple(_norm(c[i]) for c in gcols)
                    cur, fails, n = list(range(n_states)), {}, 0
                    paths = [unknown(table, q) if tracked.on else NONE for q in range(n_states)]
                    live = {q: [q] for q in range(n_states)}  # state -> start states
                n += 1
                y = sym[i]
                nxt_live: dict[int, list[int]] = {}
                for s_, starts in live.items():
                    t = table.advance(s_, y)
                    if t < 0:
                        f = (n, table.expected(s_), shown[i] if shown is not None else None)
                        for q in starts:
                            fails[q] = f
                    else:
                        nxt_live.setdefault(t, []).extend(starts)
                        if tracked.on:
                            for q in starts:
                                paths[q] = tracked.step(s_, y, paths[q], ccols, i, restart=False)
                live = nxt_live
                for s_, starts in live.items():
                    for q in starts:
                        cur[q] = s_
            if rows:
                yield records(rows, columns=cols)
        if gkey is not None:
            yield records(flush(gkey, cur, fails, n, paths), columns=cols)

    return kernel


def _whole_compose(tracked: Tracker, keys, names, flagged: bool):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_blk", "q"], kind="stable")
        key = tuple(_norm(pdf[k].iloc[0]) for k in keys)
        by_blk = {b: g for b, g in pdf.groupby("_blk", sort=True)}
        state, n, fail, paths = START, 0, None, NONE
        for b in sorted(by_blk):
            g = by_blk[b]
            nb = int(g["n"].iloc[0])
            if fail is None:
                r = g[g["q"] == state].iloc[0]
                if int(r["end_q"]) < 0:
                    fail = (n + int(r["fail_i"]), _norm(r["fail_expected"]),
                            _norm(r["fail_got"]))
                else:
                    state = int(r["end_q"])
                    if r["paths"] is not None:
                        paths = joined(paths, loaded(r["paths"]))
            n += nb
        return records([_whole_finish(tracked, key, state, n, fail, paths, flagged)], columns=names)

    return fn


# ---------------------------------------------------------------------------
# O14 / O15 helpers
# ---------------------------------------------------------------------------

def successes(events: DataFrame) -> DataFrame:
    """Keep SUCCESS rows only."""
    return events.filter(F.col("status") == "SUCCESS")


def failures(events: DataFrame) -> DataFrame:
    """Failures are data."""
    return events.filter(F.col("status") == "FAILURE")


def failure_summary(events: DataFrame) -> DataFrame:
    return (failures(events)
            .groupBy("fail_expected", "fail_got")
            .agg(F.count(F.lit(1)).alias("n_failures")))


__all__ = [
    "match_events", "match_cut", "match_lists", "match_chain", "match_whole", "successes",
    "failures", "failure_summary", "AMBIGUOUS", "INCOMPLETE",
]
