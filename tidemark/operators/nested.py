"""Nested depth (O21) as per-event statuses and as a whole-input match.

The pattern is ``S = open S close | empty``, its value the depth.  It is a
counter, not a finite table: START takes an opening event; UP(d) climbs with
opening events and turns with a closing one; DOWN(d) takes closing events
only; the match ends where the depth is back to 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.matcher import _as_list, _group_starts, _norm
from tidemark.plans import nestscan
from tidemark.plans.automaton import FAILURE, INCOMPLETE, STATUS_NAMES, SUCCESS
from tidemark.plans.frames import map_frames, records
from tidemark.plans.nestscan import CLOSE, OPEN
from tidemark.plans.skew import HotKeys, keyed_window

END = "<end of input>"


def symbol(open_: Column, close: Column) -> Column:
    return (F.when(F.coalesce(open_, F.lit(False)), F.lit(OPEN))
            .when(F.coalesce(close, F.lit(False)), F.lit(CLOSE)).otherwise(F.lit(0)))


class _State:
    """The walk of one key: phase 0 start, 1 up, 2 down."""

    __slots__ = ("key", "phase", "depth", "peak", "steps", "attempt")

    def __init__(self, key, phase=0, depth=0, peak=0, steps=0, attempt=0):
        self.key, self.phase, self.depth, self.peak, self.steps, self.attempt = key, phase, depth, peak, steps, attempt


class _Marks:
    """Statuses of a batch, written a run of equal events at a time."""

    def __init__(self, n: int):
        self.status = np.zeros(n, np.int8)
        self.attempt = np.zeros(n, np.int64)
        self.step = np.zeros(n, np.int64)
        self.depth = np.full(n, -1, np.int64)
        self.expected = np.zeros(n, np.int8)  # 0 none, 1 open, 2 both, 3 close

    def _put(self, st: _State, a: int, b: int) -> None:
        """Events of the open attempt."""
        self.status[a:b] = INCOMPLETE
        self.attempt[a:b] = st.attempt
        self.step[a:b] = st.steps + 1 + np.arange(b - a)
        st.steps += b - a

    def _spent(self, st: _State, a: int, b: int) -> None:
        """Events that can't start an attempt: each fails on its own."""
        self.status[a:b] = FAILURE
        self.attempt[a:b] = st.attempt + 1 + np.arange(b - a)
        self.step[a:b] = 1
        self.expected[a:b] = 1
        st.attempt += b - a

    def _climb(self, st: _State, a: int, b: int) -> None:
        if a < b:
            if st.phase == 0:
                st.phase, st.depth, st.steps, st.attempt = 1, 0, 0, st.attempt + 1
            self._put(st, a, b)
            st.depth += b - a
            st.peak = st.depth

    def run(self, st: _State, sym: int, a: int, b: int) -> None:
        """Events ``a`` to ``b``, all of the kind ``sym``."""
        if sym == OPEN and st.phase < 2:
            self._climb(st, a, b)
        elif st.phase == 0:
            self._spent(st, a, b)
        elif sym == CLOSE:
            c = min(b, a + st.depth)
            self._put(st, a, c)
            st.depth -= c - a
            st.phase = 2
            if st.depth == 0:
                self.status[c - 1], self.depth[c - 1] = SUCCESS, st.peak
                st.phase = 0
                self._spent(st, c, b)
        else:  # the event fails the attempt and is spent
            self._put(st, a, a + 1)
            self.status[a], self.expected[a] = FAILURE, 2 if st.phase == 1 else 3
            st.phase = 0
            if sym == OPEN:
                self._climb(st, a + 1, b)
            else:
                self._spent(st, a + 1, b)


def _kernel(keys: list[str], gkeys: list[str], orders: list[str], names: tuple[str, str], columns: list[str], final: str, blocks: bool):
    expected = np.array([None, names[0], ",".join(sorted(names)), names[1]], dtype=object)
    status = np.array(STATUS_NAMES, dtype=object)

    def end(st: _State) -> tuple:
        return st.key + (None,) * len(orders) + end_values(final, names, st.phase, st.steps, st.attempt)

    def kernel(it):
        prev, st = None, None
        for pdf in it:
            n = len(pdf)
            if n == 0:
                continue
            newk, gcols = _group_starts(pdf, gkeys, prev)
            sym = pdf["_sym"].to_numpy().astype(np.int64)
            change = newk.copy()
            change[0] = True
            change[1:] |= sym[1:] != sym[:-1]
            cuts = [*np.flatnonzero(change).tolist(), n]
            out, ends = _Marks(n), []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if newk[a]:
                    if st is not None and not blocks and final != "none":
                        ends.append(end(st))
                    prev = tuple(_norm(c[a]) for c in gcols)
                    st = _State(prev[:len(keys)])
                    if blocks:
                        st = _State(st.key, *(int(pdf[f"_m_{x}"].iat[a]) for x in ("phase", "d", "peak", "steps", "att")))
                out.run(st, int(sym[a]), a, b)
            failed = out.status == FAILURE
            shown = pdf["_show"].to_numpy(dtype=object) if "_show" in pdf.columns else np.full(n, None, dtype=object)
            yield pd.DataFrame({
                **{c: pdf[c].to_numpy(dtype=object) for c in keys + orders}, "status": status[out.status], "attempt_id": out.attempt,
                "step": out.step, "depth": np.where(out.depth < 0, None, out.depth.astype(object)),
                "fail_expected": expected[out.expected], "fail_got": np.where(failed, shown, None)})
            if ends:
                yield records(ends, columns)
        if st is not None and not blocks and final != "none":
            yield records([end(st)], columns)

    return kernel


def end_values(final: str, names: tuple[str, str], phase: int, steps: int, attempt: int) -> tuple:
    """status, attempt_id, step, depth, fail_expected, fail_got of a key's end row."""
    if final == "ended":
        return "ENDED", None, steps if phase else 0, None, None, None
    if phase == 0:
        return "SUCCESS", attempt + 1, 0, 0, None, None
    return "FAILURE", attempt, steps, None, names[1], END


def nested_events(df: DataFrame, open_: Column, close: Column, partition_by, order_by, *, show: Column | None = None,
                  names: Sequence[str] = ("(", ")"), final: str = "ended", strategy: str = "auto") -> DataFrame:
    """One status row per event, and one end row per key, of the nested pattern.

    Output: key and order columns, ``status``, ``attempt_id``, ``step``, ``depth`` (of a
    SUCCESS), ``fail_expected`` (``names`` of the events that could go on, sorted) and
    ``fail_got`` (``show``).  ``final`` as for ``match_events``: 'complete' gives the empty
    match of depth 0 at the end of a key without an open attempt, else a FAILURE
    that expects the closing event.  Hot keys are cut into blocks.
    """
    if final not in ("ended", "complete", "none"):
        raise ValueError("final must be 'ended', 'complete' or 'none'")
    keys, orders, names = _as_list(partition_by), _as_list(order_by), tuple(names)
    extra = [] if show is None else ["_show"]
    src = df.select(*keys, *orders, symbol(open_, close).alias("_sym"), *([] if show is None else [show.cast("string").alias("_show")]))
    new = [("status", T.StringType()), ("attempt_id", T.LongType()), ("step", T.LongType()), ("depth", T.LongType()),
           ("fail_expected", T.StringType()), ("fail_got", T.StringType())]
    schema = T.StructType([df.schema[c] for c in keys + orders] + [T.StructField(n, t) for n, t in new])

    def plain(d: DataFrame) -> DataFrame:
        part = (d.repartition(*keys) if keys else d.repartition(1)).sortWithinPartitions(*keys, *orders)
        out = map_frames(part, _kernel(keys, keys, orders, names, schema.names, final, False), schema)
        if keys or final == "none":
            return out
        # keyless input without events is one key all the same
        none = df.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
        values = dict(zip([n for n, _ in new], end_values(final, names, 0, 0, 0)))
        return out.unionByName(none.select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]))

    hk = None if strategy == "plain" else HotKeys(df, keys, orders, force=strategy == "block")
    if not hk:
        return plain(src)
    cold, hot = hk.split(src)
    walked, ends = nestscan.scan(df, hot, keys, orders, hk.n_blocks, extra)
    out = map_frames(walked, _kernel(keys, [*keys, "_sk_blk"], orders, names, schema.names, final, True), schema)
    if final != "none":
        open_now = F.col("_m_phase") > 0
        if final == "ended":
            values = {"status": F.lit("ENDED"), "step": F.when(open_now, F.col("_m_steps")).otherwise(0)}
        else:
            values = {"status": F.when(open_now, "FAILURE").otherwise("SUCCESS"), "step": F.when(open_now, F.col("_m_steps")).otherwise(0),
                      "attempt_id": F.col("_m_att") + F.when(open_now, 0).otherwise(1), "depth": F.when(~open_now, 0),
                      "fail_expected": F.when(open_now, F.lit(names[1])), "fail_got": F.when(open_now, F.lit(END))}
        last = ends.select(*keys, *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields[len(keys):]])
        out = out.unionByName(last)
    return plain(cold).unionByName(out) if keys else out


def nested_whole(df: DataFrame, open_: Column, close: Column, partition_by, order_by, *, show: Column | None = None,
                 names: Sequence[str] = ("(", ")"), strategy: str = "auto") -> DataFrame:
    """Is each key's whole input one nested match?  (No restart after a completion.)

    Output: key columns, ``status``, ``depth``, ``n_events``, ``fail_step`` (first event that
    couldn't be taken, NULL if the input ran out), ``fail_expected``, ``fail_got``.
    The match is u opening events and then u closing ones, so three numbers of a
    key decide: its events, the first that isn't opening, and the first after that
    which isn't closing.  They are plain aggregates over row numbers, so a hot
    key is no task of its own.  Keyless input without events matches with depth 0.
    """
    keys, orders = _as_list(partition_by), _as_list(order_by)
    hk = HotKeys(df, keys, orders) if strategy == "auto" else None
    src = df.select(*keys, *orders, symbol(open_, close).alias("_sym"), *([] if show is None else [show.cast("string").alias("_show")]))

    def op(d: DataFrame, part: list[str]) -> DataFrame:
        return d.withColumn("_prev", F.lag("_sym").over(Window.partitionBy(*part).orderBy(*orders)))

    rows = keyed_window(src, keys, orders, op, behind=1, row_number=True, strategy=strategy, hot=hk)
    sym, rn = F.col("_sym"), F.col("_rn")
    # every event before the first that isn't opening is opening, so an opening
    # event after another kind, or one of no kind, is the first that isn't closing
    other = (sym == 0) | ((sym == OPEN) & (F.col("_prev") != OPEN))
    got = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(sym != OPEN, rn)).alias("_a"), F.min_by(sym, F.when(sym != OPEN, rn)).alias("_as"),
        F.min(F.when(other, rn)).alias("_x"))
    n, up = F.col("_n"), F.coalesce(F.col("_a") - 1, F.col("_n"))
    got = got.withColumn("_u", up)
    u = F.col("_u")
    at = (F.when(n == 0, F.lit(None))
          .when(u == 0, F.lit(1))
          .when(F.col("_as") == 0, F.col("_a"))
          .otherwise(F.least(F.col("_x"), F.when(n > 2 * u, 2 * u + 1))))
    got = got.withColumn("fail_step", at.cast("long"))
    step, (opening, closing) = F.col("fail_step"), names
    expected = (F.when(step.isNull() & (n < 2 * u), closing)
                .when(step.isNull(), F.lit(None))
                .when(u == 0, opening)
                .when(step == u + 1, ",".join(sorted(names)))
                .when(step <= 2 * u, closing))
    done = step.isNull() & (n == 2 * u)
    out = got.select(*keys, F.when(done, "SUCCESS").otherwise("FAILURE").alias("status"), F.when(done, u).cast("long").alias("depth"),
                     n.cast("long").alias("n_events"), "fail_step", expected.cast("string").alias("fail_expected"),
                     F.when(~done & step.isNull(), F.lit(END)).alias("_end"))
    if show is None:
        return out.withColumn("fail_got", F.col("_end")).drop("_end")
    seen = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_rn", "_show")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = out.join(seen, [*same, F.col("fail_step") == F.col("_rn")], "left")
    return joined.select(*keys, "status", "depth", "n_events", "fail_step", "fail_expected", F.coalesce("_end", "_show").alias("fail_got"))
