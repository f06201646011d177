"""Windows and acknowledgements in a stream (P14, P16, P17; our definitions).

Under a watermark each gives a row out once the watermark has passed what could
still change it (append mode), so the output of a stream that has ended equals
the batch (``run_stream(operators=2)`` for cascading windows, which chain two).
``delay``: how far out of order rows may come.  ``end``: as in
``tidemark.streaming.stateful``.  Rows without a time are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.matcher import _as_list
from tidemark.operators.windows import duration_micros, time_number
from tidemark.streaming.fold import stream_fold
from tidemark.streaming.stateful import _sent, watermarked


def _length(d: str | int) -> str:
    return f"{duration_micros(d)} microseconds"


def _start(window: Column) -> Column:
    return F.unix_micros(window["start"]).alias("window_start")


def stream_windows(stream: DataFrame, time_col: str, length: str | int, slide: str | int | None = None, group_by: Sequence[str] = (),
                   aggs: Sequence[Column] = (), delay: str | int = 0, end: DataFrame | None = None) -> DataFrame:
    """``aggs`` by ``group_by`` and tumbling windows, or windows of ``length`` every
    ``slide``; ``window_start`` in epoch microseconds."""
    ev = watermarked(stream, time_number(time_col, stream), delay, end)
    win = F.window("_wm", _length(length), None if slide is None else _length(slide))
    out = ev.groupBy(win.alias("_win"), *group_by).agg(*aggs, F.bool_or("_end").alias("_last")).where("not _last")
    names = [c for c in out.columns if c not in ("_win", "_last")]
    return out.select(*names, _start(F.col("_win")))


def stream_cascading(stream: DataFrame, time_col: str, fine: str | int, coarse: str | int, group_by: Sequence[str] = (),
                     delay: str | int = 0, end: DataFrame | None = None) -> DataFrame:
    """Coarse windows over the results of fine windows: two chained aggregates, the
    second by the event time that Spark keeps for a closed fine window."""
    ev = watermarked(stream, time_number(time_col, stream), delay, end)
    small = (ev.groupBy(F.window("_wm", _length(fine)).alias("_w"), *group_by)
             .agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_end").alias("_last")))
    out = (small.groupBy(F.window(F.window_time("_w"), _length(coarse)).alias("_c"), *group_by)
           .agg(F.sum("_n").cast("long").alias("n_events"), F.max("_n").cast("long").alias("max_fine"),
                F.count(F.lit(1)).cast("long").alias("n_fine"), F.bool_or("_last").alias("_last")).where("not _last"))
    return out.select(*group_by, "n_events", "max_fine", "n_fine", _start(F.col("_c")))


def stream_first_after(stream: DataFrame, a: Column, b: Column, partition_by, order_by, cols: Sequence[str], time_col: str,
                       within: str | int, delay: str | int = 0, end: DataFrame | None = None) -> DataFrame:
    """Every A event with the first later B event of its key (``next_<c>`` columns)
    that comes within ``within``; NULL if none did.

    Output: key and order columns of the A event, ``next_<c>``.  A key's state is its open
    A events (and the rows that wait): a B event closes them all, and those too old
    for one are given out open, at the next event or once the watermark tells that
    none can come.  A stream-stream join would keep every B event too and need
    an aggregate after it to find the first.  Timestamps come as epoch micros.
    """
    keys, orders, cols = _as_list(partition_by), _as_list(order_by), list(dict.fromkeys(cols))
    limit = duration_micros(within)
    isa, isb = (F.coalesce(x, F.lit(False)) for x in (a, b))
    ev = stream.where(isa | isb).select("*", isa.alias("_isa"), isb.alias("_isb"), time_number(time_col, stream).alias("_at"))

    def sent(c: str) -> T.StructField:
        return T.StructField(c, _sent(stream, c)[1])

    schema = T.StructType([sent(o) for o in orders] + [T.StructField(f"next_{c}", sent(c).dataType) for c in cols])

    def step(waiting: list, row: dict) -> tuple[list, list]:
        out = [w[1] + (None,) * len(cols) for w in waiting if row["_at"] - w[0] > limit]
        waiting = [w for w in waiting if row["_at"] - w[0] <= limit]
        if row["_isb"]:
            out += [w[1] + tuple(row[c] for c in cols) for w in waiting]
            waiting = []
        if row["_isa"]:
            waiting = [*waiting, (row["_at"], tuple(row[o] for o in orders))]
        return waiting, out

    return stream_fold(ev, keys, orders, list(dict.fromkeys([*orders, *cols, "_at", "_isa", "_isb"])), list, step,
                       lambda waiting: [w[1] + (None,) * len(cols) for w in waiting], schema, time_col, idle=within, delay=delay, end=end)
