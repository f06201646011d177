"""Stateful fold in a stream (P12; our definition).

A key's state is the user's state and the rows that may still be overtaken, those
within ``delay`` of the watermark; rows are folded in order once it has passed them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.matcher import _as_list
from tidemark.operators.windows import duration_micros, time_number
from tidemark.streaming.stateful import LAST_MICROS, _clamped, _plain, _sent, watermarked

_STATE = T.StructType([T.StructField("state", T.BinaryType()), T.StructField("last_t", T.LongType()), T.StructField("waiting", T.BinaryType())])


def stream_fold(stream: DataFrame, partition_by, order_by, columns: Sequence[str], init: Callable[[], Any],
                step: Callable[[Any, dict], tuple[Any, list]], end_hook: Callable[[Any], list], schema: T.StructType, time_col: str, *,
                idle: str | int | None = None, delay: str | int = 0, end: DataFrame | None = None) -> DataFrame:
    """``sequential.fold`` over a stream: ``state, rows = step(state, row)`` per key, in order.

    ``end_hook(state)`` is called, and the state dropped, when a key has had no event for
    ``idle`` (the next one starts anew), and for all keys where the stream ends
    (``end``).  Emitted rows are tuples for ``schema`` without the key columns, which are
    prepended.  Timestamps come as epoch micros.  The state must pickle.  ``delay``: how
    far out of order rows may come.  Rows without a time are left out.
    """
    keys, orders = _as_list(partition_by), _as_list(order_by)
    cols = list(dict.fromkeys(columns))
    gap = None if idle is None else duration_micros(idle)
    sent, fields = [], []
    for i, k in enumerate(keys):
        col, dt = _sent(stream, k)
        sent.append(col.alias(f"_k{i}"))
        fields.append(T.StructField(k, dt))
    for pre, names in (("o", orders), ("c", cols)):
        sent += [_sent(stream, c)[0].alias(f"_{pre}{i}") for i, c in enumerate(names)]
    t = time_number(time_col, stream)
    ev = watermarked(stream.select(*sent, t.cast("decimal(20,0)").alias("_t")), F.col("_t").cast("long"), delay, end)
    group = [f"_k{i}" for i in range(len(keys))]
    out = T.StructType([*fields, *schema.fields])
    names = out.names

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        key = tuple(_plain(k) for k in key)
        now = state.getCurrentWatermarkMs()
        st, last, waiting = init(), None, []
        if state.exists:
            st, last, waiting = pickle.loads(state.get[0]), state.get[1], pickle.loads(state.get[2])
        for pdf in pdfs if not state.hasTimedOut else ():
            pdf = pdf[~pdf["_end"].astype(bool)]
            col = {c: [_plain(v) for v in pdf[c]] for c in pdf.columns if c not in ("_wm", "_end")}
            for i in range(len(pdf)):
                waiting.append((tuple(col[f"_o{j}"][i] for j in range(len(orders))), col["_t"][i],
                                {c: col[f"_c{j}"][i] for j, c in enumerate(cols)}))
        if not waiting and not state.exists:
            return
        rows = []

        def ended():
            return [key + tuple(r) for r in end_hook(st)]

        # NULLs first, as Spark sorts
        ready = sorted((r for r in waiting if _clamped(r[1]) < now * 1000), key=lambda r: tuple((v is not None, v) for v in r[0]))
        waiting = [r for r in waiting if _clamped(r[1]) >= now * 1000]
        for _, t, row in ready:
            if gap is not None and last is not None and t - last > gap:
                rows += ended()
                st = init()
            st, emitted = step(st, row)
            rows += [key + tuple(r) for r in emitted]
            last = t
        # no row within the gap can come any more; without a gap, once the stream has ended
        until = None if last is None else LAST_MICROS if gap is None else min(LAST_MICROS, _clamped(last + gap))
        if until is not None and not waiting and until < now * 1000:
            rows += ended()
            state.remove()
        else:
            state.update((pickle.dumps(st), last, pickle.dumps(waiting)))
            at = [_clamped(r[1]) for r in waiting] + ([until] if until is not None else [])
            state.setTimeoutTimestamp(max(min(at) // 1000 + 1, now + 1))
        if rows:
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return ev.groupBy(*group).applyInPandasWithState(fn, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
