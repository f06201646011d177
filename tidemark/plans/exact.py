"""Exact running sums of doubles.

A double is a whole multiple of 2^-1074, so sums and differences of doubles are
exact in whole numbers of that unit: what enters a range and leaves it again
leaves nothing behind, the order of additions doesn't matter, and the result is
rounded once.  NaN and infinities are counted apart.  The state is one number
per sum, whatever the range.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.plans.frames import _frame, apply_frames, records
from tidemark.plans.skew import HotKeys, broadcast_blocks

_UNIT = 1 << 1074


class Sum:
    """Exact sum of doubles that can be taken away again."""

    __slots__ = ("units", "nan", "up", "down")

    def __init__(self, units: int = 0, nan: int = 0, up: int = 0, down: int = 0):
        self.units, self.nan, self.up, self.down = units, nan, up, down

    def add(self, v: float, sign: int) -> None:
        if v != v:
            self.nan += sign
        elif v in (math.inf, -math.inf):
            if v > 0:
                self.up += sign
            else:
                self.down += sign
        elif v:
            n, d = v.as_integer_ratio()
            self.units += sign * (n << 1075 - d.bit_length())

    def value(self) -> float:
        if self.nan or (self.up and self.down):
            return math.nan
        if self.up or self.down:
            return math.inf if self.up else -math.inf
        try:
            return self.units / _UNIT
        except OverflowError:
            return math.inf if self.units > 0 else -math.inf

    def plain(self) -> tuple:
        return self.units, self.nan, self.up, self.down

    def plus(self, other: tuple) -> "Sum":
        return Sum(*[a + b for a, b in zip(self.plain(), other)])


def _kernel(keys: list[str], gkeys: list[str], n: int, blocks: bool, summary: bool):
    """Rows (keys, t, left, v0..) in order of (t, left): the sums at every time at which a
    row enters, or with ``summary`` the sums of every block."""
    from tidemark.operators.matcher import _group_starts, _norm

    def kernel(it):
        gkey, at, pending = None, None, False
        sums: list[Sum] = []

        def row():
            return gkey[:len(keys)] + (at,) + tuple(s.value() for s in sums)

        for b in it:
            if b.num_rows == 0:
                continue
            if gkeys:
                newk, gcols = _group_starts(_frame(pa.Table.from_batches([b]).select(gkeys)), gkeys, gkey)
            else:
                newk, gcols = np.arange(b.num_rows) < (gkey is None), []
            col = {c: b.column(c).to_pylist() for c in b.schema.names if c not in gkeys}  # NaN is no NULL here
            t, left = col["t"], col["left"]
            vals = [col[f"v{j}"] for j in range(n)]
            marks = col.get("_m_sums")
            out = []
            for i, fresh in enumerate(newk.tolist()):
                if fresh or t[i] != at or left[i]:
                    if pending and not summary:
                        out.append(row())
                    pending = False
                if fresh:
                    if gkey is not None and summary:
                        out.append(gkey + (pickle.dumps([s.plain() for s in sums]),))
                    gkey = tuple(_norm(c[i]) for c in gcols)
                    sums = [Sum(*p) for p in pickle.loads(marks[i])] if blocks else [Sum() for _ in range(n)]
                at = t[i]
                sign = -1 if left[i] else 1
                pending = pending or not left[i]
                for s, values in zip(sums, vals):
                    if values[i] is not None:
                        s.add(values[i], sign)
            if out:
                yield out
        if gkey is not None:
            if summary:
                yield [gkey + (pickle.dumps([s.plain() for s in sums]),)]
            elif pending:
                yield [row()]

    return kernel


def _mapped(df: DataFrame, kernel, schema: T.StructType) -> DataFrame:
    """``kernel`` from Arrow batches to lists of rows, NaN kept apart from NULL."""
    target = to_arrow_schema(schema)

    def run(batches):
        for rows in kernel(batches):
            cols = [pa.array(list(c), f.type, from_pandas=not pa.types.is_floating(f.type)) for c, f in zip(zip(*rows), target)]
            yield pa.RecordBatch.from_arrays(cols, schema=target)

    return df.mapInArrow(run, schema)


def range_sums(steps: DataFrame, keys: list[str], n: int, strategy: str) -> DataFrame:
    """(keys, t, v0..): sums of doubles after every time at which a row enters.

    ``steps``: keys, ``t``, ``left`` (0 enters, 1 leaves) and the values ``v0``.., NULLs
    counting as 0.  Hot keys are cut into blocks of (t, left), whose own sums
    give each block what it begins with.
    """
    orders = ["t", "left"]
    key_fields = [steps.schema[k] for k in keys]
    values = [f"v{j}" for j in range(n)]
    schema = T.StructType([*key_fields, steps.schema["t"], *[T.StructField(v, T.DoubleType()) for v in values]])

    def plain(d: DataFrame) -> DataFrame:
        part = (d.repartition(*keys) if keys else d.repartition(1)).sortWithinPartitions(*keys, *orders)
        return _mapped(part, _kernel(keys, keys, n, False, False), schema)

    hk = None if strategy == "plain" else HotKeys(steps, keys, orders, force=strategy == "block")
    if not hk:
        return plain(steps)
    cold, hot = hk.split(steps)
    gkeys = [*keys, "_sk_blk"]
    part = hot.repartition(*gkeys).sortWithinPartitions(*gkeys, *orders)
    sums = T.StructType([*key_fields, T.StructField("_sk_blk", T.LongType()), T.StructField("_m_sums", T.BinaryType())])

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_sk_blk", kind="stable")
        key, now, out = tuple(pdf[k].iloc[0] for k in keys), [Sum() for _ in range(n)], []
        for blk, data in zip(pdf["_sk_blk"].tolist(), pdf["_m_sums"].tolist()):
            out.append(key + (int(blk), pickle.dumps([s.plain() for s in now])))
            now = [s.plus(p) for s, p in zip(now, pickle.loads(data))]
        return records(out, sums.names)

    own = _mapped(part, _kernel(keys, gkeys, n, False, True), sums)
    marks = apply_frames(own.groupBy(*(keys or [F.lit(0).alias("_all")])), before, sums)
    marks = broadcast_blocks(marks.select(*[F.col(c).alias(f"_sk_h{i}") for i, c in enumerate(gkeys)], "_m_sums"), hk.n_blocks)
    same = [part[c].eqNullSafe(marks[f"_sk_h{i}"]) for i, c in enumerate(gkeys)]
    walked = part.join(marks, same).select(*[part[c] for c in part.columns], "_m_sums").sortWithinPartitions(*gkeys, *orders)
    out = _mapped(walked, _kernel(keys, gkeys, n, True, False), schema)
    return plain(cold).unionByName(out) if keys else out
