"""Kernels on pandas frames that keep every value as it is.

``mapInPandas`` turns an integer column that holds a NULL into float64, which
rounds ids beyond 2^53, and times into nanoseconds, which end in 2262.  Here
such integers travel as objects and times as UTC microseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_MICROS = pa.timestamp("us")


def records(rows: list, columns: list[str]) -> pd.DataFrame:
    """Rows to a frame of objects: integers beside None stay integers."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


def _frame(table: pa.Table) -> pd.DataFrame:
    cols = [c.cast(_MICROS) if pa.types.is_timestamp(c.type) else c for c in table.columns]
    return pa.Table.from_arrays(cols, names=table.column_names).to_pandas(integer_object_nulls=True)


def _columns(pdf: pd.DataFrame, schema: pa.Schema) -> list[pa.Array]:
    out = []
    for f in schema:
        if pa.types.is_timestamp(f.type):
            out.append(pa.array(pdf[f.name], type=_MICROS, from_pandas=True).cast(f.type))
        else:
            out.append(pa.array(pdf[f.name], type=f.type, from_pandas=True))
    return out


def map_frames(df: DataFrame, fn: Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]],
               schema: T.StructType) -> DataFrame:
    """As ``df.mapInPandas(fn, schema)``."""
    target = to_arrow_schema(schema)

    def run(batches):
        for pdf in fn(_frame(pa.Table.from_batches([b])) for b in batches):
            yield pa.RecordBatch.from_arrays(_columns(pdf, target), schema=target)

    return df.mapInArrow(run, schema)


def apply_frames(grouped: GroupedData, fn: Callable[[pd.DataFrame], pd.DataFrame],
                 schema: T.StructType) -> DataFrame:
    """As ``grouped.applyInPandas(fn, schema)``."""
    target = to_arrow_schema(schema)

    def run(table):
        return pa.Table.from_arrays(_columns(fn(_frame(table)), target), schema=target)

    return grouped.applyInArrow(run, schema)
