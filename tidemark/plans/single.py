"""Strategy S1 for one-event patterns: the matcher is a filter.

When every match is a single event (no step has a successor) and no event
can be taken by two branches at once (one step, or literals of one column
with distinct values), the cut matcher needs no state at all: each event
either matches (SUCCESS) or is spent (FAILURE), and the attempt number is
the event's row number in its key.  The plan is then JVM-only: the step
predicate is pushed into the scan, and the row number comes from the
skew-safe keyed window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.pattern import Pattern
from tidemark.plans.automaton import START, StepTable
from tidemark.plans.skew import HotKeys, keyed_window


def single_event_positions(pattern: Pattern, table: StepTable) -> list[int] | None:
    """Positions of a one-event, ambiguity-free pattern, else None."""
    n = len(table.positions) - 1
    if n == 0 or table.nullable:
        return None
    pos = list(range(1, n + 1))
    if any(table.follow[i] for i in pos) or set(table.follow[0]) != set(pos) \
            or set(table.last) != set(pos):
        return None
    if n == 1:
        return pos
    steps = pattern.steps()
    if len(steps) != n:
        return None
    cols = {s.column for s in steps}
    vals = [s.value for s in steps]
    if len(cols) != 1 or None in cols or None in vals:
        return None
    # values of one type only: 1 and 1.0 differ in writing, not for the data
    if len({type(v) for v in vals}) != 1 or any(v == w for i, v in enumerate(vals) for w in vals[:i]):
        return None
    return pos


def _pred(table: StepTable, i: int) -> Column:
    p = table.positions[i].pred
    return F.lit(False) if p < 0 else F.coalesce(table.predicates[p], F.lit(False))


def _raw_filter(table: StepTable, pos: list[int]) -> Column:
    """OR of the raw predicates: in a filter NULL drops the row just as
    false does, and the bare comparisons can be pushed into the scan."""
    preds = [table.predicates[table.positions[i].pred] for i in pos
             if table.positions[i].pred >= 0]
    if not preds:
        return F.lit(False)
    out = preds[0]
    for c in preds[1:]:
        out = out | c
    return out


def _source_layout(prep, strategy: str):
    """Hot-key layout of the unfiltered input (cached across queries)."""
    return HotKeys(prep.src, prep.keys, prep.orders) if strategy == "auto" else None  # cached probe


def cut(prep, pos: list[int], schema: T.StructType, strategy: str) -> DataFrame:
    table, keys, orders = prep.table, prep.keys, prep.orders
    any_ = F.lit(False)
    for i in pos:
        any_ = any_ | _pred(table, i)
    alt: Column = F.lit(None).cast("string")
    if table.top_is_alt:
        for i in reversed(pos):
            alt = F.when(_pred(table, i), F.lit(table.branch_names[table.positions[i].branch])) \
                .otherwise(alt)
    caps = []
    for c in prep.caps:
        hit = F.lit(False)
        for i in pos:
            if i in c.positions:
                hit = hit | _pred(table, i)
        caps.append(F.when(hit, prep.exprs[c.index]).alias(c.name))
    if "_flags" in schema.names:
        flags = F.lit(0)
        for i in reversed(pos):
            flags = F.when(_pred(table, i), F.lit(table.positions[i].took)).otherwise(flags)
        caps.append(flags.alias("_flags"))
    matched = (prep.src.filter(_raw_filter(table, pos))
               .select(*keys, *orders, alt.alias("alt"), *caps))
    numbered = keyed_window(matched, keys, orders, lambda d, part: d, row_number=True,
                            strategy=strategy, hot=_source_layout(prep, strategy))
    out = numbered.select(
        *keys, F.col("_rn").alias("match_no"),
        *[F.col(o).alias(f"start_{o}") for o in orders],
        *[F.col(o).alias(f"end_{o}") for o in orders],
        F.lit(1).cast("long").alias("n_events"), "alt",
        *[F.col(c) for c in schema.names[len(schema.names) - len(caps):]])
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def events(prep, pos: list[int], schema: T.StructType, final: str, show: Column | None,
           strategy: str) -> DataFrame:
    """Statuses of every event, and each key's end row emitted by its last
    event (one window pass: the last row explodes into itself and the end
    row), so the input is read once."""
    table, keys, orders = prep.table, prep.keys, prep.orders
    any_ = F.lit(False)
    for i in pos:
        any_ = any_ | _pred(table, i)
    label: Column = F.lit(None).cast("string")
    alt: Column = F.lit(None).cast("string")
    for i in reversed(pos):
        label = F.when(_pred(table, i), F.lit(table.positions[i].name)).otherwise(label)
        if table.top_is_alt:
            alt = F.when(_pred(table, i),
                         F.lit(table.branch_names[table.positions[i].branch])).otherwise(alt)
    expected = table.expected(START)
    rows = prep.src.select(
        *keys, *orders, *prep.carry,
        F.when(any_, F.lit("SUCCESS")).otherwise(F.lit("FAILURE")).alias("status"),
        F.lit(1).cast("int").alias("step"), alt.alias("alt"), label.alias("label"),
        F.when(~any_, F.lit(expected)).alias("fail_expected"),
        (F.when(~any_, show) if show is not None else F.lit(None)).cast("string")
        .alias("fail_got"))
    def last_flag(d: DataFrame, part: list[str]) -> DataFrame:
        # the key's last event: nothing follows it (one ordered window with
        # the row number; hot keys get a one-row look-ahead halo)
        w = Window.partitionBy(*part).orderBy(*orders)
        return d.withColumn("_last", F.lead(F.lit(1)).over(w).isNull())

    ends = final != "none"
    numbered = keyed_window(rows, keys, orders, last_flag if ends else (lambda d, part: d),
                            row_number=True, ahead=1 if ends else 0, strategy=strategy,
                            hot=_source_layout(prep, strategy))
    numbered = numbered.withColumnRenamed("_rn", "attempt_id")
    names = [f.name for f in schema.fields]
    if final == "none":
        return numbered.select(*names)
    ev_row = F.struct(*[F.col(c).cast(schema[c].dataType).alias(c) for c in names])
    if final == "ended":
        end_vals = {"status": F.lit("ENDED"), "attempt_id": F.lit(None),
                    "step": F.lit(0)}
    else:
        end_vals = {"status": F.lit("FAILURE"), "attempt_id": F.col("attempt_id") + 1,
                    "step": F.lit(0), "fail_expected": F.lit(expected),
                    "fail_got": F.lit("<end of input>")}
    end_row = F.struct(*[
        (F.col(c) if c in keys else end_vals.get(c, F.lit(None)))
        .cast(schema[c].dataType).alias(c) for c in names])
    both = F.when(F.col("_last"), F.array(ev_row, end_row)).otherwise(F.array(ev_row))
    return numbered.select(F.explode(both).alias("_r")).select("_r.*")
