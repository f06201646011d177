"""Full patterns where any event may start a match, and in windows.

The functions of ``tidemark.operators.windows`` come here when they are given a
``Pattern`` instead of predicates.  An attempt is tried from every event, by the
rules of the cut matcher: the first event on which exactly one path ends is the
match.  Matches may overlap; each event starts one match at most.  All of them
are our definition: the reference only sketches these operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.pattern import Pattern, step
from tidemark.functions.reverse import reversed_pattern
from tidemark.operators.matcher import _as_list
from tidemark.plans import spans
from tidemark.plans.automaton import StepTable
from tidemark.plans.skew import HotKeys, keyed_window


def _same(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[Column]:
    return [a[f"`{x}`"].eqNullSafe(b[f"`{y}`"]) for x, y in pairs]


def _later(df: DataFrame, keys: list[str], orders: list[str], strategy: str) -> str:
    """Plan of steps over results: no key has more matches than events, so where no key of
    the input is hot none is later, and no statistics of results are needed."""
    if strategy != "auto":
        return strategy
    return "auto" if HotKeys(df, keys, orders) else "plain"


def match_every(df: DataFrame, pattern: Pattern, partition_by, order_by, *, time_col: str | None = None,
                max_gap: str | int | None = None, keep: Sequence[str] = (), on_ambiguity: str = "reference",
                strategy: str = "auto") -> DataFrame:
    """Every event may start a match.

    Output: key columns; ``start_<c>`` and ``end_<c>``, each order and ``keep`` column at
    the match's first and last event; ``n_events``.  With ``max_gap`` an attempt ends
    where the next event comes later than that (a NULL time is never late).
    """
    from tidemark.operators.windows import duration_micros, time_number

    if max_gap is not None and time_col is None:
        raise ValueError("max_gap needs time_col")
    return spans.starts(df, StepTable(pattern, on_ambiguity), _as_list(partition_by), _as_list(order_by), keep,
                        None if max_gap is None else time_number(time_col, df),
                        None if max_gap is None else duration_micros(max_gap), strategy)


def in_last_n(df: DataFrame, pattern: Pattern, n: int, partition_by, order_by, strategy: str = "auto") -> DataFrame:
    """``hit`` is 1 at events with a match wholly within the last ``n`` events.

    Of the matches that end on an event the shortest counts; one of length m that
    ended d events ago lies within the last n where d + m <= n.
    """
    keys, orders = _as_list(partition_by), _as_list(order_by)
    found = match_every(df, pattern, keys, orders, strategy=strategy)
    ends = found.groupBy(*keys, *[F.col(f"end_{o}") for o in orders]).agg(F.min("n_events").alias("_len"))
    rows = df.join(ends, _same(df, ends, [(k, k) for k in keys] + [(o, f"end_{o}") for o in orders]), "left").select(
        *[df[f"`{c}`"] for c in df.columns], ends["_len"])

    def op(d: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*orders).rowsBetween(1 - n, 0)
        near = F.min(F.col("_len") - F.col("_rn")).over(w) <= F.lit(n) - F.col("_rn")
        return d.withColumn("hit", F.coalesce(near, F.lit(False)).cast("int"))

    hot = HotKeys(df, keys, orders) if strategy == "auto" else None
    return keyed_window(rows, keys, orders, op, behind=max(n - 1, 0), row_number=True, strategy=strategy,
                        hot=hot).select(*df.columns, "hit")


def _div(a: Column, b: int) -> Column:
    """Floor of a / b in whole numbers."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def window_contains(df: DataFrame, pattern: Pattern, partition_by, order_by, time_col: str, length: str | int = "1d",
                    slide: str | int | None = None, strategy: str = "auto") -> DataFrame:
    """``n_matches`` that lie wholly inside each window of ``length`` every ``slide``
    (none: windows side by side), for windows that hold one.

    A match is in the windows of a run of slides: it adds one where the run starts
    and takes it away after its end, and a running total over these changes
    gives every window's count, so no match is copied to each of its windows.
    Windows are aligned to the epoch, ``window_start`` in microseconds.
    """
    from tidemark.operators.windows import _running_totals, duration_micros, time_number

    keys, orders = _as_list(partition_by), _as_list(order_by)
    size = duration_micros(length)
    by = size if slide is None else duration_micros(slide)
    if not 0 < by <= size:
        raise ValueError("slide must be positive and at most the length")
    later = _later(df, keys, orders, strategy)
    found = match_every(df, pattern, keys, orders, keep=[time_col], strategy=strategy)
    t0, t1 = (time_number(F.col(f"`{p}_{time_col}`"), dtype=df.schema[time_col].dataType) for p in ("start", "end"))
    runs = found.select(*keys, (_div(t1 - size, by) + 1).alias("_a"), _div(t0, by).alias("_b")).where("_a <= _b")
    change = F.explode(F.array(F.struct(F.col("_a").alias("k"), F.lit(1).cast("long").alias("d")),
                               F.struct((F.col("_b") + 1).alias("k"), F.lit(-1).cast("long").alias("d"))))
    changes = (runs.select(*keys, change.alias("_c")).groupBy(*keys, F.col("_c.k").alias("_k"))
               .agg(F.sum("_c.d").alias("_d")).where("_d <> 0"))
    total = _running_totals(changes, keys, ["_k"], ["_d"], later)

    def until(d: DataFrame, part: list[str]) -> DataFrame:
        return d.withColumn("_to", F.lead("_k").over(Window.partitionBy(*part).orderBy("_k")))

    total = keyed_window(total, keys, ["_k"], until, ahead=1, strategy=later).where("_d > 0")
    at = F.explode(F.sequence("_k", F.col("_to") - 1))
    return total.select(*keys, at.alias("_k"), F.col("_d").alias("n_matches")).select(
        *keys, (F.col("_k") * by).alias("window_start"), "n_matches")


def window_edges(df: DataFrame, first: Pattern, last: Pattern, partition_by, order_by, time_col: str,
                 length: str | int = "1d", strategy: str = "auto") -> DataFrame:
    """Per key and window, do its first events match ``first`` (``starts_with``) and
    its last events match ``last`` (``ends_with``)?  0/1 columns.

    ``last`` is matched by its reversed step table from the window's end, so neither
    walk looks beyond the events that decide it.
    """
    from tidemark.operators.windows import day_window

    keys, orders = _as_list(partition_by), _as_list(order_by)
    d = df.withColumn("window_start", day_window(time_col, length, df)).where(F.col("window_start").isNotNull())
    group = [*keys, "window_start"]
    a = spans.answers(d, [StepTable(first)], group, orders, first_only=True, strategy=strategy)
    b = spans.answers(d, [StepTable(reversed_pattern(last))], group, orders, first_only=True, forward=False, strategy=strategy)
    both = a.select(*group, F.col("hit0").alias("_f"), F.lit(False).alias("_l")).unionByName(
        b.select(*group, F.lit(False).alias("_f"), F.col("hit0").alias("_l")))
    return both.groupBy(*group).agg(F.bool_or("_f").cast("long").alias("starts_with"), F.bool_or("_l").cast("long").alias("ends_with"))


def _patterns(of: dict[str, Pattern | Column]) -> list[Pattern]:
    return [p if isinstance(p, Pattern) else step(n, p) for n, p in of.items()]


def window_all_of(df: DataFrame, patterns: dict[str, Pattern | Column], partition_by, order_by, time_col: str,
                  length: str | int = "1d", strategy: str = "auto") -> DataFrame:
    """P10: windows with a match of every pattern, in any order and overlapping or not.
    One pass carries all the patterns' step tables."""
    from tidemark.operators.windows import day_window

    keys, orders = _as_list(partition_by), _as_list(order_by)
    d = df.withColumn("window_start", day_window(time_col, length, df)).where(F.col("window_start").isNotNull())
    tables = [StepTable(p) for p in _patterns(patterns)]
    out = spans.answers(d, tables, [*keys, "window_start"], orders, first_only=False, strategy=strategy)
    cond = F.lit(True)
    for j in range(len(tables)):
        cond = cond & F.col(f"hit{j}")
    return out.where(cond).select(*keys, "window_start")


def window_lacking(df: DataFrame, pattern: Pattern, partition_by, order_by, time_col: str, length_days: int = 1,
                   strategy: str = "auto") -> DataFrame:
    """Per key, the windows of ``length_days`` UTC days, from the key's first event on,
    without a match of ``pattern`` wholly inside.  Events without a time are in none."""
    from tidemark.operators.windows import time_number

    keys, orders = _as_list(partition_by), _as_list(order_by)
    d = df.withColumn("_day", _div(time_number(time_col, df), 86_400_000_000).cast("int")).where(F.col("_day").isNotNull())
    if length_days > 1:
        if keys:
            lo = d.groupBy(*[F.col(f"`{k}`").alias(f"_l{i}") for i, k in enumerate(keys)]).agg(F.min("_day").alias("_lo"))
            d = d.join(lo, [F.col(f"`{k}`").eqNullSafe(F.col(f"_l{i}")) for i, k in enumerate(keys)]).drop(*[f"_l{i}" for i in range(len(keys))])
        else:
            d = d.withColumn("_lo", F.lit(d.agg(F.min("_day")).first()[0]).cast("int"))
        shift = F.col("_day") - F.col("_lo")
        d = d.withColumn("_day", (F.col("_lo") + shift - F.pmod(shift, F.lit(length_days))).cast("int")).drop("_lo")
    out = spans.answers(d, [StepTable(pattern)], [*keys, "_day"], orders, first_only=False, strategy=strategy)
    got = out.groupBy(*keys).agg(F.min("_day").alias("_lo"), F.max("_day").alias("_hi"),
                                 F.collect_set(F.when(F.col("hit0"), F.col("_day"))).alias("_have"))
    every = F.sequence(F.col("_lo"), F.col("_hi"), F.lit(length_days))
    return got.where(F.col("_lo").isNotNull()).select(*keys, F.explode(F.array_except(every, "_have")).alias("_day")).select(
        *keys, F.date_add(F.lit("1970-01-01").cast("date"), F.col("_day")).alias("day"))
