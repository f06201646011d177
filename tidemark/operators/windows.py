"""Fixed-length and windowed pattern operators, window functions only.

Everything here stays in the JVM (whole-stage codegen, sort-based window
exec that spills); no Python runs per row.  Definitions marked "our
definition" fix semantics the reference only sketches (SURVEY §2.2).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.pattern import Pattern
from tidemark.operators.matcher import _as_list
from tidemark.plans.skew import HotKeys, _with_blocks, keyed_window


def time_number(c: str | Column, df: DataFrame | None = None, dtype=None) -> Column:
    """Microseconds since the epoch.

    A ``TIMESTAMP_NTZ`` column (give ``df`` or ``dtype``) is counted in wall
    time, independent of the session time zone; other timestamps are
    instants.
    """
    col = (F.col(f"`{c}`" if df is not None and c in df.columns else c)) if isinstance(c, str) else c
    if dtype is None and df is not None and isinstance(c, str):
        dtype = df.schema[c].dataType
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, col)
    return F.unix_micros(col.cast("timestamp"))


def _tcol(df: DataFrame, c: str) -> Column:
    """A time column usable by ``F.window`` (NTZ stays wall time)."""
    dt = df.schema[c].dataType
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType)):
        return F.col(c)
    return F.col(c).cast("timestamp")


def duration_micros(d: str | int) -> int:
    """'90s', '15m', '6h', '1d' or an int of microseconds."""
    if isinstance(d, int):
        return d
    units = {"us": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6,
             "d": 86400 * 10**6}
    d = d.strip()
    for u in ("us", "ms", "s", "m", "h", "d"):
        if d.endswith(u) and d[: -len(u)].strip().replace(".", "", 1).isdigit():
            return int(float(d[: -len(u)]) * units[u])
    raise ValueError(f"bad duration {d!r}")


def _wp(part, order_by):
    return Window.partitionBy(*part).orderBy(*_as_list(order_by))


def _lead_all(steps: Sequence[Column], w) -> Column:
    cond = F.coalesce(steps[0], F.lit(False))
    for i, s in enumerate(steps[1:], start=1):
        cond = cond & F.coalesce(F.lead(s, i).over(w), F.lit(False))
    return cond


def match_every(df: DataFrame, steps: Sequence[Column] | Pattern, partition_by, order_by, *,
                time_col: str | None = None, max_gap: str | int | None = None,
                keep: Sequence[str] = (), strategy: str = "auto") -> DataFrame:
    """P1 (our definition): every event may start a match; matches overlap.

    ``steps`` are predicates of consecutive events.  With ``max_gap`` (P4)
    each gap between consecutive events of the match is at most that long.
    Output: the input columns of the first event, ``end_<o>`` for each
    order column, ``n_events``; ``keep`` columns are also taken from the
    last event as ``end_<c>``.  A ``Pattern`` goes to ``tidemark.operators.every``.
    """
    if isinstance(steps, Pattern):
        from tidemark.operators import every

        return every.match_every(df, steps, partition_by, order_by, time_col=time_col, max_gap=max_gap, keep=keep, strategy=strategy)
    n = len(steps)
    if max_gap is not None and time_col is None:
        raise ValueError("max_gap needs time_col")

    def op(d: DataFrame, part: list[str]) -> DataFrame:
        w = _wp(part, order_by)
        cond = _lead_all(steps, w)
        if max_gap is not None:
            t = time_number(time_col, df)
            lim = duration_micros(max_gap)
            for i in range(1, n):
                gap = F.lead(t, i).over(w) - (F.lead(t, i - 1).over(w) if i > 1 else t)
                cond = cond & F.coalesce(gap <= F.lit(lim), F.lit(False))
        ends = [F.lead(F.col(o), n - 1).over(w).alias(f"end_{o}")
                for o in dict.fromkeys(_as_list(order_by) + list(keep))]
        return d.select("*", cond.alias("_hit"), *ends)

    out = keyed_window(df, _as_list(partition_by), _as_list(order_by), op, ahead=n - 1,
                       strategy=strategy)
    return (out.filter(F.col("_hit")).drop("_hit")
            .withColumn("n_events", F.lit(n).cast("long")))


def in_last_n(df: DataFrame, steps: Sequence[Column] | Pattern, n: int, partition_by,
              order_by, strategy: str = "auto") -> DataFrame:
    """P2 (our definition): at each event, 1 if a P1 match lies wholly
    within the last ``n`` events (this one included), else 0."""
    if isinstance(steps, Pattern):
        from tidemark.operators import every

        return every.in_last_n(df, steps, n, partition_by, order_by, strategy)
    span = n - len(steps)
    if span < 0:
        return df.withColumn("hit", F.lit(0))

    def op(d: DataFrame, part: list[str]) -> DataFrame:
        w = _wp(part, order_by)
        end = F.coalesce(steps[-1], F.lit(False))
        for i, s in enumerate(reversed(steps[:-1]), start=1):
            end = end & F.coalesce(F.lag(s, i).over(w), F.lit(False))
        d = d.withColumn("_end", end.cast("int"))
        return d.withColumn("hit", F.max("_end").over(w.rowsBetween(-span, 0))).drop("_end")

    return keyed_window(df, _as_list(partition_by), _as_list(order_by), op, behind=n - 1,
                        strategy=strategy)


def blocks_of(df: DataFrame, n: int, partition_by, order_by, name: str = "block",
              strategy: str = "auto") -> DataFrame:
    """P3 (our definition): cut each key's rows into blocks of ``n`` rows."""
    def op(d: DataFrame, part: list[str]) -> DataFrame:
        return d.withColumn(name, F.floor((F.col("_rn") - 1) / n).cast("long"))

    return keyed_window(df, _as_list(partition_by), _as_list(order_by), op,
                        row_number=True, strategy=strategy).drop("_rn")


def pair_filter(df: DataFrame, predicate, partition_by, order_by,
                cols: Sequence[str], strategy: str = "auto") -> DataFrame:
    """Keep rows for which ``predicate(prev, cur)`` holds, where ``prev``
    is a struct of ``cols`` of the row before in the key."""
    def op(d: DataFrame, part: list[str]) -> DataFrame:
        prev = F.lag(F.struct(*[F.col(c) for c in cols]), 1).over(_wp(part, order_by))
        return d.withColumn("_prev", prev)

    out = keyed_window(df, _as_list(partition_by), _as_list(order_by), op, behind=1,
                       strategy=strategy)
    return out.filter(F.coalesce(predicate(F.col("_prev"), F), F.lit(False)))


def _next_over_blocks(df: DataFrame, keys: list[str], orders: list[str],
                      within: Callable[[DataFrame, list[str]], DataFrame], first: Column,
                      strategy: str) -> DataFrame:
    """``within(frame, partition_cols)`` adds ``_nx``, what the rest of the key holds
    first.  Hot keys: the block's own answer, else that of the nearest later
    block that has one (``first``, an aggregate; a backward scan over the small
    per-block table), so the unbounded look-ahead never needs a whole key in a task."""
    hk = None if strategy == "plain" else HotKeys(df, keys, orders, force=strategy == "block")
    if not hk:
        return within(df, keys)
    cold, hot = hk.split(df)
    part = keys + ["_sk_blk"]
    wk = Window.partitionBy(*keys).orderBy(F.col("_sk_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hot.groupBy(*part).agg(first.alias("_fb")).select(*part, F.min("_fb").over(wk).alias("_after"))
    out = _with_blocks(within(hot, part), blocks, part, hk.n_blocks)
    out = out.withColumn("_nx", F.coalesce("_nx", "_after")).drop("_after", "_sk_blk")
    return within(cold, keys).unionByName(out)


def not_followed_within(df: DataFrame, a: Column, b: Column, within: str | int,
                        partition_by, time_col: str, strategy: str = "auto") -> DataFrame:
    """P5 (our definition): A events with no B event of the same key in
    ``(t, t + within]``."""
    lim = duration_micros(within)
    t = F.col("_sk_t")
    bt = F.when(F.coalesce(b, F.lit(False)), t)

    def op(d: DataFrame, part: list[str]) -> DataFrame:
        # the next B by one running pass from the end: linear, however wide the range
        w = Window.partitionBy(*part).orderBy(t.desc()).rangeBetween(Window.unboundedPreceding, -1)
        return d.withColumn("_nx", F.min(bt).over(w))

    # equal times are never cut, so a B of a later block is a later B
    out = _next_over_blocks(df.withColumn("_sk_t", time_number(time_col, df)), _as_list(partition_by), ["_sk_t"],
                            op, F.min(bt), strategy)
    near = F.coalesce(F.col("_nx") - t <= lim, F.lit(False))
    return out.filter(F.coalesce(a, F.lit(False)) & ~near).select(*df.columns)


def first_after(df: DataFrame, a: Column, b: Column, partition_by, order_by,
                cols: Sequence[str], strategy: str = "auto") -> DataFrame:
    """P17 (our definition): for each A event, the first later B event of the
    same key (``next_<c>`` columns, NULL while still open)."""
    keys, orders = _as_list(partition_by), _as_list(order_by)
    isb = F.coalesce(b, F.lit(False))
    packed = F.struct(*[F.col(o) for o in orders], *[F.col(c).alias(f"_v_{c}") for c in cols])

    def within(d: DataFrame, part: list[str]) -> DataFrame:
        # from the end, the last B passed is the first one after: a running pass
        w = (Window.partitionBy(*part).orderBy(*[F.col(o).desc() for o in orders])
             .rowsBetween(Window.unboundedPreceding, -1))
        return d.withColumn("_nx", F.last(F.when(isb, packed), ignorenulls=True).over(w))

    out = _next_over_blocks(df, keys, orders, within, F.min(F.when(isb, packed)), strategy)
    nxt = [F.col("_nx")[f"_v_{c}"].alias(f"next_{c}") for c in cols]
    return (out.filter(F.coalesce(a, F.lit(False)))
            .select(*[F.col(c) for c in df.columns], *nxt))


def longest_alternative(df: DataFrame, branches: dict[str, Sequence[Column]],
                        partition_by, order_by, strategy: str = "auto") -> DataFrame:
    """P19 (our definition): at each start event, of the fixed-length
    branches that match from there, keep the longest (ties: first listed).
    Output: input columns + ``alt`` + ``n_events``."""
    order = sorted(branches.items(), key=lambda kv: len(kv[1]))
    reach = max(len(v) for v in branches.values()) - 1

    def op(d: DataFrame, part: list[str]) -> DataFrame:
        w = _wp(part, order_by)
        best_len = F.lit(None).cast("long")
        best_alt = F.lit(None).cast("string")
        for name, steps in order:
            cond = _lead_all(steps, w)
            best_len = F.when(cond, F.lit(len(steps)).cast("long")).otherwise(best_len)
            best_alt = F.when(cond, F.lit(name)).otherwise(best_alt)
        return d.select("*", best_alt.alias("alt"), best_len.alias("n_events"))

    out = keyed_window(df, _as_list(partition_by), _as_list(order_by), op, ahead=reach,
                       strategy=strategy)
    return out.filter(F.col("n_events").isNotNull())


def rising_triples(df: DataFrame, value_col: str, partition_by, order_by,
                   strategy: str = "auto") -> DataFrame:
    """Cut each key's events into triples; 1 if the three values rise,
    else 0.  An unfinished last triple gives nothing.

    Output: key columns, ``triple_no`` (1-based), ``first_<o>`` order
    columns of the triple's first event, ``rising``.
    """
    keys, orders = _as_list(partition_by), _as_list(order_by)
    v = F.col(value_col)

    def op(d: DataFrame, part: list[str]) -> DataFrame:
        w = _wp(part, orders)
        return d.select("*", F.lead(v, 1).over(w).alias("_v1"),
                        F.lead(v, 2).over(w).alias("_v2"),
                        F.lead(F.lit(1), 2).over(w).alias("_full"))

    out = keyed_window(df.select(*dict.fromkeys(keys + orders + [value_col])), keys, orders,
                       op, ahead=2, row_number=True, strategy=strategy)
    return (out.filter(((F.col("_rn") - 1) % 3 == 0) & F.col("_full").isNotNull())
            .select(*[F.col(k) for k in keys],
                    ((F.col("_rn") - 1) / 3 + 1).cast("long").alias("triple_no"),
                    *[F.col(o).alias(f"first_{o}") for o in orders],
                    F.when((F.col("_v2") > F.col("_v1")) & (F.col("_v1") > v), 1)
                    .otherwise(0).cast("long").alias("rising")))


# -- time windows (P14-P16) --------------------------------------------------

def tumbling(df: DataFrame, time_col: str, length: str, group_by: Sequence[str] = (),
             aggs: Sequence[Column] = ()) -> DataFrame:
    """Aligned windows, end exclusive; ``window_start`` as epoch micros."""
    win = F.window(_tcol(df, time_col), length)
    dt = df.schema[time_col].dataType
    return (df.groupBy(win.alias("_win"), *group_by).agg(*aggs)
            .withColumn("window_start", time_number(F.col("_win.start"), dtype=dt))
            .drop("_win"))


def sliding(df: DataFrame, time_col: str, length: str, slide: str,
            group_by: Sequence[str] = (), aggs: Sequence[Column] = ()) -> DataFrame:
    """Sliding windows of ``length`` every ``slide``."""
    win = F.window(_tcol(df, time_col), length, slide)
    dt = df.schema[time_col].dataType
    return (df.groupBy(win.alias("_win"), *group_by).agg(*aggs)
            .withColumn("window_start", time_number(F.col("_win.start"), dtype=dt))
            .drop("_win"))


def _running_totals(df: DataFrame, keys: list[str], orders: list[str], names: Sequence[str],
                    strategy: str) -> DataFrame:
    """``df`` with each column of ``names`` replaced by its running total in its key, ties
    included.  Hot keys: the total of the blocks before plus that inside the block."""
    def inside(d: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(*orders).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return d.select(*[c for c in d.columns if c not in names], *[F.sum(n).over(w).alias(n) for n in names])

    hk = None if strategy == "plain" else HotKeys(df, keys, orders, force=strategy == "block")
    if not hk:
        return inside(df, keys)
    cold, hot = hk.split(df)
    part = keys + ["_sk_blk"]
    wk = Window.partitionBy(*keys).orderBy("_sk_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = hot.groupBy(*part).agg(*[F.sum(n).alias(n) for n in names]).select(
        *part, *[F.sum(n).over(wk).alias(f"_b_{n}") for n in names])
    out = _with_blocks(inside(hot, part), before, part, hk.n_blocks)
    total = [(F.col(n) + F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in names]
    out = out.select(*[c for c in df.columns if c not in names], *total)
    return inside(cold, keys).unionByName(out)


def rolling(df: DataFrame, time_col: str, length: str | int, partition_by,
            aggs: dict[str, Column] | None = None, totals: dict[str, Column] | None = None,
            strategy: str = "auto") -> DataFrame:
    """Trailing range ``[t - length, t]`` at each event of the key.

    ``totals``: sums of columns over the range (``F.lit(1)`` counts; NULLs count
    as 0).  Each event enters the sum at its time and leaves it ``length``
    later, so one running total gives every range, in time linear in the rows
    however wide the range is.  Exact for integers and decimals; sums of doubles
    are exact too and rounded once (``tidemark.plans.exact``): NaN where the range
    holds a NaN or both infinities.  ``aggs``: any other aggregates, by a sliding
    frame, whose time grows with the rows in the range.
    """
    lim = duration_micros(length)
    keys = _as_list(partition_by)
    out = df
    names = list(totals or ())
    probe = df.select(*[v.alias(n) for n, v in (totals or {}).items()]).schema
    inexact = {n: v for n, v in (totals or {}).items() if isinstance(probe[n].dataType, (T.DoubleType, T.FloatType))}
    totals = {n: v for n, v in (totals or {}).items() if n not in inexact}
    if inexact:
        from tidemark.plans import exact

        t = time_number(time_col, df)
        vals = [v.cast("double").alias(f"v{j}") for j, v in enumerate(inexact.values())]
        steps = F.array(F.struct(t.alias("t"), F.lit(0).alias("left")), F.struct((t + lim).alias("t"), F.lit(1).alias("left")))
        moves = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], *vals, F.explode(steps).alias("_s"))
        moves = moves.select(*[f"_k{i}" for i in range(len(keys))], "_s.t", "_s.left", *[f"v{j}" for j in range(len(vals))])
        sums = exact.range_sums(moves, [f"_k{i}" for i in range(len(keys))], len(vals), strategy)
        sums = sums.withColumnsRenamed({"t": "_rt", **{f"v{j}": n for j, n in enumerate(inexact)}})
        same = [F.col("_at").eqNullSafe(F.col("_rt"))] + [F.col(f"_in.`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in"), t.alias("_at"))
        out = rows.join(sums, same).select("_in.*", *inexact)
    if totals:
        t = time_number(time_col, df)
        df = out
        rows = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        vals = {f"_v{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate(totals.values())}
        # an event leaves after the events of the time it was still in the range of
        steps = F.array(F.struct(t.alias("t"), F.lit(0).alias("left"), *[v.alias(n) for n, v in vals.items()]),
                        F.struct((t + lim).alias("t"), F.lit(1).alias("left"), *[(-v).alias(n) for n, v in vals.items()]))
        both = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], rows.alias("_in"), F.explode(steps).alias("_s"))
        both = both.select(*[f"_k{i}" for i in range(len(keys))], "_s.*", F.when(F.col("_s.left") == 0, F.col("_in")).alias("_in"))
        both = _running_totals(both, [f"_k{i}" for i in range(len(keys))], ["t", "left"], list(vals), strategy)
        out = both.where("left = 0").select("_in.*", *[F.col(v).alias(n) for v, n in zip(vals, totals)])
    if inexact and totals:
        out = out.select(*[c for c in out.columns if c not in names], *names)
    if not aggs:
        return out
    time = time_number(time_col, df)

    def op(d: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(F.col("_sk_t")).rangeBetween(-lim, 0)
        return d.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])

    return keyed_window(out.withColumn("_sk_t", time), keys, ["_sk_t"], op, range_behind=max(lim, 1),
                        time=F.col("_sk_t"), strategy=strategy).select(*out.columns, *aggs)


def cascading(df: DataFrame, time_col: str, fine: str, coarse: str,
              group_by: Sequence[str] = ()) -> DataFrame:
    """Coarse windows computed from the fine windows' results only."""
    dt = df.schema[time_col].dataType
    fine_df = (df.groupBy(F.window(_tcol(df, time_col), fine).alias("_w"),
                          *group_by)
               .agg(F.count(F.lit(1)).alias("_n")))
    return (fine_df.groupBy(F.window(F.col("_w.start"), coarse).alias("_c"), *group_by)
            .agg(F.sum("_n").cast("long").alias("n_events"),
                 F.max("_n").cast("long").alias("max_fine"),
                 F.count(F.lit(1)).cast("long").alias("n_fine"))
            .withColumn("window_start", time_number(F.col("_c.start"), dtype=dt))
            .drop("_c"))


# -- windows as match scopes (P7-P11) -----------------------------------------

def day_window(time_col: str, length: str | int = "1d", df: DataFrame | None = None) -> Column:
    """Epoch micros of the start of the aligned window holding the event
    (windows aligned to the epoch, as ``F.window`` aligns them)."""
    lim = duration_micros(length)
    return (F.floor(time_number(time_col, df) / lim) * lim).cast("long")


def window_contains(df: DataFrame, steps: Sequence[Column] | Pattern, partition_by, order_by,
                    time_col: str, length: str = "1d", slide: str | None = None) -> DataFrame:
    """P7 (our definition): per key and aligned window, the number of P1
    matches lying wholly inside it; windows with at least one.  Windows that
    ``slide`` take a ``Pattern``."""
    if isinstance(steps, Pattern):
        from tidemark.operators import every

        return every.window_contains(df, steps, partition_by, order_by, time_col, length, slide)
    if slide is not None:
        raise ValueError("sliding windows take a Pattern")
    every = match_every(df, steps, partition_by, order_by, keep=[time_col])
    start_w = day_window(time_col, length, df)
    end_w = day_window(f"end_{time_col}", length, every)
    return (every.filter(start_w == end_w)
            .groupBy(*_as_list(partition_by), start_w.alias("window_start"))
            .agg(F.count(F.lit(1)).cast("long").alias("n_matches")))


def window_edges(df: DataFrame, first: Column | Pattern, last: Column | Pattern, partition_by, order_by,
                 time_col: str, length: str = "1d") -> DataFrame:
    """P9 (our definition): per key and window, does its first event satisfy
    ``first`` and its last event ``last`` (for a ``Pattern``: its first, its last
    events)?  Output 0/1 columns."""
    if isinstance(first, Pattern) or isinstance(last, Pattern):
        from tidemark.operators import every

        return every.window_edges(df, *every._patterns({"first": first, "last": last}), partition_by, order_by, time_col, length)
    keys = _as_list(partition_by)
    orders = _as_list(order_by)
    ws = day_window(time_col, length, df)
    d = df.withColumn("window_start", ws)
    ordered = F.struct(*[F.col(o) for o in orders])
    agg = (d.groupBy(*keys, "window_start")
           .agg(F.min_by(F.coalesce(first, F.lit(False)), ordered).alias("_f"),
                F.max_by(F.coalesce(last, F.lit(False)), ordered).alias("_l")))
    return agg.select(*keys, "window_start",
                      F.col("_f").cast("long").alias("starts_with"),
                      F.col("_l").cast("long").alias("ends_with"))


def window_all_of(df: DataFrame, preds: dict[str, Column | Pattern], partition_by, time_col: str,
                  length: str = "1d", order_by=None) -> DataFrame:
    """P10 (our definition): windows in which every predicate holds for some
    event, in any order.  With a ``Pattern`` among them, ``order_by`` is needed."""
    if any(isinstance(p, Pattern) for p in preds.values()):
        from tidemark.operators import every

        return every.window_all_of(df, preds, partition_by, order_by, time_col, length)
    keys = _as_list(partition_by)
    aggs = [F.bool_or(F.coalesce(p, F.lit(False))).alias(f"_{n}") for n, p in preds.items()]
    out = df.groupBy(*keys, day_window(time_col, length, df).alias("window_start")).agg(*aggs)
    cond = F.lit(True)
    for n in preds:
        cond = cond & F.col(f"_{n}")
    return out.filter(cond).select(*keys, "window_start")


def window_lacking(df: DataFrame, pred: Column | Pattern, partition_by, time_col: str,
                   length_days: int = 1, order_by=None) -> DataFrame:
    """P11 (our definition): per key, the windows of ``length_days`` UTC days,
    from the key's first event on, in which no event satisfies ``pred`` (with a
    ``Pattern`` and ``order_by``: without a match).  A NULL key is a key; events
    without a time are in no window."""
    if isinstance(pred, Pattern):
        from tidemark.operators import every

        return every.window_lacking(df, pred, partition_by, order_by, time_col, length_days)
    keys = _as_list(partition_by)
    number = F.floor(time_number(time_col, df) / F.lit(86_400_000_000)).cast("int")
    d = df.select(*keys, number.alias("_day"), F.coalesce(pred, F.lit(False)).alias("_ok")).where(
        F.col("_day").isNotNull())
    # one row per key and day, so what follows grows with days, not events
    days = d.groupBy(*keys, "_day").agg(F.bool_or("_ok").alias("_ok"))
    wk = Window.partitionBy(*keys)
    days = days.withColumn("_lo", F.min("_day").over(wk)).withColumn("_hi", F.max("_day").over(wk))
    at = F.col("_lo") + F.floor((F.col("_day") - F.col("_lo")) / length_days) * length_days
    got = days.groupBy(*keys, "_lo", "_hi").agg(
        F.collect_set(F.when(F.col("_ok"), at.cast("int"))).alias("_have"))
    every = F.sequence(F.col("_lo"), F.col("_hi"), F.lit(length_days))
    return got.select(*keys, F.explode(F.array_except(every, "_have")).alias("_day")).select(
        *keys, F.date_add(F.lit("1970-01-01").cast("date"), F.col("_day")).alias("day"))
