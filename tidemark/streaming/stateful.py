"""Streaming matchers (O12, O17 incremental state, P13 timeout, P21 time).

``groupBy(key).applyInPandasWithState`` keeps, per key, the step-table state
of the open attempt and the rows that may still be overtaken.  With an event
time, a row is stepped once the watermark has passed it, so rows that are out
of order by no more than ``delay`` come out in order, however they were cut
into micro-batches; rows later than that are dropped by Spark, which counts
them (``numRowsDroppedByWatermark`` in the query's progress).  Rows without
a time have no place in the order and are left out.  Without an event time
(``time_col=None``) rows are stepped as they arrive, each micro-batch in
order, and gaps are measured by the clock.

An open attempt whose next event comes more than ``timeout`` after its last
one is dropped.  State of a key idle for ``forget`` is removed, and its
numbering starts again; without it keys are remembered for good.

A stream has no end of input, so there is no ENDED row here.  Rows the
watermark hasn't passed yet wait; a runner that knows the input's end says so
through ``end`` (see ``run_stream``).

Whole numbers travel as decimals: pandas would round 64-bit ids beside NULLs.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.pattern import Pattern
from tidemark.operators.matcher import STATUS_FIELDS, _as_list, _norm, _Prepared
from tidemark.operators.windows import duration_micros, time_number
from tidemark.plans.automaton import FAILURE, INCOMPLETE, START, STATUS_NAMES, SUCCESS
from tidemark.plans.captures import NONE, Tracker, dumped, loaded
from tidemark.session import ensure_checkpoint_dir

#: The watermark's range in micros: Spark's begins at the epoch, pandas ends in 2262.
#: Earlier and later times count as these where the watermark is concerned.
FIRST_MICROS, LAST_MICROS = 1_000, 9_214_646_400_000_000
_END_MICROS = LAST_MICROS + 86_400_000_000
_STATE = T.StructType([T.StructField("open", T.BinaryType()), T.StructField("waiting", T.BinaryType())])


def _sent(df: DataFrame, c: str, expr: Column | None = None) -> tuple[Column, T.DataType]:
    """A column as it is sent to Python, and its type in the output."""
    dt = df.schema[c].dataType
    expr = F.col(c) if expr is None else expr
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return time_number(expr, dtype=dt).cast("decimal(20,0)"), T.LongType()
    if isinstance(dt, T.IntegralType):
        return expr.cast("decimal(20,0)"), dt
    return expr, dt


def _plain(v):
    v = _norm(v)
    return int(v) if isinstance(v, Decimal) else None if v is pd.NaT else v


def _clamped(t: int) -> int:
    return min(max(t, FIRST_MICROS), LAST_MICROS)


def watermarked(ev: DataFrame, t: Column, delay: str | int, end: DataFrame | None) -> DataFrame:
    """``ev`` with its time ``t`` (micros) as the watermark column ``_wm``, without rows that
    have no time, and the rows of ``end`` (``_end``), which move the watermark past all."""
    ev = ev.where(t.isNotNull()).select("*", F.timestamp_micros(F.least(F.greatest(t, F.lit(FIRST_MICROS)), F.lit(LAST_MICROS))).alias("_wm"),
                                        F.lit(False).alias("_end"))
    if end is not None:
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in ev.schema if f.name not in ("_wm", "_end")]
        ev = ev.unionByName(end.select(*blank, F.timestamp_micros(F.lit(_END_MICROS)).alias("_wm"), F.lit(True).alias("_end")))
    # rows as late as the watermark itself are dropped: a millisecond keeps those at the edge
    return ev.withWatermark("_wm", f"{(duration_micros(delay) + 999) // 1000 + 1} milliseconds")


class _Open:
    """The open attempt of a key: only plain values, so any process can go on with it."""

    def __init__(self):
        self.state, self.steps, self.attempt, self.match_no = "", 0, 0, 0
        self.start, self.paths, self.last_t = (), NONE, None

    def dump(self) -> bytes:
        return pickle.dumps((self.state, self.steps, self.attempt, self.match_no, self.start, dumped(self.paths), self.last_t))

    def load(self, data: bytes) -> "_Open":
        (self.state, self.steps, self.attempt, self.match_no, self.start, paths, self.last_t) = pickle.loads(data)
        self.paths = loaded(paths)
        return self


def _stream(stream: DataFrame, pattern: Pattern, partition_by, order_by, mode: str, time_col: str | None,
            timeout, delay, forget, capture, show: Column | None, on_ambiguity: str, end: DataFrame | None) -> DataFrame:
    prep = _Prepared(stream, pattern, partition_by, order_by, show, capture, None, on_ambiguity,
                     want_show=mode == "events")
    table, keys, orders = prep.table, prep.keys, prep.orders
    tracked = Tracker(table, prep.caps if mode == "cut" else [])
    lim = None if timeout is None else duration_micros(timeout)
    idle = None if forget is None else duration_micros(forget)
    by_clock = time_col is None

    sent, types = [], {}
    for pre, cols in (("k", keys), ("o", orders)):
        for i, c in enumerate(cols):
            col, types[c] = _sent(stream, c)
            sent.append(col.alias(f"_{pre}{i}"))
    probe = stream.select(*[e.alias(f"_cap{i}") for i, e in enumerate(prep.exprs)])
    cap_types = []
    for i, e in enumerate(prep.exprs):
        col, dt = _sent(probe, f"_cap{i}", e)
        cap_types.append(dt)
        sent.append(col.alias(f"_cap{i}"))
    sent.append(table.symbol_column().cast("long").alias("_sym"))
    has_show = prep.has_show
    if has_show:
        shown = prep.df.select("_show")  # checks the expression
        sent.append((show if show is not None else _default(pattern)).cast("string").alias(shown.columns[0]))
    if by_clock:
        ev = stream.select(*sent, F.lit(False).alias("_end"))
    else:
        t = time_number(time_col, stream)
        ev = watermarked(stream.select(*sent, t.cast("decimal(20,0)").alias("_t")), F.col("_t").cast("long"), delay, end)

    fields = [T.StructField(k, types[k]) for k in keys]
    if mode == "cut":
        fields += [T.StructField("match_no", T.LongType())]
        fields += [T.StructField(f"{x}_{o}", types[o]) for x in ("start", "end") for o in orders]
        fields += [T.StructField("n_events", T.LongType()), T.StructField("alt", T.StringType())]
        fields += [T.StructField(c.name, cap_types[c.index]) for c in prep.caps]
    else:
        fields += [T.StructField(o, types[o]) for o in orders] + STATUS_FIELDS
    names = [f.name for f in fields]
    no, ncols = len(orders), len(prep.exprs)

    def walk(key: tuple, s: _Open, rows: list[tuple]) -> list[tuple]:
        """Step rows (order, t, symbol, captured, shown), already in order."""
        out = []
        state = table.state_from_key(s.state) if s.state else START
        for order, t, sym, cols, got in rows:
            if state != START and lim is not None and t - s.last_t > lim:
                state = START
            if state == START:
                s.steps, s.start, s.paths = 0, order, NONE
                s.attempt += 1
            s.steps += 1
            nxt, code, br, lab = table.move(state, sym)
            if tracked.on and code in (INCOMPLETE, SUCCESS):
                s.paths = tracked.step(state, sym, s.paths, [(c,) for c in cols], 0)
            alt = table.branch_names[br] if code == SUCCESS and table.top_is_alt else None
            if code == SUCCESS:
                s.match_no += 1
            if mode == "events":
                failed = code == FAILURE
                out.append(key + order + (STATUS_NAMES[code], s.attempt, s.steps, alt, table.labels[lab],
                                          table.expected(state) if failed else None, got if failed else None))
            elif code == SUCCESS:
                caps = s.paths[0].values
                out.append(key + (s.match_no,) + s.start + order + (s.steps, alt) + tuple(caps.get(j) for j in range(tracked.n)))
            state, s.last_t = nxt, t
        s.state = table.state_key(state) if state != START else ""
        return out

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        key = tuple(_plain(k) for k in key)
        s, waiting = _Open(), []
        if state.exists:
            s, waiting = s.load(state.get[0]), pickle.loads(state.get[1])
        now = state.getCurrentProcessingTimeMs() if by_clock else state.getCurrentWatermarkMs()
        new = []
        for pdf in pdfs if not state.hasTimedOut else ():
            pdf = pdf[~pdf["_end"].astype(bool)]
            col = {c: [_plain(v) for v in pdf[c]] for c in pdf.columns if c not in ("_wm", "_end")}
            for i in range(len(pdf)):
                new.append((tuple(col[f"_o{j}"][i] for j in range(no)), now * 1000 if by_clock else col["_t"][i],
                            col["_sym"][i], tuple(col[f"_cap{j}"][i] for j in range(ncols)),
                            col["_show"][i] if has_show else None))
        if not new and not state.exists:
            return
        # NULLs first, as Spark sorts
        rank = (lambda r: tuple((v is not None, v) for v in r[0]))
        if by_clock:
            ready, waiting = sorted(new, key=rank), []
        else:
            rows = waiting + new
            ready = sorted((r for r in rows if _clamped(r[1]) < now * 1000), key=rank)
            waiting = [r for r in rows if _clamped(r[1]) >= now * 1000]
        out = walk(key, s, ready)
        quiet = idle is not None and not waiting and s.last_t is not None
        if quiet and not new and now * 1000 - s.last_t >= idle:
            state.remove()
        else:
            state.update((s.dump(), pickle.dumps(waiting)))
            if by_clock and quiet:
                state.setTimeoutDuration(max(1, (s.last_t + idle) // 1000 - now))
            elif waiting:
                state.setTimeoutTimestamp(max(min(_clamped(r[1]) for r in waiting) // 1000 + 1, now + 1))
            elif quiet:
                state.setTimeoutTimestamp(max((s.last_t + idle) // 1000 + 1, now + 1))
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    return (ev.groupBy(*[f"_k{i}" for i in range(len(keys))])
            .applyInPandasWithState(fn, T.StructType(fields), _STATE, "append",
                                    GroupStateTimeout.ProcessingTimeTimeout if by_clock else GroupStateTimeout.EventTimeTimeout))


def _default(pattern: Pattern) -> Column:
    from tidemark.operators.matcher import default_show

    return default_show(pattern)


def stream_match_cut(stream: DataFrame, pattern: Pattern, partition_by, order_by, time_col: str | None,
                     timeout: str | int | None = None, delay: str | int = 0, *, capture: Sequence[str] = (),
                     forget: str | int | None = None, on_ambiguity: str = "reference",
                     end: DataFrame | None = None) -> DataFrame:
    """Streaming ``match_cut``; append mode (module doc).

    Output: key columns, ``match_no``, ``start_<o>``, ``end_<o>``, ``n_events``,
    ``alt`` and the captures as in ``match_cut``; timestamps as epoch micros.
    ``delay``: how far out of order rows may come; a key's rows of that span are its
    state, so give streams of hot keys a short one (``in_time_order``).
    """
    return _stream(stream, pattern, partition_by, order_by, "cut", time_col, timeout, delay, forget, capture, None,
                   on_ambiguity, end)


def stream_match_events(stream: DataFrame, pattern: Pattern, partition_by, order_by, time_col: str | None,
                        timeout: str | int | None = None, delay: str | int = 0, *, show: Column | None = None,
                        forget: str | int | None = None, on_ambiguity: str = "reference",
                        end: DataFrame | None = None) -> DataFrame:
    """Streaming ``match_events`` (without end rows); append mode (module doc)."""
    return _stream(stream, pattern, partition_by, order_by, "events", time_col, timeout, delay, forget, (), show,
                   on_ambiguity, end)


# ---------------------------------------------------------------------------
# one-shot runs over a table at rest
# ---------------------------------------------------------------------------

def glob_of(path: str) -> str:
    """``path`` (a file or a folder of files) as a pattern that fits it alone, the
    form in which a file source takes both."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]" if path[-1] not in "*]}" else path


def disorder(df: DataFrame, time_col: str) -> int:
    """Micros by which the rows of a file source go back in time: how far the latest
    time of the files up to one lies after the earliest of that file.

    Files are taken in the order of their modification times, equal ones in any.
    One aggregate over one column, then a window over the table of files.
    """
    t = time_number(time_col, df)
    files = (df.select(F.col("_metadata.file_modification_time").alias("m"), F.col("_metadata.file_path").alias("f"), t.alias("t"))
             .groupBy("m", "f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")))
    so_far = Window.orderBy("m").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return files.select((F.max("hi").over(so_far) - F.col("lo")).alias("back")).agg(F.coalesce(F.max("back"), F.lit(0))).first()[0]


def one_batch(df: DataFrame, files_per_batch: int) -> bool:
    """Is a file source read in one micro-batch, in which no row can be late?"""
    return len(df.inputFiles()) <= files_per_batch


def in_time_order(spark: SparkSession, path: str, time_col: str, slices: int = 16) -> str:
    """A folder with the rows of ``path`` as slices of time, written one after another, so
    that a stream over it goes forward in time and rows wait for one slice at most.

    The slices' bounds are approximate quantiles of the time; each slice is one
    distributed write of the rows between two bounds (a filter on the scan).  Rows
    without a time come first.
    """
    df = spark.read.parquet(glob_of(path))
    t = time_number(time_col, df)
    cuts = df.select(t.alias("t")).agg(F.percentile_approx("t", [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ordered-{uuid.uuid4().hex}"
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = df.where(F.lit(True) if lo is None else t >= lo).where(F.lit(True) if hi is None else F.coalesce(t < hi, F.lit(True)))
        part.write.mode("append").parquet(folder)
    return folder


def run_stream(spark: SparkSession, path: str, make: Callable[[DataFrame, DataFrame], DataFrame], *,
               output: str | None = None, checkpoint: str | None = None, files_per_batch: int = 1,
               state_partitions: int | None = None, event_time: bool = True, operators: int = 1) -> DataFrame:
    """Run ``make(stream, end)`` over the Parquet files of ``path`` (a file, a folder
    or a pattern) until all input there now is processed, then tell it that the
    input has ended, which moves the watermark past all rows that wait; return
    what was written.

    ``output`` and ``checkpoint`` default to a fresh folder under
    ``spark.checkpoint.dir`` and must be shared storage on a cluster.  The state
    is kept in ``state_partitions`` partitions (default: the cluster's
    parallelism), fixed for the life of the checkpoint; the query runs in a
    child session so the caller's settings are untouched.  ``event_time=False``
    is for streams matched by the clock, which keep no rows waiting.  Input that
    is one micro-batch is told of its end in that batch, in one run.  ``operators``:
    stateful operators that hand rows on to each other; each takes a run of its
    own to give out what the one before held back.
    """
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    output, checkpoint = output or f"{run}/out", checkpoint or f"{run}/chk"
    child = spark.newSession()
    child.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    source = glob_of(path)
    schema = child.read.parquet(source).schema
    ends = f"{checkpoint.rstrip('/')}-end"
    child.range(0).write.mode("ignore").parquet(ends)
    if not event_time:  # timeouts by the clock ask for one empty batch after another
        child.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    once = event_time and one_batch(child.read.parquet(source), files_per_batch)
    for last in [False] * (not once) + [True] * (operators if event_time else 0):
        if last:
            child.range(1).write.mode("append").parquet(ends)
        src = child.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        out = make(src, child.readStream.schema("id long").parquet(ends))
        q = (out.writeStream.format("parquet").outputMode("append").option("path", output)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(output)


def measured_delay(spark: SparkSession, path: str, time_col: str, files_per_batch: int = 1) -> int:
    """The delay that keeps every row of the files: none in one micro-batch, else their ``disorder``."""
    df = spark.read.parquet(glob_of(path))
    return 0 if one_batch(df, files_per_batch) else disorder(df, time_col)


def run_stream_match_cut(spark: SparkSession, path: str, pattern: Pattern, partition_by, order_by, time_col: str,
                         timeout: str | int | None = None, delay: str | int | None = None,
                         capture: Sequence[str] = (), **kw) -> DataFrame:
    """``stream_match_cut`` over the files of ``path`` (``run_stream``).  Without
    ``delay`` it is measured (``disorder``), so that no row is late."""
    if delay is None:
        delay = measured_delay(spark, path, time_col, kw.get("files_per_batch", 1))
    return run_stream(spark, path, lambda s, end: stream_match_cut(
        s, pattern, partition_by, order_by, time_col, timeout, delay, capture=capture, end=end), **kw)


def run_stream_match_events(spark: SparkSession, path: str, pattern: Pattern, partition_by, order_by, time_col: str,
                            timeout: str | int | None = None, delay: str | int | None = None, **kw) -> DataFrame:
    """``stream_match_events`` over the files of ``path``, as ``run_stream_match_cut``."""
    if delay is None:
        delay = measured_delay(spark, path, time_col, kw.get("files_per_batch", 1))
    return run_stream(spark, path, lambda s, end: stream_match_events(
        s, pattern, partition_by, order_by, time_col, timeout, delay, end=end), **kw)
