"""Windows, acknowledgements, folds and bucketed state in a stream: the batch answer."""

import glob
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from test_streaming import CUT, A, B, _events, _sorted, _write_batches
from tidemark.operators import windows as W
from tidemark.operators.matcher import match_cut
from tidemark.operators.sequential import fold
from tidemark.streaming.fold import stream_fold
from tidemark.streaming.stateful import disorder, in_time_order, run_stream, stream_match_cut
from tidemark.streaming.windows import stream_cascading, stream_first_after, stream_windows


@pytest.fixture(scope="module")
def folder(spark):
    """Three files in order of time, with NULL keys and a row without a time."""
    ev = _events(n_keys=4, n=60, seed=8).sort_values(["ts", "pos"])
    ev.loc[ev.index[-1], "ts"] = pd.NaT
    return _write_batches(spark, [ev.iloc[j * 80:(j + 1) * 80] for j in range(3)])


def _delay(spark, folder):
    return disorder(spark.read.parquet(folder), "ts")


@pytest.mark.parametrize("slide", [None, "10m"])
def test_windows(spark, folder, slide):
    d = _delay(spark, folder)
    aggs = [F.count(F.lit(1)).alias("n"), F.max("pos").alias("top")]
    got = run_stream(spark, folder, lambda s, end: stream_windows(s, "ts", "30m", slide, ["ch"], aggs, d, end))
    table = spark.read.parquet(folder).where("ts is not null")
    batch = W.tumbling(table, "ts", "30 minutes", ["ch"], aggs) if slide is None else W.sliding(table, "ts", "30 minutes", "10 minutes", ["ch"], aggs)
    cols = ("ch", "window_start", "n", "top")
    assert _sorted(got, *cols) == _sorted(batch, *cols) and got.count() > 5


def test_cascading(spark, folder):
    d = _delay(spark, folder)
    got = run_stream(spark, folder, lambda s, end: stream_cascading(s, "ts", "5m", "1h", ["ch"], d, end), operators=2)
    batch = W.cascading(spark.read.parquet(folder).where("ts is not null"), "ts", "5 minutes", "1 hour", ["ch"])
    cols = ("ch", "window_start", "n_events", "max_fine", "n_fine")
    assert _sorted(got, *cols) == _sorted(batch, *cols) and got.count() > 3


def test_acknowledgements(spark, folder):
    """Closed alerts and those left open, with the first of several acknowledgements."""
    d = _delay(spark, folder)
    a, b = F.col("ch") == "X", F.col("ch") == "B"
    got = run_stream(spark, folder, lambda s, end: stream_first_after(s, a, b, "key", ["ts", "pos"], ["pos", "ts"], "ts", "1m", d, end))
    rows = [r for r in spark.read.parquet(folder).collect() if r.ts is not None]
    want = []
    for r in rows:
        if r.ch == "X":
            later = sorted((x.ts, x.pos) for x in rows if x.key == r.key and x.ch == "B" and (x.ts, x.pos) > (r.ts, r.pos)
                           and (x.ts - r.ts).total_seconds() <= 60)
            want.append((r.key, r.pos, later[0][1] if later else None))
    assert _sorted(got, "key", "pos", "next_pos") == sorted(want, key=str)
    assert 0 < sum(w[2] is None for w in want) < len(want)


def _sessions():
    def step(st, row):
        return (st[0] + 1, (st[1] or 0) + row["pos"] % 100, st[2] or row["pos"]), []

    schema = T.StructType([T.StructField("first_pos", T.LongType()), T.StructField("n", T.LongType()), T.StructField("total", T.LongType())])
    return (lambda: (0, None, None)), step, (lambda st: [(st[2], st[0], st[1])] if st[0] else []), schema


@pytest.mark.parametrize("idle", ["100s", None])
def test_fold(spark, folder, idle):
    d = _delay(spark, folder)
    init, step, end_hook, schema = _sessions()
    got = run_stream(spark, folder, lambda s, end: stream_fold(
        s, "key", ["ts", "pos"], ["pos"], init, step, end_hook, schema, "ts", idle=idle, delay=d, end=end))
    table = spark.read.parquet(folder).where("ts is not null").withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    reset = None
    if idle:
        from pyspark.sql import Window
        prev = F.lag("_t").over(Window.partitionBy("key").orderBy("ts", "pos"))
        table = table.withColumn("_new", F.col("_t") - prev > W.duration_micros(idle))
        reset = F.col("_new")
    batch = fold(table, "key", ["ts", "pos"], ["pos"], init, step, end_hook, schema, reset=reset, strategy="plain")
    cols = ("key", "first_pos", "n", "total")
    assert _sorted(got, *cols) == _sorted(batch, *cols) and got.count() >= 2


def test_fold_of_hot_keys_by_combine(spark):
    """Running totals and an end row: blocks folded apart and combined."""
    rng = random.Random(4)
    rows = [(k, i, rng.choice([None, 1, 2, 5])) for k, n in (("hot", 200), (None, 60), ("c", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, pos long, v long")

    def step(st, row):
        st = (st[0] + 1, st[1] + (row["v"] or 0))
        return st, [("row", row["pos"], st[1])] if row["v"] == 5 else []

    schema = T.StructType([T.StructField("what", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("total", T.LongType())])
    args = (["pos", "v"], lambda: (0, 0), step, lambda st: [("end", st[0], st[1])], schema)
    combine = lambda a, b: (a[0] + b[0], a[1] + b[1])
    want = _sorted(fold(df, "key", "pos", *args, strategy="plain"), "key", "what", "pos", "total")
    hot = df.where("key = 'hot'")
    want1 = _sorted(fold(hot, [], "pos", *args, strategy="plain"), "what", "pos", "total")
    spark.conf.set("tidemark.blockRows", "7")
    spark.conf.set("tidemark.hotKeyRows", "20")
    try:
        assert _sorted(fold(df, "key", "pos", *args, combine=combine), "key", "what", "pos", "total") == want
        assert _sorted(fold(hot, [], "pos", *args, combine=combine), "what", "pos", "total") == want1
    finally:
        spark.conf.unset("tidemark.blockRows")
        spark.conf.unset("tidemark.hotKeyRows")


def test_state_of_a_hot_key_grows_linearly(spark):
    """Bytes of state written for one key, by files in order of time: four times the
    rows write about four times the bytes."""
    def written(n):
        ev = pd.DataFrame([(1, i, pd.Timestamp(i * 10, unit="s"), "AB"[i % 2]) for i in range(n)], columns=["key", "pos", "ts", "ch"])
        folder = _write_batches(spark, [ev.iloc[j:j + 250] for j in range(0, n, 250)])
        chk = f"{folder}-chk"
        out = run_stream(spark, folder, lambda s, end: stream_match_cut(s, A >> B, "key", ["ts", "pos"], "ts", delay=0, end=end),
                         checkpoint=chk, state_partitions=1)
        assert out.count() == n // 2
        return sum(os.path.getsize(f) for f in glob.glob(f"{chk}/state/**/*.delta", recursive=True))

    small, big = written(1000), written(4000)
    assert big < 6 * small


def test_input_written_in_time_order(spark):
    ev = _events(n_keys=2, n=200).sample(frac=1, random_state=1)
    folder = in_time_order(spark, _write_batches(spark, [ev]), "ts", slices=8)
    table = spark.read.parquet(folder)
    span = (ev["ts"].max() - ev["ts"].min()).total_seconds() * 1e6
    assert table.count() == len(ev) and disorder(table, "ts") < span / 3
