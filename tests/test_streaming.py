"""Streaming matchers (O12, O17, P13, P21): micro-batches give the batch answer."""
import os
import random
import time
import uuid

import pandas as pd
import pytest

from tidemark.functions.pattern import lit
from tidemark.operators.matcher import match_cut, match_events
from tidemark.session import ensure_checkpoint_dir
from tidemark.streaming.stateful import (
    disorder, run_stream, run_stream_match_cut, run_stream_match_events, stream_match_cut, stream_match_events,
)

A, B, C = (lit("ch", x) for x in "ABC")
BIG = 1 << 60


def _write_batches(spark, frames):
    """A folder of files whose modification times follow their order."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/src-{uuid.uuid4().hex}"
    os.makedirs(folder)
    now = time.time() - 1000
    for i, f in enumerate(frames):
        name = f"{folder}/part-{i:03d}.parquet"
        f.to_parquet(name, index=False, coerce_timestamps="us")
        os.utime(name, (now + i, now + i))
    return folder


def _events(n_keys=5, n=120, seed=5):
    random.seed(seed)
    rows = []
    for k in range(n_keys):
        t = 0
        for i in range(n):
            t += random.choice([10, 20, 30, 200])
            rows.append((None if k == 0 else BIG + k, BIG + i, pd.Timestamp(t, unit="s"), random.choice("AABX")))
    df = pd.DataFrame(rows, columns=["key", "pos", "ts", "ch"])
    df["key"] = df["key"].astype("Int64")
    return df


def _sorted(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


CUT = ("key", "match_no", "start_pos", "end_pos", "n_events", "alt", "A_pos")


@pytest.mark.parametrize("shuffled", [False, True])
def test_micro_batches_equal_batch(spark, shuffled):
    """Three files, in order of time or not, NULL and 64-bit keys."""
    ev = _events()
    ev = ev.sample(frac=1, random_state=3) if shuffled else ev.sort_values(["ts", "pos"])
    folder = _write_batches(spark, [ev.iloc[j * 200:(j + 1) * 200] for j in range(3)])
    p = (A >> B) | (A >> A >> B)
    got = run_stream_match_cut(spark, folder, p, "key", ["ts", "pos"], "ts", "1m", capture=["pos"])
    table = spark.read.parquet(folder)
    batch = match_cut(table, p, "key", ["ts", "pos"], time_col="ts", timeout="1m", strategy="plain", capture=["pos"])
    g = _sorted(got, *CUT)
    assert g and g == _sorted(batch, *CUT)
    assert disorder(table, "ts") > 0


def test_rows_within_the_delay_are_kept(spark):
    """The order 0, 2 then 1: row 1 is out of order by less than the delay."""
    ev = pd.DataFrame([(1, i, pd.Timestamp(i * 60, unit="s"), c) for i, c in enumerate("ABC")], columns=["key", "pos", "ts", "ch"])
    folder = _write_batches(spark, [ev.iloc[[0, 2]], ev.iloc[[1]]])
    got = run_stream_match_cut(spark, folder, A >> B >> C, "key", ["ts", "pos"], "ts", delay="1h").collect()
    assert [(r.match_no, r.start_pos, r.end_pos, r.n_events) for r in got] == [(1, 0, 2, 3)]


def test_late_rows_are_dropped(spark):
    ev = _events(n_keys=2, n=60, seed=9).sort_values(["ts", "pos"])
    parts = [ev.iloc[:40], ev.iloc[40:80], ev.iloc[80:]]
    late = ev.iloc[[5]].copy()  # an old row arriving again, when the watermark is past it
    late["pos"] = 10_000
    folder = _write_batches(spark, [parts[0], parts[1], pd.concat([parts[2], late])])
    got = run_stream_match_cut(spark, folder, A >> B, "key", ["ts", "pos"], "ts", "1h", delay=0, capture=["pos"])
    batch = match_cut(spark.createDataFrame(ev), A >> B, "key", ["ts", "pos"], time_col="ts", timeout="1h", strategy="plain",
                      capture=["pos"])
    assert _sorted(got, *CUT) == _sorted(batch, *CUT)


def test_statuses_of_every_event(spark):
    ev = _events(n_keys=3, n=40, seed=2).sort_values(["ts", "pos"])
    folder = _write_batches(spark, [ev.iloc[:50], ev.iloc[50:]])
    cols = ("key", "pos", "status", "attempt_id", "step", "alt", "label", "fail_expected", "fail_got")
    got = run_stream_match_events(spark, folder, A >> B, "key", ["ts", "pos"], "ts", "1m")
    batch = match_events(spark.read.parquet(folder), A >> B, "key", ["ts", "pos"], time_col="ts", timeout="1m", final="none",
                         strategy="plain")
    assert _sorted(got, *cols) == _sorted(batch, *cols) and got.count() == 120


def test_processing_time_and_a_single_file(spark):
    ev = pd.DataFrame([(1, i, pd.Timestamp(i, unit="s"), c) for i, c in enumerate("ABXAB")], columns=["key", "pos", "ts", "ch"])
    folder = _write_batches(spark, [ev])
    got = run_stream(spark, f"{folder}/part-000.parquet",
                     lambda s, end: stream_match_cut(s, A >> B, "key", "pos", None, "1h", forget="1h"), event_time=False).collect()
    assert sorted((r.match_no, r.start_pos, r.end_pos) for r in got) == [(1, 0, 1), (2, 3, 4)]


def test_idle_keys_are_forgotten(spark):
    rows = [(k, i, pd.Timestamp(t, unit="s"), c) for k, t0 in ((1, 0), (2, 100_000), (2, 200_000), (1, 300_000))
            for i, (t, c) in enumerate(((t0, "A"), (t0 + 1, "B")))]
    ev = pd.DataFrame(rows, columns=["key", "pos", "ts", "ch"])
    folder = _write_batches(spark, [ev.iloc[i:i + 2] for i in range(0, 8, 2)])

    def numbers(forget):
        out = run_stream(spark, folder, lambda s, end: stream_match_cut(
            s, A >> B, "key", ["ts", "pos"], "ts", delay=0, forget=forget, end=end)).collect()
        return sorted((r.key, r.match_no) for r in out)

    assert numbers(None) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert numbers("30000s") == [(1, 1), (1, 1), (2, 1), (2, 2)] or numbers("30000s") == [(1, 1), (1, 1), (2, 1), (2, 1)]


def test_no_state_for_an_empty_stream(spark):
    folder = _write_batches(spark, [_events(1, 3).iloc[:0]])
    out = run_stream(spark, folder, lambda s, end: stream_match_events(s, A >> B, "key", ["ts", "pos"], "ts", end=end))
    assert out.count() == 0
