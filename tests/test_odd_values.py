"""Rolling sums of doubles, times that are NULL, stored tables that are gone."""

import datetime as dt
import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.functions.pattern import lit
from tidemark.operators import windows as W
from tidemark.operators.matcher import match_cut, match_events
from tidemark.plans import skew

SCHEMA = "k string, ts timestamp_ntz, id long, v double, n long, d decimal(20,2)"
NAN, INF = math.nan, math.inf


def _rows(seed=2, n=120):
    rng = random.Random(seed)
    odd = [NAN, INF, -INF, None, 1e18, -1e18, 5e-324, 1.7e308, 0.1, -0.0]
    out = []
    for i in range(n):
        t = None if rng.random() < 0.05 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 400))
        v = rng.choice(odd) if rng.random() < 0.25 else round(rng.uniform(-100, 100), 3)
        out.append((rng.choice([None, "x", "x", "y"]), t, i, v, i % 7, None))
    return out


def _want(rows, minutes=60):
    want = {}
    for k, t, i, *_ in rows:
        near = [r for r in rows if r[0] == k and ((r[1] is None) == (t is None))
                and (t is None or t - dt.timedelta(minutes=minutes) <= r[1] <= t)]
        v = [r[3] for r in near if r[3] is not None]
        if any(x != x for x in v) or (INF in v and -INF in v):
            s = NAN
        elif INF in v or -INF in v:
            s = INF if INF in v else -INF
        else:
            try:
                s = math.fsum(v)
            except OverflowError:
                s = INF if sum(x / 2 for x in v) > 0 else -INF
        want[i] = (s, sum(r[4] for r in near))
    return want


@pytest.mark.parametrize("strategy", ["plain", "block"])
@pytest.mark.parametrize("seed", [2, 3])
def test_rolling_sums_of_doubles(spark, strategy, seed):
    """NaN, infinities, 1e18 and mixed magnitudes: the exact sum of each range, rounded
    once, whichever plan."""
    rows = _rows(seed)
    spark.conf.set("tidemark.blockRows", "9")
    try:
        out = W.rolling(spark.createDataFrame(rows, SCHEMA), "ts", "1h", "k",
                        totals={"s": F.col("v"), "c": F.col("n"), "s2": F.col("v") * 0}, strategy=strategy)
        assert out.columns == ["k", "ts", "id", "v", "n", "d", "s", "c", "s2"]
        got = {r.id: (r.s, r.c) for r in out.collect()}
    finally:
        spark.conf.unset("tidemark.blockRows")
    assert {i: repr(x) for i, x in got.items()} == {i: repr(x) for i, x in _want(rows).items()}


def test_a_large_value_leaves_nothing_behind(spark):
    rows = [("x", dt.datetime(2024, 1, 1, h), h, v, 0, None) for h, v in enumerate([1e18, 4.25, 3.25, 6.25, NAN, 1.5, 2.5, 1.0])]
    out = W.rolling(spark.createDataFrame(rows, SCHEMA), "ts", "1h", "k", totals={"s": F.col("v")}).orderBy("id").collect()
    assert [repr(r.s) for r in out] == ["1e+18", "1e+18", "7.5", "9.5", "nan", "nan", "4.0", "3.5"]


def test_rolling_without_key_and_empty(spark):
    rows = _rows(5, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: repr((r.s, r.c)) for r in W.rolling(df, "ts", "1h", [], totals={"s": F.col("v"), "c": F.col("n")}).collect()}
    assert got == {i: repr(x) for i, x in _want([(None, *r[1:]) for r in rows]).items()}
    assert W.rolling(df.where("false"), "ts", "1h", "k", totals={"s": F.col("v")}).count() == 0


def _walk(rows, lim):
    """Cut matches of ``a b`` with a timeout, by hand: (key, start, end)."""
    out = []
    for k in {r[0] for r in rows}:
        open_, last = None, None
        for _, t, i, ty in sorted((r for r in rows if r[0] == k), key=lambda r: r[2]):
            if open_ is not None and t is not None and last is not None and t - last > lim:
                open_ = None
            if open_ is None:
                open_ = i if ty == "a" else None
            else:
                if ty == "b":
                    out.append((k, open_, i))
                open_ = None
            last = t
    return sorted(out, key=repr)


@pytest.mark.parametrize("strategy", ["plain", "block"])
def test_null_times_and_timeouts(spark, strategy):
    """Next to an event without a time there is no gap, across blocks and batches too."""
    rng = random.Random(6)
    base, rows = dt.datetime(2024, 1, 1), []
    for i in range(150):
        base += dt.timedelta(minutes=rng.choice([1, 1, 90]))
        rows.append((rng.choice([None, "x"]), base if rng.random() < 0.7 else None, i, rng.choice("aab")))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, ty string")
    p = lit("ty", "a") >> lit("ty", "b")
    spark.conf.set("tidemark.blockRows", "5")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        m = match_cut(df, p, "k", "id", time_col="ts", timeout="1h", strategy=strategy)
        assert sorted(((r.k, r.start_id, r.end_id) for r in m.collect()), key=repr) == _walk(rows, dt.timedelta(hours=1))
        ev = match_events(df, p, "k", "id", time_col="ts", timeout="1h", strategy=strategy).where("status = 'SUCCESS'")
        assert sorted(((r.k, r.id) for r in ev.collect()), key=repr) == sorted(((k, e) for k, _, e in _walk(rows, dt.timedelta(hours=1))), key=repr)
    finally:
        spark.conf.unset("tidemark.blockRows")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_removed_tables_of_hot_keys_are_made_again(spark):
    df = spark.range(300).select((F.col("id") % 2).cast("string").alias("k"), "id", F.lit("a").alias("ty"))
    spark.conf.set("tidemark.hotKeyRows", "100")
    try:
        want = match_cut(df, lit("ty", "a") >> lit("ty", "a"), "k", "id").count()
        for _, _, path in list(skew._STATS_CACHE.values()):
            if path:
                shutil.rmtree(path.replace("file:", ""), ignore_errors=True)
        assert match_cut(df, lit("ty", "a") >> lit("ty", "a"), "k", "id").count() == want == 150
    finally:
        spark.conf.unset("tidemark.hotKeyRows")


@pytest.mark.parametrize("strategy", ["plain", "block"])
def test_columns_named_as_results(spark, strategy):
    """Order, key and carried columns that clash with results, and dots in names."""
    from tidemark.operators.matcher import match_whole

    rows = [("x", i, "ab"[i % 2], i * 10) for i in range(8)]
    df = spark.createDataFrame(rows, "`match_no` string, `status` long, ty string, `a.b` long")
    p = lit("ty", "a") >> lit("ty", "b")
    spark.conf.set("tidemark.blockRows", "3")
    try:
        ev = match_events(df, p, "match_no", "status", carry=["a.b"], strategy=strategy)
        assert ev.columns[:3] == ["match_no", "in_status", "a_b"] and ev.where("status = 'SUCCESS'").count() == 4
        assert [r.a_b for r in ev.where("status = 'SUCCESS'").orderBy("in_status").collect()] == [10, 30, 50, 70]
        m = match_cut(df, p, "match_no", ["a.b"], strategy=strategy).orderBy("match_no")
        assert m.columns[:4] == ["in_match_no", "match_no", "start_a_b", "end_a_b"]
        assert [tuple(r)[:4] for r in m.collect()] == [("x", i + 1, 20 * i, 20 * i + 10) for i in range(4)]
        w = match_whole(df, p.one_or_more(), "match_no", "status", strategy=strategy).collect()
        assert [(r.match_no, r.status, r.n_events) for r in w] == [("x", "SUCCESS", 8)]
    finally:
        spark.conf.unset("tidemark.blockRows")


@pytest.mark.parametrize("strategy", ["plain", "block"])
def test_running_sums_of_an_attempt(spark, strategy):
    """Sums so far on every event of an attempt, over long attempts cut by blocks and batches."""
    rng = random.Random(9)
    rows = [(rng.choice([None, "x", "x"]), i, rng.choice("abbbbbbc"), rng.choice([None, 1, 5, 1 << 40])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id long, ty string, v long")
    p = lit("ty", "a") >> lit("ty", "b").one_or_more() >> lit("ty", "c")
    spark.conf.set("tidemark.blockRows", "4")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = match_events(df, p, "k", "id", sums={"s": F.col("v"), "d": F.col("v").cast("decimal(20,2)")}, strategy=strategy).collect()
    finally:
        spark.conf.unset("tidemark.blockRows")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    value = {i: v or 0 for _, i, _, v in rows}
    want, now = {}, {}
    for r in sorted((r for r in out if r.id is not None), key=lambda r: r.id):
        now[r.k] = value[r.id] + (now[r.k] if r.step > 1 else 0)
        want[r.id] = now[r.k]
    assert {r.id: r.s for r in out if r.id is not None} == want and {r.id: int(r.d) for r in out if r.id is not None} == want
    assert max(r.step for r in out) > 8 and all(r.s is None for r in out if r.id is None)
