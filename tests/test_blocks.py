"""Blocks of hot keys hold about equal rows whatever their order columns are."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.pattern import alt, lit, step
from tidemark.operators import windows as W
from tidemark.operators.matcher import match_cut, match_events
from tidemark.plans.skew import HotKeys

T0 = dt.datetime(2024, 1, 1)
N = 2000
ORDERS = {
    "bursty": ("ts timestamp", lambda i: T0 + dt.timedelta(microseconds=i) if i else dt.datetime(9999, 1, 1)),
    "score": ("x double", lambda i: i / N),
    "string": ("s string", lambda i: f"{i:05d}"),
    "tied": ("d int, i long", lambda i: (7, i)),
    "some null": ("i long", lambda i: i if i else None),
}


@pytest.fixture(autouse=True)
def small_blocks(spark):
    spark.conf.set("tidemark.blockRows", "200")
    spark.conf.set("tidemark.hotKeyRows", "1000")
    yield
    spark.conf.unset("tidemark.blockRows")
    spark.conf.unset("tidemark.hotKeyRows")


def _frame(spark, name, key="k"):
    cols, value = ORDERS[name]
    rows = [(key, "ABX"[i % 3], *(v if isinstance(v := value(i), tuple) else (v,))) for i in range(N)]
    rows += [("cold", "A", *r[2:]) for r in rows[:20]]
    df = spark.createDataFrame(rows, f"key string, ch string, {cols}")
    return df, df.columns[2:]


@pytest.mark.parametrize("name", list(ORDERS))
@pytest.mark.parametrize("key", ["k", None])
def test_even_blocks(spark, name, key):
    df, orders = _frame(spark, name, key)
    hk = HotKeys(df, ["key"], orders)
    cold, hot = hk.split(df)
    sizes = [r["count"] for r in hot.groupBy("_sk_blk").count().collect()]
    assert (hk.n_keys, cold.count(), sum(sizes)) == (1, 20, N)
    assert len(sizes) >= 8 and max(sizes) <= 400
    p = lit("ch", "A") >> lit("ch", "B")
    want = match_cut(df, p, "key", orders, strategy="plain").collect()
    assert sorted(map(str, match_cut(df, p, "key", orders).collect())) == sorted(map(str, want)) and len(want) > 600


def test_keyless_string_order(spark):
    df, orders = _frame(spark, "string")
    df = df.where("key = 'k'")
    assert len(HotKeys(df, [], orders).split(df)[1].select("_sk_blk").distinct().collect()) >= 8
    p = lit("ch", "A") >> lit("ch", "B")
    got, want = (match_cut(df, p, [], orders, strategy=s).collect() for s in ("auto", "plain"))
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_many_predicates_keep_blocks(spark):
    """Over 4,096 combinations of predicates: few states, so still split."""
    df = spark.createDataFrame([("k", i, i % 20) for i in range(N)], "key string, pos long, v int")
    steps = [step(f"s{j}", (F.col("v") == j) | (F.col("v") == 19)) for j in range(15)]
    chain = steps[0]
    for s in steps[1:]:
        chain = chain >> s
    wide = alt(*steps[1:]) >> steps[0]
    for p in (chain, wide):
        out = [sorted(map(str, match_events(df, p, "key", "pos", strategy=s).collect())) for s in ("plain", "block")]
        assert out[0] == out[1]
    with pytest.raises(ValueError, match="63 distinct predicates"):
        match_cut(df, alt(*[lit("v", j) for j in range(64)]) >> lit("v", 0), "key", "pos")


@pytest.mark.parametrize("strategy", ["plain", "block"])
def test_rolling(spark, strategy):
    spark.conf.set("tidemark.blockRows", "5")
    at = [0, 1, 1, 2, 7, 8, 8, 8, 15, 30, 31, 32, 33, 34, 60, None, None]
    rows = [(k, i, None if t is None else T0 + dt.timedelta(minutes=t), i if i % 4 else None)
            for k in (None, "k") for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "key string, i long, ts timestamp, v long")
    for minutes in (0, 1, 7, 1000):
        got = W.rolling(df, "ts", f"{minutes}m", "key", aggs={"top": F.max("i")},
                        totals={"n": F.lit(1), "s": F.col("v")}, strategy=strategy).collect()
        assert len(got) == len(rows)
        for r in got:
            t = at[r.i]
            inside = [j for j, u in enumerate(at) if (u is None if t is None else u is not None and t - minutes <= u <= t)]
            assert (r.n, r.s, r.top) == (len(inside), sum(j for j in inside if j % 4), max(inside)), (minutes, r)
