"""64-bit ids, NULLs beside them, NULL captures and far-off times come through as they are."""

import datetime as dt

import pytest

from tidemark.functions.pattern import lit
from tidemark.operators import sequential as S
from tidemark.operators.matcher import match_cut, match_events, match_whole
from pyspark.sql import functions as F

A, B, C = (lit("ch", x) for x in "ABC")
BIG = 1 << 60


@pytest.fixture(autouse=True)
def small_blocks(spark):
    spark.conf.set("tidemark.blockRows", "3")
    yield
    spark.conf.unset("tidemark.blockRows")


@pytest.mark.parametrize("strategy", ["plain", "block"])
def test_long_keys_orders_captures(spark, strategy):
    rows = [(k, BIG + i, ch, None if ch == "B" else BIG + 10 * i + 1)
            for k in (None, BIG, BIG + 1) for i, ch in enumerate("ABXABXAB")]
    df = spark.createDataFrame(rows, "id long, pos long, ch string, v long")
    got = match_cut(df, A >> B, "id", "pos", capture=["v"], strategy=strategy).collect()
    want = {(k, m + 1, BIG + s, BIG + s + 1, BIG + 10 * s + 1, None)
            for k in (None, BIG, BIG + 1) for m, s in enumerate((0, 3, 6))}
    assert {(r.id, r.match_no, r.start_pos, r.end_pos, r.A_v, r.B_v) for r in got} == want and len(got) == 9
    ends = match_events(df, A >> B, "id", "pos", strategy=strategy).where("status = 'ENDED'")
    assert {r.id for r in ends.collect()} == {None, BIG, BIG + 1} and ends.count() == 3
    whole = match_whole(df, A >> B, "id", "pos", strategy=strategy).collect()
    assert {r.id for r in whole} == {None, BIG, BIG + 1} and len(whole) == 3


@pytest.mark.parametrize("strategy", ["plain", "block"])
def test_null_capture_replaces_older_value(spark, strategy):
    vals = [1, 2, 3, 4, 5, None, 7]
    df = spark.createDataFrame([("k", i, c, v) for i, (c, v) in enumerate(zip("ABBBBBC", vals))],
                               "k string, pos long, ch string, v long")
    got = match_cut(df, A >> B.one_or_more() >> C, "k", "pos", capture=["v"], strategy=strategy).collect()
    assert [(r.A_v, r.B_v, r.C_v) for r in got] == [(1, None, 7)]


@pytest.mark.parametrize("strategy", ["plain", "block"])
def test_years_beyond_nanoseconds(spark, strategy):
    t = [dt.datetime(1500, 1, 1), dt.datetime(2024, 5, 6, 7, 8, 9, 10), dt.datetime(9999, 12, 31)]
    df = spark.createDataFrame([("k", x, c) for x, c in zip(t, "ABX")], "k string, ts timestamp, ch string")
    got = match_cut(df, A >> B, "k", "ts", strategy=strategy).select(
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start_ts", "end_ts")]).collect()
    assert [tuple(r) for r in got] == [("1500-01-01 00:00:00.000000", "2024-05-06 07:08:09.000010")]


@pytest.mark.parametrize("strategy", ["plain", "block"])
def test_nested_depth_of_long_orders(spark, strategy):
    df = spark.createDataFrame([(k, BIG + i, c) for k in (None, BIG + 1) for i, c in enumerate("(())()")],
                               "id long, pos long, ch string")
    got = S.nested_depth(df, F.col("ch") == "(", F.col("ch") == ")", "id", "pos", strategy=strategy).collect()
    assert {(r.id, r.start_pos, r.end_pos) for r in got} == {
        (k, BIG + s, BIG + e) for k in (None, BIG + 1) for s, e in ((0, 3), (4, 5))}
