"""Plain and block plans agree where keys and orders are NULL or tied."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.pattern import lit
from tidemark.operators import sequential as S
from tidemark.operators import windows as W
from tidemark.operators.matcher import match_cut

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rows = []
    for key in (None, "k", "m"):
        for i in range(12):
            pos = None if key == "m" else i if i != 5 else None
            rows.append((key, pos, "A" if i % 4 else "B", T0 + dt.timedelta(hours=6 * i)))
    return spark.createDataFrame(rows, "key string, pos long, ch string, ts timestamp")


@pytest.fixture(autouse=True)
def small_blocks(spark):
    spark.conf.set("tidemark.blockRows", "3")
    yield
    spark.conf.unset("tidemark.blockRows")


def _same(make, *strategies):
    plain, block = (sorted(map(str, make(s).collect())) for s in ("plain", "block"))
    assert plain == block
    return plain


def test_fold(events):
    d = events.where("pos is not null")
    out = _same(lambda s: S.fold(
        d, "key", "pos", ["pos"], lambda: 0, lambda n, row: (n + 1, []), lambda n: [(n,)],
        T.StructType([T.StructField("n", T.LongType())]), reset=F.col("ch") == "B", strategy=s))
    assert sum("key=None" in r for r in out) == sum("key='k'" in r for r in out) == 3  # rows 0-3, 4-7, 8-11


def test_first_after(events):
    d = events.where("pos is not null")
    out = _same(lambda s: W.first_after(d, F.col("ch") == "A", F.col("ch") == "B", "key", "pos", ["pos"], strategy=s))
    got = {}
    for r in W.first_after(d, F.col("ch") == "A", F.col("ch") == "B", "key", "pos", ["pos"], strategy="block").collect():
        got[(r.key, r.pos)] = r.next_pos
    assert got[(None, 1)] == 4 and got[(None, 6)] == 8 and got[(None, 9)] is None and len(out) == len(got)


def test_not_followed_within(events):
    out = _same(lambda s: W.not_followed_within(events, F.col("ch") == "A", F.col("ch") == "B", "13h", "key", "ts", strategy=s))
    assert len(out) == 3 * (1 + 1 + 3)  # the first after a B, 18 hours before the next, and the open tail


def test_all_null_orders(events):
    d = events.where("key = 'm'")
    _same(lambda s: W.match_every(d, [F.col("ch") == "A"], "key", "pos", strategy=s))


def test_lacking_windows(events):
    two = {(r.key, str(r.day)) for r in W.window_lacking(events, F.col("ch") == "B", "key", "ts", 2).collect()}
    assert two == set()  # every two-day window has a B
    none = {(r.key, str(r.day)) for r in W.window_lacking(events, F.col("ch") == "C", "key", "ts", 2).collect()}
    assert none == {(k, d) for k in (None, "k", "m") for d in ("2024-01-01", "2024-01-03")}


def test_equal_literals_of_two_types(spark):
    d = spark.createDataFrame([("k", 1, 1.0)], "key string, pos long, x double")
    p = lit("x", 1) | lit("x", 1.0)
    assert match_cut(d, p, "key", "pos").count() == match_cut(d, p, "key", "pos", strategy="plain").count() == 0
