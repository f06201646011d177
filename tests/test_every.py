"""Full patterns from every start and in windows, against regular expressions over
the event types, on the plain plan and with every key cut into small blocks."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.pattern import lit
from tidemark.operators import every
from tidemark.operators import windows as W

DAY = 86_400_000_000
HOUR = DAY // 24


def _p(t):
    return lit("ty", t)


# patterns with one path at most, and the same as expressions
PATTERNS = {
    "ab+c": (_p("a") >> _p("b").one_or_more() >> _p("c"), "ab+c"),
    "ab?c|bb": ((_p("a") >> _p("b").optional() >> _p("c")) | (_p("b") >> _p("b")), "ab?c|bb"),
    "a(b|c)*d": (_p("a") >> (_p("b") | _p("c")).repeated() >> _p("d"), "a[bc]*d"),
    "aa": (_p("a") >> _p("a"), "aa"),
    "none": (_p("z"), "z"),
}


def _events(n, seed, letters="abcd", nulls=True):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = rng.choice([None, "x", "x", "x", "y"]) if nulls else rng.choice("xy")
        rows.append((key, base + dt.timedelta(minutes=rng.randint(0, 4 * 24 * 60)), i, rng.choice(letters)))
    return rows


SCHEMA = "k string, ts timestamp_ntz, id long, ty string"


def _by_key(rows, extra=lambda r: ()):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault((r[0], *extra(r)), []).append(r)
    return out


def _every(rows, rx, max_gap=None):
    """(start index, end index) of the first completion from every start."""
    text = "".join(r[3] for r in rows)
    out = []
    for i in range(len(rows)):
        for j in range(i, len(rows)):
            if max_gap and j > i and rows[j][1] - rows[j - 1][1] > max_gap:
                break
            if re.fullmatch(rx, text[i:j + 1]):
                out.append((i, j))
                break
    return out


def micros(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(params=["plain", "block"])
def strategy(request, spark):
    if request.param == "block":
        spark.conf.set("tidemark.hotKeyRows", "0")
        spark.conf.set("tidemark.blockRows", "5")
    yield "auto"
    spark.conf.unset("tidemark.hotKeyRows")
    spark.conf.unset("tidemark.blockRows")


@pytest.mark.parametrize("name", list(PATTERNS))
def test_every_start(spark, strategy, name):
    p, rx = PATTERNS[name]
    rows = _events(120, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(((k[0], rs[i][2], rs[j][2], j - i + 1, rs[i][3], rs[j][3]) for k, rs in _by_key(rows).items()
                   for i, j in _every(rs, rx)), key=repr)
    got = W.match_every(df, p, "k", ["ts", "id"], keep=["ty"])
    assert _rows(got.select("k", "start_id", "end_id", "n_events", "start_ty", "end_ty")) == want
    gap = dt.timedelta(hours=2)
    want = sorted(((k[0], rs[i][2], rs[j][2]) for k, rs in _by_key(rows).items() for i, j in _every(rs, rx, gap)), key=repr)
    got = W.match_every(df, p, "k", ["ts", "id"], time_col="ts", max_gap="2h")
    assert _rows(got.select("k", "start_id", "end_id")) == want


def test_every_start_without_key_across_batches(spark, strategy):
    p, rx = PATTERNS["a(b|c)*d"]
    rows = _events(80, 5, "abbbccd")
    rs = sorted(rows, key=lambda r: (r[1], r[2]))
    want = sorted(((rs[i][2], rs[j][2]) for i, j in _every(rs, rx)), key=repr)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = W.match_every(spark.createDataFrame(rows, SCHEMA), p, [], ["ts", "id"])
        assert _rows(got.select("start_id", "end_id")) == want
        assert W.match_every(spark.createDataFrame([], SCHEMA), p, [], ["ts", "id"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_attempts_share_their_end(spark, strategy):
    """Every a of a run is a live start until the c: one entry per state, not per start."""
    rows = [("x", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, "a") for i in range(300)]
    rows.append(("x", dt.datetime(2024, 1, 2), 300, "c"))
    got = W.match_every(spark.createDataFrame(rows, SCHEMA), _p("a").one_or_more() >> _p("c"), "k", ["ts", "id"])
    assert _rows(got.select("start_id", "end_id", "n_events")) == [(i, 300, 301 - i) for i in sorted(range(300), key=lambda i: repr((i, 300)))]


@pytest.mark.parametrize("n", [1, 3, 10])
def test_in_last_n(spark, strategy, n):
    p, rx = PATTERNS["ab+c"]
    rows = _events(150, 7, "abbc")
    want = []
    for k, rs in _by_key(rows).items():
        found = _every(rs, rx)
        for c in range(len(rs)):
            want.append((k[0], rs[c][2], int(any(j <= c and i > c - n for i, j in found))))
    got = W.in_last_n(spark.createDataFrame(rows, SCHEMA), p, n, "k", ["ts", "id"])
    assert _rows(got.select("k", "id", "hit")) == sorted(want, key=repr)


@pytest.mark.parametrize("length,slide", [("1h", "15m"), ("6h", "5h"), ("1d", None)])
def test_window_contains(spark, strategy, length, slide):
    p, rx = PATTERNS["ab?c|bb"]
    rows = _events(200, 11, "abc")
    size, by = W.duration_micros(length), W.duration_micros(slide or length)
    want = {}
    for k, rs in _by_key(rows).items():
        for i, j in _every(rs, rx):
            a, b = micros(rs[i][1]), micros(rs[j][1])
            for w in range((b - size) // by + 1, a // by + 1):
                assert w * by <= a and b < w * by + size
                want[k[0], w * by] = want.get((k[0], w * by), 0) + 1
    got = W.window_contains(spark.createDataFrame(rows, SCHEMA), p, "k", ["ts", "id"], "ts", length, slide)
    assert _rows(got.select("k", "window_start", "n_matches")) == sorted(((*k, v) for k, v in want.items()), key=repr)


def _days(rows):
    return _by_key(rows, lambda r: (micros(r[1]) // DAY * DAY,))


def test_window_edges(spark, strategy):
    rows = _events(120, 13, "abbc")
    want = []
    for (k, day), rs in _days(rows).items():
        text = "".join(r[3] for r in rs)
        want.append((k, day, int(bool(re.match("ab?c|bb", text))), int(bool(re.search("(?:b+c)$", text)))))
    got = W.window_edges(spark.createDataFrame(rows, SCHEMA), PATTERNS["ab?c|bb"][0], _p("b").one_or_more() >> _p("c"),
                         "k", ["ts", "id"], "ts")
    assert _rows(got.select("k", "window_start", "starts_with", "ends_with")) == sorted(want, key=repr)
    # a predicate beside a pattern
    got = W.window_edges(spark.createDataFrame(rows, SCHEMA), F.col("ty") == "a", _p("c"), "k", ["ts", "id"], "ts")
    want = [(k, d, int(rs[0][3] == "a"), int(rs[-1][3] == "c")) for (k, d), rs in _days(rows).items()]
    assert _rows(got.select("k", "window_start", "starts_with", "ends_with")) == sorted(want, key=repr)


def test_window_all_of(spark, strategy):
    rows = _events(150, 17, "abc")
    want = [(k, d) for (k, d), rs in _days(rows).items() if all(x in "".join(r[3] for r in rs) for x in ("ab", "ca"))]
    got = W.window_all_of(spark.createDataFrame(rows, SCHEMA), {"x": _p("a") >> _p("b"), "y": _p("c") >> _p("a")}, "k", "ts",
                          order_by=["ts", "id"])
    assert _rows(got) == sorted(want, key=repr)
    want = [(k, d) for (k, d), rs in _days(rows).items() if "ab" in "".join(r[3] for r in rs) and any(r[3] == "c" for r in rs)]
    got = W.window_all_of(spark.createDataFrame(rows, SCHEMA), {"x": _p("a") >> _p("b"), "y": F.col("ty") == "c"}, "k", "ts",
                          order_by=["ts", "id"])
    assert _rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("days", [1, 2])
def test_window_lacking(spark, strategy, days):
    rows = _events(60, 19, "abc")
    want = []
    for k, rs in _by_key(rows).items():
        lo = micros(rs[0][1]) // DAY
        for d in range(lo, micros(rs[-1][1]) // DAY + 1, days):
            text = "".join(r[3] for r in rs if d <= micros(r[1]) // DAY < d + days)
            if not re.search("ab", text):
                want.append((k[0], str(dt.date(1970, 1, 1) + dt.timedelta(days=d))))
    got = W.window_lacking(spark.createDataFrame(rows, SCHEMA), _p("a") >> _p("b"), "k", "ts", days, order_by=["ts", "id"])
    assert _rows(got.select("k", F.col("day").cast("string"))) == sorted(want, key=repr)


def test_null_times_and_empty_tables(spark, strategy):
    rows = [("x", None, 1, "a"), ("x", dt.datetime(2024, 1, 1), 2, "b"), ("x", dt.datetime(2024, 1, 3), 3, "c"), (None, None, 4, "a")]
    p = _p("a") >> _p("b") >> _p("c")
    df = spark.createDataFrame(rows, SCHEMA)
    assert _rows(W.match_every(df, p, "k", ["id"], time_col="ts", max_gap="3d").select("start_id", "end_id")) == [(1, 3)]
    assert W.match_every(df, p, "k", ["id"], time_col="ts", max_gap="1d").count() == 0
    assert W.window_contains(df, p, "k", ["id"], "ts").count() == 0
    for d in (df, df.where("false")):
        assert every.window_lacking(d, p, "k", ["id"], "ts").count() == (3 if d is df else 0)
        assert W.window_edges(d, p, p, "k", ["id"], "ts").count() == (2 if d is df else 0)
    assert W.in_last_n(df.where("false"), p, 3, "k", ["id"]).count() == 0
