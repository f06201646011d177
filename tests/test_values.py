"""Captures follow the path that matched; branches, parts and constants give values."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.pattern import alt, completed, lit, step
from tidemark.operators.matcher import match_cut, match_lists

A, B, C, D = (lit("ch", x) for x in "ABCD")


@pytest.fixture(autouse=True)
def small_blocks(spark):
    spark.conf.set("tidemark.blockRows", "3")
    yield
    spark.conf.unset("tidemark.blockRows")


@pytest.fixture(params=["auto", "plain", "block"])
def run(request, chars):
    def go(pattern, text, **kw):
        out = match_cut(chars(text), pattern, "key", "pos", strategy=request.param, **kw)
        return out.orderBy("match_no").collect()
    return go


def test_keep_left_and_right_of_one_name(run):
    assert [r.A_pos for r in run(A.keep_left(A), "XAAXAA", capture=["pos"])] == [1, 4]
    assert [r.A_pos for r in run(A.keep_right(A), "XAAXAA", capture=["pos"])] == [2, 5]


def test_shared_events_belong_to_the_path_that_ends(run):
    opens, begins = lit("ch", "A", "open"), lit("ch", "A", "begin")
    got = run((opens >> B) | (begins >> C), "ABXACXAB", capture=["pos"])
    assert [(r.open_pos, r.begin_pos, r.B_pos, r.C_pos) for r in got] == [
        (0, None, 1, None), (None, 3, None, 4), (6, None, 7, None)]


def test_values_of_branches(run):
    p = A.as_(1) | B.as_(2)
    assert [(r.result, r.alt) for r in run(p, "ABXB")] == [(1, "A"), (2, "B"), (2, "B")]
    p = (A >> C).as_("x").named("n") | (B >> C).map(lambda c: F.concat(F.lit("y"), c["B"]["pos"])).named("m")
    assert [(r.result, r.alt) for r in run(p, "ACXBCXXAC", capture=["pos"])] == [("x", "n"), ("y3", "m"), ("x", "n")]


def test_maps_of_maps_and_parts(run):
    p = (A >> B).map(lambda c: c["A"]["pos"] + 1).map(lambda c: c.value * 10)
    assert [r.result for r in run(p, "ABXAB", capture=["pos"])] == [10, 40]
    p = (A.as_(1) | B.as_(2)) >> C >> (A.as_("a") | completed("none") >> D)
    got = [(r.result["_1"], r.result["_2"]) for r in run(p, "ACAXBCDXACA")]
    assert got == [(1, "a"), (2, "none"), (1, "a")]


def test_completed_and_optional_values(run):
    p = A >> (B.as_(1) | completed(0)) >> C
    assert [r.result for r in run(p, "ABCXACXXXXABC")] == [1, 0, 1]
    p = A >> B.as_(5).optional() >> C
    assert [r.result for r in run(p, "ABCXAC")] == [5, None]
    p = A >> (B.as_("b") | C.as_("c")).one_or_more() >> D  # the last round's
    assert [r.result for r in run(p, "ABCBDXACCCCCDXABBBCD")] == ["b", "c", "c"]
    p = A >> (B.as_(1) | C.as_(2)).keep_left(D.as_(3))
    assert [r.result for r in run(p, "ABDXACD")] == [1, 2]


def test_projection_per_step(run):
    twice = step("twice", F.col("ch") == "A", v=F.col("pos") * 2)
    got = run(twice >> B, "XABXXAB")
    assert [r.twice_v for r in got] == [2, 10]
    one = run(twice | step("other", F.col("ch") == "B", w=F.upper("ch")), "AXB")
    assert [(r.twice_v, r.other_w) for r in one] == [(0, None), (None, "B")]


@pytest.mark.parametrize("strategy", ["plain", "block"])
def test_all_events_of_a_match(chars, strategy):
    got = match_lists(chars("XABBBCXABC"), A >> B.one_or_more() >> C, "key", "pos", ["pos"], strategy=strategy)
    rows = got.orderBy("match_no").collect()
    assert [(r.match_no, r.n_events, [(e.label, e.pos) for e in r.events]) for r in rows] == [
        (1, 5, [("A", 1), ("B", 2), ("B", 3), ("B", 4), ("C", 5)]), (2, 3, [("A", 7), ("B", 8), ("C", 9)])]
    both = match_lists(chars("AAXAA"), A >> A, "key", "pos", ["pos"], strategy=strategy).collect()
    assert sorted([e.pos for e in r.events] for r in both) == [[0, 1], [3, 4]]


def test_long_optional_runs_across_blocks(run):
    p = A >> alt(B.as_(1), C.as_(2)).repeated() >> D
    got = run(p, "A" + "B" * 9 + "D" + "XA" + "BCC" * 4 + "D", capture=["pos"])
    assert [(r.result, r.A_pos, r.B_pos, r.C_pos, r.D_pos) for r in got] == [(1, 0, 9, None, 10), (2, 12, 22, 24, 25)]


@pytest.mark.parametrize("strategy", ["auto", "plain", "block"])
def test_keyless_empty_input(chars, strategy):
    """One end row, as one key without events (FIXTURES: any pattern, empty input, E)."""
    from tidemark.operators.matcher import match_events, match_whole

    none = chars("A").where("ch = 'Z'")
    for p in (A, A >> B):
        got = match_events(none, p, [], "pos", strategy=strategy).collect()
        assert [(r.status, r.attempt_id, r.step, r.pos) for r in got] == [("ENDED", None, 0, None)]
    got = match_events(none, A >> B, [], "pos", strategy=strategy, final="complete").collect()
    assert [(r.status, r.attempt_id, r.fail_expected, r.fail_got) for r in got] == [("FAILURE", 1, "A", "<end of input>")]
    assert [(r.status, r.n_events) for r in match_whole(none, A.repeated(), [], "pos", strategy=strategy).collect()] == [("SUCCESS", 0)]
    assert match_events(none, A, "key", "pos", strategy=strategy).count() == 0
    assert match_events(chars("AB"), A >> B, [], "pos", strategy=strategy).count() == 3


@pytest.mark.parametrize("strategy", ["plain", "block"])
def test_whole_input_values(spark, strategy):
    """An expression of tokens gives its captured numbers and a value per key."""
    from tidemark.operators.matcher import match_whole
    from tidemark.sources.text import EXPR_RULES, tokenize

    texts = [("a", "12 + 3"), ("b", "7*8"), ("c", "1 + 2 + 3"), ("d", "4 -"), ("e", "5"), (None, "6+7")]
    df = spark.createDataFrame(texts, "key string, text string")
    toks = tokenize(df, "text", ["key"], EXPR_RULES, values={"num": ("n", lambda g: g[0].cast("int"))})
    left, right = lit("kind", "num", "left"), lit("kind", "num", "right")
    plus, times = lit("kind", "plus"), lit("kind", "times")
    p = ((left >> plus >> right).map(lambda c: c["left"]["n"] + c["right"]["n"])
         | (left >> times >> right).map(lambda c: c["left"]["n"] * c["right"]["n"]))
    spark.conf.set("tidemark.blockRows", "2")
    try:
        out = match_whole(toks, p, "key", "pos", capture=["n"], strategy=strategy)
        got = {r.key: (r.status, r.left_n, r.right_n, r.result) for r in out.collect()}
    finally:
        spark.conf.unset("tidemark.blockRows")
    fail = ("FAILURE", None, None, None)
    assert got == {"a": ("SUCCESS", 12, 3, 15), "b": ("SUCCESS", 7, 8, 56), "c": fail, "d": fail, "e": fail, None: ("SUCCESS", 6, 7, 13)}


@pytest.mark.parametrize("strategy", ["plain", "block"])
def test_whole_input_last_round_across_blocks(spark, strategy):
    """Captures of a repeated part are those of its last round, wherever blocks cut."""
    from tidemark.operators.matcher import match_whole

    rows = [("k", i, "ab"[i % 2], 10 * i) for i in range(40)] + [("odd", i, "ab"[i % 2], i) for i in range(7)]
    df = spark.createDataFrame(rows, "key string, pos long, ch string, v long")
    p = (lit("ch", "a") >> lit("ch", "b")).one_or_more()
    spark.conf.set("tidemark.blockRows", "3")
    try:
        out = match_whole(df, p, "key", "pos", capture=["v", "pos"], result=lambda c: c["b"]["v"] - c["a"]["v"], strategy=strategy)
        got = {r.key: (r.status, r.a_v, r.b_v, r.b_pos, r.result, r.fail_expected) for r in out.collect()}
    finally:
        spark.conf.unset("tidemark.blockRows")
    assert got == {"k": ("SUCCESS", 380, 390, 39, 10, None), "odd": ("FAILURE", None, None, None, None, "b")}
