"""Golden fixtures (FIXTURES.md): per-event statuses of the cut matcher."""
import pytest
from pyspark.sql import functions as F

from tidemark.functions.pattern import completed, fail, lit, step
from tidemark.operators.matcher import match_cut, match_events, match_whole

A, B = lit("ch", "A"), lit("ch", "B")
I, S, FL, E = "INCOMPLETE", "SUCCESS", "FAILURE", "ENDED"


def statuses(df, pattern, strategy="plain", **kw):
    out = match_events(df, pattern, "key", "pos", strategy=strategy, **kw)
    rows = out.orderBy(F.col("pos").asc_nulls_last()).collect()
    return [r.status for r in rows]


CASES = [
    (A >> A, "AA", [I, S, E]),
    (A >> A, "A", [I, E]),
    (A, "B", [FL, E]),
    (A | B, "A", [S, E]),
    (A | B, "B", [S, E]),
    (A >> B, "AB", [I, S, E]),
    (A >> B, "AAB", [I, FL, FL, E]),
    (A >> B, "AAAB", [I, FL, I, S, E]),
    (A | (A >> B), "AB", [S, FL, E]),
    (A | A, "AA", [I, FL, E]),
    (A >> B.optional(), "AB", [S, FL, E]),
    (A >> B.repeated(), "AB", [S, FL, E]),
    (A >> B.optional() >> A, "ABA", [I, I, S, E]),
    (A >> B.optional() >> A, "AA", [I, S, E]),
    (A >> B.one_or_more() >> A, "ABBBA", [I, I, I, I, S, E]),
]


@pytest.mark.parametrize("strategy", ["plain", "block"])
@pytest.mark.parametrize("pattern,text,expected", CASES)
def test_statuses(spark, chars, pattern, text, expected, strategy):
    assert statuses(chars(text), pattern, strategy) == expected


def test_failure_facts(spark, chars):
    rows = match_events(chars("B"), A, "key", "pos").filter("status = 'FAILURE'").collect()
    assert (rows[0].fail_expected, rows[0].fail_got) == ("A", "B")


def test_alternation_reports_branch(spark, chars):
    out = match_cut(chars("AB"), A | B, "key", "pos").orderBy("match_no").collect()
    assert [r.alt for r in out] == ["A", "B"]


def test_values_and_map(spark, chars):
    p = (A >> B).named("ab")
    out = match_cut(chars("AB"), p, "key", "pos", capture=["pos"],
                    result=lambda c: F.concat(F.lit("AB"), c["A"]["pos"].cast("string"))).collect()
    assert out[0].result == "AB0" and out[0].A_pos == 0 and out[0].B_pos == 1
    assert out[0].n_events == 2


def test_keep_left_right(spark, chars):
    left = match_cut(chars("AB"), A.keep_left(B), "key", "pos", capture=["pos"]).columns
    right = match_cut(chars("AB"), A.keep_right(B), "key", "pos", capture=["pos"]).columns
    assert "A_pos" in left and "B_pos" not in left
    assert "B_pos" in right and "A_pos" not in right


def test_empty_input_keyed_gives_no_rows(spark, chars):
    empty = chars("").filter("false") if chars("") is not None else None
    assert match_events(chars("X").filter("false"), A >> B, "key", "pos").count() == 0


def test_empty_pattern_never_matches_alone(spark, chars):
    assert statuses(chars("X"), completed(0)) == [FL, E]


def test_always_error(spark, chars):
    rows = match_events(chars("fu"), fail("boom"), "key", "pos", show=F.col("ch")) \
        .filter("status = 'FAILURE'").collect()
    assert {r.fail_expected for r in rows} == {"boom"} and len(rows) == 2


def test_ambiguity_flag_mode(spark, chars):
    assert statuses(chars("A"), A | A, on_ambiguity="flag") == ["AMBIGUOUS", E]


def test_final_complete(spark, chars):
    rows = match_events(chars("A"), A >> B, "key", "pos", final="complete").collect()
    end = [r for r in rows if r.pos is None][0]
    assert end.status == FL and end.fail_expected == "B"
    rows = match_events(chars("AB"), (A >> B).optional(), "key", "pos",
                        final="complete").collect()
    assert [r.status for r in rows if r.pos is None] == [S]


def test_row_count_invariant(spark):
    import random
    random.seed(3)
    rows = [(f"k{k}", i, random.choice("ABX")) for k in range(7) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, pos long, ch string")
    assert match_events(df, A >> B, "key", "pos").count() == len(rows) + 7


def test_no_key_empty_input_is_empty(spark, chars):
    assert match_cut(chars("X").filter("false"), A, [], "pos").count() == 0


@pytest.mark.parametrize("text,ok", [("a", True), ("ab", False), ("", None)])
def test_whole_input(spark, chars, text, ok):
    a = lit("ch", "a")
    rows = match_whole(chars(text), a, "key", "pos").collect()
    if ok is None:
        assert rows == []
    else:
        assert (rows[0].status == "SUCCESS") == ok


def test_whole_input_error_text(spark, chars):
    rows = match_whole(chars("fubar"), fail("fubar"), "key", "pos").collect()
    assert rows[0].status == "FAILURE" and rows[0].fail_expected == "fubar"
    assert rows[0].fail_step == 1


def test_whole_input_open_at_end(spark, chars):
    p = lit("ch", "(") >> lit("ch", ")")
    rows = match_whole(chars("("), p, "key", "pos").collect()
    assert rows[0].status == "FAILURE" and rows[0].fail_expected == ")"
    assert rows[0].fail_step is None
    rows = match_whole(chars(")"), p, "key", "pos").collect()
    assert (rows[0].fail_expected, rows[0].fail_got) == ("(", ")")


def test_pattern_map_and_as(spark, chars):
    out = match_cut(chars("AB"), (A >> B).map(lambda c: c["B"]["pos"] * 10), "key", "pos",
                    capture=["pos"]).collect()
    assert out[0].result == 10
    out = match_cut(chars("AB"), (A >> B).as_("AB"), "key", "pos").collect()
    assert out[0].result == "AB"
