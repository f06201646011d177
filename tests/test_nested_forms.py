"""Nested depth: per-event statuses, the whole-input form and the end of input."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.nested import nested_events, nested_whole
from tidemark.operators.sequential import nested_depth

IS_OPEN, IS_CLOSE = F.col("ch") == "(", F.col("ch") == ")"


def walk(text, final="ended"):
    """(status, attempt, step, depth, expected, got) per event and at the end, by hand."""
    phase = depth = peak = steps = att = 0
    out = []
    for c in text:
        want = {0: "(", 1: "(,)", 2: ")"}[phase]
        if phase == 0:
            att, steps = att + 1, 0
        steps += 1
        if c == "(" and phase < 2:
            phase, depth = 1, (0 if phase == 0 else depth) + 1
            peak = depth
            out.append(("INCOMPLETE", att, steps, None, None, None))
        elif c == ")" and phase:
            phase, depth = 2, depth - 1
            out.append(("INCOMPLETE", att, steps, None, None, None) if depth else ("SUCCESS", att, steps, peak, None, None))
            phase = 2 if depth else 0
        else:
            out.append(("FAILURE", att, steps, None, want, c))
            phase = 0
    if final == "ended":
        out.append(("ENDED", None, steps if phase else 0, None, None, None))
    elif phase:
        out.append(("FAILURE", att, steps, None, ")", "<end of input>"))
    else:
        out.append(("SUCCESS", att + 1, 0, 0, None, None))
    return out


def events(df, keys="key", final="ended", strategy="auto"):
    out = nested_events(df, IS_OPEN, IS_CLOSE, keys, "pos", show=F.col("ch"), final=final, strategy=strategy)
    return out.select(*([keys] if keys else []), F.col("pos").isNull().alias("end"), "pos", "status", "attempt_id", "step", "depth",
                      "fail_expected", "fail_got").orderBy(*([keys] if keys else []), "end", "pos").collect()


# Bracket strings and the statuses they must give.
@pytest.mark.parametrize("text,expected", [
    ("()", "ISE"), ("(((())))", "IIIIIIISE"), ("(b)", "IFFE"), ("(()())", "IIIFFFE"), ("() () ()", "ISFISFISE"), ("", "E"),
])
def test_statuses(spark, chars, text, expected):
    rows = events(chars(text) if text else chars("x").where("false"), keys=None)
    assert "".join(r.status[0] for r in rows) == expected
    assert [tuple(r)[2:] for r in rows] == walk(text)


def test_expected_and_got(spark, chars):
    rows = events(chars("(b)"))
    assert [(r.fail_expected, r.fail_got) for r in rows[1:3]] == [("(,)", "b"), ("(", ")")]


@pytest.mark.parametrize("alphabet,seed", [("()", 1), ("(()", 2), ("())", 3), ("(()x", 4), ("((((()", 5), ("())))", 6)])
@pytest.mark.parametrize("final", ["ended", "complete", "none"])
def test_blocks_and_batches_equal_the_walk(spark, alphabet, seed, final):
    rng = random.Random(seed)
    texts = {k: "".join(rng.choice(alphabet) for _ in range(n)) for k, n in [("hot", 400), ("c", 40), ("one", 1)]}
    # long runs across blocks, and a NULL key
    texts[None] = "(" * 30 + ")" * 30 + "x" + "(" * 20 + ")" * 25 + "(((" * 5
    df = spark.createDataFrame([(k, i, c) for k, t in texts.items() for i, c in enumerate(t)], "key string, pos long, ch string")
    cut = (lambda rows: rows[:-1]) if final == "none" else (lambda rows: rows)
    want = {k: cut(walk(t, "ended" if final == "none" else final)) for k, t in texts.items()}
    spark.conf.set("tidemark.blockRows", "9")
    spark.conf.set("tidemark.hotKeyRows", "20")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        for strategy in ("auto", "plain"):
            got = {}
            for r in events(df, final=final, strategy=strategy):
                got.setdefault(r.key, []).append(tuple(r)[3:])
            assert got == want
            if final != "ended":
                depths = nested_depth(df, IS_OPEN, IS_CLOSE, "key", "pos", final=final, strategy=strategy)
                assert sorted(((r.key, r.match_no, r.depth) for r in depths.collect()), key=repr) == sorted(
                    ((k, i, d) for k, rows in want.items() for i, d in enumerate([r[3] for r in rows if r[0] == "SUCCESS"], 1)), key=repr)
        one = [tuple(r)[2:] for r in events(df.where("key = 'hot'"), keys=None, final=final)]
        assert one == want["hot"]
    finally:
        for c in ("tidemark.blockRows", "tidemark.hotKeyRows", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(c)


# Whole inputs, their depth, or where and why they fail.
WHOLE = [
    ("()", ("SUCCESS", 1, 2, None, None, None)),
    ("(((())))", ("SUCCESS", 4, 8, None, None, None)),
    ("(", ("FAILURE", None, 1, None, ")", "<end of input>")),
    ("(((()", ("FAILURE", None, 5, None, ")", "<end of input>")),
    (")", ("FAILURE", None, 1, 1, "(", ")")),
    ("(b)", ("FAILURE", None, 3, 2, "(,)", "b")),
    ("(()())", ("FAILURE", None, 6, 4, ")", "(")),
    ("())", ("FAILURE", None, 3, 3, None, ")")),
    ("()(", ("FAILURE", None, 3, 3, None, "(")),
    ("(()x", ("FAILURE", None, 4, 4, ")", "x")),
    ("x", ("FAILURE", None, 1, 1, "(", "x")),
]


@pytest.mark.parametrize("strategy", ["plain", "auto"])
def test_whole_input(spark, strategy):
    df = spark.createDataFrame([(t if t != "x" else None, i, c) for t, _ in WHOLE for i, c in enumerate(t)], "key string, pos long, ch string")
    if strategy == "auto":
        spark.conf.set("tidemark.blockRows", "3")
        spark.conf.set("tidemark.hotKeyRows", "0")
    try:
        out = nested_whole(df, IS_OPEN, IS_CLOSE, "key", "pos", show=F.col("ch"), strategy=strategy).collect()
    finally:
        spark.conf.unset("tidemark.blockRows")
        spark.conf.unset("tidemark.hotKeyRows")
    assert {r.key: tuple(r)[1:] for r in out} == {t if t != "x" else None: w for t, w in WHOLE}


def test_whole_input_without_key_or_events(spark, chars):
    empty = chars("x").where("false")
    assert [tuple(r) for r in nested_whole(empty, IS_OPEN, IS_CLOSE, [], "pos").collect()] == [("SUCCESS", 0, 0, None, None, None)]
    assert nested_whole(empty, IS_OPEN, IS_CLOSE, "key", "pos").count() == 0
    assert [tuple(r) for r in nested_whole(chars("(())"), IS_OPEN, IS_CLOSE, [], "pos", strategy="block").collect()] == [
        ("SUCCESS", 2, 4, None, None, None)]
