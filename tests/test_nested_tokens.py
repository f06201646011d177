"""Nested depth (O21), rising triples (O22) and the rule tokeniser."""
import pytest
from pyspark.sql import functions as F

from tidemark.operators.sequential import nested_depth
from tidemark.operators.windows import rising_triples
from tidemark.sources.text import EXPR_RULES, tokenize


def depths(df, final="none"):
    out = nested_depth(df, F.col("ch") == "(", F.col("ch") == ")", "key", "pos", final=final)
    return [r.depth for r in out.orderBy("match_no").collect()]


# Bracket strings and the depths they must give.
@pytest.mark.parametrize("text,expected", [
    ("()", [1]),
    ("(((())))", [4]),
    ("(b)", []),
    ("(()())", []),
    ("() () ()", [1, 1, 1]),
])
def test_nested(spark, chars, text, expected):
    assert depths(chars(text)) == expected


# Bracket strings and the depths they must give.
@pytest.mark.parametrize("text,expected", [
    ("()" * 13, [1] * 13 + [0]),
    ("((()))(())()((((()))))((()))()(((())))", [3, 2, 1, 5, 3, 1, 4, 0]),
    # the older driver's late-error quirk is not copied: 1, 1, 1, 0
    ("() () ()", [1, 1, 1, 0]),
])
def test_nested_final_complete(spark, chars, text, expected):
    assert depths(chars(text), "complete") == expected


def test_rising(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([1, 2, 3, 3, 2, 1, 5])],
                               "key string, t long, v long")
    out = rising_triples(df, "v", "key", "t").orderBy("triple_no").collect()
    assert [r.rising for r in out] == [1, 0]


def toks(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r.kind, r.token) for r in tokenize(df, "text", ["doc_id"], EXPR_RULES)
            .orderBy("pos").collect()]


def test_tokenize_number(spark):
    assert toks(spark, "42") == [("num", "42")]


def test_tokenize_sum(spark):
    assert toks(spark, "1 + 2") == [("num", "1"), ("plus", "+"), ("num", "2")]


def test_tokenize_long(spark):
    out = toks(spark, "123 - 2 + 228 * 4 + 12 / 4 + 79 * 5")
    assert len(out) == 15 and sum(k == "num" for k, _ in out) == 8


def test_tokenize_errors(spark):
    assert toks(spark, "4 x+") == [("num", "4"), ("error", " "), ("error", "x"), ("plus", "+")]


@pytest.mark.parametrize("alphabet,seed", [("()", 1), ("(()", 2), ("())", 3), ("(()x", 4),
                                           ("((((()", 5), ("())))", 6)])
def test_nested_hot_blocks_equal_plain(spark, alphabet, seed):
    """Bracket-only runs cut by tiny blocks: the block scan must agree with
    one sequential walk, for keyed and keyless input."""
    import random

    random.seed(seed)
    rows = [(k, i, random.choice(alphabet)) for k, n in [("hot", 700), ("c", 40)]
            for i in range(n)]
    df = spark.createDataFrame(rows, "key string, pos long, ch string")
    o, c = F.col("ch") == "(", F.col("ch") == ")"

    def run(d, keys, strategy):
        out = nested_depth(d, o, c, keys, "pos", strategy=strategy)
        return sorted(map(tuple, out.collect()), key=str)

    ref = run(df, "key", "plain")
    ref1 = run(df.filter("key = 'hot'"), [], "plain")
    spark.conf.set("tidemark.blockRows", "9")
    spark.conf.set("tidemark.hotKeyRows", "100")
    try:
        got = run(df, "key", "auto")
        got1 = run(df.filter("key = 'hot'"), [], "auto")
    finally:
        spark.conf.unset("tidemark.blockRows")
        spark.conf.unset("tidemark.hotKeyRows")
    assert got == ref
    assert got1 == ref1


def _tokens(spark, text, rules, **kw):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [tuple(r)[2:] for r in tokenize(df, "text", ["doc_id"], rules, **kw).orderBy("pos").collect()]


def test_token_values_from_groups(spark):
    """A number comes as a typed value of its group, as Num(12)."""
    got = _tokens(spark, "12 + 3", EXPR_RULES, values={"num": ("n", lambda g: g[0].cast("int"))})
    assert got == [("num", "12", 12), ("plus", "+", None), ("num", "3", 3)]


def test_lookaround_keeps_its_kind(spark):
    rules = [("usd", "[0-9]+(?=USD)"), ("num", "[0-9]+"), ("unit", "USD|EUR"), ("after", "(?<=x)y")]
    assert _tokens(spark, "12USD7EURxy", rules) == [
        ("usd", "12"), ("unit", "USD"), ("num", "7"), ("unit", "EUR"), ("error", "x"), ("after", "y")]


@pytest.mark.parametrize("tail", ["", "\ufdd0", "\ufdd1 \ufdd0"])
def test_groups_and_back_references(spark, tail):
    """Groups inside rules, also in texts that hold a delimiter."""
    rules = [("kv", "([a-z]+)=([0-9]*)(?:;|$)?"), ("twice", "([A-Z])([0-9])\\2\\1"), ("quoted", "\\Q(+\\E"), ("class", "[(\\[]")]
    got = _tokens(spark, "ab=12;c=A77A(+([" + tail, rules, groups=True)
    want = [("kv", "ab=12;", ["ab", "12"]), ("kv", "c=", ["c", ""]), ("twice", "A77A", ["A", "7"]), ("quoted", "(+", []),
            ("class", "(", []), ("class", "[", [])]
    assert got == want + [("error", c, []) for c in tail]


def test_tokens_of_null_empty_and_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "\U0001f600a"), (4, "$1 \\ 2")], "doc_id long, text string")
    got = [tuple(r) for r in tokenize(df, "text", ["doc_id"]).orderBy("doc_id", "pos").collect()]
    assert got == [(3, 1, "error", "\U0001f600"), (3, 2, "word", "a"), (4, 1, "error", "$"), (4, 2, "number", "1"),
                   (4, 3, "error", " "), (4, 4, "error", "\\"), (4, 5, "number", "2")]
