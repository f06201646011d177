"""Registered queries: one per operator of SURVEY §2, with DuckDB oracles.

Every query reads the driver's tables in full.  Events are ordered per
``user_id`` by ``(ts, event_id)`` (a total order).  The oracles compute
the same answer by another method: closed forms over run positions where
one exists (SURVEY §7.4), else a recursive walk by ``(user_id, rn)``.
Integers are BIGINT on both sides; money is compared in whole cents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.pattern import fail, lit, step
from tidemark.operators import nested as N
from tidemark.operators import sequential as S
from tidemark.operators import windows as W
from tidemark.operators.matcher import (
    failure_summary, match_chain, match_cut, match_events, match_lists, match_whole,
)
from tidemark.session import table
from tidemark.sources.text import PROSE_RULES, tokenize

KEY = "user_id"
ORDER = ["ts", "event_id"]


def et():
    return F.col("event_type")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def is_(t: str):
    return lit("event_type", t)


def cents(c):
    return F.round(c * 100).cast("long")


# ---------------------------------------------------------------------------
# SQL building blocks (oracle side)
# ---------------------------------------------------------------------------

E = """e AS (
  SELECT user_id, event_id, ts, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events)"""


def RUNS(a: str, part: str = "user_id", src: str = "e") -> str:
    """run = position of a row inside its run of ``a`` events (NULL if not
    ``a``); prev_* = the row before in the key."""
    return f"""g AS (
  SELECT *, sum(CASE WHEN event_type IS DISTINCT FROM '{a}' THEN 1 ELSE 0 END)
              OVER (PARTITION BY {part} ORDER BY rn ROWS UNBOUNDED PRECEDING) AS grp
  FROM {src}),
r AS (
  SELECT *, CASE WHEN event_type = '{a}' THEN
              row_number() OVER (PARTITION BY {part}, grp ORDER BY rn)
              - CASE WHEN grp > 0 THEN 1 ELSE 0 END END AS run
  FROM g),
l AS (
  SELECT *, lag(run) OVER (PARTITION BY {part} ORDER BY rn) AS prev_run,
            lag(event_id) OVER (PARTITION BY {part} ORDER BY rn) AS prev_id,
            lag(event_id, 2) OVER (PARTITION BY {part} ORDER BY rn) AS prev2_id,
            lag(value) OVER (PARTITION BY {part} ORDER BY rn) AS prev_value,
            lag(event_type) OVER (PARTITION BY {part} ORDER BY rn) AS prev_type
  FROM r)"""


def WALK(next_st: str, status: str, extra_cols: str = "", extra_seed: str = "") -> str:
    """Recursive walk of a hand-written automaton per user; ``w.st`` is the
    state before the row, ``e`` the row.  State 0 is the start."""
    return f"""w AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, 0 AS st,
         CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS sid,
         CAST(0 AS BIGINT) AS steps, CAST(0 AS BIGINT) AS att{extra_seed}
  FROM e GROUP BY user_id
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, {next_st} AS st, {status} AS status,
         CASE WHEN w.st = 0 THEN e.event_id ELSE w.sid END AS sid,
         CASE WHEN w.st = 0 THEN 1 ELSE w.steps + 1 END AS steps,
         CASE WHEN w.st = 0 THEN w.att + 1 ELSE w.att END AS att{extra_cols}
  FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)"""


MATCHES_FROM_WALK = """SELECT user_id,
       row_number() OVER (PARTITION BY user_id ORDER BY rn) AS match_no,
       sid AS start_event_id, event_id AS end_event_id, steps AS n_events
FROM w WHERE status = 'SUCCESS'"""


def _cut_cols(df: DataFrame) -> DataFrame:
    return df.select(KEY, "match_no", "start_event_id", "end_event_id", "n_events")


# ---------------------------------------------------------------------------
# One-event patterns
# ---------------------------------------------------------------------------

def literal_events(spark, sf):
    ev = match_events(_events(spark, sf), is_("click"), KEY, ORDER)
    return ev.select(KEY, "event_id", "status", "fail_expected", "fail_got")


SQL_LITERAL_EVENTS = f"""WITH {E}
SELECT user_id, event_id,
       CASE WHEN event_type = 'click' THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
       CASE WHEN event_type = 'click' THEN NULL ELSE 'click' END AS fail_expected,
       CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS fail_got
FROM e
UNION ALL
SELECT DISTINCT user_id, CAST(NULL AS BIGINT), 'ENDED', CAST(NULL AS VARCHAR),
       CAST(NULL AS VARCHAR) FROM e"""


def pattern_project(spark, sf):
    big = step("big_purchase", (et() == "purchase") & (F.col("value") > 50))
    m = match_cut(_events(spark, sf), big, KEY, ORDER, capture=["value"],
                  result=lambda c: c["big_purchase"]["value"] * 2)
    return m.select(KEY, "match_no", "end_event_id", F.col("result").alias("doubled"))


SQL_PATTERN_PROJECT = f"""WITH {E}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS match_no,
       event_id AS end_event_id, value * 2 AS doubled
FROM e WHERE event_type = 'purchase' AND value > 50"""


def union_one(spark, sf):
    m = match_cut(_events(spark, sf), is_("click") | is_("view"), KEY, ORDER)
    return m.select(KEY, "match_no", "end_event_id", "alt")


SQL_UNION_ONE = f"""WITH {E}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS match_no,
       event_id AS end_event_id, event_type AS alt
FROM e WHERE event_type IN ('click', 'view')"""


# ---------------------------------------------------------------------------
# Sequences under cut
# ---------------------------------------------------------------------------

def seq_cut(spark, sf):
    return _cut_cols(match_cut(_events(spark, sf), is_("click") >> is_("view"), KEY, ORDER))


SQL_SEQ_CUT = f"""WITH {E}, {RUNS('click')}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS match_no,
       prev_id AS start_event_id, event_id AS end_event_id, CAST(2 AS BIGINT) AS n_events
FROM l WHERE event_type = 'view' AND prev_run % 2 = 1"""


def seq_same_cut(spark, sf):
    return _cut_cols(match_cut(_events(spark, sf), is_("click") >> is_("click"), KEY, ORDER))


SQL_SEQ_SAME_CUT = f"""WITH {E}, {RUNS('click')}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS match_no,
       prev_id AS start_event_id, event_id AS end_event_id, CAST(2 AS BIGINT) AS n_events
FROM l WHERE event_type = 'click' AND run % 2 = 0"""


def seq_keep_left(spark, sf):
    m = match_cut(_events(spark, sf), is_("click").keep_left(is_("view")), KEY, ORDER,
                  capture=["value"])
    return m.select(KEY, "match_no", F.col("click_value").alias("kept_value"))


SQL_SEQ_KEEP_LEFT = f"""WITH {E}, {RUNS('click')}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS match_no,
       prev_value AS kept_value
FROM l WHERE event_type = 'view' AND prev_run % 2 = 1"""


def seq_keep_right(spark, sf):
    m = match_cut(_events(spark, sf), is_("click").keep_right(is_("view")), KEY, ORDER,
                  capture=["value"])
    return m.select(KEY, "match_no", F.col("view_value").alias("kept_value"))


SQL_SEQ_KEEP_RIGHT = f"""WITH {E}, {RUNS('click')}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS match_no,
       value AS kept_value
FROM l WHERE event_type = 'view' AND prev_run % 2 = 1"""


def map_const(spark, sf):
    total = (is_("click") >> is_("view")).map(
        lambda c: cents(c["click"]["value"] + c["view"]["value"]))
    m = match_cut(_events(spark, sf), total, KEY, ORDER, capture=["value"])
    return m.select(KEY, "match_no", F.col("result").alias("total_cents"),
                    F.lit("AB").alias("tag"))


SQL_MAP_CONST = f"""WITH {E}, {RUNS('click')}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS match_no,
       CAST(round((prev_value + value) * 100) AS BIGINT) AS total_cents, 'AB' AS tag
FROM l WHERE event_type = 'view' AND prev_run % 2 = 1"""


# ---------------------------------------------------------------------------
# Repetition and optional steps (recursive walk oracles)
# ---------------------------------------------------------------------------

def repeat_run(spark, sf):
    p = is_("click") >> is_("view").one_or_more() >> is_("purchase")
    return _cut_cols(match_cut(_events(spark, sf), p, KEY, ORDER))


_T = "e.event_type"
SQL_REPEAT_RUN = f"""WITH RECURSIVE {E}, {WALK(
    f"CASE WHEN w.st = 0 AND {_T} = 'click' THEN 1 "
    f"WHEN w.st IN (1, 2) AND {_T} = 'view' THEN 2 ELSE 0 END",
    f"CASE WHEN w.st = 2 AND {_T} = 'purchase' THEN 'SUCCESS' "
    f"WHEN (w.st = 0 AND {_T} = 'click') OR (w.st IN (1, 2) AND {_T} = 'view') "
    f"THEN 'INCOMPLETE' ELSE 'FAILURE' END")}
{MATCHES_FROM_WALK}"""


def optional_seq(spark, sf):
    p = is_("click") >> is_("view").optional() >> is_("purchase")
    return _cut_cols(match_cut(_events(spark, sf), p, KEY, ORDER))


SQL_OPTIONAL_SEQ = f"""WITH RECURSIVE {E}, {WALK(
    f"CASE WHEN w.st = 0 AND {_T} = 'click' THEN 1 "
    f"WHEN w.st = 1 AND {_T} = 'view' THEN 2 ELSE 0 END",
    f"CASE WHEN w.st IN (1, 2) AND {_T} = 'purchase' THEN 'SUCCESS' "
    f"WHEN (w.st = 0 AND {_T} = 'click') OR (w.st = 1 AND {_T} = 'view') "
    f"THEN 'INCOMPLETE' ELSE 'FAILURE' END")}
{MATCHES_FROM_WALK}"""


# ---------------------------------------------------------------------------
# Statuses as data
# ---------------------------------------------------------------------------

def always_error(spark, sf):
    ev = match_events(_events(spark, sf), fail("never"), KEY, ORDER, show=et())
    return ev.select(KEY, "event_id", "status", "attempt_id", "fail_expected", "fail_got")


SQL_ALWAYS_ERROR = f"""WITH {E}
SELECT user_id, event_id, 'FAILURE' AS status, rn AS attempt_id,
       'never' AS fail_expected, event_type AS fail_got FROM e
UNION ALL
SELECT DISTINCT user_id, CAST(NULL AS BIGINT), 'ENDED', CAST(NULL AS BIGINT),
       CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM e"""


def ambiguous(spark, sf):
    p = is_("click") | step("not_view", et() != "view")
    ev = match_events(_events(spark, sf), p, KEY, ORDER, show=et())
    return ev.select(KEY, "event_id", "status", "alt", "fail_expected", "fail_got")


SQL_AMBIGUOUS = f"""WITH {E}, {RUNS('click')},
s AS (
  SELECT user_id, event_id,
         CASE WHEN event_type = 'click' AND run % 2 = 1 THEN 'INCOMPLETE'
              WHEN event_type = 'click' THEN 'FAILURE'
              WHEN prev_run % 2 = 1 THEN 'FAILURE'
              WHEN event_type = 'view' THEN 'FAILURE'
              ELSE 'SUCCESS' END AS status,
         CASE WHEN event_type = 'click' THEN NULL
              WHEN prev_run % 2 = 1 THEN NULL
              WHEN event_type = 'view' THEN NULL ELSE 'not_view' END AS alt,
         CASE WHEN event_type = 'click' AND run % 2 = 0 THEN NULL
              WHEN event_type <> 'click' AND prev_run % 2 = 1 THEN NULL
              WHEN event_type = 'view' THEN 'click,not_view' END AS fail_expected,
         CASE WHEN event_type = 'click' AND run % 2 = 0 THEN 'click'
              WHEN event_type <> 'click' AND prev_run % 2 = 1 THEN event_type
              WHEN event_type = 'view' THEN 'view' END AS fail_got
  FROM l)
SELECT * FROM s
UNION ALL
SELECT DISTINCT user_id, CAST(NULL AS BIGINT), 'ENDED', CAST(NULL AS VARCHAR),
       CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM e"""


def event_status(spark, sf):
    ev = match_events(_events(spark, sf), is_("click") >> is_("view"), KEY, ORDER)
    return ev.select(KEY, "event_id", "status", "attempt_id", "step", "fail_expected",
                     "fail_got")


_STATUS_CTE = f"""{E}, {RUNS('click')},
f AS (
  SELECT *, COALESCE(prev_run % 2 = 1, false) AS mid FROM l),
s AS (
  SELECT user_id, rn, event_id,
         CASE WHEN NOT mid AND event_type = 'click' THEN 'INCOMPLETE'
              WHEN mid AND event_type = 'view' THEN 'SUCCESS'
              ELSE 'FAILURE' END AS status,
         CAST(sum(CASE WHEN mid THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY rn
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt_id,
         CASE WHEN mid THEN 2 ELSE 1 END AS step,
         CASE WHEN NOT mid AND event_type <> 'click' THEN 'click'
              WHEN mid AND event_type <> 'view' THEN 'view' END AS fail_expected,
         CASE WHEN (NOT mid AND event_type <> 'click') OR (mid AND event_type <> 'view')
              THEN event_type END AS fail_got,
         CASE WHEN event_type = 'click' AND run % 2 = 1 THEN 1 ELSE 0 END AS open_after
  FROM f),
ends AS (
  SELECT user_id, CAST(NULL AS BIGINT) AS event_id, 'ENDED' AS status,
         CAST(NULL AS BIGINT) AS attempt_id, arg_max(open_after, rn) AS step,
         CAST(NULL AS VARCHAR) AS fail_expected, CAST(NULL AS VARCHAR) AS fail_got
  FROM s GROUP BY user_id),
allrows AS (
  SELECT user_id, event_id, status, attempt_id, step, fail_expected, fail_got FROM s
  UNION ALL SELECT * FROM ends)"""

SQL_EVENT_STATUS = f"""WITH {_STATUS_CTE}
SELECT user_id, event_id, status, attempt_id, CAST(step AS INTEGER) AS step,
       fail_expected, fail_got FROM allrows"""


def status_counts(spark, sf):
    ev = match_events(_events(spark, sf), is_("click") >> is_("view"), KEY, ORDER)
    return ev.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


SQL_STATUS_COUNTS = f"""WITH {_STATUS_CTE}
SELECT status, count(*) AS n FROM allrows GROUP BY status"""


def failure_summary_q(spark, sf):
    ev = match_events(_events(spark, sf), is_("click") >> is_("view"), KEY, ORDER)
    return failure_summary(ev)


SQL_FAILURE_SUMMARY = f"""WITH {_STATUS_CTE}
SELECT fail_expected, fail_got, count(*) AS n_failures FROM allrows
WHERE status = 'FAILURE' GROUP BY fail_expected, fail_got"""


def open_at_end(spark, sf):
    ev = match_events(_events(spark, sf), is_("click") >> is_("view"), KEY, ORDER)
    return ev.filter(F.col("status") == "ENDED").select(KEY, "step")


SQL_OPEN_AT_END = f"""WITH {_STATUS_CTE}
SELECT user_id, CAST(step AS INTEGER) AS step FROM ends"""


# ---------------------------------------------------------------------------
# O18 whole input, O19 chained phases, O20 tokens, O21 nesting, O22-O25
# ---------------------------------------------------------------------------

def whole_conversation(spark, sf):
    conv = table(spark, sf, "conversations")
    role = lambda r: lit("role", r)
    p = role("system").optional() >> (role("user") >> role("assistant")).one_or_more()
    out = match_whole(conv, p, "conv_id", "turn")
    return out.select("conv_id", "status", "n_events")


SQL_WHOLE_CONVERSATION = """SELECT conv_id,
       CASE WHEN regexp_full_match(string_agg(code, '' ORDER BY turn), 's?(ua)+')
            THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
       count(*) AS n_events
FROM (SELECT conv_id, turn,
             CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u'
                       WHEN 'assistant' THEN 'a' ELSE 'x' END AS code
      FROM conversations)
GROUP BY conv_id"""


def _turns():
    role = {r: lit("role", r) for r in ("system", "user", "assistant")}
    talk = (role["user"] >> role["assistant"]).one_or_more()
    return (role["system"].as_("led") >> talk) | talk.as_("free")


def whole_values(spark, sf):
    """The turns captured last in each conversation that matches, and which form it has."""
    out = match_whole(table(spark, sf, "conversations"), _turns(), "conv_id", "turn", capture=["turn"])
    return out.select("conv_id", "status", "system_turn", "user_turn", "assistant_turn", F.col("result").alias("form"))


SQL_WHOLE_VALUES = """WITH c AS (
  SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, ''
                             ORDER BY turn) AS t,
         max(CASE WHEN role = 'system' THEN turn END) AS s, max(CASE WHEN role = 'user' THEN turn END) AS u,
         max(CASE WHEN role = 'assistant' THEN turn END) AS a
  FROM conversations GROUP BY conv_id),
m AS (SELECT *, regexp_full_match(t, 's?(ua)+') AS ok FROM c)
SELECT conv_id, CASE WHEN ok THEN 'SUCCESS' ELSE 'FAILURE' END AS status, CASE WHEN ok THEN s END AS system_turn,
       CASE WHEN ok THEN u END AS user_turn, CASE WHEN ok THEN a END AS assistant_turn,
       CASE WHEN ok AND s IS NOT NULL THEN 'led' WHEN ok THEN 'free' END AS form
FROM m"""


def chain_two_phase(spark, sf):
    pair = step("m1", F.lit(True)) >> step("m2", F.lit(True))
    second = match_chain(_events(spark, sf), [is_("click") >> is_("view"), pair], KEY,
                         ORDER, capture=[(), ["start_event_id", "end_event_id"]])
    return second.select(KEY, F.col("match_no").alias("pair_no"),
                         F.col("m1_start_event_id").alias("first_start_event_id"),
                         F.col("m2_end_event_id").alias("second_end_event_id"))


SQL_CHAIN_TWO_PHASE = f"""WITH {E}, {RUNS('click')},
m AS (
  SELECT user_id, prev_id AS start_event_id, event_id AS end_event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY rn) AS match_no
  FROM l WHERE event_type = 'view' AND prev_run % 2 = 1)
SELECT user_id, CAST((match_no + 1) // 2 AS BIGINT) AS pair_no,
       min(start_event_id) AS first_start_event_id,
       max(end_event_id) AS second_end_event_id
FROM m GROUP BY user_id, (match_no + 1) // 2 HAVING count(*) = 2"""


def tokens(spark, sf):
    docs = table(spark, sf, "documents")
    return tokenize(docs, "text", ["doc_id"], PROSE_RULES)


def _sql_tokens() -> str:
    alts = "|".join(f"(?:{r})" for _, r in PROSE_RULES)
    rx = "(?s)" + alts + "|."
    kinds = " ".join(
        f"WHEN regexp_full_match(raw, '{r}') THEN '{n}'" for n, r in PROSE_RULES)
    return f"""WITH t AS (
  SELECT doc_id, regexp_extract_all(text, '{rx}') AS toks FROM documents),
u AS (
  SELECT doc_id, unnest(toks) AS raw, generate_subscripts(toks, 1) AS pos FROM t),
k AS (
  SELECT doc_id, CAST(pos AS BIGINT) AS pos, raw,
         CASE {kinds} ELSE 'error' END AS kind FROM u)
SELECT doc_id, pos, kind,
       CASE WHEN kind = 'error' THEN raw
            ELSE regexp_replace(raw, '^[ \\t\\r\\n]+', '') END AS token
FROM k"""


SQL_TOKENS = _sql_tokens()


def nested_depth(spark, sf):
    ev = _events(spark, sf)
    out = S.nested_depth(ev, et().isin("click", "signup"), et().isin("view", "purchase"),
                         KEY, ORDER)
    return out.select(KEY, "match_no", "start_event_id", "end_event_id", "n_events",
                      "depth")


_S = "e.sym"
SQL_NESTED_DEPTH = f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id,
         CASE WHEN event_type IN ('click', 'signup') THEN 1
              WHEN event_type IN ('view', 'purchase') THEN 2 ELSE 0 END AS sym,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
w AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id,
         0 AS ph, 0 AS d, 0 AS pk, false AS ok, CAST(NULL AS BIGINT) AS sid,
         CAST(0 AS BIGINT) AS steps, 0 AS val
  FROM e GROUP BY user_id
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id,
         CASE WHEN w.ph = 0 THEN (CASE WHEN {_S} = 1 THEN 1 ELSE 0 END)
              WHEN w.ph = 1 AND {_S} = 1 THEN 1
              WHEN w.ph IN (1, 2) AND {_S} = 2 THEN (CASE WHEN w.d = 1 THEN 0 ELSE 2 END)
              ELSE 0 END,
         CASE WHEN w.ph = 0 THEN (CASE WHEN {_S} = 1 THEN 1 ELSE 0 END)
              WHEN w.ph = 1 AND {_S} = 1 THEN w.d + 1
              WHEN w.ph IN (1, 2) AND {_S} = 2 THEN w.d - 1 ELSE 0 END,
         CASE WHEN w.ph = 0 THEN (CASE WHEN {_S} = 1 THEN 1 ELSE 0 END)
              WHEN w.ph = 1 AND {_S} = 1 THEN w.d + 1 ELSE w.pk END,
         w.ph IN (1, 2) AND {_S} = 2 AND w.d = 1,
         CASE WHEN w.ph = 0 THEN e.event_id ELSE w.sid END,
         CASE WHEN w.ph = 0 THEN 1 ELSE w.steps + 1 END,
         w.pk
  FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS match_no,
       sid AS start_event_id, event_id AS end_event_id, steps AS n_events,
       CAST(val AS BIGINT) AS depth
FROM w WHERE ok"""


_OPENS, _CLOSES = ["click", "signup"], ["view", "purchase"]


def nested_statuses(spark, sf):
    """Per-event statuses of the nested pattern and an end row per user."""
    out = N.nested_events(_events(spark, sf), et().isin(*_OPENS), et().isin(*_CLOSES), KEY, ORDER, show=et(), names=("open", "close"))
    return out.select(KEY, "event_id", "status", "attempt_id", "step", "depth", "fail_expected", "fail_got")


SQL_NESTED_STATUSES = f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id, event_type,
         CASE WHEN event_type IN ('click', 'signup') THEN 1
              WHEN event_type IN ('view', 'purchase') THEN 2 ELSE 0 END AS sym,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
w AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS got, 0 AS ph0, 0 AS ph,
         CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS pk, CAST(0 AS BIGINT) AS att, CAST(0 AS BIGINT) AS steps,
         CAST(NULL AS VARCHAR) AS status
  FROM e GROUP BY user_id
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.event_type, w.ph,
         CASE WHEN {_S} = 1 AND w.ph < 2 THEN 1 WHEN {_S} = 2 AND w.ph > 0 AND w.d > 1 THEN 2 ELSE 0 END,
         CASE WHEN {_S} = 1 AND w.ph = 0 THEN 1 WHEN {_S} = 1 AND w.ph = 1 THEN w.d + 1 WHEN {_S} = 2 AND w.ph > 0 THEN w.d - 1 ELSE 0 END,
         CASE WHEN {_S} = 1 AND w.ph = 0 THEN 1 WHEN {_S} = 1 AND w.ph = 1 THEN w.d + 1 ELSE w.pk END,
         CASE WHEN w.ph = 0 THEN w.att + 1 ELSE w.att END, CASE WHEN w.ph = 0 THEN 1 ELSE w.steps + 1 END,
         CASE WHEN {_S} = 1 AND w.ph < 2 THEN 'INCOMPLETE' WHEN {_S} = 2 AND w.ph > 0 AND w.d > 1 THEN 'INCOMPLETE'
              WHEN {_S} = 2 AND w.ph > 0 THEN 'SUCCESS' ELSE 'FAILURE' END
  FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1),
f AS (SELECT *, lead(rn) OVER (PARTITION BY user_id ORDER BY rn) AS nx FROM w)
SELECT user_id, event_id, status, att AS attempt_id, steps AS step, CASE WHEN status = 'SUCCESS' THEN pk END AS depth,
       CASE WHEN status = 'FAILURE' THEN CASE ph0 WHEN 0 THEN 'open' WHEN 1 THEN 'close,open' ELSE 'close' END END AS fail_expected,
       CASE WHEN status = 'FAILURE' THEN got END AS fail_got
FROM f WHERE rn > 0
UNION ALL
SELECT user_id, NULL, 'ENDED', NULL, CASE WHEN ph > 0 THEN steps ELSE 0 END, NULL, NULL, NULL FROM f WHERE nx IS NULL"""


def nested_days(spark, sf):
    """Is a user's whole day one nested match?"""
    ev = _events(spark, sf)
    ev = ev.withColumn("window_start", W.day_window("ts", "1d", ev))
    return N.nested_whole(ev, et().isin(*_OPENS), et().isin(*_CLOSES), [KEY, "window_start"], ORDER, show=et(), names=("open", "close"))


SQL_NESTED_DAYS = """WITH s AS (
  SELECT user_id, epoch_us(date_trunc('day', ts)) AS window_start, count(*) AS n, list(event_type ORDER BY ts, event_id) AS l,
         string_agg(CASE WHEN event_type IN ('click', 'signup') THEN '(' WHEN event_type IN ('view', 'purchase') THEN ')' ELSE 'x' END, ''
                    ORDER BY ts, event_id) AS t
  FROM events GROUP BY ALL),
a AS (SELECT *, length(regexp_extract(t, '^[(]*')) AS u FROM s),
b AS (SELECT *, length(regexp_extract(substr(t, u + 1), '^[)]*')) AS c FROM a),
f AS (SELECT *, CASE WHEN u = 0 THEN 1 WHEN c = 0 AND n > u THEN u + 1 WHEN c < u AND n > u + c THEN u + c + 1
                     WHEN c >= u AND n > 2 * u THEN 2 * u + 1 END AS fs FROM b)
SELECT user_id, window_start, CASE WHEN fs IS NULL AND c = u THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
       CAST(CASE WHEN fs IS NULL AND c = u THEN u END AS BIGINT) AS depth, n AS n_events, CAST(fs AS BIGINT) AS fail_step,
       CASE WHEN fs IS NULL AND c = u THEN NULL WHEN fs IS NULL THEN 'close' WHEN u = 0 THEN 'open' WHEN fs = u + 1 THEN 'close,open'
            WHEN fs <= 2 * u THEN 'close' END AS fail_expected,
       CASE WHEN fs IS NULL AND c < u THEN '<end of input>' WHEN fs IS NOT NULL THEN l[fs] END AS fail_got
FROM f"""


def rising_triples(spark, sf):
    out = W.rising_triples(_events(spark, sf), "value", KEY, ORDER)
    return out.select(KEY, "triple_no", F.col("first_event_id"), "rising")


SQL_RISING_TRIPLES = f"""WITH {E},
x AS (
  SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY rn) AS v1,
            lead(value, 2) OVER (PARTITION BY user_id ORDER BY rn) AS v2,
            lead(rn, 2) OVER (PARTITION BY user_id ORDER BY rn) AS r2
  FROM e)
SELECT user_id, CAST((rn - 1) / 3 + 1 AS BIGINT) AS triple_no, event_id AS first_event_id,
       CAST(CASE WHEN v2 > v1 AND v1 > value THEN 1 ELSE 0 END AS BIGINT) AS rising
FROM x WHERE (rn - 1) % 3 = 0 AND r2 IS NOT NULL"""


def to_text(spark, sf):
    ev = _events(spark, sf)
    return ev.select("event_id", F.concat(et(), F.lit(":"), F.col(KEY).cast("string"))
                     .alias("event_text"))


SQL_TO_TEXT = """SELECT event_id, event_type || ':' || CAST(user_id AS VARCHAR) AS event_text
FROM events"""


def sum_value(spark, sf):
    ev = _events(spark, sf)
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                         cents(F.sum("value")).alias("total_cents"))


SQL_SUM_VALUE = """SELECT event_type, count(*) AS n,
       CAST(round(sum(value) * 100) AS BIGINT) AS total_cents
FROM events GROUP BY event_type"""


# ---------------------------------------------------------------------------
# Overlapping, windowed and timed sequences
# ---------------------------------------------------------------------------

def every_pair(spark, sf):
    out = W.match_every(_events(spark, sf), [et() == "click", et() == "click"], KEY, ORDER)
    return out.select(KEY, F.col("event_id").alias("start_event_id"), "end_event_id")


SQL_EVERY_PAIR = f"""WITH {E},
x AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY rn) AS t1,
                lead(event_id) OVER (PARTITION BY user_id ORDER BY rn) AS id1 FROM e)
SELECT user_id, event_id AS start_event_id, id1 AS end_event_id
FROM x WHERE event_type = 'click' AND t1 = 'click'"""


def in_last_n(spark, sf):
    out = W.in_last_n(_events(spark, sf), [et() == "click", et() == "view"], 10, KEY, ORDER)
    return out.select(KEY, "event_id", F.col("hit").cast("long").alias("hit"))


SQL_IN_LAST_N = f"""WITH {E},
x AS (SELECT *, CASE WHEN event_type = 'view' AND lag(event_type) OVER
                     (PARTITION BY user_id ORDER BY rn) = 'click' THEN 1 ELSE 0 END AS fin
      FROM e)
SELECT user_id, event_id,
       CAST(max(fin) OVER (PARTITION BY user_id ORDER BY rn
            ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS BIGINT) AS hit
FROM x"""


def in_blocks_n(spark, sf):
    ev = W.blocks_of(_events(spark, sf), 10, KEY, ORDER)
    m = match_cut(ev, is_("click") >> is_("view"), [KEY, "block"], ORDER)
    return m.select(KEY, "block", "match_no", "start_event_id", "end_event_id")


SQL_IN_BLOCKS_N = f"""WITH {E},
eb AS (SELECT *, CAST((rn - 1) // 10 AS BIGINT) AS block FROM e),
{RUNS('click', 'user_id, block', 'eb')}
SELECT user_id, block,
       row_number() OVER (PARTITION BY user_id, block ORDER BY rn) AS match_no,
       prev_id AS start_event_id, event_id AS end_event_id
FROM l WHERE event_type = 'view' AND prev_run % 2 = 1"""


def double_click(spark, sf):
    ev = _events(spark, sf)
    ev = ev.withColumn("_t", W.time_number("ts", ev))
    lim = W.duration_micros("6h")
    out = W.pair_filter(
        ev, lambda prev, F_: (prev["event_type"] == "click") & (F_.col("event_type") == "click")
        & (F_.col("_t") - prev["_t"] <= lim),
        KEY, ORDER, ["event_type", "event_id", "_t"])
    return out.select(KEY, F.col("_prev.event_id").alias("first_event_id"),
                      F.col("event_id").alias("second_event_id"),
                      F.floor((F.col("_t") - F.col("_prev._t")) / 1000).cast("long")
                      .alias("gap_ms"))


SQL_DOUBLE_CLICK = f"""WITH {E},
x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY rn) AS pt,
                lag(event_id) OVER (PARTITION BY user_id ORDER BY rn) AS pid,
                lag(ts) OVER (PARTITION BY user_id ORDER BY rn) AS pts FROM e)
SELECT user_id, pid AS first_event_id, event_id AS second_event_id,
       CAST(floor((epoch_us(ts) - epoch_us(pts)) / 1000) AS BIGINT) AS gap_ms
FROM x WHERE event_type = 'click' AND pt = 'click' AND ts - pts <= INTERVAL 6 HOUR"""


def followed_within(spark, sf):
    ev = _events(spark, sf)
    out = W.match_every(ev, [et() == "click", et() == "view"], KEY, ORDER, time_col="ts",
                        max_gap="30m")
    return out.select(KEY, F.col("event_id").alias("start_event_id"), "end_event_id")


SQL_FOLLOWED_WITHIN = f"""WITH {E},
x AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY rn) AS t1,
                lead(event_id) OVER (PARTITION BY user_id ORDER BY rn) AS id1,
                lead(ts) OVER (PARTITION BY user_id ORDER BY rn) AS ts1 FROM e)
SELECT user_id, event_id AS start_event_id, id1 AS end_event_id
FROM x WHERE event_type = 'click' AND t1 = 'view' AND ts1 - ts <= INTERVAL 30 MINUTE"""


def no_followup(spark, sf):
    out = W.not_followed_within(_events(spark, sf), et() == "purchase", et() == "error", "1d",
                                KEY, "ts")
    return out.select(KEY, "event_id")


SQL_NO_FOLLOWUP = """SELECT a.user_id, a.event_id FROM events a
WHERE a.event_type = 'purchase' AND NOT EXISTS (
  SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error'
    AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 DAY)"""


# ---------------------------------------------------------------------------
# windows
# ---------------------------------------------------------------------------

def window_contains(spark, sf):
    return W.window_contains(_events(spark, sf), [et() == "click", et() == "view"], KEY, ORDER,
                             "ts")


SQL_WINDOW_CONTAINS = f"""WITH {E},
x AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY rn) AS t1,
                lead(ts) OVER (PARTITION BY user_id ORDER BY rn) AS ts1 FROM e)
SELECT user_id, epoch_us(date_trunc('day', ts)) AS window_start, count(*) AS n_matches
FROM x WHERE event_type = 'click' AND t1 = 'view'
  AND date_trunc('day', ts) = date_trunc('day', ts1)
GROUP BY user_id, date_trunc('day', ts)"""


def window_matches(spark, sf):
    ev = _events(spark, sf)
    ev = ev.withColumn("window_start", W.day_window("ts", "1d", ev))
    p = is_("signup").optional() >> (is_("click") | is_("view")).one_or_more() \
        >> is_("purchase").optional()
    out = match_whole(ev, p, [KEY, "window_start"], ORDER)
    return out.select(KEY, "window_start", "status", "n_events")


SQL_WINDOW_MATCHES = """SELECT user_id, epoch_us(date_trunc('day', ts)) AS window_start,
       CASE WHEN regexp_full_match(string_agg(code, '' ORDER BY ts, event_id), 'g?[cv]+p?')
            THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
       count(*) AS n_events
FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'g' WHEN 'click' THEN 'c'
                     WHEN 'view' THEN 'v' WHEN 'purchase' THEN 'p' ELSE 'e' END AS code
      FROM events)
GROUP BY user_id, date_trunc('day', ts)"""


def window_edges(spark, sf):
    return W.window_edges(_events(spark, sf), et() == "click", et() == "purchase", KEY, ORDER,
                          "ts")


SQL_WINDOW_EDGES = """WITH x AS (
  SELECT user_id, event_type, date_trunc('day', ts) AS d,
         row_number() OVER (PARTITION BY user_id, date_trunc('day', ts)
                            ORDER BY ts, event_id) AS ra,
         row_number() OVER (PARTITION BY user_id, date_trunc('day', ts)
                            ORDER BY ts DESC, event_id DESC) AS rd
  FROM events)
SELECT user_id, epoch_us(d) AS window_start,
       CAST(max(CASE WHEN ra = 1 AND event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT)
         AS starts_with,
       CAST(max(CASE WHEN rd = 1 AND event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT)
         AS ends_with
FROM x GROUP BY user_id, d"""


def window_all_of(spark, sf):
    return W.window_all_of(_events(spark, sf),
                           {"click": et() == "click", "purchase": et() == "purchase"}, KEY, "ts")


SQL_WINDOW_ALL_OF = """SELECT user_id, epoch_us(date_trunc('day', ts)) AS window_start
FROM events GROUP BY user_id, date_trunc('day', ts)
HAVING bool_or(event_type = 'click') AND bool_or(event_type = 'purchase')"""


def window_lacking(spark, sf):
    out = W.window_lacking(_events(spark, sf), et() == "purchase", KEY, "ts")
    return out.select(KEY, F.col("day").cast("string").alias("day"))


SQL_WINDOW_LACKING = """WITH spans AS (
  SELECT user_id, min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi
  FROM events GROUP BY user_id),
spine AS (
  SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
  FROM spans)
SELECT s.user_id, CAST(s.day AS VARCHAR) AS day FROM spine s
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.user_id
                  AND e.event_type = 'purchase' AND CAST(e.ts AS DATE) = s.day)"""


def tumbling(spark, sf):
    return W.tumbling(_events(spark, sf), "ts", "6 hours", ["event_type"],
                      [F.count(F.lit(1)).alias("n"), cents(F.sum("value")).alias("total_cents")])


SQL_TUMBLING = """SELECT event_type, count(*) AS n,
       CAST(round(sum(value) * 100) AS BIGINT) AS total_cents,
       epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS window_start
FROM events GROUP BY event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')"""


def sliding(spark, sf):
    return W.sliding(_events(spark, sf), "ts", "1 day", "6 hours", [],
                     [F.count(F.lit(1)).alias("n")])


SQL_SLIDING = """WITH b AS (
  SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS b0 FROM events)
SELECT count(*) AS n, b0 - k * CAST(21600000000 AS BIGINT) AS window_start
FROM b, range(0, 4) AS t(k)
GROUP BY b0 - k * CAST(21600000000 AS BIGINT)"""


def rolling(spark, sf):
    out = W.rolling(_events(spark, sf).select(KEY, "event_id", "ts"), "ts", "1h", KEY,
                    totals={"n_last_hour": F.lit(1)})
    return out.select(KEY, "event_id", "n_last_hour")


SQL_ROLLING = """SELECT user_id, event_id,
       count(*) OVER (PARTITION BY user_id ORDER BY ts
                      RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_last_hour
FROM events"""


def rolling_value(spark, sf):
    """The exact sum of a double over each event's last three hours."""
    out = W.rolling(_events(spark, sf).select(KEY, "event_id", "ts", "value"), "ts", "3h", KEY, totals={"s": F.col("value")})
    return out.select(KEY, "event_id", cents(F.col("s")).alias("cents_last_3h"))


SQL_ROLLING_VALUE = """SELECT user_id, event_id,
       CAST(round(sum(value) OVER (PARTITION BY user_id ORDER BY ts
                      RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND CURRENT ROW) * 100) AS BIGINT) AS cents_last_3h
FROM events"""


def cascading(spark, sf):
    return W.cascading(_events(spark, sf), "ts", "1 hour", "1 day")


SQL_CASCADING = """WITH h AS (
  SELECT date_trunc('hour', ts) AS hr, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_events, CAST(max(n) AS BIGINT) AS max_fine,
       count(*) AS n_fine, epoch_us(date_trunc('day', hr)) AS window_start
FROM h GROUP BY date_trunc('day', hr)"""


# ---------------------------------------------------------------------------
# P17-P20, P12/P13/O17
# ---------------------------------------------------------------------------

def ack_interval(spark, sf):
    ev = _events(spark, sf)
    ev = ev.withColumn("_t", W.time_number("ts", ev))
    out = W.first_after(ev, et() == "error", et() == "signup", KEY, ORDER, ["event_id", "_t"])
    return out.select(KEY, F.col("event_id").alias("error_event_id"),
                      F.col("next_event_id").alias("ack_event_id"),
                      F.floor((F.col("next__t") - F.col("_t")) / 1000).cast("long")
                      .alias("wait_ms"))


SQL_ACK_INTERVAL = f"""WITH {E},
a AS (
  SELECT x.user_id, x.event_id, x.ts,
         (SELECT min(y.rn) FROM e y WHERE y.user_id = x.user_id AND y.rn > x.rn
            AND y.event_type = 'signup') AS ack_rn
  FROM e x WHERE x.event_type = 'error')
SELECT a.user_id, a.event_id AS error_event_id, b.event_id AS ack_event_id,
       CAST(floor((epoch_us(b.ts) - epoch_us(a.ts)) / 1000) AS BIGINT) AS wait_ms
FROM a LEFT JOIN e b ON b.user_id = a.user_id AND b.rn = a.ack_rn"""


def multi_pattern(spark, sf):
    c = is_("click")
    out = S.match_many(_events(spark, sf),
                       {"single": c, "double": c >> c, "triple": c >> c >> c}, KEY, ORDER)
    return out.select("pattern", KEY, "match_no", "start_event_id", "end_event_id",
                      "n_events")


SQL_MULTI_PATTERN = f"""WITH {E}, {RUNS('click')},
x AS (
  SELECT 'single' AS pattern, user_id, rn, event_id AS start_event_id,
         event_id AS end_event_id, CAST(1 AS BIGINT) AS n_events
  FROM l WHERE event_type = 'click'
  UNION ALL
  SELECT 'double', user_id, rn, prev_id, event_id, CAST(2 AS BIGINT)
  FROM l WHERE event_type = 'click' AND run % 2 = 0
  UNION ALL
  SELECT 'triple', user_id, rn, prev2_id, event_id, CAST(3 AS BIGINT)
  FROM l WHERE event_type = 'click' AND run % 3 = 0)
SELECT pattern, user_id,
       row_number() OVER (PARTITION BY pattern, user_id ORDER BY rn) AS match_no,
       start_event_id, end_event_id, n_events
FROM x"""


def longest_alt(spark, sf):
    c = et() == "click"
    out = W.longest_alternative(_events(spark, sf),
                                {"one": [c], "two": [c, c], "three": [c, c, c]}, KEY, ORDER)
    return out.select(KEY, F.col("event_id").alias("start_event_id"), "alt", "n_events")


SQL_LONGEST_ALT = f"""WITH {E},
x AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY rn) AS t1,
                lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY rn) AS t2 FROM e)
SELECT user_id, event_id AS start_event_id,
       CASE WHEN t1 = 'click' AND t2 = 'click' THEN 'three'
            WHEN t1 = 'click' THEN 'two' ELSE 'one' END AS alt,
       CAST(CASE WHEN t1 = 'click' AND t2 = 'click' THEN 3
                 WHEN t1 = 'click' THEN 2 ELSE 1 END AS BIGINT) AS n_events
FROM x WHERE event_type = 'click'"""


def partial_output(spark, sf):
    p = is_("click") >> is_("view").one_or_more() >> is_("purchase")
    ev = match_events(_events(spark, sf), p, KEY, ORDER, final="none", sums={"so_far_cents": cents(F.col("value"))})
    return (ev.filter(F.col("status") == "INCOMPLETE")
            .select(KEY, "event_id", "attempt_id", "step", "so_far_cents"))


SQL_PARTIAL_OUTPUT = f"""WITH RECURSIVE {E}, {WALK(
    f"CASE WHEN w.st = 0 AND {_T} = 'click' THEN 1 "
    f"WHEN w.st IN (1, 2) AND {_T} = 'view' THEN 2 ELSE 0 END",
    f"CASE WHEN w.st = 2 AND {_T} = 'purchase' THEN 'SUCCESS' "
    f"WHEN (w.st = 0 AND {_T} = 'click') OR (w.st IN (1, 2) AND {_T} = 'view') "
    f"THEN 'INCOMPLETE' ELSE 'FAILURE' END",
    extra_cols=", CASE WHEN w.st = 0 THEN e.value ELSE w.acc + e.value END AS acc",
    extra_seed=", CAST(0 AS DOUBLE) AS acc")}
SELECT user_id, event_id, att AS attempt_id, CAST(steps AS INTEGER) AS step,
       CAST(round(acc * 100) AS BIGINT) AS so_far_cents
FROM w WHERE status = 'INCOMPLETE'"""


def stateful_fold(spark, sf):
    """Sessions split at gaps over one hour, emitted when they close.

    The gap flag comes from a skew-safe ``lag``; it is the fold's reset, so
    hot users are split too; session numbers are a skew-safe row number.
    """
    from pyspark.sql import Window

    from tidemark.plans.skew import keyed_window

    gap = W.duration_micros("1h")
    ev = _events(spark, sf)
    ev = ev.withColumn("_t", W.time_number("ts", ev))

    def flag(d, part):
        prev = F.lag("_t").over(Window.partitionBy(*part).orderBy(*ORDER))
        return d.withColumn("_new", prev.isNull() | (F.col("_t") - prev > gap))

    flagged = keyed_window(ev, [KEY], ORDER, flag, behind=1)

    def init():
        return None

    def step_(st, row):
        if st is None:
            return (row["_t"], 1, row["value"], row["event_id"]), []
        return (st[0], st[1] + 1, st[2] + row["value"], st[3]), []

    def end(st):
        return [] if st is None else [(st[3], st[0], st[1], round(st[2] * 100))]

    schema = T.StructType([T.StructField("first_event_id", T.LongType()),
                           T.StructField("first_t", T.LongType()),
                           T.StructField("n_events", T.LongType()),
                           T.StructField("total_cents", T.LongType())])
    sessions = S.fold(flagged, KEY, ORDER, ["_t", "value", "event_id"], init, step_, end,
                      schema, reset=F.col("_new"))
    numbered = keyed_window(sessions, [KEY], ["first_t", "first_event_id"],
                            lambda d, part: d, row_number=True)
    return numbered.select(KEY, F.col("_rn").alias("session_no"), "n_events",
                           "total_cents", "first_event_id")


SQL_STATEFUL_FOLD = f"""WITH {E},
x AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY rn) IS NULL
                       OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY rn)
                          > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new_s FROM e),
y AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY rn
                                 ROWS UNBOUNDED PRECEDING) AS sno FROM x)
SELECT user_id, CAST(sno AS BIGINT) AS session_no, count(*) AS n_events,
       CAST(round(sum(value) * 100) AS BIGINT) AS total_cents,
       arg_min(event_id, rn) AS first_event_id
FROM y GROUP BY user_id, sno"""


def seq_timeout(spark, sf):
    out = S.match_cut_timeout(_events(spark, sf), is_("click") >> is_("view"), KEY, ORDER,
                              "ts", "1h")
    return _cut_cols(out)


SQL_SEQ_TIMEOUT = f"""WITH RECURSIVE {E},
w AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, 0 AS st,
         CAST(NULL AS TIMESTAMP) AS lt, false AS ok, CAST(NULL AS BIGINT) AS sid
  FROM e GROUP BY user_id
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id,
         CASE WHEN (w.st = 0 OR e.ts - w.lt > INTERVAL 1 HOUR) AND e.event_type = 'click'
              THEN 1 ELSE 0 END,
         e.ts,
         w.st = 1 AND e.ts - w.lt <= INTERVAL 1 HOUR AND e.event_type = 'view',
         CASE WHEN w.st = 0 OR e.ts - w.lt > INTERVAL 1 HOUR THEN e.event_id ELSE w.sid END
  FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS match_no,
       sid AS start_event_id, event_id AS end_event_id, CAST(2 AS BIGINT) AS n_events
FROM w WHERE ok"""


def stream_match(spark, sf):
    from tidemark.streaming.stateful import run_stream_match_cut

    return _cut_cols(run_stream_match_cut(spark, f"{sf.rstrip('/')}/events.parquet",
                                          is_("click") >> is_("view"), KEY, ORDER, "ts",
                                          "1h"))


# ---------------------------------------------------------------------------
# P1, P2, P7, P9-P11 with full patterns
# ---------------------------------------------------------------------------

def _funnel():
    return is_("click") >> is_("view").one_or_more() >> is_("purchase")


def every_pattern(spark, sf):
    out = W.match_every(_events(spark, sf), _funnel(), KEY, ORDER)
    return out.select(KEY, "start_event_id", "end_event_id", "n_events")


#: m = the funnel from every click: its views, then a purchase
FUNNELS = f"""{E},
x AS (SELECT *, min(CASE WHEN event_type IS DISTINCT FROM 'view' THEN rn END) OVER
                    (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nv FROM e),
m AS (SELECT x.user_id, x.rn AS s, y.rn AS f, x.event_id AS sid, y.event_id AS fid
      FROM x JOIN e y ON y.user_id = x.user_id AND y.rn = x.nv
      WHERE x.event_type = 'click' AND y.event_type = 'purchase' AND y.rn >= x.rn + 2)"""

SQL_EVERY_PATTERN = f"""WITH {FUNNELS}
SELECT user_id, sid AS start_event_id, fid AS end_event_id, f - s + 1 AS n_events FROM m"""


def last_n_pattern(spark, sf):
    out = W.in_last_n(_events(spark, sf), _funnel(), 10, KEY, ORDER)
    return out.select(KEY, "event_id", F.col("hit").cast("long").alias("hit"))


SQL_LAST_N_PATTERN = f"""WITH {FUNNELS}
SELECT user_id, event_id, CAST(EXISTS (SELECT 1 FROM m WHERE m.user_id = e.user_id AND m.f <= e.rn AND m.s > e.rn - 10) AS BIGINT) AS hit
FROM e"""


def sliding_contains(spark, sf):
    return W.window_contains(_events(spark, sf), is_("click") >> is_("view"), KEY, ORDER, "ts", "1h", "15m")


SQL_SLIDING_CONTAINS = f"""WITH {E},
x AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY rn) AS t1,
                lead(ts) OVER (PARTITION BY user_id ORDER BY rn) AS ts1 FROM e),
w AS (SELECT user_id, unnest(range((epoch_us(ts1) - 3600000000) // 900000000 + 1, epoch_us(ts) // 900000000 + 1)) AS k
      FROM x WHERE event_type = 'click' AND t1 = 'view')
SELECT user_id, k * 900000000 AS window_start, count(*) AS n_matches FROM w GROUP BY user_id, k"""


def edges_pattern(spark, sf):
    """Days that open with clicks or views up to a purchase, or close with views and a purchase."""
    start = (is_("click") | is_("view")).one_or_more() >> is_("purchase")
    return W.window_edges(_events(spark, sf), start, is_("view").one_or_more() >> is_("purchase"), KEY, ORDER, "ts")


SQL_EDGES_PATTERN = """WITH d AS (
  SELECT user_id, event_type, date_trunc('day', ts) AS d,
         row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS ra,
         row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) AS rd
  FROM events),
g AS (
  SELECT user_id, d, min(CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE ra END) AS other,
         max(CASE WHEN rd = 1 THEN event_type END) AS last1, max(CASE WHEN rd = 2 THEN event_type END) AS last2
  FROM d GROUP BY user_id, d)
SELECT g.user_id, epoch_us(g.d) AS window_start,
       CAST(CASE WHEN g.other >= 2 AND o.event_type = 'purchase' THEN 1 ELSE 0 END AS BIGINT) AS starts_with,
       CAST(CASE WHEN g.last1 = 'purchase' AND g.last2 = 'view' THEN 1 ELSE 0 END AS BIGINT) AS ends_with
FROM g LEFT JOIN d o ON o.user_id = g.user_id AND o.d = g.d AND o.ra = g.other"""


def all_of_patterns(spark, sf):
    """Weeks with a click followed by a view and a view followed by a purchase, in any order."""
    return W.window_all_of(_events(spark, sf), {"look": is_("click") >> is_("view"), "buy": is_("view") >> is_("purchase")},
                           KEY, "ts", "7d", order_by=ORDER)


#: week = epoch-aligned seven days; t1 = the type of the next event of that week
WEEKS = """wk AS (SELECT user_id, event_type, epoch_us(ts) // 604800000000 AS week,
                lead(event_type) OVER (PARTITION BY user_id, epoch_us(ts) // 604800000000 ORDER BY ts, event_id) AS t1
         FROM events)"""

SQL_ALL_OF_PATTERNS = f"""WITH {WEEKS}
SELECT user_id, week * 604800000000 AS window_start FROM wk GROUP BY user_id, week
HAVING bool_or(event_type = 'click' AND t1 = 'view') AND bool_or(event_type = 'view' AND t1 = 'purchase')"""


def lacking_pattern(spark, sf):
    """Three-day windows, from a user's first day on, without a click followed by a view."""
    out = W.window_lacking(_events(spark, sf), is_("click") >> is_("view"), KEY, "ts", 3, order_by=ORDER)
    return out.select(KEY, F.col("day").cast("string").alias("day"))


SQL_LACKING_PATTERN = """WITH lo AS (
  SELECT user_id, min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events GROUP BY user_id),
x AS (
  SELECT e.user_id, lo.lo + CAST((CAST(e.ts AS DATE) - lo.lo) // 3 * 3 AS INTEGER) AS day, e.event_type, e.ts, e.event_id
  FROM events e JOIN lo ON lo.user_id = e.user_id),
y AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS t1 FROM x),
spine AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 3 DAY)) AS DATE) AS day FROM lo)
SELECT s.user_id, CAST(s.day AS VARCHAR) AS day FROM spine s
WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.user_id = s.user_id AND y.day = s.day AND y.event_type = 'click' AND y.t1 = 'view')"""


def _streamed(spark, sf, make, operators: int = 1):
    """``make(stream, delay, end)`` over the events as a file stream, to its end."""
    from tidemark.streaming.stateful import measured_delay, run_stream

    path = f"{sf.rstrip('/')}/events.parquet"
    delay = measured_delay(spark, path, "ts")
    return run_stream(spark, path, lambda s, end: make(s, delay, end), operators=operators)


def stream_tumbling(spark, sf):
    from tidemark.streaming.windows import stream_windows

    return _streamed(spark, sf, lambda s, delay, end: stream_windows(
        s, "ts", "6h", None, ["event_type"], [F.count(F.lit(1)).alias("n"), cents(F.sum("value")).alias("total_cents")], delay, end))


def stream_cascade(spark, sf):
    from tidemark.streaming.windows import stream_cascading

    return _streamed(spark, sf, lambda s, delay, end: stream_cascading(s, "ts", "1h", "1d", [], delay, end), operators=2)


def stream_ack(spark, sf):
    """P17 in a stream: errors with the first signup of the user within two days."""
    from tidemark.streaming.windows import stream_first_after

    out = _streamed(spark, sf, lambda s, delay, end: stream_first_after(
        s, et() == "error", et() == "signup", KEY, ORDER, ["event_id"], "ts", "2d", delay, end))
    return out.select(KEY, F.col("event_id").alias("error_event_id"), F.col("next_event_id").alias("ack_event_id"))


SQL_STREAM_ACK = """SELECT a.user_id, a.event_id AS error_event_id,
       (SELECT arg_min(b.event_id, row(b.ts, b.event_id)) FROM events b
        WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAY
          AND (b.ts > a.ts OR b.event_id > a.event_id)) AS ack_event_id
FROM events a WHERE a.event_type = 'error'"""


def stream_sessions(spark, sf):
    """P12 in a stream: sessions of a user that end with an hour without an event."""
    from tidemark.streaming.fold import stream_fold

    def step_(st, row):
        return ((row["event_id"], 1, row["value"]) if st is None else (st[0], st[1] + 1, st[2] + row["value"])), []

    schema = T.StructType([T.StructField("first_event_id", T.LongType()), T.StructField("n_events", T.LongType()),
                           T.StructField("total_cents", T.LongType())])
    return _streamed(spark, sf, lambda s, delay, end: stream_fold(
        s, KEY, ORDER, ["event_id", "value"], lambda: None, step_,
        lambda st: [] if st is None else [(st[0], st[1], round(st[2] * 100))], schema, "ts", idle="1h", delay=delay, end=end))


SQL_STREAM_SESSIONS = f"""SELECT user_id, first_event_id, n_events, total_cents FROM ({SQL_STATEFUL_FOLD}) AS s"""


def branch_values(spark, sf):
    out = match_cut(_events(spark, sf), is_("click").as_(1) | is_("purchase").as_(2), KEY, ORDER)
    return out.select(KEY, "match_no", F.col("start_event_id").alias("event_id"), "alt", "result")


SQL_BRANCH_VALUES = f"""WITH {E}
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS match_no, event_id,
       event_type AS alt, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS result
FROM e WHERE event_type IN ('click', 'purchase')"""


def pair_events(spark, sf):
    """Both events of each pair of clicks, not only the last."""
    out = match_lists(_events(spark, sf), is_("click") >> is_("click"), KEY, ORDER, ["event_id"])
    return out.select(KEY, "match_no", "n_events", F.col("events")[0]["event_id"].alias("first_event_id"),
                      F.col("events")[1]["event_id"].alias("second_event_id"))


SQL_PAIR_EVENTS = f"""SELECT user_id, match_no, CAST(2 AS BIGINT) AS n_events,
       start_event_id AS first_event_id, end_event_id AS second_event_id
FROM ({SQL_SEQ_SAME_CUT}) AS m"""


def _entries() -> list[tuple[str, Callable, str | None]]:
    return [
        ("literal_events", literal_events, SQL_LITERAL_EVENTS),
        ("pattern_project", pattern_project, SQL_PATTERN_PROJECT),
        ("union_one", union_one, SQL_UNION_ONE),
        ("seq_cut", seq_cut, SQL_SEQ_CUT),
        ("seq_same_cut", seq_same_cut, SQL_SEQ_SAME_CUT),
        ("seq_keep_left", seq_keep_left, SQL_SEQ_KEEP_LEFT),
        ("seq_keep_right", seq_keep_right, SQL_SEQ_KEEP_RIGHT),
        ("map_const", map_const, SQL_MAP_CONST),
        ("repeat_run", repeat_run, SQL_REPEAT_RUN),
        ("optional_seq", optional_seq, SQL_OPTIONAL_SEQ),
        ("always_error", always_error, SQL_ALWAYS_ERROR),
        ("ambiguous", ambiguous, SQL_AMBIGUOUS),
        ("event_status", event_status, SQL_EVENT_STATUS),
        ("status_counts", status_counts, SQL_STATUS_COUNTS),
        ("failure_summary", failure_summary_q, SQL_FAILURE_SUMMARY),
        ("open_at_end", open_at_end, SQL_OPEN_AT_END),
        ("whole_conversation", whole_conversation, SQL_WHOLE_CONVERSATION),
        ("chain_two_phase", chain_two_phase, SQL_CHAIN_TWO_PHASE),
        ("tokens", tokens, SQL_TOKENS),
        ("nested_depth", nested_depth, SQL_NESTED_DEPTH),
        ("rising_triples", rising_triples, SQL_RISING_TRIPLES),
        ("to_text", to_text, SQL_TO_TEXT),
        ("sum_value", sum_value, SQL_SUM_VALUE),
        ("every_pair", every_pair, SQL_EVERY_PAIR),
        ("in_last_n", in_last_n, SQL_IN_LAST_N),
        ("in_blocks_n", in_blocks_n, SQL_IN_BLOCKS_N),
        ("double_click", double_click, SQL_DOUBLE_CLICK),
        ("followed_within", followed_within, SQL_FOLLOWED_WITHIN),
        ("no_followup", no_followup, SQL_NO_FOLLOWUP),
        ("window_contains", window_contains, SQL_WINDOW_CONTAINS),
        ("window_matches", window_matches, SQL_WINDOW_MATCHES),
        ("window_edges", window_edges, SQL_WINDOW_EDGES),
        ("window_all_of", window_all_of, SQL_WINDOW_ALL_OF),
        ("window_lacking", window_lacking, SQL_WINDOW_LACKING),
        ("tumbling", tumbling, SQL_TUMBLING),
        ("sliding", sliding, SQL_SLIDING),
        ("rolling", rolling, SQL_ROLLING),
        ("cascading", cascading, SQL_CASCADING),
        ("ack_interval", ack_interval, SQL_ACK_INTERVAL),
        ("multi_pattern", multi_pattern, SQL_MULTI_PATTERN),
        ("longest_alt", longest_alt, SQL_LONGEST_ALT),
        ("partial_output", partial_output, SQL_PARTIAL_OUTPUT),
        ("stateful_fold", stateful_fold, SQL_STATEFUL_FOLD),
        ("seq_timeout", seq_timeout, SQL_SEQ_TIMEOUT),
        ("stream_match", stream_match, SQL_SEQ_TIMEOUT),
        ("branch_values", branch_values, SQL_BRANCH_VALUES),
        ("pair_events", pair_events, SQL_PAIR_EVENTS),
        ("rolling_value", rolling_value, SQL_ROLLING_VALUE),
        ("whole_values", whole_values, SQL_WHOLE_VALUES),
        ("stream_tumbling", stream_tumbling, SQL_TUMBLING),
        ("stream_cascade", stream_cascade, SQL_CASCADING),
        ("stream_ack", stream_ack, SQL_STREAM_ACK),
        ("stream_sessions", stream_sessions, SQL_STREAM_SESSIONS),
        ("nested_statuses", nested_statuses, SQL_NESTED_STATUSES),
        ("nested_days", nested_days, SQL_NESTED_DAYS),
        ("every_pattern", every_pattern, SQL_EVERY_PATTERN),
        ("last_n_pattern", last_n_pattern, SQL_LAST_N_PATTERN),
        ("sliding_contains", sliding_contains, SQL_SLIDING_CONTAINS),
        ("edges_pattern", edges_pattern, SQL_EDGES_PATTERN),
        ("all_of_patterns", all_of_patterns, SQL_ALL_OF_PATTERNS),
        ("lacking_pattern", lacking_pattern, SQL_LACKING_PATTERN),
    ]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn, _ in _entries()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _entries() if sql is not None}
