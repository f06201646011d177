"""Text as an event source: rule tokenisation.

Rules are tried at the current position in the order given; the first
rule that fits the text there wins and is applied greedily.  A character
no rule fits becomes an ``error`` token of its own and is skipped.

Rules that look at nothing but the token itself are one regular expression over
the text, and a token's kind is the first rule that fits it whole.  Rules with
lookaround, anchors or back references, and tokens whose groups are asked for, are
one expression with a group for each rule: every match is rewritten as its groups
between two delimiters, so which rule took a token, and the rule's own groups,
are read from the match itself, where lookaround still sees the text around it.
Texts that hold a delimiter are read group by group instead.  No Python runs.

Keep rules to the regex subset that Java and RE2 share when results are
compared with another engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default rules for prose.  Leading blanks belong to the
# token that follows them, as in the rules of the expression tokeniser.
BLANKS = "[ \\t\\r\\n]*"
PROSE_RULES: list[tuple[str, str]] = [
    ("number", BLANKS + "[0-9]+"),
    ("word", BLANKS + "\\p{L}+"),
    ("punct", BLANKS + "[.,;:!?]"),
]
# The expression tokens (number, + - * / ( )).
EXPR_RULES: list[tuple[str, str]] = [
    ("num", BLANKS + "([0-9]+)"),
    ("plus", BLANKS + "\\+"),
    ("minus", BLANKS + "-"),
    ("times", BLANKS + "\\*"),
    ("div", BLANKS + "/"),
    ("lparen", BLANKS + "\\("),
    ("rparen", BLANKS + "\\)"),
]

#: Delimiters of tokens and of their groups: code points that Unicode keeps out of texts.
_TOKEN, _GROUP = "\ufdd0", "\ufdd1"


#: What makes a rule depend on the text around a token, or on the numbers of groups.
_CONTEXT = re.compile(r"\(\?[=!<]|\\[bBAzZG1-9]|[\^$]")


def shifted(rule: str, by: int) -> tuple[str, int]:
    """The rule with its back references moved ``by`` groups on, and how many
    capturing groups it has."""
    out, groups, i, in_class = [], 0, 0, 0
    while i < len(rule):
        c = rule[i]
        if c == "\\" and i + 1 < len(rule):
            if rule[i + 1] == "Q":  # quoted up to \E
                end = rule.find("\\E", i)
                end = len(rule) if end < 0 else end + 2
                out.append(rule[i:end])
                i = end
                continue
            if rule[i + 1] in "123456789" and not in_class:
                j = i + 2
                while j < len(rule) and rule[j].isdigit():
                    j += 1
                out.append(f"\\{int(rule[i + 1:j]) + by}")
                i = j
                continue
            out.append(rule[i:i + 2])
            i += 2
            continue
        if c == "[":
            in_class += 1
        elif c == "]" and in_class:
            in_class -= 1
        elif c == "(" and not in_class:
            rest = rule[i + 1:i + 4]
            if not rest.startswith("?") or (rest.startswith("?<") and rest[2:3] not in ("=", "!")):
                groups += 1
        out.append(c)
        i += 1
    return "".join(out), groups


def token_regex(rules: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The expression of all rules and, for each, its group's number and the
    number of groups inside; the last group is the error character."""
    parts, places, at = [], [], 1
    for _, r in rules:
        text, groups = shifted(r, at)
        parts.append(f"({text})")
        places.append((at, groups))
        at += groups + 1
    return "(?s)" + "|".join(parts) + "|(.)", [*places, (at, 0)]


def tokenize(df: DataFrame, text_col: str, id_cols: Sequence[str],
             rules: Sequence[tuple[str, str]] = PROSE_RULES,
             error_kind: str = "error", *, groups: bool = False,
             values: dict[str, tuple[str, Callable[[Column], Column]]] | None = None) -> DataFrame:
    """One row per token: ``id_cols``, ``pos`` (1-based), ``kind``, ``token``.

    ``token`` is the matched text without leading blanks; error tokens keep
    their one character.  ``groups`` adds the groups of the rule that took the
    token as an array (one that took no part is an empty string).  ``values``
    gives kinds a typed value: ``{"num": ("n", lambda g: g[0].cast("int"))}`` adds the
    column ``n``, NULL for other kinds.  A rule must take a character at least.
    NULL and empty texts have no tokens.
    """
    if not groups and not values and not any(_CONTEXT.search(r) for _, r in rules):
        return _alone(df, text_col, id_cols, rules, error_kind)
    rx, places = token_regex(rules)
    n = places[-1][0]
    text = F.col(text_col)
    marked = F.regexp_replace(text, F.lit(rx), F.lit(_TOKEN + _GROUP.join(f"${i}" for i in range(1, n + 1))))
    by_group = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(rx), F.lit(i)).alias(f"g{i}") for i in range(1, n + 1)])
    # a token read group by group begins with the token delimiter, which no other does
    slow = F.transform(by_group, lambda z: F.concat(F.lit(_TOKEN), F.to_json(F.array(*[z[f"g{i}"] for i in range(1, n + 1)]))))
    fast = F.split(F.substring(marked, 2, 1 << 30), _TOKEN, -1)
    tokens = (F.when(F.instr(text, _TOKEN) + F.instr(text, _GROUP) > 0, slow)
              .when(text != "", fast))
    rows = df.select(*id_cols, F.posexplode(tokens).alias("_p", "_tok"))
    tok = F.col("_tok")
    listed = F.from_json(F.substring(tok, 2, 1 << 30), "array<string>")
    # the delimiters before a match's first character count the groups before the rule's own
    cut = rows.select(*id_cols, "_p", "_tok", F.ltrim(tok, F.lit(_GROUP)).alias("_rest"),
                      F.when(F.startswith(tok, F.lit(_TOKEN)), listed).alias("_list"))
    first = F.lit(n - 1)
    for at, _ in reversed(places):
        first = F.when(F.col("_list")[at - 1] != "", at - 1).otherwise(first)
    own = F.when(F.col("_list").isNotNull(), first).otherwise(F.length("_tok") - F.length("_rest"))
    placed = cut.select(*id_cols, "_p", "_tok", "_rest", "_list", own.alias("_own"))
    raw = F.when(F.col("_list").isNotNull(), F.col("_list")[F.col("_own")]).otherwise(F.substring_index("_rest", _GROUP, 1))
    kind, inner = F.lit(error_kind), F.lit(0)
    for (name, _), (at, size) in zip(rules, places):
        kind = F.when(F.col("_own") == at - 1, F.lit(name)).otherwise(kind)
        inner = F.when(F.col("_own") == at - 1, F.lit(size)).otherwise(inner) if size else inner
    extra = []
    if groups or values:
        parts = F.when(F.col("_list").isNotNull(), F.col("_list")).otherwise(F.split("_tok", _GROUP, -1))
        extra = [F.slice(parts, F.col("_own") + 2, inner).alias("groups")]
    out = placed.select(*id_cols, (F.col("_p") + 1).cast("long").alias("pos"), kind.alias("kind"), raw.alias("_raw"), *extra)
    token = F.when(F.col("kind") == F.lit(error_kind), F.col("_raw")).otherwise(F.ltrim(F.col("_raw"), F.lit(" \t\r\n")))
    typed = [F.when(F.col("kind") == k, fn(F.col("groups"))).alias(c) for k, (c, fn) in (values or {}).items()]
    return out.select(*id_cols, "pos", "kind", token.alias("token"), *(["groups"] if groups else []), *typed)


def _alone(df: DataFrame, text_col: str, id_cols: Sequence[str], rules: Sequence[tuple[str, str]], error_kind: str) -> DataFrame:
    """Tokens of rules that depend on nothing around them: an earlier rule that fits the
    token whole would have won where it stands, so the first that does took it."""
    rx = "(?s)" + "|".join(f"(?:{r})" for _, r in rules) + "|."
    found = F.regexp_extract_all(F.col(text_col), F.lit(rx), F.lit(0))
    rows = df.select(*id_cols, F.posexplode(found).alias("_p", "_raw"))
    kind: Column = F.lit(error_kind)
    for name, r in reversed(list(rules)):
        kind = F.when(F.col("_raw").rlike(f"^(?:{r})$"), F.lit(name)).otherwise(kind)
    out = rows.select(*id_cols, "_p", "_raw", kind.alias("kind"))
    token = F.when(F.col("kind") == F.lit(error_kind), F.col("_raw")).otherwise(F.ltrim(F.col("_raw"), F.lit(" \t\r\n")))
    return out.select(*id_cols, (F.col("_p") + 1).cast("long").alias("pos"), "kind", token.alias("token"))
