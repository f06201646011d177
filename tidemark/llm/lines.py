"""Line dedup by a log-template tree, in DataFrame functions only.

Lines are parsed as logs are: a tree of fixed depth leads from the number of
tokens over the first ``depth`` tokens (those with digits are variable at
once, unless all of the line's are) to a leaf.  In a leaf a place is constant where one token fills at
least half of the lines; the other places are variable fields.  A line whose
constant places are at least half of those after the leading ones takes the
leaf's template, tokens of variable places as ``<*>``; another keeps its own
text as template.  A template met in ``min_docs`` distinct texts is
boilerplate: its lines go from all texts but the first that has it.

Leaves of fewer than ``min_docs`` texts can hold no such template and are left
after one narrow count; only lines of the others are looked at token by token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, text_key, unpacked, written

#: Stands for a variable field.
FIELD = "<*>"


def _tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit as variable fields; null for a blank line.
    Where every token has a digit, nothing would be left to tell the lines of a table
    apart, so these tokens stay as they are."""
    t = F.split(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")), " ")
    named = line.rlike(r"(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0D0-9]+(?:[\x20\x09-\x0D]|\z)")
    t = F.when(named, F.transform(t, lambda x: F.when(x.rlike("[0-9]"), F.lit(FIELD)).otherwise(x))).otherwise(t)
    return F.when(line.rlike(r"[^\x20\x09-\x0D]"), t)


def line_templates(texts: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """(key, place, template) of every line in a leaf that ``min_docs`` texts share.

    ``texts``: distinct (key, text).  Copies of a text count once.
    """
    lines = (texts.select("key", F.posexplode(F.split("text", "\n")).alias("place", "line"))
             .withColumn("tokens", _tokens(F.col("line"))).where("tokens is not null"))
    leaf = F.md5(F.concat_ws(" ", F.size("tokens").cast("string"), F.slice("tokens", 1, depth)))
    # the line travels as text, a third of its token array, and is split again where needed
    lines = lines.select("key", "place", "line", F.unhex(leaf).alias("leaf"))
    # distinct (leaf, key) first, so a leaf's many lines in one text are one row
    leaves = (lines.select("leaf", "key").distinct().groupBy("leaf").agg(F.count("*").alias("docs"))
              .where(F.col("docs") >= min_docs).select(F.struct("leaf").alias("at")))
    # joined on the struct, so both sides are dealt anew and AQE can split a hot leaf
    shared = written(lines.withColumn("at", F.struct("leaf")).join(leaves, "at", "left_semi")
                     .select("leaf", "key", "place", _tokens(F.col("line")).alias("tokens")), "shared-lines")
    counts = (shared.select("leaf", F.posexplode("tokens").alias("i", "token"))
              .groupBy("leaf", "i", "token").agg(F.count("*").alias("n")))
    places = counts.groupBy("leaf", "i").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("lines"))
    constant = F.when(2 * F.col("top.n") >= F.col("lines"), F.col("top.token"))
    shape = (places.select("leaf", "i", F.coalesce(constant, F.lit(FIELD)).alias("token"))
             .groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("i", "token"))).alias("shape"))
             .select(F.struct("leaf").alias("at"), F.col("shape.token").alias("shape")))
    j = shared.withColumn("at", F.struct("leaf")).join(shape, "at")
    same = F.zip_with("tokens", "shape", lambda t, s: (t == s) & (s != FIELD))
    rest = F.size("tokens") - depth
    fits = F.size(F.filter(F.slice(same, depth + 1, 1 << 30), lambda x: x)) * 2 >= rest
    template = F.when((rest <= 0) | fits, F.array_join("shape", " ")).otherwise(F.array_join("tokens", " "))
    return j.select("key", "place", F.unhex(F.md5(template)).alias("template"))


def dedup_lines(docs: DataFrame, text: str = "text", depth: int = 3, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line of a recurring template goes from every text but the least (by
    digest) that has the template, where its first line stays.  Kept lines are
    joined by line feeds as they were; blank lines always stay.  Null and empty
    texts have no lines and an empty ``kept_text``.  Copies of a text are
    treated alike and count as one.  Columns of ``docs`` with the names of
    results give way to the results.
    """
    new = ("n_lines", "n_dropped", "kept_text")
    kept = [c for c in docs.columns if c.lower() not in new]
    # one row a text; the copies of a text meet on the map side already
    keyed = docs.select(text_key(text).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    found = written(line_templates(keyed, depth, min_docs).distinct(), "templates")
    often = (found.select("template", "key").distinct().groupBy("template")
             .agg(F.count("*").alias("docs"), F.min("key").alias("first_key")).where(F.col("docs") >= min_docs))
    hits = found.withColumn("at", F.struct("template")).join(
        often.select(F.struct("template").alias("at"), "first_key"), "at")
    first = F.min(F.when(F.col("key") == F.col("first_key"), F.col("place")))
    firsts = (hits.where("key = first_key").groupBy("template").agg(first.alias("first_place"))
              .select(F.struct("template").alias("at"), "first_place"))
    drop = (hits.join(firsts, "at").where("not (key = first_key and place = first_place)")
            .groupBy("key").agg(F.collect_set("place").alias("_drop")).select(F.struct("key").alias("_at"), "_drop"))
    # joined on the struct, so both sides are dealt anew and AQE can split the copies of a text
    out = docs.select(packed(docs, kept), F.struct(text_key(text).alias("key")).alias("_at"),
                      F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(drop, "_at", "left")
    lines = F.split("_text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_drop")  # hashed: linear in the lines
    # the split lines as a lambda's variable are computed once a text
    stay = F.get(F.transform(F.array(lines), lambda whole: F.transform(places, lambda i: F.get(whole, i))), F.lit(0))
    return out.select(
        *unpacked(kept),
        F.when(F.col("_text") == "", F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.size("_drop") >= 0, F.size("_drop")), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(stay, "\n")).alias("kept_text"))


LINES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS key FROM documents),
u AS (SELECT DISTINCT key, text FROM d),
l AS (SELECT key, i - 1 AS place, string_split(text, chr(10))[i] AS line
      FROM (SELECT key, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM u)),
t AS (SELECT key, place, list_transform(
          string_split(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' '),
          lambda x: CASE WHEN regexp_matches(x, '[0-9]')
              AND regexp_matches(line, '(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0D0-9]+(?:[\x20\x09-\x0D]|\z)')
              THEN '<*>' ELSE x END) AS tokens
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT *, CAST(len(tokens) AS VARCHAR) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM t),
g AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT key) >= 5),
s AS (SELECT f.* FROM f JOIN g USING (leaf)),
p AS (SELECT leaf, unnest(range(1, len(tokens) + 1)) AS i, unnest(tokens) AS token FROM s),
c AS (SELECT leaf, i, token, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT leaf, i, CASE WHEN 2 * max(n) >= sum(n) THEN max(struct_pack(n := n, token := token)).token ELSE '<*>' END AS token
      FROM c GROUP BY leaf, i),
h AS (SELECT leaf, list(token ORDER BY i) AS shape FROM m GROUP BY leaf),
j AS (SELECT s.key, s.place, CASE WHEN len(tokens) <= 3 OR 2 * len(list_filter(range(4, len(tokens) + 1),
              lambda k: tokens[k] = shape[k] AND shape[k] <> '<*>')) >= len(tokens) - 3
            THEN array_to_string(shape, ' ') ELSE array_to_string(tokens, ' ') END AS template
      FROM s JOIN h USING (leaf)),
o AS (SELECT template, min(key) AS first_key FROM j GROUP BY template HAVING count(DISTINCT key) >= 5),
k AS (SELECT j.key, j.place, j.template, o.first_key,
             min(CASE WHEN j.key = o.first_key THEN j.place END) OVER (PARTITION BY j.template) AS first_place
      FROM j JOIN o USING (template)),
x AS (SELECT DISTINCT key, place FROM k WHERE NOT (key = first_key AND place = first_place)),
kept AS (SELECT d.key, array_to_string(list(string_split(d.text, chr(10))[y.i] ORDER BY y.i), chr(10)) AS kept_text
         FROM u d, LATERAL (SELECT unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS i) y
         LEFT JOIN x ON x.key = d.key AND x.place = y.i - 1 WHERE x.key IS NULL GROUP BY d.key),
n AS (SELECT key, count(*) AS n_dropped FROM x GROUP BY key)
SELECT d.doc_id, CASE WHEN d.text = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(n.n_dropped, 0) AS n_dropped, sha256(coalesce(kept.kept_text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (key) LEFT JOIN kept USING (key)
"""
