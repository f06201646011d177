"""Benchmark decontamination by size-partitioned MinHash containment, native.

An item is contained in a document where at least ``percent`` of the item's
distinct word shingles are among the document's.  Containment doesn't depend on the
document's length, so, unlike a Jaccard sketch, the signature must not
either: items are partitioned by size (powers of two), and every partition has its
own signature length s = floor((100 - percent) / 100 * largest size) + 1.  An item's
signature is its s least MinHash values.  A document that contains the item lacks
fewer than s of its shingles, so at least one value of the signature is among
the document's shingles: the search loses nothing, in documents of any length.

Document shingles are probed against the signatures only.  The candidates, pairs of
text and item, are verified by exact containment of the full shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, text_key, unpacked, written

#: Rows of a signature table (24 bytes each) up to which it is sent to all executors.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: Column, words: int, lengths: list[int] | None = None) -> Column:
    """64-bit hashes of the shingles of ``words`` words, runs of letters, marks and
    digits, lower-cased; a shorter text's whole sequence is its one shingle.  With
    ``lengths``, each below ``words``, a text of any length has all shingles of ``words`` and
    of those many words, the latter hashed as whole short texts are."""
    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        none = F.slice(h, 1, 0)
        if lengths is not None:
            parts = [F.when(n >= words, F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(
                *[F.get(h, i + k) for k in range(words)]))).otherwise(none)]
            for m in lengths:  # the lambda is called at once, so it sees this ``m``
                parts.append(F.when(n >= m, F.transform(F.sequence(F.lit(1), n - (m - 1)), lambda i: F.xxhash64(
                    F.lit("short"), F.slice(h, i, F.lit(m))))).otherwise(none))
            return F.concat(*parts)
        full = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        short = F.transform(F.slice(h, 1, 1), lambda _: F.xxhash64(F.lit("short"), h))
        return F.when(n >= words, full).otherwise(short)

    return _let(F.transform(_words(text), lambda x: F.xxhash64(x)), of_hashes)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once (a plain reuse would be
    computed again in every lambda call)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(items: DataFrame, percent: int) -> DataFrame:
    """(sh, item): the signature values of (item, shingles) rows."""
    size = F.size("shingles")
    largest = F.pow(F.lit(2), F.floor(F.log2(size)) + 1) - 1  # of the item's partition
    length = F.least(size, (F.floor(largest * (100 - percent) / 100) + 1).cast("int"))
    order = F.array_sort(F.transform("shingles", lambda x: F.struct(F.xxhash64(F.lit(3), x).alias("rank"), x.alias("sh"))))
    return items.where(size > 0).select("item", F.explode(F.slice(order, F.lit(1), length)).alias("v")).select(
        F.col("v.sh").alias("sh"), "item")


def _small(df: DataFrame) -> DataFrame:
    """``df`` (a written table), marked for broadcast where its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
                    words: int = 5, percent: int = 80) -> DataFrame:
    """(key, item, n_shared, n_item): items contained in the texts of ``docs``.

    ``key`` is the text's digest (``text_key``), ``item`` that of the item's text.
    Null and empty texts and items without words contain nothing and are contained
    in nothing.  An item of fewer than ``words`` words is found wherever these words
    stand one after another.
    """
    it = written(items.select(text_key(item_text).alias("item"), F.array_distinct(
        shingle_hashes(F.col(item_text), words)).alias("shingles"), F.size(_words(F.col(item_text))).alias("size")).dropDuplicates(["item"]).where(F.size("shingles") > 0), "items")
    # the lengths of shorter items, words - 1 numbers at most; texts have shingles of those too
    lengths = sorted(r[0] for r in it.where(F.col("size") < words).select("size").distinct().collect())
    sig = written(signatures(it, percent), "signatures")
    keyed = docs.select(text_key(text).alias("key"), F.col(text).alias("text"))
    probes = keyed.select("key", F.explode(shingle_hashes(F.col("text"), words, lengths or None)).alias("sh"))
    cand = written(probes.join(_small(sig), "sh").select("key", "item").distinct(), "candidates")
    suspects = _small(written(cand.select("key").distinct(), "suspects"))
    full = (keyed.join(suspects, "key", "left_semi").dropDuplicates(["key"])
            .select("key", F.array_distinct(shingle_hashes(F.col("text"), words, lengths or None)).alias("have")))
    j = cand.join(full, "key").join(it, "item")
    shared = F.size(F.array_intersect("shingles", "have"))
    return (j.select("key", "item", shared.alias("n_shared"), F.size("shingles").alias("n_item"))
            .where(100 * F.col("n_shared") >= percent * F.col("n_item")))


def contaminated_pairs(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id",
                       text: str = "text", item_text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): each document with each item it contains.
    Copies of documents and of items each give their own rows."""
    found = written(contained_items(docs, items, text, item_text, words, percent), "contained")
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(text).alias("key"))
    i = items.select(F.col(f"`{item_id}`").alias("item_id"), text_key(item_text).alias("item"))
    return (found.join(i, "item").join(d, "key").select(
        "doc_id", "item_id", F.col("n_shared").cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item")))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
                      words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain no item; all columns as they are."""
    bad = written(contained_items(docs, items, text, item_text, words, percent).select("key").distinct(), "contaminated")
    d = docs.select(packed(docs, docs.columns), text_key(text).alias("key"))
    return d.join(bad, "key", "left_anti").select(*unpacked(docs.columns))


DECONTAM_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, CASE WHEN len(w) >= 5 THEN w[i:i + 4] ELSE ['short', array_to_string(w, ' ')] END AS sh
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
bl AS (SELECT DISTINCT len(w) AS m FROM b WHERE len(w) BETWEEN 1 AND 4),
ds AS (SELECT DISTINCT doc_id, sh FROM (
         SELECT doc_id, w[i:i + 4] AS sh
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
         UNION ALL
         SELECT doc_id, ['short', array_to_string(w[i:i + m - 1], ' ')] AS sh
         FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d JOIN bl ON len(w) >= m))
       SEMI JOIN bs USING (sh)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item
FROM ds JOIN bs USING (sh) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""
