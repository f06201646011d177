"""Mixing sources to target weights: capped water-filling, seeded repetitions.

Every source asks for a share of all words by its weight.  A source cannot
give more than ``max_epochs`` times its own words, so one whose share exceeds
that is held at the cap and the excess goes to the others by weight, until
none is above.  In closed form: sources in order of cap / weight are capped
as long as their cap lies under the water level of what is left, so one
ordered pass over the source table finds the level.

A source's epochs are target / size.  Each document is taken the whole part of
that, and once more if it lies in the first ``fraction`` of its source's words
in a seeded hash order, so a source's taken words miss its target by half a
document at most, and a rerun takes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, packed, unpacked

#: Hash-order buckets per source; only the bucket that holds a source's cut
#: is ordered row by row, so no task sees a whole source.
BUCKET_DIGITS = 3


def word_count(col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """source, source_size -> those, weight and target.  One row per source.

    Windows here run over the table of sources, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.partitionBy()
    # cap / weight in exact integers: cap times the product of all other weights' common multiple
    common = 1
    for x in set(weights):
        common *= x
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("level", F.expr(f"cap * {common} div weight"))
         .withColumn("total", F.sum("source_size").over(everything))
         .withColumn("all_weight", F.sum("weight").over(everything))
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0))))
    left = F.col("total") - F.col("cap_before")
    open_weight = F.col("all_weight") - F.col("weight_before")
    s = s.withColumn("capped", F.col("weight") * left >= F.col("cap") * open_weight)
    # the level of the sources that stay open: what is left after all capped ones
    s = (s.withColumn("capped_cap", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
         .withColumn("capped_weight", F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0)).over(everything)))
    flow = F.try_divide((F.col("weight") * (F.col("total") - F.col("capped_cap"))).cast("double"),
                        (F.col("all_weight") - F.col("capped_weight")).cast("double"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(flow)
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
                weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target``, ``repeats``, ``taken``.

    Sources in code point order (null last) weigh ``weights`` in turn.  Null
    texts have size 0; a source without words has target 0.  Rows with the
    same id, source and text are told apart by nothing, so it doesn't matter
    which of them is repeated.  Columns of ``docs`` with the names of results
    give way to the results.  An empty table gives an empty result.
    """
    new = ("size", "source_size", "target", "repeats", "taken")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string")))
    kept = [c for c in docs.columns if c.lower() not in new]
    d = docs.select(packed(docs, kept), F.col(f"`{source}`").alias("_from"), F.col(f"`{doc_id}`").alias("_id"),
                    word_count(text).alias("size"), key.alias("_key"), F.substring(key, 1, BUCKET_DIGITS).alias("_bucket"))
    # narrow first: one row per (source, bucket), then the windows per source
    buckets = (d.groupBy(F.col("_from").alias("_source"), "_bucket")
               .agg(F.sum("size").alias("_words")))
    sizes = buckets.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"))
    plan = targets(sizes, weights, max_epochs).select(
        F.col("source").alias("_source"), "source_size", "target",
        F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int").alias("_whole"))
    plan = plan.withColumn("_extra", F.col("target") - F.col("_whole") * F.col("source_size"))
    run = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_start", F.coalesce(F.sum("_words").over(run), F.lit(0)))
    plan = (buckets.join(plan, buckets["_source"].eqNullSafe(plan["_source"]))
            .select(buckets["_source"].alias("_s"), F.col("_bucket").alias("_b"), "_start", "_words",
                    "source_size", "target", "_whole", "_extra"))
    j = (d.join(plan, F.col("_from").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))))
    whole_in = F.col("_start") + F.col("_words") <= F.col("_extra")
    cut = ~whole_in & (F.col("_start") < F.col("_extra"))
    inside = j.where(cut)
    order = (Window.partitionBy("_from", "_bucket").orderBy("_key", "_id", "size")
             .rowsBetween(Window.unboundedPreceding, -1))
    at = F.col("_start") + F.coalesce(F.sum("size").over(order), F.lit(0))
    inside = inside.withColumn("_once", (at + F.col("size") / 2 <= F.col("_extra")).cast("int"))
    outside = j.where(~cut).withColumn("_once", whole_in.cast("int"))
    out = inside.unionByName(outside)
    repeats = F.col("_whole") + F.when(F.col("size") > 0, F.col("_once")).otherwise(0)
    return (out.withColumn("repeats", repeats.cast("int"))
            .withColumn("taken", F.col("repeats").cast("long") * F.col("size"))
            .select(*unpacked(kept), *new))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('7' || coalesce(':' || CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
             3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, cap * 6 // weight AS level FROM w),
b AS (SELECT *,
        coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
        coalesce(sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb,
        sum(weight) OVER () AS aw FROM l),
c AS (SELECT *, weight * (total - cb) >= cap * (aw - wb) AS capped FROM b),
t AS (SELECT source, source_size,
        CASE WHEN capped THEN CAST(cap AS DOUBLE)
             ELSE CAST(weight * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) AS DOUBLE)
                / CAST(aw - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER () AS DOUBLE) END AS target
      FROM c),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
f AS (SELECT *, target - whole * source_size AS extra FROM e),
r AS (SELECT d.doc_id, d.size, f.source_size, f.target, f.whole, f.extra,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
        sum(d.size) OVER (PARTITION BY d.source, substr(d.k, 1, 3)) AS words,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(d.k, 1, 3)
                                   RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN upto <= extra THEN 1
                                 WHEN upto - words >= extra THEN 0
                                 WHEN pos + size / 2.0 <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
