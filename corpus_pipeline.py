"""Corpus pipeline: documents to a deduplicated, decontaminated, weighted mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result to the shared folder and reads it again as the next one's
docs, so a lost executor costs work of one stage only.  All but the last return
the columns of documents.  Empty tables pass through; extra columns stay.

A factorization machine isn't SQL, so there is no ORACLE_SQL; ``tests/llm``
holds each stage's kept ids and texts against brute force or SQL, the toxicity
stage against its model's predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lines, minhash, mixing, toxicity
from tidemark.llm.common import packed, text_key, unpacked, written
from tidemark.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts stay
    unless the labels' share of toxic rows is a half."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    d = docs.select(packed(docs, docs.columns), F.col("text").alias("t"))
    return toxicity.score_toxicity(d, model, text="t").where("predicted = 0").select(*unpacked(docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays, null texts as null."""
    others = [c for c in docs.columns if c != "text"]
    out = lines.dedup_lines(docs.select(packed(docs, others), F.col("text").alias("t")), text="t")
    cut = F.col("n_dropped") > 0
    values = dict(zip(others, unpacked(others))) | {"text": F.when(F.col("t").isNotNull(), F.col("kept_text")).alias("text")}
    if "n_chars" in values:
        values["n_chars"] = F.when(cut, F.length("kept_text")).otherwise(values["n_chars"]).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[values[c] for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, 0.8): the
    one of the least id, among equal ids that of the least text digest."""
    # rows numbered in a written table, so rows of one id, or of none, are told apart
    numbered = written(docs.select(packed(docs, docs.columns), F.monotonically_increasing_id().alias("row")), "numbered")
    rows = numbered.select("row", F.col("_in.text").alias("text"))
    kept = minhash.near_duplicates(rows, doc_id="row", words=5, percent=80).select(
        F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    # row numbers follow the order of the files read, which may differ in a rerun; ids don't
    rank = F.struct(F.col("_in.doc_id").isNull(), F.col("_in.doc_id"), text_key("_in.text"), "row")
    kept = (numbered.select("row", rank.alias("rank")).join(kept, "row").groupBy("group")
            .agg(F.min("rank").getField("row").alias("row")).select("row"))
    return numbered.join(kept, "row", "left_semi").select(*unpacked(docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go (five words, 0.8 of the item)."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix: documents taken at least once, with how often (``repeats``),
    their words (``size``), their source's words and target, and the words taken."""
    return mixing.mix_sources(docs).where("repeats > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
