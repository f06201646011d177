"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, html, lattice, lines, minhash, mixing, phrases, pii, runs, substring, toxicity, urls, vectors
from tidemark.session import table

# The rules of the url query's contract.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op1_substring(spark: SparkSession, sf: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf, "embeddings"), least=0.93)


def op3_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), words=4, percent=80)


def op4_lines(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the text without the dropped lines)."""
    out = lines.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"), depth=3, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_decontam(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document and benchmark item it contains."""
    return decontam.contaminated_pairs(table(spark, sf, "documents"), table(spark, sf, "benchmark"), words=5, percent=80)


def op7_html(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf, "pages").select("page_id", "url", "html"))


def op8_urls(spark: SparkSession, sf: str) -> DataFrame:
    out = urls.url_filter(table(spark, sf, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                      F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: A public subword vocabulary; only the driver reads it.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op11_lattice(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", lattice.held_out(F.col("doc_id")).alias("held_out"))
    model = lattice.train(docs.where("not held_out").select("text"), VOCABULARY)
    out = lattice.score_documents(docs, model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = runs.find_runs(docs, min_length=24, periods=3, plant=runs.planted(F.col("doc_id")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents").select("lang", "text"), longest=5, least=100, cover=100, first=2000)


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring, op2_vectors, op3_minhash, op4_lines, op5_toxicity, op6_decontam, op7_html, op8_urls, op9_pii, op10_mixing, op11_lattice, op12_runs, op13_phrases, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_lines": lines.LINES_SQL, "op6_decontam": decontam.DECONTAM_SQL, "op8_urls": urls.URL_SQL, "op10_mixing": mixing.MIX_SQL, "op13_phrases": phrases.PHRASE_SQL}
