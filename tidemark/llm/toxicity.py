"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words, lower-cased, and the first five bytes of
longer ones (so inflected forms share a term), hashed to ``2^BITS`` numbers.  The
score is

    sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

with x_i = 1 for terms in the text: the factors v learn pairs that mean more
together than apart, as an insult beside the mention of a group, which a sum
of weights can't.

Training reads at most ``max_rows`` labelled rows (the least by hash of their
id), of which the ``max_terms`` most telling terms are kept; both are bounds of the
fit and parameters.  Scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import mix, packed, text_key, unpacked, word_hashes, word_spans, written

BITS = 22
PREFIX = 5
#: All ASCII bytes but letters and digits separate terms.
_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _BREAK[_lo:_hi] = False


def terms_of(text: str | None) -> np.ndarray:
    """Sorted distinct term numbers of a whole text."""
    data = np.frombuffer((text or "").lower().encode(), np.uint8)
    s, e = word_spans(data, _BREAK)
    if not len(s):
        return np.zeros(0, np.int32)
    long = e - s > PREFIX
    h = np.concatenate([mix(word_hashes(data, s, e), 21), mix(word_hashes(data, s[long], s[long] + PREFIX), 22)])
    return np.unique(h >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    terms: np.ndarray  # sorted term numbers that have weights
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, lists: list[np.ndarray]) -> np.ndarray:
        """Scores of texts given as term numbers."""
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        if not len(self.terms):
            return np.full(len(lists), _sigmoid(np.array([self.bias]))[0])
        col = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        ok = self.terms[col] == flat
        return _sigmoid(_raw(row[ok], col[ok], len(lists), self.bias, self.weights, self.factors)[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _raw(row, col, n, bias, w, v):
    """Raw scores and the factor sums of ``n`` rows of (row, col) ones."""
    sums = np.stack([np.bincount(row, v[col, f], n) for f in range(v.shape[1])], 1)
    squares = np.bincount(row, (v[col] ** 2).sum(1), n)
    return bias + np.bincount(row, w[col], n) + 0.5 * ((sums ** 2).sum(1) - squares), sums


def fit_machine(row: np.ndarray, col: np.ndarray, y: np.ndarray, terms: np.ndarray, factors: int = 4,
                steps: int = 300, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> Model:
    """Fit by Adam on the whole (bounded) sample; logistic loss with weight decay."""
    rng = np.random.default_rng(seed)
    n, k = len(y), len(terms)
    prior = (y.sum() + 0.5) / (n + 2)
    params = [np.array([np.log(prior / (1 - prior))]), np.zeros(k), rng.normal(0, 0.05, (k, factors))]
    if not n or not k:
        return Model(terms, float(params[0][0]), params[1], params[2])
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        z, sums = _raw(row, col, n, params[0][0], params[1], params[2])
        g = (_sigmoid(z) - y) / n
        gr = g[row]
        gv = np.stack([np.bincount(col, gr * sums[row, f], k) for f in range(factors)], 1)
        gv -= np.bincount(col, gr, k)[:, None] * params[2]
        grads = [np.array([g.sum()]), np.bincount(col, gr, k) + decay * params[1], gv + decay * params[2]]
        for p, d, a, b in zip(params, grads, first, second):
            a *= 0.9
            a += 0.1 * d
            b *= 0.999
            b += 0.001 * d * d
            p -= rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    return Model(terms, float(params[0][0]), params[1], params[2])


def held_out(doc_id: Column) -> Column:
    """Fifth of the ids that training never sees; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _numbers(batches):
    for b in batches:
        lists = [terms_of(t.as_py()) for t in b.column(1)]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["y", "terms"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
          max_rows: int = 20_000, max_terms: int = 20_000, least_docs: int = 4, least_z: float = 3.5) -> Model:
    """Fit on the labelled rows of ``docs`` that aren't held out.

    At most ``max_rows`` rows are fitted, however often an id is met: equal texts of an
    id count once, different ones and two labels of an id count each.
    Rows without a label or an id are no training rows.  With no rows, or rows of
    one label, the model scores every text with the (smoothed) share of label 1.
    """
    sample = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y"))
              .where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("_id")))
              .distinct().orderBy(F.xxhash64("_id"), "_id", "y").limit(max_rows))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    found = texts.join(F.broadcast(sample), "_id")  # max_rows pairs of numbers
    # an id may be on many rows: the bound holds for what is fitted, texts by their digests
    chosen = (found.select("_id", "y", text_key("_text").alias("_key")).distinct()
              .orderBy(F.xxhash64("_id"), "_id", "y", "_key").limit(max_rows))
    labelled = (found.withColumn("_key", text_key("_text")).join(F.broadcast(chosen), ["_id", "y", "_key"])
                .dropDuplicates(["_id", "y", "_key"]).select("y", "_text"))
    rows = written(labelled.mapInArrow(_numbers, "y int, terms array<int>"), "train")
    total, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not total or ones in (0, total):
        return fit_machine(np.zeros(0, int), np.zeros(0, int), np.array([ones / total] * total if total else []), np.zeros(0, np.int32))
    p = ones / total
    stats = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("n"), F.sum("y").alias("pos"))
    z = F.abs(F.col("pos") - p * F.col("n")) / F.sqrt(F.col("n") * p * (1 - p))
    top = (stats.where(F.col("n") >= least_docs).withColumn("z", z).where(F.col("z") >= least_z)
           .orderBy(F.desc("z"), "term").limit(max_terms).select("term").collect())  # max_terms numbers
    terms = np.sort(np.array([r[0] for r in top], np.int32))

    def chosen(batches):
        for b in batches:
            lists = [np.intersect1d(x.values.to_numpy(), terms, assume_unique=True) for x in b.column(1)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))], names=["y", "terms"])

    data = rows.mapInArrow(chosen, rows.schema).orderBy("y", "terms").toArrow()  # max_rows rows of chosen terms
    lists = data.column("terms").combine_chunks()
    length = np.diff(lists.offsets.to_numpy())
    col = np.searchsorted(terms, lists.flatten().to_numpy())
    return fit_machine(np.repeat(np.arange(total), length), col, data.column("y").to_numpy().astype(float), terms)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    Null and empty texts have no terms and get the score of the bias.  Columns of
    ``docs`` with the names of results give way to the results.
    """
    new = ("score", "predicted")
    kept = [c for c in docs.columns if c.lower() not in new]
    src = docs.select(packed(docs, kept), F.col(f"`{text}`").cast("string").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # max_terms weights and factors

    def run(batches):
        for b in batches:
            s = sent.value.scores([terms_of(t.as_py()) for t in b.column(b.num_columns - 1)])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["_in", *new])

    schema = src.drop("_text").schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return src.mapInArrow(run, schema).select(*unpacked(kept), *new)
