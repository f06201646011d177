"""Language-model scores by subword lattice likelihood.

The pieces of an existing subword vocabulary, with its scores as prior, span a
lattice over every word: one path for each way to spell it.  A document's
probability is the sum over all its segmentations, found by the forward
recursion in log space:

    alpha(0) = 0,   alpha(j) = log sum over pieces text[i:j] of exp(alpha(i) + log p(piece))

Pieces never cross a word's start (a piece may only begin with the space that
opens a word), so the sum over a document is the product of the sums of its
words times the probability of the end.  Every byte is a piece, so every text
has a probability, and the probabilities of all texts sum to one at most.

The vocabulary is taken as it is.  The model, the pieces' probabilities, is
learned from the training documents: expected counts of every piece over all
segmentations of all training words (forward times backward), added to the prior.
Word counts cover all training documents and are pre-aggregated in every task.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import evicted, least_count, mix, packed, unpacked, written

_INF = -np.inf
#: Words of more bytes go through the recursion one by one.
_LONG = 64
#: Cells (words times bytes) of one vectorised recursion.
_CELLS = 1 << 15
#: Distinct words a task counts at once.
_COUNTED = 1 << 17
#: Words of texts that are scored together.
_TOGETHER = 1 << 17


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; bytes split at exactly 0x20, 0x09-0x0D."""
    return (text or "").encode().lower().split()


# ------------------------------------------------------------------ vocabulary


def load_vocabulary(path: str, floor: float = 1e-9) -> tuple[list[bytes], np.ndarray]:
    """Pieces that lower-cased words can hold, and their prior probabilities.

    ``path`` names a sentencepiece model.  Log-probability scores are used as they
    are; merge ranks (whole numbers, as of merge vocabularies) count as ranks of
    Zipf's law.  Byte pieces, and bytes the vocabulary lacks, get the least of them.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
    score = np.array([m.get_score(i) for i in ids], float)
    ranks = bool(len(score)) and bool((score == np.round(score)).all())
    weight = 1 / (3 - np.maximum(score, -1e8)) if ranks else np.exp(score)
    prior: dict[bytes, float] = {}
    for i, w in zip(ids, weight):
        p = m.id_to_piece(i).replace("▁", " ").encode()
        if p and p.lower() == p and not p[1:].split(b" ")[1:] and p[:1] not in b"\t\n\v\f\r" and len(p[1:].split()) < 2:
            prior[p] = prior.get(p, 0.0) + float(w)
    least = min(prior.values(), default=1.0)
    for b in range(256):
        if b not in (9, 10, 11, 12, 13) and not 65 <= b <= 90:
            prior.setdefault(bytes([b]), least)
    pieces = sorted(prior)
    weight = np.maximum([prior[p] for p in pieces], floor)
    return pieces, weight / weight.sum()


# --------------------------------------------------------------------- lattice


class Lattice:
    """Forward and backward sums over the segmentations of words."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.log_p = np.asarray(log_p, float)
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        self.tables = {}
        for n, numbers in by_length.items():
            block = np.frombuffer(b"".join(pieces[i] for i in numbers), np.uint8).reshape(len(numbers), n)
            key = _keys(block, n)[n][:, 0]
            order = np.argsort(key)
            self.tables[n] = key[order], np.array(numbers)[order]

    def _edges(self, block: np.ndarray, length: np.ndarray) -> dict[int, np.ndarray]:
        """{piece length: piece number at every cell, or -1} of zero-padded words."""
        out, width = {}, block.shape[1]
        key = _keys(block, min(self.longest, width))
        room = length[:, None] - np.arange(width)
        for n, (keys, numbers) in self.tables.items():
            if n <= width:
                at = np.minimum(np.searchsorted(keys, key[n]), len(keys) - 1)
                out[n] = np.where((keys[at] == key[n]) & (room[:, :width - n + 1] >= n), numbers[at], -1)
        return out

    def _sweep(self, lp: dict[int, np.ndarray], rows: int, width: int) -> np.ndarray:
        a = np.full((rows, width + 1), _INF)
        a[:, 0] = 0
        for t in range(1, width + 1):
            a[:, t] = _log_sum([a[:, t - n] + v[:, t - n] for n, v in lp.items() if n <= t])
        return a

    def _blocks(self, words: list[bytes]):
        """(places, zero-padded bytes with the opening space, lengths) by length."""
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(length, kind="stable")
        lo = 0
        while lo < len(order) and length[order[lo]] <= _LONG:
            hi = min(len(order), lo + max(1, _CELLS // int(length[order[lo]])))
            hi = lo + int(np.searchsorted(length[order[lo:hi]], min(_LONG, length[order[lo]] + 3), side="right"))
            at = order[lo:hi]
            width = int(length[at[-1]])
            yield at, np.frombuffer(b"".join((b" " + words[i]).ljust(width, b"\0") for i in at), np.uint8).reshape(len(at), width), length[at]
            lo = hi
        for i in order[lo:]:
            yield i, None, None

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability, over all its segmentations."""
        out = np.zeros(len(words))
        for at, block, length in self._blocks(words):
            if block is None:
                out[at] = self._forward(b" " + words[at])[-1]
                continue
            lp = {n: np.where(e >= 0, self.log_p[e], _INF) for n, e in self._edges(block, length).items()}
            a = self._sweep(lp, len(at), block.shape[1])
            out[at] = a[np.arange(len(at)), length]
        return out

    def expected(self, words: list[bytes], count: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in ``words``, each taken ``count`` times."""
        total = np.zeros(len(self.log_p))
        for at, block, length in self._blocks(words):
            if block is None:
                self._expected_long(b" " + words[at], float(count[at]), total)
                continue
            rows, width = block.shape
            edges = self._edges(block, length)
            lp = {n: np.where(e >= 0, self.log_p[e], _INF) for n, e in edges.items()}
            a = self._sweep(lp, rows, width)
            b = np.full((rows, width + 1), _INF)
            b[np.arange(rows), length] = 0
            for t in range(width - 1, -1, -1):
                inside = length > t
                b[:, t] = np.where(inside, _log_sum([v[:, t] + b[:, t + n] for n, v in lp.items() if t + n <= width]), b[:, t])
            whole = a[np.arange(rows), length][:, None]
            weight = np.asarray(count, float)[at][:, None]
            for n, e in edges.items():
                ok = e >= 0
                x = a[:, :width - n + 1] + lp[n] + b[:, n:] - whole
                total += np.bincount(e[ok], (np.exp(x) * weight)[ok], len(total))
        return total

    def _steps(self, w: bytes, i: int):
        for j in range(i + 1, min(len(w), i + self.longest) + 1):
            p = self.number.get(w[i:j])
            if p is not None:
                yield j, p

    def _forward(self, w: bytes) -> list[float]:
        a = [_INF] * (len(w) + 1)
        a[0] = 0.0
        for i in range(len(w)):
            for j, p in self._steps(w, i):
                a[j] = float(np.logaddexp(a[j], a[i] + self.log_p[p]))
        return a

    def _expected_long(self, w: bytes, count: float, total: np.ndarray) -> None:
        a, b = self._forward(w), [_INF] * len(w) + [0.0]
        for i in range(len(w) - 1, -1, -1):
            for j, p in self._steps(w, i):
                path = self.log_p[p] + b[j]
                b[i] = float(np.logaddexp(b[i], path))
                total[p] += count * np.exp(a[i] + path - a[-1])


def _keys(block: np.ndarray, longest: int) -> list[np.ndarray | None]:
    """64-bit keys of the substrings of each length at each cell: the bytes
    themselves up to eight, a hash of those beyond."""
    out: list[np.ndarray | None] = [None]
    for n in range(1, longest + 1):
        if n <= 8:
            last = block[:, n - 1:].astype(np.uint64)
            out.append(last if n == 1 else (out[n - 1][:, :-1] << np.uint64(8)) | last)
        else:
            out.append(mix(mix(out[8][:, :block.shape[1] - n + 1], 31) + out[n - 8][:, 8:], 32))
    return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    m = np.stack(terms)
    top = m.max(0)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(m - top).sum(0))


# ----------------------------------------------------------------------- model


@dataclass
class Model:
    pieces: list[bytes]
    log_p: np.ndarray  # natural logs, one per piece
    log_end: float
    counts: DataFrame  # (word, c) of the training words, the end as ""
    tokens: int
    distinct: int


def held_out(doc_id: Column) -> Column:
    """Seventh of the ids that training never sees; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all of ``docs``; the ends of texts are the word "".

    Counted in every task first, so a word that fills the corpus is one row
    of each task.
    """
    def batch(part: dict):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(part), pa.binary()).cast(pa.string()), pa.array(list(part.values()), pa.int64())], names=["word", "c"])

    def count(batches):
        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(words_of(t.as_py()))
                if len(seen) > _COUNTED:
                    yield batch(evicted(seen))
            seen[b""] += b.num_rows
        if seen:
            yield batch(seen)

    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "word string, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, vocabulary: str, text: str = "text", rounds: int = 2, strength: float = 1000.0) -> Model:
    """Piece probabilities from the training rows ``docs``.

    ``rounds`` of expected counts over all distinct words with their counts;
    ``strength`` is the weight of the prior in pieces.  What comes to the driver is
    one number per piece of the vocabulary.  No rows: the prior.
    """
    pieces, prior = load_vocabulary(vocabulary)
    counts = written(word_counts(docs, text), "word-counts")
    tokens, distinct, ends = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0))).first()
    share = 0.01  # the prior's share for the end
    log_p, log_end = np.log(prior * (1 - share)), float(np.log(share))
    for _ in range(rounds if tokens else 0):
        sent = docs.sparkSession.sparkContext.broadcast((pieces, log_p))  # as many numbers as the vocabulary has pieces

        def expect(batches, sent=sent):
            lattice, total = Lattice(*sent.value), np.zeros(len(sent.value[0]))
            for b in batches:
                total += lattice.expected([w.encode() for w in b.column(0).to_pylist()], b.column(1).to_numpy())
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "uses"])

        uses = np.zeros(len(pieces))
        for r in counts.where("word <> ''").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r.piece] = r.uses
        total = uses.sum() + ends + strength
        log_p = np.log((uses + strength * (1 - share) * prior) / total)
        log_end = float(np.log((ends + strength * share) / total))
    return Model(pieces, log_p, log_end, counts, int(tokens), int(distinct))


# --------------------------------------------------------------------- scoring


def _parts(column):
    """(place of the first, words of each) of runs of texts with few words together."""
    first, texts, size = 0, [], 0
    for i, t in enumerate(column):
        texts.append(words_of(t.as_py()))
        size += len(texts[-1])
        if size > _TOGETHER:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


def _with_log_p(words: DataFrame, pieces: list[bytes], log_p: np.ndarray) -> DataFrame:
    """``words`` (.., word string, p double) with the nulls in ``p`` replaced by the word's
    log probability."""
    sent = words.sparkSession.sparkContext.broadcast((pieces, log_p))  # as many numbers as the vocabulary has pieces
    at, to = words.columns.index("word"), words.columns.index("p")

    def run(batches):
        lattice = Lattice(*sent.value)
        for b in batches:
            p = b.column(to).to_numpy(zero_copy_only=False).copy()
            new = np.flatnonzero(~b.column(to).is_valid().to_numpy(zero_copy_only=False))
            p[new] = lattice.log_probability([w.encode() for w in b.column(at).take(pa.array(new)).to_pylist()])
            cols = list(b.columns)
            cols[to] = pa.array(p, pa.float64())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return words.mapInArrow(run, words.schema)


def score_documents(docs: DataFrame, model: Model, text: str = "text", common: int = 100_000, longest: int = 40) -> DataFrame:
    """``docs`` without ``text``, with n_tokens, n_known, train_tokens, base_score and score.

    ``score``: log10 of the text's probability, the sum over all segmentations;
    ``base_score``: log10 under add-one counts of whole words.  Null and empty texts
    are the end alone.  Every training word's lattice is summed once.  The most
    frequent ones, up to ``common`` of at most ``longest`` bytes, are sent to the tasks (a
    bound on their size); the other words of a text meet theirs in a join, where no
    word is frequent, and words that training lacks are summed there.  Columns of ``docs``
    with the names of results give way to the results.
    """
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c.lower() not in (*new, text.lower())]
    src = docs.select(packed(docs, kept), F.monotonically_increasing_id().alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    known = model.counts.select("word", "c", F.lit(None).cast("double").alias("p"))
    known = written(_with_log_p(known.where("word <> ''"), model.pieces, model.log_p), "word-scores")
    short = known.where(F.octet_length("word") <= longest)
    top = {r.word.encode(): (float(np.log10(r.c + 1)), r.p)
           for r in short.where(F.col("c") >= least_count(short, "c", common)).collect()}  # common x longest bytes
    end = model.counts.where("word = ''").select("c").first()
    end = end.c if end else 0
    sent = docs.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        base = {w: b for w, (b, _) in sent.value.items()}
        score = {w: p for w, (_, p) in sent.value.items()}
        for b in batches:
            for first, texts in _parts(b.column(2)):
                n, hit, known_base, known_score, rest, times = [], [], [], [], [], []
                for t in texts:
                    hits = [v for v in map(base.get, t) if v is not None]
                    n.append(len(t) + 1)
                    hit.append(len(hits))
                    known_base.append(sum(hits))
                    other = Counter(w for w in t if w not in base) if len(hits) < len(t) else {}
                    known_score.append(sum(v for v in map(score.get, t) if v is not None))
                    rest.append([w.decode() for w in other])
                    times.append(list(other.values()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), pa.array(n, pa.int64()),
                     pa.array(hit, pa.int64()), pa.array(known_base, pa.float64()), pa.array(known_score, pa.float64()),
                     pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                    names=["_in", "row", "n", "known", "base", "score", "rest", "times"])

    schema = T.StructType([src.schema["_in"], *T.StructType.fromDDL(
        "row long, n long, known long, base double, score double, rest array<string>, times array<long>").fields])
    scored = written(src.mapInArrow(run, schema), "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row", "r.rest", "r.times")
    met = (rest.join(known, F.struct("rest") == F.struct("word"), "left")  # dealt anew, so AQE can split a hot word
           .select("row", F.col("rest").alias("word"), "times", "c", "p"))
    c = F.coalesce("c", F.lit(0))
    found = (_with_log_p(met, model.pieces, model.log_p).groupBy("row")
             .agg(F.sum(F.when(c > 0, F.col("times"))).alias("more"), F.sum(F.col("times") * F.log10(c + 1)).alias("more_base"),
                  F.sum(F.col("times") * F.col("p")).alias("more_score")))
    scale = float(np.log10(model.tokens + model.distinct + 1))
    zero = F.lit(0.0)
    return scored.join(found, "row", "left").select(
        *unpacked(kept), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(1 if end else 0)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) + F.lit(float(np.log10(end + 1))) - F.col("n") * F.lit(scale)).alias("base_score"),
        ((F.col("score") + F.coalesce("more_score", zero) + F.lit(model.log_end)) / F.lit(float(np.log(10)))).alias("score"))
