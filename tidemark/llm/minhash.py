"""Near-duplicate texts by SetSketch registers, banding, likelihood, verification.

A document's set is its distinct word shingles.  Its sketch holds ``M``
registers: register i is the least of one exponential value per shingle,
kept as the exponent K = floor(1 - log_B(value)), truncated to a byte pair.
The union of two sets has the register-wise maximum (``merge``), and two
registers agree with a probability close to the Jaccard similarity.

Steps, none of which holds a group in one place or lists all pairs of one:

1. Documents with one set form a class (128-bit digest of the set); only
   classes go on, so exact copies cost one row.
2. Each class gives ``M / ROWS`` band keys.  In each bucket the member with the
   least id is the hub; a member's distinct hubs are ranked by the
   joint likelihood estimate of the Jaccard similarity from both sketches, and
   the best one is verified on the full sets.  Verified links give first
   components.
3. Buckets that still hold several components are compared completely, in
   blocks of at most ``BLOCK`` x ``BLOCK`` members: exact intersections over bit
   sets, of which only links that join components leave the task.

With 32 bands of 4 registers a pair at similarity 0.8 shares no bucket with
probability (1 - 0.8^4)^32 = 5e-8.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import components, lower_ascii, mix, signed, text_key, window_hashes, word_hashes, word_spans, written

M, ROWS = 128, 4
B, A, Q = 1.02, 20.0, 4094
#: Members of a bucket compared with each other in one task.
BLOCK = 512
_ODD1, _ODD2 = 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25
_ID = "decimal(38,0)"


def shingle_sets(text: str | None, words: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text (A-Z lower-cased)."""
    data = lower_ascii(np.frombuffer((text or "").encode(), np.uint8))
    s, e = word_spans(data)
    if not len(s):
        return np.zeros(0, np.uint64)
    h = word_hashes(data, s, e)
    n = min(words, len(h))
    # the number of words goes in: a short text's sequence is no part of a longer one's
    return np.unique(mix(window_hashes(h, n, _ODD1) ^ np.uint64(n << 57)))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of many sets at once, one row of ``M`` per set; empty sets give 0.

    Register values of one shingle arrive as a Poisson process of rate ``M`` with
    random register marks, which is ``M`` independent exponentials; arrivals
    above the bound under which every register is filled don't matter.
    """
    k = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    least = np.full(k * M, np.inf)
    todo = np.flatnonzero(n)
    slack = 12.0
    while len(todo):
        least.reshape(k, M)[todo] = np.inf
        doc = np.repeat(todo, n[todo])
        key = np.concatenate([sets[i] for i in todo])
        bound = ((np.log(M) + slack) / n)[doc] if k else None
        value = np.zeros(len(key))
        step = 0
        while len(key):
            u = (mix(key, 2 * step + 101) >> np.uint64(11)).astype(np.float64)
            value = value - np.log((u + 0.5) * 2.0**-53) / M
            ok = value < bound
            doc, key, bound, value = doc[ok], key[ok], bound[ok], value[ok]
            reg = (mix(key, 2 * step + 102) % np.uint64(M)).astype(np.int64)
            np.minimum.at(least, doc * M + reg, value)
            step += 1
        todo = todo[np.isinf(least.reshape(k, M)[todo]).any(axis=1)]  # about one set in 200,000
        slack *= 2
    with np.errstate(divide="ignore"):
        reg = np.floor(1 - np.log(least / A) / np.log(B))
    return np.where(np.isinf(least), 0, np.clip(reg, 0, Q + 1)).astype(np.uint16).reshape(k, M)


def merge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(x, y)


def likelihood_jaccard(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch rows: the likelihood's maximum given how many
    registers are greater, less and equal, and the sets' sizes.

    With u = nx / (nx + ny) a register of x is the greater with probability
    p(u - v J), p(z) = -log_B(1 - z (B - 1) / B); the log-likelihood is concave in
    J, so a grid followed by its best cell is enough for ranking and filtering.
    """
    over, under = (x > y).sum(1), (x < y).sum(1)
    same = x.shape[1] - over - under
    u = nx / (nx + ny)
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)[:, None]

    def p(z):
        return -np.log1p(-np.clip(z, 1e-12, None) * (B - 1) / B) / np.log(B)

    pu, pv = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    p0 = np.clip(1 - pu - pv, 1e-12, 1)
    return j[np.arange(len(j)), (over[:, None] * np.log(pu) + under[:, None] * np.log(pv) + same[:, None] * np.log(p0)).argmax(1)]


def _bands(reg: np.ndarray) -> np.ndarray:
    """(k, M / ROWS) band keys: four 16-bit registers are one 64-bit key."""
    return np.ascontiguousarray(reg).view(np.int64)


def _registers(bands: pd.Series) -> np.ndarray:
    return np.ascontiguousarray(np.stack(bands.to_numpy())).view(np.uint16)


def _linked(n_common, n_a, n_b, percent: int):
    return 100 * n_common >= percent * (n_a + n_b - n_common)


# ------------------------------------------------------------------- steps


def document_sets(docs: DataFrame, text: str, words: int) -> tuple[DataFrame, list[str]]:
    """Rows of ``docs`` (without ``text``) with cls, n, key and bands."""
    kept = [c for c in docs.columns if c != text]
    src = docs.select(*[docs[f"`{c}`"] for c in kept], text_key(text).alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))

    def sketch(batches):
        for big in batches:
            for lo in range(0, big.num_rows, 256):  # bounds the shingles held at once
                b = big.slice(lo, 256)
                sets = [shingle_sets(t.as_py(), words) for t in b.column(b.num_columns - 1)]
                cls = [Decimal(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=16).digest()) >> 3) if len(s) else None
                       for s in sets]
                bands = _bands(sketches(sets))
                flat = pa.array(bands.ravel())
                offsets = pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], pa.array(cls, pa.decimal128(38, 0)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.ListArray.from_arrays(offsets, flat)], names=[*kept, "_key", "_cls", "_n", "_bands"])

    schema = (src.drop("_text").schema.add("_cls", T.DecimalType(38, 0)).add("_n", "long")
              .add("_bands", T.ArrayType(T.LongType())))
    return src.mapInArrow(sketch, schema), kept


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int, sigmas: float = 6.0) -> DataFrame:
    """(a, b) pairs -> those whose estimate isn't far below the threshold, with ``est``.
    A pair that reaches the threshold is lost with probability 1e-9."""
    t = percent / 100
    floor = t - sigmas * (t * (1 - t) / M) ** 0.5
    ca = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bands").alias("ba"))
    cb = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("bb"))
    j = pairs.join(ca, "a").join(cb, "b").where(
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))

    def estimate(pdfs):
        for p in pdfs:
            if len(p):
                est = likelihood_jaccard(_registers(p["ba"]), _registers(p["bb"]), p["na"].to_numpy(float), p["nb"].to_numpy(float))
                yield pd.DataFrame({"a": p["a"], "b": p["b"], "est": est})

    return j.mapInPandas(estimate, f"a {_ID}, b {_ID}, est double").where(F.col("est") >= floor)


def _sets_of(docs: DataFrame, text: str, classes: DataFrame, words: int) -> DataFrame:
    """(cls, set) of the classes, from one text of each."""
    want = classes.select(F.col("key").alias("_key"), "cls")
    src = (docs.select(text_key(text).alias("_key"), F.col(f"`{text}`").alias("_text"))
           .join(want, "_key").select("cls", "_text"))

    def expand(batches):
        seen = set()
        for b in batches:
            cls, sets = [], []
            for c, t in zip(b.column(0).to_pylist(), b.column(1)):
                if c not in seen:
                    seen.add(c)
                    cls.append(c)
                    sets.append(pa.array(signed(shingle_sets(t.as_py(), words))))
            if cls:
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls, pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(sets))],
                    names=["cls", "set"])

    return src.mapInArrow(expand, f"cls {_ID}, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs whose full sets reach the threshold."""
    sa, sb = sets.select(F.col("cls").alias("a"), F.col("set").alias("sa")), sets.select(F.col("cls").alias("b"), F.col("set").alias("sb"))
    j = pairs.join(sa, "a").join(sb, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return j.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def _block_links(percent: int):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Exact links between the two sides of a block that join components; a forest of them."""
        none = pd.DataFrame({"a": [], "b": []}, dtype=object)
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.drop_duplicates("cls")
        left = pdf[pdf["chunk"] == i]
        right = left if i == j else pdf[pdf["chunk"] == j]
        if not len(left) or not len(right) or pdf["comp"].nunique() < 2:
            return none
        sets = list(left["set"]) + ([] if i == j else list(right["set"]))
        flat = np.concatenate([np.asarray(s, np.int64) for s in sets])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[code] > 1  # what only one member has is in no intersection
        code, owner = code[shared], owner[shared]
        _, code = np.unique(code, return_inverse=True)
        width = (int(code.max()) // 64 + 1) if len(code) else 1
        bits = np.zeros((len(sets), width), np.uint64)
        np.bitwise_or.at(bits, (owner, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
        lb, rb = bits[:len(left)], bits if i == j else bits[len(left):]
        ln, rn = left["n"].to_numpy(), right["n"].to_numpy()
        lc, rc = left["comp"].to_numpy(), right["comp"].to_numpy()
        names = {c: c for c in pdf["comp"]}

        def root(c):
            while names[c] != c:
                names[c] = c = names[names[c]]
            return c

        out = []
        lcls, rcls = left["cls"].to_numpy(), right["cls"].to_numpy()
        for x in range(len(left)):
            lo, hi = np.minimum(ln[x], rn), np.maximum(ln[x], rn)
            near = np.flatnonzero((100 * lo >= percent * hi) & (rc != lc[x]))
            if not len(near):
                continue
            both = np.bitwise_count(rb[near] & lb[x]).sum(1, dtype=np.int64)
            for y in near[_linked(both, ln[x], rn[near], percent)]:
                p, q = root(lc[x]), root(rc[y])
                if p != q:
                    names[max(p, q)] = min(p, q)
                    out.append((lcls[x], rcls[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object) if out else none
    return compare


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 4,
                    percent: int = 80) -> DataFrame:
    """(``doc_id``, n_shingles, component_id, kept), one row per row of ``docs``.

    Two documents link where 100 * intersection >= percent * union of their
    shingle sets; component_id is the least id reachable.  Texts of fewer than
    ``words`` words have one shingle, null and empty ones none and no links.
    Rows with a null id take part; their component_id is that of the others (null
    if all ids are), and they aren't kept beside an id.  Rows of one id
    with different texts are judged each by its text.  Other columns are ignored.
    """
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows, _ = document_sets(src, "text", words)
    rows = written(rows, "sets")
    classes = written(rows.where("_n > 0").groupBy(F.col("_cls").alias("cls")).agg(
        F.first("_n").alias("n"), F.min("_key").alias("key"), F.first("_bands").alias("bands"),
        F.min("doc_id").alias("least_id")), "classes")
    band = classes.select("cls", "n", F.posexplode("bands").alias("band", "bucket"))
    hubs = (band.groupBy("band", "bucket").agg(F.count("*").alias("members"), F.min("cls").alias("hub"))
            .where("members > 1"))
    # joined on the struct, so both sides are dealt anew and AQE can split a hot bucket
    hubs = hubs.select(F.struct("band", "bucket").alias("at"), "hub")
    placed = written(band.withColumn("at", F.struct("band", "bucket")).join(hubs, "at")
                     .select("at", "cls", "n", "hub"), "buckets")
    stars = placed.where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()
    best = (_estimated(stars, classes, percent).groupBy("a")
            .agg(F.max(F.struct("est", "b")).alias("top")).select("a", F.col("top.b").alias("b")))
    in_buckets = placed.select("cls").distinct()
    sets = written(_sets_of(src, "text", classes.join(in_buckets, "cls", "left_semi"), words), "full-sets")
    first = written(_verified(best, sets, percent), "links")
    comp = components(first, "near")
    member = placed.select("at", "cls", "n").join(comp, F.col("cls") == F.col("node"), "left").select(
        "at", "cls", "n", F.coalesce("root", "cls").alias("comp"))
    rest = _open_buckets(member)
    second = written(_compare_open(rest, sets, percent), "links-rest")
    comp = components(first.unionByName(second), "near")
    lookup = classes.join(comp, F.col("cls") == F.col("node"), "left").select(
        "cls", F.coalesce("root", "cls").alias("comp"), "least_id")
    ids = lookup.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    by_class = lookup.join(ids, "comp").select(F.col("cls").alias("_cls"), "component_id")
    out = rows.join(by_class, "_cls", "left")
    component = F.when(F.col("_n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("_n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _open_buckets(member: DataFrame) -> DataFrame:
    """Members of buckets with several components, each set of members once."""
    h = F.xxhash64(F.col("cls").cast("string"))
    stats = (member.groupBy("at").agg(
        F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).where("lo <> hi"))
    once = stats.groupBy("members", "x", "s").agg(F.min("at").alias("at"))  # bands that agree on the members
    once = once.select(F.struct("at").alias("k"), F.ceil(F.col("members") / BLOCK).cast("int").alias("chunks"))
    return written(member.withColumn("k", F.struct("at")).join(once, "k").select("at", "cls", "n", "comp", "chunks"), "open")


def _compare_open(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components in open buckets, in blocks of (chunk i, chunk j)."""
    d = rest.withColumn("chunk", F.pmod(F.xxhash64(F.col("cls").cast("string")), F.col("chunks")).cast("int"))
    d = d.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
        F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j")))))
    d = d.select("at", "pair.i", "pair.j", "cls", "n", "comp", "chunk").join(sets, "cls")
    return (d.groupBy("at", "i", "j").applyInPandas(_block_links(percent), f"a {_ID}, b {_ID}")
            .distinct())
