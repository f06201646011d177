"""Shared pieces: written tables, word hashes, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own switch: an SQL execution's shuffle files go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The word pattern of the contracts, for JVM regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Unset, a folder is made and set in local mode only (as in tests); on a
    cluster this raises, since a machine-local folder would lose rows.
    """
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    with contextlib.suppress(Exception):  # a Spark without that switch
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with contextlib.suppress(Exception):
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage: an executor lost later costs nothing of what is written
    here.  The shuffle files of the write go with its end, so the disk in use
    is one step's, not the sum of all steps.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, kept: list[str]) -> Column:
    """The columns to hand through, as one struct ``_in``: whatever they are called,
    they clash with no working column."""
    return F.struct(*([F.col(f"`{c}`") for c in kept] or [F.lit(None).cast("int").alias("none")])).alias("_in")


def unpacked(kept: list[str]) -> list[Column]:
    return [F.col("_in").getField(c).alias(c) for c in kept]


def text_key(col: str = "text"):
    """128-bit digest of a text, null as empty: texts that are equal share it."""
    return F.unhex(F.md5(F.coalesce(F.col(col), F.lit(""))))


def evicted(seen: Counter) -> dict:
    """What a task's full counter gives out to make room: the keys met once, or all
    where those are less than half; frequent keys stay and are given out once."""
    rare = [k for k, n in seen.items() if n == 1]
    out = dict.fromkeys(rare, 1) if 2 * len(rare) >= len(seen) else dict(seen)
    for k in out:
        del seen[k]
    return out


def least_count(counts: DataFrame, col: str, most: int) -> int:
    """A count that at most ``most`` rows of ``counts`` reach, so that those rows may be
    collected: of a histogram of a sixteenth of a binary order a bin, whose few
    rows are all that comes to the driver, whatever the number of rows or tasks."""
    bins = counts.groupBy(F.floor(F.log2(col) * 16).alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("least")).collect()
    total, least = 0, 1 << 62
    for r in sorted(bins, key=lambda r: -r.least):
        total += r.n
        if total > most:
            break
        least = r.least
    return least


# ---------------------------------------------------------------- word hashes

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15
_64 = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x + np.uint64(_GOLD * (2 * seed + 1) & _64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: True for the bytes that separate words: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last byte of every word in a byte array."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~separators[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: sum of (byte + 1) times a random odd number
    of its place in the word, finalised together with the word's length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    place = at - np.repeat(starts, length)
    odd = mix(np.arange(int(length.max()), dtype=np.uint64), 11) | np.uint64(1)
    value = (data[at].astype(np.uint64) + np.uint64(1)) * odd[place]
    sums = np.add.reduceat(value, np.concatenate(([0], np.cumsum(length)[:-1])))
    return mix(sums ^ (length.astype(np.uint64) << np.uint64(48)), 12)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return _LOWER[data]


def window_hashes(words: np.ndarray, length: int, odd: int) -> np.ndarray:
    """Hash of every ``length`` consecutive words, by doubling: a window of 2n
    is two windows of n; odd lengths join the windows of their binary digits."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size = odd | 1, 1
    block, out, done = words, None, 0
    rest, factor = length, 1
    while rest:
        if rest & 1:
            part = block[done:done + n]
            part = part * np.uint64(factor)
            out = part if out is None else out + part
            done += size
            factor = factor * power & _64
        rest >>= 1
        if rest:
            block = block[:-size] + block[size:] * np.uint64(power)
            power, size = power * power & _64, size * 2
    return mix(out, 13)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ------------------------------------------------------- connected components


def components(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b) the least node it reaches.

    Alternating large-star and small-star rounds, each a grouped minimum
    with map-side partial aggregation and a join that AQE can split; hubs of
    any degree cost no more than their edges.  Rounds end when the edges stop
    changing; every round is a written table, so a lost executor repeats one
    round at most.  Node ids may be of any orderable type without nulls.
    """
    def least(e: DataFrame, key: str, other: str) -> DataFrame:
        return e.groupBy(F.col(key).alias("n")).agg(F.min(other).alias("m"))

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    cur = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    last = None
    for _ in range(most):
        two = both(cur)
        m = least(two, "a", "b").select("n", F.least("n", "m").alias("m"))
        # large star: every larger neighbour v of u to the least of u's neighbourhood
        large = (two.where("b > a").join(m, F.col("a") == F.col("n"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: u and its smaller neighbours to their least
        m2 = least(large, "a", "b")
        joined = large.join(m2, F.col("a") == F.col("n"))
        small = (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(m2.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        cur = written(small, f"{name}-round")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
