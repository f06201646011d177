"""Substring dedup by level-wise doubling.

A window of 2n words can only repeat where both its halves do, so short
windows are judged first and only what repeats at one length is looked at
again at twice that length (9, 18, 35 words by default, the last level cut to
the window asked for), until the last level or until no candidate is left.

Short windows are sampled without loss: a 35-word window is represented by
the least-hashed 9-word window inside it.  Equal windows have equal
representatives at equal places, so a window that repeats is never pruned,
and only one place in about fourteen is shuffled at the first level.  At the
last level the window is its own representative (128-bit hash), so the result
is that of comparing all windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, signed, text_key, unpacked, window_hashes, word_hashes, word_spans, written

_ODD1, _ODD2 = 0x5851F42D4C957F2D, 0xD1342543DE82EF95
#: Windows judged in one go; a longer text is walked in pieces.
_PIECE = 1 << 22


def levels_for(window: int, base: int = 9) -> list[int]:
    """Doubling lengths up to the window: 9, 18, 35 for 35."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` consecutive keys, by doubling."""
    size, out = 1, keys
    while 2 * size <= span:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < span:
        out = np.minimum(out[:len(out) - (span - size)], out[span - size:])
    return out


def anchors(words: np.ndarray, level: int, window: int) -> np.ndarray:
    """For each window of the text the place of its representative of ``level`` words."""
    starts = len(words) - window + 1
    if level == window:
        return np.arange(starts)
    out = np.empty(starts, np.int64)
    for lo in range(0, starts, _PIECE):
        part = words[lo:min(starts, lo + _PIECE) + window - 1]
        h = window_hashes(part, level, _ODD1)
        place = np.arange(len(h), dtype=np.uint64)
        low = np.uint64((1 << 23) - 1)  # _PIECE + window places fit in 23 bits
        least = _least((h & ~low) | place, window - level + 1)
        out[lo:lo + len(least)] = (least & low).astype(np.int64) + lo
    return out


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    s, e = word_spans(data)
    return data, s, e


def _candidates(docs: DataFrame, level: int, window: int, alive: DataFrame | None, before: int) -> DataFrame:
    """(h1, h2, key, place): the windows of ``level`` words to be counted.

    ``docs``: (key, text).  ``alive``: (key, places) that repeat at the level
    ``before``.  A text met again in the task is given twice at most: two
    make a repeat as well as a thousand do.
    """
    pruned = alive is not None

    def emit(batches):
        times: dict[bytes, int] = {}
        for b in batches:
            h1, h2, keys, places = [], [], [], []
            cols = b.to_pydict()
            for i, (k, t) in enumerate(zip(cols["key"], cols["text"])):
                n = times.get(k, 0)
                if not t or n >= 2:
                    continue
                times[k] = n + 1
                data, s, e = _words(t)
                if len(s) < window:
                    continue
                w = word_hashes(data, s, e)
                at = anchors(w, level, window)
                if pruned:
                    old = at if before == level else anchors(w, before, window)
                    ok = np.zeros(len(w), bool)
                    ok[np.asarray(cols["places"][i], np.int64)] = True
                    at = at[ok[old]]
                at = np.unique(at)
                h1.append(window_hashes(w, level, _ODD1)[at])
                h2.append(window_hashes(w, level, _ODD2)[at] if level == window else np.zeros(len(at), np.uint64))
                places.append(at.astype(np.int32))
                keys.append(pa.array([k], pa.binary()).take(pa.array(np.zeros(len(at), np.int32))))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(h1))), pa.array(signed(np.concatenate(h2))),
                     pa.concat_arrays(keys), pa.array(np.concatenate(places))],
                    names=["h1", "h2", "key", "place"])

    src = docs.select("key", "text") if not pruned else docs.join(alive, "key").select("key", "text", "places")
    return src.mapInArrow(emit, "h1 long, h2 long, key binary, place int")


def _repeating(rows: DataFrame) -> DataFrame:
    """(key, places) of the rows whose window is there more than once."""
    many = rows.groupBy("h1", "h2").count().where("count > 1").select(F.struct("h1", "h2").alias("w"))
    # joined on the struct, so both sides are dealt anew and AQE can split a hot window
    return (rows.withColumn("w", F.struct("h1", "h2")).join(many, "w", "left_semi")
            .groupBy("key").agg(F.collect_set("place").alias("places")))


def repeated_places(docs: DataFrame, window: int, base: int = 9) -> DataFrame:
    """(key, places) of the windows of (key, text) rows that start elsewhere too."""
    alive, before = None, 0
    for level in levels_for(window, base):
        rows = written(_candidates(docs, level, window, alive, before), f"windows-{level}")
        alive, before = written(_repeating(rows), f"repeats-{level}"), level
        if alive.isEmpty():
            break
    return alive


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35, base: int = 9) -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``n_removed`` and ``kept_text``.

    Words are runs of other than 0x20, 0x09-0x0D.  Every word covered by a
    window of ``window`` words that starts anywhere else too, same document
    included, goes; ``kept_text`` joins the others by one space.  Windows are
    judged on the input.  Null and empty texts have no words and an empty
    ``kept_text``.  Rows need no unique id: texts are told apart by a 128-bit
    digest, and equal texts of at least ``window`` words remove each other.
    Columns of ``docs`` with the names of results give way to the results.
    """
    new = ("n_words", "n_removed", "kept_text")
    kept = [c for c in docs.columns if c.lower() not in (*new, text.lower())]
    keyed = docs.select(text_key(text).alias("key"), F.col(text).cast("string").alias("text"))
    alive = repeated_places(keyed, window, base)
    src = (docs.select(packed(docs, kept), text_key(text).alias("_key"), F.col(text).cast("string").alias("_text"))
           .join(alive.select(F.col("key").alias("_key"), F.col("places").alias("_places")), "_key", "left")
           .select("_in", "_text", "_places"))

    def cut(batches):
        for b in batches:
            n_words, n_removed, out = [], [], []
            for t, places in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1)):
                raw = (t.as_py() or "").encode()
                words = raw.split()  # bytes split at exactly 0x20, 0x09-0x0D
                n = len(words)
                places = places.values.to_numpy(zero_copy_only=False) if places.is_valid else ()
                if len(places):
                    depth = np.zeros(n + 1, np.int64)
                    depth[places] += 1
                    np.subtract.at(depth, np.asarray(places) + window, 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
                n_words.append(n)
                n_removed.append(n - len(words))
                out.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(out, pa.string())], names=["_in", *new])

    schema = src.drop("_text", "_places").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return src.mapInArrow(cut, schema).select(*unpacked(kept), *new)
