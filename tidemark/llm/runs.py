"""Periodic runs by online dyadic square catching.

Words are appended; whenever a block of L = 2^k words is complete, a catcher
starts for it: it looks for the block's words again while the next 2L words are
appended.  Found again q words on, they are part of a square of period q, which
suffix comparisons extend to the left, and every appended word to the right, as
long as words q apart are identical.  Squares of one period that touch
merge into one run.  A run of period q and at least three periods holds a whole
aligned block of the level of q twice, so none escapes its catchers.

All catchers of a level advance together, one numpy comparison of window
hashes for a piece of appended words, so n words take time n log n.  Hits are
confirmed word by word on exact word numbers.  Hits inside a run of a smaller
period that can't start or end a longer run are dropped by its ends alone, so
long stretches of one word cost no more than others.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import mix, packed, unpacked

_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Words of short texts appended together, and the least piece of a long one.
_PIECE = 1 << 18


def _right(ids: np.ndarray, x: int, q: int, end: int) -> int:
    """First place from ``x`` on whose word differs from that ``q`` later."""
    step = 64
    while x + q < end:
        k = min(step, end - q - x)
        differ = ids[x:x + k] != ids[x + q:x + q + k]
        j = int(differ.argmax())
        if differ[j]:
            return x + j
        x, step = x + k, min(step * 2, 1 << 20)
    return x


def _left(ids: np.ndarray, x: int, q: int) -> int:
    """Least place from which all words up to ``x`` equal those ``q`` later."""
    step = 64
    while x > 0:
        k = min(step, x)
        differ = (ids[x - k:x] != ids[x - k + q:x + q])[::-1]
        j = int(differ.argmax())
        if differ[j]:
            return x - j
        x, step = x - k, min(step * 2, 1 << 20)
    return 0


@dataclass
class Catchers:
    """Online run finder over word numbers; ``append`` any number of words at a time.

    ``min_length``: least words of a run; ``periods``: least periods (3 at least).
    """

    min_length: int = 24
    periods: int = 3
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: int = 0
    closed: dict = field(default_factory=dict)  # (start, end) -> least period
    open: dict = field(default_factory=dict)  # period -> start of the square growing at the end
    _spans: dict = field(default_factory=lambda: defaultdict(lambda: (0, -1)))  # period -> last stretch

    def __post_init__(self):
        if self.periods < 3 or self.min_length < 1:
            raise ValueError("a run has three periods and one word at least")
        # the first level serves all periods whose least stretch holds one of its blocks
        self.first = 1
        while all(max(self.min_length - q, 2 * q) >= 4 * self.first - 1 for q in range(1, 4 * self.first)):
            self.first *= 2

    def _enough(self, start: int, end: int, q: int) -> bool:
        return end - start >= max(self.min_length, self.periods * q)

    def _close(self, start: int, end: int, q: int) -> None:
        if self._enough(start, end, q):
            self.closed[start, end] = min(q, self.closed.get((start, end), q))

    def append(self, words: np.ndarray, longest: int | None = None) -> None:
        """``words``: their numbers; ``longest``: most words one text of the stream has."""
        old, new = self.size, self.size + len(words)
        if new > len(self.ids):
            self.ids = np.concatenate((self.ids[:old], words, np.zeros(old, np.int64)))  # room to grow by as much again
        else:
            self.ids[old:new] = words
        self.size = new
        ids = self.ids[:new]
        for q, start in list(self.open.items()):  # appended words extend the open squares
            x = _right(ids, max(start, old - q), q, new)
            if x + q < new:
                del self.open[q]
                self._close(start, x + q, q)
            self._spans[q] = (start, x)
        top, level = self.first, self.first
        while 2 * top * self.periods <= min(longest or new, new):
            top *= 2
        base = max(0, (old - 3 * top) // top * top)
        h = mix(ids[base:new].astype(np.uint64), 41)
        size = 1
        while size < level:
            h, size = mix(h[:-size] * _ODD + h[size:], 42), 2 * size
        while level <= top and len(h) > 0:
            self._catch(level, h, base, old, new)
            h, level = mix(h[:-level] * _ODD + h[level:], 42) if len(h) > level else h[:0], 2 * level

    def _catch(self, level: int, h: np.ndarray, base: int, old: int, new: int) -> None:
        """Catchers of one level against the windows that end in [old, new)."""
        lo = max(base + 1, old - level + 1)  # first window that ends beyond old
        hi = new - level + 1
        if hi <= lo:
            return
        if level > self.first:
            blocks = np.arange(max(base, (lo // level - 1) * level), hi, level)
            b0 = int(blocks[0])
            start = max(lo, b0 + level)
            if start >= hi:
                return
            want = np.repeat(h[blocks - base], level)  # window y meets the block before its own
            places = np.flatnonzero(h[start - base:hi - base] == want[start - level - b0:hi - level - b0]) + start
            block = (places // level - 1) * level
        else:
            found = []
            for q in range(1, 2 * level):
                first = max(0, -(-max(lo - q, base) // level) * level)
                at = np.arange(first, hi - q, level)
                at = at[h[at - base] == h[at + q - base]]
                found.append((at, at + q))
            block = np.concatenate([a for a, _ in found])
            places = np.concatenate([b for _, b in found])
        if len(places):
            self._squares(level, block, places - block, new)

    def _squares(self, level: int, block: np.ndarray, q: np.ndarray, new: int) -> None:
        ids = self.ids[:new]
        order = np.lexsort((block, q))
        block, q = block[order], q[order]
        at = 0
        while at < len(block):
            # runs found so far change what is left to look at, period by period on the first level
            stop = int(np.searchsorted(q, q[at], side="right")) if level == self.first else len(q)
            keep = self._telling(level, block[at:stop], q[at:stop], new)
            for b, p in zip(block[at:stop][keep].tolist(), q[at:stop][keep].tolist()):
                start, end = self._spans[p]
                if start <= b < end:
                    continue  # merged into the square of the block before
                x = _right(ids, b, p, new)
                if x < b + level:
                    continue  # equal hashes of unequal words
                s = _left(ids, b, p)
                self._spans[p] = (s, x)
                if x + p == new:
                    self.open[p] = s
                else:
                    self._close(s, x + p, p)
            at = stop

    def _telling(self, level: int, block: np.ndarray, q: np.ndarray, new: int) -> np.ndarray:
        """False for hits that lie in runs of a smaller period and can't make a run.

        A block inside a run R of period d <= level / 2 comes again only in runs of
        that period.  In R itself the period is a multiple of d.  In another one,
        R2, the square ends with the sooner end of either, too short for a run,
        unless q brings their starts or their ends together.
        """
        runs = [(s, e, e) for (s, e), d in self.closed.items() if 2 * d <= level <= e - s]
        runs += [(s, new, new + 1) for d, s in self.open.items() if 2 * d <= level <= new - s and self._enough(s, new, d)]
        if not runs:
            return np.ones(len(block), bool)
        start, end, true_end = np.array(sorted(runs)).T

        def inside(x):
            i = np.searchsorted(start, x, side="right") - 1
            return np.where((i >= 0) & (end[i] >= x + level), i, -1)

        r, r2 = inside(block), inside(block + q)
        both = (r >= 0) & (r2 >= 0)
        aligned = (start[r] + q == start[r2]) | (end[r] + q == true_end[r2]) | ((true_end[r2] > new) & (end[r] + q >= new))
        return ~both | ((r != r2) & aligned)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, smallest period) of all runs, by start, then period."""
        out = dict(self.closed)
        for q, s in self.open.items():
            if self._enough(s, self.size, q):
                out[s, self.size] = min(q, out.get((s, self.size), q))
        return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list], min_length: int = 24, periods: int = 3, piece: int = _PIECE) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words.

    Short texts go through one stream, parted by numbers of their own; the words
    of a longer one than ``piece`` are appended piece by piece.
    """
    out: list[list] = [[] for _ in texts]
    group: list[int] = []

    def flush():
        if not group:
            return
        number: defaultdict = defaultdict(itertools.count().__next__)
        parts, first, at = [], [], 0
        for k, i in enumerate(group):
            words = np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i]))
            parts += [words, np.array([-1 - k], np.int64)]
            first.append(at)
            at += len(words) + 1
        longest = max(len(texts[i]) for i in group)
        stream, c, done = np.concatenate(parts), Catchers(min_length, periods), 0
        while done < len(stream):
            step = max(piece, done)
            c.append(stream[done:done + step], longest)
            done += step
        for s, e, q in c.runs():
            k = int(np.searchsorted(first, s, side="right")) - 1
            out[group[k]].append((s - first[k], e - s, q))
        group.clear()

    waiting = 0
    for i, words in enumerate(texts):
        if len(words) < min_length:
            continue
        if waiting + len(words) > piece:
            flush()
            waiting = 0
        group.append(i)
        waiting += len(words)
    flush()
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period, the first of equals."""
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q or (n * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = s, n, q
    return best


def looped(words: list, h: int) -> list:
    """For a tenth of the numbers ``h`` the words, repeating from a place on.

    With g = h div 10: from word g mod n on, the words repeat with the period
    1 + (words left) div (3 + g mod 8).  Used to plant runs in texts.
    """
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def planted(doc_id: Column) -> Column:
    """The number ``looped`` takes: crc32 of the id as text (null as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def find_runs(docs: DataFrame, text: str = "text", min_length: int = 24, periods: int = 3, plant: Column | None = None) -> DataFrame:
    """``docs`` without ``text``, with the runs of its words and the text without repeats.

    Words are runs of other than 0x20, 0x09-0x0D, numbered from 0.  A run is a
    stretch with smallest period q (words q apart are identical) of at least
    max(``min_length``, ``periods`` * q) words that can't be longer either way.
    ``runs``: array of (start, length, period) by start, then period; ``n_words``,
    ``n_runs``; start, length, period and exponent_milli (floor of 1000 length /
    period) of the run of greatest length / period, nulls without a run;
    ``collapsed_text``: the words outside of runs and the first q of each, joined by
    one space.  Null and empty texts have no words, no runs and an empty text.
    ``plant``: a number per row; ``looped`` is applied first.  One pass over the rows,
    no shuffle.  Columns with the names of results give way to the results.
    """
    new = ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed_text")
    kept = [c for c in docs.columns if c.lower() not in (*new, text.lower())]
    src = docs.select(packed(docs, kept), F.col(f"`{text}`").cast("string").alias("_text"),
                      (plant if plant is not None else F.lit(None)).cast("long").alias("_plant"))

    def run(batches):
        for b in batches:
            texts = [(t.as_py() or "").encode().split() for t in b.column(1)]
            texts = [w if h is None else looped(w, h) for w, h in zip(texts, b.column(2).to_pylist())]
            found = runs_of_texts(texts, min_length, periods)
            collapsed, best = [], [strongest(r) for r in found]
            for words, runs in zip(texts, found):
                if runs:
                    depth = np.zeros(len(words) + 1, np.int64)
                    for s, n, q in runs:
                        depth[s + q] += 1
                        depth[s + n] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
                collapsed.append(b" ".join(words).decode())
            cols = [[len(w) for w in texts], [len(r) for r in found]]
            cols += [[x and x[i] for x in best] if i else [None if x is None else x[0] for x in best] for i in range(3)]
            cols.append([None if x is None else 1000 * x[1] // x[2] for x in best])
            item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found], pa.list_(item))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in cols], runs, pa.array(collapsed, pa.string())], names=["_in", *new])

    schema = T.StructType([src.schema["_in"], *T.StructType.fromDDL(
        ", ".join(f"{c} long" for c in new[:6]) + ", runs array<struct<start: long, length: long, period: long>>, collapsed_text string").fields])
    return src.mapInArrow(run, schema).select(*unpacked(kept), *new)
