"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c are within squared distance 2 (1 - c).  After a
rotation the distance is the sum over low-dimensional blocks, so a linked pair
is within its proportional budget (the block's share of the dimensions) in
at least one block.  Every block is range-joined on its own: two sets of rows
are halved in turn at their widest coordinate, and each time the rows of either
that are beyond the budget from the other's bounding box leave, so whole
quarters of the pairs are never compared (``range_pairs``).  A pair counts in
the first block in whose budget it lies and is skipped in the others, so the
union of candidates needs no ``distinct``; it is verified by the exact cosine
there and then.

The points of a label that fit a task are sent there once and joined in all
blocks.  A larger label is split by a k-d tree per block over all the block's
coordinates, fitted on a bounded sample of the label: a row goes to its own
cell and, on one side of each split, to the cells within reach.  The trees
only deal rows; whatever they are, each pair in reach meets in one cell.  A cell
of more rows than a task takes is compared in (chunk, chunk) groups; a task
returns link counts per vector and a forest of links, not the pairs.  Equal
vectors of one label are one point with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import components, written

#: Coordinates of the rows on one side of a task's comparison (16 MB of doubles).
VALUES = 1 << 21
#: Cells of all trees together, and the sampled rows a cell is fitted on.  Labels beyond
#: that have larger cells, compared in chunks.
CELLS, PER_CELL = 4096, 32
#: Pairs compared at once where some are out of reach, and where all are within.
_TILE, _FULL = 1 << 13, 1 << 18
#: Room for rounding of float rotation and budgets; the cosine itself is exact in doubles.
_SLACK = 1e-5


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix: spreads any direction evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _blocks(dim: int, size: int, least: float) -> list[tuple[int, int, float]]:
    """(first, one past last coordinate, budget) of every block."""
    edges = [*range(0, dim, size), dim]
    return [(lo, hi, 2 * (1 - least) * (hi - lo) / dim + _SLACK) for lo, hi in zip(edges, edges[1:])]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each (exact), so no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _matrix(column, dim: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _scaled(a.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _turned(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])


# ------------------------------------------------------------- range join


def _halves(y: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = y[a]
    order = np.argpartition(z[:, np.argmax(np.ptp(z, axis=0))], len(a) // 2)
    return a[order[:len(a) // 2]], a[order[len(a) // 2:]]


def _near_box(z: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: float) -> np.ndarray:
    gap = np.maximum(np.maximum(lo - z, z - hi), 0)
    return np.einsum("ij,ij->i", gap, gap) <= budget


def range_pairs(y: np.ndarray, a: np.ndarray, b: np.ndarray | None, budget: float) -> Iterator[tuple]:
    """Tiles (a, b, same) that hold all pairs of rows ``a`` with rows ``b`` of ``y``
    within squared distance ``budget``; without ``b``, of ``a`` with itself, where
    ``same`` marks a tile of rows with themselves."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if b is None:
            if len(a) * len(a) <= _TILE:
                if len(a) > 1:
                    yield a, a, True
                continue
            left, right = _halves(y, a)
            todo += [(left, None), (right, None), (left, right)]
            continue
        size = -1
        while len(a) and len(b) and size != len(a) + len(b):  # boxes shrink as rows leave
            size = len(a) + len(b)
            z = y[b]
            lo, hi = z.min(axis=0), z.max(axis=0)
            a = a[_near_box(y[a], lo, hi, budget)]
            if len(a):
                w = y[a]
                low, high = w.min(axis=0), w.max(axis=0)
                b = b[_near_box(z, low, high, budget)]
        if not len(a) or not len(b):
            continue
        reach = np.maximum(high - lo, hi - low)
        if len(a) * len(b) <= (_FULL if reach @ reach <= budget else _TILE):
            yield a, b, False
        elif len(a) >= len(b):
            todo += [(half, b) for half in _halves(y, a)]
        else:
            todo += [(a, half) for half in _halves(y, b)]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, term by term (no cancellation)."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        d *= d
        out += d
    return out


class _Joined:
    """Links among the rows of one task: counts per row and a forest."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, size: int, least: float):
        self.x, self.copies, self.least = x, copies, least
        self.norm = np.linalg.norm(x, axis=1)
        self.unit = x / self.norm[:, None]
        y = _turned(x)
        self.blocks = [(np.ascontiguousarray(y[:, lo:hi]), budget) for lo, hi, budget in _blocks(x.shape[1], size, least)]
        self.links = np.zeros(len(x), np.int64)
        self.names = np.arange(len(x))
        self.forest: list[tuple[int, int]] = []
        self.compared = self.verified = 0

    def _root(self, a: int) -> int:
        names = self.names
        while names[a] != a:
            names[a] = a = names[names[a]]
        return a

    def _cosines(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty(len(u))
        for s in range(0, len(u), 1 << 14):
            p, q = u[s:s + (1 << 14)], v[s:s + (1 << 14)]
            out[s:s + (1 << 14)] = (self.x[p] * self.x[q]).sum(1) / (self.norm[p] * self.norm[q])
        return out

    def join(self, block: int, a: np.ndarray, b: np.ndarray | None) -> None:
        y, budget = self.blocks[block]
        for p, q, same in range_pairs(y, a, b, budget):
            near = _squared(y[p], y[q]) <= budget
            if same:  # each pair once
                near &= np.tri(len(p), k=-1, dtype=bool)
            self.compared += near.size
            r, c = np.nonzero(near)
            for z, most in self.blocks[:block]:  # counted in an earlier block
                if not len(r):
                    break
                d = z[p[r]] - z[q[c]]
                new = np.einsum("ij,ij->i", d, d) > most
                r, c = r[new], c[new]
            if not len(r):
                continue
            self.verified += len(r)
            u, v = p[r], q[c]
            if 4 * len(r) > near.size:  # by one product, those at the threshold once more
                cos = (self.unit[p] @ self.unit[q].T)[r, c]
                at = np.flatnonzero(np.abs(cos - self.least) < 1e-9)
                cos[at] = self._cosines(u[at], v[at])
            else:
                cos = self._cosines(u, v)
            u, v = u[cos >= self.least], v[cos >= self.least]
            np.add.at(self.links, u, self.copies[v])
            np.add.at(self.links, v, self.copies[u])
            apart = self.names[u] != self.names[v]
            for m, n in zip(u[apart].tolist(), v[apart].tolist()):
                g, h = self._root(m), self._root(n)
                if g != h:
                    self.names[g] = h
                    self.forest.append((m, n))
            while not np.array_equal(flat := self.names[self.names], self.names):
                self.names[:] = flat


def _compare(dim: int, size: int, least: float):
    schema = pa.schema([("pid", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block, i, j = (key[k].as_py() for k in (1, 3, 4))
        col = {c: table.column(c).to_numpy() for c in ("pid", "copies", "home", "chunk")}
        order = np.argsort(col["pid"])  # a retry sees the rows in the same order
        pid, copies, home, chunk = (col[c][order] for c in ("pid", "copies", "home", "chunk"))
        job = _Joined(_matrix(table.column("x"), dim)[order], copies, size, least)
        mine, theirs = np.flatnonzero(home & (chunk == i)), np.flatnonzero(home & (chunk == j))
        # home rows meet each other once; a copied row meets the home rows of either chunk
        pairs = [(mine, None if i == j else theirs), (mine, np.flatnonzero(~home & (chunk == j)))]
        if i != j:
            pairs.append((theirs, np.flatnonzero(~home & (chunk == i))))
        for k in range(len(job.blocks)) if block < 0 else [block]:
            for a, b in pairs:
                job.join(k, a, b)
        linked = np.flatnonzero(job.links)
        m, n = np.array(job.forest, np.int64).reshape(-1, 2).T
        none = pa.nulls(len(linked), pa.int64())
        return pa.table([pa.array(np.concatenate([pid[linked], pid[m]])),
                         pa.array(np.concatenate([job.links[linked], np.zeros(len(m), np.int64)])),
                         pa.concat_arrays([none, pa.array(pid[n], pa.int64())])], schema=schema)
    return run


# ------------------------------------------------------- cells of large labels


def _fit(dim: int, size: int, least: float, depths: dict[int, int]):
    """Sampled rows of a label -> per block the splits of a tree, node i over 2i+1 and 2i+2."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lab = key[0].as_py()
        y = _turned(_matrix(table.column("x"), dim)[np.argsort(table.column("pid").to_numpy())])
        rows = []
        for k, (lo, hi, _) in enumerate(_blocks(dim, size, least)):
            z = y[:, lo:hi]
            level, at, value = [np.arange(len(z))], [], []
            for _ in range(depths[lab]):
                below = []
                for a in level:
                    spread = z[a].var(axis=0) if len(a) else np.zeros(hi - lo)
                    at.append(int(np.argmax(spread)))
                    value.append(float(np.median(z[a, at[-1]])) if len(a) else 0.0)
                    left = z[a, at[-1]] < value[-1]
                    below += [a[left], a[~left]]
                level = below
            rows.append((lab, k, at, value))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (
            pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())))], names=["lab", "block", "at", "value"])
    return run


def cells(z: np.ndarray, at: list[int], value: list[float], budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of the rows ``z`` in a tree's cells: a row's own cell, and those
    within reach that a split puts after it."""
    out = []
    todo = [(0, np.arange(len(z)), np.zeros(z.shape), np.ones(len(z), bool))]
    while todo:
        node, rows, gap, home = todo.pop()
        if not len(rows):
            continue
        if node >= len(at):
            out.append((rows, np.full(len(rows), node), home))
            continue
        d = z[rows, at[node]] - value[node]
        for child, own in ((2 * node + 1, d < 0), (2 * node + 2, d >= 0)):
            g = gap.copy()
            g[~own, at[node]] = np.abs(d[~own])
            stay = own | ((~home | (d < 0)) & (np.einsum("ij,ij->i", g, g) <= budget))
            todo.append((child, rows[stay], g[stay], (home & own)[stay]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int),) * 3


def _deal(dim: int, size: int, least: float, trees):
    """Batches of (lab, pid, label, x, copies) -> one row per (block, cell) copy; a label
    without trees is one cell of block -1."""
    def run(batches):
        blocks = _blocks(dim, size, least)
        for b in batches:
            lab = b.column(0).to_numpy()
            known = [int(v) for v in np.unique(lab) if int(v) in trees.value]
            parts = [(-1, np.flatnonzero(~np.isin(lab, known)), None, None)]
            if known:
                y = _turned(_matrix(b.column(3), dim))
            for v in known:
                rows = np.flatnonzero(lab == v)
                for k, (lo, hi, budget) in enumerate(blocks):
                    i, cell, home = cells(y[rows, lo:hi], *trees.value[v][k], budget)
                    parts.append((k, rows[i], cell, home))
            i = np.concatenate([p[1] for p in parts])
            block = np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts])
            cell = np.concatenate([np.zeros(len(p[1]), np.int64) if p[2] is None else p[2].astype(np.int64) for p in parts])
            home = np.concatenate([np.ones(len(p[1]), bool) if p[3] is None else p[3].astype(bool) for p in parts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(cell), pa.array(home),
                 *[b.column(c).take(pa.array(i)) for c in range(1, b.num_columns)]],
                names=["block", "cell", "home", *b.schema.names[1:]])
    return run


def _trees(p: DataFrame, dim: int, size: int, least: float, rows: int) -> dict:
    """Label digest -> per block (coordinates, values) of the splits, for labels of more than
    ``rows`` points.  A digest two labels share costs nothing but the fit."""
    big = (p.groupBy("lab").agg(F.count("*").alias("n")).where(F.col("n") > rows)
           .orderBy(F.desc("n"), "lab").limit(CELLS // 2).collect())
    depths, left = {}, CELLS
    for r in big:
        depth = min(int(np.ceil(np.log2(r.n / rows))), int(np.log2(left)) if left > 1 else 0)
        if depth:
            depths[r.lab], left = depth, left - (1 << depth)
    if not depths:
        return {}
    # about PER_CELL points of every cell to come, chosen by digest, are fitted on
    share = [(r.lab, min(1.0, PER_CELL * (1 << depths[r.lab]) / r.n)) for r in big if r.lab in depths]
    spark = p.sparkSession
    rates = F.broadcast(spark.createDataFrame(share, "lab long, share double"))
    chosen = p.join(rates, "lab").where(F.pmod(F.xxhash64("pid", F.lit(7)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    fitted = chosen.select("lab", "pid", "x").groupBy("lab").applyInArrow(
        _fit(dim, size, least, depths), "lab long, block int, at array<int>, value array<double>").collect()
    out: dict[int, dict] = {}
    for r in fitted:
        out.setdefault(r.lab, {})[r.block] = (r["at"], r["value"])
    return out


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 least: float = 0.93, block: int = 8, task_values: int = VALUES) -> DataFrame:
    """(``vec_id``, n_links, component_id, kept), one row per row of ``vectors``.

    Rows of equal, non-null label link where their cosine in doubles is at
    least ``least``.  Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing, nor do vectors of different
    lengths.  n_links counts the other rows linked directly, component_id is the
    least id reachable (null if no id is known), kept tells whether that is the
    row itself.  Rows that are equal in everything count as different rows.
    Other columns are ignored.
    """
    v = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"),
                       F.col(f"`{vector}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = (F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False))
              & F.exists("x", lambda e: e != 0))
    v = v.withColumn("pkey", F.when(usable, F.struct("label", "x")))
    rows = written(v.select("vec_id", "pkey", F.xxhash64("pkey").alias("h")), "vectors")
    # equal vectors of a label are one point; its number is dealt by place in the written table
    points = rows.where("pkey is not null").groupBy("pkey").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    points = written(points.select(F.monotonically_increasing_id().alias("pid"), "pkey", "copies", "least_id"), "points")
    found = []
    for dim in [r[0] for r in points.select(F.size("pkey.x")).distinct().collect()]:  # the lengths in use
        p = points.where(F.size("pkey.x") == dim).select("pid", F.col("pkey.label").alias("label"), F.col("pkey.x").alias("x"), "copies")
        most = max(2, task_values // dim)
        p = p.select(F.xxhash64("label").alias("lab"), "pid", "label", "x", "copies")
        trees = p.sparkSession.sparkContext.broadcast(_trees(p, dim, block, least, most))  # at most CELLS cells
        schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("cell", T.LongType()),
                               T.StructField("home", T.BooleanType()), *p.drop("lab").schema.fields])
        dealt = p.mapInArrow(_deal(dim, block, least, trees), schema)
        # cells are counted from the narrow columns, then split into chunks
        counts = dealt.groupBy("label", "block", "cell").agg(F.count("*").alias("rows"), F.sum(F.col("home").cast("int")).alias("homes"))
        counts = counts.where("rows > 1 and homes > 0").select(
            F.struct("label", "block", "cell").alias("at"), F.ceil(F.col("rows") / most).cast("int").alias("chunks"))
        d = dealt.withColumn("at", F.struct("label", "block", "cell")).join(counts, "at")
        d = d.withColumn("chunk", F.pmod(F.xxhash64("pid"), F.col("chunks")).cast("int"))
        d = d.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
            F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j")))))
        d = d.select("label", "block", "cell", "pair.i", "pair.j", "chunk", "home", "pid", "copies", "x")
        found.append(d.groupBy("label", "block", "cell", "i", "j").applyInArrow(
            _compare(dim, block, least), "pid long, links long, other long"))
    if not found:
        out = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return out.withColumn("kept", F.lit(True))
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    links = written(links, "links")
    counts = links.groupBy("pid").agg(F.sum("links").alias("links"))
    comp = components(links.where("other is not null").select(F.col("pid").alias("a"), F.col("other").alias("b")), "vec")
    p = (points.join(counts, "pid", "left").join(comp, F.col("pid") == F.col("node"), "left")
         .select("pkey", "copies", "least_id", F.coalesce("root", "pid").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    least_ids = p.groupBy(F.col("root").alias("r")).agg(F.min("least_id").alias("component"))
    p = p.join(least_ids, F.col("root") == F.col("r")).select(F.col("pkey").alias("k"), "component", (F.col("links") + F.col("copies") - 1).alias("n"))
    out = rows.join(p, F.col("pkey") == F.col("k"), "left")
    component = F.when(F.col("pkey").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
