"""Hot keys for keyed window operators: ordered blocks plus halo rows.

``Window.partitionBy(key)`` sorts a whole key in one task; a key holding a
third of all rows would make that one task hold a third of the data.
Here such keys are found by one aggregate (partial aggregation map-side),
whose result stays a table: only how many keys and rows are hot comes to
the driver.  The rows of hot keys are cut into blocks of about equal row
counts by Spark's range partitioning over the key and the whole order
tuple, so bursts, far-off values, ties on the first column, strings,
fractions and NULLs are cut as evenly as anything else.  The blocked rows
are a table in the shared folder: the cut is sampled once, and every
reader, retries included, sees the same blocks.  A window operator then
runs per ``(key, block)`` on the block's rows plus *halo* rows copied from
the neighbouring blocks:

* a look-ahead of ``k`` rows needs the first ``k`` rows of the next
  non-empty block; a look-behind the last ``k`` rows of the previous one;
* a time range of length ``r`` needs the rows within ``r`` of the block's
  first time; blocks are merged until two of them span more than ``r``, so
  two neighbours suffice;
* a global row number is the block's offset (a running sum over the small
  per-block counts) plus the row number inside the block.

There are at most ``tidemark.maxBlocks`` blocks (default 10,000; blocks
grow beyond that), so the per-key tables over blocks stay small whatever
the data size.

Halo rows are computed and then dropped, so every row is output once.
Cold keys take the plain path: one shuffle by key.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ensure_checkpoint_dir

DEFAULT_HOT_ROWS = 2_000_000
DEFAULT_BLOCK_ROWS = 500_000
DEFAULT_MAX_BLOCKS = 10_000
DEFAULT_BROADCAST_BLOCKS = 200_000
#: Blocks that one task writes at most before more tasks are used.
BLOCKS_PER_FILE = 64


def conf_int(spark, name: str, default: int) -> int:
    return int(spark.conf.get(f"tidemark.{name}", str(default)))


def store(df: DataFrame, name: str) -> str:
    """Write ``df`` as a table in the shared folder (``spark.checkpoint.dir``); its path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/blocks-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return path


def stored(spark, path: str) -> bool:
    """Is the table still there?  A retention rule may have removed it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def broadcast_blocks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a table of at most ``rows`` rows over blocks, marked for broadcast
    where that bounds its bytes: few rows of fixed-width columns.  Otherwise
    the adaptive planner decides by the size it sees."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)

    def narrow(t: T.DataType) -> bool:
        return all(narrow(f.dataType) for f in t.fields) if isinstance(t, T.StructType) else isinstance(t, fixed)

    limit = conf_int(df.sparkSession, "broadcastBlocks", DEFAULT_BROADCAST_BLOCKS)
    return F.broadcast(df) if rows <= limit and narrow(df.schema) else df


_STATS_CACHE: dict[tuple, tuple[int, int, str | None]] = {}
_STATS_CACHE_SIZE = 256


def _hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> tuple[int, int, DataFrame | None]:
    """(number of hot keys, their rows, table of them): keys with more than
    ``hot_rows`` rows.

    Remembered per input plan within the application: many operators read
    the same table by the same key.  A stale entry splits other keys than
    it might; blocks are always cut from the rows themselves.
    """
    spark = df.sparkSession
    probe = df.select(*keys) if keys else df.select(F.lit(1).alias("_sk_one"))
    ck = (spark.sparkContext.applicationId, probe.semanticHash(), probe.schema.json(), hot_rows)
    known = _STATS_CACHE.get(ck)
    if known is None or (known[2] and not stored(spark, known[2])):
        hot = (probe.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sk_n"))
               .filter(F.col("_sk_n") > F.lit(hot_rows)))
        n, total = hot.agg(F.count(F.lit(1)), F.sum("_sk_n")).first()
        path = store(hot.select(*keys), "hot-keys") if n and keys else None
        if len(_STATS_CACHE) >= _STATS_CACHE_SIZE:
            _STATS_CACHE.pop(next(iter(_STATS_CACHE)))  # oldest first
        _STATS_CACHE[ck] = (n, total or 0, path)
    n, total, path = _STATS_CACHE[ck]
    return n, total, spark.read.schema(probe.schema).parquet(path) if path else None


class HotKeys:
    """Hot keys of ``df`` and how many blocks their rows are cut into."""

    def __init__(self, df: DataFrame, keys: Sequence[str], orders: Sequence[str], *, force: bool = False):
        spark = df.sparkSession
        self.keys, self.orders = list(keys), list(orders)
        hot_rows = 0 if force else conf_int(spark, "hotKeyRows", DEFAULT_HOT_ROWS)
        self.n_keys, rows, self._table = _hot_keys(df, self.keys, hot_rows)
        block_rows = conf_int(spark, "blockRows", DEFAULT_BLOCK_ROWS)
        self.parts = min(max(1, math.ceil(rows / block_rows)), conf_int(spark, "maxBlocks", DEFAULT_MAX_BLOCKS))
        #: a range holds the end of one key and the start of others, so no more (key, block) pairs
        self.n_blocks = self.parts + self.n_keys

    def __bool__(self) -> bool:
        return self.n_keys > 0

    def split(self, df: DataFrame, orders: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(cold rows, hot rows with ``_sk_blk``, a stored table)."""
        if self.keys:
            h = self._table.select(*[F.col(k).alias(f"_sk_k{i}") for i, k in enumerate(self.keys)])
            same = [df[k].eqNullSafe(h[f"_sk_k{i}"]) for i, k in enumerate(self.keys)]  # a NULL key is a key
            cold, hot = df.join(h, same, "left_anti"), df.join(h, same, "left_semi")
        else:
            cold, hot = df.limit(0), df
        by = list(dict.fromkeys([*self.keys, *(orders or self.orders)]))
        cut = hot.repartitionByRange(self.parts, *by).withColumn("_sk_blk", F.spark_partition_id().cast("long"))
        files = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(self.parts / BLOCKS_PER_FILE))
        path = store(cut.coalesce(files) if files < self.parts else cut, "hot-rows")
        return cold, df.sparkSession.read.schema(cut.schema).parquet(path)


def _neighbours(hot: DataFrame, keys: list[str], reach: int, time: Column | None = None) -> DataFrame:
    """Per non-empty block: the ``reach`` previous and next non-empty blocks
    and the number of rows before it in its key (with ``time``, also the first
    times of the next blocks).  One row per block."""
    first = [] if time is None else [F.min(time).alias("_sk_t0")]
    counts = hot.groupBy(*keys, "_sk_blk").agg(F.count(F.lit(1)).alias("_sk_cnt"), *first)
    w = Window.partitionBy(*keys).orderBy("_sk_blk")
    out = counts.withColumn("_sk_off", F.coalesce(
        F.sum("_sk_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).cast("long"))
    for i in range(1, reach + 1):
        out = (out.withColumn(f"_sk_prev{i}", F.lag("_sk_blk", i).over(w))
               .withColumn(f"_sk_next{i}", F.lead("_sk_blk", i).over(w)))
        if time is not None:
            out = out.withColumn(f"_sk_t{i}", F.lead("_sk_t0", i).over(w))
    return out


def _with_blocks(rows: DataFrame, blocks: DataFrame, part: list[str], n_blocks: int) -> DataFrame:
    """``rows`` with the other columns of their block's row in ``blocks``."""
    extra = [c for c in blocks.columns if c not in part]
    b = blocks.select(*[F.col(c).alias(f"_sk_h{i}") for i, c in enumerate(part)], *extra)
    same = [F.col(c).eqNullSafe(F.col(f"_sk_h{i}")) for i, c in enumerate(part)]
    return rows.join(broadcast_blocks(b, n_blocks), same, "inner").select(*rows.columns, *extra)


def _merged(hot: DataFrame, keys: list[str], time: Column, length: int, n_blocks: int) -> DataFrame:
    """Blocks whose first times share a cell of ``length`` become one, so any
    three consecutive blocks span more than ``length``."""
    first = hot.groupBy(*keys, "_sk_blk").agg(F.min(time).alias("_sk_t0"))
    cell = Window.partitionBy(*keys, F.floor(F.col("_sk_t0") / max(length, 1)))
    first = first.select(*keys, "_sk_blk", F.min("_sk_blk").over(cell).alias("_sk_to"))
    return (_with_blocks(hot, first, [*keys, "_sk_blk"], n_blocks)
            .withColumn("_sk_blk", F.col("_sk_to")).drop("_sk_to"))


def keyed_window(df: DataFrame, keys: Sequence[str], orders: Sequence[str],
                 op: Callable[[DataFrame, list[str]], DataFrame], *,
                 ahead: int = 0, behind: int = 0, range_behind: int = 0,
                 time: Column | None = None, row_number: bool = False,
                 strategy: str = "auto", hot: "HotKeys | None" = None) -> DataFrame:
    """Apply a window operator per key, splitting hot keys (module doc).

    ``op(frame, partition_cols)`` must add columns computed with windows
    partitioned by ``partition_cols`` and ordered by ``orders``, keep every
    row, and may use ``_rn`` (global row number in the key) when
    ``row_number`` is set.  It must not filter rows: filtering happens after
    halo rows are dropped, by the caller.  ``range_behind``: how far back
    ``op`` looks by ``time``, a number that grows with ``orders``.  ``hot``:
    hot keys found on a frame this one was filtered from (a superset of its
    hot keys), to save a statistics pass.
    """
    keys, orders = list(keys), list(orders)

    def plain(d: DataFrame) -> DataFrame:
        if row_number:
            d = d.withColumn("_rn", F.row_number().over(
                Window.partitionBy(*keys).orderBy(*orders)).cast("long"))
        return op(d, keys)

    if strategy == "plain":
        return plain(df)
    hk = hot if hot is not None and strategy == "auto" else HotKeys(df, keys, orders, force=strategy == "block")
    if not hk:
        return plain(df)
    cold, rows = hk.split(df, orders)
    part = keys + ["_sk_blk"]
    if range_behind:
        rows = _merged(rows, keys, time, range_behind, hk.n_blocks)
    reach = max(ahead, behind, 2 if range_behind else 0)
    nb = _neighbours(rows, keys, reach, time if range_behind else None)
    frame = rows.withColumn("_sk_halo", F.lit(False))
    if ahead or row_number:
        frame = frame.withColumn("_sk_rb", F.row_number().over(
            Window.partitionBy(*part).orderBy(*orders)))
    if behind:
        frame = frame.withColumn("_sk_rbd", F.row_number().over(
            Window.partitionBy(*part).orderBy(*[F.col(o).desc() for o in orders])))
    j = _with_blocks(frame, nb, part, hk.n_blocks)

    # One pass gives each row its copies: the first k rows of a block are
    # look-ahead of each of the k blocks before it (a block may hold fewer
    # than k rows); likewise behind.
    def copy(block: Column, halo: bool = True) -> Column:
        return F.struct(block.alias("blk"), F.lit(halo).alias("halo"))

    to = [copy(F.col("_sk_blk"), False)]
    for i in range(1, reach + 1):
        if i <= ahead:
            to.append(copy(F.when(F.col("_sk_rb") <= ahead, F.col(f"_sk_prev{i}"))))
        if i <= behind:
            to.append(copy(F.when(F.col("_sk_rbd") <= behind, F.col(f"_sk_next{i}"))))
        if range_behind and i <= 2:
            to.append(copy(F.when(time >= F.col(f"_sk_t{i}") - F.lit(range_behind), F.col(f"_sk_next{i}"))))
    if len(to) > 1:
        copies = F.filter(F.array(*to), lambda x: x["blk"].isNotNull())
        j = (j.withColumn("_sk_copy", F.explode(copies))
             .withColumn("_sk_blk", F.col("_sk_copy.blk")).withColumn("_sk_halo", F.col("_sk_copy.halo")))
    if row_number:
        # halo rows keep their own global number: offset of their home block
        j = j.withColumn("_rn", (F.col("_sk_off") + F.col("_sk_rb")).cast("long"))
    out_hot = op(j, part).filter(~F.col("_sk_halo"))
    keep = [c for c in out_hot.columns if not c.startswith("_sk_")]
    return plain(cold).select(*keep).unionByName(out_hot.select(*keep))
