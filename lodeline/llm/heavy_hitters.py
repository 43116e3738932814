"""Most frequent items of a column with bounded memory.

Method: a heavy-light split. Each partition keeps ``buckets`` buckets; a bucket holds one resident item with an exact
count of its own and a counter of the votes against it. When the votes against reach the resident's count, the resident
is evicted: its count falls into a compact two-row counter array (the light part) and the strongest challenger moves in.
Partitions merge by recombining buckets: counts of an item add up, a bucket keeps its strongest items, the rest falls
into the light part. For every item ``heavy + min(light cells)`` is never below its true count, so filtering on that
bound loses nothing, whatever the hashing did; an exact recount of the few items above the bound follows.

Memory: per task ``buckets`` keys and ``2 * width`` counters. Sent to the driver: at most ``SLOTS * buckets`` keys
(in practice a few times ``limit``) and the light cells above the limit, fewer than ``2 * limit``. Neither grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.session import cut

#: Items a bucket keeps when the partitions' buckets are recombined.
SLOTS = 4


def _cells(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """The item's cell in each row of the light part. Keys are 64-bit hashes, so disjoint bits serve as two hashes."""
    return [keys & (width - 1), (keys >> 20) & (width - 1)]


def _cell(key: Column, row: int, width: int) -> Column:
    """``_cells`` as an expression; ``width`` is a power of two up to 2**20."""
    return (F.shiftright(key, 20) if row else key).bitwiseAND(F.lit(width - 1).cast("long"))


class Sketch:
    """One partition's heavy-light sketch over 64-bit item keys."""

    def __init__(self, buckets: int, width: int):
        self.buckets, self.width, self.total = buckets, width, 0
        self.key = np.zeros(buckets, np.int64)
        self.own = np.zeros(buckets, np.int64)
        self.against = np.zeros(buckets, np.int64)
        self.light = np.zeros((2, width), np.int64)

    def _drop(self, keys: np.ndarray, counts: np.ndarray) -> None:
        for row, cell in enumerate(_cells(keys, self.width)):
            np.add.at(self.light[row], cell, counts)

    def add(self, keys: np.ndarray) -> None:
        """Take one batch of keys, repeats allowed."""
        if not len(keys):
            return
        self.total += len(keys)
        item, count = np.unique(keys, return_counts=True)
        count = count.astype(np.int64)
        at = (item >> 40) & (self.buckets - 1)
        at_home = (self.own[at] > 0) & (self.key[at] == item)
        np.add.at(self.own, at[at_home], count[at_home])
        item, count, at = item[~at_home], count[~at_home], at[~at_home]
        if not len(item):
            return
        np.add.at(self.against, at, count)
        order = np.lexsort((item, -count, at))
        item, count, at = item[order], count[order], at[order]
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        wins = first & (self.against[at] >= self.own[at])
        out = at[wins & (self.own[at] > 0)]
        self._drop(self.key[out], self.own[out])
        self.key[at[wins]], self.own[at[wins]], self.against[at[wins]] = item[wins], count[wins], 0
        self._drop(item[~wins], count[~wins])

    def rows(self) -> pa.RecordBatch:
        """kind 0: heavy items, 1 and 2: light cells, 3: the number of items."""
        live = self.own > 0
        parts = [(np.zeros(live.sum(), np.int32), self.key[live], self.own[live])]
        for row in (0, 1):
            cell = np.flatnonzero(self.light[row])
            parts.append((np.full(len(cell), row + 1, np.int32), cell, self.light[row][cell]))
        parts.append((np.array([3], np.int32), np.array([0]), np.array([self.total])))
        kind, key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])


def _partition_sketch(buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketch(buckets, width)
        for b in batches:
            s.add(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False))
        if s.total:
            yield s.rows()

    return run


def sketch(keys: DataFrame, buckets: int, width: int) -> DataFrame:
    """The merged sketch ``(kind, key, n)`` of a frame whose first column is a non-null 64-bit key."""
    parts = keys.mapInArrow(_partition_sketch(buckets, width), "kind int, key long, n long")
    summed = parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    bucket = F.shiftright("key", 40).bitwiseAND(F.lit(buckets - 1).cast("long"))
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(F.desc("n"), "key"))
    ranked = summed.where("kind = 0").withColumn("place", place)
    kept = ranked.where(F.col("place") <= SLOTS).select("kind", "key", "n")
    fallen = ranked.where(F.col("place") > SLOTS).select("key", "n").mapInArrow(_fall(width), "kind int, key long, n long")
    light = summed.where("kind > 0").unionByName(fallen).groupBy("kind", "key").agg(F.sum("n").alias("n"))
    return kept.unionByName(light)


def _fall(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            for row, cell in enumerate(_cells(keys, width)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row + 1, np.int32)), pa.array(cell), n], ["kind", "key", "n"])

    return run


def frequent(
    rows: DataFrame, items: list[str], limit: int, once_per: str | None = None, buckets: int | None = None, width: int | None = None
) -> DataFrame:
    """Items with more than ``1/limit`` of all rows: ``items..., n, approx_n, approx_low``, every such item and no other.

    ``once_per`` names an identifier whose repeats count once (rows with a null identifier each count for themselves);
    repeats carry the same item. Rows with a null in any item column are left out. An empty table gives an empty result.
    Ties need no rule: every item above the limit is returned. ``approx_low <= n <= approx_n``: what the sketch alone knows.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    buckets = buckets or min(1 << 18, max(1024, 1 << (8 * limit - 1).bit_length()))
    width = width or 4 * buckets
    if buckets & (buckets - 1) or width & (width - 1) or width > 1 << 20:
        raise ValueError("buckets and width must be powers of two, width at most 2**20")
    if {"n", "approx_n", "approx_low"} & set(items):
        raise ValueError("an item column has the name of a result column")
    inner = [f"__i{i}" for i in range(len(items))]
    picked = [F.col(c).alias(i) for c, i in zip(items, inner, strict=True)]
    valid = rows.select(*picked, *([] if once_per is None else [F.col(once_per).alias("__once")])).dropna(subset=inner).withColumn("__k", F.xxhash64(*inner))
    # Only 16 bytes a row are shuffled to count each identifier once.
    keys = valid.select("__k") if once_per is None else _once(valid.select("__k", "__once")).select("__k")
    merged = cut(sketch(keys, buckets, width))
    total = (merged.where("kind = 3").agg(F.sum("n")).first() or [0])[0] or 0
    floor = total // limit  # n * limit > total  <=>  n > floor
    hot = {row: [r["key"] for r in merged.where((F.col("kind") == row) & (F.col("n") > floor)).select("key").collect()] for row in (1, 2)}
    bound = _bounds(merged.where("kind = 0").select("key", "n"), merged.where("kind in (1, 2)"), width)
    kept = bound.where(F.col("high") > floor).select("key", "low", "high").collect()
    cand = rows.sparkSession.createDataFrame([(r["key"], r["low"], r["high"]) for r in kept], "__k long, approx_low long, approx_n long")
    known = valid.join(F.broadcast(cand), "__k", "left")
    hot_cells = F.lit(False)
    if hot[1] and hot[2]:
        hot_cells = _cell(F.col("__k"), 0, width).isin(hot[1]) & _cell(F.col("__k"), 1, width).isin(hot[2])
    known = known.where(F.col("approx_n").isNotNull() | hot_cells)
    keep = [*inner, "approx_n", "approx_low"]
    if once_per is not None:
        known = _once(known.select(*keep, "__k", "__once"), keep)
    return (
        known.groupBy(*inner)
        .agg(F.count(F.lit(1)).alias("n"), F.max("approx_n").alias("approx_n"), F.max("approx_low").alias("approx_low"))
        .where(F.col("n") > floor)
        .select(*[F.col(i).alias(c) for i, c in zip(inner, items, strict=True)], "n", F.coalesce("approx_n", "n").alias("approx_n"), F.coalesce("approx_low", F.lit(0)).alias("approx_low"))
    )


def _once(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per identifier; the aggregation drops repeats before the shuffle where they meet. Rows without an identifier all stay."""
    named = df.where(F.col("__once").isNotNull()).groupBy("__once")
    if keep is None:
        first, keep = named.agg(F.min("__k").alias("__k")), ["__k"]
    else:
        first = named.agg(F.min(F.struct("__k", *keep)).alias("__s")).select("__s.*")
    return first.select(*keep).unionByName(df.where(F.col("__once").isNull()).select(*keep))


def _bounds(heavy: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """Lower and upper bound of every kept item: its own count, and that plus the smaller of its light cells."""
    h = heavy.withColumn("c1", _cell(F.col("key"), 0, width)).withColumn("c2", _cell(F.col("key"), 1, width))
    l1 = cells.where("kind = 1").select(F.col("key").alias("c1"), F.col("n").alias("n1"))
    l2 = cells.where("kind = 2").select(F.col("key").alias("c2"), F.col("n").alias("n2"))
    j = h.join(l1, "c1", "left").join(l2, "c2", "left")
    return j.select("key", F.col("n").alias("low"), (F.col("n") + F.least(F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0)))).alias("high"))
