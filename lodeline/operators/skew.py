"""Joins that stay balanced when a few keys own a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more than 1/HOT of all rows, so there are fewer than HOT hot keys at any data size.
HOT = 64
SALTS = 48


def salted_lookup(left: DataFrame, right: DataFrame, on: list[str], count_col: str, spread: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on)`` for a ``right`` with one row per key that knows how many left rows the key has.

    Hot keys (over 1/HOT of the sum of ``count_col``) are split over SALTS tasks: their right row is replicated and
    their left rows take a salt from the hash of ``spread``, so a task that is run again salts alike. Fewer than HOT
    keys can be hot, so the list sent to the executors is bounded by construction. Without hot keys it is a plain join.
    Null keys match nothing, as in any join.
    """
    total = right.agg(F.sum(count_col).alias("t")).first()["t"] or 0
    hot = right.where(F.col(count_col) > F.lit(max(1, total // HOT))).select(*on) if total >= HOT * SALTS else None
    found = hot.limit(HOT + 1).collect() if hot is not None else []
    if not found:
        return left.join(right, on, how)
    spark = left.sparkSession
    keys = F.broadcast(spark.createDataFrame([tuple(r) for r in found], hot.schema).withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    l2 = left.join(keys, on, "left").withColumn("__salt", salt).drop("__hot")
    r2 = (
        right.join(keys, on, "left")
        .withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        .drop("__hot")
    )
    return l2.join(r2, [*on, "__salt"], how).drop("__salt")


#: Below so many rows of one key no task is in danger, and the join is left to the planner.
MANY = 200_000


def split_lookup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left.join(right, on)`` for a ``right`` with at most one row per key, when nobody has counted the left rows of a key.

    The keys are counted map-side first. Those with more than 1/HOT of all rows, fewer than HOT at any size, are looked up in a broadcast of
    their right rows, so the rows of a hot key stay where they are; the others are joined as usual. ``left`` is read twice: cut it before.
    """
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    top = sizes.orderBy(F.desc("__n")).limit(HOT).collect()
    if not top or top[0]["__n"] < MANY:
        return left.join(right, on)
    total = left.count()
    hot = [tuple(r[c] for c in on) for r in top if r["__n"] * HOT > total]
    if not hot:
        return left.join(right, on)
    keys = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(*on).schema))
    few = F.broadcast(right.join(keys, on, "left_semi"))
    return left.join(few, on).unionByName(left.join(keys, on, "left_anti").join(right, on))
