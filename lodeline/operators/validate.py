"""Data-quality checks: each returns its violations as ``rule, entity, detail``; an empty result means a clean table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def row_rules(df: DataFrame, entity: Column, rules: dict[str, Column]) -> DataFrame:
    """One scan for any number of row rules; a rule is a column that is true for a good row (null counts as bad)."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(failed).alias("rule"), entity.cast("string").alias("entity"), F.lit("").alias("detail"))


def unique(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("entity"), F.concat(F.lit("x"), F.col("n")).alias("detail"))


def refers(df: DataFrame, keys: list[str], to: DataFrame, rule: str) -> DataFrame:
    """Rows whose key is not in ``to`` (which has columns of the same names)."""
    lost = df.select(*keys).distinct().join(to.select(*keys).distinct(), keys, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("entity"), F.lit("missing").alias("detail"))


def ordered(df: DataFrame, group: list[str], place: str, keys: list[str], rule: str) -> DataFrame:
    """Rows that do not strictly follow the row before them in key order; keys are compared as a tuple."""
    w = Window.partitionBy(*group).orderBy(place)
    k = F.struct(*keys)
    bad = df.withColumn("before", F.lag(k).over(w)).where(F.col("before").isNotNull() & (F.col("before") >= k))
    return bad.select(F.lit(rule).alias("rule"), F.concat_ws("|", *group, F.col(place).cast("string")).alias("entity"), F.lit("order").alias("detail"))


def counts_match(parent: DataFrame, keys: list[str], count: str, child: DataFrame, rule: str) -> DataFrame:
    """Parents whose stored count differs from the rows of ``child``."""
    got = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("got"))
    j = parent.select(*keys, count).join(got, keys, "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col(count) != F.col("got"))
    return j.select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("entity"), F.concat_ws("<>", F.col(count).cast("string"), F.col("got").cast("string")).alias("detail"))


def subset(df: DataFrame, entity: Column, inner: str, outer: str, rule: str) -> DataFrame:
    """Rows whose array ``inner`` is empty, is not within ``outer``, or fills it."""
    bad = (F.size(F.array_except(inner, outer)) > 0) | (F.size(F.array_distinct(inner)) == 0) | (F.size(F.array_distinct(inner)) >= F.size(F.array_distinct(outer)))
    return df.where(F.coalesce(bad, F.lit(True))).select(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), F.lit("").alias("detail"))


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
