"""JSON documents: canonical writing, strict reading, lenient stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(df: DataFrame, order: list[str], name: str = "json") -> DataFrame:
    """Rows as JSON text with keys in byte order, minus zero as zero, not-a-number refused, in a total order: the same table gives the same bytes."""
    cols = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
            c = F.when(bad, F.raise_error(F.lit(f"{f.name} is not finite"))).otherwise(c + F.lit(0.0))
        cols.append(c.alias(f.name))
    return df.select(*order, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(name)).orderBy(*order).select(name)


def write_canonical(df: DataFrame, order: list[str], path: str) -> None:
    """One file with the rows in order. For reports and small documents; tables belong into parquet."""
    canonical(df, order).coalesce(1).write.mode("overwrite").text(path)


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows of exactly this schema; a row that does not fit stops the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows; what does not fit becomes null, rows of nothing are dropped."""
    return spark.read.schema(schema).json(path, mode="PERMISSIVE").dropna(how="all")


def read_tally(spark: SparkSession, path: str) -> DataFrame:
    """A tally store: rows that say more passes than gradings are dropped."""
    t = read_lenient(spark, path, "verb string, subject string, graded long, passed_on long")
    return t.where("verb is not null and subject is not null and graded >= 0 and passed_on >= 0 and passed_on <= graded")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """A progress store of either version: version 1 holds ``done``, version 2 ``proved`` and ``shown``; both come out as version 2."""
    t = read_lenient(spark, path, "version int, verb string, subject string, done array<string>, proved array<string>, shown array<string>")
    none = F.array().cast("array<string>")
    old = F.coalesce("version", F.lit(1)) < 2
    return t.where("verb is not null and subject is not null").select(
        "verb", "subject", F.array_sort(F.array_distinct(F.when(old, F.coalesce("done", none)).otherwise(F.coalesce("proved", none)))).alias("proved"), F.array_sort(F.array_distinct(F.coalesce("shown", none))).alias("shown")
    )
