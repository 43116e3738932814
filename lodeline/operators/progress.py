"""Folding an attempts log: tallies, first passes, what is shown, what is proved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def attempts(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The log with ``attempt``: the ordinal of each submission of a board."""
    return log.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def tally(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """Per board: submissions graded, and the first that passed (0 for none)."""
    return numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("graded"), F.coalesce(F.min(F.when(F.col("passed"), F.col("attempt"))), F.lit(0)).alias("passed_on"))


def readings(t: DataFrame, by: list[str]) -> DataFrame:
    """Boards, submissions, boards passed at once, passed later, and never."""
    return t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("boards"),
        F.sum("graded").alias("graded"),
        F.count_if(F.col("passed_on") == 1).alias("first"),
        F.count_if(F.col("passed_on") > 1).alias("later"),
        F.count_if(F.col("passed_on") == 0).alias("unpassed"),
    )


def fold(numbered: DataFrame, keys: list[str], member: str) -> DataFrame:
    """What each subject has proved (members of first submissions that passed) and only shown (of later ones), as sorted sets.

    A member that is proved is not shown too. Sets are of the members of one subject's boards.
    """
    g = numbered.where("passed").groupBy(*keys, member).agg(F.min("attempt").alias("first"))
    return g.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("first") == 1, F.col(member)))).alias("proved"), F.array_sort(F.collect_list(F.when(F.col("first") > 1, F.col(member)))).alias("shown")
    )


def still_holds(passes: DataFrame, relation: DataFrame, keys: list[str]) -> DataFrame:
    """Passes whose keys are still in the relation."""
    return passes.join(relation.select(*keys).distinct(), keys, "left_semi")


def medals(have: DataFrame, groups: list[str], tiers: dict[str, float]) -> DataFrame:
    """The best tier each group reaches: a tier asks for its part of the achievable, rounded up, one at least. ``have`` has ``have, achievable``."""
    tier = F.lit(None).cast("string")
    for name, part in sorted(tiers.items(), key=lambda kv: kv[1]):
        bar = F.greatest(F.lit(1), F.ceil(F.col("achievable") * F.lit(part)))
        tier = F.when((F.col("achievable") > 0) & (F.col("have") >= bar), F.lit(name)).otherwise(tier)
    return have.select(*groups, "have", "achievable", tier.alias("medal"))
