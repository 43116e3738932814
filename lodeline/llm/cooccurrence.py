"""Items that appear together: pair counts and how much more often than chance.

Method: basket collapsing. Baskets are deduplicated to sorted item sets, identical sets are grouped into one weighted
basket, pairs are enumerated once per distinct basket, and the weights are summed.

Two exact prunings come before pairs are made, from counts of single items: a pair needs ``n_ab >= min_count``, so both
items need it; and ``n_ab <= min(n_a, n_b)``, so ``n_ab * N >= lift * n_a * n_b`` needs ``lift * max(n_a, n_b) <= N``.
The second removes the very popular items, the ones that would make most pairs. After pruning baskets collapse again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.skew import salted_lookup, split_lookup
from lodeline.session import cut


def collapse(baskets: DataFrame, group: str, items: str) -> DataFrame:
    """Distinct item sets of each group with their weight: ``group, items, weight``.

    Null items and repeats within a basket do not count; baskets that are null or empty are left out.
    """
    clean = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))
    return (
        baskets.select(F.col(group), clean.alias(items))
        .where(F.size(items) > 0)
        .groupBy(group, items)
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def pairs(baskets: DataFrame, group: str, set_column: str, min_count: DataFrame, lift: float = 0.0) -> DataFrame:
    """Pairs of items in baskets of one group: ``group, item_a, item_b, n_ab, n_a, n_b, n, lift, conviction``.

    ``min_count`` has ``group, min_count``; groups without a row there give nothing. ``item_a < item_b`` by bytes. Baskets
    must be of bounded size (leave wide ones out before). ``lift`` is ``n_ab * n / (n_a * n_b)``; ``conviction`` of a -> b is
    ``(1 - n_b / n) / (1 - n_ab / n_a)``, null when every basket with a has b. Empty input gives an empty result.
    """
    out_group, group, items, floors = group, "__group", "__items", min_count
    min_count = floors.select(F.col(out_group).alias(group), F.col("min_count"))
    source = baskets.select(F.col(out_group).alias(group), F.col(set_column).alias(items))
    weighted = cut(collapse(source, group, items))
    totals = weighted.groupBy(group).agg(F.sum("weight").alias("n")).join(min_count.select(group, "min_count"), group)
    touched = weighted.select(group, "weight", F.explode(items).alias("item"))
    single = touched.groupBy(group, "item").agg(F.sum("weight").alias("n_item"), F.count(F.lit(1)).alias("rows"))
    keep = (F.col("n_item") >= F.col("min_count")) & (F.lit(float(lift)) * F.col("n_item") <= F.col("n"))
    kept = cut(single.join(totals, group).where(keep).select(group, "item", "n_item", "rows"))
    # a basket travels as a 128-bit name, not as its set once an item
    name = [F.xxhash64(group, items).alias("h1"), F.xxhash64(F.lit(1), group, items).alias("h2")]
    slim = salted_lookup(
        weighted.select(group, *name, "weight", F.explode(items).alias("item")),
        kept.select(group, "item", "rows"),
        [group, "item"],
        "rows",
        ["h1"],
    )
    again = (
        slim.groupBy(group, "h1", "h2")
        .agg(F.array_sort(F.collect_list("item")).alias("set2"), F.max("weight").alias("weight"))
        .where(F.size("set2") > 1)
        .groupBy(group, "set2")
        .agg(F.sum("weight").alias("weight"))
    )
    made = again.select(
        group,
        "weight",
        F.posexplode("set2").alias("i", "item_a"),
        "set2",
    ).select(group, "weight", "item_a", F.explode(F.slice("set2", F.col("i") + 2, F.size("set2"))).alias("item_b"))
    counted = made.groupBy(group, "item_a", "item_b").agg(F.sum("weight").alias("n_ab"))
    frequent = cut(counted.join(totals, group).where(F.col("n_ab") >= F.col("min_count")))
    a = kept.select(group, F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = kept.select(group, F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    # a popular item stands in a great part of the pairs
    scored = split_lookup(split_lookup(frequent, a, [group, "item_a"]), b, [group, "item_b"])
    product = F.col("n_a").cast("double") * F.col("n_b")
    return scored.where(F.col("n_ab").cast("double") * F.col("n") >= F.lit(float(lift)) * product).select(
        F.col(group).alias(out_group),
        "item_a",
        "item_b",
        "n_ab",
        "n_a",
        "n_b",
        "n",
        (F.col("n_ab").cast("double") * F.col("n") / product).alias("lift"),
        F.when(
            F.col("n_ab") < F.col("n_a"),
            (1 - F.col("n_b") / F.col("n")) / (1 - F.col("n_ab") / F.col("n_a")),
        ).alias("conviction"),
    )
