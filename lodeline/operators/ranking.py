"""Top-k, mixing and sampling over ranked rows. Every order ends in a unique key, so results do not depend on the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, place: str = "place") -> DataFrame:
    """The first ``k`` rows of each group (planned as a group limit before the shuffle)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= k)


def round_robin(df: DataFrame, group: list[str], lane: str, order: list, k: int, far_first: bool = True) -> DataFrame:
    """The first ``k`` of each group taken in turn from its lanes: the best of every lane, then the second best, and so on."""
    inner = Window.partitionBy(*group, lane).orderBy(*order)
    turn = Window.partitionBy(*group).orderBy("turn", F.desc(lane) if far_first else F.asc(lane), *order)
    return df.withColumn("turn", F.row_number().over(inner)).withColumn("place", F.row_number().over(turn)).where(F.col("place") <= k)


def quotas(df: DataFrame, group: list[str], weight: str, key: str, total: Column) -> DataFrame:
    """Largest-remainder shares of ``total`` over each group's weights: column ``quota``; ties go to the smaller key."""
    g = Window.partitionBy(*group)
    exact = total * F.col(weight) / F.sum(weight).over(g)
    base = F.floor(exact)
    rest = Window.partitionBy(*group).orderBy(F.desc("rest"), key)
    x = df.withColumn("base", base).withColumn("rest", F.round(exact - base, 9)).withColumn("left", total - F.sum("base").over(g))
    return x.withColumn("quota", F.col("base") + F.when(F.row_number().over(rest) <= F.col("left"), 1).otherwise(0)).drop("base", "rest", "left")


def even_spread(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """``k`` rows of each group at even distances over its order, the ends included; all rows of a group of no more than ``k``."""
    w = Window.partitionBy(*group).orderBy(*order)
    g = Window.partitionBy(*group)
    x = df.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(g))
    # row i is wanted when some j has round(j * (n - 1) / (k - 1)) = i
    step = (F.col("n") - 1) / F.lit(max(1, k - 1))
    j = F.floor(F.col("i") / F.greatest(step, F.lit(1e-9)) + 0.5)
    near = [F.floor((j + o) * step + 0.5) == F.col("i") for o in (-1, 0, 1)]
    inside = [((j + o) >= 0) & ((j + o) <= k - 1) for o in (-1, 0, 1)]
    hit = (near[0] & inside[0]) | (near[1] & inside[1]) | (near[2] & inside[2])
    return x.where((F.col("n") <= k) | (F.lit(k == 1) & (F.col("i") == 0)) | (F.lit(k > 1) & hit)).drop("i", "n")


def bands(df: DataFrame, group: list[str], order: list, count: int, name: str = "band") -> DataFrame:
    """Equal bands of each group by rank; rows that tie share the band of the first of them."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.floor((F.rank().over(w) - 1) * count / F.count(F.lit(1)).over(Window.partitionBy(*group))).cast("int"))


def truth_cap(candidates: Column) -> Column:
    """How many of so many candidates may be right: a third of the others, rounded down."""
    return F.floor((candidates - 1) / 3).cast("int")


def truth_size(pool: Column, supply: Column, cap: int) -> Column:
    """The largest size s up to ``cap`` and the supply for which the wrong ones, at most ``pool`` and ``candidates - s``, exceed 2 s; else 0."""
    sizes = F.sequence(F.lit(1), F.lit(cap))
    fits = F.filter(sizes, lambda s: (s <= supply) & (F.least(pool, F.lit(3 * cap + 1) - s) > 2 * s))
    return F.coalesce(F.array_max(fits), F.lit(0))


#: Items of a board whose count is a column, at most.
MOST = 19


def mixed(lanes: dict, strategies: Sequence[str], shares: Sequence[float], count: int, filler: str | None = None) -> dict:
    """Up to ``count`` items of ranked lanes with their strategies: each one's quota in turn, skipping what is taken, then round-robin, then the filler."""
    total = sum(shares)
    exact = [count * x / total for x in shares]
    quota = [int(x) for x in exact]
    for i in sorted(range(len(shares)), key=lambda i: (-round(exact[i] - quota[i], 9), i))[: count - sum(quota)]:
        quota[i] += 1
    taken: dict = {}
    for s, q in zip(strategies, quota, strict=True):
        for v in lanes.get(s, []):
            if q and v not in taken:
                taken[v] = s
                q -= 1
    more = True
    while more and len(taken) < count:
        more = False
        for s in strategies:
            v = next((x for x in lanes.get(s, []) if x not in taken), None)
            if v is not None and len(taken) < count:
                taken[v], more = s, True
    for v in lanes.get(filler, []):
        if len(taken) < count and v not in taken:
            taken[v] = filler
    return dict(list(taken.items())[:count])


def select_mix(supplies: DataFrame, group: list[str], item: str, strategies: Sequence[str], shares: Sequence[float], count: int | str, filler: str | None = None) -> DataFrame:
    """``count`` items a group from ranked supplies by strategy: each strategy's quota in turn, skipping what is taken, then round-robin over what is left.

    ``count`` may name a column of the group, at most ``MOST``. What the strategies leave open comes from the supply named ``filler``.

    ``supplies`` has ``group..., strategy, place, item`` with at most ``count`` rows a strategy, so a group is a bounded board:
    it is cut to that before it is gathered.
    """
    small = top_per_group(supplies.select(*group, "strategy", "place", item).where(F.col("strategy").isin(*strategies, *([filler] if filler else []))), [*group, "strategy"], ["place", item], MOST if isinstance(count, str) else count, "rank")
    kinds = {f.name: f.dataType.simpleString() for f in supplies.schema}

    wanted = count

    def board(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        count = int(key[group.index(wanted)]) if isinstance(wanted, str) else wanted
        lanes = {s: list(x.sort_values(["rank"])[item]) for s, x in pdf.groupby("strategy")}
        rows = list(mixed(lanes, strategies, shares, count, filler).items())
        return pd.DataFrame({**{g: [k] * len(rows) for g, k in zip(group, key, strict=True)}, item: [v for v, _ in rows], "strategy": [s for _, s in rows]})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, item]) + ", strategy string"
    return small.groupBy(*group).applyInPandas(board, schema)
