"""Consolidating pairwise matches into groups: connected components over any number of links.

Method: every node takes the smallest label among itself and its neighbours, pointer jumping follows these labels to
their roots, the links are rewritten to the roots and deduplicated, and the rounds go on until no link joins two
different labels. A round at least merges every node that is no local minimum, so links shrink geometrically; jumping
makes long chains take logarithmically many joins. Each step is written to the shared checkpoint folder.

Labels only ever fall to a smaller label of the same component, so the last label is the component's smallest node.
Nothing is collected. A hub with a third of all links is aggregated map-side and the relabelling of links is salted; where the nodes of a giant
component meet their one root, that root's row is broadcast to them (``split_lookup``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.skew import salted_lookup, split_lookup
from lodeline.session import cut


def components(links: DataFrame, a: str, b: str, scope: str | None = None, max_rounds: int = 64) -> DataFrame:
    """``scope, node, group`` for every node of a link between two different nodes.

    ``links`` may hold repeats, both directions, nulls and self-links; the last two are no links. With ``scope`` nodes of
    different scopes never meet and equal names in two scopes are two nodes (a null scope links nothing); without it the
    result has no such column. ``group`` is the smallest node of the component in byte (or number) order. An empty table
    gives an empty result.
    """
    s = "__scope"
    base = links.select((F.col(scope) if scope else F.lit(0)).alias(s), F.col(a).alias("x"), F.col(b).alias("y"))
    edges = cut(base.where(F.col(s).isNotNull() & (F.col("x") != F.col("y"))).select(s, F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    found: DataFrame | None = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        way = lambda n, o: F.struct(F.col(n).alias("node"), F.col(o).alias("other"))
        ends = edges.select(s, F.explode(F.array(way("u", "v"), way("v", "u"))).alias("e"))
        near = ends.groupBy(s, F.col("e.node").alias("node")).agg(F.min("e.other").alias("low"), F.count(F.lit(1)).alias("links"))
        label = cut(near.select(s, "node", F.least("node", "low").alias("root"), "links"))
        label = _jump(label, s)
        if found is None:
            found = label.select(s, "node", "root")
        else:
            # every root without a row of its own keeps itself
            step = label.select(s, F.col("node").alias("root"), F.col("root").alias("next"))
            rest = found.select(s, "root").distinct().join(step, [s, "root"], "left_anti").select(s, "root", F.col("root").alias("next"))
            found = cut(split_lookup(found, cut(step.unionByName(rest)), [s, "root"]).select(s, "node", F.col("next").alias("root")))
        for end in ("u", "v"):
            to = label.select(s, F.col("node").alias(end), F.col("root").alias("to"), "links")
            edges = salted_lookup(edges, to, [s, end], "links", ["v" if end == "u" else "u"]).drop(end, "links").withColumnRenamed("to", end)
        edges = cut(
            edges.where(F.col("u") != F.col("v")).select(s, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        )
    else:
        raise RuntimeError(f"links are left after {max_rounds} rounds")
    if found is None:
        found = edges.select(s, F.col("u").alias("node"), F.col("v").alias("root"))
    out = found.select(s, "node", F.col("root").alias("group"))
    return out.withColumnRenamed(s, scope) if scope else out.drop(s)


def _jump(label: DataFrame, s: str) -> DataFrame:
    """Follow every label to its root: root <- root of root until none changes."""
    while True:
        up = label.select(s, F.col("node").alias("root"), F.col("root").alias("next"))
        moved = cut(split_lookup(label, up, [s, "root"]).select(s, "node", F.col("next").alias("root"), "links", (F.col("next") != F.col("root")).alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        label = moved.drop("moved")
