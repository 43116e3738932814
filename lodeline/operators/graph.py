"""Graph operators over scoped edges ``repo_id, src, dst``: reach, closure, taint, routes, twins, components, communities.

Every traversal runs all sources of all repositories at once: a frontier is joined to the edges, what was seen before is taken out
by an anti join, and each round is written to the checkpoint folder. A source never counts as reached from itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.session import cut


def flip(edges: DataFrame) -> DataFrame:
    return edges.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected: each link in both directions, once."""
    e = edges.select("repo_id", "src", "dst")
    return e.unionByName(flip(e)).distinct()


def _compact(parts: list[DataFrame], most: int = 12) -> list[DataFrame]:
    """The same rows in one part once there are many, so that plans stay short however deep a graph is."""
    return parts if len(parts) < most else [cut(reduce(DataFrame.unionByName, parts))]


def reach(edges: DataFrame, seeds: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """``repo_id, start, node, distance`` for every node that a start reaches along the edges, with its least distance.

    ``seeds`` has ``repo_id, start``; without it every node with an out-edge starts. Cycles are fine. For dependents, flip the edges.
    """
    e = cut(edges.select("repo_id", "src", "dst").distinct())
    first = e.select("repo_id", F.col("src").alias("start"), F.col("dst").alias("node"))
    if seeds is not None:
        first = first.join(seeds.select("repo_id", "start").distinct(), ["repo_id", "start"], "left_semi")
    front = cut(first.where("start <> node").withColumn("distance", F.lit(1)))
    seen = [front]
    depth = 1
    while (max_depth is None or depth < max_depth) and not front.isEmpty():
        depth += 1
        known = reduce(DataFrame.unionByName, seen).select("repo_id", "start", "node")
        step = e.select("repo_id", F.col("src").alias("node"), F.col("dst").alias("next"))
        new = front.select("repo_id", "start", "node").join(step, ["repo_id", "node"]).where("start <> next").select("repo_id", "start", F.col("next").alias("node")).distinct()
        front = cut(new.join(known, ["repo_id", "start", "node"], "left_anti").withColumn("distance", F.lit(depth)))
        seen = _compact([*seen, front])
    return reduce(DataFrame.unionByName, seen)


def cone_sizes(dist: DataFrame) -> DataFrame:
    """Per start: how many nodes it reaches and how far the farthest is."""
    return dist.groupBy("repo_id", F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("breadth"), F.max("distance").alias("radius"))


def layer(count: Column) -> Column:
    """Bit length of a count: 0, 1, 2-3, 4-7, ... give 0, 1, 2, 3, ...; exact, without logarithms."""
    return F.when(count < 1, F.lit(0)).otherwise(F.length(F.bin(count.cast("long"))))


def spread_mark(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """Marked nodes and all that depend on them: ``repo_id, node``. Marks go back over the edges, from dst to src."""
    e = cut(edges.select("repo_id", "src", "dst").distinct())
    front = cut(marked.select("repo_id", "node").distinct())
    seen = [front]
    while not front.isEmpty():
        known = reduce(DataFrame.unionByName, seen)
        new = front.join(e.select("repo_id", F.col("dst").alias("node"), "src"), ["repo_id", "node"]).select("repo_id", F.col("src").alias("node")).distinct()
        front = cut(new.join(known, ["repo_id", "node"], "left_anti"))
        seen = _compact([*seen, front])
    return reduce(DataFrame.unionByName, seen)


def next_hops(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """For each start and node it reaches: the smallest node one step nearer, ``repo_id, start, node, distance, via`` (the start itself at distance 1)."""
    e = edges.select("repo_id", F.col("src").alias("via"), F.col("dst").alias("node")).distinct()
    near = dist.select("repo_id", "start", F.col("node").alias("via"), (F.col("distance") + 1).alias("distance"))
    origin = dist.select("repo_id", "start").distinct().select("repo_id", "start", F.col("start").alias("via"), F.lit(1).alias("distance"))
    steps = near.unionByName(origin).join(e, ["repo_id", "via"])
    return dist.join(steps, ["repo_id", "start", "node", "distance"]).groupBy("repo_id", "start", "node", "distance").agg(F.min("via").alias("via"))


def blockers(dist: DataFrame, unsound: DataFrame, keep: int = 3) -> DataFrame:
    """Starts whose cone (themselves included) holds unsound nodes: how many, and the first ``keep`` by name."""
    own = dist.select("repo_id", "start").distinct().select("repo_id", "start", F.col("start").alias("node"))
    cone = dist.select("repo_id", "start", "node").unionByName(own)
    hit = cone.join(unsound.select("repo_id", "node").distinct(), ["repo_id", "node"], "left_semi")
    w = Window.partitionBy("repo_id", "start").orderBy("node")
    few = hit.withColumn("place", F.row_number().over(w))
    return few.groupBy("repo_id", "start").agg(
        F.count(F.lit(1)).alias("unsound"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= keep, F.col("node")))), " ").alias("first")
    )


def twins(dist: DataFrame) -> DataFrame:
    """Nodes that reach exactly the same nodes: ``repo_id, node, twin_of, size``; ``twin_of`` is the smallest of the class.

    Sets are compared by their size and two 64-bit digests that do not depend on order, so no set is gathered anywhere.
    """
    sets = dist.groupBy("repo_id", "start").agg(
        F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node))").alias("h1"), F.expr("bit_xor(xxhash64(node, 1))").alias("h2")
    )
    g = Window.partitionBy("repo_id", "n", "h1", "h2")
    out = sets.select("repo_id", F.col("start").alias("node"), F.min("start").over(g).alias("twin_of"), F.count(F.lit(1)).over(g).alias("size"))
    return out.where("size > 1")


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Connected parts: ``repo_id, node, part`` with the smallest node of each; nodes without links stand alone.

    Smallest labels go over the links and are shortcut by pointer jumping until none changes.
    """
    e = cut(both_ways(edges).where("src <> dst"))
    base = e.select("repo_id", F.col("src").alias("node")).distinct()
    if nodes is not None:
        base = base.unionByName(nodes.select("repo_id", "node")).distinct()
    label = cut(base.select("repo_id", "node", F.col("node").alias("part")))
    while True:
        near = label.select("repo_id", F.col("node").alias("dst"), "part").join(e, ["repo_id", "dst"]).groupBy("repo_id", F.col("src").alias("node")).agg(F.min("part").alias("low"))
        step = label.join(near, ["repo_id", "node"], "left").select("repo_id", "node", "part", F.least("part", F.coalesce("low", "part")).alias("new"))
        up = step.select("repo_id", F.col("node").alias("new"), F.col("new").alias("up"))
        nxt = cut(step.join(up, ["repo_id", "new"]).select("repo_id", "node", F.col("up").alias("part"), (F.col("up") != F.col("part")).alias("moved")))
        label = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return label


def strongly_connected(edges: DataFrame) -> DataFrame:
    """Strongly connected parts of at least two nodes: ``repo_id, node, part`` (the smallest node). By forward and backward reach."""
    d = reach(edges)
    back = d.select("repo_id", F.col("start").alias("node"), F.col("node").alias("start"))
    mutual = d.select("repo_id", "start", "node").join(back, ["repo_id", "start", "node"], "left_semi")
    return mutual.groupBy("repo_id", F.col("start").alias("node")).agg(F.least(F.min("node"), F.first("start")).alias("part"))


def modularity(edges: DataFrame, labels: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Per repository the modularity of a partition ``repo_id, node, label`` of undirected weighted edges."""
    a = labels.select("repo_id", F.col("node").alias("src"), F.col("label").alias("la"))
    b = labels.select("repo_id", F.col("node").alias("dst"), F.col("label").alias("lb"))
    e = edges.select("repo_id", "src", "dst", "weight").join(a, ["repo_id", "src"]).join(b, ["repo_id", "dst"])
    ends = e.select("repo_id", "weight", F.explode(F.array("la", "lb")).alias("label"))
    total = ends.groupBy("repo_id", "label").agg(F.sum("weight").alias("tot"))
    inner = e.where("la = lb").groupBy("repo_id", F.col("la").alias("label")).agg(F.sum(2 * F.col("weight")).alias("inner"))
    m2 = e.groupBy("repo_id").agg(F.sum(2 * F.col("weight")).alias("m2"))
    share = F.coalesce("inner", F.lit(0)) / F.col("m2") - F.lit(gamma) * F.pow(F.col("tot") / F.col("m2"), F.lit(2.0))
    return total.join(inner, ["repo_id", "label"], "left").join(m2, "repo_id").groupBy("repo_id").agg(F.sum(share).alias("modularity"))


def communities(edges: DataFrame, rounds: int = 10, levels: int = 3, gamma: float = 1.0) -> DataFrame:
    """A partition of high modularity: ``repo_id, node, label``.

    Local moving over DataFrames: in each round the nodes of one hash half look at the communities of their neighbours and take the one of
    largest gain (ties to the smaller label, staying put when nothing is gained); then communities become nodes and the rounds begin again.
    Halves alternate, so two neighbours never swap for ever. The order of visits differs from a sequential pass, so labels may too.
    A level ends when both halves are quiet, after ``rounds`` halves at the latest: a bound on the work, not a settled state.
    """
    e = cut(edges.where("src <> dst").select("repo_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("repo_id", "src", "dst").agg(F.sum("weight").alias("weight")))
    nodes = e.select("repo_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    result = cut(nodes.select("repo_id", "node", F.col("node").alias("label")))
    loops = e.limit(0)
    for _ in range(levels):
        links = e.select("repo_id", "src", "dst", "weight").unionByName(e.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        ends = links.select("repo_id", F.col("src").alias("node"), "weight").unionByName(loops.select("repo_id", F.col("src").alias("node"), (2 * F.col("weight")).alias("weight")))
        degree = cut(ends.groupBy("repo_id", "node").agg(F.sum("weight").alias("k")))
        m2 = degree.groupBy("repo_id").agg(F.sum("k").alias("m2"))
        at = cut(degree.select("repo_id", "node", F.col("node").alias("label")))
        quiet = 0
        for r in range(rounds):
            tot = at.join(degree, ["repo_id", "node"]).groupBy("repo_id", "label").agg(F.sum("k").alias("tot"))
            into = links.join(at.select("repo_id", F.col("node").alias("dst"), "label"), ["repo_id", "dst"]).groupBy("repo_id", F.col("src").alias("node"), "label").agg(F.sum("weight").alias("w"))
            stay = at.select("repo_id", "node", "label", F.lit(0).cast("long").alias("w"))
            choice = into.unionByName(stay).groupBy("repo_id", "node", "label").agg(F.sum("w").alias("w"))
            scored = choice.join(tot, ["repo_id", "label"]).join(degree, ["repo_id", "node"]).join(m2, "repo_id").join(at.withColumnRenamed("label", "now"), ["repo_id", "node"])
            rest = F.col("tot") - F.when(F.col("label") == F.col("now"), F.col("k")).otherwise(F.lit(0))
            gain = F.col("w") - F.lit(gamma) * F.col("k") * rest / F.col("m2")
            best = scored.groupBy("repo_id", "node", "now").agg(
                F.max(F.struct(F.round(gain, 9).alias("g"), (F.col("label") == F.col("now")).alias("same"))).alias("b"),
                F.min(F.struct((-F.round(gain, 9)).alias("g"), "label")).alias("c"),
            )
            turn = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
            new = F.when(turn & ~F.col("b.same"), F.col("c.label")).otherwise(F.col("now"))
            moved = cut(best.select("repo_id", "node", new.alias("label"), (new != F.col("now")).alias("moved")))
            at = moved.drop("moved")
            quiet = quiet + 1 if moved.where("moved").isEmpty() else 0
            if quiet == 2:
                break
        result = cut(result.join(at.select("repo_id", F.col("node").alias("label"), F.col("label").alias("up")), ["repo_id", "label"]).select("repo_id", "node", F.col("up").alias("label")))
        a = at.select("repo_id", F.col("node").alias("src"), F.col("label").alias("la"))
        b = at.select("repo_id", F.col("node").alias("dst"), F.col("label").alias("lb"))
        up = e.join(a, ["repo_id", "src"]).join(b, ["repo_id", "dst"]).select("repo_id", F.least("la", "lb").alias("src"), F.greatest("la", "lb").alias("dst"), "weight")
        old = loops.join(a, ["repo_id", "src"]).select("repo_id", F.col("la").alias("src"), F.col("la").alias("dst"), "weight") if loops.columns else loops
        merged = cut(up.unionByName(old).groupBy("repo_id", "src", "dst").agg(F.sum("weight").alias("weight")))
        fewer = at.where("node <> label").isEmpty()
        e, loops = merged.where("src <> dst"), merged.where("src = dst")
        if fewer or e.isEmpty():
            break
    return result


def split_disconnected(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Communities cut into their connected parts: ``repo_id, node, label`` with the smallest node of each part."""
    a = labels.select("repo_id", F.col("node").alias("src"), F.col("label").alias("la"))
    b = labels.select("repo_id", F.col("node").alias("dst"), F.col("label").alias("lb"))
    inner = edges.select("repo_id", "src", "dst").join(a, ["repo_id", "src"]).join(b, ["repo_id", "dst"]).where("la = lb").select("repo_id", "src", "dst")
    return connected(inner, labels).select("repo_id", "node", F.col("part").alias("label"))


def absorb_small(edges: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """Communities of fewer than ``least`` members join the neighbour they have most edges with (the lower label on a tie).

    In each round only small communities whose target is no small community of a larger label move, so two never swap; one without
    neighbours stays as it is. A round that moves anything leaves fewer communities, so the rounds end.
    """
    at = cut(labels.select("repo_id", "node", "label"))
    while True:
        size = at.groupBy("repo_id", "label").agg(F.count(F.lit(1)).alias("n"))
        a = at.select("repo_id", F.col("node").alias("src"), F.col("label").alias("la"))
        b = at.select("repo_id", F.col("node").alias("dst"), F.col("label").alias("lb"))
        cross = both_ways(edges).join(a, ["repo_id", "src"]).join(b, ["repo_id", "dst"]).where("la <> lb").groupBy("repo_id", "la", "lb").agg(F.count(F.lit(1)).alias("w"))
        small = size.where(F.col("n") < least).select("repo_id", F.col("label").alias("la"), F.col("n").alias("na"))
        there = size.select("repo_id", F.col("label").alias("lb"), F.col("n").alias("nb"))
        best = cross.join(small, ["repo_id", "la"]).join(there, ["repo_id", "lb"]).groupBy("repo_id", "la").agg(F.min(F.struct((-F.col("w")).alias("w"), "lb", "nb")).alias("t"))
        move = best.where((F.col("t.nb") >= least) | (F.col("t.lb") < F.col("la"))).select("repo_id", F.col("la").alias("label"), F.col("t.lb").alias("to"))
        if move.isEmpty():
            return at
        at = cut(at.join(move, ["repo_id", "label"], "left").select("repo_id", "node", F.coalesce("to", "label").alias("label")))


def describe(labels: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The directory that fits each community best: F1 of the members under it, deepest on ties, then by name.

    ``labels`` is ``repo_id, node, label``, ``prefixes`` ``repo_id, node, dir, depth`` with each directory above each node.
    """
    size = labels.groupBy("repo_id", "label").agg(F.count(F.lit(1)).alias("members"))
    under = prefixes.groupBy("repo_id", "dir").agg(F.count(F.lit(1)).alias("under"))
    both = labels.join(prefixes, ["repo_id", "node"]).groupBy("repo_id", "label", "dir", "depth").agg(F.count(F.lit(1)).alias("overlap"))
    f1 = 2 * F.col("overlap") / (F.col("under") + F.col("members"))
    w = Window.partitionBy("repo_id", "label").orderBy(F.desc("f1"), F.desc("depth"), "dir")
    scored = both.join(under, ["repo_id", "dir"]).join(size, ["repo_id", "label"]).withColumn("f1", f1)
    return scored.withColumn("place", F.row_number().over(w)).where("place = 1").select("repo_id", "label", "dir", "overlap", "under", "members", "f1")


def claim_labels(described: DataFrame) -> DataFrame:
    """One owner a directory: the community with the largest overlap share (at least half its members) takes its name, the others get the name with a number."""
    share = F.col("overlap") / F.col("members")
    w = Window.partitionBy("repo_id", "dir").orderBy(F.desc("share"), F.desc("members"), "label")
    ranked = described.withColumn("share", share).withColumn("place", F.row_number().over(w))
    name = F.when((F.col("place") == 1) & (F.col("share") >= 0.5), F.col("dir")).when(F.col("place") == 1, F.concat(F.lit("around "), F.col("dir"))).otherwise(F.concat("dir", F.lit(" ("), F.col("place"), F.lit(")")))
    return ranked.select("repo_id", "label", name.alias("name"), "share")


def rand_index(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rand index of two partitions ``repo_id, node, label`` of the same nodes and the agreement that chance would give, by repository."""
    j = left.select("repo_id", "node", F.col("label").alias("a")).join(right.select("repo_id", "node", F.col("label").alias("b")), ["repo_id", "node"])
    pair = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = j.groupBy("repo_id", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    both = cells.groupBy("repo_id").agg(pair("c").alias("both"), F.sum("c").alias("n"))
    rows = cells.groupBy("repo_id", "a").agg(F.sum("c").alias("c")).groupBy("repo_id").agg(pair("c").alias("in_a"))
    cols = cells.groupBy("repo_id", "b").agg(F.sum("c").alias("c")).groupBy("repo_id").agg(pair("c").alias("in_b"))
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    pa, pb = F.col("in_a") / all_pairs, F.col("in_b") / all_pairs
    return (
        both.join(rows, "repo_id")
        .join(cols, "repo_id")
        .where("n > 1")
        .select("repo_id", "n", ((all_pairs + 2 * F.col("both") - F.col("in_a") - F.col("in_b")) / all_pairs).alias("rand"), (pa * pb + (1 - pa) * (1 - pb)).alias("chance"))
    )
