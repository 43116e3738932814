"""A force layout as rounds of joins: springs along edges, repulsion between neighbours in a grid, cohesion of labels, gravity, cooling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.functions.scoring import round2
from lodeline.session import cut

LENGTH, COHESION, GRAVITY = 60.0, 0.32, 0.01


def force_layout(edges: DataFrame, labels: DataFrame, rounds: int = 30) -> DataFrame:
    """``repo_id, node, x, y`` for every node of ``labels`` (``repo_id, node, label``), two decimals, centred by repository.

    Starts on a grid with a seeded shift by the node's hash. Repulsion reaches 2.5 lengths and is looked up through grid cells of that size,
    where a cell pushes with its centre and its number of nodes, so a crowded cell costs as much as an empty one.
    """
    side = F.ceil(F.sqrt(F.count(F.lit(1)).over(_per_repo()))) + 1
    h = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1000)) / 1000.0 - 0.5
    i = F.row_number().over(_per_repo("node")) - 1
    at = cut(labels.select("repo_id", "node", "label", ((i % side) * LENGTH + h(1) * 10).alias("x"), (F.floor(i / side) * LENGTH + h(2) * 10).alias("y")))
    e = cut(edges.select("repo_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), "weight"), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))).alias("e")).select("repo_id", "e.*"))
    cell = 2.5 * LENGTH
    for r in range(rounds):
        heat = LENGTH * (1 - r / rounds)
        o = at.select("repo_id", F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        j = e.join(o, ["repo_id", "other"]).join(at.select("repo_id", "node", "x", "y"), ["repo_id", "node"])
        pull = j.groupBy("repo_id", "node").agg(F.avg(F.col("ox") - F.col("x")).alias("sx"), F.avg(F.col("oy") - F.col("y")).alias("sy"))
        g = at.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
        crowd = g.groupBy("repo_id", "gx", "gy").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))
        near = F.explode(F.array(*[F.struct((F.col("gx") + a).alias("gx"), (F.col("gy") + b).alias("gy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("c")
        dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
        d2 = F.greatest(dx * dx + dy * dy, F.lit(1.0))
        push = g.select("repo_id", "node", "x", "y", near).select("repo_id", "node", "x", "y", "c.gx", "c.gy").join(crowd, ["repo_id", "gx", "gy"])
        push = push.groupBy("repo_id", "node").agg(F.sum(dx * F.col("n") * LENGTH * LENGTH / (d2 * 8)).alias("px"), F.sum(dy * F.col("n") * LENGTH * LENGTH / (d2 * 8)).alias("py"))
        centre = at.groupBy("repo_id", "label").agg(F.avg("x").alias("lx"), F.avg("y").alias("ly"))
        mid = at.groupBy("repo_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
        k = at.join(pull, ["repo_id", "node"], "left").join(push, ["repo_id", "node"], "left").join(centre, ["repo_id", "label"]).join(mid, "repo_id").na.fill(0.0, ["sx", "sy", "px", "py"])
        fx = 0.5 * F.col("sx") + F.col("px") + COHESION * (F.col("lx") - F.col("x")) - GRAVITY * (F.col("x") - F.col("mx"))
        fy = 0.5 * F.col("sy") + F.col("py") + COHESION * (F.col("ly") - F.col("y")) - GRAVITY * (F.col("y") - F.col("my"))
        size = F.greatest(F.sqrt(fx * fx + fy * fy), F.lit(1e-9))
        step = F.least(size, F.lit(heat)) / size
        at = cut(k.select("repo_id", "node", "label", (F.col("x") + fx * step).alias("x"), (F.col("y") + fy * step).alias("y")))
    mid = at.groupBy("repo_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return at.join(mid, "repo_id").select("repo_id", "node", "label", round2(F.col("x") - F.col("mx")).alias("x"), round2(F.col("y") - F.col("my")).alias("y"))


def _per_repo(order: str | None = None):  # noqa: ANN202
    from pyspark.sql.window import Window

    w = Window.partitionBy("repo_id")
    return w.orderBy(order) if order else w
