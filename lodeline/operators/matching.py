"""Greedy one-to-one matching, votes and claims: sequential rules put as rounds in which all undisputed choices are made at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.session import cut


def greedy_matching(cells: DataFrame, scope: list[str], left: str, right: str, weight: str) -> DataFrame:
    """The pairs that taking the heaviest cell again and again would take (ties by left, then right).

    In each round every cell that comes first both in its row and in its column is taken: no heavier cell can ever bar it, so the result
    is that of the one-by-one rule.
    """
    open_ = cut(cells.select(*scope, left, right, weight))
    out = open_.limit(0)
    while True:
        by = [F.desc(weight), left, right]
        ranked = open_.withColumn("r", F.row_number().over(Window.partitionBy(*scope, left).orderBy(*by))).withColumn("c", F.row_number().over(Window.partitionBy(*scope, right).orderBy(*by)))
        taken = cut(ranked.where("r = 1 and c = 1").drop("r", "c"))
        if taken.isEmpty():
            return out
        out = out.unionByName(taken)
        open_ = cut(open_.join(taken.select(*scope, left), [*scope, left], "left_anti").join(taken.select(*scope, right), [*scope, right], "left_anti"))


def recoloured_share(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per repository the share of nodes whose label is not the match of their old label. Both sides are ``repo_id, node, label``."""
    j = left.select("repo_id", "node", F.col("label").alias("a")).join(right.select("repo_id", "node", F.col("label").alias("b")), ["repo_id", "node"])
    cells = j.groupBy("repo_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    kept = greedy_matching(cells, ["repo_id"], "a", "b", "n").groupBy("repo_id").agg(F.sum("n").alias("kept"))
    total = cells.groupBy("repo_id").agg(F.sum("n").alias("nodes"))
    return total.join(kept, "repo_id", "left").select("repo_id", "nodes", (1 - F.coalesce("kept", F.lit(0)) / F.col("nodes")).alias("recoloured"))


def majority_origin(members: DataFrame) -> DataFrame:
    """The origin directory of each package: one that more than half of its members come from, first by name; else the package itself.

    ``members`` has ``repo_id, package, origin_dir``.
    """
    n = members.groupBy("repo_id", "package").agg(F.count(F.lit(1)).alias("n"))
    votes = members.groupBy("repo_id", "package", "origin_dir").agg(F.count(F.lit(1)).alias("v"))
    best = votes.join(n, ["repo_id", "package"]).where(2 * F.col("v") > F.col("n")).groupBy("repo_id", "package").agg(F.min("origin_dir").alias("origin"))
    return n.join(best, ["repo_id", "package"], "left").select("repo_id", "package", F.coalesce("origin", "package").alias("origin"))


def claim_origins(proposed: DataFrame, live: DataFrame) -> DataFrame:
    """One claimant an origin: no origin that is itself live (unless it is the claimant's own key), the first key by name where several ask; the others keep their key.

    ``proposed`` has ``repo_id, key, origin``; ``live`` ``repo_id, key``.
    """
    own = F.col("key") == F.col("origin")
    taken = live.select("repo_id", F.col("key").alias("origin"), F.lit(True).alias("is_live"))
    j = proposed.join(taken, ["repo_id", "origin"], "left").withColumn("free", own | F.col("is_live").isNull())
    w = Window.partitionBy("repo_id", "origin").orderBy(F.desc("free"), "key")
    ranked = j.withColumn("place", F.row_number().over(w))
    return ranked.select("repo_id", "key", F.when(F.col("free") & (F.col("place") == 1), F.col("origin")).otherwise(F.col("key")).alias("origin"))


def go_targets(refs: DataFrame, modules: DataFrame) -> DataFrame:
    """Go imports against the modules of the repository: ``repo_id, specifier, module, directory`` of the longest module path that prefixes the import.

    ``refs`` has ``repo_id, specifier``, ``modules`` ``repo_id, module, directory``. Prefixes of an import are few: they are made and joined.
    """
    p = F.split("specifier", "/", -1)
    r = refs.select("repo_id", "specifier").distinct()
    prefixes = r.select("repo_id", "specifier", F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).alias("module"))
    best = prefixes.join(modules, ["repo_id", "module"]).groupBy("repo_id", "specifier").agg(F.max_by(F.struct("module", "directory"), F.length("module")).alias("b"))
    rest = F.substring("specifier", F.length("b.module") + 2, F.length("specifier"))
    return best.select("repo_id", "specifier", F.col("b.module").alias("module"), F.concat_ws("/", F.nullif(F.col("b.directory"), F.lit("")), F.nullif(rest, F.lit(""))).alias("directory"))


def package_facts(manifests: DataFrame) -> DataFrame:
    """``path, name, dependencies, workspaces`` of package manifests: names sorted, of all dependency kinds; null fields where the text is no JSON."""
    schema = "name string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>, workspaces array<string>"
    none = F.array().cast("array<string>")
    keys = lambda c: F.coalesce(F.map_keys(c), none)
    j = manifests.select("path", F.from_json("text", schema).alias("j"))
    deps = F.array_sort(F.array_distinct(F.concat(*[keys(f"j.{k}") for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")])))
    return j.select("path", F.col("j.name").alias("name"), deps.alias("dependencies"), F.coalesce("j.workspaces", none).alias("workspaces"))
