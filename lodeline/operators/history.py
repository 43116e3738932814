"""Change history: touched sets, per-file aggregates, co-change with its cap and floor, rename lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.session import cut


def touched_sets(commits: DataFrame, limits: DataFrame) -> DataFrame:
    """Per commit the number of files, whether it is wide, the files kept under the cap and how many were dropped."""
    j = commits.join(limits.select("repo_id", "wide_commit_files", "max_commit_files"), "repo_id")
    n = F.size("files")
    return j.select(
        "repo_id",
        "sha",
        n.alias("n_files"),
        (n > F.col("wide_commit_files")).alias("wide"),
        F.slice("files", F.lit(1), F.col("max_commit_files")).alias("kept"),
        F.greatest(n - F.col("max_commit_files"), F.lit(0)).alias("dropped"),
    )


def file_history(files: DataFrame, touches: DataFrame) -> DataFrame:
    """Churn, distinct authors, first and last date of each file; files never touched get zeros and nulls."""
    agg = touches.groupBy("repo_id", "path").agg(
        F.count(F.lit(1)).alias("churn"), F.count_distinct("author").alias("authors"), F.min("commit_date").alias("first_seen"), F.max("commit_date").alias("last_seen")
    )
    zero = F.lit(0).cast("long")
    return (
        files.select("repo_id", "path")
        .distinct()
        .join(agg, ["repo_id", "path"], "left")
        .select("repo_id", "path", F.coalesce("churn", zero).alias("churn"), F.coalesce("authors", zero).alias("authors"), "first_seen", "last_seen")
    )


def windows(commits: DataFrame, limits: DataFrame) -> DataFrame:
    """Per repository: first and last commit date, commits walked, retained under the cap and dropped."""
    g = commits.groupBy("repo_id").agg(F.min("commit_date").alias("from_date"), F.max("commit_date").alias("to_date"), F.count(F.lit(1)).alias("walked"))
    kept = F.least(F.col("walked"), F.col("max_commits").cast("long"))
    return g.join(limits.select("repo_id", "max_commits"), "repo_id").select("repo_id", "from_date", "to_date", "walked", kept.alias("retained"), (F.col("walked") - kept).alias("dropped"))


def retained(commits: DataFrame, limits: DataFrame) -> DataFrame:
    """The latest commits of each repository up to its cap, in canonical order (date descending, then sha)."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("commit_date"), "sha")
    return commits.join(limits.select("repo_id", "max_commits"), "repo_id").withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("max_commits")).drop("max_commits")


def capped_pairs(pairs: DataFrame, limits: DataFrame) -> DataFrame:
    """Pairs seen at least ``min_co_change_count`` times, the strongest up to the repository's cap, with their place."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("n"), "a", "b")
    j = pairs.join(limits.select("repo_id", "min_co_change_count", "max_co_change_pairs"), "repo_id").where(F.col("n") >= F.col("min_co_change_count"))
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("max_co_change_pairs")).select("repo_id", "a", "b", "n", "place")


def floors(pairs: DataFrame, limits: DataFrame) -> DataFrame:
    """The count from which an absent pair is proof of absence: one over the last kept count where the cap bit, else the least count.

    Pairs are counted by how often they were seen, and the cap is found among these counts: no repository's pairs are sorted.
    """
    j = pairs.join(limits.select("repo_id", "min_co_change_count", "max_co_change_pairs"), "repo_id").where(F.col("n") >= F.col("min_co_change_count"))
    counts = j.groupBy("repo_id", "n").agg(F.count(F.lit(1)).alias("c"), F.max("max_co_change_pairs").alias("cap"), F.max("min_co_change_count").alias("least"))
    above = Window.partitionBy("repo_id").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    g = counts.withColumn("before", F.coalesce(F.sum("c").over(above), F.lit(0))).groupBy("repo_id").agg(
        F.sum("c").alias("pairs"),
        F.max("cap").alias("cap"),
        F.min(F.when(F.col("before") < F.col("cap"), F.col("n"))).alias("last_kept"),
        F.max("least").alias("least"),
    )
    bit = F.col("pairs") > F.col("cap")
    return g.select("repo_id", "pairs", F.least("pairs", "cap").alias("kept"), bit.alias("cap_bit"), F.when(bit, F.col("last_kept") + 1).otherwise(F.col("least").cast("long")).alias("floor"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """A row for each file of each pair: ``repo_id, subject, partner, n``."""
    way = lambda s, p: F.struct(F.col(s).alias("subject"), F.col(p).alias("partner"))
    return pairs.select("repo_id", "n", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).select("repo_id", "w.subject", "w.partner", "n")


def rank_partners(pairs: DataFrame, floor: DataFrame, top: int) -> DataFrame:
    """The ``top`` partners of each file: most common commits first, then partners with fewer partners of their own, then by path."""
    rows = both_ways(pairs)
    width = rows.groupBy("repo_id", F.col("subject").alias("partner")).agg(F.count(F.lit(1)).alias("width"))
    w = Window.partitionBy("repo_id", "subject").orderBy(F.desc("n"), "width", "partner")
    j = rows.join(floor.select("repo_id", "floor"), "repo_id").where(F.col("n") >= F.col("floor")).join(width, ["repo_id", "partner"])
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("repo_id", "subject", "partner", "n", "width", "place")


def commit_reasons(commits: DataFrame, repos: DataFrame, limits: DataFrame) -> DataFrame:
    """Why a commit is not usable, in the order shallow, truncated, wide, empty; null when it is usable.

    ``repos`` has ``repo_id, root`` (null for shallow clones). A commit of exactly the file cap is truncated, one of exactly the wide
    limit is not wide.
    """
    n = F.size("files")
    why = (
        F.when(F.col("root").isNull(), "shallow")
        .when(n >= F.col("max_commit_files"), "truncated")
        .when(n > F.col("wide_commit_files"), "wide")
        .when(n == 0, "empty")
    )
    one = repos.groupBy("repo_id").agg(F.max("root").alias("root"))
    return commits.join(one, "repo_id", "left").join(limits.select("repo_id", "max_commit_files", "wide_commit_files"), "repo_id").select("repo_id", "sha", why.alias("reason"))


def rename_origins(renames: DataFrame) -> DataFrame:
    """Where each renamed file comes from: ``repo_id, path, origin, hops, contested``.

    ``renames`` has ``repo_id, seq, from_path, to_path``; ``seq`` orders the events of a repository. For the last event that made a path, the
    chain goes back over the last event before it that made its source. Chains are followed by pointer jumping over the events, so a long history
    of one repository is not walked in one task. Two paths of one origin contest it.
    """
    e = renames.where("from_path <> to_path")
    # events meet on a path: those that make it, and those that move it away
    made = e.select("repo_id", F.col("to_path").alias("path"), "seq", F.lit(0).alias("leaves"), "from_path")
    left = e.select("repo_id", F.col("from_path").alias("path"), "seq", F.lit(1).alias("leaves"), "from_path")
    before = Window.partitionBy("repo_id", "path").orderBy("seq", F.desc("leaves")).rowsBetween(Window.unboundedPreceding, -1)
    seen = made.unionByName(left).withColumn("prev", F.last(F.when(F.col("leaves") == 0, F.col("seq")), ignorenulls=True).over(before))
    link = seen.where("leaves = 1").select("repo_id", "seq", "path", F.col("prev").alias("up"))
    at = cut(link.select("repo_id", "seq", "up", F.when(F.col("up").isNull(), F.col("path")).alias("origin"), F.lit(1).cast("long").alias("hops")))
    while not at.where("up is not null").isEmpty():
        nxt = at.select("repo_id", F.col("seq").alias("up"), F.col("up").alias("up2"), F.col("origin").alias("origin2"), F.col("hops").alias("hops2"))
        done, open_ = at.where("up is null"), at.where("up is not null")
        moved = open_.join(nxt, ["repo_id", "up"]).select("repo_id", "seq", F.col("up2").alias("up"), F.col("origin2").alias("origin"), (F.col("hops") + F.col("hops2")).alias("hops"))
        at = cut(done.unionByName(moved))
    last = made.groupBy("repo_id", "path").agg(F.max("seq").alias("seq"))
    out = last.join(at.select("repo_id", "seq", "origin", "hops"), ["repo_id", "seq"])
    claims = Window.partitionBy("repo_id", "origin")
    return out.select("repo_id", "path", "origin", "hops", (F.count(F.lit(1)).over(claims) > 1).alias("contested"))


def gaps(touches: DataFrame) -> DataFrame:
    """For each touch of a file, in order of date and sha: its ordinal and the whole days since the one before."""
    w = Window.partitionBy("repo_id", "path").orderBy("commit_date", "sha")
    return touches.select("repo_id", "path", "sha", "commit_date", F.row_number().over(w).alias("ordinal"), F.date_diff("commit_date", F.lag("commit_date").over(w)).alias("gap_days"))
