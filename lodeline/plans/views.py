"""The relations the queries start from, as DataFrames and as the same relations in SQL.

Every relation is scoped by ``repo_id``: one plan serves all repositories at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.paths import clean_path
from lodeline.session import table


def limits(spark: SparkSession, d: str) -> DataFrame:
    """Limits in force for every repository that has commits; what is null or missing takes the default row's value."""
    t = table(spark, d, "history_limits")
    names = [c for c in t.columns if c != "repo_id"]
    own = t.where("repo_id <> 0").groupBy("repo_id").agg(*[F.max(c).alias(c) for c in names])
    # one row: the default
    default = t.where("repo_id = 0").agg(*[F.max(c).alias(f"d_{c}") for c in names])
    repos = table(spark, d, "git_commits").select("repo_id").where("repo_id is not null").distinct()
    return repos.join(own, "repo_id", "left").join(F.broadcast(default)).select("repo_id", *[F.coalesce(c, f"d_{c}").alias(c) for c in names])


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Each commit once, as last delivered: ``repo_id, sha, commit_date, author, subject, files``; files are a sorted set."""
    files = F.array_sort(F.array_distinct(F.transform(F.filter("files", lambda f: f.isNotNull()), clean_path)))
    t = table(spark, d, "git_commits").where("repo_id is not null and sha is not null")
    last = F.max_by(F.struct("commit_date", F.lower(F.trim("author")).alias("author"), "subject", F.coalesce(files, F.array().cast("array<string>")).alias("files")), "ingested_at")
    return t.groupBy("repo_id", "sha").agg(last.alias("c")).select("repo_id", "sha", "c.*")


def touches(spark: SparkSession, d: str, narrow: bool = False) -> DataFrame:
    """``repo_id, sha, commit_date, author, path``, a row for each file of each commit; ``narrow`` leaves wide commits out."""
    c = commits(spark, d)
    if narrow:
        c = c.join(limits(spark, d).select("repo_id", "wide_commit_files"), "repo_id").where(F.size("files") <= F.col("wide_commit_files"))
    return c.select("repo_id", "sha", "commit_date", "author", F.explode("files").alias("path"))


def cochange(spark: SparkSession, d: str) -> DataFrame:
    """``repo_id, a, b, n``: commits that touch both files, wide ones left out; ``a < b``. Identical file sets count once, weighted."""
    c = commits(spark, d).join(limits(spark, d).select("repo_id", "wide_commit_files"), "repo_id")
    sets = c.where(F.size("files").between(2, F.col("wide_commit_files"))).groupBy("repo_id", "files").agg(F.count(F.lit(1)).alias("w"))
    first = sets.select("repo_id", "w", "files", F.posexplode("files").alias("i", "a"))
    both = first.select("repo_id", "w", "a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("b"))
    return both.groupBy("repo_id", "a", "b").agg(F.sum("w").alias("n"))


def edges(spark: SparkSession, d: str, least: int = 2) -> DataFrame:
    """``repo_id, src, dst, weight``: a directed acyclic dependency graph, from the later to the earlier path of a pair seen ``least`` times."""
    return cochange(spark, d).where(F.col("n") >= least).select("repo_id", F.col("b").alias("src"), F.col("a").alias("dst"), F.col("n").alias("weight"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """Each walked file once, as last delivered; path cleaned, language cleaned."""
    t = table(spark, d, "walked_files").where("file_id is not null")
    last = F.max_by(F.struct("repo_id", clean_path("path").alias("path"), F.lower(F.trim("lang")).alias("lang"), "bytes", "loc"), "walked_at")
    return t.groupBy("file_id").agg(last.alias("f")).select("file_id", "f.*")


CLEAN = "regexp_replace({0}, '^(\\./)+', '')"
#: The same relations in SQL, to be put in front of a query.
SQL = f"""
WITH RECURSIVE lim0 AS (SELECT * FROM history_limits WHERE repo_id = 0),
limits AS (SELECT g.repo_id, coalesce(l.max_commits, z.max_commits) AS max_commits, coalesce(l.max_commit_files, z.max_commit_files) AS max_commit_files,
  coalesce(l.wide_commit_files, z.wide_commit_files) AS wide_commit_files, coalesce(l.max_co_change_pairs, z.max_co_change_pairs) AS max_co_change_pairs,
  coalesce(l.min_co_change_count, z.min_co_change_count) AS min_co_change_count
  FROM (SELECT DISTINCT repo_id FROM git_commits WHERE repo_id IS NOT NULL) g
  LEFT JOIN history_limits l ON l.repo_id = g.repo_id CROSS JOIN lim0 z),
commits AS (SELECT DISTINCT ON (repo_id, sha) repo_id, sha, commit_date, lower(trim(author)) AS author, subject,
  coalesce(list_sort(list_distinct(list_transform(list_filter(files, lambda x: x IS NOT NULL), lambda x: {CLEAN.format('x')}))), []) AS files
  FROM git_commits WHERE repo_id IS NOT NULL AND sha IS NOT NULL ORDER BY repo_id, sha, ingested_at DESC),
touches AS (SELECT repo_id, sha, commit_date, author, unnest(files) AS path FROM commits),
narrow AS (SELECT t.* FROM touches t JOIN commits c USING (repo_id, sha) JOIN limits l ON l.repo_id = t.repo_id WHERE len(c.files) <= l.wide_commit_files),
cochange AS (SELECT x.repo_id, x.path AS a, y.path AS b, count(*) AS n FROM narrow x JOIN narrow y ON x.repo_id = y.repo_id AND x.sha = y.sha AND x.path < y.path GROUP BY ALL),
edges AS (SELECT repo_id, b AS src, a AS dst, n AS weight FROM cochange WHERE n >= 2),
files AS (SELECT DISTINCT ON (file_id) file_id, repo_id, {CLEAN.format('path')} AS path, lower(trim(lang)) AS lang, bytes, loc
  FROM walked_files WHERE file_id IS NOT NULL ORDER BY file_id, walked_at DESC)
"""
