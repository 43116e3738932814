"""The training-data queries over the project's tables, and their SQL where it exists."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.paths import clean_path, extension
from lodeline.llm.components import components
from lodeline.llm.cooccurrence import pairs
from lodeline.llm.heavy_hitters import frequent
from lodeline.llm.leakage import leaks
from lodeline.llm.mixture import Mixture, count_tokens
from lodeline.llm.provenance import not_handwritten
from lodeline.llm.stuffing import language, stuffed
from lodeline.llm.validity import judged, rates
from lodeline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _limits(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """The limits per repository with the default row's values filled in, and the default row."""
    t = table(spark, d, "history_limits")
    names = [c for c in t.columns if c != "repo_id"]
    default = t.where("repo_id = 0").agg(*[F.max(c).alias(c) for c in names]).first().asDict()
    filled = t.where("repo_id <> 0").groupBy("repo_id").agg(*[F.coalesce(F.max(c), F.lit(default[c])).alias(c) for c in names])
    return filled, default


def _with_limits(df: DataFrame, limits: DataFrame, default: dict, names: list[str]) -> DataFrame:
    """One row per repository at most on the right; repositories without a row take the default row's values."""
    return df.join(limits.select("repo_id", *names), "repo_id", "left").withColumns({c: F.coalesce(c, F.lit(default[c])) for c in names})


def _observations(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "co_change_log").select("obs_id", "repo_id", "path_a", "path_b")
    a, b = clean_path("path_a"), clean_path("path_b")
    return log.where(a != b).select("obs_id", "repo_id", F.least(a, b).alias("path_a"), F.greatest(a, b).alias("path_b"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs over the default row's limit; without such a row no pair can be over it."""
    _, default = _limits(spark, d)
    items = ["repo_id", "path_a", "path_b"]
    return frequent(_observations(spark, d), items, default["max_co_change_pairs"] or 1, once_per="obs_id").select(*items)


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """The frequent pairs with their exact count and the bounds the sketch had for it."""
    _, default = _limits(spark, d)
    items = ["repo_id", "path_a", "path_b"]
    return frequent(_observations(spark, d), items, default["max_co_change_pairs"] or 1, once_per="obs_id").select(
        *items, "n", (F.col("approx_n") >= F.col("n")).alias("upper_holds"), (F.col("approx_low") <= F.col("n")).alias("lower_holds")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    files = judged(table(spark, d, "walked_files"), "file_id", "repo_id", "path", "source_text")
    return files.where("fault is not null").select(F.col("file").alias("file_id"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per repository and language: files judged, invalid and never read."""
    return rates(table(spark, d, "walked_files"), table(spark, d, "dropped_files"), "file_id", "repo_id", "path", "source_text")


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many files have each kind of fault, by extension."""
    files = judged(table(spark, d, "walked_files"), "file_id", "repo_id", "path", "source_text")
    return files.where("fault is not null").groupBy("ext", "fault").agg(F.count(F.lit(1)).alias("files"))


def _not_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(table(spark, d, "walked_files"), "file_id", "repo_id", "path", "source_text", table(spark, d, "walk_options"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _not_handwritten(spark, d).select(F.col("file").alias("file_id"))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per repository and language: files with a source, files left as hand-written, and files taken out by reason.

    ``over_limit`` counts files over the repository's walk limit now in force (or the default row's): they would not be walked today.
    """
    limits = table(spark, d, "walk_options").groupBy("repo_id").agg(F.max("max_file_bytes").alias("most"))
    default = limits.where("repo_id = 0").first()
    files = (
        table(spark, d, "walked_files")
        .where("source_text is not null")
        .groupBy("file_id")
        .agg(F.max("repo_id").alias("repo_id"), F.max(lang_key("lang", "path")).alias("lang"), F.max(F.coalesce("bytes", F.octet_length("source_text"))).alias("bytes"))
    )
    why = _not_handwritten(spark, d).select(F.col("file").alias("file_id"), "why")
    limited = files.join(limits.where("repo_id <> 0"), "repo_id", "left").join(why, "file_id", "left")
    most = F.coalesce("most", F.lit(default["most"] if default else None).cast("int"))
    return limited.groupBy("repo_id", "lang").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.when(F.col("why").isNull(), 1).otherwise(0)).alias("kept"),
        *[F.sum(F.when(F.col("why") == w, 1).otherwise(0)).alias(w) for w in ("generated", "minified", "vendored", "data")],
        F.sum(F.when(F.col("bytes") > most, 1).otherwise(0)).alias("over_limit"),
    )


def lang_key(lang: str, path: str) -> Column:
    """The language as the path's extension names it, else the cleaned language column."""
    return F.coalesce(F.nullif(extension(path), F.lit("")), F.lower(F.trim(F.col(lang))))


def _commits(spark: SparkSession, d: str) -> DataFrame:
    """Every commit once: a delivery's files are the same set whichever delivery is taken."""
    files = F.array_sort(F.array_distinct(F.transform(F.filter("files", lambda f: f.isNotNull()), clean_path)))
    return (
        table(spark, d, "git_commits")
        .where(F.col("repo_id").isNotNull() & F.col("sha").isNotNull())
        .select("repo_id", "sha", "ingested_at", files.alias("files"))
        .groupBy("repo_id", "sha")
        .agg(F.max_by("files", F.struct(F.col("files").isNotNull(), "ingested_at")).alias("files"))
    )


def _pairs(spark: SparkSession, d: str, lift: float) -> DataFrame:
    limits, default = _limits(spark, d)
    commits = _with_limits(_commits(spark, d), limits, default, ["wide_commit_files", "min_co_change_count"])
    narrow = commits.where(F.size("files").between(1, F.col("wide_commit_files")))
    repos = table(spark, d, "git_commits").select("repo_id").distinct()
    floor = _with_limits(repos, limits, default, ["min_co_change_count"]).withColumnRenamed("min_co_change_count", "min_count")
    return pairs(narrow, "repo_id", "files", floor, lift)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, 4.0).select("repo_id", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """All pairs at the floor or over it, with counts, lift and conviction."""
    return _pairs(spark, d, 0.0).select(
        "repo_id", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n_ab", "n_a", "n_b", "n", *[F.round(c, 6).alias(c) for c in ("lift", "conviction")]
    )


def _renames(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "git_commits").select("repo_id", F.explode("renames").alias("r"))
    return r.select("repo_id", clean_path(F.col("r.from_path")).alias("a"), clean_path(F.col("r.to_path")).alias("b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components(_renames(spark, d), "a", "b", "repo_id").select("repo_id", F.col("node").alias("path"), F.col("group").alias("group_path"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per group with the number of its paths."""
    return p5_found(spark, d).groupBy("repo_id", "group_path").agg(F.count(F.lit(1)).alias("paths"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "prompt").distinct()


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents that hold it, none included."""
    hits = p6_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    items = table(spark, d, "eval_items").select("item_id", "suite", "tier").distinct()
    return items.join(hits, "item_id", "left").select("item_id", "suite", "tier", F.coalesce("documents", F.lit(0)).alias("documents"))


#: Where the public vocabulary lies.
VOCABULARY = os.environ.get("LODELINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _mixture(spark: SparkSession, d: str) -> Mixture:
    docs = table(spark, d, "documents").select("doc_id", "text", source_key("source").alias("source"))
    targets = table(spark, d, "mix_targets").withColumn("source", source_key("source_name"))
    return Mixture(count_tokens(docs, "doc_id", "text", VOCABULARY, ["source"]), "doc_id", "source", targets)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report()


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture itself in its global order: each document once a copy."""
    return _mixture(spark, d).documents().select("doc_id", "source_name", "copy", "tokens", "place")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed(table(spark, d, "documents"), "doc_id", "text", "lang").select(F.col("id").alias("doc_id"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source and language the documents, the stuffed ones and their share."""
    docs = table(spark, d, "documents")
    bad = stuffed(docs, "doc_id", "text", "lang").select(F.col("id").alias("doc_id"), F.lit(1).alias("bad"))
    named = docs.select("doc_id", source_key("source").alias("source"), language("lang").alias("lang"))
    return named.join(bad, "doc_id", "left").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count("bad").alias("stuffed"), F.round(F.count("bad") / F.count(F.lit(1)), 6).alias("share")
    )


def source_key(c: Column | str) -> Column:
    """A source's name without case, padding and separators, so that spelling variants meet; null stays null."""
    return F.regexp_replace(F.lower(F.trim(c if isinstance(c, Column) else F.col(c))), "[^a-z0-9]+", "")


_CLEAN = "regexp_replace({0}, '^(\\./)+', '')"
_OBS = f"""
WITH cleaned AS (
  SELECT DISTINCT obs_id, repo_id, {_CLEAN.format('path_a')} AS a, {_CLEAN.format('path_b')} AS b FROM co_change_log
  WHERE path_a IS NOT NULL AND path_b IS NOT NULL),
once AS (SELECT obs_id, any_value(repo_id) AS repo_id, any_value(least(a, b)) AS path_a, any_value(greatest(a, b)) AS path_b
  FROM cleaned WHERE a <> b GROUP BY obs_id),
lim AS (SELECT max(max_co_change_pairs) AS k FROM history_limits WHERE repo_id = 0),
counted AS (SELECT repo_id, path_a, path_b, count(*) AS n FROM once GROUP BY ALL
  HAVING count(*) * (SELECT k FROM lim) > (SELECT count(*) FROM once))
"""
_BASKETS = f"""
WITH touched AS (SELECT DISTINCT repo_id, sha, {_CLEAN.format('f')} AS path
  FROM (SELECT repo_id, sha, unnest(files) AS f FROM git_commits) WHERE f IS NOT NULL),
lim AS (SELECT g.repo_id, coalesce(l.wide_commit_files, z.wide_commit_files) AS wide, coalesce(l.min_co_change_count, z.min_co_change_count) AS floor
  FROM (SELECT DISTINCT repo_id FROM git_commits) g LEFT JOIN history_limits l ON l.repo_id = g.repo_id
  CROSS JOIN (SELECT * FROM history_limits WHERE repo_id = 0) z),
kept AS (SELECT repo_id, sha FROM touched JOIN lim USING (repo_id) GROUP BY repo_id, sha, wide HAVING count(*) <= wide),
t AS (SELECT * FROM touched SEMI JOIN kept USING (repo_id, sha)),
total AS (SELECT repo_id, count(*) AS n FROM kept GROUP BY repo_id),
single AS (SELECT repo_id, path, count(*) AS n FROM t GROUP BY ALL),
duo AS (SELECT a.repo_id, a.path AS path_a, b.path AS path_b, count(*) AS n_ab
  FROM t a JOIN t b ON a.repo_id = b.repo_id AND a.sha = b.sha AND a.path < b.path GROUP BY ALL),
scored AS (SELECT duo.repo_id, path_a, path_b, n_ab, sa.n AS n_a, sb.n AS n_b, total.n AS n
  FROM duo JOIN lim USING (repo_id) JOIN total USING (repo_id)
  JOIN single sa ON sa.repo_id = duo.repo_id AND sa.path = path_a JOIN single sb ON sb.repo_id = duo.repo_id AND sb.path = path_b
  WHERE n_ab >= floor)
"""
_GROUPS = f"""
WITH RECURSIVE r AS (SELECT repo_id, unnest(renames) AS x FROM git_commits),
link AS (SELECT DISTINCT repo_id, {_CLEAN.format('x.from_path')} AS a, {_CLEAN.format('x.to_path')} AS b FROM r
  WHERE x.from_path IS NOT NULL AND x.to_path IS NOT NULL),
edge AS (SELECT repo_id, a, b FROM link WHERE a <> b UNION SELECT repo_id, b, a FROM link WHERE a <> b),
reach(repo_id, path, other) AS (SELECT repo_id, a, a FROM edge UNION
  SELECT reach.repo_id, reach.path, edge.b FROM reach JOIN edge ON edge.repo_id = reach.repo_id AND edge.a = reach.other),
grouped AS (SELECT repo_id, path, min(other) AS group_path FROM reach GROUP BY ALL)
"""


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_counts": p1_counts,
        "p2_found": p2_found,
        "p2_rates": p2_rates,
        "p2_kinds": p2_kinds,
        "p3_found": p3_found,
        "p3_kept": p3_kept,
        "p4_found": p4_found,
        "p4_scores": p4_scores,
        "p5_found": p5_found,
        "p5_groups": p5_groups,
        "p6_found": p6_found,
        "p6_items": p6_items,
        "p7_mix": p7_mix,
        "p7_mixture": p7_mixture,
        "p8_found": p8_found,
        "p8_rates": p8_rates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _OBS + "SELECT repo_id, path_a, path_b FROM counted",
        "p1_counts": _OBS + "SELECT repo_id, path_a, path_b, n, true AS upper_holds, true AS lower_holds FROM counted",
        "p4_found": _BASKETS + "SELECT repo_id, path_a, path_b FROM scored WHERE n_ab * n >= 4 * n_a * n_b",
        "p4_scores": _BASKETS
        + "SELECT *, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 6) AS lift, CASE WHEN n_ab < n_a THEN round((1 - n_b / n) / (1 - n_ab / n_a), 6) END AS conviction FROM scored",
        "p5_found": _GROUPS + "SELECT repo_id, path, group_path FROM grouped",
        "p5_groups": _GROUPS + "SELECT repo_id, group_path, count(*) AS paths FROM grouped GROUP BY ALL",
    }
