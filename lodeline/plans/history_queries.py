"""Queries over the commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.paths import clean_path, tokens
from lodeline.operators import history as H
from lodeline.plans import views as V
from lodeline.plans.views import CLEAN, SQL
from lodeline.session import table


def touched_sets(s: SparkSession, d: str) -> DataFrame:
    t = H.touched_sets(V.commits(s, d), V.limits(s, d))
    return t.select("repo_id", "sha", "n_files", "wide", F.size("kept").alias("kept"), "dropped", F.array_join("kept", " ").alias("kept_paths"))


def file_history(s: SparkSession, d: str) -> DataFrame:
    return H.file_history(V.files(s, d), V.touches(s, d))


def history_windows(s: SparkSession, d: str) -> DataFrame:
    return H.windows(V.commits(s, d), V.limits(s, d))


def retained_commits(s: SparkSession, d: str) -> DataFrame:
    return H.retained(V.commits(s, d), V.limits(s, d)).select("repo_id", "sha", "commit_date", "place")


def cochange_pairs(s: SparkSession, d: str) -> DataFrame:
    return V.cochange(s, d)


def cochange_capped(s: SparkSession, d: str) -> DataFrame:
    return H.capped_pairs(V.cochange(s, d), V.limits(s, d))


def cochange_floor(s: SparkSession, d: str) -> DataFrame:
    return H.floors(V.cochange(s, d), V.limits(s, d))


def companion_rank(s: SparkSession, d: str) -> DataFrame:
    pairs, lim = V.cochange(s, d), V.limits(s, d)
    return H.rank_partners(H.capped_pairs(pairs, lim), H.floors(pairs, lim), 5)


def commit_reasons(s: SparkSession, d: str) -> DataFrame:
    r = H.commit_reasons(V.commits(s, d), table(s, d, "repos"), V.limits(s, d))
    return r.groupBy("repo_id", F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("commits"))


def truncation_report(s: SparkSession, d: str) -> DataFrame:
    """What every cap kept and dropped, by repository."""
    lim, pairs = V.limits(s, d), V.cochange(s, d)
    commits = H.windows(V.commits(s, d), lim).select("repo_id", F.lit("commits").alias("what"), F.col("retained").alias("kept"), "dropped")
    sets = H.touched_sets(V.commits(s, d), lim).groupBy("repo_id").agg(F.sum(F.size("kept")).alias("kept"), F.sum("dropped").alias("dropped"))
    fl = H.floors(pairs, lim).select("repo_id", F.lit("pairs").alias("what"), F.col("kept"), (F.col("pairs") - F.col("kept")).alias("dropped"))
    return commits.unionByName(sets.select("repo_id", F.lit("files").alias("what"), "kept", "dropped")).unionByName(fl)


def rename_origins(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "git_commits").where("repo_id is not null and sha is not null")
    one = t.groupBy("repo_id", "sha").agg(F.max_by(F.struct("commit_date", "renames"), "ingested_at").alias("c"))
    ev = one.select("repo_id", "sha", "c.commit_date", F.posexplode("c.renames").alias("i", "r"))
    seq = F.concat_ws("|", F.col("commit_date").cast("string"), "sha", F.lpad(F.col("i").cast("string"), 6, "0"))
    return H.rename_origins(ev.select("repo_id", seq.alias("seq"), clean_path(F.col("r.from_path")).alias("from_path"), clean_path(F.col("r.to_path")).alias("to_path")))


def touch_gaps(s: SparkSession, d: str) -> DataFrame:
    return H.gaps(V.touches(s, d))


def author_activity(s: SparkSession, d: str) -> DataFrame:
    return V.commits(s, d).groupBy("repo_id", "author").agg(F.count(F.lit(1)).alias("commits"), F.sum(F.size("files")).alias("files"), F.min("commit_date").alias("first"), F.max("commit_date").alias("last"))


def issue_links(s: SparkSession, d: str) -> DataFrame:
    """The first issue number a subject names, and the subject cut to 120 characters with an ellipsis."""
    n = F.regexp_extract("subject", r"#(\d{1,9})\b", 1)
    short = F.when(F.length("subject") > 120, F.concat(F.substring("subject", 1, 119), F.lit("…"))).otherwise(F.col("subject"))
    return V.commits(s, d).select("repo_id", "sha", F.nullif(F.try_to_number(F.nullif(n, F.lit("")), F.lit("999999999")).cast("long"), F.lit(0).cast("long")).alias("issue"), short.alias("subject"))


def message_tokens(s: SparkSession, d: str) -> DataFrame:
    """How many commits of a repository use each word of their subjects."""
    t = V.commits(s, d).select("repo_id", F.explode(F.array_distinct(tokens("subject"))).alias("token"))
    return t.groupBy("repo_id", "token").agg(F.count(F.lit(1)).alias("commits"))


QUERIES = {f.__name__: f for f in (
    touched_sets, file_history, history_windows, retained_commits, cochange_pairs, cochange_capped, cochange_floor, companion_rank, commit_reasons, truncation_report,
    rename_origins, touch_gaps, author_activity, issue_links, message_tokens,
)}

_RANKED = """, ranked AS (SELECT c.repo_id, a, b, n, min_co_change_count AS least, max_co_change_pairs AS cap, row_number() OVER (PARTITION BY c.repo_id ORDER BY n DESC, a, b) AS place
  FROM cochange c JOIN limits l ON l.repo_id = c.repo_id WHERE n >= min_co_change_count),
capped AS (SELECT * FROM ranked WHERE place <= cap),
floors AS (SELECT repo_id, count(*) AS pairs, least(count(*), max(cap)) AS kept, count(*) > max(cap) AS cap_bit,
  CASE WHEN count(*) > max(cap) THEN min(CASE WHEN place <= cap THEN n END) + 1 ELSE max(least) END AS floor FROM ranked GROUP BY repo_id)
"""
_WINDOWS = """SELECT c.repo_id, min(commit_date) AS from_date, max(commit_date) AS to_date, count(*) AS walked, least(count(*), max(max_commits)) AS retained,
  count(*) - least(count(*), max(max_commits)) AS dropped FROM commits c JOIN limits l ON l.repo_id = c.repo_id GROUP BY c.repo_id"""
ORACLE = {
    "touched_sets": SQL + """SELECT c.repo_id, sha, len(files) AS n_files, len(files) > wide_commit_files AS wide, least(len(files), max_commit_files) AS kept,
  greatest(len(files) - max_commit_files, 0) AS dropped, array_to_string(files[1:max_commit_files], ' ') AS kept_paths FROM commits c JOIN limits l ON l.repo_id = c.repo_id""",
    "file_history": SQL + """SELECT f.repo_id, f.path, count(t.sha) AS churn, count(DISTINCT t.author) AS authors, min(t.commit_date) AS first_seen, max(t.commit_date) AS last_seen
  FROM (SELECT DISTINCT repo_id, path FROM files) f LEFT JOIN touches t ON t.repo_id = f.repo_id AND t.path = f.path GROUP BY ALL""",
    "history_windows": SQL + _WINDOWS,
    "retained_commits": SQL + """SELECT repo_id, sha, commit_date, place FROM (SELECT c.repo_id, sha, commit_date, max_commits,
  row_number() OVER (PARTITION BY c.repo_id ORDER BY commit_date DESC, sha) AS place FROM commits c JOIN limits l ON l.repo_id = c.repo_id) WHERE place <= max_commits""",
    "cochange_pairs": SQL + "SELECT * FROM cochange",
    "cochange_capped": SQL + _RANKED + "SELECT repo_id, a, b, n, place FROM capped",
    "cochange_floor": SQL + _RANKED + "SELECT * FROM floors",
    "companion_rank": SQL + _RANKED + """, rows AS (SELECT repo_id, a AS subject, b AS partner, n FROM capped UNION ALL SELECT repo_id, b, a, n FROM capped),
width AS (SELECT repo_id, subject AS partner, count(*) AS width FROM rows GROUP BY ALL)
SELECT * FROM (SELECT r.repo_id, subject, r.partner, n, width, row_number() OVER (PARTITION BY r.repo_id, subject ORDER BY n DESC, width, r.partner) AS place
  FROM rows r JOIN width w ON w.repo_id = r.repo_id AND w.partner = r.partner JOIN floors f ON f.repo_id = r.repo_id WHERE n >= floor) WHERE place <= 5""",
    "commit_reasons": SQL + """SELECT c.repo_id, CASE WHEN root IS NULL THEN 'shallow' WHEN len(files) >= max_commit_files THEN 'truncated' WHEN len(files) > wide_commit_files THEN 'wide'
  WHEN len(files) = 0 THEN 'empty' ELSE 'usable' END AS reason, count(*) AS commits
  FROM commits c JOIN limits l ON l.repo_id = c.repo_id LEFT JOIN (SELECT repo_id, max(root) AS root FROM repos GROUP BY repo_id) r ON r.repo_id = c.repo_id GROUP BY ALL""",
    "truncation_report": SQL + _RANKED + f""", w AS ({_WINDOWS})
SELECT repo_id, 'commits' AS what, retained AS kept, dropped FROM w UNION ALL
SELECT c.repo_id, 'files', sum(least(len(files), max_commit_files)), sum(greatest(len(files) - max_commit_files, 0)) FROM commits c JOIN limits l ON l.repo_id = c.repo_id GROUP BY c.repo_id UNION ALL
SELECT repo_id, 'pairs', kept, pairs - kept FROM floors""",
    "rename_origins": SQL + f""", one AS (SELECT DISTINCT ON (repo_id, sha) repo_id, sha, commit_date, renames FROM git_commits WHERE repo_id IS NOT NULL AND sha IS NOT NULL ORDER BY repo_id, sha, ingested_at DESC),
ev AS (SELECT repo_id, commit_date::VARCHAR || '|' || sha || '|' || lpad((i - 1)::VARCHAR, 6, '0') AS seq, {CLEAN.format('r.from_path')} AS f, {CLEAN.format('r.to_path')} AS t
  FROM (SELECT repo_id, sha, commit_date, unnest(renames) AS r, generate_subscripts(renames, 1) AS i FROM one)),
e AS (SELECT * FROM ev WHERE f <> t),
last AS (SELECT repo_id, t AS path, max(seq) AS seq FROM e GROUP BY ALL),
walk(repo_id, path, seq, f, hops) AS (SELECT l.repo_id, l.path, l.seq, e.f, 1::BIGINT FROM last l JOIN e ON e.repo_id = l.repo_id AND e.seq = l.seq UNION ALL
  SELECT w.repo_id, w.path, p.seq, p.f, w.hops + 1 FROM walk w JOIN e p ON p.repo_id = w.repo_id AND p.t = w.f AND p.seq < w.seq
    AND NOT EXISTS (SELECT 1 FROM e q WHERE q.repo_id = w.repo_id AND q.t = w.f AND q.seq < w.seq AND q.seq > p.seq)),
o AS (SELECT repo_id, path, arg_max(f, hops) AS origin, max(hops) AS hops FROM walk GROUP BY ALL)
SELECT repo_id, path, origin, hops, count(*) OVER (PARTITION BY repo_id, origin) > 1 AS contested FROM o""",
    "touch_gaps": SQL + """SELECT repo_id, path, sha, commit_date, row_number() OVER w AS ordinal, date_diff('day', lag(commit_date) OVER w, commit_date) AS gap_days
  FROM touches WINDOW w AS (PARTITION BY repo_id, path ORDER BY commit_date, sha)""",
    "author_activity": SQL + "SELECT repo_id, author, count(*) AS commits, sum(len(files)) AS files, min(commit_date) AS first, max(commit_date) AS last FROM commits GROUP BY ALL",
    "issue_links": SQL + """SELECT repo_id, sha, nullif(try_cast(regexp_extract(subject, '#([0-9]{1,9})\\b', 1) AS BIGINT), 0) AS issue,
  CASE WHEN length(subject) > 120 THEN left(subject, 119) || '…' ELSE subject END AS subject FROM commits""",
    "message_tokens": SQL + """SELECT repo_id, token, count(*) AS commits FROM (SELECT DISTINCT repo_id, sha,
  unnest(list_filter(regexp_split_to_array(lower(regexp_replace(subject, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM commits) GROUP BY ALL""",
}
