"""Ranking, candidate pools, quotas, sampling and set scores over the files of each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.paths import base_name, dir_name, dir_prefixes, jaccard, name_tokens, tokens
from lodeline.functions.scoring import band, difficulty, f1, log_share, round2
from lodeline.operators import graph as G
from lodeline.operators import history as H
from lodeline.operators import ranking as R
from lodeline.plans import views as V
from lodeline.plans.graph_queries import _DIST, _NODES, _UP, _nodes, _unsound
from lodeline.plans.views import SQL
from lodeline.session import table


def _churn(s: SparkSession, d: str) -> DataFrame:
    return V.touches(s, d).groupBy("repo_id", F.col("path").alias("node")).agg(F.count(F.lit(1)).alias("churn"))


def topk_churn(s: SparkSession, d: str) -> DataFrame:
    """The ten busiest files of each repository."""
    return R.top_per_group(_churn(s, d), ["repo_id"], [F.desc("churn"), "node"], 10)


def round_robin_distance(s: SparkSession, d: str) -> DataFrame:
    """Twelve dependents of each file taken in turn from its distances, far to near, those few depend on first."""
    e = V.edges(s, d)
    dist = G.reach(G.flip(e))
    size = G.cone_sizes(dist).select("repo_id", "node", "breadth")
    j = dist.join(size, ["repo_id", "node"], "left").withColumn("breadth", F.coalesce("breadth", F.lit(0)))
    return R.round_robin(j, ["repo_id", "start"], "distance", ["breadth", "node"], 12).select("repo_id", "start", "node", "distance", "place")


def tree_siblings(s: SparkSession, d: str) -> DataFrame:
    """The five files that share the deepest directory with each file of the graph."""
    n = _nodes(V.edges(s, d))
    p = n.select("repo_id", "node", F.explode(dir_prefixes("node")).alias("dir")).withColumn("depth", F.size(F.split("dir", "/", -1)))
    o = p.select("repo_id", "dir", F.col("node").alias("other"))
    both = p.join(o, ["repo_id", "dir"]).where("node <> other").groupBy("repo_id", "node", "other").agg(F.max("depth").alias("shared"))
    return R.top_per_group(both, ["repo_id", "node"], [F.desc("shared"), "other"], 5)


def name_similar(s: SparkSession, d: str) -> DataFrame:
    """The five files whose names share most words with each file's, by overlap of the word sets."""
    n = _nodes(V.edges(s, d)).withColumn("words", F.array_distinct(name_tokens("node")))
    t = n.select("repo_id", "node", "words", F.explode("words").alias("word"))
    o = t.select("repo_id", "word", F.col("node").alias("other"), F.col("words").alias("other_words"))
    pairs = t.join(o, ["repo_id", "word"]).where("node <> other").select("repo_id", "node", "other", jaccard(F.col("words"), F.col("other_words")).alias("similarity")).distinct()
    return R.top_per_group(pairs, ["repo_id", "node"], [F.desc("similarity"), "other"], 5).withColumn("similarity", F.round("similarity", 6))


def key_siblings(s: SparkSession, d: str) -> DataFrame:
    """For each file, the other files in the directories of its partners, in turn from each directory, six at most."""
    pairs = H.both_ways(V.cochange(s, d).where("n >= 2"))
    lanes = pairs.select("repo_id", "subject", dir_name("partner").alias("dir")).distinct()
    n = _nodes(V.edges(s, d)).select("repo_id", "node", dir_name("node").alias("dir"))
    known = pairs.select("repo_id", "subject", F.col("partner").alias("node"))
    pool = lanes.join(n, ["repo_id", "dir"]).where("node <> subject").join(known, ["repo_id", "subject", "node"], "left_anti")
    return R.round_robin(pool, ["repo_id", "subject"], "dir", ["node"], 6, far_first=False).select("repo_id", "subject", "dir", "node", "place")


def mentioned_files(s: SparkSession, d: str) -> DataFrame:
    """Files all of whose name words occur in a commit's subject, the commits that name them, and how many of these touch them."""
    c = V.commits(s, d).select("repo_id", "sha", "files", F.array_distinct(tokens("subject")).alias("said"))
    n = V.files(s, d).select("repo_id", "path").distinct().withColumn("words", F.array_distinct(name_tokens("path"))).where("size(words) > 0")
    said = c.select("repo_id", "sha", "files", F.size("said").alias("k"), F.explode("said").alias("word"))
    w = n.select("repo_id", "path", F.size("words").alias("need"), F.explode("words").alias("word"))
    hit = w.join(said, ["repo_id", "word"]).groupBy("repo_id", "path", "sha", "need").agg(F.count(F.lit(1)).alias("got"), F.max(F.array_contains("files", F.col("path"))).alias("touches"))
    full = hit.where("got = need")
    return full.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("commits"), F.sum(F.col("touches").cast("int")).alias("touching"))


def commit_overlap(s: SparkSession, d: str) -> DataFrame:
    """For each commit the three others of its repository that share most files with it."""
    t = V.touches(s, d, narrow=True).select("repo_id", "sha", "path")
    o = t.select("repo_id", "path", F.col("sha").alias("other"))
    both = t.join(o, ["repo_id", "path"]).where("sha <> other").groupBy("repo_id", "sha", "other").agg(F.count(F.lit(1)).alias("shared"))
    return R.top_per_group(both.where("shared > 1"), ["repo_id", "sha"], [F.desc("shared"), "other"], 3)


def quota_shares(s: SparkSession, d: str) -> DataFrame:
    """Forty places of each repository shared over its languages by their number of files, largest remainders first."""
    n = V.files(s, d).where("lang is not null").groupBy("repo_id", "lang").agg(F.count(F.lit(1)).alias("files"))
    return R.quotas(n, ["repo_id"], "files", "lang", F.lit(40))


def even_spread_commits(s: SparkSession, d: str) -> DataFrame:
    """Nine commits of each repository at even distances over its history."""
    c = V.commits(s, d).select("repo_id", "sha", "commit_date")
    return R.even_spread(c, ["repo_id"], ["commit_date", "sha"], 9)


def progress_bands(s: SparkSession, d: str) -> DataFrame:
    """Ten bands of each repository's files by churn, ties in one band."""
    return R.bands(_churn(s, d), ["repo_id"], ["churn"], 10)


def retain_bands(s: SparkSession, d: str) -> DataFrame:
    """One file for each of eight bands of churn: the one most files depend on, then by name."""
    e = V.edges(s, d)
    size = G.cone_sizes(G.reach(G.flip(e)))
    j = _churn(s, d).join(size, ["repo_id", "node"], "left").withColumn("breadth", F.coalesce("breadth", F.lit(0))).drop("radius")
    b = R.bands(j, ["repo_id"], ["churn", "node"], 8)
    return R.top_per_group(b, ["repo_id", "band"], [F.desc("breadth"), "node"], 1).drop("place")


def landmarks(s: SparkSession, d: str) -> DataFrame:
    """The top 12 % of a repository's files (3 to 24) by dependents, then direct ones, then name."""
    e = V.edges(s, d)
    size = G.cone_sizes(G.reach(G.flip(e)))
    direct = e.groupBy("repo_id", F.col("dst").alias("node")).agg(F.count_distinct("src").alias("direct"))
    n = _nodes(e).join(size, ["repo_id", "node"], "left").join(direct, ["repo_id", "node"], "left")
    n = n.select("repo_id", "node", F.coalesce("breadth", F.lit(0)).alias("dependents"), F.coalesce("direct", F.lit(0)).alias("direct"))
    count = n.groupBy("repo_id").agg(F.least(F.greatest(F.ceil(F.count(F.lit(1)) * 0.12), F.lit(3)), F.lit(24)).alias("most"))
    r = R.top_per_group(n, ["repo_id"], [F.desc("dependents"), F.desc("direct"), "node"], 24)
    return r.join(count, "repo_id").where("place <= most").drop("most")


def arrival(s: SparkSession, d: str) -> DataFrame:
    """Each repository's first landmark, in one aggregation."""
    n = G.cone_sizes(G.reach(G.flip(V.edges(s, d))))
    return n.groupBy("repo_id").agg(F.min(F.struct((-F.col("breadth")).alias("b"), F.col("node"))).alias("x")).select("repo_id", "x.node", (-F.col("x.b")).alias("dependents"))


def candidate_pool(s: SparkSession, d: str) -> DataFrame:
    """For each file with dependents: how many files are related, and how many clean ones are left to choose wrong answers from."""
    e = V.edges(s, d)
    bad = G.spread_mark(e, _unsound(e))
    n = _nodes(e)
    total = n.join(bad, ["repo_id", "node"], "left_anti").groupBy("repo_id").agg(F.count(F.lit(1)).alias("clean"))
    own = G.reach(G.flip(e))
    related = own.select("repo_id", "start", "node").unionByName(own.select("repo_id", "start", F.col("start").alias("node"))).distinct()
    used = related.join(bad, ["repo_id", "node"], "left_anti").groupBy("repo_id", "start").agg(F.count(F.lit(1)).alias("taken"))
    all_ = related.groupBy("repo_id", "start").agg((F.count(F.lit(1)) - 1).alias("related"))
    return all_.join(used, ["repo_id", "start"], "left").join(total, "repo_id").select("repo_id", "start", "related", (F.col("clean") - F.coalesce("taken", F.lit(0))).alias("pool"))


def truth_sizes(s: SparkSession, d: str) -> DataFrame:
    p = candidate_pool(s, d)
    return p.select("repo_id", "start", R.truth_cap(F.col("related") + F.col("pool")).alias("cap"), R.truth_size(F.col("pool"), F.col("related"), 6).alias("size"))


def directory_guess(s: SparkSession, d: str) -> DataFrame:
    """How well 'the files beside it' guess a file's partners: hits, precision, recall, F1 and grade."""
    pairs = H.both_ways(V.cochange(s, d).where("n >= 2"))
    n = _nodes(V.edges(s, d)).select("repo_id", "node", dir_name("node").alias("dir"))
    truth = pairs.groupBy("repo_id", "subject").agg(F.count(F.lit(1)).alias("truth"))
    inside = n.groupBy("repo_id", "dir").agg((F.count(F.lit(1)) - 1).alias("picked"))
    hit = pairs.where(dir_name("subject") == dir_name("partner")).groupBy("repo_id", "subject").agg(F.count(F.lit(1)).alias("hits"))
    j = truth.withColumn("dir", dir_name("subject")).join(inside, ["repo_id", "dir"], "left").join(hit, ["repo_id", "subject"], "left").na.fill(0, ["picked", "hits"])
    score = f1(F.col("hits"), F.col("picked"), F.col("truth"))
    return j.select("repo_id", "subject", "truth", "picked", "hits", F.round(score, 6).alias("score"), band(score).alias("grade"))


def guess_gate(s: SparkSession, d: str) -> DataFrame:
    """Per repository: subjects whose partners the directory guess gives away (score from .78), and the mean and best score."""
    g = directory_guess(s, d)
    return g.groupBy("repo_id").agg(F.count(F.lit(1)).alias("subjects"), F.count_if(F.col("score") >= 0.78).alias("given_away"), F.round(F.avg("score"), 5).alias("mean"), F.max("score").alias("best"))


def board_difficulty(s: SparkSession, d: str) -> DataFrame:
    """Difficulty of asking for a file's dependents: breadth and reach by logarithmic share, surprise from the directory guess."""
    e = V.edges(s, d)
    dist = G.reach(G.flip(e))
    size = G.cone_sizes(dist)
    most = size.groupBy("repo_id").agg(F.max("breadth").alias("mb"), F.max("radius").alias("mr"))
    n = _nodes(e).select("repo_id", "node", dir_name("node").alias("dir"))
    beside = n.groupBy("repo_id", "dir").agg((F.count(F.lit(1)) - 1).alias("picked"))
    hit = dist.where(dir_name("start") == dir_name("node")).groupBy("repo_id", F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("hits"))
    j = size.withColumn("dir", dir_name("node")).join(beside, ["repo_id", "dir"]).join(hit, ["repo_id", "node"], "left").na.fill(0, ["hits"]).join(most, "repo_id")
    wrong = F.col("breadth") + F.col("picked") - 2 * F.col("hits")
    s_ = F.least(F.lit(1.0), wrong / F.greatest(F.col("breadth"), F.lit(1)))
    return j.select("repo_id", "node", difficulty(log_share(F.col("breadth"), F.col("mb")), log_share(F.col("radius"), F.col("mr")), s_).alias("difficulty"))


def distinct_keys(s: SparkSession, d: str) -> DataFrame:
    """One subject for each distinct set of direct dependents: the first by name, and how many share the set."""
    e = V.edges(s, d)
    sets = e.groupBy("repo_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(src))").alias("h1"), F.expr("bit_xor(xxhash64(src, 1))").alias("h2"))
    return sets.groupBy("repo_id", "n", "h1", "h2").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("sharing")).select("repo_id", "node", "n", "sharing")


def distractor_mix(s: SparkSession, d: str) -> DataFrame:
    """A board of eight wrong answers for each file, mixed from three ranked strategies by quota; how many came from each."""
    sib = tree_siblings(s, d).select("repo_id", F.col("node").alias("subject"), F.lit("tree").alias("strategy"), "place", F.col("other").alias("item"))
    nam = name_similar(s, d).select("repo_id", F.col("node").alias("subject"), F.lit("name").alias("strategy"), "place", F.col("other").alias("item"))
    key = key_siblings(s, d).select("repo_id", "subject", F.lit("key").alias("strategy"), "place", F.col("node").alias("item"))
    board = R.select_mix(sib.unionByName(nam).unionByName(key), ["repo_id", "subject"], "item", ["tree", "key", "name"], [0.5, 0.3, 0.2], 8)
    return board.groupBy("repo_id", "strategy").agg(F.count(F.lit(1)).alias("picked"), F.count_distinct("subject").alias("boards"))


def label_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Short labels of files: the name, with its directory before it where the name repeats in the repository."""
    f = V.files(s, d).select("repo_id", "path").distinct().withColumn("base", base_name("path"))
    count = f.groupBy("repo_id", "base").agg(F.count(F.lit(1)).alias("n"))
    return f.join(count, ["repo_id", "base"]).select("repo_id", "path", F.when(F.col("n") > 1, F.concat_ws("/", F.nullif(base_name(dir_name("path")), F.lit("")), "base")).otherwise(F.col("base")).alias("label"))


def lifetime_pool(s: SparkSession, d: str) -> DataFrame:
    """For each file: commits of its repository within its lifetime, and how many of them do not touch it."""
    t = V.touches(s, d)
    life = t.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("touching"), F.min("commit_date").alias("lo"), F.max("commit_date").alias("hi"))
    days = V.commits(s, d).where("commit_date is not null").groupBy("repo_id", "commit_date").agg(F.count(F.lit(1)).alias("n"))
    inside = life.join(days, "repo_id").where(F.col("commit_date").between(F.col("lo"), F.col("hi")))
    g = inside.groupBy("repo_id", "path", "touching").agg(F.sum("n").alias("inside"))
    return g.select("repo_id", "path", "touching", "inside", (F.col("inside") - F.col("touching")).alias("pool"))


def eval_scores(s: SparkSession, d: str) -> DataFrame:
    """Mean tier of the test items by suite, halves up, and the items without a tier."""
    t = table(s, d, "eval_items")
    return t.groupBy("suite").agg(round2(F.avg("tier")).alias("mean_tier"), F.count_if(F.col("tier").isNull()).alias("untiered"), F.count(F.lit(1)).alias("items"))


QUERIES = {f.__name__: f for f in (
    topk_churn, round_robin_distance, tree_siblings, name_similar, key_siblings, mentioned_files, commit_overlap, quota_shares, even_spread_commits, progress_bands, retain_bands, landmarks,
    arrival, candidate_pool, truth_sizes, directory_guess, guess_gate, board_difficulty, distinct_keys, distractor_mix, label_duplicates, lifetime_pool, eval_scores,
)}

_CHURN = ", churn AS (SELECT repo_id, path AS node, count(*) AS churn FROM touches GROUP BY ALL)"
_CONE = _UP + _DIST + _NODES + ", cone AS (SELECT repo_id, start AS node, count(*) AS breadth, max(distance) AS radius FROM dist GROUP BY ALL)"
_TOK = "list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
_STEM = "regexp_replace(string_split({0}, '/')[-1], '(.)\\.[^.]*$', '\\1')"
_WORDS = "list_distinct(" + _TOK.format(_STEM.format("{0}")) + ")"
_DIR = "array_to_string(string_split({0}, '/')[1:-2], '/')"
_PAIRS = ", bp AS (SELECT repo_id, a AS subject, b AS partner FROM cochange WHERE n >= 2 UNION ALL SELECT repo_id, b, a FROM cochange WHERE n >= 2)"
_BAD = ", bad(repo_id, node) AS (SELECT repo_id, node FROM nodes WHERE regexp_matches(node, '\\.(json|md)$') UNION SELECT t.repo_id, e.src FROM bad t JOIN edges e ON e.repo_id = t.repo_id AND e.dst = t.node)"
_POOL = _UP + _DIST + _NODES + _BAD + """, clean AS (SELECT repo_id, count(*) AS clean FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.repo_id = n.repo_id AND b.node = n.node) GROUP BY ALL),
rel AS (SELECT repo_id, start, node FROM dist UNION SELECT repo_id, start, start FROM dist),
pool AS (SELECT r.repo_id, r.start, count(*) - 1 AS related, max(clean) - count(CASE WHEN b.node IS NULL THEN 1 END) AS pool FROM rel r LEFT JOIN bad b ON b.repo_id = r.repo_id AND b.node = r.node
  JOIN clean c ON c.repo_id = r.repo_id GROUP BY r.repo_id, r.start)"""
_GUESS = _NODES + _PAIRS + f""", nd AS (SELECT repo_id, {_DIR.format('node')} AS dir, count(*) - 1 AS picked FROM nodes GROUP BY ALL),
g0 AS (SELECT b.repo_id, subject, count(*) AS truth, count(CASE WHEN {_DIR.format('subject')} = {_DIR.format('partner')} THEN 1 END) AS hits FROM bp b GROUP BY ALL),
g1 AS (SELECT g0.repo_id, subject, truth, coalesce(picked, 0) AS picked, hits, CASE WHEN hits = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * hits / (coalesce(picked, 0) + truth) END AS sc
  FROM g0 LEFT JOIN nd ON nd.repo_id = g0.repo_id AND nd.dir = {_DIR.format('subject')}),
guess AS (SELECT repo_id, subject, truth, picked, hits, round(sc, 6) AS score, CASE WHEN sc >= 0.95 THEN 'S' WHEN sc >= 0.78 THEN 'A' WHEN sc >= 0.6 THEN 'B' WHEN sc >= 0.5 THEN 'C' ELSE '-' END AS grade FROM g1)"""
ORACLE = {
    "topk_churn": SQL + _CHURN + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY churn DESC, node) AS place FROM churn) WHERE place <= 10",
    "round_robin_distance": SQL + _CONE + """, tt AS (SELECT d.*, coalesce(breadth, 0) AS breadth FROM dist d LEFT JOIN cone c ON c.repo_id = d.repo_id AND c.node = d.node),
rr AS (SELECT *, row_number() OVER (PARTITION BY repo_id, start, distance ORDER BY breadth, node) AS turn FROM tt)
SELECT repo_id, start, node, distance, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, start ORDER BY turn, distance DESC, breadth, node) AS place FROM rr) WHERE place <= 12""",
    "tree_siblings": SQL + _NODES + """, px AS (SELECT repo_id, node, array_to_string(sg[1:i], '/') AS dir, i AS depth FROM (SELECT repo_id, node, sg, unnest(range(1, len(sg))) AS i FROM (SELECT repo_id, node, string_split(node, '/') AS sg FROM nodes))),
bo AS (SELECT a.repo_id, a.node, b.node AS other, max(a.depth) AS shared FROM px a JOIN px b ON a.repo_id = b.repo_id AND a.dir = b.dir AND a.node <> b.node GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, node ORDER BY shared DESC, other) AS place FROM bo) WHERE place <= 5""",
    "name_similar": SQL + _NODES + f""", w AS (SELECT repo_id, node, {_WORDS.format('node')} AS words FROM nodes),
pp AS (SELECT a.repo_id, a.node, b.node AS other, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS sim FROM w a JOIN w b ON a.repo_id = b.repo_id AND a.node <> b.node WHERE len(list_intersect(a.words, b.words)) > 0)
SELECT repo_id, node, other, round(sim, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, node ORDER BY sim DESC, other) AS place FROM pp) WHERE place <= 5""",
    "key_siblings": SQL + _NODES + _PAIRS + f""", ln AS (SELECT DISTINCT repo_id, subject, {_DIR.format('partner')} AS dir FROM bp),
po AS (SELECT ln.repo_id, ln.subject, ln.dir, n.node FROM ln JOIN nodes n ON n.repo_id = ln.repo_id AND {_DIR.format('n.node')} = ln.dir AND n.node <> ln.subject
  WHERE NOT EXISTS (SELECT 1 FROM bp WHERE bp.repo_id = ln.repo_id AND bp.subject = ln.subject AND bp.partner = n.node)),
rr AS (SELECT *, row_number() OVER (PARTITION BY repo_id, subject, dir ORDER BY node) AS turn FROM po)
SELECT repo_id, subject, dir, node, place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, subject ORDER BY turn, dir, node) AS place FROM rr) WHERE place <= 6""",
    "mentioned_files": SQL + f""", said AS (SELECT repo_id, sha, files, {_TOK.format('subject')} AS said FROM commits),
w AS (SELECT DISTINCT repo_id, path, {_WORDS.format('path')} AS words FROM files)
SELECT w.repo_id, w.path, count(*) AS commits, sum(CASE WHEN list_contains(s.files, w.path) THEN 1 ELSE 0 END) AS touching
FROM w JOIN said s ON s.repo_id = w.repo_id AND len(w.words) > 0 AND list_has_all(s.said, w.words) GROUP BY ALL""",
    "commit_overlap": SQL + """, bo AS (SELECT a.repo_id, a.sha, b.sha AS other, count(*) AS shared FROM narrow a JOIN narrow b ON a.repo_id = b.repo_id AND a.path = b.path AND a.sha <> b.sha GROUP BY ALL HAVING count(*) > 1)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, sha ORDER BY shared DESC, other) AS place FROM bo) WHERE place <= 3""",
    "quota_shares": SQL + """, n AS (SELECT repo_id, lang, count(*) AS files FROM files WHERE lang IS NOT NULL GROUP BY ALL),
x AS (SELECT *, 40 * files / sum(files) OVER (PARTITION BY repo_id) AS exact FROM n),
y AS (SELECT *, floor(exact) AS base, 40 - sum(floor(exact)) OVER (PARTITION BY repo_id) AS rest FROM x)
SELECT repo_id, lang, files, (base + CASE WHEN row_number() OVER (PARTITION BY repo_id ORDER BY round(exact - base, 9) DESC, lang) <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM y""",
    "even_spread_commits": SQL + """, o AS (SELECT repo_id, sha, commit_date, row_number() OVER (PARTITION BY repo_id ORDER BY commit_date NULLS FIRST, sha) - 1 AS i, count(*) OVER (PARTITION BY repo_id) AS n FROM commits)
SELECT repo_id, sha, commit_date FROM o WHERE n <= 9 OR i IN (SELECT floor(j * (o.n - 1) / 8.0 + 0.5) FROM range(9) r(j))""",
    "progress_bands": SQL + _CHURN + "SELECT *, floor((rank() OVER (PARTITION BY repo_id ORDER BY churn) - 1) * 10 / count(*) OVER (PARTITION BY repo_id))::INT AS band FROM churn",
    "retain_bands": SQL + _CONE + _CHURN + """, b AS (SELECT ch.repo_id, ch.node, churn, coalesce(breadth, 0) AS breadth, floor((row_number() OVER (PARTITION BY ch.repo_id ORDER BY churn, ch.node) - 1) * 8 / count(*) OVER (PARTITION BY ch.repo_id))::INT AS band
  FROM churn ch LEFT JOIN cone c ON c.repo_id = ch.repo_id AND c.node = ch.node)
SELECT repo_id, node, churn, breadth, band FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, band ORDER BY breadth DESC, node) AS p FROM b) WHERE p = 1""",
    "landmarks": SQL + _CONE + """, dd AS (SELECT repo_id, dst AS node, count(DISTINCT src) AS direct FROM edges GROUP BY ALL),
r AS (SELECT n.repo_id, n.node, coalesce(breadth, 0) AS dependents, coalesce(direct, 0) AS direct, row_number() OVER (PARTITION BY n.repo_id ORDER BY coalesce(breadth, 0) DESC, coalesce(direct, 0) DESC, n.node) AS place,
  count(*) OVER (PARTITION BY n.repo_id) AS c FROM nodes n LEFT JOIN cone c ON c.repo_id = n.repo_id AND c.node = n.node LEFT JOIN dd ON dd.repo_id = n.repo_id AND dd.node = n.node)
SELECT repo_id, node, dependents, direct, place FROM r WHERE place <= least(greatest(ceil(c * 0.12), 3), 24)""",
    "arrival": SQL + _CONE + "SELECT repo_id, node, dependents FROM (SELECT repo_id, node, breadth AS dependents, row_number() OVER (PARTITION BY repo_id ORDER BY breadth DESC, node) AS p FROM cone) WHERE p = 1",
    "candidate_pool": SQL + _POOL + "SELECT * FROM pool",
    "truth_sizes": SQL + _POOL + "SELECT repo_id, start, floor((related + pool - 1) / 3)::INT AS cap, coalesce((SELECT max(s) FROM range(1, 7) r(s) WHERE s <= related AND least(pool, 19 - s) > 2 * s), 0) AS size FROM pool",
    "directory_guess": SQL + _GUESS + "SELECT * FROM guess",
    "guess_gate": SQL + _GUESS + "SELECT repo_id, count(*) AS subjects, count(CASE WHEN score >= 0.78 THEN 1 END) AS given_away, round(avg(score), 5) AS mean, max(score) AS best FROM guess GROUP BY ALL",
    "board_difficulty": SQL + _CONE + f""", mm AS (SELECT repo_id, max(breadth) AS mb, max(radius) AS mr FROM cone GROUP BY ALL), nd AS (SELECT repo_id, {_DIR.format('node')} AS dir, count(*) - 1 AS picked FROM nodes GROUP BY ALL),
hh AS (SELECT repo_id, start AS node, count(*) AS hits FROM dist WHERE {_DIR.format('start')} = {_DIR.format('node')} GROUP BY ALL)
SELECT c.repo_id, c.node, floor(least(1, 0.25::DOUBLE * least(1, ln(1 + breadth) / ln(1 + mb)) + 0.25::DOUBLE * least(1, ln(1 + radius) / ln(1 + mr))
  + 0.5::DOUBLE * least(1, (breadth + picked - 2 * coalesce(hits, 0)) / greatest(breadth, 1))) * 100 + 0.5) / 100 AS difficulty
FROM cone c JOIN mm ON mm.repo_id = c.repo_id JOIN nd ON nd.repo_id = c.repo_id AND nd.dir = {_DIR.format('c.node')} LEFT JOIN hh ON hh.repo_id = c.repo_id AND hh.node = c.node""",
    "distinct_keys": SQL + ", k AS (SELECT repo_id, dst AS node, count(*) AS n, string_agg(src, '|' ORDER BY src) AS key FROM edges GROUP BY ALL) SELECT repo_id, min(node) AS node, n, count(*) AS sharing FROM k GROUP BY repo_id, n, key",
    "label_duplicates": SQL + f""", f AS (SELECT DISTINCT repo_id, path, string_split(path, '/')[-1] AS base FROM files)
SELECT repo_id, path, CASE WHEN count(*) OVER (PARTITION BY repo_id, base) > 1 AND len(string_split(path, '/')) > 1 THEN string_split(path, '/')[-2] || '/' || base ELSE base END AS label FROM f""",
    "lifetime_pool": SQL + """, lf AS (SELECT repo_id, path, count(*) AS touching, min(commit_date) AS lo, max(commit_date) AS hi FROM touches GROUP BY ALL)
SELECT l.repo_id, l.path, touching, count(*) AS inside, count(*) - touching AS pool FROM lf l JOIN commits c ON c.repo_id = l.repo_id AND commit_date BETWEEN lo AND hi GROUP BY l.repo_id, l.path, touching""",
    "eval_scores": "SELECT suite, floor(avg(tier) * 100 + 0.5) / 100 AS mean_tier, count(*) - count(tier) AS untiered, count(*) AS items FROM eval_items GROUP BY suite",
}
