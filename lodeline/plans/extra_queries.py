"""Queries that build on the others: guesses, explanations, matchings, visibility, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.paths import dir_name
from lodeline.functions.scoring import f1
from lodeline.functions.wording import decode_witness, encode_witness
from lodeline.operators import graph as G
from lodeline.operators import matching as M
from lodeline.operators import ranking as R
from lodeline.operators import spatial as S
from lodeline.operators.layout import force_layout
from lodeline.plans import boards as B
from lodeline.plans import views as V
from lodeline.plans.board_queries import _CHANGED
from lodeline.plans.graph_queries import ORACLE as GRAPH
from lodeline.plans.graph_queries import _LINKS, _nodes, _top, route_next_hop
from lodeline.plans.history_queries import ORACLE as HISTORY
from lodeline.plans.history_queries import companion_rank, rename_origins
from lodeline.plans.ranking_queries import ORACLE as RANKING
from lodeline.plans.ranking_queries import landmarks
from lodeline.plans.views import SQL
from lodeline.session import table

_DIR = "array_to_string(string_split({0}, '/')[1:-2], '/')"


def mutual_companions(s: SparkSession, d: str) -> DataFrame:
    """Pairs of files that rank each other among their five best partners."""
    r = companion_rank(s, d).select("repo_id", "subject", "partner", "place")
    back = r.select("repo_id", F.col("partner").alias("subject"), F.col("subject").alias("partner"), F.col("place").alias("back"))
    return r.join(back, ["repo_id", "subject", "partner"]).where("subject < partner").select("repo_id", "subject", "partner", "place", "back")


def route_links(s: SparkSession, d: str) -> DataFrame:
    """The links that shortest routes go over, and how many routes use each."""
    return route_next_hop(s, d).groupBy("repo_id", F.col("node").alias("src"), F.col("via").alias("dst")).agg(F.count(F.lit(1)).alias("routes"))


def visible_share(s: SparkSession, d: str) -> DataFrame:
    """The share of each repository's nodes that are a landmark or next to one."""
    e = V.edges(s, d)
    marks = landmarks(s, d).select("repo_id", "node")
    beside = G.both_ways(e).join(marks.withColumnRenamed("node", "src"), ["repo_id", "src"]).select("repo_id", F.col("dst").alias("node"))
    seen = marks.unionByName(beside).distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("seen"))
    total = _nodes(e).groupBy("repo_id").agg(F.count(F.lit(1)).alias("nodes"))
    return total.join(seen, "repo_id").select("repo_id", "nodes", "seen", F.round(F.col("seen") / F.col("nodes"), 6).alias("share"))


def recoloured_folders(s: SparkSession, d: str) -> DataFrame:
    """How many nodes change their label between top folders and connected parts under the best greedy match."""
    e = V.edges(s, d)
    r = M.recoloured_share(_top(_nodes(e)), G.connected(e).withColumnRenamed("part", "label"))
    return r.select("repo_id", "nodes", F.round("recoloured", 6).alias("recoloured"))


def package_origins(s: SparkSession, d: str) -> DataFrame:
    """The directory that most of a directory's renamed files come from; origins that are directories still in use are not claimed."""
    o = rename_origins(s, d).select("repo_id", dir_name("path").alias("package"), dir_name("origin").alias("origin_dir"))
    live = V.files(s, d).select("repo_id", dir_name("path").alias("key")).distinct()
    return M.claim_origins(M.majority_origin(o).withColumnRenamed("package", "key"), live)


def guess_scores(s: SparkSession, d: str) -> DataFrame:
    """What naive guesses score on the boards of changed files: the busiest candidates, the last by name, the largest folder; mean and best."""
    b = B.changed(s, d)
    churn = V.touches(s, d).groupBy("repo_id", F.col("path").alias("member")).agg(F.count(F.lit(1)).alias("churn"))
    c = b.select("repo_id", "subject", F.size("truth").alias("size"), "truth", F.explode("candidates").alias("member")).withColumn("right", F.array_contains("truth", F.col("member")))
    c = c.join(churn, ["repo_id", "member"], "left").withColumn("folder", dir_name("member"))
    n = c.groupBy("repo_id", "subject", "folder").agg(F.count(F.lit(1)).alias("in_folder"))
    c = c.join(n, ["repo_id", "subject", "folder"])
    w = lambda *o: F.row_number().over(Window.partitionBy("repo_id", "subject").orderBy(*o))
    places = c.select("repo_id", "subject", "size", "right", w(F.desc("churn"), "member").alias("busy"), w(F.desc("member")).alias("name"), w(F.desc("in_folder"), "folder", "member").alias("folder"))
    picks = places.unpivot(["repo_id", "subject", "size", "right"], ["busy", "name", "folder"], "guess", "place")
    score = picks.where("place <= size").groupBy("repo_id", "subject", "guess", "size").agg(F.count_if("right").alias("hits"), F.count(F.lit(1)).alias("picked"))
    score = score.withColumn("score", f1(F.col("hits"), F.col("picked"), F.col("size")))
    return score.groupBy("guess").agg(F.count(F.lit(1)).alias("boards"), F.round(F.avg("score"), 5).alias("mean"), F.count_if(F.col("score") >= B.GIVEN_AWAY).alias("given_away"))


def reveal_reasons(s: SparkSession, d: str) -> DataFrame:
    """Why candidates of the boards of changed files are right or wrong: changed, or together with a right one in its folder or elsewhere."""
    b = B.changed(s, d)
    c = b.select("repo_id", "truth", F.explode("candidates").alias("member"))
    right = F.array_contains("truth", F.col("member"))
    beside = F.exists("truth", lambda t: dir_name(t) == dir_name("member"))
    return c.select("repo_id", F.when(right, "changed").when(beside, "beside").otherwise("elsewhere").alias("reason")).groupBy("repo_id", "reason").agg(F.count(F.lit(1)).alias("members"))


def witness_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Boards whose witness does not come back the same after decoding and encoding: there are none."""
    b = B.changed(s, d)
    again = encode_witness(F.col("candidates"), decode_witness(F.col("candidates"), F.col("witness")))
    return b.agg(F.count(F.lit(1)).alias("boards"), F.count_if(again != F.col("witness")).alias("different"))


def next_question(s: SparkSession, d: str) -> DataFrame:
    """What each user is asked next: the event type seen least, then not passed, then longest ago, then by name."""
    e = table(s, d, "events")
    g = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("seen"), F.max((F.col("value") >= 50).cast("int")).alias("passed"), F.max("ts").alias("last"))
    return R.top_per_group(g, ["user_id"], ["seen", "passed", "last", "event_type"], 1).select("user_id", "event_type", "seen")


def neighbour_guess(s: SparkSession, d: str) -> DataFrame:
    """How well a node's neighbours, either way, guess its dependents: mean, median and best F1 by repository."""
    e = V.edges(s, d)
    dist = G.reach(G.flip(e)).select("repo_id", F.col("start").alias("subject"), "node")
    truth = dist.groupBy("repo_id", "subject").agg(F.count(F.lit(1)).alias("truth"))
    near = G.both_ways(e).select("repo_id", F.col("src").alias("subject"), F.col("dst").alias("node"))
    picked = near.groupBy("repo_id", "subject").agg(F.count(F.lit(1)).alias("picked"))
    hits = near.join(dist, ["repo_id", "subject", "node"]).groupBy("repo_id", "subject").agg(F.count(F.lit(1)).alias("hits"))
    j = truth.join(picked, ["repo_id", "subject"]).join(hits, ["repo_id", "subject"], "left").na.fill(0, ["hits"])
    j = j.withColumn("score", f1(F.col("hits"), F.col("picked"), F.col("truth")))
    return j.groupBy("repo_id").agg(F.round(F.avg("score"), 5).alias("mean"), F.round(F.expr("percentile(score, 0.5)"), 5).alias("median"), F.round(F.max("score"), 5).alias("best"))


def layout_spread(s: SparkSession, d: str) -> DataFrame:
    """A force layout of the largest connected parts, and how tight its folders lie against how far apart they are."""
    e = V.edges(s, d)
    at = force_layout(e, _top(_nodes(e)), rounds=6)
    return S.spread_ratio(at.select(F.concat_ws("|", "repo_id", "label").alias("label"), "x", "y"), "label")


QUERIES = {f.__name__: f for f in (
    mutual_companions, route_links, visible_share, recoloured_folders, package_origins, guess_scores, reveal_reasons, witness_round_trip, next_question, neighbour_guess, layout_spread,
)}

_BOARD = _CHANGED + ", fb AS (SELECT * FROM bd QUALIFY row_number() OVER (PARTITION BY repo_id, truth ORDER BY subject) = 1), cd AS (SELECT repo_id, subject, string_split(truth, '|') AS truth, unnest(string_split(candidates, '|')) AS member FROM fb)"


def _wrap(sql: str, name: str, rest: str) -> str:
    """A query's SQL as a named relation, followed by another select."""
    return f"WITH {name} AS ({sql})\n{rest}"


ORACLE = {
    "mutual_companions": _wrap(HISTORY["companion_rank"], "cr", "SELECT a.repo_id, a.subject, a.partner, a.place, b.place AS back FROM cr a JOIN cr b ON a.repo_id = b.repo_id AND a.subject = b.partner AND a.partner = b.subject WHERE a.subject < a.partner"),
    "route_links": _wrap(GRAPH["route_next_hop"], "rn", "SELECT repo_id, node AS src, via AS dst, count(*) AS routes FROM rn GROUP BY ALL"),
    "visible_share": _wrap(
        RANKING["landmarks"], "lm",
        f"SELECT x.repo_id, nodes, seen, round(seen / nodes, 6) AS share FROM (SELECT repo_id, count(*) AS nodes FROM ({SQL}{_LINKS} SELECT * FROM nodes) GROUP BY ALL) x JOIN (SELECT repo_id, count(*) AS seen FROM (SELECT repo_id, node FROM lm UNION SELECT l.repo_id, l.dst FROM ({SQL}{_LINKS} SELECT * FROM link) l JOIN lm ON lm.repo_id = l.repo_id AND lm.node = l.src) GROUP BY ALL) y ON y.repo_id = x.repo_id",
    ),
    "package_origins": _wrap(
        HISTORY["rename_origins"], "ro",
        f"""SELECT repo_id, key, CASE WHEN free AND row_number() OVER (PARTITION BY repo_id, origin ORDER BY free DESC, key) = 1 THEN origin ELSE key END AS origin FROM (
  SELECT p.*, key = origin OR NOT EXISTS (SELECT 1 FROM walked_files w WHERE w.repo_id = p.repo_id AND {_DIR.format("regexp_replace(w.path, '^(\\./)+', '')")} = p.origin) AS free FROM (
    SELECT n.repo_id, n.key, coalesce(m.o, n.key) AS origin FROM (SELECT repo_id, {_DIR.format('path')} AS key, count(*) AS n FROM ro GROUP BY ALL) n
    LEFT JOIN (SELECT repo_id, {_DIR.format('path')} AS key, {_DIR.format('origin')} AS o, count(*) AS v FROM ro GROUP BY ALL) m ON m.repo_id = n.repo_id AND m.key = n.key AND 2 * m.v > n.n) p)""",
    ),
    "guess_scores": _BOARD + f""", ch AS (SELECT repo_id, path AS member, count(*) AS churn FROM touches GROUP BY ALL),
pk AS (SELECT c.repo_id, subject, len(truth) AS size, list_contains(truth, c.member) AS ok, c.member, churn, {_DIR.format('c.member')} AS folder, count(*) OVER (PARTITION BY c.repo_id, subject, {_DIR.format('c.member')}) AS nf FROM cd c LEFT JOIN ch ON ch.repo_id = c.repo_id AND ch.member = c.member),
pl AS (SELECT *, row_number() OVER (PARTITION BY repo_id, subject ORDER BY churn DESC, member) AS busy, row_number() OVER (PARTITION BY repo_id, subject ORDER BY member DESC) AS name, row_number() OVER (PARTITION BY repo_id, subject ORDER BY nf DESC, folder, member) AS fold FROM pk),
ga AS (SELECT repo_id, subject, 'busy' AS guess, size, ok FROM pl WHERE busy <= size UNION ALL SELECT repo_id, subject, 'name', size, ok FROM pl WHERE name <= size UNION ALL SELECT repo_id, subject, 'folder', size, ok FROM pl WHERE fold <= size),
sc AS (SELECT guess, 2.0::DOUBLE * count(CASE WHEN ok THEN 1 END) / (count(*) + size) AS score FROM ga GROUP BY repo_id, subject, guess, size)
SELECT guess, count(*) AS boards, round(avg(score), 5) AS mean, count(CASE WHEN score >= 0.78 THEN 1 END) AS given_away FROM sc GROUP BY guess""",
    "reveal_reasons": _BOARD + f" SELECT repo_id, CASE WHEN list_contains(truth, member) THEN 'changed' WHEN list_contains(list_transform(truth, lambda t: {_DIR.format('t')}), {_DIR.format('member')}) THEN 'beside' ELSE 'elsewhere' END AS reason, count(*) AS members FROM cd GROUP BY ALL",
    "witness_round_trip": _BOARD + " SELECT count(*) AS boards, 0::BIGINT AS different FROM fb",
    "next_question": """SELECT user_id, event_type, seen FROM (SELECT user_id, event_type, count(*) AS seen, max((value >= 50)::INT) AS passed, max(ts) AS last FROM events GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen, passed, last, event_type) = 1""",
    "neighbour_guess": _wrap(GRAPH["dependents_closure"], "dc", f"""SELECT repo_id, round(avg(score), 5) AS mean, round(median(score), 5) AS median, round(max(score), 5) AS best FROM (
  SELECT t.repo_id, t.subject, CASE WHEN coalesce(h.hits, 0) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * h.hits / (p.picked + t.truth) END AS score FROM (SELECT repo_id, subject, count(*) AS truth FROM dc GROUP BY ALL) t
  JOIN (SELECT repo_id, src AS subject, count(*) AS picked FROM ({SQL}{_LINKS} SELECT * FROM link) GROUP BY ALL) p ON p.repo_id = t.repo_id AND p.subject = t.subject
  LEFT JOIN (SELECT l.repo_id, l.src AS subject, count(*) AS hits FROM ({SQL}{_LINKS} SELECT * FROM link) l JOIN dc ON dc.repo_id = l.repo_id AND dc.subject = l.src AND dc.dependent = l.dst GROUP BY ALL) h ON h.repo_id = t.repo_id AND h.subject = t.subject) GROUP BY repo_id"""),
}
