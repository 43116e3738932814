"""Queries over the dependency graph of each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.paths import dir_prefixes, segments
from lodeline.operators import graph as G
from lodeline.plans import views as V
from lodeline.plans.views import SQL


def _nodes(e: DataFrame) -> DataFrame:
    return e.select("repo_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


def _top(nodes: DataFrame) -> DataFrame:
    """The partition by top folder."""
    return nodes.select("repo_id", "node", F.substring_index("node", "/", 1).alias("label"))


def _unsound(e: DataFrame) -> DataFrame:
    """Nodes whose own links cannot be trusted: files of languages that are carried but not parsed."""
    return _nodes(e).where(F.col("node").rlike(r"\.(json|md)$"))


def degrees(s: SparkSession, d: str) -> DataFrame:
    e = V.edges(s, d)
    ends = e.select("repo_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("x"))
    return ends.groupBy("repo_id", "x.node").agg(F.sum("x.out").alias("out_degree"), F.sum("x.into").alias("in_degree"))


def reach_depth(s: SparkSession, d: str) -> DataFrame:
    """All nodes within three steps of each node, with the least distance."""
    return G.reach(V.edges(s, d), max_depth=3)


def dependents_closure(s: SparkSession, d: str) -> DataFrame:
    return G.reach(G.flip(V.edges(s, d))).select("repo_id", F.col("start").alias("subject"), F.col("node").alias("dependent"), "distance")


def cone_sizes(s: SparkSession, d: str) -> DataFrame:
    return G.cone_sizes(G.reach(G.flip(V.edges(s, d))))


def elevation_layers(s: SparkSession, d: str) -> DataFrame:
    """Each node's layer: the bit length of the number of nodes that depend on it, directly or not."""
    e = V.edges(s, d)
    size = G.cone_sizes(G.reach(G.flip(e)))
    n = F.coalesce("breadth", F.lit(0))
    return _nodes(e).join(size, ["repo_id", "node"], "left").select("repo_id", "node", n.alias("dependents"), G.layer(n).alias("layer"))


def taint_closure(s: SparkSession, d: str) -> DataFrame:
    e = V.edges(s, d)
    return G.spread_mark(e, _unsound(e))


def taint_sources(s: SparkSession, d: str) -> DataFrame:
    """How many nodes each unsound node spoils."""
    e = V.edges(s, d)
    seeds = _unsound(e).select("repo_id", F.col("node").alias("start"))
    return G.cone_sizes(G.reach(G.flip(e), seeds))


def route_next_hop(s: SparkSession, d: str) -> DataFrame:
    e = G.flip(V.edges(s, d))
    return G.next_hops(e, G.reach(e))


def cone_blockers(s: SparkSession, d: str) -> DataFrame:
    e = V.edges(s, d)
    return G.blockers(G.reach(e), _unsound(e))


def neighbours_two(s: SparkSession, d: str) -> DataFrame:
    """Undirected distance up to two."""
    return G.reach(G.both_ways(V.edges(s, d)), max_depth=2)


def twin_classes(s: SparkSession, d: str) -> DataFrame:
    return G.twins(G.reach(G.flip(V.edges(s, d))))


def graph_parts(s: SparkSession, d: str) -> DataFrame:
    return G.connected(V.edges(s, d)).groupBy("repo_id", "part").agg(F.count(F.lit(1)).alias("nodes"))


def _implied(s: SparkSession, d: str) -> DataFrame:
    """a -> b where at least half of the pair commits of a are with b: a graph with cycles."""
    both = V.cochange(s, d).select("repo_id", "n", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("x")).select("repo_id", "x.*", "n")
    most = both.groupBy("repo_id", "src").agg(F.max("n").alias("most"))
    return both.join(most, ["repo_id", "src"]).where("n >= 2 and 2 * n >= most").select("repo_id", "src", "dst")


def strong_parts(s: SparkSession, d: str) -> DataFrame:
    return G.strongly_connected(_implied(s, d)).groupBy("repo_id", "part").agg(F.count(F.lit(1)).alias("nodes"))


def folder_modularity(s: SparkSession, d: str) -> DataFrame:
    e = V.edges(s, d)
    return G.modularity(e, _top(_nodes(e))).select("repo_id", F.round("modularity", 6).alias("modularity"))


def split_folders(s: SparkSession, d: str) -> DataFrame:
    """Top folders cut into connected parts."""
    e = V.edges(s, d)
    return G.split_disconnected(e, _top(_nodes(e)))


def community_labels(s: SparkSession, d: str) -> DataFrame:
    e = V.edges(s, d)
    return G.absorb_small(e, G.split_disconnected(e, G.communities(e)))


def community_quality(s: SparkSession, d: str) -> DataFrame:
    """Per repository the modularity of the communities found beside that of the top folders."""
    e = V.edges(s, d)
    found = G.modularity(e, G.communities(e)).withColumnRenamed("modularity", "communities")
    return found.join(G.modularity(e, _top(_nodes(e))).withColumnRenamed("modularity", "folders"), "repo_id")


def _prefixes(nodes: DataFrame) -> DataFrame:
    p = nodes.select("repo_id", "node", F.explode(dir_prefixes("node")).alias("dir"))
    return p.withColumn("depth", F.size(F.split("dir", "/", -1)))


def part_folders(s: SparkSession, d: str) -> DataFrame:
    """The directory that fits each connected part best."""
    e = V.edges(s, d)
    labels = G.connected(e).withColumnRenamed("part", "label")
    return G.describe(labels, _prefixes(_nodes(e))).select("repo_id", "label", "dir", "overlap", "under", "members", F.round("f1", 6).alias("f1"))


def part_names(s: SparkSession, d: str) -> DataFrame:
    e = V.edges(s, d)
    labels = G.split_disconnected(e, _top(_nodes(e)))
    return G.claim_labels(G.describe(labels, _prefixes(_nodes(e)))).select("repo_id", "label", "name", F.round("share", 6).alias("share"))


def rand_folders_parts(s: SparkSession, d: str) -> DataFrame:
    e = V.edges(s, d)
    r = G.rand_index(_top(_nodes(e)), G.connected(e).withColumnRenamed("part", "label"))
    return r.select("repo_id", "n", F.round("rand", 6).alias("rand"), F.round("chance", 6).alias("chance"))


def dir_counts(s: SparkSession, d: str) -> DataFrame:
    """Files under every directory."""
    p = V.files(s, d).select("repo_id", F.explode(dir_prefixes("path")).alias("dir"))
    return p.groupBy("repo_id", "dir").agg(F.count(F.lit(1)).alias("files"))


def common_directory(s: SparkSession, d: str) -> DataFrame:
    """Per repository and language the longest directory all files share: that of the smallest and the largest path."""
    f = V.files(s, d).where("lang is not null").groupBy("repo_id", "lang").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    from lodeline.functions.paths import shared_depth

    a, b = segments("lo"), segments("hi")
    return f.select("repo_id", "lang", F.array_join(F.slice(a, F.lit(1), shared_depth(a, b)), "/").alias("dir"))


QUERIES = {f.__name__: f for f in (
    degrees, reach_depth, dependents_closure, cone_sizes, elevation_layers, taint_closure, taint_sources, route_next_hop, cone_blockers, neighbours_two, twin_classes, graph_parts,
    strong_parts, folder_modularity, split_folders, community_labels, community_quality, part_folders, part_names, rand_folders_parts, dir_counts, common_directory,
)}

_NODES = ", nodes AS (SELECT repo_id, src AS node FROM edges UNION SELECT repo_id, dst FROM edges), top AS (SELECT repo_id, node, split_part(node, '/', 1) AS label FROM nodes)"
_DOWN = ", walk(repo_id, start, node, d) AS (SELECT repo_id, src, dst, 1 FROM edges UNION SELECT w.repo_id, w.start, e.dst, d + 1 FROM walk w JOIN edges e ON e.repo_id = w.repo_id AND e.src = w.node)"
_UP = ", walk(repo_id, start, node, d) AS (SELECT repo_id, dst, src, 1 FROM edges UNION SELECT w.repo_id, w.start, e.src, d + 1 FROM walk w JOIN edges e ON e.repo_id = w.repo_id AND e.dst = w.node)"
_DIST = ", dist AS (SELECT repo_id, start, node, min(d) AS distance FROM walk WHERE start <> node GROUP BY ALL)"
_UNSOUND = _NODES + ", unsound AS (SELECT * FROM nodes WHERE regexp_matches(node, '\\.(json|md)$'))"
_LINKS = _NODES + ", link AS (SELECT repo_id, src, dst FROM edges UNION SELECT repo_id, dst, src FROM edges)"
_PARTS = _LINKS + ", pr(repo_id, node, other) AS (SELECT repo_id, node, node FROM nodes UNION SELECT p.repo_id, p.node, l.dst FROM pr p JOIN link l ON l.repo_id = p.repo_id AND l.src = p.other), parts AS (SELECT repo_id, node, min(other) AS part FROM pr GROUP BY ALL)"
_SPLIT = _LINKS + """, ilink AS (SELECT l.* FROM link l JOIN top a ON a.repo_id = l.repo_id AND a.node = src JOIN top b ON b.repo_id = l.repo_id AND b.node = dst WHERE a.label = b.label),
ir(repo_id, node, other) AS (SELECT repo_id, node, node FROM nodes UNION SELECT p.repo_id, p.node, l.dst FROM ir p JOIN ilink l ON l.repo_id = p.repo_id AND l.src = p.other),
split AS (SELECT repo_id, node, min(other) AS label FROM ir GROUP BY ALL)"""
_PREFIX = ", px AS (SELECT repo_id, node, array_to_string(sg[1:i], '/') AS dir, i AS depth FROM (SELECT repo_id, node, sg, unnest(range(1, len(sg))) AS i FROM (SELECT repo_id, node, string_split(node, '/') AS sg FROM nodes)))"
_DESCRIBE = """, sz AS (SELECT repo_id, label, count(*) AS members FROM lab GROUP BY ALL), un AS (SELECT repo_id, dir, count(*) AS under FROM px GROUP BY ALL),
ov AS (SELECT l.repo_id, label, dir, depth, count(*) AS overlap FROM lab l JOIN px ON px.repo_id = l.repo_id AND px.node = l.node GROUP BY ALL),
de AS (SELECT * FROM (SELECT ov.repo_id, ov.label, ov.dir, overlap, under, members, 2 * overlap / (under + members) AS f1,
  row_number() OVER (PARTITION BY ov.repo_id, ov.label ORDER BY 2 * overlap / (under + members) DESC, depth DESC, ov.dir) AS place
  FROM ov JOIN un ON un.repo_id = ov.repo_id AND un.dir = ov.dir JOIN sz ON sz.repo_id = ov.repo_id AND sz.label = ov.label) WHERE place = 1)"""
ORACLE = {
    "degrees": SQL + _NODES + "SELECT n.repo_id, n.node, (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.src = n.node) AS out_degree, (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id AND e.dst = n.node) AS in_degree FROM nodes n",
    "reach_depth": SQL + ", walk(repo_id, start, node, d) AS (SELECT repo_id, src, dst, 1 FROM edges UNION SELECT w.repo_id, w.start, e.dst, d + 1 FROM walk w JOIN edges e ON e.repo_id = w.repo_id AND e.src = w.node WHERE d < 3)" + _DIST + "SELECT * FROM dist",
    "dependents_closure": SQL + _UP + _DIST + "SELECT repo_id, start AS subject, node AS dependent, distance FROM dist",
    "cone_sizes": SQL + _UP + _DIST + "SELECT repo_id, start AS node, count(*) AS breadth, max(distance) AS radius FROM dist GROUP BY ALL",
    "elevation_layers": SQL + _UP + _DIST + _NODES + """, c AS (SELECT n.repo_id, n.node, count(d.node) AS dependents FROM nodes n LEFT JOIN dist d ON d.repo_id = n.repo_id AND d.start = n.node GROUP BY ALL)
SELECT repo_id, node, dependents, CASE WHEN dependents < 1 THEN 0 ELSE floor(log2(dependents))::INT + 1 END AS layer FROM c""",
    "taint_closure": SQL + _UNSOUND + ", t(repo_id, node) AS (SELECT * FROM unsound UNION SELECT t.repo_id, e.src FROM t JOIN edges e ON e.repo_id = t.repo_id AND e.dst = t.node) SELECT * FROM t",
    "taint_sources": SQL + _UP + _DIST + _UNSOUND + "SELECT d.repo_id, start AS node, count(*) AS breadth, max(distance) AS radius FROM dist d JOIN unsound u ON u.repo_id = d.repo_id AND u.node = d.start GROUP BY ALL",
    "route_next_hop": SQL + _UP + _DIST + """SELECT d.repo_id, d.start, d.node, d.distance, min(e.dst) AS via FROM dist d JOIN edges e ON e.repo_id = d.repo_id AND e.src = d.node
  LEFT JOIN dist p ON p.repo_id = d.repo_id AND p.start = d.start AND p.node = e.dst
  WHERE p.distance = d.distance - 1 OR (d.distance = 1 AND e.dst = d.start) GROUP BY ALL""",
    "cone_blockers": SQL + _DOWN + _DIST + _UNSOUND + """, cone AS (SELECT repo_id, start, node FROM dist UNION SELECT repo_id, start, start FROM dist),
hit AS (SELECT c.*, row_number() OVER (PARTITION BY c.repo_id, start ORDER BY c.node) AS place FROM cone c JOIN unsound u ON u.repo_id = c.repo_id AND u.node = c.node)
SELECT repo_id, start, count(*) AS unsound, string_agg(CASE WHEN place <= 3 THEN node END, ' ' ORDER BY node) AS first FROM hit GROUP BY ALL""",
    "neighbours_two": SQL + _LINKS + """, walk AS (SELECT repo_id, src AS start, dst AS node, 1 AS d FROM link UNION SELECT a.repo_id, a.src, b.dst, 2 FROM link a JOIN link b ON b.repo_id = a.repo_id AND b.src = a.dst)""" + _DIST + "SELECT * FROM dist",
    "twin_classes": SQL + _UP + _DIST + """, k AS (SELECT repo_id, start, string_agg(node, '|' ORDER BY node) AS key FROM dist GROUP BY ALL)
SELECT * FROM (SELECT repo_id, start AS node, min(start) OVER (PARTITION BY repo_id, key) AS twin_of, count(*) OVER (PARTITION BY repo_id, key) AS size FROM k) WHERE size > 1""",
    "graph_parts": SQL + _PARTS + "SELECT repo_id, part, count(*) AS nodes FROM parts GROUP BY ALL",
    "strong_parts": SQL + """, bw AS (SELECT repo_id, a AS src, b AS dst, n FROM cochange UNION ALL SELECT repo_id, b, a, n FROM cochange),
im AS (SELECT repo_id, src, dst FROM (SELECT *, max(n) OVER (PARTITION BY repo_id, src) AS most FROM bw) WHERE n >= 2 AND 2 * n >= most),
rc(repo_id, s, n) AS (SELECT repo_id, src, dst FROM im UNION SELECT r.repo_id, r.s, e.dst FROM rc r JOIN im e ON e.repo_id = r.repo_id AND e.src = r.n),
mu AS (SELECT x.repo_id, x.s, least(x.s, min(x.n)) AS part FROM rc x JOIN rc y ON y.repo_id = x.repo_id AND y.s = x.n AND y.n = x.s WHERE x.s <> x.n GROUP BY x.repo_id, x.s)
SELECT repo_id, part, count(*) AS nodes FROM mu GROUP BY ALL""",
    "folder_modularity": SQL + _NODES + """, ee AS (SELECT e.repo_id, a.label AS la, b.label AS lb, weight FROM edges e JOIN top a ON a.repo_id = e.repo_id AND a.node = src JOIN top b ON b.repo_id = e.repo_id AND b.node = dst),
tt AS (SELECT repo_id, label, sum(weight) AS tot FROM (SELECT repo_id, la AS label, weight FROM ee UNION ALL SELECT repo_id, lb, weight FROM ee) GROUP BY ALL),
ii AS (SELECT repo_id, la AS label, sum(2 * weight) AS inn FROM ee WHERE la = lb GROUP BY ALL), mm AS (SELECT repo_id, sum(2 * weight) AS m2 FROM ee GROUP BY ALL)
SELECT tt.repo_id, round(sum(coalesce(inn, 0) / m2 - (tot / m2) * (tot / m2)), 6) AS modularity FROM tt JOIN mm ON mm.repo_id = tt.repo_id LEFT JOIN ii ON ii.repo_id = tt.repo_id AND ii.label = tt.label GROUP BY tt.repo_id""",
    "split_folders": SQL + _SPLIT + "SELECT * FROM split",
    "part_folders": SQL + _PARTS + ", lab AS (SELECT repo_id, node, part AS label FROM parts)" + _PREFIX + _DESCRIBE + "SELECT repo_id, label, dir, overlap, under, members, round(f1, 6) AS f1 FROM de",
    "part_names": SQL + _SPLIT + ", lab AS (SELECT * FROM split)" + _PREFIX + _DESCRIBE + """, rk AS (SELECT *, overlap / members AS share, row_number() OVER (PARTITION BY repo_id, dir ORDER BY overlap / members DESC, members DESC, label) AS pl FROM de)
SELECT repo_id, label, CASE WHEN pl = 1 AND share >= 0.5 THEN dir WHEN pl = 1 THEN 'around ' || dir ELSE dir || ' (' || pl || ')' END AS name, round(share, 6) AS share FROM rk""",
    "rand_folders_parts": SQL + _PARTS + """, ct AS (SELECT t.repo_id, t.label AS a, p.part AS b, count(*) AS c FROM top t JOIN parts p ON p.repo_id = t.repo_id AND p.node = t.node GROUP BY ALL),
bo AS (SELECT repo_id, sum(c * (c - 1) / 2) AS both_in, sum(c) AS n FROM ct GROUP BY ALL),
ra AS (SELECT repo_id, sum(c * (c - 1) / 2) AS ia FROM (SELECT repo_id, a, sum(c) AS c FROM ct GROUP BY ALL) GROUP BY ALL),
rb AS (SELECT repo_id, sum(c * (c - 1) / 2) AS ib FROM (SELECT repo_id, b, sum(c) AS c FROM ct GROUP BY ALL) GROUP BY ALL)
SELECT repo_id, n, round((n * (n - 1) / 2 + 2 * both_in - ia - ib) / (n * (n - 1) / 2), 6) AS rand,
  round((ia / (n * (n - 1) / 2)) * (ib / (n * (n - 1) / 2)) + (1 - ia / (n * (n - 1) / 2)) * (1 - ib / (n * (n - 1) / 2)), 6) AS chance FROM bo JOIN ra USING (repo_id) JOIN rb USING (repo_id) WHERE n > 1""",
    "dir_counts": SQL + """SELECT repo_id, array_to_string(sg[1:i], '/') AS dir, count(*) AS files FROM (SELECT repo_id, sg, unnest(range(1, len(sg))) AS i FROM (SELECT repo_id, string_split(path, '/') AS sg FROM files)) GROUP BY ALL""",
    "common_directory": SQL + """, mm AS (SELECT repo_id, lang, string_split(min(path), '/')[1:-2] AS lo, string_split(max(path), '/')[1:-2] AS hi FROM files WHERE lang IS NOT NULL GROUP BY ALL),
kk AS (SELECT repo_id, lang, lo, len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])) AS k FROM mm)
SELECT repo_id, lang, array_to_string(lo[1:k], '/') AS dir FROM kk""",
}
