"""The question boards as queries, with the invariants that hold for every board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.plans import boards as B
from lodeline.plans import views as V
from lodeline.plans import whole_boards as W
from lodeline.plans.graph_queries import _DIST, _NODES, _UP
from lodeline.plans.history_queries import ORACLE as HISTORY
from lodeline.plans.views import SQL
from lodeline.session import cut


def _flat(b: DataFrame) -> DataFrame:
    return b.select("repo_id", "subject", F.array_join("candidates", "|").alias("candidates"), F.array_join("truth", "|").alias("truth"), "witness")


def boards_dependents(s: SparkSession, d: str) -> DataFrame:
    return _flat(B.dependents(s, d))


def boards_partners(s: SparkSession, d: str) -> DataFrame:
    return _flat(B.partners(s, d))


def boards_changed(s: SparkSession, d: str) -> DataFrame:
    return _flat(B.changed(s, d))


def boards_touching(s: SparkSession, d: str) -> DataFrame:
    return _flat(B.touching(s, d))


def whole_boards_dependents(s: SparkSession, d: str) -> DataFrame:
    return _flat(W.boards(s, d, "dependents"))


def whole_boards_partners(s: SparkSession, d: str) -> DataFrame:
    return _flat(W.boards(s, d, "partners"))


def whole_boards_changed(s: SparkSession, d: str) -> DataFrame:
    return _flat(W.boards(s, d, "changed"))


def whole_boards_touching(s: SparkSession, d: str) -> DataFrame:
    return _flat(W.boards(s, d, "touching", W.boards(s, d, "changed").select("repo_id", F.col("subject").alias("sha"))))


def boards_wrong_truth(s: SparkSession, d: str) -> DataFrame:
    """Candidates of the commit and file boards whose verdict differs from the touches themselves: there are none."""
    says = lambda x: F.array_contains("truth", x).alias("says")
    a = B.changed(s, d).select(F.lit("changed").alias("kind"), "repo_id", F.col("subject").alias("sha"), F.transform("candidates", lambda x: F.struct(x.alias("path"), says(x))).alias("verdicts"))
    b = B.touching(s, d).select("repo_id", F.explode("candidates").alias("sha"), F.col("subject").alias("path"), "truth")
    b = b.select(F.lit("touching").alias("kind"), "repo_id", "sha", F.array(F.struct("path", says(F.col("sha")))).alias("verdicts"))
    # a row for each commit of the touches, not for each touch
    j = a.unionByName(b).join(V.commits(s, d).select("repo_id", "sha", "files"), ["repo_id", "sha"], "left")
    wrong = F.filter("verdicts", lambda v: v["says"] != F.coalesce(F.array_contains("files", v["path"]), F.lit(False)))
    return j.groupBy("kind").agg(F.sum(F.size(wrong).cast("long")).alias("wrong"))


def boards_held_out(s: SparkSession, d: str) -> DataFrame:
    """Boards held back by template, after those that the served ones give away are refused."""
    parts = {k: cut(W.boards(s, d, k)) for k in ("dependents", "partners", "changed")}
    # an answered board of changed files tells how many its commit changed
    parts["touching"] = cut(W.boards(s, d, "touching", parts["changed"].select("repo_id", F.col("subject").alias("sha"))))
    ids, facts = None, None
    for k, b in parts.items():
        i = b.select("repo_id", F.lit(k).alias("kind"), "subject")
        x = b.select("repo_id", "subject", F.explode("truth").alias("member"))
        relation = "touch" if k in ("changed", "touching") else k
        f = x.select("repo_id", F.lit(k).alias("kind"), "subject", F.lit(relation).alias("relation"), F.least("subject", "member").alias("one"), F.greatest("subject", "member").alias("other"))
        ids, facts = (i, f) if ids is None else (ids.unionByName(i), facts.unionByName(f))
    held = B.hold_out(ids, facts, facts.limit(0), 5)
    total = ids.groupBy("kind").agg(F.count(F.lit(1)).alias("boards"))
    return total.join(held.groupBy("kind").agg(F.count(F.lit(1)).alias("held")), "kind", "left").select("kind", "boards", F.coalesce("held", F.lit(0)).alias("held"))


QUERIES = {f.__name__: f for f in (boards_dependents, boards_partners, boards_changed, boards_touching, whole_boards_dependents, whole_boards_partners, whole_boards_changed, whole_boards_touching, boards_wrong_truth, boards_held_out)}

_CHANGED = SQL + """, tr AS (SELECT repo_id, sha AS subject, path AS member, row_number() OVER (PARTITION BY repo_id, sha ORDER BY path) AS place FROM narrow QUALIFY place <= 6),
pr AS (SELECT repo_id, a AS anchor, b AS member, n FROM cochange WHERE n >= 2 UNION ALL SELECT repo_id, b, a, n FROM cochange WHERE n >= 2),
nr AS (SELECT t.repo_id, t.subject, p.member, max(n) AS n FROM tr t JOIN pr p ON p.repo_id = t.repo_id AND p.anchor = t.member
  WHERE NOT EXISTS (SELECT 1 FROM narrow x WHERE x.repo_id = t.repo_id AND x.sha = t.subject AND x.path = p.member) GROUP BY ALL),
wr AS (SELECT repo_id, subject, member, row_number() OVER (PARTITION BY repo_id, subject ORDER BY n DESC, member) AS place FROM nr QUALIFY place <= 19),
nn AS (SELECT t.repo_id, t.subject, t.supply, w.pool FROM (SELECT repo_id, subject, count(*) AS supply FROM tr GROUP BY ALL) t JOIN (SELECT repo_id, subject, count(*) AS pool FROM wr GROUP BY ALL) w USING (repo_id, subject)),
sz AS (SELECT repo_id, subject, (SELECT max(s) FROM range(1, 7) r(s) WHERE s <= supply AND least(pool, 19 - s) > 2 * s) AS size FROM nn),
rows AS (SELECT t.repo_id, t.subject, member, '-' AS how FROM tr t JOIN sz USING (repo_id, subject) WHERE place <= size UNION ALL
  SELECT w.repo_id, w.subject, member, 'together' FROM wr w JOIN sz USING (repo_id, subject) WHERE place <= 19 - size),
bd AS (SELECT repo_id, subject, string_agg(member, '|' ORDER BY member) AS candidates, string_agg(CASE WHEN how = '-' THEN member END, '|' ORDER BY member) AS truth, string_agg(how, ' ' ORDER BY member) AS witness FROM rows GROUP BY ALL)
"""
_DIR = "array_to_string(string_split({0}, '/')[1:-2], '/')"
#: From tr and wr to boards: the size, the members, the witness, one board a truth.
_ASSEMBLE = """
nn AS (SELECT t.repo_id, t.subject, t.supply, w.pool FROM (SELECT repo_id, subject, count(*) AS supply FROM tr GROUP BY ALL) t JOIN (SELECT repo_id, subject, count(*) AS pool FROM wr GROUP BY ALL) w USING (repo_id, subject)),
sz AS (SELECT repo_id, subject, (SELECT max(s) FROM range(1, 7) r(s) WHERE s <= supply AND least(pool, 19 - s) > 2 * s) AS size FROM nn),
mem AS (SELECT t.repo_id, t.subject, member, '-' AS how FROM tr t JOIN sz USING (repo_id, subject) WHERE place <= size UNION ALL
  SELECT w.repo_id, w.subject, member, strategy FROM wr w JOIN sz USING (repo_id, subject) WHERE place <= 19 - size),
bd AS (SELECT repo_id, subject, string_agg(member, '|' ORDER BY member) AS candidates, string_agg(CASE WHEN how = '-' THEN member END, '|' ORDER BY member) AS truth, string_agg(how, ' ' ORDER BY member) AS witness FROM mem GROUP BY ALL),
fb AS (SELECT * FROM bd QUALIFY row_number() OVER (PARTITION BY repo_id, truth ORDER BY subject) = 1)
"""
_GATE = f"""SELECT fb.* FROM fb JOIN (SELECT repo_id, subject, count(CASE WHEN here THEN 1 END) AS picked, count(CASE WHEN here AND how = '-' THEN 1 END) AS hits, count(CASE WHEN how = '-' THEN 1 END) AS truth_n
  FROM (SELECT *, {_DIR.format('member')} = {_DIR.format('subject')} AS here FROM mem) GROUP BY ALL) g ON g.repo_id = fb.repo_id AND g.subject = fb.subject
  WHERE CASE WHEN hits = 0 THEN 0 ELSE 2 * hits / (picked + truth_n) END < 0.78"""
_PARTNERS = f"""WITH cr AS ({HISTORY['companion_rank'].replace('place <= 5', 'place <= 6')}),
tr AS (SELECT repo_id, subject, partner AS member, place FROM cr), met AS (SELECT * FROM ({SQL} SELECT repo_id, a AS subject, b AS member FROM cochange UNION ALL SELECT repo_id, b, a FROM cochange)),
ch AS (SELECT * FROM ({SQL} SELECT repo_id, path AS member, count(*) AS churn FROM narrow GROUP BY ALL)),
wr AS (SELECT s.repo_id, s.subject, c.member, 'busy' AS strategy, row_number() OVER (PARTITION BY s.repo_id, s.subject ORDER BY churn DESC, c.member) AS place
  FROM (SELECT DISTINCT repo_id, subject FROM tr) s JOIN ch c ON c.repo_id = s.repo_id AND split_part(c.member, '/', 1) = split_part(s.subject, '/', 1) AND c.member <> s.subject
  WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.repo_id = s.repo_id AND m.subject = s.subject AND m.member = c.member) QUALIFY place <= 19),"""
_TOUCHING = SQL + """, t AS (SELECT repo_id, path AS subject, sha AS member, commit_date FROM touches),
lf AS (SELECT repo_id, subject, min(commit_date) AS lo, max(commit_date) AS hi FROM t GROUP BY ALL HAVING count(*) >= 3 AND min(commit_date) < max(commit_date)),
kp AS (SELECT t.* FROM t SEMI JOIN lf USING (repo_id, subject)),
od AS (SELECT *, row_number() OVER (PARTITION BY repo_id, subject ORDER BY commit_date, member) - 1 AS i, count(*) OVER (PARTITION BY repo_id, subject) AS n FROM kp),
tr AS (SELECT repo_id, subject, member, row_number() OVER (PARTITION BY repo_id, subject ORDER BY commit_date, member) AS place FROM od WHERE n <= 6 OR i IN (SELECT floor(j * (od.n - 1) / 5.0 + 0.5) FROM range(6) r(j))),
via AS (SELECT DISTINCT k.repo_id, k.subject, x.path AS via FROM kp k JOIN touches x ON x.repo_id = k.repo_id AND x.sha = k.member AND x.path <> k.subject),
po AS (SELECT v.repo_id, v.subject, x.sha AS member, count(*) AS shared FROM via v JOIN touches x ON x.repo_id = v.repo_id AND x.path = v.via JOIN lf l ON l.repo_id = v.repo_id AND l.subject = v.subject
  WHERE x.commit_date BETWEEN lo AND hi AND NOT EXISTS (SELECT 1 FROM t WHERE t.repo_id = v.repo_id AND t.subject = v.subject AND t.member = x.sha) GROUP BY ALL),
wr AS (SELECT repo_id, subject, member, 'neighbour' AS strategy, row_number() OVER (PARTITION BY repo_id, subject ORDER BY shared DESC, member) AS place FROM po QUALIFY place <= 19),"""
_DEPENDENTS = SQL + _UP + _DIST + _NODES + """, cone AS (SELECT repo_id, start AS node, count(*) AS breadth FROM dist GROUP BY ALL),
bad(repo_id, node) AS (SELECT repo_id, node FROM nodes WHERE regexp_matches(node, '\\.(json|md)$') UNION SELECT t.repo_id, e.src FROM bad t JOIN edges e ON e.repo_id = t.repo_id AND e.dst = t.node),
clean AS (SELECT * FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.repo_id = n.repo_id AND b.node = n.node)),
so AS (SELECT d.repo_id, d.start AS subject, d.node AS member, distance, coalesce(breadth, 0) AS breadth FROM dist d LEFT JOIN cone c ON c.repo_id = d.repo_id AND c.node = d.node
  JOIN clean x ON x.repo_id = d.repo_id AND x.node = d.node JOIN clean y ON y.repo_id = d.repo_id AND y.node = d.start),
rr AS (SELECT *, row_number() OVER (PARTITION BY repo_id, subject, distance ORDER BY breadth, member) AS turn FROM so),
tr AS (SELECT repo_id, subject, member, row_number() OVER (PARTITION BY repo_id, subject ORDER BY turn, distance DESC, breadth, member) AS place FROM rr QUALIFY place <= 6),
wr AS (SELECT s.repo_id, s.subject, c.node AS member, 'tree' AS strategy, row_number() OVER (PARTITION BY s.repo_id, s.subject ORDER BY c.node) AS place
  FROM (SELECT DISTINCT repo_id, subject FROM tr) s JOIN clean c ON c.repo_id = s.repo_id AND split_part(c.node, '/', 1) = split_part(s.subject, '/', 1) AND c.node <> s.subject
  WHERE NOT EXISTS (SELECT 1 FROM dist d WHERE d.repo_id = s.repo_id AND d.start = s.subject AND d.node = c.node) QUALIFY place <= 19),"""
ORACLE = {
    "boards_changed": _CHANGED + "SELECT * FROM bd QUALIFY row_number() OVER (PARTITION BY repo_id, truth ORDER BY subject) = 1",
    "boards_partners": _PARTNERS + _ASSEMBLE + _GATE,
    "boards_touching": _TOUCHING + _ASSEMBLE + "SELECT * FROM fb",
    "boards_dependents": _DEPENDENTS + _ASSEMBLE + _GATE,
    "boards_wrong_truth": "SELECT * FROM (VALUES ('changed', 0::BIGINT), ('touching', 0::BIGINT)) t(kind, wrong)",
}
