"""Question boards: the reference's four templates as one pipeline of relations.

A board has a subject, right answers (``truth``) and wrong ones (``wrong``), chosen so that the right ones cannot be told by the file's place in
the tree. Templates differ in what the truth is and where wrong answers come from:

* ``dependents``: nodes that depend on the subject, in turn from every distance; wrong ones are clean nodes that do not;
* ``partners``: files that share at least the floor of commits with the subject; wrong ones never shared one;
* ``changed``: files that a commit touched; wrong ones it did not;
* ``touching``: commits that touched a file; wrong ones lie within its lifetime and did not.

Everything is joins, anti joins and ranked limits by subject; a board is gathered only after it is cut to its bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.paths import dir_name
from lodeline.functions.scoring import f1
from lodeline.operators import graph as G
from lodeline.operators import history as H
from lodeline.operators import ranking as R
from lodeline.operators.overlap import companions, neighbours
from lodeline.plans import views as V
from lodeline.session import cut

#: Candidates on a board and right ones among them, at most.
CANDIDATES, RIGHT = 19, 6
#: A guess that scores as much gives a board away.
GIVEN_AWAY = 0.78

KEYS = ["repo_id", "subject"]


def assemble(truth: DataFrame, wrong: DataFrame) -> DataFrame:
    """``repo_id, subject, candidates, truth, witness`` from ranked members: ``truth`` and ``wrong`` have ``repo_id, subject, member, place``, ``wrong`` a ``strategy`` too.

    The size is the largest s up to RIGHT with more than 2 s wrong answers left; boards of size 0 are dropped. Candidates are sorted;
    the witness says for each of them ``-`` for right or the strategy it came from.
    """
    t = truth.where(F.col("place") <= RIGHT)
    w = wrong.where(F.col("place") <= CANDIDATES)
    n = t.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("supply")).join(w.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("pool")), KEYS)
    size = n.select(*KEYS, R.truth_size(F.col("pool"), F.col("supply"), RIGHT).alias("size")).where("size > 0")
    right = t.join(size, KEYS).where("place <= size").select(*KEYS, "member", F.lit("-").alias("how"))
    others = w.join(size, KEYS).where(F.col("place") <= F.lit(CANDIDATES) - F.col("size")).select(*KEYS, "member", F.col("strategy").alias("how"))
    rows = right.unionByName(others)
    board = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("member", "how"))).alias("m"))
    return board.select(
        *KEYS,
        F.transform("m", lambda x: x["member"]).alias("candidates"),
        F.transform(F.filter("m", lambda x: x["how"] == "-"), lambda x: x["member"]).alias("truth"),
        F.array_join(F.transform("m", lambda x: x["how"]), " ").alias("witness"),
    )


def folder_guess(board: DataFrame, folder: Column | None = None) -> DataFrame:
    """Boards with ``guess``: the score of picking the candidates that lie in the subject's folder."""
    here = dir_name("subject") if folder is None else folder
    picked = F.filter("candidates", lambda c: dir_name(c) == here)
    hits = F.size(F.array_intersect(picked, F.col("truth")))
    return board.withColumn("guess", f1(hits, F.size(picked), F.size("truth")))


def gate(board: DataFrame) -> DataFrame:
    return folder_guess(board).where(F.col("guess") < GIVEN_AWAY)


def distinct_truth(board: DataFrame) -> DataFrame:
    """One board for each set of right answers: the first subject by name."""
    return R.top_per_group(board.withColumn("__key", F.array_join("truth", "\n")), ["repo_id", "__key"], ["subject"], 1).drop("__key", "place")


def _ranked(pool: DataFrame, order: list, strategy: str) -> DataFrame:
    return R.top_per_group(pool, KEYS, order, CANDIDATES).withColumn("strategy", F.lit(strategy)).select(*KEYS, "member", "place", "strategy")


def _siblings(subjects: DataFrame, members: DataFrame) -> DataFrame:
    """Members of the top folder of each subject: candidates of a plausible place without pairing everything with everything."""
    top = lambda c: F.substring_index(c, "/", 1)
    return subjects.select(*KEYS, top("subject").alias("top")).join(members.select("repo_id", "member", top("member").alias("top")), ["repo_id", "top"]).where("subject <> member").select(*KEYS, "member")


def dependents(s: SparkSession, d: str) -> DataFrame:
    e = cut(V.edges(s, d))
    dist = cut(G.reach(G.flip(e)))
    breadth = G.cone_sizes(dist).select("repo_id", "node", "breadth")
    nodes = e.select("repo_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    bad = G.spread_mark(e, nodes.where(F.col("node").rlike(r"\.(json|md)$")))
    clean = nodes.join(bad, ["repo_id", "node"], "left_anti")
    related = dist.select("repo_id", F.col("start").alias("subject"), F.col("node").alias("member"), "distance")
    ranked = related.join(breadth.withColumnRenamed("node", "member"), ["repo_id", "member"], "left").na.fill(0, ["breadth"])
    sound = ranked.join(clean.withColumnRenamed("node", "member"), ["repo_id", "member"], "left_semi").join(clean.withColumnRenamed("node", "subject"), ["repo_id", "subject"], "left_semi")
    truth = R.round_robin(sound, KEYS, "distance", ["breadth", "member"], RIGHT).select(*KEYS, "member", "place")
    pool = _siblings(truth.select(*KEYS).distinct(), clean.withColumnRenamed("node", "member")).join(related.select(*KEYS, "member"), [*KEYS, "member"], "left_anti")
    return gate(distinct_truth(assemble(truth, _ranked(pool, ["member"], "tree"))))


def partners(s: SparkSession, d: str) -> DataFrame:
    pairs, lim = cut(V.cochange(s, d)), V.limits(s, d)
    ranked = H.rank_partners(H.capped_pairs(pairs, lim), H.floors(pairs, lim), RIGHT)
    truth = ranked.select("repo_id", "subject", F.col("partner").alias("member"), "place")
    met = H.both_ways(pairs).select("repo_id", "subject", F.col("partner").alias("member"))
    churn = V.touches(s, d, narrow=True).groupBy("repo_id", F.col("path").alias("member")).agg(F.count(F.lit(1)).alias("churn"))
    pool = _siblings(truth.select(*KEYS).distinct(), churn).join(met, [*KEYS, "member"], "left_anti").join(churn, ["repo_id", "member"])
    return gate(distinct_truth(assemble(truth, _ranked(pool, [F.desc("churn"), "member"], "busy"))))


def changed(s: SparkSession, d: str) -> DataFrame:
    c = V.commits(s, d).join(V.limits(s, d).select("repo_id", "wide_commit_files"), "repo_id").where(F.size("files").between(1, F.col("wide_commit_files")))
    c = cut(c.select("repo_id", "sha", "commit_date", "files"))
    truth = c.select("repo_id", F.col("sha").alias("subject"), F.posexplode(F.slice("files", 1, RIGHT)).alias("i", "member")).select(*KEYS, "member", (F.col("i") + 1).alias("place"))
    wrong = companions(c, RIGHT, 2, CANDIDATES).withColumn("strategy", F.lit("together"))
    return distinct_truth(assemble(truth, wrong))


def touching(s: SparkSession, d: str) -> DataFrame:
    c = cut(V.commits(s, d).select("repo_id", "sha", "commit_date", "files"))
    t = c.select("repo_id", F.explode("files").alias("subject"), F.col("sha").alias("member"), "commit_date")
    life = t.groupBy("repo_id", "subject").agg(F.min("commit_date").alias("lo"), F.max("commit_date").alias("hi"), F.count(F.lit(1)).alias("n")).where("n >= 3 and lo < hi")
    kept = t.join(life.select("repo_id", "subject"), ["repo_id", "subject"], "left_semi")
    truth = R.even_spread(kept, KEYS, ["commit_date", "member"], RIGHT)
    truth = R.top_per_group(truth, KEYS, ["commit_date", "member"], RIGHT).select(*KEYS, "member", "place")
    # wrong answers: commits that share a file with one that touched the subject, within its lifetime
    wrong = neighbours(c, life, CANDIDATES).withColumn("strategy", F.lit("neighbour"))
    return distinct_truth(assemble(truth, wrong))


TEMPLATES = {"dependents": dependents, "partners": partners, "changed": changed, "touching": touching}


def facts(kind: str, board: DataFrame) -> DataFrame:
    """What a board gives away once it is answered: ``repo_id, relation, one, other`` with both ends in byte order."""
    x = board.select("repo_id", "subject", F.explode("truth").alias("member"))
    relation = "touch" if kind in ("changed", "touching") else kind
    return x.select("repo_id", F.lit(relation).alias("relation"), F.least("subject", "member").alias("one"), F.greatest("subject", "member").alias("other")).distinct()


def hold_out(boards: DataFrame, kind_facts: DataFrame, served: DataFrame, share: int, max_rounds: int = 64) -> DataFrame:
    """Boards ``repo_id, kind, subject`` to hold back: every ``share``-th by rank, without any that the others give away.

    A board is refused while a fact of it is among the facts of served boards (all that are not held back); refused boards are served
    from then on, which may give away more, so the rounds go on until none is refused.
    """
    keys = ["repo_id", "kind", "subject"]
    held = cut(boards.select(*keys).withColumn("h", F.pmod(F.xxhash64(*keys), F.lit(share)) == 0))
    facts_ = kind_facts.select(*keys, "relation", "one", "other").unionByName(served.select(*keys, "relation", "one", "other")).distinct()
    for _ in range(max_rounds):
        out = facts_.join(held.where("h").select(*keys), keys, "left_semi")
        seen = facts_.join(held.where("h").select(*keys), keys, "left_anti").select("repo_id", "relation", "one", "other").distinct()
        refused = cut(out.join(seen, ["repo_id", "relation", "one", "other"], "left_semi").select(*keys).distinct())
        if refused.isEmpty():
            return held.where("h").select(*keys)
        held = cut(held.join(refused.withColumn("r", F.lit(True)), keys, "left").select(*keys, (F.col("h") & F.col("r").isNull()).alias("h")))
    raise RuntimeError(f"boards held back still give one another away after {max_rounds} rounds")
