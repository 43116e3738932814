"""Question boards over the whole pool: universe - subject - related - tainted, mixed from ranked strategies and filled up.

``plans/boards.py`` holds the boards that the project's SQL defines, with one strategy each out of a narrow pool. Here a board's wrong
answers may be any member of the repository that is not banned: the strategies of its template offer theirs, ``select_mix`` takes each one's
quota, and what is missing comes from a filler over the whole repository. A board that any guess of its template gives away is refused.

No subject is paired with a whole repository for the filler or the tree: the members of a lane (a repository, a folder, a set of name words)
are ranked once, and of a subject with b banned members the first 2 * CANDIDATES + b places hold all that can get onto its board.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeline.functions.paths import dir_name, dir_prefixes, jaccard, name_tokens, tokens
from lodeline.functions.scoring import f1
from lodeline.operators import graph as G
from lodeline.operators import history as H
from lodeline.operators import ranking as R
from lodeline.plans import views as V
from lodeline.plans.boards import CANDIDATES, GIVEN_AWAY, KEYS, RIGHT, distinct_truth
from lodeline.plans.whole_parts import made
from lodeline.session import cut

#: The strategies of each template and their shares.
MIX = {
    "dependents": {"adjacent": 0.36, "tree": 0.225, "name": 0.18, "together": 0.135, "key": 0.1},
    "partners": {"structural": 0.35, "busy": 0.25, "tree": 0.2, "name": 0.2},
    "changed": {"busy": 0.35, "together": 0.15, "structural": 0.15, "tree": 0.15, "name": 0.1, "mentioned": 0.1},
    "touching": {"neighbour": 0.4, "sibling": 0.25, "mentions": 0.2, "companion": 0.15},
}
FILLER = "distant"
#: How far cousins reach on the boards of dependents.
NEAR_HOPS = 2


def free(at: DataFrame, universe: DataFrame, banned: DataFrame, lane: list[str], order: list) -> DataFrame:
    """For every row of ``at`` (KEYS and its lane) the first members of that lane that are not banned, at least 2 * CANDIDATES where there are so many."""
    ranked = universe.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id", *lane).orderBy(*order)))
    sizes = universe.groupBy("repo_id", *lane).agg(F.count(F.lit(1)).alias("__n"))
    b = banned.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__b"))
    want = at.join(sizes, ["repo_id", *lane]).join(b, KEYS, "left")
    last = F.least(F.lit(2 * CANDIDATES) + F.coalesce("__b", F.lit(0)), F.col("__n"))
    want = want.withColumn("rank", F.explode(F.sequence(F.lit(1), last.cast("int")))).drop("__n", "__b")
    return want.join(ranked, ["repo_id", *lane, "rank"]).join(banned, [*KEYS, "member"], "left_anti")


def supply(pool: DataFrame, order: list, strategy: str) -> DataFrame:
    return R.top_per_group(pool, KEYS, order, CANDIDATES).select(*KEYS, "member", "place", F.lit(strategy).alias("strategy"))


def filler(subjects: DataFrame, universe: DataFrame, banned: DataFrame, order: list, strategy: str = FILLER) -> DataFrame:
    return supply(free(subjects.select(*KEYS), universe, banned, [], order), ["rank"], strategy)


def tree(anchors: DataFrame, universe: DataFrame, banned: DataFrame, order: list) -> DataFrame:
    """Members by the deepest folder they share with an anchor."""
    at = anchors.select(*KEYS, F.explode(dir_prefixes("anchor")).alias("prefix")).distinct()
    got = free(at, universe.withColumn("prefix", F.explode(dir_prefixes("member"))), banned, ["prefix"], order)
    best = got.withColumn("depth", F.size(F.split("prefix", "/", -1)))
    best = R.top_per_group(best, [*KEYS, "member"], [F.desc("depth"), "prefix"], 1).drop("place")
    return supply(best, [F.desc("depth"), *order], "tree")


def names(anchors: DataFrame, universe: DataFrame, banned: DataFrame) -> DataFrame:
    """Members by the overlap of their name's words with an anchor's; files of equal words are compared once."""
    words = lambda c: F.array_sort(F.array_distinct(name_tokens(c)))
    u = universe.select("repo_id", "member", words("member").alias("set"))
    a = anchors.select(*KEYS, words("anchor").alias("own")).distinct()
    first = u.groupBy("repo_id", "set").agg(F.min("member").alias("first"))
    left = a.select("repo_id", "own").distinct().withColumn("word", F.explode("own"))
    pairs = left.join(first.withColumn("word", F.explode("set")), ["repo_id", "word"]).select("repo_id", "own", "set", "first").distinct().withColumn("sim", jaccard(F.col("own"), F.col("set")))
    ranked = pairs.withColumn("near", F.row_number().over(Window.partitionBy("repo_id", "own").orderBy(F.desc("sim"), "first")))
    # of b banned members at most b sets ahead can have none to offer
    b = banned.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__b"))
    at = a.join(ranked, ["repo_id", "own"]).join(b, KEYS, "left").where(F.col("near") <= F.lit(CANDIDATES) + F.coalesce("__b", F.lit(0))).groupBy(*KEYS, "set").agg(F.max("sim").alias("sim"))
    return supply(free(at, u, banned, ["set"], ["member"]), [F.desc("sim"), "member"], "name")


def rings(anchors: DataFrame, around: DataFrame, universe: DataFrame, banned: DataFrame, deepest: int | None = None) -> DataFrame:
    """Free members of the universe by hops from the anchors, ring after ring until a board's worth is found; a ring is taken whole."""
    seen = anchors.select(*KEYS, F.col("anchor").alias("member")).distinct()
    frontier, found, hop = seen, None, 0
    while deepest is None or hop < deepest:
        hop += 1
        ring = cut(frontier.withColumnRenamed("member", "src").join(around, ["repo_id", "src"]).select(*KEYS, F.col("dst").alias("member")).distinct().join(seen, [*KEYS, "member"], "left_anti"))
        if ring.isEmpty():
            break
        hits = ring.join(universe, ["repo_id", "member"]).join(banned, [*KEYS, "member"], "left_anti").withColumn("hop", F.lit(hop))
        found = cut(hits if found is None else found.unionByName(hits))
        seen = cut(seen.unionByName(ring))
        full = found.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= CANDIDATES).select(*KEYS)
        frontier = ring.join(full, KEYS, "left_anti")
    return seen.join(universe, ["repo_id", "member"]).withColumn("hop", F.lit(0)).limit(0) if found is None else found


def sizes(truth: DataFrame, filled: DataFrame) -> DataFrame:
    """``size`` of each board: the truth on offer against the pool, of which the filler holds CANDIDATES wherever there are so many."""
    n = truth.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("supply")).join(filled.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("pool")), KEYS)
    return n.select(*KEYS, R.truth_size(F.col("pool"), F.col("supply"), RIGHT).alias("size")).where("size > 0")


def members(right: DataFrame, size: DataFrame, supplies: list[DataFrame], filled: DataFrame, kind: str) -> DataFrame:
    """``KEYS, member, how``: the right answers and the mix of wrong ones."""
    every = filled
    for x in supplies:
        every = every.unionByName(x)
    every = every.join(size.select(*KEYS, (F.lit(CANDIDATES) - F.col("size")).alias("want")), KEYS)
    mix = R.select_mix(every, [*KEYS, "want"], "member", list(MIX[kind]), list(MIX[kind].values()), "want", FILLER)
    return right.select(*KEYS, "member", F.lit("-").alias("how")).unionByName(mix.select(*KEYS, "member", F.col("strategy").alias("how")))


def gathered(rows: DataFrame) -> DataFrame:
    """The boards of their members, one for each set of right answers."""
    return shown(rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("member", "how"))).alias("m")))


def shown(boards: DataFrame) -> DataFrame:
    """The boards of their sorted members ``m``, one for each set of right answers."""
    board = boards.select(
        *KEYS,
        F.transform("m", lambda x: x["member"]).alias("candidates"),
        F.transform(F.filter("m", lambda x: x["how"] == "-"), lambda x: x["member"]).alias("truth"),
        F.array_join(F.transform("m", lambda x: x["how"]), " ").alias("witness"),
    )
    return distinct_truth(board)


def _files(s: SparkSession, d: str) -> DataFrame:
    """``repo_id, member, churn``: every file that a commit touched; wide commits make no churn."""
    churn = V.touches(s, d, narrow=True).groupBy("repo_id", F.col("path").alias("member")).agg(F.count(F.lit(1)).alias("churn"))
    return cut(V.touches(s, d).select("repo_id", F.col("path").alias("member")).distinct().join(churn, ["repo_id", "member"], "left").na.fill(0, ["churn"]))


def _self(subjects: DataFrame) -> DataFrame:
    return subjects.select(*KEYS, F.col("subject").alias("anchor"))


def dependents(s: SparkSession, d: str) -> DataFrame:
    e = cut(V.edges(s, d))
    dist = cut(G.reach(G.flip(e)))
    breadth = G.cone_sizes(dist).select("repo_id", F.col("node").alias("member"), "breadth")
    nodes = e.select("repo_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    clean = cut(nodes.join(G.spread_mark(e, nodes.where(F.col("node").rlike(r"\.(json|md)$"))), ["repo_id", "node"], "left_anti").withColumnRenamed("node", "member"))
    indegree = e.groupBy("repo_id", F.col("dst").alias("member")).agg(F.count(F.lit(1)).alias("indegree"))
    universe = cut(clean.join(indegree, ["repo_id", "member"], "left").na.fill(0, ["indegree"]))
    related = dist.select("repo_id", F.col("start").alias("subject"), F.col("node").alias("member"), "distance")
    sound = related.join(breadth, ["repo_id", "member"], "left").na.fill(0, ["breadth"]).join(clean, ["repo_id", "member"], "left_semi").join(clean.withColumnRenamed("member", "subject"), ["repo_id", "subject"], "left_semi")
    truth = cut(R.round_robin(sound, KEYS, "distance", ["breadth", "member"], RIGHT).select(*KEYS, "member", "place"))
    subjects = truth.select(*KEYS).distinct()
    banned = cut(related.select(*KEYS, "member").unionByName(_self(subjects).withColumnRenamed("anchor", "member")).join(subjects, KEYS, "left_semi").distinct())
    order = [F.desc("indegree"), "member"]
    filled = cut(filler(subjects, universe, banned, order))
    size = cut(sizes(truth, filled))
    right = truth.join(size, KEYS).where("place <= size").select(*KEYS, "member", "place")
    at = _self(size)
    # what the subject depends on, nearest first, then cousins
    deps = dist.select("repo_id", F.col("node").alias("subject"), F.col("start").alias("member"), F.col("distance").alias("hop")).join(size.select(*KEYS), KEYS, "left_semi")
    down = deps.join(universe, ["repo_id", "member"]).join(banned, [*KEYS, "member"], "left_anti").withColumn("turn", F.lit(0))
    near = rings(at, G.both_ways(e).select("repo_id", "src", "dst"), universe, banned, NEAR_HOPS).join(down.select(*KEYS, "member"), [*KEYS, "member"], "left_anti").withColumn("turn", F.lit(1))
    met = H.both_ways(V.cochange(s, d)).select("repo_id", "subject", F.col("partner").alias("member"), "n")
    met = met.join(size.select(*KEYS), KEYS, "left_semi").join(clean, ["repo_id", "member"], "left_semi").join(banned, [*KEYS, "member"], "left_anti")
    beside = right.select(*KEYS, dir_name(dir_name("member")).alias("prefix"), "place").where("prefix <> ''").groupBy(*KEYS, "prefix").agg(F.min("place").alias("bucket"))
    inside = free(beside, clean.withColumn("prefix", F.explode(dir_prefixes("member"))), banned, ["prefix"], ["member"])
    inside = R.top_per_group(inside, [*KEYS, "member"], ["bucket"], 1).drop("place", "rank")
    inside = inside.withColumn("turn", F.row_number().over(Window.partitionBy(*KEYS, "bucket").orderBy("member")))
    lanes = [
        supply(down.unionByName(near), ["turn", "hop", *order], "adjacent"),
        tree(at, clean, banned, ["member"]),
        names(at, clean, banned),
        supply(met, [F.desc("n"), "member"], "together"),
        supply(inside, ["turn", "bucket"], "key"),
    ]
    return members(right, size, lanes, filled, "dependents")


def _partners(s: SparkSession, d: str) -> DataFrame:
    pairs, lim = cut(V.cochange(s, d)), V.limits(s, d)
    ranked = cut(H.rank_partners(H.capped_pairs(pairs, lim), H.floors(pairs, lim), RIGHT))
    truth = ranked.select("repo_id", "subject", F.col("partner").alias("member"), "place")
    return made(s, d, "partners", MIX["partners"], FILLER, truth=truth)


def partners(s: SparkSession, d: str) -> DataFrame:
    return _opened(_partners(s, d))


def changed(s: SparkSession, d: str) -> DataFrame:
    return _opened(made(s, d, "changed", MIX["changed"], FILLER))


def touching(s: SparkSession, d: str) -> DataFrame:
    return _opened(made(s, d, "touching", MIX["touching"], FILLER))


def _opened(boards: DataFrame) -> DataFrame:
    return boards.select(*KEYS, F.explode("m").alias("x")).select(*KEYS, "x.member", "x.how")


#: The guesses that a template's boards invite.
GUESSES = {
    "dependents": ("directory", "name", "partition"),
    "partners": ("directory", "name", "churn", "partition"),
    "changed": ("name", "churn", "recency", "partition"),
    "touching": ("mentions", "endpoints", "oldestK", "recentK", "broadKnown"),
}


def guess_scores(rows: DataFrame, picks: dict[str, Column], partition: bool) -> DataFrame:
    """``KEYS, guess, score``: every guess of ``picks`` (whether it takes a member) on every board, and the partition guess.

    ``rows`` has a row for each member with the columns that the picks read and ``right``. The partition guess takes the folder, at any depth, that holds
    exactly as many candidates as there are right ones, the best of several; a single right answer is guessed only when one folder is of that size.
    """
    one = rows.select(*KEYS, "right", *[F.coalesce(x, F.lit(False)).alias(g) for g, x in picks.items()])
    long = one.unpivot([*KEYS, "right"], list(picks), "guess", "taken")
    score = long.groupBy(*KEYS, "guess").agg(F.count_if("right").alias("n"), F.count_if("taken").alias("picked"), F.count_if(F.col("taken") & F.col("right")).alias("hits"))
    score = score.select(*KEYS, "guess", f1(F.col("hits"), F.col("picked"), F.col("n")).alias("score"))
    if not partition:
        return score
    n = rows.groupBy(*KEYS).agg(F.count_if("right").alias("n"))
    groups = rows.select(*KEYS, "right", F.explode(dir_prefixes("member")).alias("prefix")).groupBy(*KEYS, "prefix").agg(F.count(F.lit(1)).alias("picked"), F.count_if("right").alias("hits"))
    best = groups.join(n, KEYS).where("picked = n").groupBy(*KEYS, "n").agg(F.max("hits").alias("hits"), F.count(F.lit(1)).alias("folders"))
    found = best.where("n >= 2 or folders = 1").select(*KEYS, f1(F.col("hits"), F.col("n"), F.col("n")).alias("score"))
    return score.unionByName(n.select(*KEYS).join(found, KEYS, "left").select(*KEYS, F.lit("partition").alias("guess"), F.coalesce("score", F.lit(0.0)).alias("score")))


def scored(s: SparkSession, d: str, kind: str, rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``KEYS, guess, score`` of the guesses of a template on its boards.

    ``known`` (``repo_id, sha``) are the commits whose number of files an answered board has told; without it broadKnown takes nothing.
    """
    x = rows.withColumn("right", F.col("how") == "-")
    w = Window.partitionBy(*KEYS)
    x = x.withColumn("n", F.count_if("right").over(w))
    first = lambda *o: F.row_number().over(w.orderBy(*o)) <= F.col("n")
    shares = lambda a, b: F.arrays_overlap(a, b)
    if kind == "touching":
        told = known.select("repo_id", F.col("sha").alias("member")).distinct().withColumn("known", F.lit(True)) if known is not None else None
        c = V.commits(s, d).select("repo_id", F.col("sha").alias("member"), F.col("commit_date").alias("day"), tokens("subject").alias("said"), F.size("files").alias("width"))
        life = V.touches(s, d).groupBy("repo_id", F.col("path").alias("subject")).agg(F.min("commit_date").alias("lo"), F.max("commit_date").alias("hi"))
        x = x.join(c, ["repo_id", "member"]).join(life, KEYS)
        x = x.withColumn("known", F.lit(False)) if told is None else x.join(told, ["repo_id", "member"], "left").na.fill(False, ["known"])
        x = x.withColumn("old", first("day", "member")).withColumn("new", first(F.desc("day"), "member")).withColumn("broad", F.col("known") & first(F.desc("known"), F.desc("width"), "member"))
        picks = {
            "mentions": shares("said", name_tokens("subject")),
            "endpoints": (F.col("day") == F.col("lo")) | (F.col("day") == F.col("hi")),
            "oldestK": F.col("old"),
            "recentK": F.col("new"),
            "broadKnown": F.col("broad"),
        }
    else:
        last = V.touches(s, d).groupBy("repo_id", F.col("path").alias("member")).agg(F.max("commit_date").alias("last"))
        x = x.join(_files(s, d), ["repo_id", "member"], "left").na.fill(0, ["churn"]).join(last, ["repo_id", "member"], "left")
        x = x.withColumn("busy", first(F.desc("churn"), "member"))
        picks = {"directory": dir_name("member") == dir_name("subject"), "name": shares(name_tokens("member"), name_tokens("subject")), "churn": F.col("busy")}
        if kind == "changed":
            said = V.commits(s, d).select("repo_id", F.col("sha").alias("subject"), tokens("subject").alias("said"), F.col("commit_date").alias("day"))
            x = x.join(said, KEYS)
            picks |= {"name": shares(name_tokens("member"), "said"), "recency": F.col("last") == F.col("day")}
        picks = {g: p for g, p in picks.items() if g in GUESSES[kind]}
    return guess_scores(x, picks, "partition" in GUESSES[kind])


def gate(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """The members of the boards that no guess gives away."""
    return rows.join(scores.where(F.col("score") >= GIVEN_AWAY).select(*KEYS).distinct(), KEYS, "left_anti")


MEMBERS = {"dependents": dependents, "partners": partners, "changed": changed, "touching": touching}


def boards(s: SparkSession, d: str, kind: str, known: DataFrame | None = None) -> DataFrame:
    """The boards of a template that no guess gives away, one for each set of right answers."""
    if kind != "dependents":
        m = _partners(s, d) if kind == "partners" else made(s, d, kind, MIX[kind], FILLER, known)
        return shown(m.where(F.col("best") < GIVEN_AWAY).drop("best"))
    rows = cut(MEMBERS[kind](s, d))
    return gathered(gate(rows, scored(s, d, kind, rows, known)))
