"""Boards over the whole pool against brute force over the smallest tables."""

from collections import defaultdict
from pathlib import Path

import pytest

from lodeline.plans import views as V
from lodeline.plans import whole_boards as W
from lodeline.plans import whole_parts as P

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def sized(pool, supply):
    return max((s for s in range(1, W.RIGHT + 1) if s <= supply and min(pool, W.CANDIDATES - s) > 2 * s), default=0)


def seen(rows):
    boards = defaultdict(dict)
    for r in rows:
        assert r["member"] not in boards[r["repo_id"], r["subject"]]
        boards[r["repo_id"], r["subject"]][r["member"]] = r["how"]
    return boards


def test_changed_draws_on_all_files(spark):
    touches = V.touches(spark, str(DATA)).collect()
    files, of = defaultdict(set), defaultdict(set)
    for r in touches:
        files[r["repo_id"]].add(r["path"])
    for r in V.touches(spark, str(DATA), narrow=True).collect():
        of[r["repo_id"], r["sha"]].add(r["path"])
    got = seen(W.changed(spark, str(DATA)).collect())
    for (repo, sha), own in of.items():
        pool = len(files[repo] - own)
        size = sized(pool, len(own))
        board = got.get((repo, sha), {})
        assert sum(h == "-" for h in board.values()) == size
        assert len(board) == (size + min(pool, W.CANDIDATES - size) if size else 0)
        assert all((m in own) == (h == "-") for m, h in board.items())
    # files at a repository's root stand on boards too
    assert any("/" not in m for b in got.values() for m, h in b.items() if h != "-")


def test_touching_draws_on_the_lifetime(spark):
    by, days = defaultdict(set), defaultdict(dict)
    for r in V.commits(spark, str(DATA)).where("commit_date is not null").collect():
        days[r["repo_id"]][r["sha"]] = r["commit_date"]
        for f in r["files"]:
            by[r["repo_id"], f].add(r["sha"])
    got = seen(W.touching(spark, str(DATA)).collect())
    for (repo, f), own in by.items():
        lo, hi = min(days[repo][x] for x in own), max(days[repo][x] for x in own)
        pool = sum(lo <= day <= hi for sha, day in days[repo].items() if sha not in own)
        size = sized(pool, len(own)) if len(own) >= 3 and lo < hi else 0
        board = got.get((repo, f), {})
        assert len(board) == (size + min(pool, W.CANDIDATES - size) if size else 0)
        assert all((m in own) == (h == "-") and lo <= days[repo][m] <= hi for m, h in board.items())


def test_filler_passes_what_is_banned(spark):
    universe = spark.createDataFrame([(1, f"f{i:03}") for i in range(100)], "repo_id long, member string")
    banned = spark.createDataFrame([(1, "README.md", f"f{i:03}") for i in range(60)], "repo_id long, subject string, member string")
    got = W.filler(banned.select(*W.KEYS).distinct(), universe, banned, ["member"])
    assert sorted(r["member"] for r in got.collect()) == [f"f{i:03}" for i in range(60, 79)]


def test_every_guess_refuses(spark):
    rows = spark.createDataFrame(
        [(1, "a/x.ts", m, h) for m, h in [("b/p.ts", "-"), ("b/q.ts", "-"), *[(f"c/w{i}.ts", "busy") for i in range(6)]]]
        + [(1, "a/y.ts", m, h) for m, h in [("b/p.ts", "-"), ("c/q.ts", "-"), *[(f"b/w{i}.ts", "busy") for i in range(6)]]],
        "repo_id long, subject string, member string, how string",
    )
    picks = {"first": W.F.col("member") == "c/q.ts", "both": W.F.col("how") == "-"}
    marked = rows.withColumn("right", W.F.col("how") == "-")
    score = {(r["subject"], r["guess"]): r["score"] for r in W.guess_scores(marked, picks, True).collect()}
    assert score["a/x.ts", "partition"] == 1 and score["a/y.ts", "partition"] == 0
    assert score["a/x.ts", "first"] == 0 and score["a/y.ts", "first"] == 2 / 3 and score["a/y.ts", "both"] == 1
    kept = W.gate(rows, W.guess_scores(marked, {"first": picks["first"]}, True)).select("subject").distinct().collect()
    assert [r["subject"] for r in kept] == ["a/y.ts"]


def test_commit_guesses_equal_brute_force(spark):
    d = str(DATA)
    commits = {(r["repo_id"], r["sha"]): r for r in V.commits(spark, d).collect()}
    touched = defaultdict(list)
    for (repo, _), r in commits.items():
        for f in r["files"]:
            touched[repo, f].append(r["commit_date"])
    rows = spark.createDataFrame(W.touching(spark, d).collect())
    known = spark.createDataFrame([k for i, k in enumerate(sorted(commits)) if i % 2], "repo_id long, sha string")
    told = {tuple(r) for r in known.collect()}
    got = {(r["repo_id"], r["subject"], r["guess"]): r["score"] for r in W.scored(spark, d, "touching", rows, known).collect()}
    for (repo, f), board in seen(rows.collect()).items():
        key = {m for m, h in board.items() if h == "-"}
        day = lambda m: commits[repo, m]["commit_date"]  # noqa: B023, E731
        ends = {min(touched[repo, f]), max(touched[repo, f])}
        wide = sorted((m for m in board if (repo, m) in told), key=lambda m: (-len(commits[repo, m]["files"]), m))  # noqa: B023
        new = sorted(sorted(board), key=day, reverse=True)
        guesses = {"oldestK": sorted(board, key=lambda m: (day(m), m))[: len(key)], "recentK": new[: len(key)], "endpoints": [m for m in board if day(m) in ends], "broadKnown": wide[: len(key)]}  # noqa: B023
        for g, taken in guesses.items():
            hits = len(key & set(taken))
            assert got[repo, f, g] == pytest.approx(2 * hits / (len(taken) + len(key)))


def test_scores_of_the_parts_equal_those_of_the_rows(spark, monkeypatch):
    """The guesses scored in numbers against the same guesses over rows, with repositories in several parts."""
    monkeypatch.setattr(P, "TOUCHES", 150)
    d = str(DATA)
    known = spark.createDataFrame([r for i, r in enumerate(sorted(V.commits(spark, d).select("repo_id", "sha").collect())) if i % 2], "repo_id long, sha string")
    for kind in P.MAKE:
        made = P.made(spark, d, kind, W.MIX[kind], W.FILLER, known).collect()
        rows = spark.createDataFrame([(r["repo_id"], r["subject"], x["member"], x["how"]) for r in made for x in r["m"]], "repo_id long, subject string, member string, how string")
        best = {tuple(r) for r in W.scored(spark, d, kind, rows, known).groupBy(*W.KEYS).agg(W.F.max("score")).collect()}
        assert made and {(r["repo_id"], r["subject"]): r["best"] for r in made} == pytest.approx({(a, b): s for a, b, s in best})


def lanes_by_rows(spark, d):
    """The lanes of changed boards as relations: what the parts must take from."""
    t = V.touches(spark, d, narrow=True).select("repo_id", W.F.col("sha").alias("subject"), W.F.col("path").alias("member"))
    right = spark.createDataFrame(W.changed(spark, d).where("how = '-'").select("repo_id", "subject", W.F.col("member").alias("anchor")).collect(), "repo_id long, subject string, anchor string")
    universe, order = W._files(spark, d), [W.F.desc("churn"), "member"]
    pairs = W.H.both_ways(V.cochange(spark, d)).where("n >= 2").select("repo_id", W.F.col("subject").alias("src"), W.F.col("partner").alias("dst"))
    return {
        "tree": W.tree(right, universe, t, order),
        "name": W.names(right, universe, t),
        "structural": W.supply(W.rings(right, W.cut(pairs), universe, t), ["hop", *order], "structural"),
        "busy": W.filler(right.select(*W.KEYS).distinct(), universe.where("churn > 0"), t, order, "busy"),
    }


def test_lanes_of_the_parts_equal_those_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "TOUCHES", 150)
    d = str(DATA)
    seen_lanes = {}
    taken = P.R.mixed

    want = {k: defaultdict(dict) for k in ("tree", "name", "structural", "busy")}
    for k, lane in lanes_by_rows(spark, d).items():
        for r in lane.collect():
            want[k][r["repo_id"], r["subject"]][r["place"]] = r["member"]
    commits = defaultdict(list)
    lim = {r["repo_id"]: r["wide_commit_files"] for r in V.limits(spark, d).collect()}
    for r in V.commits(spark, d).collect():
        commits[r["repo_id"]].append({"sha": r["sha"], "commit_date": r["commit_date"], "files": r["files"], "said": [], "narrow": len(r["files"]) <= lim[r["repo_id"]], "known": False})
    kinds = P.pa.schema([("sha", P.pa.string()), ("commit_date", P.pa.date32()), ("files", P.pa.list_(P.pa.string())), ("said", P.pa.list_(P.pa.string())), ("narrow", P.pa.bool_()), ("known", P.pa.bool_())])
    for repo, rows in commits.items():
        x = P.Repo(P.pa.Table.from_pylist(rows, kinds))
        mix = lambda lanes, filled, count: (seen_lanes.update(now={k: [x.paths[f] for f in v] for k, v in lanes.items()}), taken({**lanes, "distant": filled}, list(W.MIX["changed"]), list(W.MIX["changed"].values()), count, "distant"))[1]  # noqa: B023, E731
        for subject, *_ in P.changed(x, range(len(x.shas)), mix):
            for k in want:
                got = want[k].get((repo, subject), {})
                assert seen_lanes["now"][k] == [got[i] for i in sorted(got)], (k, repo, subject)


def test_changed_makes_no_rows_of_lanes(spark):
    """Neither the lanes nor the ranks of banned members are rows: the plan of the boards has one shuffle of commits by part and no checkpoint."""
    plan = W.boards(spark, str(DATA), "changed")._jdf.queryExecution().optimizedPlan().toString()
    assert "rank" not in plan and "prefix" not in plan and "FlatMapGroupsInArrow" in plan


def test_partners_are_made_by_part(spark, monkeypatch):
    """Scores and lanes of the boards of partners in several parts, against the same over rows; the plan makes no rows of lanes."""
    monkeypatch.setattr(P, "TOUCHES", 150)
    d = str(DATA)
    made = W._partners(spark, d)
    assert "FlatMapCoGroupsInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    boards = made.collect()
    rows = spark.createDataFrame([(r["repo_id"], r["subject"], x["member"], x["how"]) for r in boards for x in r["m"]], "repo_id long, subject string, member string, how string")
    best = {tuple(r) for r in W.scored(spark, d, "partners", rows).groupBy(*W.KEYS).agg(W.F.max("score")).collect()}
    assert boards and {(r["repo_id"], r["subject"]): r["best"] for r in boards} == pytest.approx({(a, b): s for a, b, s in best})
    met = defaultdict(set)
    for r in W.H.both_ways(V.cochange(spark, d)).collect():
        met[r["repo_id"], r["subject"]].add(r["partner"])
    assert all((r["member"] in met[r["repo_id"], r["subject"]]) == (r["how"] == "-") for r in rows.collect())
    ask = rows.select(*W.KEYS).distinct()
    at, universe = W._self(ask), W._files(spark, d)
    banned = spark.createDataFrame([(*k, x) for k, v in met.items() for x in v | {k[1]}], "repo_id long, subject string, member string").join(ask, W.KEYS, "left_semi")
    lanes = {"tree": W.tree(at, universe, banned, ["member"]), "name": W.names(at, universe, banned), "busy": W.filler(ask, universe.where("churn > 0"), banned, [W.F.desc("churn"), "member"], "busy")}
    offered = {k: {(r["repo_id"], r["subject"], r["member"]) for r in x.collect()} for k, x in lanes.items()}
    assert all((r["repo_id"], r["subject"], r["member"]) in offered[r["how"]] for r in rows.collect() if r["how"] in offered)
