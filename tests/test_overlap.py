"""Commits that share files, against brute force; no pair of a file and a commit is shuffled."""

import random
from collections import defaultdict
from datetime import date, timedelta

from pyspark.sql import functions as F

from lodeline.operators import overlap as O
from lodeline.plans import board_queries as Q
from lodeline.plans import boards as B

DAY = date(2024, 1, 1)


def history(spark, n=120, files=25, seed=1):
    r = random.Random(seed)
    rows = [(repo, f"{r.randrange(1 << 30):08x}", None if r.random() < 0.05 else DAY + timedelta(r.randrange(40)), sorted({f"d{r.randrange(3)}/é{r.randrange(files)}.ts" for _ in range(r.randrange(5))})) for repo in (1, 2) for _ in range(n)]
    return spark.createDataFrame(rows, "repo_id long, sha string, commit_date date, files array<string>"), rows


def lives(rows):
    of = defaultdict(dict)
    for repo, sha, day, files in rows:
        for f in files:
            of[repo, f][sha] = day
    dated = {k: [x for x in v.values() if x] for k, v in of.items()}
    return of, [(*k, min(x), max(x)) for k, x in dated.items() if len(x) > 2]


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(O.parts, "__defaults__", ("subject", 7))  # several parts a repository
    commits, rows = history(spark)
    of, spans = lives(rows)
    want = set()
    for repo, f, lo, hi in spans:
        via = {g for r, sha, _, files in rows if r == repo and f in files for g in files if g != f}
        pool = [(-len(via & set(files)), sha) for r, sha, day, files in rows if r == repo and day and lo <= day <= hi and f not in files and via & set(files)]
        want |= {(repo, f, sha, i) for i, (_, sha) in enumerate(sorted(pool)[:4], 1)}
    subjects = spark.createDataFrame(spans, "repo_id long, subject string, lo date, hi date")
    assert {tuple(r) for r in O.neighbours(commits, subjects, 4).collect()} == want
    assert O.neighbours(commits.limit(0), subjects, 4).count() == 0 and O.neighbours(commits, subjects.limit(0), 4).count() == 0


def test_touching_shuffles_no_pairs(spark, monkeypatch):
    """Files that all meet one another: 200 commits of 40 files make 1.6 million pairs of a file, a file beside it and a commit."""
    rows = [(1, f"{i:08x}", DAY + timedelta(i % 30), "s", sorted(f"f{(i + j) % 60:02}.ts" for j in range(40))) for i in range(200)]
    commits = spark.createDataFrame(rows, "repo_id long, sha string, commit_date date, subject string, files array<string>")
    monkeypatch.setattr(B.V, "commits", lambda s, d: commits)
    boards = B.touching(spark, "")
    assert boards.count() > 0
    assert "via" not in boards._jdf.queryExecution().optimizedPlan().toString()
    assert boards.select(F.explode("candidates")).count() <= 60 * B.CANDIDATES


def test_companions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(O.parts, "__defaults__", ("subject", 7))
    monkeypatch.setattr(O, "SUBJECTS", 5)
    commits, rows = history(spark)
    want = set()
    for repo, sha, _, files in rows:
        n = defaultdict(int)
        for a in sorted(files)[:2]:
            for g in {g for r, _, _, x in rows if r == repo and a in x for g in x} - set(files):
                n[g] = max(n[g], sum(r == repo and a in x and g in x for r, _, _, x in rows))
        want |= {(repo, sha, g, i) for i, (_, g) in enumerate(sorted((-v, g) for g, v in n.items() if v >= 2)[:5], 1)}
    assert {tuple(r) for r in O.companions(commits, 2, 2, 5).collect()} == want
    assert O.companions(commits.limit(0), 2, 2, 5).count() == 0


def test_wrong_truth_explodes_no_touches(spark, monkeypatch):
    """A wrong verdict is counted, and the touches are read by commit."""
    rows = [(1, f"c{i:02}", DAY + timedelta(i % 7), [f"f{(i + j) % 9}.ts" for j in range(3)]) for i in range(30)]
    commits = spark.createDataFrame(rows, "repo_id long, sha string, commit_date date, files array<string>")
    board = lambda subject, candidates, truth: spark.createDataFrame([(1, subject, candidates, truth)], "repo_id long, subject string, candidates array<string>, truth array<string>")
    monkeypatch.setattr(Q.V, "commits", lambda s, d: commits)
    monkeypatch.setattr(Q.B, "changed", lambda s, d: board("c00", ["f0.ts", "f1.ts", "f5.ts"], ["f0.ts", "f5.ts"]))  # f1 is missing, f5 wrong
    monkeypatch.setattr(Q.B, "touching", lambda s, d: board("f0.ts", ["c00", "c01", "c09"], ["c00", "c09"]))
    got = Q.boards_wrong_truth(spark, "")
    assert {tuple(r) for r in got.collect()} == {("changed", 2), ("touching", 0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(files" not in plan
