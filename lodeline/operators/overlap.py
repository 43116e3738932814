"""Commits that share files, counted repository by repository in numbers instead of pairs of rows.

Who shares a file with whom makes far more pairs than there are commits, and a shuffle of them is what fills the disk. Here the commits of a
repository travel once for every ``SUBJECTS`` subjects, a task holds one such part, and pairs exist only while one subject is counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Subjects that one task counts; a repository of more is split and its commits go to every part.
SUBJECTS = 512


def parts(commits: DataFrame, subjects: DataFrame, by: str = "subject", size: int = SUBJECTS) -> tuple[DataFrame, DataFrame]:
    """Both with ``repo, part``: each subject in one of its repository's parts, the commits in all of them."""
    n = subjects.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("__n"))
    commits, subjects = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (commits, subjects))
    left = commits.join(n, "repo_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumnRenamed("repo_id", "repo").drop("__n")
    right = subjects.join(n, "repo_id").withColumn("part", F.pmod(F.xxhash64(by), F.col("__n")).cast("int")).withColumnRenamed("repo_id", "repo").drop("__n")
    return left, right


def gather(starts: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of the given rows of a ragged array, one after another."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - ends + sizes, sizes)]


class Commits:
    """The commits of one repository (``sha, commit_date, files``): commits are numbered in the order of their sha, files in that of their path."""

    def __init__(self, t: pa.Table) -> None:
        t = t.take(pc.sort_indices(t["sha"]))
        self.shas = t["sha"].to_pylist()
        day = t["commit_date"].combine_chunks().cast(pa.int32())
        self.dated = np.asarray(day.is_valid())
        self.days = np.asarray(day.fill_null(0))
        files = t["files"].combine_chunks()
        flat = files.flatten().dictionary_encode()
        names = flat.dictionary
        order = np.asarray(pc.sort_indices(names))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.paths = names.take(pa.array(order)).to_pylist()
        self.number = {p: i for i, p in enumerate(self.paths)}
        #: The files of each commit, and the commits of each file, both in rising numbers.
        self.sizes = np.asarray(pc.list_value_length(files).fill_null(0))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.files = rank[np.asarray(flat.indices)] if len(flat) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(self.shas)), self.sizes)
        by_file = np.argsort(self.files, kind="stable")
        self.at = np.concatenate(([0], np.cumsum(np.bincount(self.files, minlength=len(self.paths)))))
        self.of = owner[by_file]

    def touching(self, file: int) -> np.ndarray:
        return self.of[self.at[file] : self.at[file + 1]]

    def together(self, commits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The files of these commits and the number of commits of each."""
        return np.unique(gather(self.starts, self.files, commits), return_counts=True)

    def sharing(self, files: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The commits that touch any of the files and how many of them each touches."""
        return np.unique(gather(self.at, self.of, files), return_counts=True)


def first(members: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` members of the highest scores; ties go to the lower number."""
    if len(members) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(members))
    return at[np.lexsort((members[at], -scores[at]))][:k]


def neighbours(commits: DataFrame, subjects: DataFrame, k: int) -> DataFrame:
    """``repo_id, subject, member, place``: of every file the first ``k`` commits within its lifetime that do not touch it, by the files they share with commits that do.

    ``commits`` has ``repo_id, sha, commit_date, files`` (a set), ``subjects`` has ``repo_id, subject, lo, hi`` (days, both included). Commits without a date lie in no lifetime.
    """
    left, right = parts(commits.select("repo_id", "sha", "commit_date", "files"), subjects.select("repo_id", "subject", F.col("lo").cast("date"), F.col("hi").cast("date")))
    repo = commits.schema["repo_id"].dataType.simpleString()

    def count(key: tuple, l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        found: list[tuple[str, str, int]] = []
        if l.num_rows and r.num_rows:
            c = Commits(l)
            for subject, lo, hi in zip(r["subject"].to_pylist(), r["lo"].cast(pa.int32()).to_pylist(), r["hi"].cast(pa.int32()).to_pylist(), strict=True):
                file = c.number[subject]
                own = c.touching(file)
                via, _ = c.together(own)
                members, shared = c.sharing(via[via != file])
                good = c.dated[members] & (c.days[members] >= lo) & (c.days[members] <= hi) & ~np.isin(members, own)
                members, shared = members[good], shared[good]
                found += [(subject, c.shas[members[i]], n) for n, i in enumerate(first(members, shared, k), 1)]
        subject, member, place = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.int64()), pa.array(subject, pa.string()), pa.array(member, pa.string()), pa.array(place, pa.int32())], ["repo_id", "subject", "member", "place"])

    return left.groupBy("repo", "part").cogroup(right.groupBy("repo", "part")).applyInArrow(count, f"repo_id {repo}, subject string, member string, place int")


def companions(commits: DataFrame, anchors: int, least: int, k: int) -> DataFrame:
    """``repo_id, subject, member, place``: of every commit the first ``k`` files beside its own, by the most commits that they share with one of its first ``anchors`` files, ``least`` or more.

    ``commits`` has ``repo_id, sha, commit_date, files`` (a set, sorted); all of them count.
    """
    left, right = parts(commits.select("repo_id", "sha", "commit_date", "files"), commits.where(F.size("files") > 0).select("repo_id", F.col("sha").alias("subject")), size=4 * SUBJECTS)
    repo = commits.schema["repo_id"].dataType.simpleString()

    def count(key: tuple, l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        found: list[tuple[str, str, int]] = []
        c = Commits(l)
        number = {x: i for i, x in enumerate(c.shas)}
        beside: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for subject in r["subject"].to_pylist():
            own = c.files[c.starts[number[subject]] : c.starts[number[subject] + 1]]
            near = []
            for f in own[:anchors]:
                if f not in beside:
                    files, n = c.together(c.touching(f))
                    beside[f] = files[n >= least], n[n >= least]
                near.append(beside[f])
            files, n = np.concatenate([x[0] for x in near]), np.concatenate([x[1] for x in near])
            other = ~np.isin(files, own)
            files, at = np.unique(files[other], return_inverse=True)
            most = np.zeros(len(files), np.int64)
            np.maximum.at(most, at, n[other])
            found += [(subject, c.paths[files[i]], place) for place, i in enumerate(first(files, most, k), 1)]
        subject, member, place = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.int64()), pa.array(subject, pa.string()), pa.array(member, pa.string()), pa.array(place, pa.int32())], ["repo_id", "subject", "member", "place"])

    return left.groupBy("repo", "part").cogroup(right.groupBy("repo", "part")).applyInArrow(count, f"repo_id {repo}, subject string, member string, place int")
