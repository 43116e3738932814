"""The commit boards over the whole pool, repository by repository in numbers.

Six or seven lanes of candidates for every commit or file, joined, ranked and shuffled as rows, are what filled the disk and took the time. Here the commits of a
repository travel once for every TOUCHES touches, and a task makes the whole boards of its share of the subjects: the lanes of
``plans/whole_boards.py``, their mix and the guesses that may give a board away. A lane is read only as far as a board can need it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions.paths import tokens
from lodeline.operators import ranking as R
from lodeline.operators.overlap import Commits, first
from lodeline.plans import views as V
from lodeline.plans.boards import CANDIDATES, RIGHT

#: A repository of more touches is split into several parts of its subjects.
TOUCHES = 16384

_HUMP, _STEM, _REST = re.compile("([a-z0-9])([A-Z])"), re.compile(r"(?<=.)\.[^.]*$"), re.compile("[^a-z0-9]+")


def words(path: str) -> frozenset[str]:
    """``name_tokens`` of a path as a set."""
    stem = _STEM.sub("", path.rsplit("/", 1)[-1])
    return frozenset(x for x in _REST.split(_HUMP.sub(r"\1 \2", stem).lower()) if x)


def folders(path: str) -> list[str]:
    """``dir_prefixes`` of a path."""
    s = path.split("/")[:-1]
    return ["/".join(s[:i]) for i in range(1, len(s) + 1)]


def spread(n: int, k: int) -> list[int]:
    """Which of ``n`` rows are among ``k`` at even distances, the ends included."""
    step = (n - 1) / max(k - 1, 1)
    return list(range(n)) if n <= k else sorted({int(np.floor(j * step + 0.5)) for j in range(k)})


def truth_size(pool: int, supply: int) -> int:
    return max((s for s in range(1, RIGHT + 1) if s <= supply and min(pool, CANDIDATES - s) > 2 * s), default=0)


def f1(hits: int, picked: int, n: int) -> float:
    return 0.0 if hits == 0 else 2.0 * hits / (picked + n)


class Repo(Commits):
    """A repository's commits with ``narrow, said, known`` besides; ``rank`` orders files by churn and path."""

    def __init__(self, t: pa.Table) -> None:
        super().__init__(t)
        t = t.sort_by("sha")
        self.narrow = np.asarray(t["narrow"].combine_chunks())
        self.known = np.asarray(t["known"].combine_chunks())
        self.said = [frozenset(x or ()) for x in t["said"].to_pylist()]
        owner = np.repeat(np.arange(len(self.shas)), self.sizes)
        self.churn = np.bincount(self.files[self.narrow[owner]], minlength=len(self.paths))
        self.order = np.lexsort((np.arange(len(self.paths)), -self.churn))
        self.rank = np.empty(len(self.paths), np.int64)
        self.rank[self.order] = np.arange(len(self.paths))
        self._met: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._near: dict[frozenset[str], tuple[list[int], list[float]]] = {}

    def own(self, commit: int) -> np.ndarray:
        return self.files[self.starts[commit] : self.starts[commit + 1]]

    def met(self, file: int) -> tuple[np.ndarray, np.ndarray]:
        """The files that narrow commits touch together with this one, and in how many."""
        if file not in self._met:
            at = self.touching(file)
            files, n = self.together(at[self.narrow[at]])
            self._met[file] = files[files != file], n[files != file]
        return self._met[file]

    @cached_property
    def words(self) -> list[frozenset[str]]:
        return [words(p) for p in self.paths]

    @cached_property
    def folders(self) -> list[list[str]]:
        return [folders(p) for p in self.paths]

    def _lists(self, keys: list, order: np.ndarray) -> dict:
        found = defaultdict(list)
        for f in order.tolist():
            for k in keys[f]:
                found[k].append(f)
        return found

    @cached_property
    def inside(self) -> dict[str, list[int]]:
        """The files of each folder at any depth, by churn and path."""
        return self._lists(self.folders, self.order)

    @cached_property
    def inside_by_path(self) -> dict[str, list[int]]:
        return self._lists(self.folders, np.arange(len(self.paths)))

    @cached_property
    def named(self) -> dict[str, list[int]]:
        """The files of each word of their names, by churn and path."""
        return self._lists(self.words, self.order)

    @cached_property
    def sets(self) -> tuple[list[frozenset[str]], list[list[int]], dict[str, list[int]]]:
        """Different sets of words, in the order of their first files; the files of each, by path; the sets of each word."""
        of: dict[frozenset[str], list[int]] = defaultdict(list)
        for f, w in enumerate(self.words):
            of[w].append(f)
        by = defaultdict(list)
        for i, w in enumerate(of):
            for x in w:
                by[x].append(i)
        return list(of), list(of.values()), by

    def near(self, own: frozenset[str]) -> tuple[list[int], list[float]]:
        """The sets that share a word, the most alike first, and how alike they are."""
        if own not in self._near:
            sets, _, by = self.sets
            shared = [np.array(by[w], np.int64) for w in own if w in by]
            ids, n = np.unique(np.concatenate(shared) if shared else np.zeros(0, np.int64), return_counts=True)
            sim = n / np.maximum(len(own) + np.array([len(sets[i]) for i in ids], np.int64) - n, 1)
            o = np.lexsort((ids, -sim))
            self._near[own] = ids[o].tolist(), sim[o].tolist()
        return self._near[own]

    @cached_property
    def last(self) -> np.ndarray:
        """The last day of each file, below all days where there is none."""
        owner = np.repeat(np.arange(len(self.shas)), self.sizes)
        x = np.full(len(self.paths), np.iinfo(np.int64).min)
        np.maximum.at(x, self.files[self.dated[owner]], self.days[owner[self.dated[owner]]].astype(np.int64))
        return x

    @cached_property
    def timed(self) -> tuple[np.ndarray, np.ndarray]:
        """Dated commits by day and sha, and the place of each commit among them."""
        at = np.flatnonzero(self.dated)
        at = at[np.argsort(self.days[at], kind="stable")]
        place = np.full(len(self.shas), -1)
        place[at] = np.arange(len(at))
        return at, place

    @cached_property
    def under(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """The commits that touch files of each folder, and how many each touches."""
        return {k: self.sharing(np.array(v)) for k, v in self.inside.items()}

    @cached_property
    def saying(self) -> dict[str, list[int]]:
        found = defaultdict(list)
        for i, w in enumerate(self.said):
            for x in w:
                found[x].append(i)
        return found


def take(found: Iterator, banned: set, k: int = CANDIDATES) -> list[int]:
    """The first ``k`` that are not banned."""
    out: list[int] = []
    for f in found:
        if f not in banned:
            out.append(f)
            if len(out) == k:
                break
    return out


def tree(r: Repo, anchors: list[int], banned: set[int], by_path: bool = False) -> list[int]:
    levels: dict[int, set[str]] = defaultdict(set)
    for a in anchors:
        for depth, p in enumerate(r.folders[a]):
            levels[depth].add(p)
    inside, key = (r.inside_by_path, None) if by_path else (r.inside, r.rank.__getitem__)
    out, gone = [], set(banned)
    for depth in sorted(levels, reverse=True):
        got = {f for p in levels[depth] for f in take(inside[p], gone)}
        out += sorted(got, key=key)
        gone |= got
        if len(out) >= CANDIDATES:
            break
    return out[:CANDIDATES]


def names(r: Repo, anchors: list[int], banned: set[int]) -> list[int]:
    """By the greatest likeness of the words of a name; equally alike files by path."""
    _, files, _ = r.sets
    best: dict[int, float] = {}
    for own in {r.words[a] for a in anchors}:
        ids, sim = r.near(own)
        # of b banned files at most b sets ahead can have none to offer
        for i, s in zip(ids[: CANDIDATES + len(banned)], sim[: CANDIDATES + len(banned)], strict=True):
            if s > best.get(i, 0.0):
                best[i] = s
    level: dict[float, list[int]] = defaultdict(list)
    for i, s in best.items():
        level[s].append(i)
    out: list[int] = []
    for s in sorted(level, reverse=True):
        out += sorted(f for i in level[s] for f in take(files[i], banned))
        if len(out) >= CANDIDATES:
            break
    return out[:CANDIDATES]


def structural(r: Repo, anchors: np.ndarray, banned: np.ndarray) -> list[int]:
    """By hops over pairs seen twice, ring after whole ring until there is a board's worth."""
    seen, ring, out = np.unique(anchors), anchors, []
    while len(ring):
        beyond = [files[n >= 2] for files, n in map(r.met, ring.tolist())]
        ring = np.setdiff1d(np.concatenate(beyond), seen)
        seen = np.union1d(seen, ring)
        free = np.setdiff1d(ring, banned, assume_unique=True)
        out += free[np.argsort(r.rank[free])].tolist()
        if len(out) >= CANDIDATES:
            break
    return out[:CANDIDATES]


def partition(r: Repo, board: list[int], right: set[int]) -> float:
    groups: dict[str, list[int]] = defaultdict(list)
    for f in board:
        for p in r.folders[f]:
            groups[p].append(f)
    hits = [sum(f in right for f in x) for x in groups.values() if len(x) == len(right)]
    return f1(max(hits), len(right), len(right)) if hits and (len(right) >= 2 or len(hits) == 1) else 0.0


def changed(r: Repo, subjects: Iterator[int], mix: Callable) -> Iterator[tuple[str, list[str], dict, dict[str, float]]]:
    """Of every narrow commit: its sha, its right answers, its wrong ones by strategy, the scores of the guesses."""
    order = r.order.tolist()
    for x in subjects:
        own = r.own(x)
        if not r.narrow[x] or not len(own):
            continue
        banned = set(own.tolist())
        filled = take(order, banned)
        size = truth_size(len(filled), len(own))
        if not size:
            continue
        right = own[spread(len(own), size)]
        at = right.tolist()
        near = [r.met(f) for f in at]
        files, n = np.concatenate([f for f, _ in near]), np.concatenate([k for _, k in near])
        beside = files[n >= 2]
        # what is left has met every right answer once at most, so the path decides
        once = np.setdiff1d(np.setdiff1d(files, beside), own)
        lanes = {
            "busy": [f for f in filled if r.churn[f]],
            "together": once[:CANDIDATES].tolist(),
            "structural": structural(r, right, own),
            "tree": tree(r, at, banned),
            "name": names(r, at, banned),
            "mentioned": sorted({f for w in r.said[x] if w in r.named for f in take(r.named[w], banned)}, key=r.rank.__getitem__)[:CANDIDATES],
        }
        wrong = mix(lanes, filled, CANDIDATES - size)
        board, truth = [*at, *wrong], set(at)
        busy = sorted(board, key=r.rank.__getitem__)[: len(at)]
        said = [f for f in board if r.words[f] & r.said[x]]
        late = [f for f in board if r.dated[x] and r.last[f] == r.days[x]]
        hit = lambda picked: f1(len(truth & set(picked)), len(picked), len(truth))  # noqa: B023, E731
        yield r.shas[x], [r.paths[f] for f in at], {r.paths[f]: s for f, s in wrong.items()}, {"name": hit(said), "churn": hit(busy), "recency": hit(late), "partition": partition(r, board, truth)}


def touching(r: Repo, subjects: Iterator[int], mix: Callable) -> Iterator[tuple[str, list[str], dict, dict[str, float]]]:
    """Of every file of three dated commits on two days: its path, its right answers, its wrong ones by strategy, the scores of the guesses."""
    at, place = r.timed
    for x in subjects:
        own = np.sort(place[r.touching(x)])
        own = own[own >= 0]
        if len(own) < 3:
            continue
        mine = at[own]
        lo, hi = r.days[mine[0]], r.days[mine[-1]]
        if lo == hi:
            continue
        days = r.days[at]
        a, b = int(np.searchsorted(days, lo)), int(np.searchsorted(days, hi, "right")) - 1
        left = b - a + 1 - len(own)
        k = min(left, CANDIDATES)
        i = np.floor(np.arange(k) * (left - 1) / max(k - 1, 1) + 0.5).astype(np.int64)
        # own commits that lie before the i-th of the others
        filled = at[i + a + np.searchsorted(own - a - np.arange(len(own)), i, "right")].tolist()
        size = truth_size(k, len(own))
        if not size:
            continue
        right = mine[spread(len(own), size)].tolist()

        def offered(members: np.ndarray, shared: np.ndarray) -> list[int]:
            good = r.dated[members] & (r.days[members] >= lo) & (r.days[members] <= hi) & ~np.isin(members, mine)  # noqa: B023
            members, shared = members[good], shared[good]
            return members[first(members, shared, CANDIDATES)].tolist()

        files, n = r.met(x)
        home = r.folders[x][-1] if r.folders[x] else ""
        said = np.unique(np.array([c for w in r.words[x] for c in r.saying.get(w, ())], np.int64))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        lanes = {
            "neighbour": offered(*r.sharing(files[n >= 2])),
            "sibling": offered(*r.under.get(home, none)),
            "mentions": offered(said, np.ones(len(said), np.int64)),
            "companion": offered(*r.sharing(files)),
        }
        wrong = mix(lanes, filled, CANDIDATES - size)
        board, truth = sorted([*right, *wrong]), set(right)
        hit = lambda picked: f1(len(truth & set(picked)), len(picked), len(truth))  # noqa: B023, E731
        wide = sorted((c for c in board if r.known[c]), key=lambda c: (-r.sizes[c], c))
        scores = {
            "mentions": hit([c for c in board if r.said[c] & r.words[x]]),
            "endpoints": hit([c for c in board if r.days[c] in (lo, hi)]),
            "oldestK": hit(sorted(board, key=lambda c: (r.days[c], c))[: len(right)]),
            "recentK": hit(sorted(board, key=lambda c: (-r.days[c], c))[: len(right)]),
            "broadKnown": hit(wide[: len(right)]),
        }
        yield r.paths[x], [r.shas[c] for c in right], {r.shas[c]: s for c, s in wrong.items()}, scores


def partners(r: Repo, truths: dict[str, list[str]], mix: Callable) -> Iterator[tuple[str, list[str], dict, dict[str, float]]]:
    """Of every subject with its ranked partners: its path, its right answers, its wrong ones by strategy, the scores of the guesses."""
    order = r.order.tolist()
    for subject, ranked in truths.items():
        x = r.number[subject]
        met = np.union1d(r.met(x)[0], [x])
        banned = set(met.tolist())
        filled = take(order, banned)
        size = truth_size(len(filled), len(ranked))
        if not size:
            continue
        at = [r.number[p] for p in ranked[:size]]
        lanes = {"structural": structural(r, np.array([x]), met), "busy": [f for f in filled if r.churn[f]], "tree": tree(r, [x], banned, True), "name": names(r, [x], banned)}
        wrong = mix(lanes, filled, CANDIDATES - size)
        board, truth = [*at, *wrong], set(at)
        hit = lambda picked: f1(len(truth & set(picked)), len(picked), len(truth))  # noqa: B023, E731
        scores = {
            "directory": hit([f for f in board if r.folders[f][-1:] == r.folders[x][-1:]]),
            "name": hit([f for f in board if r.words[f] & r.words[x]]),
            "churn": hit(sorted(board, key=r.rank.__getitem__)[: len(at)]),
            "partition": partition(r, board, truth),
        }
        yield subject, [r.paths[f] for f in at], {r.paths[f]: s for f, s in wrong.items()}, scores


MAKE = {"changed": changed, "touching": touching}


def made(s: SparkSession, d: str, kind: str, shares: dict[str, float], filler: str, known: DataFrame | None = None, truth: DataFrame | None = None) -> DataFrame:
    """``repo_id, subject, m, best``: the boards of a template, their members (``member, how``) by name, and the highest score of a guess.

    ``known`` (``repo_id, sha``) are the commits whose number of files an answered board has told; ``truth`` (``repo_id, subject, member, place``)
    are the right answers on offer to the boards of partners.
    """
    c = V.commits(s, d).join(V.limits(s, d).select("repo_id", "wide_commit_files"), "repo_id")
    c = c.select("repo_id", "sha", "commit_date", "files", tokens("subject").alias("said"), F.coalesce(F.size("files") <= F.col("wide_commit_files"), F.lit(False)).alias("narrow"))
    if known is not None:
        c = c.join(known.select("repo_id", "sha").distinct().withColumn("known", F.lit(True)), ["repo_id", "sha"], "left").na.fill(False, ["known"])
    else:
        c = c.withColumn("known", F.lit(False))
    n = c.groupBy("repo_id").agg(F.ceil((F.sum(F.size("files")) + 1) / TOUCHES).cast("int").alias("parts"))
    c = c.join(n, "repo_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def table(repo: int, found: Iterator) -> pa.Table:
        out = []
        for subject, right, wrong, scores in found:
            m = sorted([*((x, "-") for x in right), *wrong.items()])
            out.append((repo, subject, [{"member": x, "how": how} for x, how in m], max(scores.values())))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("member", pa.string()), ("how", pa.string())])), pa.float64()]
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["repo_id", "subject", "m", "best"])

    mix = lambda lanes, filled, count: R.mixed({**lanes, filler: filled}, list(shares), list(shares.values()), count, filler)

    def boards(key: tuple, t: pa.Table) -> pa.Table:
        repo, part, parts = (k.as_py() for k in key)
        r = Repo(t)
        return table(repo, MAKE[kind](r, range(part, len(r.shas if kind == "changed" else r.paths), parts), mix))

    def offered(key: tuple, t: pa.Table, right: pa.Table) -> pa.Table:
        truths: dict[str, list[str]] = defaultdict(list)
        for x in sorted(right.to_pylist(), key=lambda x: x["place"]):
            truths[x["subject"]].append(x["member"])
        return table(key[0].as_py(), partners(Repo(t), truths, mix) if truths else iter(()))

    repo = c.schema["repo_id"].dataType.simpleString()
    schema = f"repo_id {repo}, subject string, m array<struct<member: string, how: string>>, best double"
    if truth is None:
        return c.groupBy("repo_id", "part", "parts").applyInArrow(boards, schema)
    at = truth.join(n, "repo_id").select(F.col("repo_id").alias("repo"), F.pmod(F.xxhash64("subject"), F.col("parts")).cast("int").alias("share"), "subject", "member", "place")
    return c.groupBy("repo_id", "part").cogroup(at.groupBy("repo", "share")).applyInArrow(offered, schema)
