"""Mixing sources to target weights.

Method: Poisson replication. Each document draws a uniform number from a seeded hash of its id; the number of its copies
is the inverse of the Poisson distribution function at that number, cut off at the source's cap. Documents are exploded
by that count and shuffled globally by another seeded hash.

The Poisson mean of a source is calibrated: copies never fall when the mean rises, so the mean is chosen by bisection such that
the tokens really drawn come as near to the target as whole documents allow (with plain means a source of few documents
would miss its share by the noise of the draw). The draw has 53 bits. The calibration sees tokens summed by source and by the
``2**BITS`` steps of the draw, which bounds the mean from both sides; the few steps that a boundary of the distribution crosses between these
bounds are then summed by ``2**BITS`` steps each. Both tables are bounded, and 2**-32 of a source is told apart, so a rate far below one in a million still
draws single documents. A source that cannot reach its share under its cap gets every document ``max_repeats`` times and is reported as it is.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.session import cut, spread

BITS = 16
#: The pre-split of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def count_tokens(docs: DataFrame, doc_id: str, text: str, vocabulary: str, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, carry..., tokens``: the length of each text in tokens of a byte-level vocabulary file; 0 for null and empty.

    The file (ranks by base64 token, about a megabyte) is read on the driver and broadcast; executors need no copy.
    """
    carry = carry or []
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("lodeline", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for b in batches:
            at = b.schema.get_field_index("__text")
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in b.column(at).to_pylist()]
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(n, pa.int64())], [*[b.schema.names[i] for i in keep], "tokens"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [doc_id, *carry])
    return spread(docs.select(doc_id, *carry, F.col(text).alias("__text"))).mapInArrow(run, f"{fields}, tokens long")


def _thresholds(mean: float, cap: int) -> np.ndarray:
    """Distribution function of Poisson(mean) at 0 .. cap-1: a draw above k of them makes k copies."""
    if math.isinf(mean):
        return np.full(cap, -1.0)
    if mean <= 0:
        return np.full(cap, 2.0)
    k = np.arange(cap)
    logs = k * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in k])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def _drawn(mean: float, cap: int, u: np.ndarray, tokens: np.ndarray) -> int:
    return int((np.searchsorted(_thresholds(mean, cap), u, side="left") * tokens).sum())


def _bisect(low: float, high: float, enough) -> tuple[float, float]:  # noqa: ANN001
    """``low`` and ``high`` brought together: ``enough`` is false at the one and true at the other."""
    for _ in range(120):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (low, mid) if enough(mid) else (mid, high)
    return low, high


def _bounds(target: float, cap: int, bins: np.ndarray, tokens: np.ndarray) -> tuple[float, float]:
    """Means between which the tokens drawn pass the target, wherever in its step each document lies."""
    if target >= cap * tokens.sum():
        return math.inf, math.inf
    if target <= 0:
        return 0.0, 0.0
    left, right = bins / (1 << BITS), (bins + 1) / (1 << BITS)
    top = max(1.0, float(cap))
    while _drawn(top, cap, left, tokens) < target:
        if top > 700 + 8 * cap:  # every document's last copy is near: only the first step is left
            return _bisect(0.0, top, lambda m: _drawn(m, cap, right, tokens) > target)[0], math.inf
        top *= 2
    return _bisect(0.0, top, lambda m: _drawn(m, cap, right, tokens) > target)[0], _bisect(0.0, top, lambda m: _drawn(m, cap, left, tokens) >= target)[1]


def _open(low: float, high: float, cap: int, bins: np.ndarray) -> np.ndarray:
    """Which steps hold a boundary of the distribution for some mean between the two."""
    if math.isinf(low) or high <= 0:
        return np.zeros(len(bins), bool)
    first, last = np.floor(_thresholds(high, cap) * (1 << BITS)), np.floor(_thresholds(low, cap) * (1 << BITS))
    return ((bins[:, None] >= first[None, :] - 1) & (bins[:, None] <= last[None, :] + 1)).any(1)


def _settle(target: float, low: float, high: float, cap: int, u: np.ndarray, tokens: np.ndarray, rest: int) -> float:
    """The mean between the two at which ``rest`` and the tokens drawn at ``u`` are nearest to the target."""
    if low == high:
        return low
    if math.isinf(high):
        high = 1400.0 + 16 * cap
        if rest + _drawn(high, cap, u, tokens) < target:
            return math.inf
    a, b = _bisect(low, high, lambda m: rest + _drawn(m, cap, u, tokens) >= target)
    below, above = _drawn(a, cap, u, tokens), _drawn(b, cap, u, tokens)
    # ``u`` is the middle of a step; the boundary goes beside the step, not through it
    half = 0.5 / (1 << 2 * BITS)
    if target - rest - below <= rest + above - target:
        return _bisect(low, a, lambda m: _drawn(m, cap, u + half, tokens) > below)[0]
    return _bisect(b, high, lambda m: _drawn(m, cap, u - half, tokens) >= above)[1]


def draw(column: Column | str, seed: int) -> Column:
    """The 64 bits drawn for an id."""
    return F.xxhash64(F.col(column) if isinstance(column, str) else column, F.lit(seed))


def _step(level: int) -> Column:
    """The step of the draw: its first BITS bits, or the BITS bits after them."""
    return F.shiftrightunsigned("__draw", 64 - BITS * level).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))


#: The draw as a number between 0 and 1.
_U = "(shiftrightunsigned(__draw, 11) + 0.5D) / 9007199254740992D"


class Mixture:
    """A mixture of ``sized`` (``doc_id``, a source key and ``tokens``) towards ``targets`` (key, source_name, target_share, max_repeats).

    The budget is the tokens of all rows, whatever their source. Rows with a null or untargeted key stay out; targets without rows
    are reported with zeros; a null cap is 1. Equal keys of several target rows are not allowed.
    """

    def __init__(self, sized: DataFrame, doc_id: str, key: str, targets: DataFrame, seed: int = 17):
        self.doc_id, self.key, self.seed = doc_id, key, seed
        self.sized = cut(sized.withColumn("__draw", draw(doc_id, seed)))
        # one row a target: as many as the report has lines
        rows = targets.select(key, "source_name", "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap")).collect()
        if len({r[key] for r in rows}) != len(rows):
            raise ValueError("two targets have the same source")
        budget = self.sized.agg(F.sum("tokens")).first()[0] or 0
        spark = sized.sparkSession
        goal = spark.createDataFrame(
            [(r[key], r["source_name"], float(r["target_share"] or 0.0), int(r["cap"]), float(r["target_share"] or 0.0) * budget) for r in rows],
            f"`{key}` string, source_name string, target_share double, cap int, goal double",
        )
        small = goal.select(key, "cap", "goal")
        steps = self.sized.join(F.broadcast(small), key).groupBy(key, "cap", "goal", _step(1).alias("__bin")).agg(F.sum("tokens").alias("tokens"))

        def bound(names: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            cap, target = int(pdf["cap"].iloc[0]), float(pdf["goal"].iloc[0])
            bins, tokens = pdf["__bin"].to_numpy(np.int64), pdf["tokens"].to_numpy(np.int64)
            low, high = _bounds(target, cap, bins, tokens)
            undecided = _open(low, high, cap, bins)
            rest = _drawn(low, cap, (bins[~undecided] + 0.5) / (1 << BITS), tokens[~undecided])
            return pd.DataFrame({key: [names[0]], "low": [low], "high": [high], "rest": [rest], "bins": [bins[undecided].tolist()], "tokens_available": [int(tokens.sum())]})

        # at most 2**BITS steps a target
        bounds = cut(steps.groupBy(key).applyInPandas(bound, f"`{key}` string, low double, high double, rest long, bins array<long>, tokens_available long"))
        undecided = bounds.select(key, F.explode("bins").alias("__bin"))
        fine = (
            self.sized.withColumn("__bin", _step(1))
            .join(F.broadcast(undecided), [key, "__bin"])
            .groupBy(key, ((F.col("__bin") * (1 << BITS)) + _step(2)).alias("__fine"))
            .agg(F.sum("tokens").alias("tokens"))
        )
        known = bounds.join(goal, key).select(key, "cap", "goal", "low", "high", "rest", "tokens_available")

        def settle(names: tuple, have: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            h = have.iloc[0]
            cap = int(h["cap"])
            u = (parts["__fine"].to_numpy(np.float64) + 0.5) / (1 << 2 * BITS)
            mean = _settle(float(h["goal"]), float(h["low"]), float(h["high"]), cap, u, parts["tokens"].to_numpy(np.int64), int(h["rest"]))
            return pd.DataFrame({key: [names[0]], "levels": [_thresholds(mean, cap).tolist()], "tokens_available": [int(h["tokens_available"])]})

        solved = known.groupBy(key).cogroup(fine.groupBy(key)).applyInPandas(settle, f"`{key}` string, levels array<double>, tokens_available long")
        self.plan = cut(goal.join(solved, key, "left"))

    def documents(self) -> DataFrame:
        """The rows of the mixture, each once a copy, in a global random order: ``doc_id, key, tokens, copy, source_name, place``."""
        u = F.expr(_U)
        levels = F.broadcast(self.plan.select(self.key, "source_name", "levels"))
        copies = F.size(F.filter("levels", lambda t: t < u))
        out = self.sized.join(levels, self.key).withColumn("copies", copies).where("copies > 0")
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        place = F.xxhash64(F.col(self.doc_id), F.col("copy"), F.lit(self.seed + 1))
        return out.withColumn("place", place).drop("__draw", "levels", "copies").orderBy("place", self.doc_id, "copy")

    def report(self) -> DataFrame:
        """Per target: tokens available, repeats (mean copies of a token), tokens used, target share, share of the mixture, share of the budget."""
        u = F.expr(_U)
        copies = F.size(F.filter("levels", lambda t: t < u))
        used = (
            self.sized.join(F.broadcast(self.plan.select(self.key, "levels")), self.key)
            .groupBy(self.key)
            .agg(F.sum(F.col("tokens") * copies).alias("tokens_used"))
        )
        all_used = used.agg(F.sum("tokens_used").alias("mixed"))
        budget = self.sized.agg(F.sum("tokens").alias("budget"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        share = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 6), F.lit(0.0))
        # the two one-row totals are attached, not joined on a key
        return (
            self.plan.join(used, self.key, "left")
            .join(F.broadcast(all_used))
            .join(F.broadcast(budget))
            .select(
                "source_name",
                zero(F.col("tokens_available")).alias("tokens_available"),
                share(F.col("tokens_used"), F.col("tokens_available")).alias("repeats"),
                zero(F.col("tokens_used")).alias("tokens_used"),
                "target_share",
                share(F.col("tokens_used"), F.col("mixed")).alias("actual_share"),
                share(F.col("tokens_used"), F.col("budget")).alias("budget_share"),
            )
        )
