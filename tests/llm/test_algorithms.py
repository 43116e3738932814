"""Frequent items, co-occurrence and components against brute force, with nulls, repeats, ties and empty tables."""

import collections
import itertools
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodeline.llm.components import components
from lodeline.llm.cooccurrence import pairs
from lodeline.llm.heavy_hitters import Sketch, frequent


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sketch_bounds_hold_under_eviction():
    rng = np.random.default_rng(3)
    keys = rng.integers(1, 1 << 62, 3000)
    stream = keys[np.minimum(rng.zipf(1.2, 60000) - 1, 2999)].astype(np.int64)
    s = Sketch(16, 64)
    for part in np.array_split(stream, 37):
        s.add(part)
    true = collections.Counter(stream.tolist())
    assert s.total == len(stream) == s.own.sum() + s.light[0].sum()
    own = {int(k): int(n) for k, n in zip(s.key, s.own, strict=True) if n}
    from lodeline.llm.heavy_hitters import _cells

    for k, n in true.items():
        c1, c2 = (c[0] for c in _cells(np.array([k], np.int64), 64))
        assert own.get(k, 0) <= n <= own.get(k, 0) + min(s.light[0][c1], s.light[1][c2])


@pytest.mark.parametrize("buckets", [None, 2])
def test_frequent_equals_count(spark, buckets):
    random.seed(1)
    data = [(i, random.choice("aabbbcccc") if i % 3 else f"x{i}", i % 5) for i in range(4000)]
    data += [(i, d, n) for i, d, n in data if i % 7 == 0] + [(None, "a", 1), (None, "a", 1), (5000, None, 1)]
    df = spark.createDataFrame(data, "id long, item string, n long").repartition(5)
    once = {i: d for i, d, _ in data if i is not None and d is not None}
    true = collections.Counter(once.values())
    true["a"] += 2
    total = sum(true.values())
    got = frequent(df.withColumnRenamed("n", "approx_n"), ["item"], 20, once_per="id", buckets=buckets, width=buckets and 4)
    assert {r["item"]: r["n"] for r in got.collect()} == {k: v for k, v in true.items() if v * 20 > total}
    assert all(r["approx_low"] <= r["n"] <= r["approx_n"] for r in got.collect())


def test_frequent_of_nothing(spark):
    df = spark.createDataFrame([], "id long, item string")
    assert frequent(df, ["item"], 10, once_per="id").count() == 0
    with pytest.raises(ValueError):
        frequent(df.withColumnRenamed("item", "n"), ["n"], 10)


def brute_pairs(baskets, floor, lift):
    out = set()
    for g in {g for g, _ in baskets}:
        sets = [sorted({x for x in b if x is not None}) for h, b in baskets if h == g and b]
        sets = [b for b in sets if b]
        one = collections.Counter(x for b in sets for x in b)
        two = collections.Counter(p for b in sets for p in itertools.combinations(b, 2))
        for (a, b), n in two.items():
            if n >= floor and n * len(sets) >= lift * one[a] * one[b]:
                out.add((g, a, b, n, one[a], one[b], len(sets)))
    return sorted(out)


@pytest.mark.parametrize("lift", [0.0, 1.0, 4.0])
def test_pairs_equal_brute_force(spark, lift):
    random.seed(2)
    baskets = [(random.choice([1, 1, 1, 2]), [random.choice(["hot", "a", "b", "c", "d", "e", None]) for _ in range(random.randint(0, 6))]) for _ in range(600)]
    baskets += [(3, None), (3, []), (3, [None])]
    df = spark.createDataFrame([(g, b, 0) for g, b in baskets], "g long, items array<string>, weight int")
    floors = spark.createDataFrame([(1, 3), (2, 3), (3, 1)], "g long, min_count int")
    got = pairs(df, "g", "items", floors, lift)
    assert sorted(tuple(r)[:7] for r in got.collect()) == brute_pairs(baskets, 3, lift)
    for r in got.collect():
        assert r["lift"] == pytest.approx(r["n_ab"] * r["n"] / (r["n_a"] * r["n_b"]))
    assert pairs(df.limit(0), "g", "items", floors, lift).count() == 0


def test_hot_item_is_salted_and_exact(spark):
    baskets = [(1, ["hot", f"i{k % 50}", f"j{k % 40}"]) for k in range(20000)]
    df = spark.createDataFrame(baskets, "g long, items array<string>")
    got = pairs(df, "g", "items", spark.createDataFrame([(1, 2)], "g long, min_count int"), 0.0)
    assert sorted(tuple(r)[:7] for r in got.collect()) == brute_pairs(baskets, 2, 0.0)


def union_find(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for s, a, b in links:
        if s is not None and a is not None and b is not None and a != b:
            x, y = find((s, a)), find((s, b))
            if x != y:
                up[max(x, y)] = min(x, y)
    return sorted((k[0], k[1], find(k)[1]) for k in up)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.sampled_from([*"abcdefghij", None]), st.sampled_from([*"abcdefghij", None])), max_size=14))
def test_components_equal_union_find(spark, links):
    df = spark.createDataFrame(links, "node long, x string, y string")
    assert rows(components(df, "x", "y", "node")) == union_find(links)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(1, f"{i:04d}", f"{i + 1:04d}") for i in range(300)]
    hub = [(2, "m", f"{i:04d}") for i in range(4000)]
    df = spark.createDataFrame(chain + hub, "s long, x string, y string")
    assert rows(components(df, "x", "y", "s")) == union_find(chain + hub)
    assert components(df.limit(0), "x", "y").count() == 0
    assert rows(components(spark.createDataFrame([(3, 2), (2, 9), (5, 5)], "a int, b int"), "a", "b")) == [(2, 2), (3, 2), (9, 2)]


def test_giant_component_is_split(spark, monkeypatch):
    """A star and a chain whose nodes all end at one root: the rows of the root's key are not sent to one task."""
    from lodeline.operators import skew

    n, m = 30_000, 300
    star = spark.range(1, n).selectExpr("0L as x", "id as y")
    chain = spark.range(n, n + m).selectExpr("id as x", "id + 1 as y")
    monkeypatch.setattr(skew, "MANY", 5_000)
    met = []
    plain = skew.split_lookup
    monkeypatch.setattr("lodeline.llm.components.split_lookup", lambda *a: met.append(plain(*a)) or met[-1])
    got = components(star.unionByName(chain), "x", "y")
    assert got.groupBy("group").count().orderBy("group").collect() == [(0, n), (n, m + 1)]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in met]
    assert any("Union" in p and "LeftAnti" in p for p in plans)
