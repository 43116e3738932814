"""Numeric geometry of a layout: projections, bounds, neighbours within a radius, placement measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))])


def centroids(points: DataFrame, by: list[str]) -> DataFrame:
    """Members and centre of each group, two decimals, halves up."""
    from lodeline.functions.scoring import round2

    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), round2(F.avg("x")).alias("cx"), round2(F.avg("y")).alias("cy"))


def to_screen(x: Column, y: Column, camera: dict) -> tuple[Column, Column]:
    """World to screen: shift to the camera, turn, scale, move to the middle of the view."""
    a = camera.get("angle", 0.0)
    dx, dy = x - camera["x"], y - camera["y"]
    rx, ry = dx * math.cos(a) - dy * math.sin(a), dx * math.sin(a) + dy * math.cos(a)
    return rx * camera["zoom"] + camera["width"] / 2, ry * camera["zoom"] + camera["height"] / 2


def to_world(sx: Column, sy: Column, camera: dict) -> tuple[Column, Column]:
    """The inverse of ``to_screen``."""
    a = -camera.get("angle", 0.0)
    dx, dy = (sx - camera["width"] / 2) / camera["zoom"], (sy - camera["height"] / 2) / camera["zoom"]
    return dx * math.cos(a) - dy * math.sin(a) + camera["x"], dx * math.sin(a) + dy * math.cos(a) + camera["y"]


def within(points: DataFrame, key: str, radius: float) -> DataFrame:
    """Pairs of different points no farther apart than ``radius``: ``a, b, distance`` with ``a < b``.

    Points meet through grid cells of that size, each looking into its neighbours, so no point is compared with far ones.
    """
    cell = points.withColumn("gx", F.floor(F.col("x") / radius)).withColumn("gy", F.floor(F.col("y") / radius))
    near = F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = cell.select(F.col(key).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(near).alias("c")).select("a", "ax", "ay", "c.gx", "c.gy")
    right = cell.select(F.col(key).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "gx", "gy")
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2.0)) + F.pow(F.col("ay") - F.col("by"), F.lit(2.0)))
    return left.join(right, ["gx", "gy"]).where("a < b").withColumn("distance", d).where(F.col("distance") <= radius).select("a", "b", "distance")


def spread_ratio(points: DataFrame, label: str) -> DataFrame:
    """Mean distance of the points to their group's centre over the mean distance between centres; one row."""
    c = points.groupBy(label).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    inner = points.join(c, label).agg(F.avg(F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("cy"), F.lit(2.0)))).alias("inner"))
    o = c.select(F.col(label).alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    # groups are few: as many as there are labels
    pairs = c.join(o, F.col(label) < F.col("other")).agg(F.avg(F.sqrt(F.pow(F.col("cx") - F.col("ox"), F.lit(2.0)) + F.pow(F.col("cy") - F.col("oy"), F.lit(2.0)))).alias("between"))
    return inner.join(pairs).select("inner", "between", F.try_divide("inner", "between").alias("ratio"))


def contrast(r1: Column, g1: Column, b1: Column, r2: Column, g2: Column, b2: Column) -> Column:
    """Contrast ratio of two colours given as 0..255 channels."""

    def luminance(r: Column, g: Column, b: Column) -> Column:
        lin = lambda v: F.when(v / 255 <= 0.04045, v / 255 / 12.92).otherwise(F.pow((v / 255 + 0.055) / 1.055, F.lit(2.4)))
        return 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)

    a, b = luminance(r1, g1, b1), luminance(r2, g2, b2)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def golden_turn(index: Column) -> Column:
    """The heading of the n-th of a series that never repeats: multiples of the golden angle, in degrees."""
    return F.pmod(index * F.lit(180 * (3 - math.sqrt(5))), F.lit(360.0))
