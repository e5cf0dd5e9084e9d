"""Nearest neighbours in the plane and counts in a radius, for tables of any length.

Points (name, id, x, y) of each name are cut into strips at quantiles of x and strips into cells
at quantiles of y, so that a cell holds about ``CELL_ROWS`` points wherever they lie. The nearest
neighbours inside the own cell bound the true distance; a point asks every other cell that its
square of that size meets, and only those. Counts in a radius along one axis are differences of
two ranks, which are taken within ranges of the axis. No task holds a name, and no step compares
all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of a cell, and points of a range of one axis, about.
CELL_ROWS = 1_024
RANGE_ROWS = 100_000
#: Distances that a kernel holds at a time.
BLOCK = 1 << 20


def digamma(x: Column) -> Column:
    """Derivative of the log gamma function for x >= 1: eight steps of its recurrence, then the asymptotic series."""
    x = x.cast("double")
    steps = F.lit(0.0)
    for i in range(8):
        steps = steps + 1 / (x + i)
    y = x + 8
    f = 1 / (y * y)
    return F.ln(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132)))) - steps


def nearest(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """The ``k`` smallest distances (in the maximum norm) of every (x, y) to the points; infinity where there are fewer.

    ``own`` is the place of each (x, y) among the points, which does not count. Points that
    coincide are compared once, with their number.
    """
    out = np.full((len(x), k), np.inf)
    if not len(px) or not len(x):
        return out
    points, code, counts = np.unique(np.stack([px, py], axis=1), axis=0, return_inverse=True, return_counts=True)
    code = code.reshape(-1)
    few = min(k + 1, len(points))
    step = max(1, BLOCK // len(points))
    for lo in range(0, len(x), step):
        part = slice(lo, lo + step)
        d = np.maximum(np.abs(x[part, None] - points[None, :, 0]), np.abs(y[part, None] - points[None, :, 1]))
        rows = np.arange(len(d))[:, None]
        at = np.argpartition(d, few - 1, axis=1)[:, :few]
        at = at[rows, np.argsort(d[rows, at], axis=1)]
        number = counts[at]
        if own is not None:
            number = number - (at == code[own[part], None])
        so_far = np.cumsum(number, axis=1)
        close = d[rows, at]
        for j in range(k):
            enough = so_far > j
            first = enough.argmax(1)
            out[part, j] = np.where(enough.any(1), close[rows[:, 0], first], np.inf)
    return out


def _place(bounds: Column, v: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b < v))


def _quantiles(v: str, parts: int) -> Column:
    if parts < 2:
        return F.array().cast("array<double>")
    return F.percentile_approx(v, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))


def radii(points: DataFrame, k: int) -> DataFrame:
    """name, id, x, y, r of points (name, id, x, y): the largest radius that holds less than ``k`` other points of the name.

    r is the largest double below the distance to the ``k``-th nearest point, 0 where that
    coincides with it, and infinite where a name has no more than ``k`` points.
    """
    most = points.groupBy("name").count().agg(F.max("count")).first()[0] or 0
    side = max(1, math.ceil(math.sqrt(most / CELL_ROWS)))
    strips = F.broadcast(points.groupBy("name").agg(_quantiles("x", side).alias("xs")))  # a row for each name, and the root of the cells in it
    stripped = points.join(strips, "name").withColumn("strip", _place(F.col("xs"), F.col("x")))
    # as a strip's cells are asked for by points of other strips too, bounds are a table
    cells = stripped.groupBy("name", "strip").agg(_quantiles("y", side).alias("ys"))
    placed = stripped.join(cells, ["name", "strip"]).withColumn("cell", _place(F.col("ys"), F.col("y"))).select("name", "strip", "cell", "id", "x", "y")

    def inside(table: pa.Table) -> pa.Table:
        x, y = (np.asarray(table.column(c), float) for c in ("x", "y"))
        found = nearest(x, y, x, y, k, np.arange(len(x)))
        return table.append_column("near", pa.array(list(found), pa.list_(pa.float64())))

    schema = "name string, strip int, cell int, id long, x double, y double, near array<double>"
    local = placed.groupBy("name", "strip", "cell").applyInArrow(inside, schema)
    far = F.element_at("near", k)
    asking = local.select("name", "strip", "cell", "id", "x", "y", far.alias("d")).join(strips, "name")
    lowest, highest = _place(F.col("xs"), F.col("x") - F.col("d")), _place(F.col("xs"), F.col("x") + F.col("d"))
    asking = asking.select("name", "id", "x", "y", "d", F.col("strip").alias("own_strip"), F.col("cell").alias("own_cell"), F.explode(F.sequence(lowest, highest)).alias("strip"))
    asking = asking.join(cells, ["name", "strip"])
    asking = asking.withColumn("cell", F.explode(F.sequence(_place(F.col("ys"), F.col("y") - F.col("d")), _place(F.col("ys"), F.col("y") + F.col("d")))))
    asking = asking.where("strip <> own_strip or cell <> own_cell").select("name", "strip", "cell", "id", "x", "y", "d")

    def across(asked: pa.Table, held: pa.Table) -> pa.Table:
        x, y, px, py = (np.asarray(t.column(c), float) for t in (asked, held) for c in ("x", "y"))
        found = nearest(x, y, px, py, k)
        return pa.table([asked.column("name"), asked.column("id"), asked.column("x"), asked.column("y"), pa.array(list(found), pa.list_(pa.float64()))], names=["name", "id", "x", "y", "near"])

    by = ("name", "strip", "cell")
    others = asking.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(across, "name string, id long, x double, y double, near array<double>")
    whole = local.select("name", "id", "x", "y", "near").unionByName(others)
    near = F.array_sort(F.flatten(F.collect_list("near")))
    out = whole.groupBy("name", "id", "x", "y").agg(F.element_at(near, k).alias("d"))

    return out.select("name", "id", "x", "y", below(F.col("d")).alias("r"))


def below(d: Column) -> Column:
    """The largest double that is smaller than ``d``; 0 for 0 (and infinity for infinity)."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        v = values.to_numpy(float)
        return pd.Series(np.where(np.isinf(v) | (v == 0), v, np.nextafter(v, 0.0)))

    return run(d)


def counts_within(queries: DataFrame, axis: str, rounded: bool = False) -> DataFrame:
    """name, id, m of rows (name, id, ``axis``, r): how many rows of the name are within r of it along the axis, itself too.

    A row is within r if the difference of the two values is at most r; with ``rounded``, if it lies between
    the doubles v - r and v + r, as in the RANGE of a window. The two differ where a value is r away but for rounding.
    """
    most = queries.groupBy("name").count().agg(F.max("count")).first()[0] or 0
    ranges = max(1, math.ceil(most / RANGE_ROWS))
    rows = queries.select("name", "id", F.col(axis).alias("v"), "r")
    bounds = F.broadcast(rows.groupBy("name").agg(_quantiles("v", ranges).alias("bounds")))  # a row for each name
    placed = rows.join(bounds, "name")
    held = placed.select(F.col("name").alias("of_name"), _place(F.col("bounds"), F.col("v")).alias("of_range"), F.col("v").alias("value"))
    v, r = F.col("v"), F.col("r")
    # the range of an end follows from the bounds that come before it, by the same comparison as the values
    lower = (lambda b: b < v - r) if rounded else (lambda b: v - b > r)
    upper = (lambda b: b <= v + r) if rounded else (lambda b: b - v <= r)
    ends = F.explode(F.array(*[F.struct(F.lit(sign).alias("sign"), F.size(F.filter("bounds", before)).alias("range")) for sign, before in ((1, upper), (-1, lower))]))
    asked = placed.select("name", "id", "v", "r", ends.alias("end")).select("name", "id", "v", "r", "end.*")

    def ranked(key: tuple, ask: pa.Table, have: pa.Table) -> pa.Table:
        values, counts = np.unique(np.asarray(have.column("value"), float), return_counts=True)
        v, r, sign = (np.asarray(ask.column(c), float) for c in ("v", "r", "sign"))
        upper = sign > 0
        at = np.where(upper, np.searchsorted(values, v + r, "right"), np.searchsorted(values, v - r, "left"))
        if not rounded:  # what counts is the difference of two values: the place may be off by a value
            padded = np.concatenate(([-np.inf], values, [np.inf]))
            inside = lambda w: np.where(upper, w - v <= r, v - w > r)  # noqa: E731  whether a value comes before the end
            for _ in range(2):
                at = at + ((at < len(values)) & inside(padded[np.minimum(at + 1, len(values) + 1)]))
                at = at - ((at > 0) & ~inside(padded[at]))
        at = np.concatenate(([0], np.cumsum(counts)))[at]
        return pa.table([ask.column("name"), ask.column("id"), ask.column("sign"), ask.column("range"), pa.array(at.astype(np.int64))], names=["name", "id", "sign", "range", "c"])

    found = asked.groupBy("name", "range").cogroup(held.groupBy("of_name", "of_range")).applyInArrow(ranked, "name string, id long, sign int, range int, c long")
    sizes = held.groupBy(F.col("of_name").alias("name"), F.col("of_range").alias("range")).agg(F.count("*").alias("size"))
    start = F.coalesce(F.sum("size").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each range; one that holds no value counts those of the ranges before it
    starts = F.broadcast(sizes.select("name", "range", start.alias("start"), "size").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("range", "start", "size"))).alias("starts")))
    joined = found.join(starts, "name")
    before = F.aggregate("starts", F.lit(0).cast("long"), lambda n, s: F.when(s["range"] < F.col("range"), s["start"] + s["size"]).otherwise(n))
    return joined.groupBy("name", "id").agg(F.sum(F.col("sign") * (F.col("c") + before)).alias("m"))


def continuous_information(points: DataFrame, k: int = 3) -> DataFrame:
    """name, score: mutual information of x and y by ``k`` nearest neighbours, over all points (name, id, x, y).

    0 for a name with ``k`` points or fewer. Ids tell the points of a name apart. Works at once.
    """
    points = points.persist()
    found = radii(points, k).where("r < double('infinity')").persist()
    try:
        names = points.groupBy("name").agg(F.count("*").alias("n"))
        terms = None
        for axis in ("x", "y"):
            part = counts_within(found, axis).groupBy("name", "m").agg(F.count("*").alias("c")).select("name", (F.col("c") * digamma(F.col("m"))).alias("term"))
            terms = part if terms is None else terms.unionByName(part)
        around = terms.groupBy("name").agg(F.sum("term").alias("around"))
        score = digamma(F.col("n")) + digamma(F.lit(k)) - F.col("around") / F.col("n")
        out = names.join(around, "name", "left").select("name", F.coalesce(F.greatest(score, F.lit(0.0)), F.lit(0.0)).alias("score"))
        return points.sparkSession.createDataFrame(out.collect(), "name string, score double")  # a row for each name
    finally:
        found.unpersist()
        points.unpersist()
