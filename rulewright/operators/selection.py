"""Feature scores, limiters and multi-step feature selection."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import neighbours

SCORES = "name string, score double"
#: Values of a feature that are sorted together, about.
RANGE_ROWS = 100_000


def unpivot(df: DataFrame, columns: list[str], keep: list) -> DataFrame:
    """keep..., name, value."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    out = df.select(*keep, F.explode(cells).alias("_cell"))
    return out.select(*[c for c in out.columns if c != "_cell"], "_cell.*")


def variance_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, score: the sample variance of each column, one aggregate."""
    row = df.agg(*[F.var_samp(F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"v{i}").alias("score")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def discrete_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """mi, hx, hy, hxy in nats of two discrete columns; rows with a null in either are left out."""
    joint = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    total = joint.agg(F.sum("n").alias("total"))
    joint = joint.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("total"))  # one row
    joint = joint.withColumn("px", F.sum("p").over(Window.partitionBy("x"))).withColumn("py", F.sum("p").over(Window.partitionBy("y")))
    h = lambda q: -F.sum(F.col("p") * F.ln(q))
    return joint.agg(F.greatest(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("px") * F.col("py")))), F.lit(0.0)).alias("mi"), h("px").alias("hx"), h("py").alias("hy"), h("p").alias("hxy"))


def symmetric_uncertainty(df: DataFrame, x: str, y: str) -> DataFrame:
    """su = 2 * mi / (hx + hy); 0 if both are constant."""
    return discrete_information(df, x, y).select("mi", F.coalesce(F.try_divide(2 * F.col("mi"), F.col("hx") + F.col("hy")), F.lit(0.0)).alias("su"))


def digamma(x: float) -> float:
    """Derivative of the log gamma function for x > 0, by recurrence and asymptotic series."""
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def _digammas(values: np.ndarray) -> float:
    kinds, counts = np.unique(values, return_counts=True)
    return float(sum(digamma(float(k)) * c for k, c in zip(kinds, counts, strict=True)) / len(values))


def neighbour_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information of two continuous variables by nearest neighbours in the maximum norm."""
    n = len(x)
    if n <= k:
        return 0.0
    dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    radius = np.nextafter(np.partition(d, k - 1, axis=1)[:, k - 1], 0)
    nx, ny = (dx <= radius[:, None]).sum(1), (dy <= radius[:, None]).sum(1)
    return max(0.0, digamma(n) + digamma(k) - _digammas(nx) - _digammas(ny))


def class_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information of a continuous and a discrete variable; labels of one row are left out."""
    labels, code, counts = np.unique(y, return_inverse=True, return_counts=True)
    keep = counts[code] > 1
    x, code = x[keep], code[keep]
    n = len(x)
    if n < 2:
        return 0.0
    radius, used, size = np.empty(n), np.empty(n, int), np.empty(n, int)
    for c in np.unique(code):
        own = np.flatnonzero(code == c)
        kk = min(k, len(own) - 1)
        d = np.abs(x[own][:, None] - x[own][None])
        np.fill_diagonal(d, np.inf)
        radius[own] = np.nextafter(np.partition(d, kk - 1, axis=1)[:, kk - 1], 0)
        used[own], size[own] = kk, len(own)
    m = (np.abs(x[:, None] - x[None]) <= radius[:, None]).sum(1)  # the same differences as above, so no rounding between
    return max(0.0, digamma(n) + _digammas(used) - _digammas(size) - _digammas(m))


def _class_scores(df: DataFrame, columns: list[str], label: str, row_id: str, k: int, seed: int, noise: float) -> DataFrame:
    """name, score: ``class_information`` of every column over all rows.

    The nearest neighbours of a value in its class are next to it in order, and the rows within
    its radius are a difference of two ranks. Both are taken within ranges of a feature's values,
    so no task holds a feature.
    """
    long = unpivot(df.where(F.col(label).isNotNull()), columns, [F.col(label).cast("string").alias("y"), F.xxhash64(row_id).alias("id")])
    long = long.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    stats = long.groupBy("name").agg(F.stddev_samp("value").alias("s"), F.avg(F.abs("value")).alias("mean"))
    s = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    normal = _normal(seed, "id", "name")
    sizes = long.groupBy("name", "y").agg(F.count("*").alias("size")).where("size > 1")
    # features and classes are few
    value = (F.col("value") / s + noise * F.greatest(F.lit(1.0), F.col("mean") / s) * normal).alias("x")
    rows = long.join(F.broadcast(stats), "name").select("name", "y", value).join(F.broadcast(sizes), ["name", "y"])

    ranges = -(-df.count() // RANGE_ROWS)
    if ranges > 1:
        bounds = rows.groupBy("name").agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("bounds"))
    else:
        bounds = rows.select("name").distinct().withColumn("bounds", F.array().cast("array<double>"))
    bounds = F.broadcast(bounds)

    def ranged(table: DataFrame) -> DataFrame:
        return table.join(bounds, "name").withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("x")))).drop("bounds")

    def before(counts: DataFrame, keys: list[str]) -> DataFrame:
        start = F.sum("c").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
        return counts.select(*keys, "range", F.coalesce(start, F.lit(0)).alias("start"))

    rows = ranged(rows)
    own = F.row_number().over(Window.partitionBy("name", "y", "range").orderBy("x")) - 1
    counts = rows.groupBy("name", "y", "range").agg(F.count("*").alias("c"))
    placed = rows.withColumn("own", own).join(before(counts, ["name", "y"]), ["name", "y", "range"])
    placed = placed.withColumn("place", F.col("own") + F.col("start")).select("name", "y", "x", "size", "place")
    # runs of a class by place; a row within k places of a run stands in it as a neighbour
    run = lambda shift: F.floor((F.col("place") + shift) / RANGE_ROWS)
    placed = placed.withColumn("home", run(0)).withColumn("run", F.explode(F.array_distinct(F.array(run(-k), run(0), run(k)))))
    order = Window.partitionBy("name", "y", "run").orderBy("place")
    beside = [f("x", j).over(order) for f in (F.lag, F.lead) for j in range(1, k + 1)]
    found = placed.select("*", F.array(*beside).alias("beside")).where("run = home")
    near = F.array_sort(F.transform(F.filter("beside", lambda v: v.isNotNull()), lambda v: F.struct(F.abs(v - F.col("x")).alias("d"), v.alias("v"))))
    found = found.select("name", "y", "place", "x", F.get(near, F.least(F.lit(k), F.col("size") - 1).cast("int") - 1).alias("far"))
    # strictly within the radius; the end on the side of the neighbour is its own value, so no rounding excludes or adds it
    low = F.when(F.col("far.v") < F.col("x"), F.col("far.v")).otherwise(F.col("x") - F.col("far.d"))
    high = F.when(F.col("far.v") > F.col("x"), F.col("far.v")).otherwise(F.col("x") + F.col("far.d"))
    # at equal values an upper end stands before the points and a lower one behind them; with a radius of 0 equal values count
    zero = F.col("far.d") == 0
    kinds = ((1, F.when(zero, 3).otherwise(1), high), (0, F.lit(2), F.col("x")), (-1, F.when(zero, 1).otherwise(3), low))
    ends = F.explode(F.array(*[F.struct(F.lit(sign).alias("sign"), at.alias("kind"), v.alias("x")) for sign, at, v in kinds]))
    events = ranged(found.select("name", "y", "place", ends.alias("e")).select("name", "y", "place", "e.*"))
    points = (F.col("sign") == 0).cast("long")
    counts = events.groupBy("name", "range").agg(F.sum(points).alias("c"))
    so_far = F.sum(points).over(Window.partitionBy("name", "range").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0))
    events = events.withColumn("so_far", so_far).join(F.broadcast(before(counts, ["name"])), ["name", "range"])
    within = events.where("sign <> 0").groupBy("name", "y", "place").agg(F.sum(F.col("sign") * (F.col("so_far") + F.col("start"))).alias("m"))

    spread = within.groupBy("name", "m").agg(F.count("*").alias("c")).groupBy("name").agg(F.sum(F.col("c") * neighbours.digamma(F.col("m"))).alias("around"))
    classes = sizes.withColumn("kk", F.least(F.lit(k), F.col("size") - 1))
    classes = classes.withColumn("term", F.col("size") * (neighbours.digamma(F.col("kk")) - neighbours.digamma(F.col("size")))).groupBy("name").agg(F.sum("size").alias("n"), F.sum("term").alias("inside"))
    classes = classes.join(spread, "name").withColumn("score", F.greatest(neighbours.digamma(F.col("n")) + (F.col("inside") - F.col("around")) / F.col("n"), F.lit(0.0)))
    return stats.select("name").join(classes.select("name", "score"), "name", "left").select("name", F.coalesce("score", F.lit(0.0)).alias("score"))


def _normal(seed: int, *of: str) -> Column:
    """A normal deviate by a hash of columns."""
    uniform = lambda part: (F.pmod(F.xxhash64(*of, F.lit(seed), F.lit(part)), F.lit(1 << 52)) + 1) / float(1 << 52)
    return F.sqrt(-2 * F.ln(uniform(0))) * F.cos(2 * math.pi * uniform(1))


def numeric_points(df: DataFrame, columns: list[str], label: str, row_id: str, seed: int, noise: float) -> DataFrame:
    """name, id, x, y: a column's values and the label, both scaled by their deviation and given noise.

    Rows with a null, NaN or infinite value of a column or the label are left out for that column.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    long = unpivot(df, columns, [F.col(label).cast("double").alias("y"), F.xxhash64(row_id).alias("id")]).where(finite("value") & finite("y"))
    stats = long.groupBy("name").agg(*[f.alias(f"{c}_{n}") for c in ("value", "y") for n, f in (("s", F.stddev_samp(c)), ("mean", F.avg(F.abs(c))))])

    def scaled(c: str, *of: str) -> Column:
        s = F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(1.0)
        return F.col(c) / s + noise * F.greatest(F.lit(1.0), F.col(f"{c}_mean") / s) * _normal(seed, "id", *of)

    return long.join(F.broadcast(stats), "name").select("name", "id", scaled("value", "name").alias("x"), scaled("y").alias("y"))  # a row for each feature


def information_scores(df: DataFrame, columns: list[str], label: str, row_id: str, discrete: tuple[str, ...] = (), numeric_label: bool = False, k: int = 3, seed: int = 1, noise: float = 1e-10) -> DataFrame:
    """name, score: mutual information of each column with the label, over all rows.

    Columns named in ``discrete`` are counted. Others are scaled by their deviation and given noise
    to break ties, and nearest neighbours count: with a label of classes by the order of a
    feature's values, with a numeric label in the plane of feature and label. Ids tell rows apart.
    """
    out = df.sparkSession.createDataFrame([], SCORES)
    for c in discrete:
        out = out.unionByName(discrete_information(df, c, label).select(F.lit(c).alias("name"), F.col("mi").alias("score")))
    others = [c for c in columns if c not in discrete]
    if others and not numeric_label:
        out = out.unionByName(_class_scores(df, others, label, row_id, k, seed, noise))
    elif others:
        out = out.unionByName(neighbours.continuous_information(numeric_points(df, others, label, row_id, seed, noise), k))
    return out


# Coefficients of the Chebyshev fit of erfc in t = 1 / (1 + z / 2), with a relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0."""
    t = 1 / (1 + z / 2)
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = series * t + c
    return t * F.exp(-z * z + series)


def mann_whitney(df: DataFrame, columns: list[str], label: str, aggregate: Callable[[Column], Column] = F.min, ranges: int = 64) -> DataFrame:
    """name, score: p-values of one class against all others, aggregated over the classes.

    Two-sided normal approximation with continuity and tie correction. Ranks are averages over
    ties, from the counts of distinct values, summed within ``ranges`` ranges of each feature's
    values and over the ranges' counts, so no task holds a feature.
    """
    long = unpivot(df.where(F.col(label).isNotNull()), columns, [F.col(label).cast("string").alias("y")]).where("value is not null and not isnan(value)")
    bounds = long.groupBy("name").agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("bounds"))
    counts = long.groupBy("name", "value", "y").agg(F.count("*").alias("n"))
    # a row for each feature
    counts = counts.join(F.broadcast(bounds), "name").withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("value")))).drop("bounds")
    values = counts.groupBy("name", "range", "value").agg(F.sum("n").alias("t"))
    own = F.coalesce(F.sum("t").over(Window.partitionBy("name", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = values.groupBy("name", "range").agg(F.sum("t").alias("c"))
    start = F.sum("c").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(starts.select("name", "range", F.coalesce(start, F.lit(0)).alias("start")))  # at most ``ranges`` rows for each feature
    values = values.withColumn("own", own).join(starts, ["name", "range"]).withColumn("rank", F.col("start") + F.col("own") + (F.col("t") + 1) / 2)
    ties = values.groupBy("name").agg(F.sum("t").alias("all"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("tie"))
    sums = counts.join(values.select("name", "value", "rank"), ["name", "value"]).groupBy("name", "y").agg(F.sum("n").alias("n1"), F.sum(F.col("n") * F.col("rank")).alias("r1")).join(ties, "name")
    n1, n = F.col("n1").cast("double"), F.col("all").cast("double")
    n2 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("tie"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd)
    p = F.coalesce(F.when(~F.isnan("z"), erfc(F.col("z") / math.sqrt(2))), F.lit(1.0))
    return sums.select("name", "y", z.alias("z")).withColumn("p", F.least(p, F.lit(1.0))).groupBy("name").agg(aggregate(F.col("p")).alias("score"))


# -- limiters ---------------------------------------------------------------------------


class Limiter(Protocol):
    def __call__(self, scores: DataFrame) -> DataFrame:
        """Scores (name, score) with a boolean column kept."""


def _rank(scores: DataFrame, descending: bool) -> DataFrame:
    # a row for each feature
    order = [F.desc_nulls_last("score") if descending else F.asc_nulls_last("score"), F.col("name")]
    return scores.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))


@dataclass(frozen=True)
class Percentage:
    """The best ceil(n * share), at least one."""

    share: float
    descending: bool = True

    def __post_init__(self):
        if not 0 < self.share < 1:
            raise ValueError("the share lies between 0 and 1")

    def __call__(self, scores: DataFrame) -> DataFrame:
        return _rank(scores, self.descending).withColumn("kept", F.col("_r") <= F.ceil(F.col("_n") * self.share)).drop("_r", "_n")


@dataclass(frozen=True)
class Best:
    n: int
    descending: bool = True

    def __call__(self, scores: DataFrame) -> DataFrame:
        return _rank(scores, self.descending).withColumn("kept", F.col("_r") <= self.n).drop("_r", "_n")


@dataclass(frozen=True)
class AtMost:
    """Scores up to a threshold, and the best ``at_least`` in any case."""

    threshold: float
    at_least: int = 1

    def __call__(self, scores: DataFrame) -> DataFrame:
        return _rank(scores, False).withColumn("kept", F.coalesce(F.col("score") <= self.threshold, F.lit(False)) | (F.col("_r") <= self.at_least)).drop("_r", "_n")


@dataclass(frozen=True)
class Everything:
    def __call__(self, scores: DataFrame) -> DataFrame:
        return scores.withColumn("kept", F.lit(True))


@dataclass(frozen=True)
class Step:
    """A score of columns and a limiter, over single features or over groups of name parts."""

    score: Callable[[DataFrame, list[str]], DataFrame]
    limit: Limiter
    group_parts: tuple[int, ...] | None = None
    aggregate: Callable[[Column], Column] = F.avg
    limit_first: bool = False


def identity_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Score 1 for every column."""
    return df.sparkSession.createDataFrame([(c, 1.0) for c in columns], SCORES)


def name_groups(spark: SparkSession, names: list[str], parts: tuple[int, ...], separator: str = "@@@") -> DataFrame:
    """name, grp: names grouped by some of their parts; ragged names or parts out of range raise."""
    split = [n.split(separator) for n in names]
    if len({len(s) for s in split}) > 1:
        raise ValueError("names with different numbers of parts")
    if split and (min(parts) < 0 or max(parts) >= len(split[0])):
        raise ValueError("a part out of range")
    return spark.createDataFrame([(n, separator.join(s[p] for p in parts)) for n, s in zip(names, split, strict=True)], "name string, grp string")


def run_step(df: DataFrame, columns: list[str], step: Step, separator: str = "@@@") -> DataFrame:
    """name, score, kept of one step.

    Grouped: scores are aggregated by group and groups are limited, or with ``limit_first``
    features are limited and a group stays if any of its features does.
    """
    scores = step.score(df, columns)
    if step.group_parts is None:
        return step.limit(scores).select("name", "score", "kept")
    groups = name_groups(df.sparkSession, columns, step.group_parts, separator)
    if step.limit_first:
        kept = step.limit(scores).join(groups, "name")
        return kept.withColumn("kept", F.max("kept").over(Window.partitionBy("grp"))).select("name", "score", "kept")
    by_group = scores.join(groups, "name").groupBy("grp").agg(step.aggregate(F.col("score")).cast("double").alias("score"))
    limited = step.limit(by_group.withColumnRenamed("grp", "name")).withColumnRenamed("name", "grp")
    return groups.join(limited, "grp").select("name", "score", "kept")


def run_selection(df: DataFrame, columns: list[str], steps: list[Step], separator: str = "@@@") -> tuple[list[str], DataFrame]:
    """(names that survive all steps, mid results step, name, score, kept)."""
    spark, mid, names = df.sparkSession, [], list(columns)
    for i, step in enumerate(steps):
        rows = run_step(df, names, step, separator).collect()  # one for each feature
        mid += [(i, r["name"], r["score"], bool(r["kept"])) for r in rows]
        kept = {r["name"] for r in rows if r["kept"]}
        names = [n for n in names if n in kept]
    return names, spark.createDataFrame(mid, "step int, name string, score double, kept boolean")


def default_steps(label: str, row_id: str) -> list[Step]:
    """The better half by variance, a tenth by mutual information, all groups."""
    return [
        Step(variance_scores, Percentage(0.5)),
        Step(lambda d, c: information_scores(d, c, label, row_id), Percentage(0.1)),
        Step(identity_scores, Everything()),
    ]


def names_at_step(mid: DataFrame, step: int) -> list[str]:
    return [r["name"] for r in mid.where((F.col("step") == step) & F.col("kept")).orderBy("name").collect()]


def survivor_study(mid: DataFrame, part: int, separator: str = "@@@") -> DataFrame:
    """step, part, total, kept: survivors of each step by one part of the names; absent ones count 0."""
    value = F.element_at(F.split("name", re.escape(separator)), part + 1)
    rows = mid.withColumn("part", value)
    counted = rows.groupBy("step", "part").agg(F.count("*").alias("total"), F.sum(F.col("kept").cast("int")).alias("kept"))
    grid = rows.select("step").distinct().crossJoin(rows.select("part").distinct())  # steps by parts of names
    return grid.join(counted, ["step", "part"], "left").select("step", "part", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))


def natural_key(name: str) -> tuple:
    """Sort key that takes runs of digits as numbers."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", name) if p)


def natural_order(name: Column) -> Column:
    """The same as a column that can be ordered by."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda p: F.struct(F.lit(0).alias("kind"), p.cast("decimal(38,0)").alias("number"), F.lit("").alias("text"))
    word = lambda p: F.struct(F.lit(1).alias("kind"), F.lit(0).cast("decimal(38,0)").alias("number"), p.alias("text"))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(word(p)))


def natural_ranks(names: DataFrame, name: str) -> DataFrame:
    """``names`` (distinct) with ``place``, from 1, in natural order: names that start alike are ordered together, and starts are counted."""
    start = F.regexp_extract(name, r"^(\D*)", 1)
    rows = names.withColumn("_start", start)
    own = F.row_number().over(Window.partitionBy("_start").orderBy(natural_order(F.col(name))))
    sizes = rows.groupBy("_start").agg(F.count("*").alias("_n"))
    # a row for each start
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(natural_order(F.col("_start"))).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("place", own).join(sizes.select("_start", before.alias("_before")), "_start").withColumn("place", (F.col("place") + F.col("_before")).cast("long")).drop("_start", "_before")


def selected_variables(names: list[str], separator: str = "@@@") -> list[str]:
    """The original variables behind selected names, in natural order."""
    return sorted({n.split(separator)[0] for n in names}, key=natural_key)


def apply_selection(df: DataFrame, names: list[str], keep: list[str] | None = None, separator: str = "@@@") -> DataFrame:
    """The table of the original variables that survived."""
    return df.select(*(keep or []), *[c for c in selected_variables(names, separator) if c in df.columns])


def count_map(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """name, n for every name asked, 0 where it does not occur; one row for each of ``names``."""
    wanted = df.sparkSession.createDataFrame([(n,) for n in names], "name string")
    counts = df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return wanted.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
