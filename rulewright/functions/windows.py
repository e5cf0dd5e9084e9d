"""Index windows over array columns.

A window is a struct (lo, n) with lo from 1. Bounds are worked out on the driver when the
length is known, and by the same arithmetic as an expression when it varies by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays


def _half_even(x: float) -> int:
    return round(x)


def moving_parameters(length: int, n: int) -> tuple[int, int]:
    """(size, step) of n windows without overlap to speak of; one window is the whole."""
    size = max(length // n, 1)
    return (length, 1) if n == 1 else (size, max((length - size) // (n - 1), 1))


def moving_windows(length: int, n: int) -> list[tuple[int, int]]:
    """The first n windows (lo, n) of fixed size and step."""
    size, step = moving_parameters(length, n)
    return [(lo, size) for lo in range(1, length - size + 2, step)][:n]


def segments(length: int, n: int) -> list[tuple[int, int]]:
    """n adjoining segments with bounds rounded half to even."""
    cuts = [_half_even(1 + i * length / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def overlapping(length: int, n: int, overlap: float = 0.0) -> list[tuple[int, int]]:
    """n windows of one size whose neighbours share the part ``overlap``.

    The size is floor(L / ((n - 1) (1 - o) + 1)), the step max(round(size (1 - o)), 1); the size
    shrinks until the last window fits. ValueError if none fits.
    """
    if not 0 <= overlap < 1 or n < 1:
        raise ValueError("overlap lies in [0, 1) and n is at least 1")
    size = math.floor(length / ((n - 1) * (1 - overlap) + 1))
    while size >= 1:
        step = max(_half_even(size * (1 - overlap)), 1)
        if (n - 1) * step + size <= length:
            return [(1 + i * step, size) for i in range(n)]
        size -= 1
    raise ValueError(f"{n} windows do not fit into {length} values")


def whole(length: int) -> list[tuple[int, int]]:
    return [(1, length)]


def tiled(length: int, size: int) -> list[tuple[int, int]]:
    """Windows of a fixed size side by side; an incomplete last one is dropped."""
    return [(lo, size) for lo in range(1, length - size + 2, size)]


@dataclass(frozen=True)
class Windowing:
    """A named way to cut a length into windows."""

    kind: str = "overlapping"
    n: int = 1
    overlap: float = 0.0
    size: int = 0

    KINDS = ("whole", "moving", "segments", "overlapping", "tiled")

    def __post_init__(self):
        if self.kind not in self.KINDS or self.n < 1 or not 0 <= self.overlap < 1 or (self.kind == "tiled" and self.size < 1):
            raise ValueError(f"no windowing: {self}")

    def of(self, length: int) -> list[tuple[int, int]]:
        if self.kind == "whole":
            return whole(length)
        if self.kind == "moving":
            return moving_windows(length, self.n)
        if self.kind == "segments":
            return segments(length, self.n)
        return tiled(length, self.size) if self.kind == "tiled" else overlapping(length, self.n, self.overlap)


def window_bounds(length: Column, n: int, overlap: float = 0.0) -> Column:
    """``overlapping`` for a length that varies by row: array<struct<lo, n>>, empty if none fits."""
    start = F.floor(length / ((n - 1) * (1 - overlap) + 1)).cast("int")

    def step_of(size: Column) -> Column:
        return F.greatest(F.bround(size * (1 - overlap), 0).cast("int"), F.lit(1))

    sizes = F.when(start >= 1, F.sequence(start, F.lit(1))).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda s: step_of(s) * (n - 1) + s <= length)
    size = F.try_element_at(fits, F.lit(1))
    bounds = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((1 + i * step_of(size)).cast("int").alias("lo"), size.alias("n")))
    return F.when(size.isNull(), F.array().cast("array<struct<lo:int,n:int>>")).otherwise(bounds)


def windowed(a: Column, bounds: list[tuple[int, int]]) -> Column:
    """The slices of an array, array<array<double>>."""
    return F.array(*[F.slice(arrays.doubles(a), lo, n) for lo, n in bounds])


def reduce_windows(a: Column, bounds: list[tuple[int, int]], fun: str = "mean") -> Column:
    """One value for each window; NaN where the array ends before the window."""
    make = arrays.feature(fun)
    return F.array(*[in_window(a, lo, n, make) for lo, n in bounds])


def in_window(a: Column, lo: int, n: int, make) -> Column:
    return F.when(F.size(a) >= lo + n - 1, make(F.slice(arrays.doubles(a), lo, n))).when(a.isNotNull(), F.lit(arrays.NAN))


def frames(a: Column, size: int, overlap: int) -> Column:
    """Overlapping frames of a signal; hop = size - overlap, an incomplete tail is dropped."""
    hop = size - overlap
    if hop < 1:
        raise ValueError("the overlap is smaller than the frame")
    n = F.floor((F.size(a) - size) / hop).cast("int") + 1
    none = F.array().cast("array<array<double>>")
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.slice(arrays.doubles(a), k * hop + 1, F.lit(size)))).otherwise(none)


def moving_median(a: Column, width: int) -> Column:
    """Median in a centred window of odd width, cut at the ends."""
    if width < 1 or width % 2 == 0:
        raise ValueError("an odd width")
    p = width // 2

    def at(i: Column) -> Column:
        lo = F.greatest(i - p, F.lit(1))
        return arrays.median(F.slice(arrays.doubles(a), lo, F.least(i + p, F.size(a)) - lo + 1))

    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.size(a)), at)).otherwise(F.array().cast("array<double>"))


def moving_median_rows(df: DataFrame, key: str, order: list[str], value: str, width: int, name: str = "moving_median") -> DataFrame:
    """The same over rows: a window for each key, in the given order."""
    p = width // 2
    return df.withColumn(name, F.percentile(value, 0.5).over(Window.partitionBy(key).orderBy(*order).rowsBetween(-p, p)))


def all_intervals(length: Column, longest: int | None = None) -> Column:
    """Every interval [x, y) of a series as structs, 1 <= x < y <= length + 1, up to ``longest``."""
    top = F.lit(2**30 if longest is None else longest)
    ends = lambda x: F.sequence(x + 1, F.least(length + 1, x + top))
    spread = F.transform(F.sequence(F.lit(1), length), lambda x: F.transform(ends(x), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    return F.when(length >= 1, F.flatten(spread)).otherwise(F.array().cast("array<struct<x:int,y:int>>"))


def interval_length(w: Column) -> Column:
    return w["y"] - w["x"]


def filter_intervals(intervals: Column, keep) -> Column:
    """Intervals for which ``keep(interval)`` holds, as for ``lambda w: interval_length(w) >= 3``."""
    return F.filter(intervals, keep)


def on_intervals(a: Column, intervals: Column, fun: str) -> Column:
    """The feature of each interval; NaN where it exceeds the series."""
    make = arrays.feature(fun)
    return F.transform(intervals, lambda w: F.when(w["y"] - 1 <= F.size(a), make(F.slice(arrays.doubles(a), w["x"], w["y"] - w["x"]))).otherwise(F.lit(arrays.NAN)))


#: Allen's relations between intervals [x, y), without equality, by their usual letters.
RELATIONS = {
    "A": lambda v, w: w["x"] == v["y"],
    "L": lambda v, w: w["x"] > v["y"],
    "B": lambda v, w: (w["x"] == v["x"]) & (w["y"] < v["y"]),
    "E": lambda v, w: (w["y"] == v["y"]) & (w["x"] > v["x"]),
    "D": lambda v, w: (w["x"] > v["x"]) & (w["y"] < v["y"]),
    "O": lambda v, w: (w["x"] > v["x"]) & (w["x"] < v["y"]) & (w["y"] > v["y"]),
}
RELATIONS |= {f"~{k}": (lambda f: lambda v, w: f(w, v))(f) for k, f in list(RELATIONS.items())}
IA7 = {
    "AO": lambda v, w: RELATIONS["A"](v, w) | RELATIONS["O"](v, w),
    "L": RELATIONS["L"],
    "DBE": lambda v, w: RELATIONS["D"](v, w) | RELATIONS["B"](v, w) | RELATIONS["E"](v, w),
    "~AO": lambda v, w: RELATIONS["~A"](v, w) | RELATIONS["~O"](v, w),
    "~L": RELATIONS["~L"],
    "~DBE": lambda v, w: RELATIONS["~D"](v, w) | RELATIONS["~B"](v, w) | RELATIONS["~E"](v, w),
    "=": lambda v, w: (v["x"] == w["x"]) & (v["y"] == w["y"]),
}


def related(intervals: Column, v: Column, relation: str) -> Column:
    """The intervals that stand in a relation to ``v``."""
    test = (RELATIONS | IA7)[relation]
    return F.filter(intervals, lambda w: test(v, w))


def related_holds(a: Column, intervals: Column, relation: str, fun: str, op: str, threshold: float, universal: bool = False) -> Column:
    """For every interval, in order: whether some (or every) interval in the relation to it passes the test.

    An interval without such a relative has no witness: false, or true for the universal form.
    """
    from ..operators.conditions import OPERATORS

    test = (RELATIONS | IA7)[relation]
    known = F.transform(F.arrays_zip(intervals.alias("w"), on_intervals(a, intervals, fun).alias("v")), lambda z: F.struct(z["w"].alias("w"), (~F.isnan(z["v"]) & OPERATORS[op](z["v"], F.lit(float(threshold)))).alias("ok")))
    some = lambda v: F.exists(known, lambda z: test(v, z["w"]) & z["ok"])
    every = lambda v: F.forall(known, lambda z: ~test(v, z["w"]) | z["ok"])
    return F.transform(intervals, every if universal else some)


def exists_interval(a: Column, intervals: Column, fun: str, op: str, threshold: float) -> Column:
    """Modal diamond: some interval's feature passes the test; NaN passes none."""
    from ..operators.conditions import OPERATORS

    return F.exists(on_intervals(a, intervals, fun), lambda x: ~F.isnan(x) & OPERATORS[op](x, F.lit(float(threshold))))


def all_intervals_hold(a: Column, intervals: Column, fun: str, op: str, threshold: float) -> Column:
    """Modal box."""
    from ..operators.conditions import OPERATORS

    return F.forall(on_intervals(a, intervals, fun), lambda x: ~F.isnan(x) & OPERATORS[op](x, F.lit(float(threshold))))


def some_interval(a: Column, fun: str, op: str, threshold: float, shortest: int = 1) -> Column:
    """Whether some interval of ``shortest`` values or more has a minimum or maximum that passes an inequality.

    The intervals are not listed. A minimum that is high, or a maximum that is low, is a stretch of
    values that pass, long enough; a minimum that is low, or a maximum that is high, is one value that passes,
    in a stretch that is long enough. Either is one pass over the series. Intervals with NaN pass nothing.
    """
    from ..operators.conditions import OPERATORS

    if fun not in ("minimum", "maximum") or op not in ("<", "<=", ">", ">="):
        raise ValueError(f"no inequality of extremes: {fun} {op}")
    every = (fun == "minimum") == (op in (">", ">="))
    passes = lambda x: ~F.isnan(x) & OPERATORS[op](x, F.lit(float(threshold)))
    state = lambda n, hit, found: F.struct(n.alias("n"), hit.alias("hit"), found.alias("found"))

    def step(s: Column, x: Column) -> Column:
        x = F.coalesce(x, F.lit(arrays.NAN))
        hit = passes(x) if every else s["hit"] | passes(x)
        long = (s["n"] + 1 >= shortest) & hit
        return F.when(passes(x) if every else ~F.isnan(x), state(s["n"] + 1, hit, s["found"] | long)).otherwise(state(F.lit(0), F.lit(False), s["found"]))

    return F.aggregate(arrays.doubles(a), state(F.lit(0), F.lit(False), F.lit(False)), step, lambda s: s["found"])


def every_interval(a: Column, fun: str, op: str, threshold: float, shortest: int = 1) -> Column:
    """Whether all intervals of ``shortest`` values or more pass; one with NaN does not."""
    from ..operators.conditions import DUALS

    spoilt = F.exists(arrays.doubles(a), lambda x: F.isnan(F.coalesce(x, F.lit(arrays.NAN))))
    return (F.size(a) < shortest) | (~spoilt & ~some_interval(a, fun, DUALS[op], threshold, shortest))
