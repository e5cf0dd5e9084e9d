"""Scalar functions of array columns, as higher-order expressions, and their registry.

NaN inside an array makes minimum, maximum and every sum NaN. An empty or null array gives
null. Functions take a column and return a column, so they run inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def _nan_guard(a: Column, value: Column) -> Column:
    return F.when(F.exists(a, F.isnan), F.lit(NAN)).otherwise(value)


def minimum(a: Column) -> Column:
    return _nan_guard(doubles(a), F.array_min(doubles(a)))


def maximum(a: Column) -> Column:
    return _nan_guard(doubles(a), F.array_max(doubles(a)))


def total(a: Column) -> Column:
    return F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def quantile(a: Column, p: float) -> Column:
    """Linear interpolation between order statistics, as for p * (n - 1)."""
    s = F.array_sort(doubles(a))
    at = F.lit(p) * (F.size(a) - 1)
    lo = F.floor(at).cast("int")
    low, high = F.try_element_at(s, lo + 1), F.try_element_at(s, F.least(lo + 2, F.size(a)))
    return F.when(F.size(a) > 0, _nan_guard(doubles(a), low + (high - low) * (at - lo)))


def median(a: Column) -> Column:
    return quantile(a, 0.5)


def soft_minimum(a: Column, alpha: float) -> Column:
    """The quantile at ``alpha``, 0 <= alpha < 1: the smallest value for 0."""
    if not 0 <= alpha < 1:
        raise ValueError("alpha lies in [0, 1)")
    return quantile(a, alpha)


def soft_maximum(a: Column, alpha: float) -> Column:
    if not 0 <= alpha < 1:
        raise ValueError("alpha lies in [0, 1)")
    return quantile(a, 1 - alpha)


def variance(a: Column) -> Column:
    """Sample variance; NaN for a single value."""
    n = F.size(a)

    def spread(mu: Column) -> Column:
        return F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + (x - mu) * (x - mu))

    # the mean is bound once, as the only element that is transformed
    squares = F.element_at(F.transform(F.array(mean(a)), spread), 1)
    return F.when(n > 1, squares / (n - 1)).when(n == 1, F.lit(NAN))


def deviation(a: Column) -> Column:
    return F.sqrt(variance(a))


def trev(a: Column) -> Column:
    """Mean cube of the successive differences of the z-scored series."""
    return F.element_at(F.transform(F.array(F.struct(mean(a).alias("m"), deviation(a).alias("s"))), lambda z: mean(F.transform(differences(a), lambda d: F.pow(d / z["s"], F.lit(3.0))))), 1)


def high_fluctuation(a: Column) -> Column:
    """Share of the successive differences larger than 0.04 deviations."""
    d = differences(a)
    return F.element_at(F.transform(F.array(deviation(a)), lambda s: F.try_divide(F.size(F.filter(d, lambda x: F.abs(x) > s * 0.04)), F.size(d)).cast("double")), 1)


def _longest_run(flags: Column) -> Column:
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(x, s["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(flags, start, step, lambda s: s["best"].cast("double"))


def longest_decrease(a: Column) -> Column:
    """Longest run of successive decreases."""
    return _longest_run(F.transform(differences(a), lambda d: d < 0))


def longest_above_mean(a: Column) -> Column:
    """Longest run of values above the mean."""
    return F.element_at(F.transform(F.array(mean(a)), lambda m: _longest_run(F.transform(doubles(a), lambda x: x > m))), 1)


def resample(a: Column, n: int) -> Column:
    """n values by linear interpolation on evenly spaced places from first to last."""
    size, a = F.size(a), doubles(a)

    def at(k: Column) -> Column:
        place = k * (size - 1) / F.lit(float(max(n - 1, 1)))
        lo = F.least(F.floor(place).cast("int"), size - 1)
        low, high = F.get(a, lo), F.get(a, F.least(lo + 1, size - 1))
        return low + (high - low) * (place - lo)

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def pad_or_cut(a: Column, n: int, fill: float = NAN) -> Column:
    """Exactly n values, padded with ``fill`` at the end."""
    return F.slice(F.concat(doubles(a), F.array_repeat(F.lit(float(fill)), n)), 1, n)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def clip(a: Column, low: float, high: float) -> Column:
    return F.transform(doubles(a), lambda x: F.when(F.isnan(x), x).otherwise(F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))))


def differences(a: Column) -> Column:
    a = doubles(a)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(2), n), F.slice(a, F.lit(1), n), lambda x, y: x - y)


def cumulative(a: Column) -> Column:
    empty = F.array().cast("array<double>")
    return F.aggregate(doubles(a), empty, lambda s, x: F.concat(s, F.array(x + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)))))


def reverse(a: Column) -> Column:
    return F.reverse(a)


def first_argmax(a: Column) -> Column:
    """Place of the largest value, from 1; the first of equal ones."""
    return F.array_position(a, F.array_max(a))


#: Features by name. A23-like ones that need loops are added by ``catch22.register``.
REGISTRY: dict[str, Callable[[Column], Column]] = {
    "minimum": minimum, "maximum": maximum, "mean": mean, "median": median, "std": deviation, "var": variance, "cov": variance, "trev": trev,
    "high_fluctuation": high_fluctuation, "stretch_decreasing": longest_decrease, "stretch_high": longest_above_mean, "sum": total,
}
ALIASES = {"min": "minimum", "max": "maximum", "avg": "mean", "⤓": "minimum", "⤒": "maximum", "↓": "minimum", "↑": "maximum"}

SETS = {
    "minmax": ["maximum", "minimum"],
    "catch9": ["maximum", "minimum", "mean", "median", "std", "stretch_high", "stretch_decreasing", "entropy_pairs", "transition_variance"],
}


def register(name: str, make: Callable[[Column], Column], aliases: tuple[str, ...] = ()) -> None:
    """Adds a feature: a function from a column of arrays to a column."""
    REGISTRY[name] = make
    ALIASES.update(dict.fromkeys(aliases, name))


def feature(name: str) -> Callable[[Column], Column]:
    """A registered feature by name or alias; a trailing + or - patches NaN, see ``patched``."""
    polarity = name[-1] if name[-1:] in "+-" and name[:-1] else ""
    base = ALIASES.get(name.rstrip("+-") if polarity else name, name.rstrip("+-") if polarity else name)
    if base not in REGISTRY:
        raise KeyError(f"unknown feature {name!r}")
    return patched(REGISTRY[base], polarity) if polarity else REGISTRY[base]


def feature_set(name: str | list[str]) -> list[str]:
    """Names of a set, or the given names after a check."""
    names = SETS.get(name) if isinstance(name, str) else list(name)
    if names is None:
        raise KeyError(f"unknown feature set {name!r}; one of {sorted(SETS)}")
    for n in names:
        feature(n)
    return list(names)


def patched(make: Callable[[Column], Column], polarity: str) -> Callable[[Column], Column]:
    """The feature with NaN replaced so that the test fails: -inf for + (>=), inf for - (<=)."""
    bottom = {"+": float("-inf"), "-": float("inf")}[polarity]
    return lambda a: F.nanvl(make(a), F.lit(bottom))


@dataclass(frozen=True)
class VariableFeature:
    """A function of one variable, or the variable itself where ``fun`` is None."""

    variable: str | int
    fun: str | None = None
    prefix: str = "V"

    @property
    def name(self) -> str:
        v = f"{self.prefix}{self.variable}" if isinstance(self.variable, int) else self.variable
        return v if self.fun is None else f"{self.fun}[{v}]"

    def column(self, names: list[str] | None = None) -> Column:
        v = F.col(f"`{names[self.variable - 1] if isinstance(self.variable, int) and names else self.variable}`")
        return v if self.fun is None else feature(self.fun)(v)


@dataclass(frozen=True)
class RowFeature:
    """A function over several variables of a row."""

    name: str
    variables: tuple[str, ...]
    make: Callable[..., Column]

    def column(self, names: list[str] | None = None) -> Column:
        return self.make(*[F.col(f"`{v}`") for v in self.variables])


COLLAPSING = {"minimum", "maximum", "soft_minimum", "soft_maximum"}


def is_collapsing(f: VariableFeature) -> bool:
    """Whether the feature of a window can be had from the features of its parts."""
    return ALIASES.get(f.fun or "", f.fun) in COLLAPSING


#: Abbreviations of a feature together with a test operator.
ABBREVIATIONS = {("minimum", ">="): "⪴", ("minimum", "<="): "⪳", ("maximum", ">="): "⪲", ("maximum", "<="): "⪱"}

#: Test operators by sign: at least, at most, above, below.
TEST_SIGNS = {"⪰": ">=", "⪯": "<=", "≻": ">", "≺": "<"}


def parse_test(text: str, names: list[str] | None = None) -> tuple[VariableFeature, str]:
    """Feature and operator of texts such as ``⪴[V1]`` or ``⤓[V1] ⪰``; an unknown sign raises."""
    for (fun, op), sign in ABBREVIATIONS.items():
        if text.strip().startswith(sign):
            return parse_feature(fun + text.strip()[len(sign) :], names), op
    body, sign = text.strip()[:-1], text.strip()[-1:]
    if sign not in TEST_SIGNS:
        raise ValueError(f"no test: {text!r}")
    return parse_feature(body, names), TEST_SIGNS[sign]


_FEATURE = re.compile(r"\s*([^\s\[\]]+)\s*\[\s*([^\[\]]+?)\s*\]\s*")


def parse_feature(text: str, names: list[str] | None = None, prefix: str = "V", aliases: dict[str, str] | None = None) -> VariableFeature:
    """``fun[V2]``, ``fun[name]`` or a bare variable; unknown functions and variables raise."""

    def variable(v: str) -> str | int:
        if prefix and re.fullmatch(re.escape(prefix) + r"\d+", v):
            return int(v[len(prefix) :])
        if names is not None and v not in names:
            raise ValueError(f"unknown variable {v!r}")
        return v

    m = _FEATURE.fullmatch(text)
    if not m:
        if re.search(r"[\[\]\s]", text.strip()) or not text.strip():
            raise ValueError(f"no feature: {text!r}")
        return VariableFeature(variable(text.strip()), None, prefix)
    fun = (aliases or {}).get(m[1], ALIASES.get(m[1], m[1]))
    feature(fun)
    return VariableFeature(variable(m[2]), fun, prefix)


def round_numbers(text: str, digits: int = 2) -> str:
    """Every decimal number in a text with ``digits`` decimals."""
    return re.sub(r"\d+\.\d+", lambda m: f"{float(m[0]):.{digits}f}", text)
