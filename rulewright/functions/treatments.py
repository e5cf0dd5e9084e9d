"""Treatments: tables of series to tables of features.

Columns of the wide form are ordered by feature, then variable, then window.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .quantiles import exact_quantiles
from .windows import Windowing, in_window, reduce_windows


def dimension(df: DataFrame, columns: list[str]) -> int:
    """0 if all columns are numbers, 1 if all are series of numbers; otherwise a TypeError."""
    kinds = set()
    for c in columns:
        t = df.schema[c].dataType
        if isinstance(t, T.ArrayType):
            if not isinstance(t.elementType, T.NumericType):
                raise TypeError(f"{c}: series of numbers only")
            kinds.add(1)
        elif isinstance(t, T.NumericType):
            kinds.add(0)
        else:
            raise TypeError(f"{c}: neither a number nor a series")
    if len(kinds) != 1:
        raise TypeError("columns of different dimensions, or none")
    return kinds.pop()


def longest_series(df: DataFrame, columns: list[str]) -> int:
    """Length of the longest series, the one action that ragged tables need."""
    return df.agg(F.greatest(*[F.max(F.size(c)) for c in columns], F.lit(0))).first()[0]


def uniform_length(df: DataFrame, columns: list[str]) -> int:
    """The one length of all series; a ValueError if there are several."""
    low, high = df.agg(F.least(*[F.min(F.size(c)) for c in columns], F.lit(2**31 - 1)), F.greatest(*[F.max(F.size(c)) for c in columns], F.lit(-1))).first()
    if low != high:
        raise ValueError(f"series of {low} to {high} values")
    return low


def column_name(fun: str, variable: str, window: int, n_windows: int) -> str:
    return f"{fun}({variable})" if n_windows == 1 else f"{fun}({variable})w{window}"


def variable_names(functions: list[str], frequencies: dict[str, list[float]] | None = None, prefix: str = "", unit: str = "Hz") -> list[str]:
    """Names of variables, one for each function, or for each of its band frequencies as whole numbers with their unit."""
    out = []
    for f in functions:
        bands = (frequencies or {}).get(f)
        out += [f"{prefix}{f}"] if bands is None else [f"{prefix}{f}[{round(x)}{unit}]" for x in bands]
    return out


def product_of(variables: list[str], n_windows: int, features: list[str]) -> list[tuple[str, int, str]]:
    """(variable, window, feature) in the order variable, window, feature."""
    return list(itertools.product(variables, range(1, n_windows + 1), features))


def aggregate(df: DataFrame, variables: list[str], features: list[str], windowing: Windowing, length: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """One column for each feature, variable and window; NaN where a row is too short."""
    bounds = windowing.of(length or longest_series(df, variables))
    cells = [(f, v, i, lo, n) for f in features for v in variables for i, (lo, n) in enumerate(bounds, 1)]
    return df.select(*(keep or []), *[in_window(F.col(v), lo, n, arrays.feature(f)).alias(column_name(f, v, i, len(bounds))) for f, v, i, lo, n in cells])


def reduce_size(df: DataFrame, variables: list[str], windowing: Windowing, fun: str = "mean", length: int | None = None) -> DataFrame:
    """Each series replaced by the values of its windows."""
    bounds = windowing.of(length or longest_series(df, variables))
    return df.withColumns({v: reduce_windows(F.col(v), bounds, fun) for v in variables})


def long_features(df: DataFrame, row_id: str, variables: list[str], features: list[str], windowing: Windowing, length: int | None = None) -> DataFrame:
    """row_id, var, win, fun, value: the long form, one row for each cell."""
    bounds = windowing.of(length or longest_series(df, variables))
    cells = [
        F.struct(F.lit(v).alias("var"), F.lit(i).alias("win"), F.lit(f).alias("fun"), in_window(F.col(v), lo, n, arrays.feature(f)).alias("value"))
        for f in features
        for v in variables
        for i, (lo, n) in enumerate(bounds, 1)
    ]
    return df.select(F.col(row_id).alias("row_id"), F.explode(F.array(*cells)).alias("x")).select("row_id", "x.*")


def preprocess(df: DataFrame, row_id: str, variables: list[str] | None = None, features: list[str] | str = "catch9", n_windows: int = 6, overlap: float = 0.05) -> DataFrame:
    """The long form with the usual settings."""
    variables = variables or [c for c, t in df.dtypes if t.startswith("array")]
    dimension(df, variables)
    return long_features(df, row_id, variables, arrays.feature_set(features), Windowing("overlapping", n_windows, overlap))


def extract(df: DataFrame, cells: list[tuple[str, int, str]], windowing: Windowing, length: int | None = None, separator: str = "@@@", keep: list[str] | None = None) -> DataFrame:
    """A wide table with columns var@@@win@@@fun for the cells given."""
    bounds = windowing.of(length or longest_series(df, sorted({v for v, _, _ in cells})))
    return df.select(*(keep or []), *[in_window(F.col(v), *bounds[w - 1], arrays.feature(f)).alias(f"{v}{separator}w{w}{separator}{f}") for v, w, f in cells])


def pivot_long(long: DataFrame, separator: str = "@@@") -> DataFrame:
    """The wide table of a long one."""
    return long.groupBy("row_id").pivot("name").agg(F.first("value")) if "name" in long.columns else pivot_long(long.withColumn("name", F.concat_ws(separator, "var", F.concat(F.lit("w"), F.col("win")), "fun")), separator)


def replace_special(c: Column, nan: float = 0.0, inf: float = 1.0, minus_inf: float = 0.0) -> Column:
    """NaN, infinity and minus infinity replaced by constants."""
    return F.when(F.isnan(c), F.lit(nan)).when(c == float("inf"), F.lit(inf)).when(c == float("-inf"), F.lit(minus_inf)).otherwise(c)


def normalise_groups(long: DataFrame, low: float | None = None, high: float | None = None, by: tuple[str, ...] = ("win", "fun"), exact: bool = False) -> DataFrame:
    """Values of each (window, feature) group scaled to [0, 1] together.

    Bounds are the minimum and maximum of the finite values, or the quantiles ``low`` and
    ``high``, approximate ones with an error below a ten-thousandth of the rows unless ``exact``, which
    takes a few counting passes. What is still NaN or infinite, or in a group of one value, becomes 0.5.
    Groups are few and may hold any share of the rows, so their bounds go to the rows.
    """
    finite = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    if exact and (low is not None or high is not None):
        found = exact_quantiles(long.withColumn("value", finite), list(by), "value", [0.0 if low is None else low, 1.0 if high is None else high])
        bounds = long.select(*by).distinct().join(found, list(by), "left").select(*by, F.get("q", F.lit(0)).alias("_lo"), F.get("q", F.lit(1)).alias("_hi"))
    else:
        quantile = lambda p: F.percentile_approx(finite, p, 10_000)
        bounds = long.groupBy(*by).agg((F.min(finite) if low is None else quantile(low)).alias("_lo"), (F.max(finite) if high is None else quantile(high)).alias("_hi"))
    scaled = F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    bad = scaled.isNull() | F.isnan(scaled) | (F.abs(scaled) == float("inf"))
    return long.join(F.broadcast(bounds), list(by)).withColumn("value", F.when(bad, F.lit(0.5)).otherwise(scaled)).drop("_lo", "_hi")


def standardise(df: DataFrame, columns: list[str], center: bool = True, scale: bool = True) -> DataFrame:
    """Columns less their mean and divided by their sample deviation, as asked; a deviation of 0 gives null."""
    if not center and not scale:
        return df
    sums = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    wide = df.crossJoin(F.broadcast(sums))  # one row
    shifted = {c: (F.col(c) - F.col(f"_m{i}") if center else F.col(c)) for i, c in enumerate(columns)}
    out = {c: (F.try_divide(v, F.col(f"_s{i}")) if scale else v) for i, (c, v) in enumerate(shifted.items())}
    return wide.withColumns(out).drop(*sums.columns)


def jitter(df: DataFrame, columns: list[str], seed: int, amount: float = 1e-10) -> DataFrame:
    """Columns with normal noise of ``amount`` times max(1, mean absolute value)."""
    sums = df.agg(*[F.greatest(F.lit(1.0), F.avg(F.abs(c))).alias(f"_a{i}") for i, c in enumerate(columns)])
    wide = df.crossJoin(F.broadcast(sums))  # one row
    return wide.withColumns({c: F.col(c) + F.lit(amount) * F.col(f"_a{i}") * F.randn(seed + i) for i, c in enumerate(columns)}).drop(*sums.columns)


def preparation(columns: list[str], categorical: list[str] | None = None, pca: int | None = None):
    """An MLlib pipeline: one-hot encoding, standardising, and principal components if asked."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    categorical = categorical or []
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categorical]
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_1" for c in categorical]))
    stages.append(VectorAssembler(inputCols=[*columns, *[f"{c}_1" for c in categorical]], outputCol="raw", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    if pca:
        stages.append(PCA(k=pca, inputCol="features", outputCol="components"))
    return Pipeline(stages=stages)
