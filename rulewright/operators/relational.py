"""Relational helpers whose semantics are fixed here: codes, selections, set operations, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_dictionary(df: DataFrame, label: str, base: int = 1) -> DataFrame:
    """label, code: sorted distinct labels numbered from ``base``; nulls have no code."""
    distinct = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    # one row for each class
    return distinct.select("label", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1 + base).alias("code"))


def encode_labels(df: DataFrame, label: str, name: str = "code", base: int = 1) -> DataFrame:
    """``df`` with the code of its label; null for null. The dictionary has one row for each class,
    and is broadcast by Spark where that is few."""
    codes = class_dictionary(df, label, base).select(F.col("label").alias("_l"), F.col("code").alias(name))
    return df.join(codes, F.col(label) == F.col("_l"), "left").drop("_l")


def decode_labels(df: DataFrame, code: str, dictionary: DataFrame, name: str = "label") -> DataFrame:
    words = dictionary.select(F.col("code").alias("_c"), F.col("label").alias(name))
    return df.join(words, F.col(code) == F.col("_c"), "left").drop("_c")


def select_by_index(df: DataFrame, places: list[int]) -> DataFrame:
    """Columns by their places, from 0."""
    return df.select(*[df.columns[i] for i in places])


def bind_columns(*tables: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Tables side by side, joined by their row id; rows that one lacks have nulls there. Other names must differ."""
    names = [c for t in tables for c in t.columns if c != row_id]
    if len(names) != len(set(names)):
        raise ValueError("columns of the same name")
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, row_id, "full")
    return out


def cell(df: DataFrame, row_id: str, row, column: str | int) -> DataFrame:
    """The one value in a row and a column (by name, or place from 0), as a table ``value``."""
    return df.where(F.col(row_id) == F.lit(row)).select(F.col(df.columns[column] if isinstance(column, int) else column).alias("value"))


def matrix_product(a: DataFrame, b: DataFrame, boolean: bool = False) -> DataFrame:
    """i, j, v of the product of two matrices given by their cells (i, j, v); absent cells are 0.

    With ``boolean`` a cell is true where any pair of factors is.
    """
    pairs = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    value = F.bool_or(F.col("x").cast("boolean") & F.col("y").cast("boolean")) if boolean else F.sum(F.col("x") * F.col("y"))
    return pairs.groupBy("i", "j").agg(value.alias("v"))


def sort_by_length(df: DataFrame, series: str, longest_first: bool = True) -> DataFrame:
    """Rows by the length of their series; null ones last."""
    return df.orderBy(F.desc_nulls_last(F.size(series)) if longest_first else F.asc_nulls_last(F.size(series)))


def cast_all(df: DataFrame, columns: list[str], kind: str = "float") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c in columns})


def rows_in(df: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    return df.join(ids, row_id, "left_semi")


def rows_not_in(df: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    return df.join(ids, row_id, "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` has not."""
    return a.subtract(b)


def leaked(train: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct rows that both have."""
    return train.intersect(test)


def union_distinct(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def weighted_vote(votes: DataFrame, row_id: str, label: str, weight: str) -> DataFrame:
    """row_id, label, total: the label with the largest weight of each row; of equal ones the smallest."""
    sums = votes.groupBy(row_id, label).agg(F.sum(weight).alias("total"))
    best = sums.groupBy(row_id).agg(F.min(F.struct((-F.col("total")).alias("t"), F.col(label).alias("label"))).alias("m"))
    return best.select(row_id, F.col("m.label").alias(label), (-F.col("m.t")).alias("total"))


def majority_vote(votes: DataFrame, row_id: str, label: str) -> DataFrame:
    return weighted_vote(votes.withColumn("_one", F.lit(1)), row_id, label, "_one")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, low, high, n: equal bins from minimum to maximum, the last one closed; empty bins are there."""
    bounds = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).crossJoin(F.broadcast(bounds))  # one row
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    counts = rows.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = bounds.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def sample_rows(df: DataFrame, row_id: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement, the first in the order of a hash of their ids."""
    return df.orderBy(F.xxhash64(row_id, F.lit(seed)), row_id).limit(k)


def argmax_name(columns: list[str]) -> Column:
    """Name of the column with the largest value of a row; the first of equal ones."""
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in columns])
    return F.try_element_at(F.array(*[F.lit(c) for c in columns]), F.array_position(values, F.array_max(values)).cast("int"))


def natural_order(df: DataFrame, name: str) -> DataFrame:
    """Rows ordered by the text before a name's number, then the number."""
    return df.orderBy(F.regexp_extract(name, r"^(.*?)\d*$", 1), F.regexp_extract(name, r"(\d+)$", 1).try_cast("long"), name)


def series_by_key(df: DataFrame, key: str, order: list[str], value: str, name: str = "series") -> DataFrame:
    """key, series: the values of each key in order, as an array.

    A key's rows become one array value, so this suits series that fit one row.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v"))))
    return df.groupBy(key).agg(F.transform(items, lambda s: s["_v"]).alias(name))
