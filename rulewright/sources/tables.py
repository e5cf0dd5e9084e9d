"""Sources and sinks of tables: CSV, Parquet, cached extractions, label files, samples."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """A CSV file; without a schema its types are inferred, which reads it twice."""
    reader = spark.read.option("header", header)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_store(spark: SparkSession, path: str, where: dict[str, list] | None = None) -> DataFrame:
    """A Parquet table, with rows chosen by values of columns; the choice reaches the scan."""
    df = spark.read.parquet(path)
    for column, values in (where or {}).items():
        df = df.where(F.col(column).isin(*values))
    return df


def write_store(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def cached(spark: SparkSession, folder: str, name: str, params: dict, build: Callable[[], DataFrame], use: bool = True) -> DataFrame:
    """What ``build`` makes, kept as Parquet under a name and a digest of its parameters."""
    if not use:
        return build()
    key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}-{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_labels(spark: SparkSession, path: str, recode: dict[str, str], id_column: str, label_column: str) -> DataFrame:
    """id, label of a CSV file: the classes of ``recode``, renamed; others are left out."""
    table = F.create_map(*[F.lit(x) for p in recode.items() for x in p])
    rows = read_csv(spark, path).select(F.col(id_column).cast("string").alias("id"), F.try_element_at(table, F.col(label_column).cast("string")).alias("label"))
    return rows.where(F.col("label").isNotNull())


def merge_labels(df: DataFrame, labels: DataFrame, id_df: str, id_labels: str, label: str, broadcast_rows: int = 200_000) -> DataFrame:
    """``df`` with the label of its id; rows without one are left out. A small label table is broadcast."""
    right = labels.select(F.col(id_labels).alias("_id"), F.col(label))
    if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        right = F.broadcast(right)
    return df.join(right, F.col(id_df) == F.col("_id")).drop("_id")


def rename_all(df: DataFrame, rename: Callable[[str], str]) -> DataFrame:
    return df.withColumnsRenamed({c: rename(c) for c in df.columns})


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """``df`` with its place in an order, from 0, by counted ranges instead of one global window.

    The first column of the order is a number or a time, by whose approximate quantiles the ranges
    are cut; rows of one value are in one range.
    """
    from ..operators.evaluation import ranked_by_key

    return ranked_by_key(df, order[0], *order[1:]).withColumnRenamed("rank", name).drop("size")


@dataclass(frozen=True)
class Source:
    """A table in memory or anywhere else, of named columns, that knows its rows."""

    table: DataFrame

    @classmethod
    def of_columns(cls, spark: SparkSession, columns: dict[str, list]) -> Source:
        """Columns of equal length; a ValueError otherwise."""
        if len({len(v) for v in columns.values()}) > 1:
            raise ValueError("columns of different lengths")
        return cls(spark.createDataFrame(pa.table(columns)) if columns else spark.createDataFrame([], "value int").drop("value"))

    @classmethod
    def of_vector(cls, spark: SparkSession, values: list, name: str = "value") -> Source:
        return cls.of_columns(spark, {name: values})

    def is_empty(self) -> bool:
        return self.table.isEmpty()

    def n_rows(self) -> int:
        return self.table.count()


def sample_iris(spark: SparkSession, n_per_class: int = 50) -> DataFrame:
    """A made-up table of the shape of a well-known flower sample, the same on every run.

    Three classes with normal measurements around class means; no network is needed.
    """
    classes = [("setosa", (5.0, 3.4, 1.5, 0.25)), ("versicolor", (5.9, 2.8, 4.3, 1.3)), ("virginica", (6.6, 3.0, 5.6, 2.0))]
    import random

    rng = random.Random(7)
    rows = [(i * n_per_class + k, *(round(max(rng.gauss(m, 0.28), 0.1), 1) for m in means), name) for i, (name, means) in enumerate(classes) for k in range(n_per_class)]
    return spark.createDataFrame(rows, "row_id long, sepal_length double, sepal_width double, petal_length double, petal_width double, label string")


def sample_houses(spark: SparkSession, n: int = 506) -> DataFrame:
    """A made-up table of the shape of a well-known sample of house prices, the same on every run.

    Twelve measurements of a district and the median price, which falls with crime and poverty and
    rises with rooms, with noise; prices end at 50.
    """
    import random

    rng = random.Random(11)
    rows = []
    for i in range(n):
        poor, rooms, crime = rng.uniform(2, 35), rng.gauss(6.3, 0.7), rng.lognormvariate(-0.8, 1.6)
        rest = (rng.choice((0.0, 12.5, 25.0, 80.0)), rng.uniform(1, 25), float(rng.random() < 0.07), rng.uniform(0.38, 0.87), rng.uniform(5, 100), rng.uniform(1, 12), float(rng.randint(1, 24)), float(rng.randint(190, 710)), rng.uniform(12.6, 22.0))
        price = 28 + 5.5 * (rooms - 6.3) - 0.55 * (poor - 12) - 0.12 * min(crime, 40) - 0.6 * (rest[8] - 18) + 2.5 * rest[2] + rng.gauss(0, 2.5)
        rows.append((i, crime, *rest[:4], rooms, *rest[4:], poor, round(min(max(price, 5.0), 50.0), 1)))
    names = ("crime", "zoned", "industry", "river", "oxides", "rooms", "age", "distance", "highways", "tax", "pupils", "poor", "price")
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} double" for c in names))


def sample_linear(spark: SparkSession, n: int = 1000, weights: tuple[float, ...] = (2.0, 3.0, -1.0, 0.5, 1.0), noise: float = 0.1, seed: int = 42) -> DataFrame:
    """x1.., y = weights . x + noise, the same on every run."""
    import random

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in weights]
        rows.append((i, *x, sum(a * b for a, b in zip(weights, x, strict=True)) + noise * rng.gauss(0, 1)))
    schema = T.StructType([T.StructField("row_id", T.LongType()), *[T.StructField(f"x{i + 1}", T.DoubleType()) for i in range(len(weights))], T.StructField("y", T.DoubleType())])
    return spark.createDataFrame(rows, schema)
