"""ARFF files of relational series: a Spark data source and its parser.

A data line holds a quoted block, whose variables are parted by a literal backslash and n and
their values by commas, then a comma and the class. Lines with % are comments, lines with @
are headers. Files may be plain, or members of a zip archive.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Data lines that travel together.
BATCH_ROWS = 1_000
SCHEMA = "line long, series array<array<double>>, class string, split string"


def parse_line(line: str) -> tuple[list[list[float]], str] | None:
    """(series of the variables, class) of a data line; None for any other line."""
    line = line.strip()
    if not line.startswith("'"):
        return None
    block, _, label = line[1:].rpartition("'")
    return [[float("nan") if v.strip() == "?" else float(v) for v in part.split(",")] for part in block.split("\\n")], label.strip().lstrip(",").strip()


class ArffSource(DataSource):
    """Option ``path``: files or folders parted by commas, each as split=path or path; a zip member as zip!member."""

    @classmethod
    def name(cls) -> str:
        return "rulewright_arff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "ArffReader":
        return ArffReader([p for p in self.options["path"].split(",") if p])


class ArffFile(InputPartition):
    def __init__(self, split: str, path: str):
        self.split, self.path = split, path


class ArffReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[ArffFile]:
        out = []
        for p in self.paths:
            split, path = p.split("=", 1) if "=" in p else ("all", p)
            store, base = _store(path.partition("!")[0])
            if "!" not in path and store.get_file_info(base).type == fs.FileType.Directory:
                found = store.get_file_info(fs.FileSelector(base))
                out += [ArffFile(split, f"{path.rstrip('/')}/{i.base_name}") for i in sorted(found, key=lambda i: i.path) if i.is_file and not i.base_name.startswith(("_", "."))]
            else:
                out.append(ArffFile(split, path))
        return out

    def read(self, partition: ArffFile) -> Iterator[pa.RecordBatch]:
        path, _, member = partition.path.partition("!")
        store, base = _store(path)
        with store.open_input_file(base) as file:
            raw = zipfile.ZipFile(file).open(member) if member else file
            held: list[tuple] = []
            with io.TextIOWrapper(io.BufferedReader(raw) if not member else raw, "utf-8") as lines:
                for i, line in enumerate(lines):
                    found = parse_line(line)
                    if found:
                        held.append((i, *found))
                    if len(held) == BATCH_ROWS:
                        yield _batch(held, partition.split)
                        held = []
            if held:
                yield _batch(held, partition.split)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that driver and executors can see."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _batch(rows: list[tuple], split: str) -> pa.RecordBatch:
    line, series, label = zip(*rows, strict=True)
    columns = [pa.array(line, pa.int64()), pa.array(series, pa.list_(pa.list_(pa.float64()))), pa.array(label, pa.string()), pa.array([split] * len(rows), pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["line", "series", "class", "split"])


def read_arff(spark: SparkSession, paths: dict[str, str], names: list[str] | None = None, classes: dict[str, str] | None = None, split: str = "all") -> DataFrame:
    """line, one column for each variable, class, split of the files named by split.

    ``split`` is one of the names of ``paths`` or "all"; variables are renamed by ``names``, and
    classes by ``classes``. Rows of one class are not moved together unless asked by ``orderBy``.
    """
    if split != "all" and split not in paths:
        raise ValueError(f"unknown split {split!r}")
    spark.dataSource.register(ArffSource)
    chosen = paths if split == "all" else {split: paths[split]}
    df = spark.read.format("rulewright_arff").option("path", ",".join(f"{k}={p}" for k, p in chosen.items())).load()
    n = len(names) if names else (df.agg(F.max(F.size("series"))).first()[0] or 0)
    names = names or [f"V{i + 1}" for i in range(n)]
    label = F.col("class")
    if classes:
        label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in classes.items() for x in p]), label), label)
    return df.select("line", *[F.get("series", F.lit(i)).alias(c) for i, c in enumerate(names)], label.alias("class"), "split")


def parse_arff_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """series, class of the data lines of a text table, in expressions only."""
    data = lines.where(F.ltrim(F.col(column)).startswith("'"))
    block = F.regexp_extract(column, r"^\s*'(.*)'\s*,?", 1)
    series = F.transform(F.split(block, r"\\n"), lambda v: F.transform(F.split(v, ","), lambda x: F.trim(x).try_cast("double")))
    return data.select(series.alias("series"), F.trim(F.regexp_extract(column, r"'\s*,\s*([^']*)$", 1)).alias("class"))
