import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def canonical(df):
    """Rows of a pandas frame as sorted text, columns by name, floats to nine digits."""
    df = df[sorted(df.columns)]

    def value(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return float(f"{v:.9g}") + 0.0
        return list(v) if hasattr(v, "__len__") and not isinstance(v, (str, bytes)) else str(v)

    return sorted(repr([value(v) for v in row]) for row in df.astype(object).itertuples(index=False, name=None))
