"""Helpers shared by the corpus operators: staged tables in the shared folder, checked
broadcasts, and vectorised hashing of whole texts.

Staging. A cluster's executors share only the folder named in ``spark.checkpoint.dir``.
Every intermediate table that is read more than once is written there as Parquet and read
back, so that a lost executor costs a re-read and never a recomputation of the job.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

#: Rows up to which a two-column key table is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000

#: Bytes of text that one vectorised step works on (several 8-byte arrays of this length live).
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C55)
_PINV = U64(pow(int(_P), -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of our own in local mode only.

    Where it is unset and the master is not local, a RuntimeError says so: a folder of the
    driver's machine is none that executors can see.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif is_local(sc.master):
            found = "file://" + tempfile.mkdtemp(prefix="rulewright-")
            sc.setCheckpointDir(found)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; ``path`` is kept for discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rulewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing lazy refers to any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(conf).delete(path, True)


def small_or_shuffled(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` with a broadcast hint if a count shows that it has at most ``most`` rows."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def row_key(text_col: str = "text") -> Column:
    """64-bit key of a row's text; with the id it tells apart rows that differ in more than other columns."""
    return F.xxhash64(F.col(text_col)).alias("row_key")


def one_of_each(docs: DataFrame, decided: DataFrame, group: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, row_key, kept, ``group``) keeps, one for each group.

    Rows are told apart by id and text, so a text that shares its id with a dropped one stays.
    Where several rows of a group are kept, as ids repeat or are null, the one with the
    smallest key of its text stays, and of rows that repeat id and text the smallest by their
    other columns (columns without an order must be alike). Rows without a group stay. What is
    dropped is joined by id and key; columns of ``docs`` cannot clash with it.
    """
    decided = staged(decided.select(F.col("doc_id").alias("of_id"), F.col("row_key").alias("of_key"), "kept", F.col(group).alias("of_group")), "decided")
    total = decided.count()
    many = decided.where("kept and of_group is not null").groupBy("of_group").agg(F.min("of_key").alias("least"), F.count("*").alias("n")).where("n > 1")
    many = staged(many.withColumnRenamed("of_group", "g"), "ties")
    ties = spread_join(decided.where("kept"), many, F.col("of_group") == F.col("g"), "n", total).where("g is not null")
    loses = decided.where("not kept").select("of_id", "of_key", F.lit(True).alias("goes")).unionByName(ties.select("of_id", "of_key", (F.col("of_key") != F.col("least")).alias("goes")))
    # one row for every key that goes or is repeated, with the number of its rows
    keys = loses.groupBy("of_id", "of_key").agg(F.count("*").alias("n"), F.max("goes").alias("goes")).where("goes or n > 1")
    keys = staged(keys, "keys")
    match = docs[id_col].cast("long").eqNullSafe(F.col("of_id")) & (F.xxhash64(docs[text_col]) == F.col("of_key"))
    left = spread_out(docs, keys, match, total)
    again = keys.where("not goes")
    if again.isEmpty():
        return left
    ordered = [c.name for c in docs.schema if not isinstance(c.dataType, (MapType, VariantType))]
    whole, order = F.struct(*[docs[c] for c in docs.columns]), F.struct(*[docs[c] for c in ordered])
    hot = F.col("n") * BROADCAST_ROWS >= total
    copies = None
    for part, few in ((again.where(hot), True), (again.where(~hot), False)):
        some = docs.join(F.broadcast(part) if few else small_or_shuffled(part), match).select("of_id", "of_key", whole.alias("row_of"), order.alias("order_of"))
        copies = some if copies is None else copies.unionByName(some)
    one = copies.groupBy("of_id", "of_key").agg(F.min_by("row_of", "order_of").alias("row_of")).select("row_of.*")
    return left.unionByName(one)


def spread_out(rows: DataFrame, keys: DataFrame, match, total: int) -> DataFrame:
    """``rows`` without those of ``keys`` (one row a key, ``n`` its rows), without a task that gets a hot key's rows.

    As in ``spread_join``: few keys are broadcast, and of many those with at least total / BROADCAST_ROWS rows.
    """
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), match, "left_anti")
    hot = F.col("n") * BROADCAST_ROWS >= total
    return rows.join(F.broadcast(keys.where(hot)), match, "left_anti").join(keys.where(~hot), match, "left_anti")


def spread_join(rows: DataFrame, keys: DataFrame, match, size: str, total: int | DataFrame) -> DataFrame:
    """``rows`` left-joined to ``keys`` (one row a key), without a task that gets a hot key's rows.

    ``size`` is the column of ``keys`` that counts the rows of a key and ``total`` their sum, or the
    table to count if it is needed. Few keys are broadcast. Of many, those with at least total / BROADCAST_ROWS rows are: there are
    at most BROADCAST_ROWS of them. What is left has no hot key and is shuffled.
    """
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), match, "left")
    total = total.count() if isinstance(total, DataFrame) else total
    hot = F.col(size) * BROADCAST_ROWS >= total
    few = F.broadcast(keys.where(hot))
    cold = rows.join(few, match, "left_anti").join(keys.where(~hot), match, "left")
    return rows.join(few, match).unionByName(cold)


def marked(rows: DataFrame, ids: DataFrame, id_col: str, name: str) -> DataFrame:
    """``rows`` with a flag ``name``: whether ``id_col`` is in the one column of ``ids`` (distinct, no nulls).

    Few ids are broadcast. Of many, the ids with at least 1 / BROADCAST_ROWS of the rows, null among them,
    are broadcast with their flags, whether they are in ``ids`` or not; the rest has no hot id and is shuffled.
    """
    ids = ids.toDF("of_id")
    match = F.col(id_col) == F.col("of_id")
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), match, "left").withColumn(name, F.col("of_id").isNotNull()).drop("of_id")
    total = rows.count()
    hot = rows.groupBy(F.col(id_col).alias("hot_id")).agg(F.count("*").alias("n")).where(F.col("n") * BROADCAST_ROWS >= total)
    hot = staged(hot.join(ids, F.col("hot_id") == F.col("of_id"), "left").select("hot_id", F.col("of_id").isNotNull().alias(name)), "hot")
    same = F.col(id_col).eqNullSafe(F.col("hot_id"))
    few = rows.join(F.broadcast(hot), same).drop("hot_id")
    rest = rows.join(F.broadcast(hot), same, "left_anti").join(ids, match, "left").withColumn(name, F.col("of_id").isNotNull()).drop("of_id")
    return few.unionByName(rest)


def lowered_ascii(text: str) -> bytes:
    """UTF-8 with only A-Z lower-cased and ASCII white space made blanks."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


_LOWER = bytes(32 if c in (9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``size`` bytes each; one long text is a range of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply rounds), bijective."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class SpanHashes:
    """64-bit hashes of arbitrary spans of one array of symbols, from polynomial prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        powers = _powers(_P, n)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((symbols.astype(U64) + U64(1)) * powers[:n], out=self.sums[1:])
        self.inverse = _powers(_PINV, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[int(base)] = have
    return have[:n]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that few texts are Python values at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def column(batch: pa.RecordBatch, name: str) -> list:
    """A column of an Arrow batch as Python values."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
