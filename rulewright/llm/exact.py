"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition reduces its rows to a sorted run of (digest, length, smallest id, count).
With R**L partitions the runs are exchanged in L binomial rounds: in round l a partition
cuts its run by the l-th base-R digit of the digest, sends each slice to the partition whose
own l-th digit is that value, and merges the R slices that it gets. Equal digests meet and
collapse at every level, so a text that fills a third of the table is one record per
partition before the first round, and after the last round each partition owns one range of
digests. A round moves each record once; no partition ever holds more than its range.

Each merge verifies its result: keys strictly increase, the counts add up to those that came
in, and no identifier is below the smallest that came in for the slice. A key is the
SHA-256 digest and the length of the normalised text, so a clash of digests of texts of
different lengths could not join them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import spread_join, staged

RADIX = 4
#: Records that a partition holds after the last round, about.
RECORDS = 500_000
#: Records of one run that travel in one row.
SLICE = 32_768

_NO_ID = np.iinfo(np.int64).max
_RECORD = np.dtype([("key", "S40"), ("keep", "<i8"), ("size", "<i8")])
_WHITE = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_RUNS = re.compile(b"  +")


def normalised(text: str | None) -> bytes:
    """UTF-8 of ``text`` (null: empty) with each run of ASCII white space replaced by one blank."""
    return _RUNS.sub(b" ", text.encode("utf-8", "surrogatepass").translate(_WHITE)) if text else b""


def _digests(batches: Iterator[pa.RecordBatch]):
    for batch in common.sliced(batches):
        texts = [normalised(t) for t in common.column(batch, "text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), *batch.columns[2:]],
            names=["doc_id", "digest", "n_bytes", *batch.schema.names[2:]],
        )


def collapse(records: np.ndarray) -> np.ndarray:
    """One record for each key of a sorted run: the smallest id, the sum of the counts."""
    if not len(records):
        return records
    starts = np.flatnonzero(np.concatenate(([True], records["key"][1:] != records["key"][:-1])))
    out = records[starts]
    out["keep"] = np.minimum.reduceat(records["keep"], starts)
    out["size"] = np.add.reduceat(records["size"], starts)
    return out


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """A tournament of two-way merges of sorted runs, collapsed and verified at each level."""
    runs = [r for r in runs if len(r)]
    if not runs:
        return np.empty(0, _RECORD)
    total, least = sum(int(r["size"].sum()) for r in runs), min(int(r["keep"].min()) for r in runs)
    while len(runs) > 1:
        runs = [_merge_two(runs[i], runs[i + 1]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    out = collapse(runs[0])
    if int(out["size"].sum()) != total or int(out["keep"].min()) != least or not (out["key"][1:] > out["key"][:-1]).all():
        raise RuntimeError("a merged run is not the ordered union of its parts")
    return out


def _merge_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a) + len(b), _RECORD)
    at = np.searchsorted(a["key"], b["key"], side="right") + np.arange(len(b))
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at], out[rest] = b, a
    return collapse(out)


def _slices(run: np.ndarray, own: int, level: int, levels: int, radix: int):
    """Rows (target, run) for the round ``level``: the partition number with one digit replaced."""
    place = radix ** (levels - 1 - level)
    lead = np.frombuffer(run["key"].tobytes(), np.uint8).reshape(-1, 40)[:, :4].astype(np.int64) if len(run) else np.empty((0, 4), np.int64)
    number = (lead[:, 0] << 24 | lead[:, 1] << 16 | lead[:, 2] << 8 | lead[:, 3]) * radix**levels >> 32
    digit = number // place % radix
    for d in range(radix):
        part = run[digit == d]
        target = own + (d - own // place % radix) * place
        for i in range(0, len(part), SLICE):
            yield target, part[i : i + SLICE].tobytes()


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())], names=["target", "run"])


def _first_runs(levels: int, radix: int):
    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        own = TaskContext.get().partitionId() % radix**levels
        runs = []
        for batch in batches:
            if not batch.num_rows:
                continue
            r = np.empty(batch.num_rows, _RECORD)
            r["key"] = [d + n.to_bytes(8, "big") for d, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            r["keep"] = np.asarray(batch.column(0).fill_null(_NO_ID))
            r["size"] = 1
            runs.append(collapse(r[np.argsort(r["key"], kind="stable")]))
        for row in _slices(merge(runs), own, 0, levels, radix):
            yield _batch([row])

    return run


def _round(level: int, levels: int, radix: int):
    def run(batches: Iterator[pa.RecordBatch]):
        own, runs = None, []
        for batch in batches:
            for target, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = target
                runs.append(np.frombuffer(blob, _RECORD))
        if runs:
            merged = merge(runs)
            if level < levels:
                for row in _slices(merged, own, level, levels, radix):
                    yield _batch([row])
            else:
                for i in range(0, len(merged), SLICE):
                    part = merged[i : i + SLICE]
                    raw = np.frombuffer(part["key"].tobytes(), np.uint8).reshape(-1, 40)
                    keys = [k.tobytes() for k in raw]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k[:32] for k in keys], pa.binary()),
                            pa.array([int.from_bytes(k[32:], "big") for k in keys], pa.int64()),
                            pa.array([None if x == _NO_ID else int(x) for x in part["keep"]], pa.int64()),
                            pa.array(part["size"], pa.int64()),
                        ],
                        names=["digest", "n_bytes", "keep_id", "group_size"],
                    )

    return run


def tree_merge(digests: DataFrame, radix: int = RADIX, records: int = RECORDS) -> DataFrame:
    """digest, n_bytes, keep_id, group_size of a table (doc_id, digest, n_bytes)."""
    levels, n = 2, digests.count()
    while radix**levels * records < n:
        levels += 1
    runs = digests.mapInArrow(_first_runs(levels, radix), "target int, run binary")
    for level in range(1, levels + 1):
        runs = runs.repartitionById(radix**levels, "target")
        last = level == levels
        runs = runs.mapInArrow(_round(level, levels, radix), "digest binary, n_bytes long, keep_id long, group_size long" if last else "target int, run binary")
    return runs


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_key: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    With ``row_key`` also ``row_key``, which ``common.row_key`` gives for the row.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one blank; a
    null text counts as empty. Of equal texts the smallest id stays. Rows that repeat that id
    and text cannot be told apart and are all marked as kept. Null ids come last: such a row
    stays only if all ids of its group are null, and keep_id is then null. An id of
    2**63 - 1 counts as null. An empty table gives an empty result; other columns are not read.
    """
    keys = [common.row_key(text_col)] if row_key else []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keys)
    digests = staged(docs.mapInArrow(_digests, "doc_id long, digest binary, n_bytes long" + ", row_key long" * row_key), "digests")
    groups = staged(tree_merge(digests), "groups")
    repeated = groups.where("group_size > 1").withColumnsRenamed({"digest": "of_digest", "n_bytes": "of_bytes"})
    match = (F.col("digest") == F.col("of_digest")) & (F.col("n_bytes") == F.col("of_bytes"))
    out = spread_join(digests, repeated, match, "group_size", digests)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *(["row_key"] if row_key else []),
    )


ORACLE = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""
