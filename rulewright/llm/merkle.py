"""Merkle fixity audit of record archives.

The records of a file are the leaves of its tree. A record is named by its id (several records
of one id by the order of their digests); a node holds the records of a range of ids, which in
an archive laid out by id is a range of offsets. A leaf's hash covers the record's id, its
length and the digest of its bytes; a node's hash covers, in the order of their offsets, the
name, the length and the hash of its children, and thus the ordered offsets within its range;
a file's root covers all of it. Offsets are counted from a node's own start, so a
record that grows, shrinks, is missing or is inserted changes the nodes above it and no others.

Two replicas are compared root by root. Only below a root that differs are children compared,
level by level down to the leaves, so an intact file costs one comparison and a damaged
record ``fanout`` comparisons for each level. Where a differing node names its children in another
order, the file's common records are put side by side, and the fewest that are out of place
are the ones that moved.

A node has at most ``fanout`` children (at the bottom, the records of one place), and each level is
written to the shared folder, from which the descent reads it again.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, spread_join, staged

FANOUT = 16
FILE_RECORDS = 1_000
#: Stands for the date of a record whose capture time is not known.
NO_DATE = "1970-01-01T00:00:00Z"


def warc_record(url: Column, body: Column, key: Column | None = None, date: str = NO_DATE) -> Column:
    """A WARC/1.1 resource record of a page as text, with all mandatory fields; nulls count as empty.

    The record's own id is a digest of ``key`` and the URL.
    """
    url, body, key = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit("")), F.lit(None) if key is None else key
    name = F.substring(F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), url), 256), 1, 32)
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), F.concat_ws("-", *parts), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
    )
    return F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def loose_files(records: DataFrame, key: str = "record_id", file_records: int = FILE_RECORDS) -> int:
    """How many files the records need that have no id of their own; replicas must use one number."""
    return records.where(F.col(key).isNull()).count() // file_records + 1


def archive_layout(records: DataFrame, key: str = "record_id", file_records: int = FILE_RECORDS, loose: int | None = None) -> DataFrame:
    """file, leaf, offset, length, digest, copies, record_id of (record_id, record) rows.

    Files hold id ranges of ``file_records``; records follow each other by id and digest, and
    identical records are one leaf with a count. Records without id are named by their digest
    and go to ``loose`` files below 0. So do all records of an id that has more than
    ``file_records`` different ones, to as many files as it takes. Only digests and lengths are
    shuffled, never the records. A null record counts as empty; an empty table gives an empty
    layout; other columns are not read.
    """
    leaves, file = _files(_hashed(records, key), file_records, loose)
    order = Window.partitionBy("file").orderBy("record_id", "digest", "length")
    offset = F.sum(F.col("length") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return leaves.withColumn("file", file).select(
        "file", (F.row_number().over(order) - 1).cast("long").alias("leaf"), F.coalesce(offset, F.lit(0)).cast("long").alias("offset"), "length", "digest", "copies", "record_id"
    )


def _hashed(records: DataFrame, key: str, *more: Column) -> DataFrame:
    record = F.coalesce(F.col("record"), F.lit(""))
    return records.select(F.col(key).cast("long").alias("record_id"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("length"), *more)


def _files(hashed: DataFrame, file_records: int, loose: int | None, rows: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """Distinct records (or ``rows``, which have their columns) with the file that each is in."""
    leaves = staged(hashed.groupBy("record_id", "digest", "length").agg(F.count("*").alias("copies")), "records")
    by_id = leaves.groupBy(F.col("record_id").alias("of_id")).agg(F.count("*").alias("n"), F.sum("copies").alias("rows"))
    total, most, nameless = by_id.agg(F.sum("n"), F.max(F.when(F.col("of_id").isNotNull(), F.col("n"))), F.max(F.when(F.col("of_id").isNull(), F.col("rows")))).first()
    loose = loose or (nameless or 0) // file_records + 1
    leaves = leaves if rows is None else rows
    if (most or 0) > file_records:
        crowded = staged(by_id.where(F.col("of_id").isNotNull() & (F.col("n") > file_records)), "crowded")
        leaves = spread_join(leaves, crowded, F.col("record_id") == F.col("of_id"), "n" if rows is None else "rows", total if rows is None else rows)
    else:
        leaves = leaves.withColumn("n", F.lit(None).cast("long"))
    files = F.when(F.col("n").isNull(), loose).otherwise(F.floor(F.col("n") / file_records) + 1)
    by_digest = -1 - F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), files)
    file = F.when(F.col("record_id").isNull() | F.col("n").isNotNull(), by_digest).otherwise(F.floor(F.col("record_id") / file_records))
    return leaves, file.cast("long")


def write_archives(records: DataFrame, directory: str, key: str = "record_id", file_records: int = FILE_RECORDS, loose: int | None = None) -> None:
    """Writes (record_id, record) rows as files of records one after another, ``file-<n>.warc``.

    Files and the order in them are those of ``archive_layout``, repeated records one after another.
    A file is written by one task, to a name of its own, and
    is then renamed, so that an attempt that fails leaves no file that counts.
    """
    fs.FileSystem.from_uri(directory)[0].create_dir(fs.FileSystem.from_uri(directory)[1], recursive=True)
    rows, file = _files(_hashed(records, key), file_records, loose, _hashed(records, key, F.encode(F.coalesce("record", F.lit("")), "utf-8").alias("record")))
    rows = rows.select(file.alias("file"), "record_id", "record", "digest", "length")

    def run(batches: Iterator[pa.RecordBatch]):
        store, base = fs.FileSystem.from_uri(directory)
        held, out, name = None, None, None
        for batch in batches:
            for number, record in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if number != held:
                    if out:
                        out.close()
                        store.move(name, f"{base}/file-{held}.warc")
                    held, name = number, f"{base}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                out.write(record.as_buffer())
        if out:
            out.close()
            store.move(name, f"{base}/file-{held}.warc")
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], names=["n"])

    rows.repartition("file").sortWithinPartitions("file", "record_id", "digest", "length").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def read_archives(spark: SparkSession, directory: str) -> DataFrame:
    """file, name, offset, length, digest of every record in the files of ``directory``, from their bytes.

    ``name`` is the WARC-Record-ID. A record ends by its Content-Length; one whose head cannot be
    read ends at the next line that starts a record and has a null name.
    """
    store, base = fs.FileSystem.from_uri(directory)
    files = sorted(i.path for i in store.get_file_info(fs.FileSelector(base)) if i.path.endswith(".warc"))
    rows = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files)))

    def run(batches: Iterator[pa.RecordBatch]):
        store, _ = fs.FileSystem.from_uri(directory)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                number = int(path.rsplit("file-", 1)[1][:-5])
                with store.open_input_file(path) as f:
                    found = [(number, *r) for r in records_of(f)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = zip(*found, strict=True) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "name", "offset", "length", "digest"])

    return rows.mapInArrow(run, "file long, name string, offset long, length long, digest string")


def records_of(file) -> Iterator[tuple[str | None, int, int, str]]:
    """(name, offset, length, digest) of the records of an open archive file, one record in memory at a time."""
    at, size = 0, file.size()
    while at < size:
        file.seek(at)
        head = b""
        while b"\r\n\r\n" not in head and at + len(head) < size and len(head) < 1 << 20:
            head += file.read(4096)
        head, found, _ = head.partition(b"\r\n\r\n")
        fields = dict(x.partition(b":")[::2] for x in head.split(b"\r\n")[1:])
        fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
        n = fields.get(b"content-length", b"")
        if head.startswith(b"WARC/") and found and n.isdigit() and at + len(head) + 8 + int(n) <= size:
            length, name = len(head) + 8 + int(n), fields.get(b"warc-record-id", b"").decode("utf-8", "replace") or None
        else:  # no head that can be read: all up to the next record
            file.seek(at)
            raw = file.read(size - at)
            next_at = raw.find(b"\r\nWARC/", 1)
            length, name = (next_at + 2 if next_at >= 0 else len(raw)), None
        file.seek(at)
        yield name, at, length, hashlib.sha256(file.read(length)).hexdigest()
        at += length


def _placed(layout: DataFrame, file_records: int) -> DataFrame:
    """``layout`` with ``place``, the key by which a file's tree holds a record, below ``file_records``.

    It is the id's place in a range of ids; without an id, or in a file below 0, it comes from the
    digest, so that equal records of two replicas meet.
    """
    by_digest = F.conv(F.substring("digest", 9, 8), 16, 10).cast("long")
    key = F.when(F.col("record_id").isNull() | (F.col("file") < 0), by_digest).otherwise(F.col("record_id"))
    return layout.withColumn("place", F.pmod(key, F.lit(file_records)).cast("long"))


def height(fanout: int, file_records: int) -> int:
    """Levels above the places of a file."""
    levels = 0
    while fanout**levels < file_records:
        levels += 1
    return levels


def tree(layout: DataFrame, fanout: int = FANOUT, levels: int | None = None, file_records: int = FILE_RECORDS, keys: tuple[str, ...] = ("file",)) -> list[DataFrame]:
    """The levels of every file's tree, leaves first: file, node, first, last, names, hash.

    A node of the lowest level holds the records of one place, one of the next ``fanout`` places
    and so on. ``first`` and ``last`` bound the offsets that a node covers, ``names`` lists its children
    by offset. There are ``levels`` levels above the lowest one, or as many as it takes for
    every file to have one node. ``keys`` tell files apart, and come first in each level.
    """
    leaf = F.sha2(F.concat_ws("|", F.lit("leaf"), F.coalesce(F.col("record_id").cast("string"), F.lit("")), "length", "copies", "digest"), 256)
    end = F.col("offset") + F.col("length") * F.col("copies")
    name = F.coalesce(F.col("record_id").cast("string"), F.lit(""))
    rows = _placed(layout, file_records).select(*keys, F.col("place").alias("node"), F.col("offset").alias("first"), end.alias("last"), leaf.alias("hash"), name.alias("name"))
    out = [staged(_grouped(rows, keys), "leaves")]
    while len(out) <= levels if levels is not None else out[-1].where("node > 0").limit(1).count():
        rows = out[-1].select(*keys, F.floor(F.col("node") / fanout).alias("node"), "first", "last", "hash", F.col("node").cast("string").alias("name"))
        out.append(staged(_grouped(rows, keys), "nodes"))
    return out


def _grouped(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, node, first, last, names, hash of the children of each node in the order of their offsets."""
    children = F.array_sort(F.collect_list(F.struct("first", "last", "name", "hash")))
    out = rows.groupBy(*keys, "node").agg(F.min("first").alias("first"), F.max("last").alias("last"), children.alias("c"))
    names = F.array_join(F.transform("c", lambda c: c["name"]), ",")
    lines = F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["last"] - c["first"], c["hash"])), "|")
    return out.select(*keys, "node", "first", "last", names.alias("names"), F.sha2(F.concat(F.lit("node|"), names, F.lit("|"), lines), 256).alias("hash"))


def _sides(one: DataFrame, two: DataFrame) -> DataFrame:
    """Both tables, told apart by ``side``."""
    return one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1)))


def _differing(levels: list[DataFrame], fanout: int) -> tuple[DataFrame, DataFrame]:
    """(file, node of the lowest nodes that differ or exist once; file of those with another order somewhere), of levels of both sides."""
    suspects, reordered = None, None
    for level in reversed(levels):
        if suspects is not None:  # Spark broadcasts what it sees to be small
            hint = suspects.select(F.col("file").alias("in_file"), F.col("node").alias("up"))
            level = level.join(hint, (F.col("file") == F.col("in_file")) & (F.floor(F.col("node") / fanout) == F.col("up")), "left_semi")
        of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
        pairs = level.groupBy("file", "node").agg(of(0, "hash").alias("x"), of(1, "hash").alias("y"), of(0, "names").alias("x_names"), of(1, "names").alias("y_names"))
        suspects = staged(pairs.where("not (x <=> y)").select("file", "node", (F.col("x_names") != F.col("y_names")).alias("other_order")), "suspects")
        other = suspects.where("other_order").select("file")
        reordered = other if reordered is None else reordered.unionByName(other)
    return suspects.select("file", "node"), reordered.distinct()


def differing_leaves(one: list[DataFrame], two: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """file, node of the lowest nodes that differ or exist once, found from the roots down; trees of one height."""
    return _differing([_sides(x, y) for x, y in zip(one, two, strict=True)], fanout)[0]


def out_of_place(order: list[int]) -> list[int]:
    """Indexes of the fewest elements of distinct numbers without which the rest ascend (the later ones on a tie)."""
    ends, at, before = [], [], []
    for i, x in enumerate(order):
        k = bisect_left(ends, x)
        ends[k : k + 1], at[k : k + 1] = [x], [i]
        before.append(at[k - 1] if k else -1)
    kept, i = set(), at[-1] if at else -1
    while i >= 0:
        kept.add(i)
        i = before[i]
    return [i for i in range(len(order)) if i not in kept]


def _moved(table: pa.Table) -> pa.Table:
    """file, moved_leaf of the records of one file that stand in another order."""
    table = table.sort_by("leaf")
    found = out_of_place(table.column("other").to_pylist())
    return table.select(["file", "leaf"]).take(pa.array(found, pa.int64())).rename_columns(["moved_file", "moved_leaf"])


def audit(one: DataFrame, two: DataFrame, fanout: int = FANOUT, file_records: int = FILE_RECORDS) -> DataFrame:
    """file, leaf, offset, length, record_id, digest, copies, intact, status, root: a row for each leaf of the first layout.

    ``status`` is ``intact`` if the second replica has the same record at the same place between
    its neighbours, ``damaged`` if it has another one of that id, ``missing`` if none, ``moved`` if
    it has it in another order: of a file's records the fewest are, without which the others
    follow each other as they should. Records that only the second replica has are ``inserted``, with
    their file, id and digest, and null leaf, offset and length. ``root`` is the hash of the file's tree
    in the first replica. Equal layouts, empty ones too, have no differing leaf.
    """
    both = staged(_sides(one.select(*_LAYOUT), two.select(*_LAYOUT)), "replicas")
    levels = tree(both, fanout, height(fanout, file_records), file_records, ("side", "file"))
    bad, reordered = _differing(levels, fanout)
    bad = bad.select(F.col("file").alias("in_file"), F.col("node").alias("in_place"))
    suspects = _placed(both, file_records).join(bad, (F.col("file") == F.col("in_file")) & (F.col("place") == F.col("in_place")), "left_semi")
    record = ["file", "record_id", "digest", "length", "copies"]
    alone = suspects.groupBy(*record).agg(F.min("side").alias("side"), F.max("side").alias("last_side"), F.min("leaf").alias("leaf")).where("side = last_side")
    nth = F.row_number().over(Window.partitionBy("side", "file", "record_id").orderBy("digest", "length", "copies"))
    alone = staged(alone.withColumn("nth", nth).drop("last_side"), "alone")
    # the nth record of an id that only one replica has stands against the nth that only the other has
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    pairs = alone.groupBy("file", "record_id", "nth").agg(of(0, "leaf").alias("leaf"), of(1, "digest").alias("digest"), of(1, "copies").alias("copies"))
    lost = pairs.where("leaf is not null").select(F.col("file").alias("l_file"), F.col("leaf").alias("l_leaf"), F.col("digest").isNull().alias("missing"))
    inserted = pairs.where("leaf is null")

    reordered = staged(reordered.withColumnRenamed("file", "in_file"), "reordered")
    shared = both.join(reordered, F.col("file") == F.col("in_file"), "left_semi").groupBy(*record[:4])
    shared = shared.agg(of(0, "leaf").alias("leaf"), of(1, "leaf").alias("other")).where("leaf is not null and other is not null").select("file", "leaf", "other")
    moved = staged(shared.groupBy("file").applyInArrow(_moved, "moved_file long, moved_leaf long"), "moved")

    roots = levels[-1].where("side = 0").select(F.col("file").alias("r_file"), F.col("hash").alias("root"))
    out = both.where("side = 0").join(roots, F.col("file") == F.col("r_file"), "left")
    out = out.join(lost, (F.col("file") == F.col("l_file")) & (F.col("leaf") == F.col("l_leaf")), "left")
    out = out.join(moved, (F.col("file") == F.col("moved_file")) & (F.col("leaf") == F.col("moved_leaf")), "left")
    status = F.when(F.col("missing"), "missing").when(F.col("l_file").isNotNull(), "damaged").when(F.col("moved_file").isNotNull(), "moved").otherwise("intact")
    out = out.select(*_LAYOUT, (status == "intact").alias("intact"), status.alias("status"), "root")
    none = F.lit(None).cast("long")
    extra = inserted.select("file", none.alias("leaf"), none.alias("offset"), none.alias("length"), "digest", "copies", "record_id", F.lit(False).alias("intact"), F.lit("inserted").alias("status"), F.lit(None).cast("string").alias("root"))
    discard(*levels[:-1])
    return out.unionByName(extra)


_LAYOUT = ("file", "leaf", "offset", "length", "digest", "copies", "record_id")
