"""Media columns: texts as 8-bit sound, packed in archives and read back by a data source.

``write_archives`` stores each payload as an 8-bit mono PCM WAV file, a zstd-compressed
member of an archive in the shared folder. An archive is a sequence of members followed by
the offsets of its byte ranges and a fixed tail:

    member  = b"RWM1" | has_id u8 | id i64 | n_bytes u64 | stored u64 | crc32(stored) u32 | stored bytes
    tail    = offsets of ranges u64... | number of offsets u64 | end of members u64 | b"RWIX"

The data source ``rulewright_media`` lists an archive directory, plans one partition for
each byte range (the tail names them, so the planner reads no member), and streams the
members of a range through Arrow in bounded batches. A member that cannot be read or whose
checksum fails is read again by its own offset, from a newly opened file, before the task
gives up; Spark then retries the range elsewhere.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common

UNIT = 192
SAMPLE_RATE = 16_000
RANGE_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
TRIES = 3
LISTING = "_archives"

_HEAD = "<4sBqQQI"
_TAIL = "<QQ4s"


def payload(text: str | None) -> tuple[int, bytes]:
    """(length of the UTF-8, UTF-8 padded with blanks to a positive multiple of 192)."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def to_wav(samples: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono PCM."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    pad = b"\0" * (len(samples) % 2)
    body = b"WAVE" + form + struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wav(media: bytes) -> tuple[int, bytes]:
    """(sample rate, samples) of an 8-bit mono PCM file; ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            if rate is None or at + 8 + n > len(media):
                raise ValueError("a WAVE file without format or with a short data chunk")
            return rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("a WAVE file without data")


def features(samples: bytes) -> str:
    """Frames, mean, deviation, peak, crossings of the mean, loudest frame of 192 samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    mean = float(x.mean(dtype=np.float64))
    up = x > mean
    frames = x[: len(x) // UNIT * UNIT].reshape(-1, UNIT)
    energy = (frames * frames).mean(axis=1) if len(frames) else np.zeros(1, np.float32)
    values = (mean, float(x.std(dtype=np.float64)), float(np.abs(x).max()), np.count_nonzero(up[1:] != up[:-1]) / max(len(x) - 1, 1), int(energy.argmax()))
    return f"frames={len(frames)};mean={values[0]:.4f};sd={values[1]:.4f};peak={values[2]:.0f};crossings={values[3]:.6f};loudest={values[4]}"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _writer(directory: str):
    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        store, base = _open(directory)
        # a name for each attempt: what an attempt that Spark does not count has left is not listed
        name = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.rwa"
        pack, at, marks, n = zstandard.ZstdCompressor(level=3), 0, [], 0
        with store.open_output_stream(name) as out:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    size, samples = payload(text)
                    stored = pack.compress(to_wav(samples))
                    if not marks or at - marks[-1] >= RANGE_BYTES:
                        marks.append(at)
                    out.write(struct.pack(_HEAD, b"RWM1", key is not None, key or 0, size, len(stored), zlib.crc32(stored)) + stored)
                    at += struct.calcsize(_HEAD) + len(stored)
                    n += 1
            out.write(struct.pack(f"<{len(marks)}Q", *marks) + struct.pack(_TAIL, len(marks), at, b"RWIX"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([n], pa.int64()), pa.array([at], pa.int64()), pa.array([marks], pa.list_(pa.int64()))], names=["archive", "members", "bytes", "marks"]
        )

    return run


def write_archives(docs: DataFrame, directory: str) -> tuple[int, int]:
    """Writes (doc_id, text) rows as archives, one for each partition; (members, bytes).

    The archives of the attempts that counted are named in a listing with the offsets of their
    byte ranges, which readers go by: planning a read opens the listing and no archive.
    """
    store, base = _open(directory)
    store.create_dir(base, recursive=True)
    made = docs.mapInArrow(_writer(directory), "archive string, members long, bytes long, marks array<long>").collect()  # a row for each partition
    with store.open_output_stream(f"{base}/{LISTING}") as out:
        lines = sorted(" ".join(map(str, [*r["marks"], r["bytes"], r["archive"]])) for r in made if r["members"])
        out.write("\n".join(lines).encode())
    return sum(r["members"] for r in made), sum(r["bytes"] for r in made)


class MediaSource(DataSource):
    """Batch reader of archive directories; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "rulewright_media"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary, archive string, offset long, stored_bytes long, stored_crc32 long"

    def reader(self, schema) -> "MediaReader":
        return MediaReader(self.options["path"])


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaReader(DataSourceReader):
    def __init__(self, directory: str):
        self.directory = directory

    def partitions(self) -> list[ByteRange]:
        store, base = _open(self.directory)
        out = []
        if store.get_file_info(f"{base}/{LISTING}").type == fs.FileType.File:
            with store.open_input_file(f"{base}/{LISTING}") as f:
                for line in f.read().decode().splitlines():
                    *marks, archive = line.split(" ", line[: line.index("/")].count(" "))
                    out += [ByteRange(archive, int(a), int(b)) for a, b in zip(marks, marks[1:], strict=False)]
            return out or [ByteRange("", 0, 0)]
        for info in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda i: i.path):  # a folder without a listing
            if info.path.endswith(".rwa"):
                with store.open_input_file(info.path) as f:
                    f.seek(info.size - struct.calcsize(_TAIL))
                    n, end, magic = struct.unpack(_TAIL, f.read(struct.calcsize(_TAIL)))
                    if magic != b"RWIX":
                        raise ValueError(f"{info.path} has no index")
                    f.seek(end)
                    marks = [*struct.unpack(f"<{n}Q", f.read(8 * n)), end]
                out += [ByteRange(info.path, a, b) for a, b in zip(marks, marks[1:], strict=False)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.end == partition.start:
            return
        store, _ = _open(self.directory)
        members, held, rows = MemberReader(store, partition.archive), 0, []
        at = partition.start
        while at < partition.end:
            key, size, media, after, stored, crc = members.member(at)
            rows.append((key, size, media, partition.archive, at, stored, crc))
            held += len(media)
            at = after
            if held >= BATCH_BYTES:
                yield _rows(rows)
                held, rows = 0, []
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "media", "archive", "offset", "stored_bytes", "stored_crc32"])


class MemberReader:
    """Reads members of one archive by offset, each with its own tries."""

    def __init__(self, store: fs.FileSystem, archive: str, tries: int = TRIES, wait_s: float = 0.2):
        self.store, self.archive, self.tries, self.wait_s = store, archive, tries, wait_s
        self.file, self.unpack = None, zstandard.ZstdDecompressor()

    def member(self, offset: int) -> tuple[int | None, int, bytes, int, int, int]:
        """(id, length of the text, WAV bytes, offset of the next member, length and CRC of what is stored)."""
        for k in range(self.tries):
            try:
                return self._read(offset)
            except (OSError, ValueError, zstandard.ZstdError):
                self.file = None  # the next try opens the file again
                if k + 1 == self.tries:
                    raise
                time.sleep(self.wait_s * 2**k)
        raise AssertionError

    def _read(self, offset: int):
        if self.file is None:
            self.file = self.store.open_input_file(self.archive)
        self.file.seek(offset)
        head = self.file.read(struct.calcsize(_HEAD))
        if len(head) < struct.calcsize(_HEAD):
            raise ValueError(f"a short member at {offset} of {self.archive}")
        magic, has_id, key, size, n, crc = struct.unpack(_HEAD, head)
        stored = self.file.read(n) if magic == b"RWM1" else b""
        if magic != b"RWM1" or len(stored) != n or zlib.crc32(stored) != crc:
            raise ValueError(f"a damaged member at {offset} of {self.archive}")
        return (key if has_id else None), size, self.unpack.decompress(stored), offset + struct.calcsize(_HEAD) + n, n, crc


def _described(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        media = [m.as_py() for m in batch.column(2)]
        samples = [from_wav(m)[1] for m in media]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([len(s) for s in samples], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in samples]),
                pa.array([zlib.crc32(s[-16:]) for s in samples], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                pa.array([features(s) for s in samples]),
                batch.column(3),
                batch.column(4),
            ],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stored_bytes", "stored_crc32"],
        )


def read_media(spark: SparkSession, directory: str) -> DataFrame:
    """doc_id, n_bytes, media, archive, offset, stored_bytes, stored_crc32 of every member of an archive directory."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("rulewright_media").option("path", directory).load()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: what its stored media holds and its features.

    The archives go to ``directory``, by default a new one in the shared folder, and stay there
    as the result reads them. ``media_bytes`` and ``media_sha256`` are of the WAV file, the media that a
    reader gets back; ``stored_bytes`` and ``stored_crc32`` are of the zstd frame that it lies in on disk. A null text counts as empty, which gives 192 blanks. Null ids
    and repeated rows are stored and returned as they are; equal texts give equal values. An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    directory = directory or f"{common.shared_dir(spark)}/rulewright/media-{uuid.uuid4().hex}"
    write_archives(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), directory)
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stored_bytes long, stored_crc32 long"
    return read_media(spark, directory).select("doc_id", "n_bytes", "media", "stored_bytes", "stored_crc32").mapInArrow(_described, kinds)
