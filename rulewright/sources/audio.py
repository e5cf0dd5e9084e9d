"""PCM WAV files as tables of clips, and clips as files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

CLIP = "path string, sr int, samples array<float>"


def decode(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples in [-1, 1]) of PCM with 8, 16 or 32 bits; channels are averaged."""
    with wave.open(io.BytesIO(raw)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(w.getnframes())
    kinds = {1: ("u1", 128, 128), 2: ("<i2", 0, 2**15), 4: ("<i4", 0, 2**31)}
    if width not in kinds:
        raise ValueError(f"{8 * width} bits are not supported")
    kind, zero, peak = kinds[width]
    x = (np.frombuffer(data, kind).astype(np.float64) - zero) / peak
    return rate, x.reshape(-1, channels).mean(1)


def encode(x: np.ndarray, rate: int) -> bytes:
    """A 16-bit mono file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(x, float), -1, 1) * (2**15 - 1)).round().astype("<i2").tobytes())
    return out.getvalue()


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Band-limited resampling by cutting or padding the spectrum."""
    if rate == to or not len(x):
        return x
    n = round(len(x) * to / rate)
    z = np.fft.rfft(x)
    return np.fft.irfft(np.pad(z, (0, max(n // 2 + 1 - len(z), 0)))[: n // 2 + 1], n) * (n / len(x))


def read_audio(spark: SparkSession, path: str, rate: int | None = None, norm: bool = False, pattern: str = "*.wav") -> DataFrame:
    """path, sr, samples of every file below a folder, resampled and scaled to a peak of 1 if asked.

    A file that cannot be decoded has null samples.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for p, raw in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    sr, x = decode(raw.as_py())
                    x = resampled(x, sr, rate) if rate else x
                    sr = rate or sr
                    x = x / (np.abs(x).max(initial=0) or 1.0) if norm else x
                    row = (sr, x.astype(np.float32))
                except (wave.Error, EOFError, ValueError):
                    row = (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([p.as_py()]), pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.list_(pa.float32()))], names=["path", "sr", "samples"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(run, CLIP)


def write_audio(clips: DataFrame, folder: str) -> DataFrame:
    """Writes each clip as folder/<last part of its path>; path, bytes of what was written."""

    def run(batches: Iterator[pa.RecordBatch]):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for p, sr, x in zip(*(batch.column(i) for i in range(3)), strict=True):
                if not x.is_valid:
                    continue
                raw = encode(np.asarray(x.values), sr.as_py())
                name = f"{base}/{p.as_py().rstrip('/').rpartition('/')[2]}"
                with store.open_output_stream(name) as out:
                    out.write(raw)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(raw)], pa.int64())], names=["path", "bytes"])

    return clips.select("path", "sr", "samples").mapInArrow(run, "path string, bytes long")
