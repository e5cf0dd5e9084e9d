"""Quality classifier: an ordinal cumulative-link regression over hashed text.

Ratings are ordered grades. One weight vector over hashed features gives a text's score s,
and ordered thresholds t1 < t2 < ... turn it into tail probabilities
P(grade >= k) = logistic(s - t_k), whose sum is the expected grade. The grades are taken
from ``labels``: 0 poor (quality 0), 1 well formed but toxic, 2 well formed and clean.

Features are the distinct words of the whole text and their first 4, 5 and 6 bytes, which
inflected forms share, hashed to 2**20 cells, and binned shares of its shape: upper case,
symbols, repeated words, distinct words, digits, length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64, SpanHashes, chunks

CELLS = 1 << 20
PREFIXES = (4, 5, 6)
#: Bounds of the sample that the model is fitted on: rows, and cells of all its rows together.
FIT_ROWS = 8_000
FIT_CELLS = 20_000_000
#: A hashed word counts in the fit if as many sampled texts have it, and if the chi-square of
#: its presence against the grades is at least this.
LEAST_TEXTS = 8
LEAST_CHI2 = 30.0
GRADES = 3
#: A text is selected if P(grade >= SELECT_GRADE) is at least SELECT_TAIL.
SELECT_GRADE = 2
SELECT_TAIL = 0.5
STEPS = 300
RATE = 0.03
#: How much more freely a shape cell's weight grows than a word's: short texts have few words.
SHAPE_SCALE = 4.0
DECAY = 2e-4

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 blank, 5 symbol, 6 beyond ASCII
_KIND[[c for c in range(128)]] = 5
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_BINS = 12


def text_features(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct feature cells) of every text; a null one counts as empty."""
    plain = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    raw = [b" ".join(t.translate(_WORDS).split()) for t in plain]
    for lo, hi in chunks(raw):
        joined = np.frombuffer(b" ".join(raw[lo:hi]) + b" ", np.uint8)
        blank = joined == 32
        before = np.concatenate(([True], blank[:-1]))
        starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
        spans = SpanHashes(joined)
        words = spans(starts, ends)
        prefixes = [spans(starts, np.minimum(starts + n, ends)) + U64(n) for n in PREFIXES]
        counts = [t.count(b" ") + 1 if t else 0 for t in raw[lo:hi]]
        at = 0
        for k, n in enumerate(counts):
            own = words[at : at + n]
            distinct, first = np.unique(own, return_index=True)
            shape = _shape(plain[lo + k], own, len(distinct))
            distinct = np.concatenate((distinct, *(p[at + first] for p in prefixes)))
            at += n
            cells = (distinct % U64(CELLS - 256)).astype(np.int64) + 256
            yield lo + k, np.unique(np.concatenate((shape, cells)))


def _shape(raw: bytes, words: np.ndarray, distinct: int) -> np.ndarray:
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7) if raw else np.zeros(7, np.int64)
    letters, n = max(kinds[1] + kinds[2] + kinds[6], 1), len(words)
    repeated = np.count_nonzero(words[1:] == words[:-1]) if n > 1 else 0
    shares = (
        kinds[1] / letters,
        kinds[5] / max(len(raw) - kinds[4], 1),
        repeated / max(n - 1, 1),
        distinct / max(n, 1),
        kinds[3] / max(len(raw) - kinds[4], 1),
        min(np.log2(n + 1) / 16, 1),
        raw.count(b"|") / max(n, 1),
    )
    return np.array([i * (_BINS + 1) + int(np.ceil(min(float(s), 1.0) * _BINS)) for i, s in enumerate(shares)], np.int64)


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, one column each."""
        return 1 / (1 + np.exp(-(scores[:, None] - self.thresholds[None]).clip(-30, 30)))


def useful(of_cell: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Which cells count in the fit, by the texts of every grade that have each and the texts of every grade."""
    n = int(sizes.sum())
    seen, chi2 = of_cell.sum(axis=0), np.zeros(of_cell.shape[1])
    for g, size in enumerate(sizes):
        expected = seen * (max(size, 1) / max(n, 1))
        chi2 += (of_cell[g] - expected) ** 2 / np.maximum(expected, 1e-9)
    used = (seen >= min(least, max(1, n // 20))) & (chi2 >= min(LEAST_CHI2, n / 20))
    used[:256] = True
    return used


def objective(p: np.ndarray, row: np.ndarray, column: np.ndarray, scale: np.ndarray, grades: np.ndarray, importance: np.ndarray, n_grades: int) -> tuple[float, np.ndarray]:
    """Weighted negative log likelihood with weight decay, and its gradient.

    ``p`` holds a weight for each name, the first threshold, and the logarithms of the steps to the
    next ones; (row, column) are the cells of the texts by place.
    """
    n, k, size = len(grades), n_grades - 1, len(scale)
    w, steps = p[:size], np.exp(p[size + 1 :])
    t = p[size] + np.concatenate(([0], np.cumsum(steps)))
    s = np.bincount(row, (w * scale)[column], minlength=n)
    cdf = np.column_stack((np.zeros(n), 1 / (1 + np.exp(-(t[None] - s[:, None]).clip(-30, 30))), np.ones(n)))
    every = np.arange(n)
    mass = np.maximum(cdf[every, grades + 1] - cdf[every, grades], 1e-12)
    slope = cdf * (1 - cdf)
    hi, lo = slope[every, grades + 1], slope[every, grades]
    by_score = importance * (hi - lo) / mass
    by_t = np.zeros(k)
    for j in range(k):
        by_t[j] = -(importance * np.where(grades == j, slope[:, j + 1], np.where(grades == j + 1, -slope[:, j + 1], 0)) / mass).sum()
    g = np.concatenate((np.bincount(column, by_score[row], minlength=size) * scale + DECAY * w, [by_t.sum()], by_t[::-1].cumsum()[::-1][1:] * steps))
    return float(-(importance * np.log(mass)).sum() + DECAY / 2 * (w * w).sum()), g


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, cells: int = CELLS, least: int = LEAST_TEXTS) -> OrdinalModel:
    """Maximum likelihood with weight decay, by full-batch Adam; without rows all tails are 1/2 or less."""
    weights = np.zeros(cells, np.float32)
    if not len(rows):
        return OrdinalModel(weights, np.arange(n_grades - 1, dtype=np.float64))
    sizes = np.array([len(r) for r in rows])
    column, row = np.concatenate(rows).astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    of_cell = np.stack([np.bincount(column[(grades == g)[row]], minlength=cells) for g in range(n_grades)])
    used = useful(of_cell, np.bincount(grades, minlength=n_grades), least)
    keep = used[column]
    column, row = column[keep], row[keep]
    del keep, of_cell
    names, column = np.unique(column, return_inverse=True)
    scale = np.where(names < 256, SHAPE_SCALE, 1.0)
    n, k = len(rows), n_grades - 1
    above = [np.clip((grades >= j + 1).mean(), 1e-3, 1 - 1e-3) for j in range(k)]
    t = -np.log(np.array(above) / (1 - np.array(above)))
    p = np.concatenate((np.zeros(len(names)), [t[0]], np.log(np.maximum(np.diff(t), 0.05))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    balance = n / (n_grades * np.maximum(np.bincount(grades, minlength=n_grades), 1))
    importance = np.sqrt(balance)[grades]
    importance /= importance.sum()
    for step in range(1, STEPS + 1):
        _, g = objective(p, row, column, scale, grades, importance, n_grades)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weights[names] = p[: len(names)] * scale
    return OrdinalModel(weights, p[len(names)] + np.concatenate(([0], np.cumsum(np.exp(p[len(names) + 1 :])))))


def _featured(batches: Iterator[pa.RecordBatch]):
    for batch in common.sliced(batches):
        cells = [c.astype(np.int32) for _, c in text_features(common.column(batch, "text"))]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(cells, pa.list_(pa.int32()))], names=["grade", "h", "cells"])


def _pruned(used: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            values, at = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            keep = used[values]
            before = np.concatenate(([0], np.cumsum(keep)))
            cells = pa.ListArray.from_arrays(pa.array(before[at] - before[at[0]], pa.int32()), pa.array(values[at[0] : at[-1]][keep[at[0] : at[-1]]], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], names=["grade", "h", "cells"])

    return run


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of (doc_id, quality, toxic); rows without id or quality are left out.

    A null ``toxic`` counts as 0; of several rows of one id the lowest grade counts.
    """
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) != 0, 1).otherwise(2)
    rows = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    return rows.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def learn(docs: DataFrame, grades: DataFrame, fit_rows: int = FIT_ROWS, fit_cells: int = FIT_CELLS) -> OrdinalModel:
    """Fits on about ``fit_rows`` labelled rows, chosen by a hash of their ids.

    If their texts are so long that they have more than ``fit_cells`` features together, fewer
    rows are taken. The driver gets the counts of at most CELLS cells, and of the rows only the cells that
    count in the fit.
    """
    n = grades.count()
    drawn = grades.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / max(n, 1))) + 1)
    # at most fit_rows rows and a few in a thousand more: bounded by the parameter
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "grade", F.xxhash64("doc_id", F.lit("fit")).alias("h"))
    rows = common.staged(rows.mapInArrow(_featured, "grade int, h long, cells array<int>"), "features")
    total = rows.agg(F.sum(F.size("cells"))).first()[0] or 0
    if total > fit_cells:
        rows = rows.where(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * fit_cells / total))
    sizes = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    counts = rows.select("grade", F.explode("cells").alias("cell")).groupBy("cell").agg(*[F.count_if(F.col("grade") == g).alias(f"g{g}") for g in range(GRADES)]).toArrow()
    of_cell = np.zeros((GRADES, CELLS))
    for g in range(GRADES):
        of_cell[g, counts.column("cell").to_numpy()] = counts.column(f"g{g}").to_numpy()
    used = useful(of_cell, np.array([sizes.get(g, 0) for g in range(GRADES)]), LEAST_TEXTS)
    found = rows.mapInArrow(_pruned(used), "grade int, h long, cells array<int>").toArrow()
    parts = []
    for chunk in found.column("cells").chunks:
        values, at = np.asarray(chunk.values), np.asarray(chunk.offsets)
        parts += [values[a:b] for a, b in zip(at, at[1:], strict=False)]
    return fit(parts, np.asarray(found.column("grade")).astype(np.int64))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        for batch in common.sliced(batches):
            scores = np.array([model.weights[c].sum(dtype=np.float64) for _, c in text_features(common.column(batch, "text"))])
            tails = model.tails(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], names=["doc_id", "score", "expected_grade", "tails"])

    return run


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_rows: int = FIT_ROWS,
    select_grade: int = SELECT_GRADE,
    select_tail: float = SELECT_TAIL,
) -> DataFrame:
    """doc_id, score, expected_grade, tails, p_select, kept: one row for each row of ``docs``.

    ``tails[k]`` is P(grade >= k + 1). A null or empty text is scored by its shape alone. Null
    ids and repeated rows are scored as they are; without a labelled text the weights are zero
    and nothing is selected. An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, graded(labels), fit_rows))
    out = docs.mapInArrow(_scorer(shared), "doc_id long, score double, expected_grade double, tails array<double>")
    tail = F.col("tails")[select_grade - 1]
    return out.select("*", tail.alias("p_select"), (tail >= select_tail).alias("kept"))


def select_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns and no join.

    Each row is judged by its own text, so repeated rows and rows without id stay or go alike; a null
    text counts as empty. Without a labelled text none stays; an empty table gives an empty one.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(named, graded(labels), fit_rows))

    def run(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        for batch in common.sliced(batches):
            scores = np.array([model.weights[c].sum(dtype=np.float64) for _, c in text_features(common.column(batch, text_col))])
            yield batch.filter(pa.array(model.tails(scores)[:, SELECT_GRADE - 1] >= SELECT_TAIL, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
