"""Language identification with error-correcting output codes.

Each language gets a codeword, a row of a Hadamard matrix without its constant column, so
any two codewords differ in half of their bits. One linear classifier over hashed byte
n-grams predicts each bit. A text goes to the codeword with the smallest weighted loss:
the loss of a bit is exponential in its margin, and its weight is the log odds of that
bit's classifier on rows kept out of its fit. A small gap between the two nearest codewords
flags the text as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Hashed n-gram cells; n-gram lengths in bytes.
CELLS = 1 << 13
LENGTHS = (1, 2, 3)
#: Bound of the sample that the classifiers are fitted on: rows of one language, and of all together
#: (of which a language gets an equal part, one row at least).
ROWS_PER_LANGUAGE = 500
FIT_ROWS = 6_000
RIDGE = 0.02
#: A text is ambiguous if its best codeword's probability is lower.
CERTAIN = 0.6
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_ONLY_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def ngram_features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams of the lower-cased letters, as float32."""
    body = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_ONLY_LETTERS).split())
    data = np.frombuffer(b" " + body + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(CELLS, np.int64)
    for lo in range(0, len(data), common.CHUNK_BYTES):
        part = data[lo : lo + common.CHUNK_BYTES + max(LENGTHS) - 1]
        code = np.zeros(len(part), np.uint32)
        for k in range(max(LENGTHS)):
            code = code[: len(part) - k] * np.uint32(257) + part[k:] + np.uint32(1)
            if k + 1 in LENGTHS:
                own = code[: common.CHUNK_BYTES]
                counts += np.bincount((own * np.uint32(2654435769)) >> np.uint32(32 - CELLS.bit_length() + 1), minlength=CELLS)
    total = counts.sum()
    return np.sqrt(counts / max(total, 1), dtype=np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1 at distance half their length; the length is a power of two less one."""
    order = 8
    while order < n:
        order *= 2
    rows, columns = np.arange(order)[:, None], np.arange(1, order)[None, :]
    return 1 - 2 * (np.bitwise_count(rows & columns) % 2).astype(np.float32)[:n]


class CodeModel:
    """Languages, their codewords, one linear classifier for each bit, and the bits' weights."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.weights, self.bias, self.trust = languages, weights, bias, trust
        self.codes = codewords(len(languages))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its probability, ambiguous) of each row of features."""
        margin = np.clip(x @ self.weights + self.bias, -3, 3)
        loss = np.exp(-margin[:, None, :] * self.codes[None]) @ self.trust
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 8)
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        score = p[np.arange(len(x)), best]
        return best, score, score < CERTAIN


def fit(x: np.ndarray, labels: list[str]) -> CodeModel | None:
    """Ridge classifiers on +1 / -1 bits of rows of features; every fifth row only weighs the bits. None without rows."""
    if not len(x):
        return None
    languages = sorted(set(labels))
    codes = codewords(len(languages))
    y = codes[np.searchsorted(languages, labels)]
    aside = np.arange(len(x)) % 5 == 4
    if len(x) < 10 * len(languages):  # too few to spare any
        aside[:] = False
    a, b = x[~aside], y[~aside]
    mean = a.mean(axis=0)
    a = a - mean
    dual = np.linalg.solve(a @ a.T + np.float32(RIDGE) * np.eye(len(a), dtype=np.float32), b - b.mean(axis=0))
    weights = (a.T @ dual).astype(np.float32)
    bias = (b.mean(axis=0) - mean @ weights).astype(np.float32)
    if aside.any():
        wrong = ((x[aside] @ weights + bias) * y[aside] <= 0).mean(axis=0)
        trust = np.log((1 - wrong + 1e-3) / (wrong + 1e-3)).clip(0.05, None)
    else:
        trust = np.ones(y.shape[1])
    return CodeModel(languages, weights, bias, (trust / trust.sum()).astype(np.float32))


def _featured(batches: Iterator[pa.RecordBatch]):
    """The features of texts with a letter, as their non-zero cells and values."""
    for batch in common.sliced(batches, 256):
        texts = common.column(batch, "text")
        rows = np.array([i for i, t in enumerate(texts) if has_letter(t)], np.int64)
        found = [ngram_features(texts[i]) for i in rows]
        cells = [np.flatnonzero(x).astype(np.int16) for x in found]
        values = [x[c] for x, c in zip(found, cells, strict=True)]
        kept = batch.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([kept.column(1), kept.column(2), pa.array(cells, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32()))], names=["lang", "h", "cells", "values"])


def learn(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, fit_rows: int = FIT_ROWS) -> CodeModel | None:
    """Fits on a hash-chosen sample of (doc_id, text, lang), about ``rows_per_language`` of each language.

    Every language is learned. With more of them than fit_rows / rows_per_language each one's part is
    the smaller. The driver gets features of at most CELLS cells a row and the languages' names, no text.
    """
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    most = max(1, min(rows_per_language, fit_rows // len(sizes)))
    # draws a half more than is wanted and then cuts, so that a rare language is not missed by chance
    share = docs.sparkSession.createDataFrame([(k, min(1.0, (1.5 * most + 10) / n)) for k, n in sizes.items()], "of_lang string, share double")
    rows = docs.join(F.broadcast(share), F.col("lang") == F.col("of_lang")).where(F.pmod(F.xxhash64("doc_id", "text", F.lit("lang")), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text", F.lit("order")), "text"))  # of few rows
    rows = rows.withColumn("place", place).where(F.col("place") <= most).select("text", "lang", F.xxhash64("doc_id", "text", F.lit("order")).alias("h"))
    found = rows.mapInArrow(_featured, "lang string, h long, cells array<smallint>, values array<float>").toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    x = np.zeros((found.num_rows, CELLS), np.float32)
    for i, (c, v) in enumerate(zip(found.column("cells"), found.column("values"), strict=True)):
        x[i, c.values.to_numpy()] = v.values.to_numpy()
    return fit(x, found.column("lang").to_pylist())


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]):
        model = shared.value
        for batch in common.sliced(batches):
            texts = common.column(batch, "text")
            langs, scores, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            for lo in range(0, len(known), 256):
                part = known[lo : lo + 256]
                for i, k, s, u in zip(part, *model.decode(np.stack([ngram_features(texts[i]) for i in part])), strict=True):
                    langs[i], scores[i], unsure[i] = model.languages[k], float(s), bool(u)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"]
            )

    return run


def predict(docs: DataFrame, model: CodeModel | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of (doc_id, text).

    A null text or one without a letter is ``und`` with a score of 0 and ambiguous, and so is
    every text if there was no labelled row to learn from. Ties go to the first language by
    name. Null ids and repeated rows are returned as they are; an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predictor(shared), "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learns from the rows that are not held out.

    A row is held out if crc32 of its id as text is divisible by ``folds``; a row without id is
    neither held out nor learned from.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % folds == 0
    model = learn(docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
