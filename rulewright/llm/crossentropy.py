"""Cross-entropy difference of two matched n-gram models.

The target model counts the texts of a target set, the background model all others. Both
have the same vocabulary (the words of the whole corpus), the same order and the same
smoothing, so their losses on a token differ only through their counts:

    p(w | u) = b * (c(u w) + p1(w)) / (c(u) + 1) + (1 - b) * p1(w),   p1(w) = (c(w) + a) / (N + a V)

A document's score is the mean over its tokens of the target loss less the background loss;
below zero means closer to the target.

Counting covers every token of every text, and every word and bigram has counts of its own.
Rows are dealt into blocks of about ``BLOCK_CHARS`` characters by a hash of the row; a row that is repeated
often goes there once, with its number. A block
sends its distinct words and bigrams with their counts, sorted and packed, to parts of the range
of keys; a part adds up what all blocks sent and answers each with the totals of its own keys in
the same order, which is all that a block needs to score its texts. So what is gathered grows
with the corpus, and no task and no broadcast holds a model.

Words and bigrams are told apart by 64-bit hashes: two different ones among n are confused with
a probability of about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64, SpanHashes, chunks, lowered_ascii, mixed

#: The vocabulary counts as at least so many words where ``score`` is not told otherwise.
UNI = 1 << 17
#: Characters of text in a block, about.
BLOCK_CHARS = 1 << 23
#: Tokens whose losses are worked out together, about.
RUN_TOKENS = 1 << 17
#: Stands before the first word of a text.
START = 0
SMOOTH = 0.1
BIGRAM = 0.7


def cell_texts(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, word hashes, bigram hashes) of every text; a text's first word follows a start mark."""
    raw = [b" ".join(lowered_ascii(t).split()) if t else b"" for t in texts]
    for lo, hi in chunks(raw):
        joined = np.frombuffer(b" ".join(raw[lo:hi]) + b" ", np.uint8)
        blank = joined == 32
        before = np.concatenate(([True], blank[:-1]))
        words = SpanHashes(joined)(np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before))
        at = 0
        for k in range(lo, hi):
            n = raw[k].count(b" ") + 1 if raw[k] else 0
            own = words[at : at + n]
            at += n
            last = np.concatenate((np.full(min(n, 1), START, U64), own[:-1]))
            yield k, own.view(np.int64), mixed(mixed(last + U64(1)) + own).view(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, so that bytes that are mostly zero cost next to nothing."""
    planes = np.ascontiguousarray(values.astype(U64).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(U64)


def _tokens(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of every row of a table, and the words and bigrams of all one after another."""
    sizes, words, pairs = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in common.sliced(iter(texts.select(["text"]).to_batches())):
        for _, own, pair in cell_texts(common.column(batch, "text")):
            sizes.append(len(own))
            words.append(own)
            pairs.append(pair)
    return np.array(sizes, np.int64), np.concatenate(words).view(U64), np.concatenate(pairs).view(U64)


def _sums(keys: np.ndarray, target: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of every key among them, and both sums by key."""
    found, code = np.unique(keys, return_inverse=True)
    # sums in doubles are exact below 2**53
    return found, code, *(np.bincount(code, x, len(found)).astype(np.int64) for x in (target, background))


def _sides(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of the target and of the background each row of a table stands for."""
    target, n = np.asarray(texts.column("is_target"), bool), np.asarray(texts.column("n"), np.int64)
    return np.where(target, n, 0), np.where(target, 0, n)


def _vocabulary(batches: Iterator[pa.RecordBatch]):
    """word, target, background; the row without word counts the texts that have one."""
    for batch in batches:
        sizes, words, _ = _tokens(pa.Table.from_batches([batch]))
        sides = _sides(pa.Table.from_batches([batch]))
        found, _, t, b = _sums(words, *(np.repeat(n, sizes) for n in sides))
        starts = [int(n[sizes > 0].sum()) for n in sides]
        yield pa.RecordBatch.from_arrays([pa.array([*found.view(np.int64).tolist(), None], pa.int64()), pa.array([*t.tolist(), starts[0]]), pa.array([*b.tolist(), starts[1]])], names=["word", "target", "background"])


def _asked(parts: int):
    """kind, part, block, keys, target, background: the counts of a block, packed by parts of the key range."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sizes, words, pairs = _tokens(table)
        weights = [np.repeat(n, sizes) for n in _sides(table)]
        rows = []
        for kind, values in enumerate((words, pairs)):
            found, _, *sides = _sums(values, *weights)
            part = ((found >> U64(32)) * U64(parts)) >> U64(32)
            first = np.flatnonzero(np.concatenate((np.ones(min(len(part), 1), bool), part[1:] != part[:-1])))
            for lo, hi in zip(first, [*first[1:], len(part)], strict=True):
                keys = np.concatenate((found[lo : lo + 1], np.diff(found[lo:hi])))
                rows.append((kind, int(part[lo]), key[0].as_py(), _packed(keys), *(_packed(x[lo:hi]) for x in sides)))
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ASKED, strict=True)], schema=_ASKED)

    return run


def _answered(table: pa.Table) -> pa.Table:
    """The totals over all blocks, for each block in the order of its keys."""
    keys, *sides = ([_unpacked(x) for x in table.column(c).to_pylist()] for c in ("keys", "target", "background"))
    _, code, *totals = _sums(np.concatenate([np.cumsum(k, dtype=U64) for k in keys]), *(np.concatenate(x) for x in sides))
    ends = np.cumsum([len(k) for k in keys])
    packed = [[_packed(x[code[hi - len(k) : hi]]) for k, hi in zip(keys, ends, strict=True)] for x in totals]
    return pa.table([table.column("kind"), table.column("part"), table.column("block"), *(pa.array(x, pa.binary()) for x in packed)], schema=_ANSWERED)


_ASKED = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("target", pa.binary()), ("background", pa.binary())])
_ANSWERED = _ASKED.remove(3)
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((c, pa.float64()) for c in ("target_loss", "background_loss", "difference")), ("row", pa.int64())])


def _runs_of_texts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about RUN_TOKENS tokens each."""
    lo = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > RUN_TOKENS:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _own_counts(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """How often the key of each token stands in the token's own text."""
    if not len(code):
        return np.zeros(0)
    _, place, counts = np.unique(row * np.int64(code.max() + 1) + code, return_inverse=True, return_counts=True)
    return counts[place].astype(np.float64)


def _scored(totals: tuple[int, int], starts: tuple[int, int], vocabulary: int, own_counts: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """The rows of a block by the counts of its words and bigrams."""
        sizes, words, pairs = _tokens(docs)
        (_, word), (_, pair) = (np.unique(x, return_inverse=True) for x in (words, pairs))
        has = sizes > 0
        order = sorted(range(answers.num_rows), key=answers.column("part").to_pylist().__getitem__)
        kinds = answers.column("kind").to_pylist()
        of_target = np.asarray(docs.column("is_target"), bool)
        ends = np.cumsum(sizes)
        losses = [np.zeros(len(sizes)), np.zeros(len(sizes))]
        for side, name in enumerate(("target", "background")):
            packed = answers.column(name).to_pylist()
            uni, bi = (np.concatenate([np.empty(0, U64), *(_unpacked(packed[i]) for i in order if kinds[i] == kind)]).astype(np.float64) for kind in (0, 1))
            for lo, hi in _runs_of_texts(sizes):
                a, b = ends[lo] - sizes[lo], ends[hi - 1]
                own, own_has = sizes[lo:hi], has[lo:hi]
                first = (np.cumsum(own) - own)[own_has]
                count, both, total, begun = uni[word[a:b]], bi[pair[a:b]], float(totals[side]), np.full(len(first), float(starts[side]))
                if not own_counts:  # a text is no evidence for itself
                    row = np.repeat(np.arange(hi - lo), own)
                    mine = (of_target[lo:hi] == (side == 0))[row].astype(np.float64)
                    count, both = count - mine * _own_counts(row, word[a:b]), both - mine * _own_counts(row, pair[a:b])
                    total, begun = total - mine * own[row], begun - mine[first]
                p1 = (count + SMOOTH) / (total + SMOOTH * vocabulary)
                context = np.concatenate((count[:0], [0.0], count[:-1]))[: len(count)]
                context[first] = begun
                loss = -np.log2(BIGRAM * (both + p1) / (context + 1) + (1 - BIGRAM) * p1)
                if len(first):
                    losses[side][lo:hi][own_has] = np.add.reduceat(loss, first) / own[own_has]
        values = [pa.array(x, pa.float64(), mask=~has) for x in (*losses, losses[0] - losses[1])]
        return pa.table([docs.column("doc_id").combine_chunks(), pa.array(sizes), *values, docs.column("row").combine_chunks()], schema=_SCORES)

    return run


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_vocabulary: int = UNI, own_counts: bool = True) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference: one row for each row of ``docs``.

    ``targets`` holds the ids (doc_id) of the target set; null and repeated ids in it do not
    matter, and without any the target model is smoothing alone. Words are
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. V is the number of distinct words of ``docs``, or
    ``least_vocabulary`` if that is more. Without ``own_counts`` a text's own words and bigrams are
    taken off the counts of its side before it is scored, so that no text is evidence for itself. A null or empty text has no token and null losses. Null
    ids count for the background and are scored. An empty table gives an empty result; other
    columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = targets.select(F.col("doc_id").cast("long").alias("target_id")).where("target_id is not null").distinct()
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = chars // BLOCK_CHARS + 1
    hot = _repeated(docs, chars)
    flagged = common.marked(docs, ids, "doc_id", "is_target")
    one, none = F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("row")
    once = flagged.select("*", one, none) if hot is None else _collapsed(flagged, hot, one, none)
    marked = once.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("block"), "doc_id", "text", "is_target", "n", "row")
    sums = [F.sum(c).alias(c) for c in ("target", "background")]
    words = marked.select("text", "is_target", "n").mapInArrow(_vocabulary, "word long, target long, background long").groupBy("word").agg(*sums)
    whole = {r["is_word"]: r for r in words.groupBy(F.col("word").isNotNull().alias("is_word")).agg(F.count("*").alias("v"), *sums).collect()}
    totals, starts = ((whole[k]["target"], whole[k]["background"]) if k in whole else (0, 0) for k in (True, False))
    vocabulary = max(whole[True]["v"] if True in whole else 0, least_vocabulary)

    asked = marked.groupBy("block").applyInArrow(_asked(parts), "kind int, part long, block long, keys binary, target binary, background binary")
    answers = asked.groupBy("kind", "part").applyInArrow(_answered, "kind int, part long, block long, target binary, background binary")
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double, row long"
    scored = marked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(totals, starts, vocabulary, own_counts), schema)
    # one job, in which the blocks' exchange is made once; what is written is a few numbers a row
    scored = common.staged(scored, "scores")
    if hot is None:
        return scored.drop("row")
    found = F.broadcast(scored.where("row is not null").withColumnRenamed("doc_id", "of_id"))
    many = docs.join(found, (F.xxhash64("doc_id", "text") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
    return scored.where("row is null").drop("row").unionByName(many.select("doc_id", *[f.name for f in _SCORES][1:-1]))


def _repeated(docs: DataFrame, chars: int) -> DataFrame | None:
    """Keys of rows that are repeated to such a length that a block should not get them one by one: BROADCAST_ROWS at most."""
    rows = docs.groupBy(F.xxhash64("doc_id", "text").alias("hot")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    found = common.staged(rows.where((F.col("n") > 1) & (F.col("chars") >= max(chars // common.BROADCAST_ROWS, BLOCK_CHARS // 8))).select("hot"), "repeated")
    return None if found.isEmpty() else found


def _collapsed(flagged: DataFrame, hot: DataFrame, one, none) -> DataFrame:
    """Rows with their number ``n``: those of ``hot`` once for each id and text, with their key, the others as they are."""
    match = F.xxhash64("doc_id", "text") == F.col("hot")
    few = flagged.join(F.broadcast(hot), match, "left_semi").groupBy("doc_id", "text", "is_target").agg(F.count("*").alias("n")).withColumn("row", F.xxhash64("doc_id", "text"))
    return few.unionByName(flagged.join(F.broadcast(hot), match, "left_anti").select("*", one, none))
