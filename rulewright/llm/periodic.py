"""Runs (maximal repetitions) of words by Lyndon arrays, after Ellert and Fischer.

For a run of smallest period p take the order of the alphabet, or its reverse, in which the word
behind the run is smaller than the word p places before it. In that order a rotation of the period
is a Lyndon word, and at each place i of the run where it starts the next smaller suffix is at
i + p. So the edges (i, next smaller suffix of i) of the two orders hold all runs, and a run is
found by extending an edge's match to both sides. Only the order and equality of words are used:
no suffix array, no hashes of spans.

The next smaller suffixes of a whole batch of texts are worked out together. The candidate of i
starts at i + 1; while the suffix there is greater, the candidate becomes that suffix's own
candidate, for whatever lies between is greater still. Most candidates are settled by their first
word. Where words are equal the match is extended, and pairs of one distance share the extension:
a match of (i, i + d) that reaches the start of one already matched at distance d ends where that one
ends. A text of one repeated word therefore costs a few passes over it and not its square.

The alphabet is ordered by how often a word occurs in the batch, rare ones first, which settles
most comparisons at once; the runs do not depend on the order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Runs count from this many words and this many periods on.
LEAST_LENGTH = 6
LEAST_PERIODS = 4
#: Bytes of text worked out together, about; a longer text is worked out by itself.
BATCH_BYTES = 1 << 21
#: Words of two suffixes compared for all pairs at once before matches are extended by distance.
STEPS = 8

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def ranked(values: np.ndarray) -> np.ndarray:
    """Codes from 1 on for values, rare ones first."""
    counts = np.bincount(values)
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(1, len(counts) + 1)
    return rank[values]


def _first_difference(x: np.ndarray, i: int, j: int, most: int) -> int:
    """How many symbols from i and j on are equal, ``most`` at most."""
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        unequal = np.flatnonzero(x[i + done : i + done + step] != x[j + done : j + done + step])
        if len(unequal):
            return done + int(unequal[0])
        done += step
        step *= 4
    return most


def _extended(x: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Lengths of the matches of the suffixes at ``at`` and ``to``; pairs of one distance share them."""
    out = np.empty(len(at), np.int64)
    order = np.lexsort((at, to - at))
    distance = (to - at)[order]
    cuts = np.flatnonzero(np.diff(distance, prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
        group, d = order[lo:hi], int(distance[lo])
        own = at[group]
        last = int(own[-1])
        end = last + _first_difference(x, last, last + d, len(x) - last - d)
        if hi - lo > 8 and end - own[0] <= 64 * (hi - lo):  # close together: where the distance mismatches
            unequal = np.append(np.flatnonzero(x[own[0] : end] != x[own[0] + d : end + d]) + own[0], end)
            out[group] = unequal[np.searchsorted(unequal, own)] - own
            continue
        out[group[-1]] = end - last
        begin = last
        for k in range(hi - lo - 2, -1, -1):
            i = int(own[k])
            length = _first_difference(x, i, i + d, begin - i)
            if i + length < begin:
                end = i + length
            begin = i
            out[group[k]] = end - i
    return out


def next_smaller_suffixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the next smaller suffix and the length of its match with the place's own suffix.

    ``x`` begins and ends with 0, which is smaller than all symbols and stands between texts; a
    suffix ends there.
    """
    nss = np.arange(1, len(x) + 1)
    match = np.zeros(len(x), np.int64)
    active = np.flatnonzero(x)
    while len(active):
        to = nss[active]
        own, other = x[active], x[to]
        again = [active[other > own]]
        same = other == own
        at, to = active[same], to[same]
        for k in range(1, STEPS + 1):
            if not len(at):
                break
            own, other = x[at + k], x[to + k]
            smaller = other < own
            match[at[smaller]] = k
            again.append(at[other > own])
            same = other == own
            at, to = at[same], to[same]
        if len(at):
            length = _extended(x, at, to)
            smaller = x[to + length] < x[at + length]
            match[at[smaller]] = length[smaller]
            again.append(at[~smaller])
        active = np.concatenate(again)
        nss[active] = nss[nss[active]]
    return nss, match


def runs(x: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs in ``x`` (see ``next_smaller_suffixes``), by start and period."""
    found = []
    for symbols in (x, np.where(x > 0, x.max(initial=0) + 1 - x, 0)):
        nss, match = next_smaller_suffixes(symbols)
        period = nss - np.arange(len(x))
        # a run of four periods has a Lyndon root in its first period, whose match is longer than two
        at = np.flatnonzero(match >= (LEAST_PERIODS - 2) * period)
        at = at[x[at] > 0]
        p, end = period[at], (nss + match)[at]
        order = np.lexsort((at, end, p))
        at, p, end = at[order], p[order], end[order]
        first = np.flatnonzero((np.diff(p, prepend=-1) != 0) | (np.diff(end, prepend=-1) != 0))
        for i, q, e in zip(at[first].tolist(), p[first].tolist(), end[first].tolist(), strict=True):
            while True:  # to the left, a period at a time: the root before this one would have been found
                lo = max(i - q, 0)
                unequal = np.flatnonzero(x[lo:i] != x[lo + q : i + q])
                if len(unequal):
                    i = lo + int(unequal[-1]) + 1
                    break
                i = lo
            if e - i >= max(LEAST_LENGTH, LEAST_PERIODS * q):
                found.append((i, e - i, q))
    out = np.array(sorted(set(found)), np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places that stand for the words of a text with a planted repetition; None where there is none."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


class Words:
    """The words of the texts of an Arrow array, as codes of the array's words."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.ends = offsets - offsets[0]
        white = _WHITE[self.data]
        begins = ~white
        begins[1:] &= white[:-1]
        edges = self.ends[:-1][np.diff(self.ends) > 0]
        begins[edges] = ~white[edges]
        starts = np.flatnonzero(begins)
        self.bounds = np.searchsorted(starts, self.ends)
        solid = self.data[~white]
        before = np.cumsum(~white)
        lengths = np.diff(np.append(before[starts] - 1, len(solid)))
        ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(solid))])
        self.codes = np.asarray(words.dictionary_encode().indices) if len(starts) else np.empty(0, np.int32)

    def of(self, k: int) -> list[bytes]:
        return self.data[self.ends[k] : self.ends[k + 1]].tobytes().split()


def _row(words: list[bytes], places: np.ndarray | None, own: np.ndarray) -> tuple:
    """Number of runs, the best one, and both digests, of a text with the runs ``own``."""
    listed = own.tolist()
    best = None
    for s, n, q in listed:  # ordered by start and period, so the first of equal exponents stays
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    kept = words if places is None else [words[i] for i in places.tolist()]
    if listed:
        change = np.zeros(len(kept) + 1, np.int64)
        np.add.at(change, own[:, 0] + own[:, 2], 1)
        np.add.at(change, own[:, 0] + own[:, 1], -1)
        kept = [kept[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    text = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
    start, length, period = best or (None, None, None)
    return len(listed), start, length, period, 1000 * length // period if best else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


_COLUMNS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def text_runs(ids: list[int | None], texts: pa.Array, plant: bool) -> Iterator[tuple[tuple, np.ndarray]]:
    """The result and the runs (start, length, period) of every text of an array."""
    words = Words(texts)
    moved = [planted(i, int(n)) if plant else None for i, n in zip(ids, np.diff(words.bounds), strict=True)]
    codes = ranked(words.codes) if len(words.codes) else words.codes
    parts = [np.zeros(1, np.int32)]
    for k, places in enumerate(moved):
        own = codes[words.bounds[k] : words.bounds[k + 1]]
        parts += [own if places is None else own[places], np.zeros(1, np.int32)]
    found = runs(np.concatenate(parts))
    firsts = words.bounds[:-1] + np.arange(1, len(texts) + 1)
    cuts = np.searchsorted(found[:, 0], np.append(firsts, np.iinfo(np.int64).max))
    for k, places in enumerate(moved):
        own = found[cuts[k] : cuts[k + 1]] - [firsts[k], 0, 0]
        yield _row(words.of(k), places, own), own


def _detect(plant: bool, listed: bool):
    kinds = dict(_COLUMNS)
    if listed:
        kinds["runs"] = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            for lo, hi in _ranges(sizes):
                rows = []
                for row, own in text_runs(ids[lo:hi], texts.slice(lo, hi - lo), plant):
                    rows.append((*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()]) if listed else row)
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *arrays], names=["doc_id", *kinds])

    return run


def _ranges(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > BATCH_BYTES:
            yield lo, i
            lo, held = i, 0
        held += n + 1
    if lo < len(sizes):
        yield lo, len(sizes)


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, listed: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256: one row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0. A run is a stretch of
    words of smallest period q, of LEAST_LENGTH words and LEAST_PERIODS periods at least, that no
    neighbouring word extends. start, length and period are those of the run with the greatest
    length / period (of equal ones the smallest start, then period) and null without a run;
    runs_sha256 is of all runs, ``start,length,period`` and a line feed each, and collapsed_sha256 of the words
    that no run holds behind its first period, joined by a blank. With ``listed`` the runs follow
    as an array ``runs``.

    With ``plant`` a tenth of the texts are read as ``planted`` says, by the CRC of the id; rows
    without id never are. A null text has no word, and no run. Repeated rows are
    treated alike, an empty table gives an empty result, and other columns are not read. Each text
    is worked out by itself, so nothing is shuffled.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    more = ", runs array<struct<start:long,length:long,period:long>>" if listed else ""
    return docs.mapInArrow(_detect(plant, listed), _SCHEMA + more)
