"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

A text is the symbol sequence of a leading blank mark and its characters, blanks replaced by
the mark. Edges of the lattice are the model's pieces; a character that is no piece is an
edge at the lowest score less UNKNOWN_PENALTY and is written as its UTF-8 bytes. The N best
paths are found by A-star from the end of the lattice backwards, with the forward Viterbi
score of a node as heuristic; as that score is exact, paths are popped in order of score.

Two facts keep whole texts cheap. Between two characters that no piece has side by side every
path has a node, so the lattice falls apart into short segments, which are worked out once for
each distinct segment (by a 64-bit hash: two different ones among n are confused with a
probability of about n**2 / 2**65) of a block of texts, by a Viterbi pass over all of them at once that
keeps the best and second-best score. And the N best paths of a text differ from the best one only in
the N - 1 segments with the smallest gaps between those two, so only those need the search.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .common import U64, SpanHashes

MARK = 0x2581
#: A mark that stands in the text itself; not a character, so never part of a piece.
LITERAL_MARK = 0x110000 + MARK
UNKNOWN_PENALTY = 10.0
#: Scores below this one mark pieces of blanks in the model file; they count as the lowest proper score.
LEAST_SCORE = -1e8
#: Segments of up to this many characters are worked out together.
VECTOR_LENGTH = 24
#: Characters of text worked out together, about.
BLOCK_CHARS = 1 << 18
NBEST = 4

_TABLE_BITS = 19


def load_vocabulary(path: str) -> "Vocabulary":
    """Pieces and scores of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Vocabulary([model.id_to_piece(i) for i in range(n)], {i: model.get_score(i) for i in plain}, byte_ids)


class Vocabulary:
    """Pieces by id, scores of those that make edges, ids of the byte pieces."""

    def __init__(self, pieces: list[str], scores: dict[int, float], byte_ids: dict[int, int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        lowest = min((s for s in scores.values() if s > LEAST_SCORE), default=0.0)
        self.scores = {i: max(s, lowest) for i, s in scores.items()}
        self.unknown = lowest - UNKNOWN_PENALTY
        self.ids = {pieces[i]: i for i in self.scores}
        self.longest = max(map(len, self.ids), default=1)
        mark = chr(MARK)
        self.spelled = [p.replace(mark, " ").encode() for p in pieces]
        for b, i in byte_ids.items():
            self.spelled[i] = bytes([b])

    def tables(self) -> "Tables":
        return Tables(self)

    def unknown_ids(self, symbol: int) -> list[int]:
        char = chr(MARK if symbol == LITERAL_MARK else symbol)
        return [self.byte_ids.get(b, 0) for b in char.encode("utf-8", "surrogatepass")]


class Tables:
    """Lookup arrays of a vocabulary: character classes, joinable pairs, hashed pieces."""

    def __init__(self, v: Vocabulary):
        several = [p for p in v.ids if len(p) > 1]
        chars = sorted({c for p in several for c in p})
        self.classes = np.zeros(0x110000 + 0x10000, np.uint16)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1,) * 2, bool)
        for p in several:
            k = self.classes[[ord(c) for c in p]]
            self.joined[k[:-1], k[1:]] = True
        self.single = np.zeros(len(self.classes), bool)
        self.single[[ord(p) for p in v.ids if len(p) == 1]] = True
        names = list(v.ids)
        symbols = np.array([ord(c) for p in names for c in p] or [0], np.uint32)
        ends = np.cumsum([len(p) for p in names])
        hashes = SpanHashes(symbols)(ends - np.array([len(p) for p in names]), ends) if names else np.empty(0, U64)
        self.keys = np.zeros(1 << _TABLE_BITS, U64)
        self.values = np.full(1 << _TABLE_BITS, -1, np.int32)
        for h, p in zip(hashes.tolist(), names, strict=True):
            slot = h >> (64 - _TABLE_BITS)
            while self.keys[slot]:
                slot = (slot + 1) & ((1 << _TABLE_BITS) - 1)
            self.keys[slot], self.values[slot] = h, v.ids[p]
        self.scores = np.full(len(v.pieces) + 1, -np.inf)  # the last: no such piece
        for i, s in v.scores.items():
            self.scores[i] = s

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of hashes; -1 where there is none."""
        slot = (hashes >> U64(64 - _TABLE_BITS)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == hashes, self.values[slot], -1)
        left = np.flatnonzero((key != hashes) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << _TABLE_BITS) - 1)
            key = self.keys[slot[left]]
            hit = key == hashes[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out


def lattice_nbest(v: Vocabulary, symbols: list[int], n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best (score, ids) of one segment: forward Viterbi, then A-star backwards."""
    text = "".join(chr(s) if s < 0x110000 else "\0" for s in symbols)
    size = len(symbols)
    marks = LITERAL_MARK in symbols
    edges: list[list[tuple[int, float, int]]] = [[] for _ in range(size + 1)]
    alpha = [0.0] + [-np.inf] * size
    for end in range(1, size + 1):
        for start in range(max(0, end - v.longest), end):
            piece = v.ids.get(text[start:end])
            if piece is not None and not (marks and LITERAL_MARK in symbols[start:end]):
                edges[end].append((start, v.scores[piece], piece))
        if not any(start == end - 1 for start, _, _ in edges[end]):
            edges[end].append((end - 1, v.unknown, -symbols[end - 1] - 1))
        alpha[end] = max(alpha[start] + s for start, s, _ in edges[end])
    out: list[tuple[float, list[int]]] = []
    agenda: list[tuple] = [(-alpha[size], 0, size, 0.0, None)]
    count, popped = 0, [0] * (size + 1)
    while agenda and len(out) < n:
        _, _, at, suffix, link = heapq.heappop(agenda)
        popped[at] += 1
        if popped[at] > n:  # n suffixes as good as this one pass here: no path of the n best needs it
            continue
        if at == 0:
            ids: list[int] = []
            while link:
                piece, link = link
                ids += [piece] if piece >= 0 else v.unknown_ids(-piece - 1)
            out.append((suffix, ids))
            continue
        for start, s, piece in edges[at]:
            if popped[start] >= n:
                continue
            count -= 1  # of equal ones the newest is taken first, so that ties are not walked side by side
            heapq.heappush(agenda, (-(suffix + s + alpha[start]), count, start, suffix + s, (piece, link)))
    return out


def symbols_of(text: str) -> np.ndarray:
    """Symbols of a text that is not empty, with the leading mark."""
    s = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(s == MARK, np.uint32(LITERAL_MARK), np.where(s == 32, np.uint32(MARK), s))
    return np.concatenate((np.array([MARK], np.uint32), s))


class Encoder:
    """Encodes lists of texts; keeps the N-best lists of segments that it had to search."""

    def __init__(self, vocabulary: Vocabulary, nbest: int = NBEST):
        self.v, self.t, self.n = vocabulary, vocabulary.tables(), nbest
        self.search = lru_cache(maxsize=20_000)(lambda key: lattice_nbest(self.v, np.frombuffer(key, np.uint32).tolist(), self.n))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, list[float], list[list[tuple[int, int, list[int]]]]]]:
        """(index, best ids, N best scores, edits of each) for every text, in blocks.

        An edit (at, length, ids) replaces the best path's ids from place ``at`` on.
        """
        lo = held = 0
        for i, t in enumerate(texts):
            if held and held + len(t or "") > BLOCK_CHARS:
                yield from self._block(texts, lo, i)
                lo, held = i, 0
            held += len(t or "")
        if lo < len(texts):
            yield from self._block(texts, lo, len(texts))

    def _block(self, texts, lo, hi):
        parts = [symbols_of(t) if t else np.empty(0, np.uint32) for t in texts[lo:hi]]
        lengths = np.array([len(p) for p in parts])
        symbols = np.concatenate(parts)
        if not len(symbols):
            for k in range(lo, hi):
                yield k, np.empty(0, np.int32), [0.0], [[]]
            return
        kind = self.t.classes[symbols]
        cut = np.ones(len(symbols), bool)
        cut[1:] = ~self.t.joined[kind[:-1], kind[1:]]
        text_ends = np.cumsum(lengths)
        cut[(text_ends - lengths)[lengths > 0]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(symbols)))
        hashes = SpanHashes(symbols)
        _, first, which = np.unique(hashes(starts, starts + sizes), return_index=True, return_inverse=True)
        at, size = starts[first], sizes[first]
        flat, offsets, best, gap = self._segments(symbols, hashes, at, size)
        counts = np.diff(offsets)[which]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(offsets[which] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.searchsorted(starts, np.concatenate(([0], text_ends)))
        score, doubt = best[which], gap[which]
        for k in range(hi - lo):
            a, b = bounds[k], bounds[k + 1]
            if a == b:
                yield lo + k, np.empty(0, np.int32), [0.0], [[]]
                continue
            base = ends[a] - counts[a]
            total = float(score[a:b].sum())
            own = ids[base : ends[b - 1]]
            scores, edits = self._combine(symbols, starts, sizes, doubt, counts, ends - counts - base, a, b, total, own)
            yield lo + k, own, scores, edits

    def _combine(self, symbols, starts, sizes, doubt, counts, places, a, b, total, ids):
        """The N best of a text from the N - 1 segments with the smallest gaps."""
        ranked: list[tuple[float, list]] = [(0.0, [])]
        own = doubt[a:b]
        few = min(self.n - 1, len(own))
        if few > 0:
            cand = np.argpartition(own, few - 1)[:few] if few < len(own) else np.arange(len(own))
            worst = own[cand].max()
            cand = np.flatnonzero(own < worst) if np.isfinite(worst) else np.flatnonzero(np.isfinite(own))
            if np.isfinite(worst):
                cand = np.concatenate((cand, np.flatnonzero(own == worst)[: few - len(cand)]))
            for s in cand[np.lexsort((cand, own[cand]))] + a:
                choices = self.search(symbols[starts[s] : starts[s] + sizes[s]].tobytes())
                top, own_ids = choices[0][0], ids[places[s] : places[s] + counts[s]].tolist()
                if choices[0][1] != own_ids:  # of equal scores the other pass may have taken another path
                    choices = [(top, own_ids), *(c for c in choices if c[1] != own_ids)][: self.n]
                grown = [(loss + top - value, edits + ([(int(places[s]), int(counts[s]), new)] if r else [])) for loss, edits in ranked for r, (value, new) in enumerate(choices)]
                ranked = sorted(grown, key=lambda x: x[0])[: self.n]
        return [total - loss for loss, _ in ranked], [edits for _, edits in ranked]

    def _segments(self, symbols, hashes, at, size):
        """(ids of all segments, offsets, best scores, gaps to the second best)."""
        u = len(at)
        best, gap = np.zeros(u), np.full(u, np.inf)
        odd = np.flatnonzero((size > VECTOR_LENGTH) | self._has_unknown(symbols, at, size))
        plain = np.ones(u, bool)
        plain[odd] = False
        lists: dict[int, list[int]] = {}
        for s in odd.tolist():
            found = self.search(symbols[at[s] : at[s] + size[s]].tobytes())
            best[s], lists[s] = found[0]
            if len(found) > 1:
                gap[s] = found[0][0] - found[1][0]
        rows = np.flatnonzero(plain)
        rows = rows[np.argsort(-size[rows], kind="stable")]
        n_ids = np.zeros(u, np.int64)
        grid = np.empty((0, 0), np.int32)
        if len(rows):
            grid, n_ids[rows], best[rows], gap[rows] = self._viterbi(hashes, at[rows], size[rows])
        for s, ids in lists.items():
            n_ids[s] = len(ids)
        offsets = np.concatenate(([0], np.cumsum(n_ids)))
        flat = np.empty(offsets[-1], np.int32)
        if len(rows):
            own = n_ids[rows]
            for k in range(grid.shape[1]):  # the k-th piece from the end
                has = own > k
                flat[offsets[rows[has]] + own[has] - 1 - k] = grid[has, k]
        for s, ids in lists.items():
            flat[offsets[s] : offsets[s + 1]] = ids
        return flat, offsets, best, gap

    def _has_unknown(self, symbols, at, size):
        bad = np.concatenate(([0], np.cumsum(~self.t.single[symbols])))
        return bad[at + size] > bad[at]

    def _viterbi(self, hashes, at, size):
        """Best and second-best scores of segments ordered from long to short, and the best ids."""
        u, longest = len(at), int(size[0])
        one = np.full((longest + 1, u), -np.inf)
        two = np.full((longest + 1, u), -np.inf)
        piece, step = np.zeros((longest + 1, u), np.int32), np.zeros((longest + 1, u), np.int8)
        one[0] = 0
        for t in range(1, longest + 1):
            n = int(np.searchsorted(-size, -t, side="right"))
            end = at[:n] + t
            b1, b2 = one[t, :n], two[t, :n]
            for width in range(min(t, self.v.longest), 0, -1):
                ids = self.t.find(hashes(end - width, end))
                hit = np.flatnonzero(ids >= 0)
                if not len(hit):
                    continue
                s = self.t.scores[ids[hit]]
                c1, c2 = one[t - width, hit] + s, two[t - width, hit] + s
                old = b1[hit]
                b2[hit] = np.maximum(np.maximum(b2[hit], c2), np.minimum(old, c1))
                better = c1 > old
                won = hit[better]
                b1[won] = c1[better]
                piece[t, won], step[t, won] = ids[won], width
        columns = np.arange(u)
        grid, place, n_ids, k = [], size.astype(np.int64), np.zeros(u, np.int64), 0
        while True:
            live = place > 0
            if not live.any():
                break
            grid.append(np.where(live, piece[place, columns], 0))
            n_ids += live
            place = place - np.where(live, step[place, columns], 0)
            k += 1
        return np.stack(grid, axis=1), n_ids, one[size, columns], one[size, columns] - two[size, columns]


def nbest(vocabulary: Vocabulary, text: str | None, n: int = NBEST) -> list[tuple[float, list[int]]]:
    """The ``n`` best (score, ids) of one text; fewer if there are fewer segmentations."""
    for _, ids, scores, edits in Encoder(vocabulary, n).encode([text]):
        return [(s, applied(ids, e)) for s, e in zip(scores, edits, strict=True)]
    return []


def applied(ids: np.ndarray, edits: list[tuple[int, int, list[int]]]) -> list[int]:
    """The best path's ids with the edits of another path."""
    out = ids.tolist()
    for at, length, new in sorted(edits, reverse=True):
        out[at : at + length] = new
    return out


def decode(vocabulary: Vocabulary, ids) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    raw = b"".join([vocabulary.spelled[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _spelled_alike(vocabulary: Vocabulary, ids: np.ndarray, edits: list[tuple[int, int, list[int]]]) -> bool:
    """Whether a path decodes like the best one: what its edits put in spells the bytes of what they replace."""
    spell = lambda part: b"".join([vocabulary.spelled[i] for i in part])
    if all(spell(new) == spell(ids[at : at + length]) for at, length, new in edits):
        return True
    return decode(vocabulary, applied(ids, edits)) == decode(vocabulary, ids)


_ENCODER: list[Encoder] = []  # of this worker; it holds its vocabulary, so identity is safe to compare


def _encoder(shared, n: int) -> Encoder:
    if not _ENCODER or _ENCODER[0].v is not shared.value or _ENCODER[0].n != n:
        _ENCODER[:] = [Encoder(shared.value, n)]
    return _ENCODER[0]


def _encoded(shared, n: int):
    edit = pa.struct([("at", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])
    kinds = {"ids": pa.list_(pa.int32()), "n_pieces": pa.int64(), "scores": pa.list_(pa.float64()), "edits": pa.list_(pa.list_(edit)), "round_trip": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]):
        encoder = _encoder(shared, n)
        for batch in common.sliced(batches):
            texts = common.column(batch, "text")
            first, held, rows = 0, 0, []
            for i, ids, scores, edits in encoder.encode(texts):
                back = decode(encoder.v, ids) == (texts[i] or "") and all(_spelled_alike(encoder.v, ids, e) for e in edits)
                rows.append((ids, len(ids), scores, [[dict(zip(_EDIT, e, strict=True)) for e in path] for path in edits], back))
                held += len(ids)
                if held > 200_000 or i + 1 == len(texts):
                    yield _rows(batch.slice(first, len(rows)), rows, kinds)
                    first, held, rows = i + 1, 0, []

    return run


_EDIT = ("at", "length", "ids")


def _rows(batch, rows, kinds):
    """doc_id, what was worked out, and the columns of the batch behind its text."""
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), *arrays, *batch.columns[2:]], names=["doc_id", *kinds, *batch.schema.names[2:]])


_ENCODED = "doc_id long, ids array<int>, n_pieces long, scores array<double>, edits array<array<struct<at:int,length:int,ids:array<int>>>>, round_trip boolean"


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST, carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, ids, n_pieces, scores, edits, round_trip: one row for each row of ``docs``, and the columns ``carry`` of it.

    ``ids`` is the best segmentation of the whole text, ``scores`` those of the up to ``n`` best.
    ``edits`` has the segmentation of each score, as the places (at, length) of ``ids`` that other
    ids stand in for; the best one has none, and ``path_column`` gives the ids of any. ``round_trip``
    is whether decoding every one of them gives the text again. A null or empty text has no ids,
    one score of 0 and a round trip to the empty text. Equal scores are ordered by the
    place where the paths differ. Null ids and repeated rows are encoded as they are; an empty
    table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    return docs.mapInArrow(_encoded(shared, n), StructType([*StructType.fromDDL(_ENCODED).fields, *docs.schema.fields[2:]]))


def path_column(encoded: DataFrame, rank: int) -> DataFrame:
    """doc_id, ids of the segmentation with the ``rank``-th best score, from 0; null ids where there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, edits = batch.column(1), batch.column(2).to_pylist()
            out = [None if e is None else applied(ids[i].values.to_numpy(), [tuple(x[c] for c in _EDIT) for x in e]) for i, e in enumerate(edits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return encoded.select("doc_id", "ids", F.get("edits", F.lit(rank)).alias("edits")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """doc_id, text of encoded rows; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]):
        v = shared.value
        for batch in batches:
            texts = [None if ids is None else decode(v, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
