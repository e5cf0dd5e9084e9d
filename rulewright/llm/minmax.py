"""MinHash near-duplicate detection with min-max hashing.

Each permutation of the shingle hashes yields two signature values, the smallest and the
largest element, so ``perms`` evaluations give ``2 * perms`` values whose agreement rate is
an unbiased estimate of the Jaccard similarity with a lower variance than as many
independent minima. Bands of ``rows`` values taken from different permutations name buckets.
With 150 permutations and bands of 6, a pair at similarity 0.8 shares no bucket with a
probability of (1 - 0.8**6)**50 = 3e-7; at 0.85, 96 permutations do for as much.

Links are never guessed from signatures; each is confirmed on full shingle sets:

1. in each bucket every member is compared with the smallest one (linear in the members);
2. buckets whose members then lie in several components are *open*. In open buckets of at
   most ``SMALL_BUCKET`` members the pairs across components are listed and compared;
3. larger open buckets are joined into families, and a family's sets are compared tile
   against tile, each tile pair in a task of its own that returns spanning links only.

So no bucket is capped, no group is expanded into pairs, and no task gets a whole group.

Sets are identified by 64-bit hashes: two different sets among n are confused with a
probability of about n**2 / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64, SpanHashes, chunks, discard, lowered_ascii, mixed, small_or_shuffled, spread_join, staged

PERMS = 150
ROWS = 6
WORDS = 5
THRESHOLD = (80, 100)

#: An open bucket with at most this many members has its pairs across components listed.
SMALL_BUCKET = 32
#: Partitions of a table of edges: these, and one more for so many edges.
LEAST_PARTS = 12
PART_EDGES = 50_000
#: Shingles that a tile of a family holds, about.
TILE_SHINGLES = 150_000


def _constants(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct 64-bit shingle hashes) of every text; empty where it has no word."""
    raw = [b" ".join(lowered_ascii(t).split()) if t else b"" for t in texts]
    for lo, hi in chunks(raw):
        joined = np.frombuffer(b" ".join(raw[lo:hi]) + b" ", np.uint8)
        blank = joined == 32
        ends = np.flatnonzero(blank & ~np.concatenate(([True], blank[:-1])))
        starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
        spans = SpanHashes(joined)
        counts = np.array([t.count(b" ") + 1 if t else 0 for t in raw[lo:hi]])
        first = np.concatenate(([0], np.cumsum(counts)))
        full = spans(starts[: max(len(starts) - words + 1, 0)], ends[words - 1 :])
        for k in range(hi - lo):
            a, n = first[k], counts[k]
            if n == 0:
                yield lo + k, np.empty(0, U64)
            elif n < words:
                yield lo + k, spans(starts[a : a + 1], ends[a + n - 1 : a + n])
            else:
                yield lo + k, np.unique(full[a : a + n - words + 1])


def node_id(shingles: np.ndarray) -> int:
    """Signed 64-bit identity of a shingle set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(values: np.ndarray, offsets: np.ndarray, perms: int) -> np.ndarray:
    """Signature matrix (sets x 2*perms) of the non-empty sets that start at ``offsets``."""
    out = np.empty((len(offsets), 2 * perms), U64)
    xor, odd = _constants(perms, 11), _constants(perms, 29) | U64(1)
    for k in range(perms):
        v = (values ^ xor[k]) * odd[k]
        out[:, k] = np.minimum.reduceat(v, offsets)
        out[:, perms + k] = np.maximum.reduceat(v, offsets)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band of each signature."""
    n, width = signature.shape
    bands = width // rows
    parts = signature[:, : bands * rows].reshape(n, bands, rows)
    weights = _constants(rows, 47) | U64(1)
    keys = np.zeros((n, bands), U64)
    for r in range(rows):
        keys = mixed(keys + parts[:, :, r] * weights[r])
    return mixed(keys + np.arange(bands, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _signature_batches(batches: Iterator[pa.RecordBatch], perms: int, rows: int, words: int):
    """doc_id, n_shingles, node, bands, row_key; bands only at a set's first row in this task."""
    seen: set[int] = set()
    for batch in common.sliced(batches):
        ids = common.column(batch, "doc_id")
        texts = common.column(batch, "text")
        sizes, nodes, bands = [0] * len(ids), [None] * len(ids), [None] * len(ids)
        held: list[tuple[int, np.ndarray]] = []
        n_held = 0

        def flush():
            if held:
                offsets = np.cumsum([0, *(len(s) for _, s in held[:-1])])
                keys = band_keys(signatures(np.concatenate([s for _, s in held]), offsets, perms), rows)
                for (i, _), row in zip(held, keys.view(np.int64), strict=True):
                    bands[i] = row
                held.clear()

        for i, s in shingle_sets(texts, words):
            if len(s):
                sizes[i], nodes[i] = len(s), node_id(s)
                if nodes[i] not in seen:
                    seen.add(nodes[i])
                    held.append((i, s))
                    n_held += len(s)
                    if n_held > 60_000:
                        flush()
                        n_held = 0
        flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), batch.column(2)],
            names=["doc_id", "n_shingles", "node", "bands", "row_key"],
        )


def _set_batches(batches: Iterator[pa.RecordBatch], words: int):
    """node, shingles of the texts whose set is the one that is looked for."""
    for batch in common.sliced(batches):
        wanted = common.column(batch, "node")
        nodes, sets, held = [], [], 0
        for i, s in shingle_sets(common.column(batch, "text"), words):
            if len(s) and node_id(s) == wanted[i]:
                nodes.append(wanted[i])
                sets.append(s.view(np.int64))
                held += len(s)
            if held > 500_000:
                yield _sets(nodes, sets)
                nodes, sets, held = [], [], 0
        if nodes:
            yield _sets(nodes, sets)


def _sets(nodes, sets):
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _similar(common_n: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    return threshold[1] * common_n >= threshold[0] * (a + b - common_n)


def tile_links(nodes, comps, sets, side, threshold) -> list[tuple[int, int]]:
    """Spanning links between the sets of one tile (``side`` all 0) or across two (0 and 1)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    code = np.cumsum(new) - 1
    often = np.bincount(code) > 1
    keep = often[code]
    code, owner = (np.cumsum(often) - 1)[code[keep]], owner[keep]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    overlap = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, (lo, lo + 4096))
        block = np.zeros((len(sets), 4096), np.float32)
        block[owner[a:b], code[a:b] - lo] = 1
        overlap += block[left] @ block[right].T
    hit = _similar(overlap.astype(np.int64), sizes[left][:, None], sizes[right][None, :], threshold)
    root = {c: c for c in comps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        p, q = left[i], right[j]
        x, y = find(comps[p]), find(comps[q])
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((nodes[p], nodes[q]))
    return links


def _tile_group(table: pa.Table, threshold) -> pa.Table:
    values = table.column("shingles").combine_chunks()
    sets = [np.asarray(values[i].values) for i in range(len(values))]
    links = tile_links(table.column("node").to_pylist(), table.column("comp").to_pylist(), sets, np.asarray(table.column("side")), threshold)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """(node, comp) of every node of ``links`` (a, b); comp is the component's smallest node.

    Alternates large-star and small-star contractions, each a grouped minimum and a join,
    until the edges are stars: no node has two centres, and no centre has one. Every round is
    staged. As an edge always points to a smaller node, a star's centre is its smallest node.
    A node's edges meet its minimum by ``spread_join``, so a centre with very many of them is
    no task's own. Links with a null end are none, and an empty table gives an empty result.
    """
    edges = staged(links.select("a", "b").where("a <> b").distinct(), name)
    n = edges.count()
    while n:
        parts = LEAST_PARTS + n // PART_EDGES  # a few rows need no more files than this
        both = edges.union(edges.select("b", "a"))
        large = _with_least(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("low", F.col("a")).alias("b"))
        large = staged(large.where("a <> b").distinct().coalesce(parts), name)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = _with_least(down, 2 * n).select(F.explode(F.array(F.struct(F.col("b").alias("x")), F.struct(F.col("a").alias("x")))).alias("p"), "low")
        small = small.select(F.col("p.x").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        after = staged(small.coalesce(parts), name)
        roles = F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))))
        nodes = after.select(roles.alias("r")).groupBy("r.x").agg(F.sum("r.out").alias("out"), F.max("r.into").alias("into"))
        unfinished, n = nodes.agg(F.count_if(F.expr("out > 1 or (out > 0 and into > 0)")), F.coalesce(F.sum("out"), F.lit(0))).first()
        discard(edges, large)
        edges = after
        if not unfinished:
            break
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return out.union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _with_least(edges: DataFrame, most: int) -> DataFrame:
    """``edges`` (a, b), at most ``most`` of them, with the smallest b of each a as ``low``."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree")).withColumnRenamed("a", "of_a")
    if most <= common.BROADCAST_ROWS:  # there are no more nodes than edges here
        return edges.join(F.broadcast(low), F.col("a") == F.col("of_a"))
    return spread_join(edges, low, F.col("a") == F.col("of_a"), "degree", most)


def _verified(pairs: DataFrame, sets: DataFrame, threshold) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    nx, ny = F.size("x"), F.size("y")
    able = F.least(nx, ny) * threshold[1] >= F.greatest(nx, ny) * threshold[0]
    n = F.size(F.array_intersect("x", "y"))
    return pairs.join(two, "b").join(one, "a").where(able).where(n * threshold[1] >= (nx + ny - n) * threshold[0]).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: tuple[int, int] = THRESHOLD,
    perms: int = PERMS,
    rows: int = ROWS,
    words: int = WORDS,
    row_key: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    With ``row_key`` also ``component`` (null without a shingle) and ``row_key``, which
    ``common.row_key`` gives for the row.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A null or empty text, or one of white
    space only, has no shingle and is its own component. Rows with equal texts, repeated rows
    among them, share a component. A row without id belongs to its component but never names
    it; it stays only if no row of its component has an id. An empty table gives an empty
    result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), common.row_key(text_col))
    sig = staged(
        docs.mapInArrow(partial(_signature_batches, perms=perms, rows=rows, words=words), "doc_id long, n_shingles long, node long, bands array<long>, row_key long"), "signatures"
    )
    member = sig.where("bands is not null").select(F.explode("bands").alias("bucket"), "node")
    shared = member.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead <> last").select("bucket", "lead")
    member = staged(member.join(shared, "bucket").distinct(), "buckets")

    # one row for each set; a set that very many rows have is summed up before it is shuffled
    last = F.lit(2**63 - 1)
    nodes = sig.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min_by("row_key", F.coalesce("doc_id", last)).alias("first_key"), F.count("*").alias("copies"))
    nodes = staged(nodes, "nodes")
    # a set's text is found by id and text: an id or a null that repeats finds its own texts only
    wanted = nodes.join(member.select("node").distinct(), "node", "left_semi")
    wanted = staged(wanted.select("node", F.col("first_id").alias("wanted_id"), F.col("first_key").alias("wanted_key")), "candidates")
    found = docs.join(small_or_shuffled(wanted), F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("row_key") == F.col("wanted_key"))).select("node", "text")
    sets = staged(found.mapInArrow(partial(_set_batches, words=words), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    first = member.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = staged(_verified(first, sets, threshold), "links")
    comp = components(links)

    rows_of = member.join(comp, "node", "left").select("bucket", "lead", "node", F.coalesce("comp", "node").alias("comp"))
    state = rows_of.groupBy("bucket").agg(F.count("*").alias("n"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket", "n")
    open_rows = staged(rows_of.join(state, "bucket"), "open")

    few = open_rows.where(F.col("n") <= SMALL_BUCKET)
    one = few.select("bucket", F.col("node").alias("a"), F.col("comp").alias("ca"))
    two = few.select("bucket", F.col("node").alias("b"), F.col("comp").alias("cb"))
    listed = one.join(two, "bucket").where("a < b and ca <> cb").select("a", "b").distinct()
    more = _verified(listed.join(first, ["a", "b"], "left_anti"), sets, threshold)
    # the components so far, as stars, stand for the links they came from
    stars = comp.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    comp = staged(components(stars.union(more).union(_family_links(open_rows.where(F.col("n") > SMALL_BUCKET), sets, threshold))), "components")

    named = nodes.join(comp, "node", "left")
    named = staged(named.select("node", F.coalesce("comp", "node").alias("comp"), "first_id", "copies"), "names")
    # only sets that are linked or repeated need a name from elsewhere
    label = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = staged(named.join(label, "comp").select(F.col("node").alias("of_node"), "comp", "component_id", "copies"), "named")
    out = spread_join(sig.select("doc_id", "n_shingles", "node", "row_key"), named, F.col("node") == F.col("of_node"), "copies", sig)
    found_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == found_id, found_id.isNull()).alias("kept")
    return out.select("doc_id", "n_shingles", found_id.alias("component_id"), kept, *([F.col("comp").alias("component"), "row_key"] if row_key else []))


def _family_links(open_rows: DataFrame, sets: DataFrame, threshold) -> DataFrame:
    """Links within the large open buckets: families in tiles, each tile pair a task's group."""
    family = components(open_rows.select(F.col("lead").alias("a"), F.col("node").alias("b")), "family")
    family = family.withColumnRenamed("comp", "family")
    comp = open_rows.select("node", "comp").distinct()
    sized = family.join(comp, "node").join(sets.select("node", F.size("shingles").alias("n")), "node")
    tiles = sized.groupBy("family").agg(F.ceil(F.sum("n") / TILE_SHINGLES).cast("int").alias("tiles"))
    placed = staged(sized.join(tiles, "family").select("node", "comp", "family", "tiles", F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile")), "tiles")
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("tile")).alias("i"), F.greatest(k, F.col("tile")).alias("j")))
    spread = placed.select("node", "comp", "family", "tile", F.explode(others).alias("p"))
    spread = spread.select("node", "comp", "family", "p.i", "p.j", F.when(F.col("p.i") == F.col("p.j"), 0).otherwise((F.col("tile") == F.col("p.j")).cast("int")).alias("side"))

    def within(table: pa.Table) -> pa.Table:
        return _tile_group(table, threshold)

    return spread.join(sets, "node").groupBy("family", "i", "j").applyInArrow(within, "a long, b long")
