"""Rules as a table: any number of conjunctions of intervals, measured in one pass over the rows.

A rule is a row for each feature that it bounds. The bounds cut a feature into elementary intervals,
and rows are first counted by cells: the combinations of intervals that occur. A block of rules has
a bitmap for each interval, of its rules that accept it; a cell's rules are the conjunction of the bitmaps
of its features' intervals. So a row costs a lookup for each feature and a cell a bitwise and for each
feature and block, whatever the number of rules in the block, no pair of row and rule is ever made, and
what leaves a task is a count for each rule and label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .conditions import RangeCondition, ScalarCondition
from .models import Branch, Ensemble, Rule, _scalar, apply_model, nodes
from .rules import _atoms

#: Rules whose bitmaps are made together; a feature then has up to twice as many intervals of so many bits.
BLOCK_RULES = 2_048
#: Bounds that one pass over the rows takes to its tasks, about; more rules take more passes.
PASS_BOUNDS = 1_000_000
#: Cells whose bitmaps are held at a time.
BATCH_ROWS = 4_096

SCHEMA = "rule_id long, feature string, low double, high double, low_closed boolean, high_closed boolean, consequent string"


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rows of ``SCHEMA`` of rules whose atoms are inequalities or ranges; a rule without atoms has one row without feature.

    Atoms of one feature are one interval. A ValueError names an atom that is no interval.
    """
    rows = []
    for i, rule in enumerate(rules):
        found: dict[str, list] = {}
        for a in _atoms(rule.antecedent):
            if isinstance(a, RangeCondition):
                own = (a.low, a.high, a.low_closed, a.high_closed)
            elif isinstance(a, ScalarCondition) and a.op == "==":
                own = (float(a.threshold), float(a.threshold), True, True)
            elif isinstance(a, ScalarCondition) and a.op != "!=":
                own = _interval(a)
                own = (*own[:2], not own[2], own[3])
            else:
                raise ValueError(f"no interval: {a}")
            low, high, lc, hc = found.get(a.feature, (-float("inf"), float("inf"), True, True))
            low, lc = max((low, not lc), (own[0], not own[2]))
            high, hc = min((high, hc), (own[1], own[3]))
            found[a.feature] = [low, high, not lc, hc]
        rows += [(i, f, *map(float, v[:2]), *v[2:], str(rule.consequent.outcome)) for f, v in found.items()] or [(i, None, None, None, None, None, str(rule.consequent.outcome))]
    return spark.createDataFrame(rows, SCHEMA)


def cells(df: DataFrame, thresholds: dict[str, set[float]], label: Column) -> DataFrame:
    """How many rows (``_n``) share a label (``_label``) and the elementary intervals of all features.

    The finite thresholds of a feature cut it into the intervals between them and the thresholds themselves.
    A cell's features have the least value of its rows, so a condition with these thresholds, or infinite ones,
    holds for a cell as it does for each of its rows; NaN stands for NaN and null. There are no more cells than
    rows, and of few thresholds far fewer.
    """
    values, places = [f"x{i}" for i in range(len(thresholds))], [f"p{i}" for i in range(len(thresholds))]
    placed = df.select(label.cast("string").alias("_label"), *[(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(math.nan)) + 0.0).alias(x) for f, x in zip(thresholds, values, strict=True)])  # no negative zero
    if thresholds:
        splits = [_splits(t) for t in thresholds.values()]
        placed = Bucketizer(splitsArray=splits, inputCols=values, outputCols=places, handleInvalid="keep").transform(placed)
    keys = [F.when(F.col(x) == math.inf, -1).when(F.col(x) == -math.inf, -2).otherwise(F.col(p).cast("int")).alias(p) for x, p in zip(values, places, strict=True)]
    # as aggregates, the values keep conditions on cells from being pushed down to the rows
    found = placed.groupBy("_label", *keys).agg(F.count("*").alias("_n"), *[F.min(x).alias(x) for x in values])
    return found.select("_label", "_n", *[F.col(x).alias(f) for f, x in zip(thresholds, values, strict=True)])


def _splits(thresholds: set[float]) -> list[float]:
    """Ends of half-open buckets, of which a finite threshold has one of its own."""
    finite = {t + 0.0 for t in thresholds if math.isfinite(t)} or {0.0}
    return sorted({-math.inf, math.inf, *finite, *(math.nextafter(t, math.inf) for t in finite)})


@dataclass
class _Block:
    """Elementary intervals of each feature and the rules that accept each of them, for rules ``first`` and on of a pass."""

    first: int
    size: int
    bounds: dict[str, np.ndarray]
    masks: dict[str, np.ndarray]
    bounding: dict[str, np.ndarray]

    @classmethod
    def of(cls, first: int, size: int, atoms: dict[str, list]) -> "_Block":
        bounds, masks = {}, {}
        for f, (rule, low, high, low_closed, high_closed) in atoms.items():
            edges = np.unique(np.concatenate([low[np.isfinite(low)], high[np.isfinite(high)]]))
            # places 2k are the open intervals between edges, 2k + 1 the edges themselves
            begin = np.where(np.isfinite(low), 2 * np.searchsorted(edges, low) + np.where(low_closed, 1, 2), 0)
            end = np.where(np.isfinite(high), 2 * np.searchsorted(edges, high) + np.where(high_closed, 1, 0), 2 * len(edges))
            end = np.where(high == -np.inf, -1, end)
            begin = np.where(low == np.inf, 2 * len(edges) + 1, begin)
            accepts = np.ones((2 * len(edges) + 1, size), bool)
            places = np.arange(2 * len(edges) + 1)[:, None]
            accepts[:, rule - first] = (places >= begin) & (places <= end)
            bounds[f], masks[f] = edges, np.packbits(accepts, axis=1)
        return cls(first, size, bounds, masks, {f: np.isin(np.arange(first, first + size), a[0]) for f, a in atoms.items()})

    def holds(self, values: dict[str, np.ndarray], n: int) -> np.ndarray:
        """Packed bits (rows x rules) of the rules that hold. NaN and null are in no interval."""
        out = np.full((n, (self.size + 7) // 8), 255, np.uint8)
        for f, edges in self.bounds.items():
            v = values[f]
            left = np.searchsorted(edges, v, "left")
            place = 2 * left + (left < len(edges)) * (edges[np.minimum(left, len(edges) - 1)] == v) if len(edges) else np.zeros(n, int)
            own = self.masks[f][place]
            bad = np.isnan(v)
            if bad.any():  # rules that bound the feature do not hold; those that do not are in all intervals
                own[bad] = np.packbits(~self.bounding[f])
            out &= own
        return out


def _blocks(rows: list) -> list[_Block]:
    """Blocks of the rules (place, feature, low, high, low_closed, high_closed) of one pass."""
    size = max((r[0] for r in rows), default=-1) + 1
    out = []
    for first in range(0, size, BLOCK_RULES):
        last = min(first + BLOCK_RULES, size)
        own: dict[str, list] = {}
        for r in rows:
            if first <= r[0] < last and r[1] is not None:
                own.setdefault(r[1], []).append((r[0], *r[2:]))
        atoms = {f: [np.array(c, k) for c, k in zip(zip(*a, strict=True), (int, float, float, bool, bool), strict=True)] for f, a in own.items()}
        out.append(_Block.of(first, last - first, atoms))
    return out


def covered_counts(df: DataFrame, rules: DataFrame, label: str) -> DataFrame:
    """rule_id, label, n: how many rows of each label each rule of a table (``SCHEMA``) holds for; those of none are left out.

    The bounds go to the tasks in passes of about PASS_BOUNDS, by the ids of their rules; each
    pass scans the rows once. A rule that bounds a feature twice needs its rows merged first.
    """
    spark = df.sparkSession
    kept = rules.storageLevel != StorageLevel.NONE
    rules = rules if kept else rules.persist()  # counted, and read once a pass
    n = rules.count()
    passes = max(1, -(-n // PASS_BOUNDS))
    out = None
    for k in range(passes):
        part = rules.where(F.pmod(F.xxhash64("rule_id"), F.lit(passes)) == k).select("rule_id", "feature", "low", "high", "low_closed", "high_closed").collect()  # about PASS_BOUNDS rows
        ids = sorted({r["rule_id"] for r in part})
        places = {i: p for p, i in enumerate(ids)}
        bounds: dict[str, set] = {}
        for r in part:
            if r["feature"] is not None:
                bounds.setdefault(r["feature"], set()).update((r["low"], r["high"]))
        shared = spark.sparkContext.broadcast([(places[r["rule_id"]], *r[1:]) for r in part])
        counted = _counted(cells(df, bounds, F.col(label)), list(bounds), shared)
        names = spark.createDataFrame(pa.table({"place": np.arange(len(ids)), "rule_id": np.array(ids, np.int64)}))
        counted = counted.groupBy("place", "label").agg(F.sum("n").alias("n")).join(F.broadcast(names), "place").select("rule_id", "label", "n")  # no more rows than bounds
        out = counted if out is None else out.unionByName(counted)
    if not kept:
        rules.unpersist()
    return out


def _counted(found: DataFrame, features: list[str], shared) -> DataFrame:
    columns = [F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)]

    def run(batches: Iterator[pa.RecordBatch]):
        blocks, totals = _blocks(shared.value), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(lo, BATCH_ROWS)
                labels = rows.column(0).to_numpy(zero_copy_only=False)
                kinds, code = np.unique(np.array(["" if x is None else f"={x}" for x in labels]), return_inverse=True)
                weights = rows.column(1).to_numpy().astype(float)  # counts are exact up to 2 ** 53
                values = {f: np.asarray(rows.column(2 + i).to_numpy(zero_copy_only=False), float) for i, f in enumerate(features)}
                for b, block in enumerate(blocks):
                    held = block.holds(values, rows.num_rows)
                    for j, kind in enumerate(kinds.tolist()):
                        own = code == j
                        some = (weights[own] @ np.unpackbits(held[own], axis=1, count=block.size)).astype(np.int64)
                        key = (b, kind)
                        totals[key] = totals[key] + some if key in totals else some
        for (b, kind), some in totals.items():
            at = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array(at + blocks[b].first, pa.int64()), pa.array([kind[1:] if kind else None] * len(at), pa.string()), pa.array(some[at], pa.int64())], names=["place", "label", "n"])

    return found.select("_label", "_n", *columns).mapInArrow(run, "place long, label string, n long")


def rule_table_metrics(df: DataFrame, rules: DataFrame, label: str) -> DataFrame:
    """rule_id, consequent, natoms, ninstances, ncovered, coverage, confidence, lift, error of every rule of a table.

    As ``rules.rule_metrics``, except that ``natoms`` counts bounded features. An empty table of rows covers nothing.
    """
    heads = rules.groupBy("rule_id").agg(F.first("consequent").alias("consequent"), F.count("feature").alias("natoms"))
    counts = covered_counts(df, rules, label)
    own = heads.select(F.col("rule_id").alias("of_rule"), F.col("consequent").alias("own"))
    hits = counts.join(own, F.col("rule_id") == F.col("of_rule")).groupBy("of_rule").agg(F.sum("n").alias("c"), F.sum(F.when(F.col("label") == F.col("own"), F.col("n")).otherwise(0)).alias("h"))
    totals = df.groupBy(F.col(label).cast("string").alias("of_label")).agg(F.count("*").alias("y"))
    n = df.count()
    out = heads.join(hits, F.col("rule_id") == F.col("of_rule"), "left").join(totals, F.col("consequent") == F.col("of_label"), "left")
    c, h, y = (F.coalesce(x, F.lit(0)) for x in ("c", "h", "y"))
    confidence = F.try_divide(h, c)
    lift = F.try_divide(confidence, F.try_divide(y, F.lit(n)))
    return out.select(
        "rule_id", "consequent", "natoms", F.lit(n).cast("long").alias("ninstances"), c.alias("ncovered"), F.coalesce(F.try_divide(c, F.lit(n)), F.lit(0.0)).alias("coverage"),
        confidence.alias("confidence"), lift.alias("lift"), (1 - confidence).alias("error"),
    )




def _leaf_column(m, leaf_ids: Iterator[int]):
    """The number of the leaf whose rule a row satisfies; null where it satisfies none, as with NaN."""
    if isinstance(m, Branch):
        yes, no = _leaf_column(m.positive, leaf_ids), _leaf_column(m.negative, leaf_ids)
        return F.when(m.condition.column(), yes).when(m.condition.dual.column(), no)
    return F.lit(next(leaf_ids))


def _leaf_atoms(m, held: list, leaf_ids: Iterator[int]) -> Iterator[tuple[int, list]]:
    if isinstance(m, Branch):
        yield from _leaf_atoms(m.positive, [*held, m.condition], leaf_ids)
        yield from _leaf_atoms(m.negative, [*held, m.condition.dual], leaf_ids)
    else:
        yield next(leaf_ids), held


def rules_of_rows(df: DataFrame, ensemble: Ensemble) -> tuple[DataFrame, DataFrame]:
    """The rules of an ensemble that hold for some row, as (rule_id, leaves, consequent, ncovered) and as a rule table (``SCHEMA``).

    A rule of an ensemble is one leaf of each tree. Their products are not listed: each row has its
    leaves, and the distinct ones, with the vote, are the rules; so there are no more of them than rows,
    and contradictions do not come up. A row that is NaN in a tested feature satisfies no rule. Rows are
    counted by ``cells`` first, unless a leaf is computed from the row; leaves and votes are of cells.
    ``rule_id`` is a 64-bit hash of the leaves. Trees have branches on inequalities of one feature.
    """
    leaves = [_leaf_column(t.root, iter(range(1 << 30))) for t in ensemble.trees]
    if _scalar(ensemble):
        thresholds: dict[str, set] = {}
        for c in (n.condition for t in ensemble.trees for n in nodes(t.root) if isinstance(n, Branch)):
            thresholds.setdefault(c.feature, set()).add(float(c.threshold))
        counted = cells(df, thresholds, F.lit(None))
    else:
        counted = df.withColumn("_n", F.lit(1))
    voted = apply_model(counted, ensemble, "_vote")
    rows = voted.select("_n", F.array(*leaves).alias("leaves"), F.col("_vote").cast("string").alias("consequent")).where(~F.exists("leaves", lambda x: x.isNull()))
    rules = rows.groupBy("leaves").agg(F.first("consequent").alias("consequent"), F.sum("_n").alias("ncovered"))
    rules = rules.select(F.xxhash64("leaves").alias("rule_id"), "leaves", "consequent", "ncovered")
    bounds = []
    for t, tree in enumerate(ensemble.trees):
        for leaf, atoms in _leaf_atoms(tree.root, [], iter(range(1 << 30))):
            for a in atoms:
                bounds.append((t, leaf, a.feature, *_interval(a)))
    bounds = df.sparkSession.createDataFrame(bounds, "tree int, leaf int, feature string, low double, high double, low_open boolean, high_closed boolean")
    parts = rules.select("rule_id", "consequent", F.posexplode("leaves").alias("tree", "leaf")).join(F.broadcast(bounds), ["tree", "leaf"])  # a row for each atom of each tree
    low, high = F.max(F.struct("low", "low_open")), F.min(F.struct("high", "high_closed"))
    whole = parts.groupBy("rule_id", "feature").agg(low.alias("l"), high.alias("h"), F.first("consequent").alias("consequent"))
    return rules, whole.select("rule_id", "feature", F.col("l.low").alias("low"), F.col("h.high").alias("high"), (~F.col("l.low_open")).alias("low_closed"), F.col("h.high_closed").alias("high_closed"), "consequent")


def _interval(a: ScalarCondition) -> tuple[float, float, bool, bool]:
    """low, high, whether the low end is open, whether the high one is closed."""
    inf, t = float("inf"), float(a.threshold)
    if a.op not in ("<", "<=", ">", ">="):
        raise ValueError(f"no inequality: {a}")
    return -inf if a.op[0] == "<" else t, inf if a.op[0] == ">" else t, a.op == ">", a.op != "<"
