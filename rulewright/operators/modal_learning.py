"""Learners of modal trees, forests and stage-wise ensembles over series.

A test asks whether some interval of a series, of a length and in a relation to the whole series, has a
feature of at least (or at most) a threshold. What decides is the best value that any such
interval attains, so each row is reduced once to one number for each test, and each number to its
place among at most ``bins`` thresholds. From then on a level of all trees is one aggregate, of
class weights by (tree, node, test, place), and only the best split of each node goes to the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from .boosting import StageWise
from .modal import ModalCondition
from .models import Branch, Ensemble, Leaf, Tree

#: Relations of an interval to the whole series that a series has intervals for; None: all of its intervals.
RELATIONS = (None, "=", "B", "E", "D", "DBE")
#: Cumulated probabilities of a Poisson variable of mean 1, which is how often a row is drawn.
_POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8))


@dataclass(frozen=True)
class ModalTest:
    """⟨relation⟩(fun(variable) op ·) over intervals of ``shortest`` to ``longest`` values; op is >= or <=."""

    variable: str
    fun: str
    op: str = ">="
    shortest: int = 1
    longest: int | None = None
    relation: str | None = None

    def __post_init__(self):
        if self.fun not in ("minimum", "maximum", "mean") or self.op not in (">=", "<=") or self.relation not in RELATIONS or self.shortest < 1 or (self.longest or self.shortest) < self.shortest:
            raise ValueError(f"no modal test: {self}")

    def condition(self, threshold: float) -> ModalCondition:
        return ModalCondition(self.variable, self.fun, self.op, threshold, self.shortest, self.longest, False, self.relation)

    def attained(self, a: np.ndarray) -> float:
        """The best value of any interval of the series; NaN without one."""
        longest = min(self.longest or len(a), len(a))
        if self.relation in ("B", "E", "D", "DBE"):
            longest = min(longest, len(a) - (2 if self.relation == "D" else 1))
        if longest < self.shortest:
            return math.nan
        if self.relation == "=":
            values = _prefixes(a, self.fun)[-1:] if self.longest is None or self.longest >= len(a) else np.empty(0)
        elif self.relation in ("B", "E"):
            values = _prefixes(a if self.relation == "B" else a[::-1], self.fun)[self.shortest - 1 : longest]
        else:
            values = _sliding(a[1:-1] if self.relation == "D" else a, self.fun, self.shortest, longest)
        values = values[~np.isnan(values)]
        return math.nan if not len(values) else float(values.max() if self.op == ">=" else values.min())


def _prefixes(a: np.ndarray, fun: str) -> np.ndarray:
    if fun == "mean":
        return np.cumsum(a) / np.arange(1, len(a) + 1)
    return (np.minimum if fun == "minimum" else np.maximum).accumulate(a)


def _sliding(a: np.ndarray, fun: str, shortest: int, longest: int) -> np.ndarray:
    """Values of intervals that hold the best of all: the shortest ones for extremes, those below twice that for means."""
    if fun == "mean":
        bad = np.isnan(a)
        sums, spoilt = (np.concatenate(([0], np.cumsum(x))) for x in (np.where(bad, 0.0, a), bad))
        out = []
        for n in range(shortest, min(longest, 2 * shortest - 1) + 1):
            out.append(np.where(spoilt[n:] > spoilt[:-n], np.nan, (sums[n:] - sums[:-n]) / n))
        return np.concatenate(out)
    pick = np.minimum if fun == "minimum" else np.maximum
    width = 1
    while 2 * width <= shortest:  # extremes of widths that double
        a, width = pick(a[:-width], a[width:]), 2 * width
    rest = shortest - width
    return pick(a[: len(a) - rest], a[rest:]) if rest else a


def attained(df: DataFrame, tests: list[ModalTest], label: str, row_id: str) -> DataFrame:
    """id, y, u: for each test the best value of a row, negated for tests of at most, so that more passes more; null without one.

    A null series has no intervals. Rows without label are left out.
    """
    variables = sorted({t.variable for t in tests})
    rows = df.where(F.col(label).isNotNull()).select(F.col(row_id).cast("string").alias("id"), F.col(label).cast("string").alias("y"), *[F.col(f"`{v}`").cast("array<double>").alias(f"s{i}") for i, v in enumerate(variables)])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            series = [[None if x is None else np.array(x, float) for x in batch.column(2 + i).to_pylist()] for i in range(len(variables))]
            out = []
            for k in range(batch.num_rows):
                row = []
                for t in tests:
                    a = series[variables.index(t.variable)][k]
                    v = math.nan if a is None else t.attained(a)
                    row.append(None if math.isnan(v) else v if t.op == ">=" else -v)
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["id", "y", "u"])

    return rows.mapInArrow(run, "id string, y string, u array<double>")


@dataclass(frozen=True)
class Coded:
    """Rows (id, y as a place among ``classes``, places among ``cuts``) and what the places mean."""

    rows: DataFrame
    tests: list[ModalTest]
    cuts: list[list[float]]
    classes: list[str]

    def condition(self, test: int, place: int) -> ModalCondition:
        cut = self.cuts[test][place - 1]
        return self.tests[test].condition(cut if self.tests[test].op == ">=" else -cut)


def coded(df: DataFrame, tests: list[ModalTest], label: str, row_id: str, bins: int = 16) -> Coded:
    """Reduces a table to small codes, once; thresholds are exact quantiles of what rows attain. The caller unpersists ``rows``."""
    found = attained(df, tests, label, row_id).persist()
    places = [i / bins for i in range(1, bins)]
    asked = exact_quantiles(found.select(F.posexplode("u").alias("test", "u")), ["test"], "u", places, between=False)
    cuts: list[list[float]] = [[] for _ in tests]
    for r in asked.collect():  # a row for each test
        cuts[r["test"]] = sorted(set(r["q"]))
    classes = sorted(r[0] for r in found.select("y").distinct().collect())
    literal = F.from_json(F.lit(json.dumps(cuts)), "array<array<double>>")
    code = F.zip_with("u", literal, lambda u, c: F.coalesce(F.size(F.filter(c, lambda x: x <= u)), F.lit(0)).cast("short"))
    rows = found.select("id", (F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1).cast("int").alias("y"), code.alias("code")).persist()
    rows.count()
    found.unpersist()
    return Coded(rows, tests, cuts, classes)


def _impurity(weights: list[Column], total: Column, criterion: str) -> Column:
    shares = [F.coalesce(F.try_divide(w, total), F.lit(0.0)) for w in weights]
    if criterion == "gini":
        return 1 - sum((p * p for p in shares), F.lit(0.0))
    return -sum((F.when(p > 0, p * F.ln(p)).otherwise(0.0) for p in shares), F.lit(0.0))


def best_splits(cells: DataFrame, classes: int, criterion: str, least: float | Column) -> DataFrame:
    """tree, node, test, place, gain, passed, whole: the best split of each node, of cells (tree, node, test, place, w0, w1, ...).

    A row passes a split at or above its place. Equal gains (to twelve decimals) go to the first
    test and its lowest place. ``passed`` and ``whole`` are the class weights that pass and that are there. A node
    without a split that leaves ``least`` weight on both sides has one with a null place.
    """
    w = [f"w{k}" for k in range(classes)]
    own = Window.partitionBy("tree", "node", "test")
    sums = cells.select("tree", "node", "test", "place", *[F.sum(c).over(own.orderBy(F.desc("place"))).alias(f"p{c}") for c in w], *[F.sum(c).over(own).alias(f"t{c}") for c in w])
    passed, whole = [F.col(f"p{c}") for c in w], [F.col(f"t{c}") for c in w]
    rest = [a - b for a, b in zip(whole, passed, strict=True)]
    n, m = sum(whole, F.lit(0.0)), sum(passed, F.lit(0.0))
    gain = _impurity(whole, n, criterion) - F.try_divide(m, n) * _impurity(passed, m, criterion) - F.try_divide(n - m, n) * _impurity(rest, n - m, criterion)
    fits = (F.col("place") > 0) & (m >= least) & (n - m >= least)
    scored = sums.select("tree", "node", "test", F.when(fits, F.col("place")).alias("place"), F.when(fits, F.round(gain, 12)).alias("gain"), F.array(*passed).alias("passed"), F.array(*whole).alias("whole"))
    first = F.struct((-F.coalesce("gain", F.lit(-1.0))).alias("loss"), "test", F.coalesce("place", F.lit(1 << 30)).alias("at"))
    best = scored.groupBy("tree", "node").agg(F.min_by(F.struct("test", "place", "gain", "passed", "whole"), first).alias("s"))
    return best.select("tree", "node", "s.*")


def _heaviest(weights: list[float], classes: list[str]) -> str:
    return classes[max(range(len(classes)), key=lambda k: (weights[k], -k))]


def _walk(lookup: Column, most: int):
    """The step of a row from a node to its child, or to itself where the node has no split."""

    def step(n: Column, _: Column) -> Column:
        s = F.try_element_at(lookup, (F.col("tree") * most + n).cast("string"))
        return F.when(s.isNull(), n).otherwise(2 * n + F.when(F.get("code", s["test"]) >= s["place"], 0).otherwise(1))

    return step


def grow(
    data: Coded, trees: int = 1, depth: int | list[int] = 3, weight: Column | None = None, tests_per_node: int | None = None, criterion: str = "gini", least: float | list[float] = 1.0, seed: int = 1
) -> tuple[list[Tree], dict]:
    """``trees`` trees at once, level by level, and their splits by (tree, node); node 1 is a root, 2n and 2n + 1 the children of n.

    ``weight`` is an array with a weight of the row for each tree; 1 without it. A node looks at
    ``tests_per_node`` tests, drawn for it by ``seed``, or at all. ``depth`` and ``least`` may differ by tree.
    """
    depths = [depth] * trees if isinstance(depth, int) else depth
    floor = least if isinstance(least, (int, float)) else F.element_at(F.array(*[F.lit(float(x)) for x in least]), F.col("tree") + 1)
    depth = max(depths)
    k, most = len(data.classes), 2 ** (depth + 1)
    if not k:  # no row has a label
        return [Tree(Leaf("")) for _ in range(trees)], {}
    weight = F.array_repeat(F.lit(1.0), trees) if weight is None else weight
    splits: dict[tuple[int, int], tuple | None] = {}
    active = [(t, 1) for t in range(trees)]
    for level in range(max(depth, 1)):  # a tree of depth 0 needs the weights of its root
        if not active:
            break
        chosen = {}
        for t, n in active:
            few = np.random.default_rng([seed, t, n]).choice(len(data.tests), tests_per_node, replace=False) if tests_per_node and tests_per_node < len(data.tests) else range(len(data.tests))
            chosen[t * most + n] = sorted(int(i) for i in few)
        looks = F.from_json(F.lit(json.dumps({str(a): b for a, b in chosen.items()})), "map<string,array<int>>")
        made = {str(t * most + n): {"test": s[0], "place": s[1]} for (t, n), s in splits.items() if s and s[1] is not None}
        lookup = F.from_json(F.lit(json.dumps(made)), "map<string,struct<test:int,place:int>>")
        rows = data.rows.select("y", "code", F.posexplode(weight).alias("tree", "w")).where("w > 0")
        node = F.aggregate(F.array_repeat(F.lit(0), level), F.lit(1), _walk(lookup, most))
        rows = rows.withColumn("node", node).select("tree", "node", "y", "w", "code", F.explode(F.try_element_at(looks, (F.col("tree") * most + F.col("node")).cast("string"))).alias("test"))
        cells = rows.groupBy("tree", "node", "test", F.get("code", "test").alias("place")).agg(*[F.sum(F.when(F.col("y") == j, F.col("w")).otherwise(0.0)).alias(f"w{j}") for j in range(k)])
        found = {(r["tree"], r["node"]): r for r in best_splits(cells, k, criterion, floor).collect()}  # a row for each node
        active = []
        for at, r in found.items():
            use = r["place"] is not None and r["gain"] > 0 and level < depths[at[0]]
            splits[at] = (r["test"], r["place"] if use else None, r["gain"], r["passed"], r["whole"])
            if use and level + 1 < depths[at[0]]:
                for child, side in ((0, r["passed"]), (1, [a - b for a, b in zip(r["whole"], r["passed"], strict=True)])):
                    if sum(x > 1e-12 for x in side) > 1:
                        active.append((at[0], 2 * at[1] + child))
        active.sort()

    def build(t: int, n: int, weights: list[float] | None):
        s = splits.get((t, n))
        if s is None or s[1] is None:
            weights = s[4] if s else weights
            return Leaf(_heaviest(weights, data.classes) if weights else data.classes[0] if data.classes else "")
        rest = [a - b for a, b in zip(s[4], s[3], strict=True)]
        return Branch(data.condition(s[0], s[1]), build(t, 2 * n, s[3]), build(t, 2 * n + 1, rest))

    return [Tree(build(t, 1, None)) for t in range(trees)], splits


def learn_tree(df: DataFrame, tests: list[ModalTest], label: str, row_id: str, depth: int = 3, bins: int = 16, criterion: str = "gini", least: float = 1.0) -> Tree:
    """A modal tree; its conditions are applied to the series like any others. Nulls pass no test."""
    data = coded(df, tests, label, row_id, bins)
    try:
        return grow(data, 1, depth, criterion=criterion, least=least)[0][0]
    finally:
        data.rows.unpersist()


def drawn_weights(n_trees: int, seed: int) -> Column:
    """How often each tree draws a row, by a digest of its id."""
    drawn = lambda t: F.conv(F.substring(F.md5(F.concat_ws("|", "id", F.lit(seed), t)), 1, 12), 16, 10).cast("double") / float(1 << 48)
    times = lambda t: sum(((drawn(t) >= p).cast("double") for p in _POISSON), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), times)


def learn_forest(df: DataFrame, tests: list[ModalTest], label: str, row_id: str, n_trees: int = 10, depth: int = 3, bins: int = 16, tests_per_node: int | None = None, criterion: str = "gini", least: float = 1.0, seed: int = 1) -> Ensemble:
    """A forest of modal trees, all grown together: rows are drawn by a hash of their id, tests by node (the root of their number)."""
    data = coded(df, tests, label, row_id, bins)
    try:
        weight = drawn_weights(n_trees, seed)
        found, _ = grow(data, n_trees, depth, weight, tests_per_node or max(1, round(math.sqrt(len(tests)))), criterion, least, seed)
        return Ensemble(tuple(found))
    finally:
        data.rows.unpersist()


def learn_stagewise(df: DataFrame, tests: list[ModalTest], label: str, row_id: str, rounds: int = 10, bins: int = 16, criterion: str = "gini") -> StageWise:
    """Multi-class stage-wise boosting of modal stumps, one aggregate a round.

    Weights start at 1; a round's weighted error e comes from the sums of its split. A round with
    e >= 1 - 1/K ends it, as the same weights would give the same stump again; its coefficient is log((1 - e) / e) + log(K - 1), and misses are
    multiplied by its exponential. An error below 1e-6 is the last round. The weight of a row is an
    expression of the rounds so far, by its codes.
    """
    data = coded(df, tests, label, row_id, bins)
    try:
        k = len(data.classes)
        trees, coefficients, gains, past = [], [], {}, []
        for _ in range(rounds):
            weight = F.lit(1.0)
            if past:
                made = F.from_json(F.lit(json.dumps(past)), "array<struct<test:int,place:int,yes:int,no:int,factor:double>>")
                said = lambda r: F.when(F.get("code", r["test"]) >= r["place"], r["yes"]).otherwise(r["no"])
                weight = F.aggregate(made, F.lit(1.0), lambda w, r: w * F.when(said(r) == F.col("y"), 1.0).otherwise(r["factor"]))
            found, splits = grow(data, 1, 1, F.array(weight), None, criterion, 0.0)
            s = splits.get((0, 1))
            if s is None:
                break
            total = sum(s[4])
            rest = [a - b for a, b in zip(s[4], s[3], strict=True)]
            right = max(s[4]) if s[1] is None else max(s[3]) + max(rest)
            error = 1 - right / total
            if error >= 1 - 1 / k:
                break
            coefficient = math.log((1 - error) / max(error, 1e-12)) + math.log(max(k - 1, 1))
            trees.append(found[0])
            coefficients.append(coefficient)
            if s[1] is None:
                break
            name = str(data.condition(s[0], s[1]))
            gains[name] = gains.get(name, 0.0) + s[2]
            if error < 1e-6:
                break
            yes, no = (max(range(k), key=lambda j, side=side: (side[j], -j)) for side in (s[3], rest))
            past.append({"test": s[0], "place": s[1], "yes": yes, "no": no, "factor": math.exp(coefficient)})
        whole = sum(gains.values()) or 1.0
        return StageWise(tuple(trees), tuple(coefficients), {f: g / whole for f, g in sorted(gains.items(), key=lambda x: (-x[1], x[0]))})
    finally:
        data.rows.unpersist()
