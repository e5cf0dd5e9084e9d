"""Symbolic models: leaves, branches, ensembles, rules, lists; applied as compiled columns.

Applying a branch evaluates its condition once per row inside one expression; a row on which
the condition does not hold, NaN and null included, goes to the negative side. Forests with
more than ``CASE_TREES`` trees are scored in Arrow batches instead, as an expression of that
size costs more to compile than it saves.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .conditions import DUALS, And, Formula, RangeCondition, ScalarCondition, Truth, conjunction, normalize, simplify

CASE_TREES = 20


class Model:
    def column(self, single: bool = False) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Leaf(Model):
    """A constant outcome, with the raw score of a boosted leaf if it has one."""

    outcome: str | float | None
    score: float | None = None

    def column(self, single: bool = False) -> Column:
        return F.lit(self.outcome)


@dataclass(frozen=True)
class FunctionLeaf(Model):
    """An outcome computed from the row."""

    name: str
    make: Callable[[], Column]

    def column(self, single: bool = False) -> Column:
        return self.make()


@dataclass(frozen=True)
class Branch(Model):
    condition: Formula
    positive: Model
    negative: Model

    def column(self, single: bool = False) -> Column:
        return F.when(self.condition.column(single), self.positive.column(single)).otherwise(self.negative.column(single))


@dataclass(frozen=True)
class Rule(Model):
    """An outcome for the rows that satisfy the antecedent, null for others."""

    antecedent: Formula
    consequent: Model

    def column(self, single: bool = False) -> Column:
        return F.when(self.antecedent.column(single), self.consequent.column(single))


@dataclass(frozen=True)
class DecisionList(Model):
    """The first rule whose antecedent holds decides, else the default."""

    rules: tuple[Rule, ...]
    default: Model

    def column(self, single: bool = False) -> Column:
        out = self.default.column(single)
        for r in reversed(self.rules):
            out = F.when(r.antecedent.column(single), r.consequent.column(single)).otherwise(out)
        return out


@dataclass(frozen=True)
class Tree(Model):
    root: Model

    def column(self, single: bool = False) -> Column:
        return self.root.column(single)


@dataclass(frozen=True)
class Ensemble(Model):
    """Trees with optional weights; labels are voted, numbers averaged."""

    trees: tuple[Tree, ...]
    weights: tuple[float, ...] | None = None
    numeric: bool = False
    vote: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if not self.trees:
            raise ValueError("an ensemble needs a tree")
        if self.weights is not None and len(self.weights) != len(self.trees):
            raise ValueError("an ensemble needs one weight for each tree")

    def predictions(self, single: bool = False) -> Column:
        return F.array(*[t.column(single) for t in self.trees])

    def column(self, single: bool = False) -> Column:
        if self.vote is None and not self.numeric:
            counted = _counted_votes(self, single)
            if counted is not None:
                return counted
        votes = self.predictions(single)
        if self.vote is not None:
            return self.vote(votes)
        if self.numeric:
            return weighted_mean(votes, self.weights)
        return majority(votes, self.weights)


@dataclass(frozen=True)
class MixedModel(Model):
    """A model whose branches may hold any other model."""

    root: Model

    def column(self, single: bool = False) -> Column:
        return self.root.column(single)


#: Bits that hold one label's votes in a packed count.
VOTE_BITS = 6


def _counted_votes(m: Ensemble, single: bool) -> Column | None:
    """The vote from counts of the labels that the leaves have, all in compiled code.

    Each tree yields one in its label's bits of a long, so that the sum of the trees holds all
    counts; with weights each label has a sum of its own. None if the trees have other leaves than
    constant ones, or too many labels or trees for that.
    """
    every = [n for t in m.trees for n in nodes(t.root)]
    if not all(isinstance(n, (Branch, Leaf)) for n in every):
        return None
    labels = sorted({n.outcome for n in every if isinstance(n, Leaf) and n.outcome is not None})

    def with_leaves(t: Model, value) -> Column:
        if isinstance(t, Leaf):
            return value(t.outcome)
        return F.when(t.condition.column(single), with_leaves(t.positive, value)).otherwise(with_leaves(t.negative, value))

    if not labels:
        return None
    if m.weights is None and len(labels) * VOTE_BITS < 63 and len(m.trees) < 1 << VOTE_BITS:
        one = {k: F.lit(1 << (VOTE_BITS * i)).cast("long") for i, k in enumerate(labels)} | {None: F.lit(0).cast("long")}
        packed = functools.reduce(operator.add, (with_leaves(t.root, one.__getitem__) for t in m.trees))
        sums = [F.shiftright(packed, VOTE_BITS * i).bitwiseAND(F.lit((1 << VOTE_BITS) - 1)) for i in range(len(labels))]
    elif m.weights is not None and len(labels) * len(every) <= 400:
        own = lambda k, w: lambda x: F.lit(float(w) if x == k else 0.0)
        sums = [functools.reduce(operator.add, (with_leaves(t.root, own(k, w)) for t, w in zip(m.trees, m.weights, strict=True))) for k in labels]
    else:
        return None
    best = F.greatest(*sums) if len(sums) > 1 else sums[0]
    out = F.when(best <= 0, F.lit(None).cast("string") if isinstance(labels[0], str) else F.lit(None))
    for k, x in zip(labels, sums, strict=True):
        out = out.when(x == best, F.lit(k))
    return out


def majority(votes: Column, weights: tuple[float, ...] | None = None) -> Column:
    """The label with the largest count or weight; of equal ones the smallest."""
    w = F.array(*[F.lit(float(x)) for x in weights]) if weights is not None else F.transform(votes, lambda _: F.lit(1.0))
    pairs = F.zip_with(votes, w, lambda v, x: F.struct(v.alias("label"), x.alias("w")))
    keys = F.array_sort(F.array_distinct(F.filter(votes, lambda v: v.isNotNull())))

    def total(k: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.when(p["label"] == k, p["w"]).otherwise(0.0))

    sums = F.transform(keys, total)
    return F.try_element_at(keys, F.array_position(sums, F.array_max(sums)).cast("int"))


def weighted_mean(values: Column, weights: tuple[float, ...] | None = None) -> Column:
    """Mean of an array of numbers, nulls left out; null if nothing is left."""
    if weights is None:
        kept = F.filter(values, lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), F.size(kept))
    w = F.array(*[F.lit(float(x)) for x in weights])
    parts = F.filter(F.zip_with(values, w, lambda v, x: F.struct((v * x).alias("p"), x.alias("w"))), lambda s: s["p"].isNotNull())
    return F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, s: a + s["p"]), F.aggregate(parts, F.lit(0.0), lambda a, s: a + s["w"]))


def parity_first(votes: Column) -> Column:
    """Alternative votes: the smallest label that occurs."""
    return F.array_min(votes)


# -- conversion and relational form -----------------------------------------------------


@dataclass(frozen=True)
class RawNode:
    """A learner's node: feature number, value, children; or a leaf's class number."""

    feature: int | None = None
    value: float | None = None
    left: RawNode | None = None
    right: RawNode | None = None
    majority: int | None = None


def convert(raw: RawNode, features: list[str], classes: list[str] | None = None, op: str = "<") -> Tree:
    """A learner's tree as a symbolic one: feature op value goes to the left child."""

    def walk(n: RawNode) -> Model:
        if n.left is None or n.right is None:
            return Leaf(classes[n.majority] if classes is not None else n.majority)
        return Branch(ScalarCondition(features[n.feature], op, n.value), walk(n.left), walk(n.right))

    return Tree(walk(raw))


def convert_ensemble(raws: list[RawNode], features: list[str], classes: list[str] | None = None, weights=None, op: str = "<") -> Ensemble:
    return Ensemble(tuple(convert(r, features, classes, op) for r in raws), None if weights is None else tuple(weights), numeric=classes is None)


NODE_SCHEMA = (
    "model_id string, tree_id int, node_id int, parent_id int, is_leaf boolean, feature string, op string, threshold double, "
    "pos_child int, neg_child int, outcome string, leaf_value float, weight double"
)


def to_table(spark: SparkSession, model: Model, model_id: str) -> DataFrame:
    """The nodes of a tree or an ensemble of scalar trees, numbered in preorder."""
    trees = model.trees if isinstance(model, Ensemble) else (model if isinstance(model, Tree) else Tree(model),)
    weights = (model.weights if isinstance(model, Ensemble) else None) or (1.0,) * len(trees)
    rows: list[tuple] = []
    for t, (tree, w) in enumerate(zip(trees, weights, strict=True)):
        count = itertools.count()

        def walk(n: Model, parent: int | None, t=t, w=w, count=count) -> int:
            i = next(count)
            if isinstance(n, Leaf):
                numeric = isinstance(n.outcome, (int, float))
                value = n.score if n.score is not None else float(n.outcome) if numeric else None
                rows.append((model_id, t, i, parent, True, None, None, None, None, None, None if n.outcome is None else str(n.outcome), value, w))
            elif isinstance(n, Branch) and isinstance(n.condition, ScalarCondition):
                place = len(rows)
                rows.append(())
                pos, neg = walk(n.positive, i), walk(n.negative, i)
                rows[place] = (model_id, t, i, parent, False, n.condition.feature, n.condition.op, n.condition.threshold, pos, neg, None, None, w)
            else:
                raise TypeError(f"no scalar tree node: {n!r}")
            return i

        walk(tree.root, None)
    return spark.createDataFrame(rows, NODE_SCHEMA)


def from_table(nodes: DataFrame, numeric: bool = False) -> Ensemble:
    """The ensemble of a node table of one model (models are small)."""
    by_tree: dict[int, dict[int, object]] = {}
    for r in nodes.collect():
        by_tree.setdefault(r["tree_id"], {})[r["node_id"]] = r

    def build(tree: dict, i: int) -> Model:
        r = tree[i]
        if r["is_leaf"]:
            return Leaf(float(r["outcome"]) if numeric and r["outcome"] is not None else r["outcome"], r["leaf_value"])
        return Branch(ScalarCondition(r["feature"], r["op"], r["threshold"]), build(tree, r["pos_child"]), build(tree, r["neg_child"]))

    trees = [by_tree[k] for k in sorted(by_tree)]
    return Ensemble(tuple(Tree(build(t, 0)) for t in trees), tuple(t[0]["weight"] for t in trees), numeric)


# -- application ------------------------------------------------------------------------


def apply_model(df: DataFrame, model: Model, name: str = "prediction", single: bool = False) -> DataFrame:
    """``df`` with the model's prediction; one pass, no shuffle."""
    if isinstance(model, Ensemble) and len(model.trees) > CASE_TREES and model.vote is None and _scalar(model):
        return _apply_batched(df, model, name, single)
    return df.withColumn(name, model.column(single))


def _scalar(model: Ensemble) -> bool:
    return all(isinstance(n, Leaf) or (isinstance(n, Branch) and isinstance(n.condition, ScalarCondition)) for t in model.trees for n in nodes(t.root))


def nodes(m: Model) -> Iterator[Model]:
    """Every model inside ``m``, itself first, positive sides before negative ones."""
    yield m
    for s in submodels(m):
        yield from nodes(s)


class _FlatTrees:
    """Trees as arrays of nodes, all stepped through together for many rows at a time."""

    def __init__(self, model: Ensemble, features: list[str], single: bool):
        self.labels = sorted({n.outcome for t in model.trees for n in nodes(t.root) if isinstance(n, Leaf)}, key=lambda x: (x is None, x))
        code = {k: i for i, k in enumerate(self.labels)}
        rows: list[list] = []

        def add(n: Model) -> int:
            i = len(rows)
            rows.append([0, 0.0, "<", i, i, 0])
            if isinstance(n, Leaf):
                rows[i][5] = code[n.outcome]
            else:
                rows[i][:3] = features.index(n.condition.feature), n.condition.threshold, n.condition.op
                rows[i][3], rows[i][4] = add(n.positive), add(n.negative)
            return i

        self.roots = np.array([add(t.root) for t in model.trees], np.int32)
        self.depth = max(height(t) for t in model.trees)
        feature, threshold, op, pos, neg, leaf = zip(*rows, strict=True)
        self.feature, self.leaf = np.array(feature, np.int32), np.array(leaf, np.int32)
        self.threshold = np.array(threshold, np.float32 if single else np.float64)
        self.next = np.stack([np.array(neg, np.int32), np.array(pos, np.int32)]).ravel()  # by 0 and 1
        self.n, self.op = len(rows), np.array(op)
        self.ops = sorted({o for o, i, j in zip(op, pos, range(len(rows)), strict=True) if i != j})
        self.of_op = {o: self.op == o for o in self.ops}

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Leaf codes, one column for each tree; NaN passes no test."""
        from .conditions import OPERATORS

        flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x), dtype=np.int64)[:, None] * x.shape[1]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        unknown = np.isnan(x).any()
        for _ in range(self.depth):
            value, threshold = flat[base + self.feature[at]], self.threshold[at]
            if len(self.ops) == 1:
                holds = OPERATORS[self.ops[0]](value, threshold)
            else:
                holds = np.zeros(at.shape, bool)
                for o in self.ops:
                    holds |= self.of_op[o][at] & OPERATORS[o](value, threshold)
            if unknown:
                holds &= ~np.isnan(value)
            at = self.next[at + holds * np.int32(self.n)]
        return self.leaf[at]


#: Rows that are stepped through together.
BLOCK_ROWS = 4_096


def _apply_batched(df: DataFrame, model: Ensemble, name: str, single: bool) -> DataFrame:
    features = sorted({n.condition.feature for t in model.trees for n in nodes(t.root) if isinstance(n, Branch)})
    flat = _FlatTrees(model, features, single)
    weights = np.array(model.weights or (1.0,) * len(model.trees))

    @F.pandas_udf("double" if model.numeric else "string")
    def predict(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(np.float32 if single else np.float64, na_value=np.nan) for c in columns], axis=1)
        out = np.empty(len(x), float if model.numeric else np.int64)
        for lo in range(0, len(x), BLOCK_ROWS):
            codes = flat.codes(x[lo : lo + BLOCK_ROWS])
            if model.numeric:
                out[lo : lo + BLOCK_ROWS] = np.array(flat.labels, float)[codes] @ weights / weights.sum()
            else:
                out[lo : lo + BLOCK_ROWS] = np.stack([(codes == k) @ weights for k in range(len(flat.labels))], axis=1).argmax(axis=1)
        return pd.Series(out if model.numeric else np.array(flat.labels, object)[out])

    return df.withColumn(name, predict(*[F.col(f"`{f}`").cast("double") for f in features]))


def collect_predictions(df: DataFrame, model: Model, name: str = "predictions", mode: str = "append", leaves_only: bool = False) -> DataFrame:
    """``df`` with an array of predictions to which the model's is added, or which it replaces.

    With ``leaves_only`` an ensemble adds the outcomes of its trees' leaves instead of its vote. A table
    without the column starts with an empty array; other modes than append and replace raise.
    """
    if mode not in ("append", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    if leaves_only and isinstance(model, Ensemble):
        new = F.transform(model.predictions(), lambda x: x.cast("string"))
    else:
        new = F.array(model.column().cast("string"))
    old = F.coalesce(F.col(f"`{name}`"), F.array().cast("array<string>")) if mode == "append" and name in df.columns else F.array().cast("array<string>")
    return df.withColumn(name, F.concat(old, new))


def with_supports(df: DataFrame, tree: Tree, name: str = "path") -> DataFrame:
    """``df`` with the path of each row through the tree: '' at the root, then p or n for each step."""

    def walk(m: Model, path: str) -> Column:
        if not isinstance(m, Branch):
            return F.lit(path)
        return F.when(m.condition.column(), walk(m.positive, path + "p")).otherwise(walk(m.negative, path + "n"))

    return df.withColumn(name, walk(tree.root, ""))


def node_supports(df: DataFrame, tree: Tree, label: str) -> DataFrame:
    """path, label, n: labels of the rows that reach each node."""
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda k: F.col("path").substr(F.lit(1), k))
    counted = with_supports(df, tree).groupBy("path", F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counted.select(F.explode(prefixes).alias("node"), "label", "n").groupBy("node", "label").agg(F.sum("n").alias("n")).withColumnRenamed("node", "path")


# -- introspection ----------------------------------------------------------------------


def submodels(m: Model) -> list[Model]:
    if isinstance(m, Branch):
        return [m.positive, m.negative]
    if isinstance(m, Rule):
        return [m.consequent]
    if isinstance(m, DecisionList):
        return [*m.rules, m.default]
    if isinstance(m, (Tree, MixedModel)):
        return [m.root]
    return list(m.trees) if isinstance(m, Ensemble) else []


def leaves(m: Model) -> list[Model]:
    return [n for n in nodes(m) if isinstance(n, (Leaf, FunctionLeaf))]


def height(m: Model) -> int:
    """Conditions on the longest way to a leaf."""
    own = 1 if isinstance(m, (Branch, Rule)) else 0
    return own + max((height(s) for s in submodels(m)), default=0)


def is_complete(m: Model) -> bool:
    """Whether every row gets an outcome."""
    return not isinstance(m, Rule) and all(is_complete(s) for s in submodels(m)) if not isinstance(m, DecisionList) else is_complete(m.default)


def immediate_rules(m: Branch) -> list[Rule]:
    return [Rule(m.condition, m.positive), Rule(m.condition.dual, m.negative)]


# -- rules of a model -------------------------------------------------------------------


@dataclass
class RuleOptions:
    """How antecedents are shaped: simplified, with ranges, normalised; or left as the path."""

    simplify: bool = False
    ranges: bool = False
    normalize: bool = False
    flip_atoms: bool = True
    rotate: bool = False
    most_products: int = 10_000
    extra: dict = field(default_factory=dict)


def _shaped(f: Formula, o: RuleOptions) -> Formula:
    f = normalize(f, o.flip_atoms, o.rotate) if o.normalize else f
    return simplify(f, o.ranges) if o.simplify else f


def list_rules(m: Model, options: RuleOptions | None = None) -> list[Rule]:
    """One rule for each way to a leaf: the atom on the positive side, its dual on the negative.

    A row that is NaN in a tested feature satisfies neither atom and thus no rule below. The
    rules of an ensemble are the products of its trees' rules, contradictions left out, with
    the vote as outcome; more than ``most_products`` raise a ValueError.
    """
    o = options or RuleOptions()
    if isinstance(m, Ensemble):
        return _product_rules(m, o)
    return [Rule(_shaped(r.antecedent, o), r.consequent) for r in _paths(m, [])]


def _paths(m: Model, held: list[Formula]) -> Iterator[Rule]:
    if isinstance(m, Branch):
        yield from _paths(m.positive, [*held, m.condition])
        yield from _paths(m.negative, [*held, m.condition.dual])
    elif isinstance(m, Rule):
        yield from _paths(m.consequent, [*held, m.antecedent])
    elif isinstance(m, DecisionList):
        before: list[Formula] = []
        for r in m.rules:
            yield from _paths(r, [*held, *before])
            before.append(r.antecedent.dual)
        yield from _paths(m.default, [*held, *before])
    elif isinstance(m, (Tree, MixedModel)):
        yield from _paths(m.root, held)
    elif isinstance(m, Ensemble):
        yield from (Rule(conjunction([*held, r.antecedent]), r.consequent) for r in list_rules(m))
    else:
        yield Rule(conjunction(held), m)


def _product_rules(m: Ensemble, o: RuleOptions) -> list[Rule]:
    weights = m.weights or (1.0,) * len(m.trees)
    partial: list[tuple[Formula, tuple]] = [(Truth(True), ())]
    for t in m.trees:
        grown = []
        for ante, outs in partial:
            for r in _paths(t, []):
                joined = conjunction([ante, r.antecedent])
                if simplify(joined) != Truth(False):
                    grown.append((joined, (*outs, r.consequent.outcome)))
        if len(grown) > o.most_products:
            raise ValueError(f"more than {o.most_products} rules; list the trees' rules with union_rules instead")
        partial = grown
    return [Rule(_shaped(a, o), Leaf(_vote(outs, weights, m.numeric))) for a, outs in partial]


def _vote(outcomes: tuple, weights: tuple, numeric: bool):
    if numeric:
        return sum(o * w for o, w in zip(outcomes, weights, strict=True)) / sum(weights)
    totals: dict = {}
    for o, w in zip(outcomes, weights, strict=True):
        totals[o] = totals.get(o, 0.0) + w
    return min(totals, key=lambda k: (-totals[k], k))


def union_rules(m: Ensemble, options: RuleOptions | None = None) -> list[Rule]:
    """The distinct rules of all trees, in order of their first place."""
    o = options or RuleOptions()
    return list({(str(r.antecedent), str(r.consequent)): r for t in m.trees for r in list_rules(t, o)}.values())


def rule_tables(spark: SparkSession, rules: list[Rule], model_id: str) -> tuple[DataFrame, DataFrame]:
    """(rule, rule_atom): the rules of a model in relational form."""
    heads, atoms = [], []
    for i, r in enumerate(rules):
        parts = r.antecedent.parts if isinstance(r.antecedent, And) else (() if isinstance(r.antecedent, Truth) else (r.antecedent,))
        heads.append((model_id, i, 0, len(parts), str(r.consequent.outcome)))
        for k, a in enumerate(parts):
            if isinstance(a, ScalarCondition):
                atoms.append((i, k, a.feature, a.op, a.threshold, None, None, None, None))
            elif isinstance(a, RangeCondition):
                atoms.append((i, k, a.feature, "in", None, a.low, a.high, a.low_closed, a.high_closed))
            else:
                raise TypeError(f"no scalar atom: {a}")
    head = "model_id string, rule_id int, tree_id int, n_atoms int, consequent string"
    return spark.createDataFrame(heads, head), spark.createDataFrame(atoms, "rule_id int, pos int, feature string, op string, threshold double, lo double, hi double, lo_incl boolean, hi_incl boolean")


# -- text -------------------------------------------------------------------------------


def describe(m: Model, digits: int | None = None, depth: int | None = None, indent: str = "", metrics: Callable[[Model], str] | None = None) -> str:
    """A model as indented text, to ``depth`` levels, with a note for each model if asked."""
    note = f"  [{metrics(m)}]" if metrics else ""
    if isinstance(m, Leaf):
        return f"{m.outcome}{note}"
    if isinstance(m, FunctionLeaf):
        return f"f:{m.name}{note}"
    if depth is not None and depth <= 0:
        return f"…{note}"
    below = None if depth is None else depth - 1
    inner = indent + "   "
    sub = lambda x: describe(x, digits, below, inner, metrics)
    if isinstance(m, Branch):
        return f"{m.condition.render(digits)}{note}\n{indent}✔ {sub(m.positive)}\n{indent}✘ {sub(m.negative)}"
    if isinstance(m, Rule):
        return f"{m.antecedent.render(digits)}  ↣  {sub(m.consequent)}{note}"
    if isinstance(m, DecisionList):
        lines = [f"{indent}[{i}/{len(m.rules)}] {sub(r)}" for i, r in enumerate(m.rules, 1)]
        return "\n".join([f"list of {len(m.rules)} rules{note}", *lines, f"{indent}else {sub(m.default)}"])
    if isinstance(m, Ensemble):
        lines = [f"{indent}[{i}/{len(m.trees)}]{'' if m.weights is None else f' (w {m.weights[i - 1]:g})'} {sub(t)}" for i, t in enumerate(m.trees, 1)]
        return "\n".join([f"ensemble of {len(m.trees)} trees{note}", *lines])
    return sub(m.root) if isinstance(m, (Tree, MixedModel)) else repr(m)


def rules_text(rules: list[Rule], digits: int | None = 2) -> str:
    """One line for each rule."""
    return "\n".join(f"{r.antecedent.render(digits)} ↣ {describe(r.consequent)}" for r in rules)


def flipped(op: str) -> str:
    return DUALS[op]
