"""Gradient boosting, SAMME boosting, and inference for boosted trees.

Trees grow level by level: one grouped aggregate over (node, feature, value) and one running
sum give the best split of every node of a level, so a tree costs as many jobs as levels.
"""

from __future__ import annotations

import functools
import json
import math
import operator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .conditions import ScalarCondition
from .models import Branch, Ensemble, Leaf, Model, Tree, leaves, nodes


@dataclass(frozen=True)
class BoostOptions:
    """Hyperparameters with their ranges.

    A feature of up to EXACT_VALUES distinct values is split between any two of them; one of more has
    ``bins`` approximate quantiles as thresholds. Either way a row is reduced to small codes once, and a level is one
    aggregate of a row for each node, feature and code. 0 tries every distinct value.
    """

    rounds: int = 10
    eta: float = 0.3
    depth: int = 3
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    objective: str = "reg:squarederror"
    base_score: float | None = None
    bins: int = 64

    def __post_init__(self):
        for name, ok in (("rounds", self.rounds >= 1), ("eta", 0 < self.eta <= 1), ("depth", self.depth >= 0), ("reg_lambda", self.reg_lambda >= 0), ("bins", self.bins == 0 or self.bins >= 2), ("min_child_weight", self.min_child_weight >= 0)):
            if not ok:
                raise ValueError(f"{name} is out of range: {getattr(self, name)}")
        if self.objective not in OBJECTIVES:
            raise ValueError(f"unknown objective {self.objective!r}")


OBJECTIVES = ("reg:squarederror", "binary:logistic", "multi:softprob", "multi:softmax", "count:poisson", "raw")


def default_objective(n_classes: int | None) -> str:
    """Objective by the number of classes; None for a numeric target."""
    return "reg:squarederror" if n_classes is None else "binary:logistic" if n_classes == 2 else "multi:softprob"


def base_score(df: DataFrame, target: str, given: float | None) -> float:
    """The mean of the training target for -inf, 0.5 for None, else what is given."""
    if given is None:
        return 0.5
    return float(df.agg(F.avg(target)).first()[0]) if given == -math.inf else given


def gradient(prediction: str, target: str) -> tuple[Column, Column]:
    """Gradient and hessian of the squared error."""
    return F.col(prediction) - F.col(target), F.lit(1.0)


def leaf_weight(g: Column, h: Column, reg_lambda: float) -> Column:
    return -g / (h + F.lit(float(reg_lambda)))


def split_gain(gl: Column, hl: Column, g: Column, h: Column, reg_lambda: float) -> Column:
    """Half the gain in squared gradient sums of a split against its node."""
    lam = F.lit(float(reg_lambda))
    gr, hr = g - gl, h - hl
    return F.lit(0.5) * (gl * gl / (hl + lam) + gr * gr / (hr + lam) - g * g / (h + lam))


def quantile_cuts(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Up to bins - 1 distinct thresholds for each feature, from one approximate aggregate."""
    probs = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), probs, 10 * bins).alias(f) for f in features]).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def best_splits(
    rows: DataFrame, features: list[str], reg_lambda: float = 1.0, min_child_weight: float = 1.0, cuts: dict[str, list[float]] | None = None, ranges: dict[str, list[float]] | None = None
) -> DataFrame:
    """node, feature, threshold, gain, sums: the best split of each node with a gain above 0.

    ``rows`` has node, g, h and the features. Thresholds are midpoints of neighbouring distinct
    values in sorted order; value < threshold goes left; both sides need ``min_child_weight``.
    Of equal gains the first feature in the given order and its smallest threshold win. Rows are
    summed by value before the running sums. ``ranges`` (bounds of each feature's values, as from
    ``quantile_cuts``) cut those sums into ranges that are added up apart, so that no task holds
    the values of a feature; the result is the same. With ``cuts`` values are first replaced by the number
    of cuts at or below them.
    """
    if cuts is not None:
        return _binned_splits(rows, features, reg_lambda, min_child_weight, cuts)
    unpivoted = rows.select("node", "g", "h", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{f}`").cast("double").alias("v")) for i, f in enumerate(features)])).alias("x"))
    unpivoted = unpivoted.where("x.v is not null and not isnan(x.v)")
    sums = unpivoted.groupBy("node", F.col("x.i").alias("i"), F.col("x.v").alias("v")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return _best_of(sums, features, reg_lambda, min_child_weight, (F.col("v") + F.col("after")) / 2, ranges)


def value_range(features: list[str], ranges: dict[str, list[float]] | None) -> Column:
    """Number of the range of feature number i that the value v lies in."""
    if not ranges:
        return F.lit(0)
    out = F.lit(0)
    for i, f in enumerate(features):
        bounds = F.array(*[F.lit(float(c)) for c in ranges.get(f, [])]).cast("array<double>")
        out = F.when(F.col("i") == i, F.size(F.filter(bounds, lambda c: c <= F.col("v")))).otherwise(out)
    return out


def running_sums(sums: DataFrame, keys: list[str], values: list[str], range_of: Column) -> DataFrame:
    """``sums`` (keys, v, values) with after, the next v, and of each value its sum up to v (left_) and in all (all_)."""
    ranged = sums.withColumn("_r", range_of)
    parts = ranged.groupBy(*keys, "_r").agg(F.min("v").alias("_least"), *[F.sum(c).alias(f"_{c}") for c in values])
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("_r")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_r").alias("_rr"), F.lead("_least").over(order).alias("_next"),
        *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0.0)).alias(f"_before_{c}") for c in values], *[F.sum(f"_{c}").over(whole).alias(f"all_{c}") for c in values],
    )
    own = Window.partitionBy(*keys, "_r").orderBy("v")
    to_here = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.select(*keys, "v", "_r", F.lead("v").over(own).alias("_lead"), *[F.sum(c).over(to_here).alias(f"_to_{c}") for c in values])
    match = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)], F.col("_r") == F.col("_rr"))
    joined = rows.join(F.broadcast(parts), match)  # at most a row for each key and range
    return joined.select(*keys, "v", F.coalesce("_lead", "_next").alias("after"), *[(F.col(f"_before_{c}") + F.col(f"_to_{c}")).alias(f"left_{c}") for c in values], *[f"all_{c}" for c in values])


def _binned_splits(rows: DataFrame, features: list[str], reg_lambda: float, min_child_weight: float, cuts: dict[str, list[float]]) -> DataFrame:
    arrays = {f: F.array(*[F.lit(float(c)) for c in cuts[f]]).cast("array<double>") for f in features}
    place = lambda f: F.size(F.filter(arrays[f], lambda c: c <= F.col(f"`{f}`").cast("double"))).cast("double")
    known = lambda f: F.col(f"`{f}`").isNotNull() & ~F.isnan(F.col(f"`{f}`").cast("double"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.when(known(f), place(f)).alias("v")) for i, f in enumerate(features)])
    sums = rows.select("node", "g", "h", F.explode(cells).alias("x")).where("x.v is not null").groupBy("node", F.col("x.i").alias("i"), F.col("x.v").alias("v")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    threshold = F.element_at(F.element_at(F.array(*[arrays[f] for f in features]), F.col("i") + 1), F.col("after").cast("int"))
    return _best_of(sums, features, reg_lambda, min_child_weight, threshold, None)


def _best_of(sums: DataFrame, features: list[str], reg_lambda: float, min_child_weight: float, threshold: Column, ranges: dict[str, list[float]] | None) -> DataFrame:
    """The best split of each node from sums by (node, feature number, value)."""
    if ranges:
        run = running_sums(sums, ["node", "i"], ["g", "h"], value_range(features, ranges))
        cuts = run.select("node", "i", "v", "after", F.col("left_g").alias("gl"), F.col("left_h").alias("hl"), F.col("all_g").alias("gt"), F.col("all_h").alias("ht"))
    else:
        order = Window.partitionBy("node", "i").orderBy("v")
        whole = Window.partitionBy("node", "i")
        running = order.rowsBetween(Window.unboundedPreceding, 0)
        cuts = sums.select("node", "i", "v", F.lead("v").over(order).alias("after"), F.sum("g").over(running).alias("gl"), F.sum("h").over(running).alias("hl"), F.sum("g").over(whole).alias("gt"), F.sum("h").over(whole).alias("ht"))
    cuts = cuts.where(F.col("after").isNotNull() & (F.col("hl") >= min_child_weight) & (F.col("ht") - F.col("hl") >= min_child_weight))
    cuts = cuts.select("node", "i", threshold.alias("threshold"), split_gain(F.col("gl"), F.col("hl"), F.col("gt"), F.col("ht"), reg_lambda).alias("gain"), "gl", "hl", "gt", "ht")
    fields = ("threshold", "gl", "hl", "gt", "ht")
    best = cuts.where("gain > 0").groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("least"), "i", *fields)).alias("b"))
    return best.select("node", F.element_at(F.array(*[F.lit(f) for f in features]), F.col("b.i") + 1).alias("feature"), "b.threshold", (-F.col("b.least")).alias("gain"), *[f"b.{c}" for c in fields[1:]])


def grow_tree(rows: DataFrame, features: list[str], options: BoostOptions, cuts: dict[str, list[float]] | None = None, ranges: dict[str, list[float]] | None = None) -> Tree:
    """A tree over (g, h, features), one job for each level."""
    split: dict[str, object] = {}
    total = rows.agg(F.sum("g"), F.sum("h")).first()
    sums = {"": (total[0] or 0.0, total[1] or 0.0)}
    open_nodes = [""]
    for _ in range(options.depth):
        if not open_nodes:
            break
        node = functools.reduce(lambda acc, p: F.when(_on_path(p, split), F.lit(p)).otherwise(acc), reversed(open_nodes), F.lit(None).cast("string"))
        found = best_splits(rows.withColumn("node", node).where("node is not null"), features, options.reg_lambda, options.min_child_weight, cuts, ranges).collect()
        open_nodes = []
        for r in sorted(found, key=lambda r: r["node"]):
            p = r["node"]
            split[p] = ScalarCondition(r["feature"], "<", r["threshold"])
            sums[p + "p"], sums[p + "n"] = (r["gl"], r["hl"]), (r["gt"] - r["gl"], r["ht"] - r["hl"])
            open_nodes += [q for q in (p + "p", p + "n") if sums[q][1] >= 2 * options.min_child_weight]

    def build(p: str) -> Model:
        if p in split:
            return Branch(split[p], build(p + "p"), build(p + "n"))
        g, h = sums[p]
        value = -g / (h + options.reg_lambda) if h + options.reg_lambda else 0.0
        return Leaf(value, value)

    return Tree(build(""))


@dataclass(frozen=True)
class Codes:
    """Rows with ``_c``, the place of each feature's value (-1: none) among ``values`` or between ``cuts``."""

    rows: DataFrame
    features: list[str]
    places: list[tuple[str, list[float]]]

    def threshold(self, i: int, code: int, after: int) -> float:
        """What is below it has at most ``code``, given that ``after`` is the next code that there is."""
        kind, known = self.places[i]
        return (known[code] + known[after]) / 2 if kind == "values" else known[after - 1]


#: Distinct values up to which a feature is split between any two of them.
EXACT_VALUES = 1_024
#: Rows of a level's histogram up to which its best splits are looked for on the driver.
HISTOGRAM_ROWS = 1_000_000


def coded(rows: DataFrame, features: list[str], bins: int, most_values: int) -> Codes:
    """``rows`` reduced to codes: by value where a feature has ``most_values`` at most, else by quantiles. Nulls and NaN have no code."""
    known = lambda f: F.when(~F.isnan(f), F.col(f))
    few = rows.agg(*[F.approx_count_distinct(known(f)).alias(f"d{i}") for i, f in enumerate(features)]).first()
    maybe = [f for i, f in enumerate(features) if few[i] <= 2 * most_values]
    sets = rows.agg(*[F.sort_array(F.collect_set(known(f))).alias(f) for f in maybe]).first() if maybe else {}
    values = {f: list(sets[f]) for f in maybe if len(sets[f]) <= most_values}
    cuts = quantile_cuts(rows, [f for f in features if f not in values], bins) if len(values) < len(features) else {}
    places = [("values", values[f]) if f in values else ("cuts", cuts[f]) for f in features]
    literal = lambda a: F.from_json(F.lit(json.dumps(a)), "array<double>")
    code = lambda f, kind, a: F.array_position(literal(a), F.col(f)).cast("int") - 1 if kind == "values" else F.size(F.filter(literal(a), lambda c: c <= F.col(f)))
    columns = [F.coalesce(F.when(~F.isnan(f), code(f, *place)), F.lit(-1)) for f, place in zip(features, places, strict=True)]
    return Codes(rows.withColumn("_c", F.array(*columns)), features, places)


def _coded_splits(cells: list, codes: Codes, o: BoostOptions) -> dict[str, tuple]:
    """node: (feature number, code, threshold, gl, hl, gt, ht) of its best split with a gain above 0."""
    by: dict[tuple, list] = {}
    for r in cells:
        by.setdefault((r["node"], r["i"]), []).append((r["code"], r["g"], r["h"]))
    best: dict[str, tuple] = {}
    for (node, i), rows in by.items():
        rows.sort()
        gt, ht = (math.fsum(r[k] for r in rows) for k in (1, 2))
        gl = hl = 0.0
        for (code, g, h), (after, _, _) in zip(rows, rows[1:], strict=False):
            gl, hl = gl + g, hl + h
            if hl < o.min_child_weight or ht - hl < o.min_child_weight:
                continue
            score = lambda a, b: a * a / (b + o.reg_lambda) if b + o.reg_lambda else 0.0
            gain = 0.5 * (score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht))
            found = (-gain, i, codes.threshold(i, code, after), code, gl, hl, gt, ht)
            if gain > 0 and (node not in best or found < best[node]):
                best[node] = found
    return {n: (b[1], b[3], b[2], *b[4:]) for n, b in best.items()}


def grow_coded(rows: DataFrame, codes: Codes, options: BoostOptions) -> Tree:
    """A tree over rows (_c, g, h); a level is one aggregate of codes by node."""
    split: dict[str, tuple[int, int, float]] = {}
    sums: dict[str, tuple[float, float]] = {}
    open_nodes = [""]
    for _ in range(options.depth):
        if not open_nodes:
            break

        def at(path: str) -> Column:
            if path not in split:
                return F.lit(path) if path in open_nodes else F.lit(None).cast("string")
            i, code, _ = split[path]
            own = F.get("_c", F.lit(i))
            return F.when((own >= 0) & (own <= code), at(path + "p")).otherwise(at(path + "n"))

        cells = rows.select(at("").alias("node"), "g", "h", F.posexplode("_c").alias("i", "code")).where("node is not null and code >= 0")
        sums_by = cells.groupBy("node", "i", "code").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        found = _coded_splits(sums_by.collect(), codes, options)  # bounded by nodes, features and bins
        open_nodes = []
        for p, (i, code, threshold, gl, hl, gt, ht) in sorted(found.items()):
            split[p] = (i, code, threshold)
            sums[p + "p"], sums[p + "n"] = (gl, hl), (gt - gl, ht - hl)
            open_nodes += [q for q in (p + "p", p + "n") if sums[q][1] >= 2 * options.min_child_weight]

    def build(p: str) -> Model:
        if p in split:
            i, _, threshold = split[p]
            return Branch(ScalarCondition(codes.features[i], "<", threshold), build(p + "p"), build(p + "n"))
        if p not in sums:  # the root, without a split
            total = rows.agg(F.sum("g"), F.sum("h")).first()
            sums[p] = (total[0] or 0.0, total[1] or 0.0)
        g, h = sums[p]
        value = -g / (h + options.reg_lambda) if h + options.reg_lambda else 0.0
        return Leaf(value, value)

    return Tree(build(""))


class _Grower:
    """Grows the trees of one table: by codes where their histograms are bounded, else by sums over values."""

    def __init__(self, rows: DataFrame, features: list[str], o: BoostOptions):
        self.features, self.options = features, o
        self.cuts = self.ranges = self.codes = None
        if o.bins and len(features) * o.bins * 2 ** max(o.depth - 1, 0) <= HISTOGRAM_ROWS:
            exact = len(features) * EXACT_VALUES * 2 ** max(o.depth - 1, 0) <= HISTOGRAM_ROWS
            self.codes = coded(rows, features, o.bins, max(o.bins, EXACT_VALUES if exact else 0))
            rows = self.codes.rows.persist()
        elif o.bins:
            self.cuts = quantile_cuts(rows, features, o.bins)
        else:
            self.ranges = quantile_cuts(rows, features, VALUE_RANGES)
        self.rows = rows

    def grow(self, rows: DataFrame) -> Tree:
        if self.codes is not None:
            return grow_coded(rows, self.codes, self.options)
        return grow_tree(rows, self.features, self.options, self.cuts, self.ranges)

    def done(self) -> None:
        if self.codes is not None:
            self.rows.unpersist()


def _on_path(path: str, split: dict) -> Column:
    out = F.lit(True)
    for k, step in enumerate(path):
        holds = F.coalesce(split[path[:k]].column(), F.lit(False))
        out = out & (holds if step == "p" else ~holds)
    return out


@dataclass(frozen=True)
class Boosted:
    """base + eta * sum of trees."""

    base: float
    eta: float
    trees: tuple[Tree, ...]
    history: tuple[float, ...] = ()

    def column(self) -> Column:
        return functools.reduce(operator.add, (F.lit(float(self.eta)) * t.column() for t in self.trees), F.lit(float(self.base)))


#: Ranges that the values of a feature are added up in.
VALUE_RANGES = 64


def boost_regression(df: DataFrame, features: list[str], target: str, options: BoostOptions | None = None, watch: DataFrame | None = None) -> Boosted:
    """Squared-error boosting. The rows are kept once; a round adds one compiled tree to the residual.

    With ``watch``, a table of the same columns, ``history`` has its mean squared error after each
    number of rounds from 0.
    """
    o = options or BoostOptions()
    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y")).where("_y is not null").persist()
    try:
        base = float(rows.agg(F.avg("_y")).first()[0] or 0.0) if o.base_score is None else base_score(rows, "_y", o.base_score)
        grower = _Grower(rows, features, o)
        trees: tuple[Tree, ...] = ()
        for _ in range(o.rounds):
            now = grower.rows.withColumn("_p", Boosted(base, o.eta, trees).column())
            g, h = gradient("_p", "_y")
            trees += (grower.grow(now.withColumn("g", g).withColumn("h", h)),)
        grower.done()
        out = Boosted(base, o.eta, trees)
        if watch is None:
            return out
        errors = [F.avg(F.pow(F.col(target) - Boosted(base, o.eta, trees[:k]).column(), F.lit(2))) for k in range(len(trees) + 1)]
        return replace(out, history=tuple(watch.agg(*[e.alias(f"m{k}") for k, e in enumerate(errors)]).first()))
    finally:
        rows.unpersist()


@dataclass(frozen=True)
class BoostedClasses:
    """Trees by round and class: tree i belongs to class i mod the number of scores."""

    classes: tuple[str, ...]
    objective: str
    eta: float
    trees: tuple[Tree, ...]
    history: tuple[float, ...] = ()

    def scores(self) -> list[Column]:
        """The sum of each class, or for two classes the one of the second."""
        k = 1 if self.objective == "binary:logistic" else len(self.classes)
        none = F.lit(0.0)
        return [functools.reduce(operator.add, (F.lit(float(self.eta)) * t.column() for t in self.trees[i::k]), none) for i in range(k)]

    def probabilities(self) -> list[Column]:
        s = self.scores()
        if self.objective == "binary:logistic":
            p = 1 / (1 + F.exp(-s[0]))
            return [1 - p, p]
        top = F.greatest(*s) if len(s) > 1 else s[0]
        powers = [F.exp(x - top) for x in s]
        total = functools.reduce(operator.add, powers)
        return [x / total for x in powers]

    def apply(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the probabilities of the classes and the likeliest one; of equal ones the first."""
        out = df.withColumns({f"_p{i}": p for i, p in enumerate(self.probabilities())})
        columns = [F.col(f"_p{i}") for i in range(len(self.classes))]
        best = F.greatest(*columns) if len(columns) > 1 else columns[0]
        label = functools.reduce(lambda acc, x: acc.when(x[1] == best, F.lit(x[0])), zip(self.classes, columns, strict=True), F.when(F.lit(False), F.lit(None).cast("string")))
        return out.withColumn("probabilities", F.array(*columns)).withColumn(name, label).drop(*[f"_p{i}" for i in range(len(columns))])


def boost_classes(df: DataFrame, features: list[str], label: str, options: BoostOptions | None = None, watch: DataFrame | None = None) -> BoostedClasses:
    """Boosting for classes: logistic for two, softmax with one tree a class and round for more.

    Classes are the sorted labels; rows without a label are left out. The gradient of a score is
    p - y and its hessian p (1 - p). With ``watch`` the history has its log loss after each
    number of rounds from 0. One class alone is always predicted.
    """
    o = options or BoostOptions()
    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features], F.col(label).cast("string").alias("_y")).where("_y is not null").persist()
    try:
        classes = tuple(sorted(r[0] for r in rows.select("_y").distinct().collect()))  # one row for each class
        objective = default_objective(len(classes))
        model = BoostedClasses(classes, objective, o.eta, ())
        grower = _Grower(rows, features, o)
        shown = classes[1:] if objective == "binary:logistic" else classes
        for _ in range(o.rounds if len(classes) > 1 else 0):
            p = model.probabilities()[-len(shown) :]
            grown = ()
            for c, q in zip(shown, p, strict=True):
                now = grower.rows.withColumn("_q", q)
                now = now.withColumn("g", F.col("_q") - (F.col("_y") == c).cast("double")).withColumn("h", F.col("_q") * (1 - F.col("_q")))
                grown += (grower.grow(now),)
            model = replace(model, trees=model.trees + grown)
        grower.done()
        if watch is None:
            return model
        losses = []
        for k in range(o.rounds + 1 if len(classes) > 1 else 1):
            part = replace(model, trees=model.trees[: k * len(shown)])
            own = functools.reduce(lambda acc, x: F.when(F.col(label).cast("string") == x[0], x[1]).otherwise(acc), zip(classes, part.probabilities(), strict=True), F.lit(0.0))
            losses.append(F.avg(-F.ln(F.greatest(own, F.lit(1e-15)))).alias(f"m{k}"))
        return replace(model, history=tuple(watch.agg(*losses).first()))
    finally:
        rows.unpersist()


def regression_errors(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """mse, rmse, mae, r2 (1 - SSres / SStot)."""
    e = F.col(target).cast("double") - F.col(prediction).cast("double")
    sums = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(F.col(target).cast("double")).alias("v"))
    return sums.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide("mse", "v")).alias("r2"))


def class_scores(trees: list[Tree], n_classes: int) -> list[Column]:
    """Sum of leaf scores for each class; tree i belongs to class i mod n_classes.

    Features and thresholds are compared as 32-bit floats, as the learner did.
    """

    def raw(m: Model) -> Column:
        if isinstance(m, Leaf):
            return F.lit(float(m.score if m.score is not None else m.outcome)).cast("float")
        return F.when(m.condition.column(single=True), raw(m.positive)).otherwise(raw(m.negative))

    return [functools.reduce(operator.add, (raw(t.root) for t in trees[k::n_classes]), F.lit(0.0).cast("float")) for k in range(n_classes)]


def boosted_inference(df: DataFrame, trees: list[Tree], objective: str, classes: list[str] | None = None, base: float = 0.5, name: str = "prediction") -> DataFrame:
    """``df`` with the scores and the prediction of a boosted model.

    multi:softprob adds an array of probabilities and the label, multi:softmax the label,
    binary:logistic the probability of the second class and the label, count:poisson the
    exponential of the sum, and the others base + sum.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective!r}")
    k = len(classes) if classes and objective.startswith("multi:") else 1
    sums = class_scores(trees, k)
    if objective.startswith("multi:"):
        scores = F.array(*[s.cast("double") for s in sums])
        out = df.withColumn("_s", scores).withColumn("_m", F.array_max("_s"))
        out = out.withColumn("_e", F.transform("_s", lambda s: F.exp(s - F.col("_m")))).withColumn("_t", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
        label = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("_s", F.col("_m")).cast("int"))
        out = out.withColumn(name, label)
        if objective == "multi:softprob":
            out = out.withColumn("probabilities", F.transform("_e", lambda e: e / F.col("_t")))
        return out.drop("_s", "_m", "_e", "_t")
    total = sums[0].cast("double")
    if objective == "binary:logistic":
        out = df.withColumn("probability", 1 / (1 + F.exp(-total)))
        names = classes or ["0", "1"]
        return out.withColumn(name, F.when(F.col("probability") > 0.5, F.lit(names[1])).otherwise(F.lit(names[0])))
    return df.withColumn(name, F.exp(total) if objective == "count:poisson" else F.lit(float(base)) + total if objective != "raw" else total)


def label_boosted_leaves(df: DataFrame, trees: list[Tree], label: str) -> list[Tree]:
    """Trees whose leaves carry the majority label of the training rows that reach them.

    A leaf that no row reaches takes the label of the nearest ancestor with rows. Scores stay,
    and so does a tree of a single leaf, so that the order of trees and classes is kept.
    """
    from .models import node_supports

    out = []
    for t in trees:
        best: dict[str, tuple[int, str]] = {}
        for r in node_supports(df, t, label).where("label is not null").collect():
            key = (-r["n"], str(r["label"]))
            best[r["path"]] = min(best.get(r["path"], key), key)

        def named(m: Model, path: str) -> Model:
            if isinstance(m, Leaf):
                p = path
                while p not in best and p:
                    p = p[:-1]
                return Leaf(best[p][1] if p in best else None, m.score if m.score is not None else float(m.outcome))
            return Branch(m.condition, named(m.positive, path + "p"), named(m.negative, path + "n"))

        out.append(Tree(named(t.root, "")))
    return out


def rescaled_mean(values: Column, n_trees: int, base: float) -> Column:
    """The sum of a regression's trees from the mean of their leaves."""
    return values * F.lit(n_trees) + F.lit(float(base))


# -- SAMME ------------------------------------------------------------------------------


@dataclass(frozen=True)
class StageWise:
    """Stumps or trees with coefficients; the class with the largest sum is predicted."""

    trees: tuple[Tree, ...]
    coefficients: tuple[float, ...]
    importance: dict[str, float] = field(default_factory=dict)

    def ensemble(self) -> Ensemble:
        return Ensemble(self.trees, self.coefficients)


def weighted_stump(rows: DataFrame, features: list[str], classes: list[str], criterion: str = "gini", ranges: dict[str, list[float]] | None = None) -> tuple[Tree, str | None, float]:
    """The best single split of weighted rows (features, _y, _w): (tree, feature, gain)."""
    unpivoted = rows.select("_y", "_w", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{f}`").alias("v")) for i, f in enumerate(features)])).alias("x")).where("x.v is not null and not isnan(x.v)")
    sums = [F.sum(F.when(F.col("_y") == c, F.col("_w")).otherwise(0.0)).alias(f"s{k}") for k, c in enumerate(classes)]
    byvalue = unpivoted.groupBy(F.col("x.i").alias("i"), F.col("x.v").alias("v")).agg(*sums)
    names = [f"s{k}" for k in range(len(classes))]
    run = running_sums(byvalue, ["i"], names, value_range(features, ranges))
    cuts = run.select("i", "v", "after", F.array(*[f"left_{c}" for c in names]).alias("l"), F.array(*[f"all_{c}" for c in names]).alias("t"))
    cuts = cuts.withColumn("r", F.zip_with("t", "l", lambda a, b: F.greatest(a - b, F.lit(0.0))))

    def impurity(a: str) -> Column:
        n = F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        if criterion == "gini":
            return n - F.coalesce(F.try_divide(F.aggregate(a, F.lit(0.0), lambda x, y: x + y * y), n), F.lit(0.0))
        return -F.aggregate(a, F.lit(0.0), lambda x, y: x + F.when(y > 0, y * F.log2(y / n)).otherwise(0.0))

    best = cuts.where("after is not null").select("i", ((F.col("v") + F.col("after")) / 2).alias("threshold"), "l", "r", (impurity("t") - impurity("l") - impurity("r")).alias("gain"))
    row = best.orderBy(F.desc("gain"), "i", "threshold").limit(1).collect()
    if not row:
        totals = {r["_y"]: r["w"] for r in rows.groupBy("_y").agg(F.sum("_w").alias("w")).collect()}
        return Tree(Leaf(min(totals, key=lambda k: (-totals[k], k)))), None, 0.0
    r = row[0]
    name = lambda a: classes[max(range(len(a)), key=lambda k: (a[k], -k))]
    return Tree(Branch(ScalarCondition(features[r["i"]], "<", r["threshold"]), Leaf(name(r["l"])), Leaf(name(r["r"])))), features[r["i"]], r["gain"]


def samme(df: DataFrame, features: list[str], label: str, rounds: int = 10, criterion: str = "gini", importance: str = "impurity") -> StageWise:
    """Multi-class stage-wise boosting of stumps.

    Weights start at 1/N. A round whose weighted error is at least 1 - 1/K is left out, its
    coefficient is log((1 - e) / e) + log(K - 1), misses are multiplied by its exponential and
    weights sum to one again; it stops below an error of 1e-6. The weights are an expression of
    the rounds so far, not a stored table.
    """
    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features], F.col(label).cast("string").alias("_y")).where("_y is not null").persist()
    try:
        classes = sorted(r[0] for r in rows.select("_y").distinct().collect())
        n, k = rows.count(), len(classes)
        weight = F.lit(1.0 / max(n, 1))
        trees, coefficients, gains = [], [], {}
        ranges = quantile_cuts(rows, features, VALUE_RANGES)
        for _ in range(rounds):
            weighted = rows.withColumn("_w", weight)
            tree, feature, gain = weighted_stump(weighted, features, classes, criterion, ranges)
            miss = tree.column() != F.col("_y")
            sums = weighted.agg(F.sum(F.when(miss, F.col("_w")).otherwise(0.0)), F.sum("_w")).first()
            error = sums[0] / sums[1]
            if error >= 1 - 1 / k:
                break  # the same rows and weights would give the same stump again
            coefficient = math.log((1 - error) / max(error, 1e-12)) + math.log(max(k - 1, 1))
            trees.append(tree)
            coefficients.append(coefficient)
            if feature:
                gains[feature] = gains.get(feature, 0.0) + (gain if importance == "impurity" else 1.0)
            if error < 1e-6:
                break
            total = sums[0] * math.exp(coefficient) + sums[1] - sums[0]
            weight = weight * F.when(miss, F.lit(math.exp(coefficient))).otherwise(1.0) / F.lit(total)
        whole = sum(gains.values()) or 1.0
        return StageWise(tuple(trees), tuple(coefficients), {f: g / whole for f, g in sorted(gains.items(), key=lambda x: (-x[1], x[0]))})
    finally:
        rows.unpersist()


def split_importance(model: Ensemble | Tree) -> dict[str, float]:
    """Share of the splits that test each feature, largest first."""
    counts: dict[str, int] = {}
    for n in nodes(model):
        if isinstance(n, Branch) and isinstance(n.condition, ScalarCondition):
            counts[n.condition.feature] = counts.get(n.condition.feature, 0) + 1
    total = sum(counts.values()) or 1
    return {f: c / total for f, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))}


def leaf_scores(tree: Tree) -> list[float]:
    return [n.score for n in leaves(tree)]
