"""Folds, measures, tuning, model registry, and the analysis that ties them together.

Row order never matters: splits follow the order of a hash of the row id (or of a column that
is named), so they are the same on every run and every cluster. Ranks over all rows are taken
in two steps, within hash ranges and over the counts of the ranges, so no window collects the
table into one task.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import Ensemble, Leaf, Model, RawNode, Tree, apply_model, convert, convert_ensemble

#: Hash ranges that ranks are taken in (a power of two), and quantile ranges of a key.
RANK_RANGES = 1 << 14
KEY_RANGES = 1 << 10
EPS = 2.22e-16


def hash_order(row_id: str, seed: int) -> Column:
    return F.xxhash64(F.col(row_id), F.lit(seed))


def ranked(df: DataFrame, order: Column, row_id: str, groups: list[str] | None = None, ranges: int = RANK_RANGES) -> DataFrame:
    """``df`` with rank (from 0) by ``order`` and id, and size, in the table or in each group.

    ``order`` is a 64-bit hash, or any long; it is cut into ``ranges`` by its high bits.
    """
    groups = groups or []
    out = df.withColumn("_o", order.cast("long")).withColumn("_r", F.shiftright("_o", 64 - int(math.log2(ranges))))
    counts = out.groupBy(*groups, "_r").agg(F.count("*").alias("_n"))
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(part.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("size", F.sum("_n").over(part)).drop("_n")
    own = F.row_number().over(Window.partitionBy(*groups, "_r").orderBy("_o", row_id)) - 1
    joined = out.withColumn("_own", own).join(counts, [*groups, "_r"])
    return joined.withColumn("rank", F.col("_own") + F.col("_before")).drop("_o", "_r", "_own", "_before")


def ranked_by_key(df: DataFrame, key: str, *then: str, ranges: int = KEY_RANGES) -> DataFrame:
    """Rank by a numeric or time key, and then by other columns, instead of a hash: ranges are cut at approximate quantiles."""
    kind = dict(df.dtypes)[key]
    number = F.unix_micros(F.col(key).cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(key) if kind == "date" else F.col(key)
    keyed = df.withColumn("_k", number.cast("double"))
    cuts = sorted(set(keyed.stat.approxQuantile("_k", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    if cuts:
        from pyspark.ml.feature import Bucketizer

        out = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_k", outputCol="_r", handleInvalid="keep").transform(keyed).drop("_k")
    else:
        out = keyed.withColumn("_r", F.lit(0.0)).drop("_k")
    counts = out.groupBy("_r").agg(F.count("*").alias("_n"))
    every = Window.partitionBy(F.lit(0))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(every.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("_n").over(every)).drop("_n")
    own = F.row_number().over(Window.partitionBy("_r").orderBy(key, *then)) - 1
    return out.withColumn("_own", own).join(F.broadcast(counts), "_r").withColumn("rank", F.col("_own") + F.col("_before")).drop("_r", "_own", "_before")


def _share(n: Column, share: float) -> Column:
    """floor(n * share), of the share as it is written: as a double, 0.7 of 90 is a little less than 63."""
    return F.floor(n.cast("decimal(19,0)") * F.lit(Decimal(str(share)))).cast("long")


def holdout(df: DataFrame, row_id: str, ratio: float = 0.7, valid_ratio: float | None = None, seed: int = 1, order: Column | None = None) -> DataFrame:
    """row_id, fold, role: the first floor(n * ratio) rows train; of the others valid_ratio, then test."""
    if not 0 < ratio < 1:
        raise ValueError("ratio lies between 0 and 1")
    r = ranked(df.select(row_id), order if order is not None else hash_order(row_id, seed), row_id)
    n_train = _share(F.col("size"), ratio)
    role = F.when(F.col("rank") < n_train, "train")
    if valid_ratio is not None:
        role = role.when(F.col("rank") < n_train + _share(F.col("size") - n_train, valid_ratio), "valid")
    return r.select(row_id, F.lit(0).alias("fold"), role.otherwise("test").alias("role"))


def _roles(assigned: DataFrame, row_id: str, k: int) -> DataFrame:
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    return assigned.select(row_id, "own", folds).select(row_id, "fold", F.when(F.col("own") == F.col("fold"), "test").otherwise("train").alias("role"))


def k_fold(df: DataFrame, row_id: str, k: int = 5, seed: int = 1, order: Column | None = None) -> DataFrame:
    """row_id, own: the fold in which a row tests, blocks of near-equal size in hash order."""
    if k < 2:
        raise ValueError("at least two folds")
    r = ranked(df.select(row_id), order if order is not None else hash_order(row_id, seed), row_id)
    return r.select(row_id, F.floor(F.col("rank") * k / F.col("size")).cast("int").alias("own"))


def stratified_fold(df: DataFrame, row_id: str, label: str, k: int = 5, seed: int = 1, order: Column | None = None) -> DataFrame:
    """row_id, own: the rank within the label, modulo k."""
    r = ranked(df.select(row_id, label), order if order is not None else hash_order(row_id, seed), row_id, [label])
    return r.select(row_id, F.pmod("rank", F.lit(k)).cast("int").alias("own"))


def time_folds(df: DataFrame, row_id: str, key: str, k: int = 5) -> DataFrame:
    """row_id, fold, role: k + 1 blocks in order; fold i trains on blocks 0..i and tests on block i + 1."""
    r = ranked_by_key(df.select(row_id, key) if key != row_id else df.select(row_id), key, row_id)
    block = F.least(F.floor(F.col("rank") * (k + 1) / F.col("size")), F.lit(k)).cast("int")
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    out = r.select(row_id, block.alias("block"), folds.alias("fold")).where("block <= fold + 1")
    return out.select(row_id, "fold", F.when(F.col("block") == F.col("fold") + 1, "test").otherwise("train").alias("role"))


def fold_roles(assigned: DataFrame, row_id: str, k: int) -> DataFrame:
    """row_id, fold, role of a table (row_id, own): a row tests in its own fold and trains in the others."""
    return _roles(assigned, row_id, k)


def group_split(df: DataFrame, label: str, group_id: str, train_share: float = 0.7, order: Column | None = None, balance: bool = True) -> DataFrame:
    """``df`` with role: ids are disjoint between train and test within each label.

    Ids go to train in the order of a hash (or of a long spread over 64 bits) while the rows before them are fewer than
    ``train_share`` of the label; with ``balance`` every (role, label) is cut to the smallest.
    """
    order = order if order is not None else F.xxhash64(group_id)
    ids = df.groupBy(label, group_id).agg(F.count("*").alias("_n")).withColumn("_o", order.cast("long"))
    ids = ids.withColumn("_r", F.shiftright("_o", 64 - int(math.log2(RANK_RANGES))))
    # rows before an id: within its hash range, and by the counts of the ranges
    own = F.sum("_n").over(Window.partitionBy(label, "_r").orderBy("_o", group_id).rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy("_l")
    ahead = F.sum("_c").over(whole.orderBy("_rr").rowsBetween(Window.unboundedPreceding, -1))
    counts = ids.groupBy(F.col(label).alias("_l"), F.col("_r").alias("_rr")).agg(F.sum("_n").alias("_c"))
    counts = counts.select("_l", "_rr", F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_c").over(whole).alias("_total"))
    placed = ids.withColumn("_own", F.coalesce(own, F.lit(0))).join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_r") == F.col("_rr")))
    role = F.when(F.col("_own") + F.col("_ahead") < _share(F.col("_total"), train_share), "train").otherwise("test").alias("role")
    out = df.join(placed.select(label, group_id, role), [label, group_id])
    if not balance:
        return out
    least = out.groupBy("role", label).count().groupBy("role").agg(F.min("count").alias("_least"))
    by_row = F.xxhash64(group_id, *[c for c in df.columns if c not in (label, group_id)])
    out = ranked(out.withColumn("_row", by_row), F.col("_row"), "_row", ["role", label])
    return out.join(F.broadcast(least), "role").where("rank < _least").drop("_row", "_least", "rank", "size")


# -- measures ---------------------------------------------------------------------------


def confusion(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """label, prediction, n."""
    return df.groupBy(*(by or []), F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, label: str, prediction: str) -> Column:
    return F.avg((F.col(label) == F.col(prediction)).cast("double"))


def kappa(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """kappa = (po - pe) / (1 - pe) from a confusion table; null if pe is 1."""
    by = by or []
    total = counts.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    rows, columns = counts.groupBy(*by, F.col("label").alias("c")).agg(F.sum("n").alias("a")), counts.groupBy(*by, F.col("prediction").alias("c")).agg(F.sum("n").alias("b"))
    agree = rows.join(columns, [*by, "c"]).groupBy(*by).agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    joined = total.join(agree, by, "left") if by else total.crossJoin(agree)  # one row each
    po, pe = F.col("hit") / F.col("t"), F.coalesce("ab", F.lit(0)) / (F.col("t") * F.col("t"))
    return joined.select(*by, F.try_divide(po - pe, 1 - pe).alias("kappa"))


def log_loss(probability_of_label: Column) -> Column:
    """Mean negative log of the true label's probability, clamped at the smallest step."""
    return F.avg(-F.ln(F.least(F.greatest(probability_of_label, F.lit(EPS)), F.lit(1 - EPS))))


def brier(probabilities: Column, classes: list[str], label: str) -> Column:
    """Mean over rows of the squared distance to the label's unit vector."""
    unit = F.array(*[(F.col(label) == c).cast("double") for c in classes])
    return F.avg(F.aggregate(F.zip_with(probabilities, unit, lambda p, u: (p - u) * (p - u)), F.lit(0.0), lambda a, x: a + x))


def specificity(label: str, prediction: str, positive: str) -> Column:
    """True negatives among the rows that are not ``positive``."""
    negative = F.col(label) != positive
    return F.try_divide(F.count_if(negative & (F.col(prediction) != positive)), F.count_if(negative))


MEASURES: dict[str, tuple[Callable[[str, str], Column], str, str]] = {
    # name: (aggregate of label and prediction, task, how folds are combined)
    "accuracy": (lambda y, p: F.avg((F.col(y) == F.col(p)).cast("double")), "class", "mean"),
    "misclassification": (lambda y, p: F.avg((F.col(y) != F.col(p)).cast("double")), "class", "mean"),
    "misses": (lambda y, p: F.count_if(F.col(y) != F.col(p)).cast("double"), "class", "sum"),
    "rms": (lambda y, p: F.sqrt(F.avg(F.pow(F.col(y).cast("double") - F.col(p).cast("double"), F.lit(2)))), "number", "rms"),
    "mae": (lambda y, p: F.avg(F.abs(F.col(y).cast("double") - F.col(p).cast("double"))), "number", "mean"),
    "l2": (lambda y, p: F.avg(F.pow(F.col(y).cast("double") - F.col(p).cast("double"), F.lit(2))), "number", "mean"),
}
MEASURES |= {"l1": MEASURES["mae"], "mav": MEASURES["mae"], "rmse": MEASURES["rms"]}


#: Measures of an array of probabilities and a label, in the order of given classes.
PROBABILITY_MEASURES: dict[str, Callable[[list[str]], Column]] = {
    "log_loss": lambda classes: log_loss(F.try_element_at("probabilities", F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")).cast("int"))),
    "brier": lambda classes: brier(F.col("probabilities"), classes, "label"),
}


def operation_for(measure: str, prediction_kind: str) -> str:
    """How predictions are taken for a measure: as they are, their mode, or their mean."""
    task = "class" if measure in ("log_loss", "brier", "kappa", "confusion", "specificity") else MEASURES[measure][1] if measure in MEASURES else None
    if task is None:
        raise ValueError(f"unknown measure {measure!r}")
    if prediction_kind == "deterministic":
        if measure in ("log_loss", "brier"):
            raise ValueError(f"{measure} needs probabilities")
        return "predict"
    if prediction_kind != "probabilistic":
        raise ValueError(f"unknown prediction kind {prediction_kind!r}")
    return "predict" if measure in ("log_loss", "brier") else "predict_mode" if task == "class" else "predict_mean"


def evaluate(predictions: DataFrame, measures: list[str], custom: dict[str, Callable[[str, str], Column]] | None = None, classes: list[str] | None = None, positive: str | None = None) -> DataFrame:
    """measure, fold, value of (fold, label, prediction); fold -1 is the aggregate.

    Folds are weighted by their rows: value = sum(w * v) with w = rows of the fold / all rows;
    root mean squares are combined through their squares, and sums are added. log_loss and brier
    need a column ``probabilities`` in the order of ``classes``; specificity needs ``positive``.
    ``confusion_of`` gives the confusion tables.
    """
    custom = dict(custom or {})
    if "specificity" in measures:
        if positive is None:
            raise ValueError("specificity needs the positive class")
        custom["specificity"] = lambda y, p: specificity(y, p, positive)
    for m in measures:
        if m in PROBABILITY_MEASURES:
            if classes is None or "probabilities" not in predictions.columns:
                raise ValueError(f"{m} needs probabilities and their classes")
            custom[m] = lambda y, p, m=m: PROBABILITY_MEASURES[m](classes)
    unknown = [m for m in measures if m not in MEASURES and m not in custom and m != "kappa"]
    if unknown:
        raise ValueError(f"unknown measures {unknown}")
    plain = [m for m in measures if m != "kappa"]
    folds = predictions.groupBy("fold").agg(F.count("*").alias("_n"), *[(custom[m] if m in custom else MEASURES[m][0])("label", "prediction").cast("double").alias(m) for m in plain])
    if "kappa" in measures:
        folds = folds.join(kappa(confusion(predictions, "label", "prediction", ["fold"]), ["fold"]), "fold", "left")
    long = folds.select("fold", "_n", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value"), F.lit(MEASURES[m][2] if m in MEASURES else "mean").alias("how")) for m in measures])).alias("x")).select("fold", "_n", "x.*")
    weighted = lambda v: F.try_divide(F.sum(v * F.col("_n")), F.sum("_n"))
    value = F.when(F.first("how") == "sum", F.sum("value")).when(F.first("how") == "rms", F.sqrt(weighted(F.col("value") * F.col("value")))).otherwise(weighted(F.col("value")))
    whole = long.groupBy("measure").agg(value.alias("value")).select("measure", F.lit(-1).alias("fold"), "value")
    return long.select("measure", "fold", "value").unionByName(whole)


def confusion_of(predictions: DataFrame) -> DataFrame:
    """fold, label, prediction, n of every fold, and of all as fold -1."""
    by_fold = confusion(predictions, "label", "prediction", ["fold"])
    whole = by_fold.groupBy("label", "prediction").agg(F.sum("n").alias("n")).select(F.lit(-1).alias("fold"), "label", "prediction", "n")
    return by_fold.select("fold", "label", "prediction", "n").unionByName(whole)


# -- tuning -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Range:
    """Values of one parameter: an interval on a scale, or a list."""

    name: str
    low: float | None = None
    high: float | None = None
    scale: str = "linear"
    values: tuple = ()

    def __post_init__(self):
        if not self.values and (self.low is None or self.high is None or self.low > self.high):
            raise ValueError(f"{self.name}: an interval or values")
        if self.scale not in ("linear", "log", "log2", "log10") or (self.scale != "linear" and not self.values and self.low <= 0):
            raise ValueError(f"{self.name}: unknown scale, or a log scale from zero")

    def at(self, u: float):
        """The value at 0 <= u <= 1."""
        if self.values:
            return self.values[min(int(u * len(self.values)), len(self.values) - 1)]
        if self.scale == "linear":
            v = self.low + u * (self.high - self.low)
        else:
            v = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        return round(v) if isinstance(self.low, int) and isinstance(self.high, int) else v

    def grid(self, n: int) -> list:
        return list(self.values) if self.values else list(dict.fromkeys(self.at(i / max(n - 1, 1)) for i in range(n)))


@dataclass
class Tuning:
    """A search over parameter ranges: candidates come in rounds and may use the scores so far."""

    strategy: str = "grid"
    resolution: int = 10
    n: int = 25
    seed: int = 1
    particles: int = 3
    settings: dict = field(default_factory=dict)

    STRATEGIES = ("grid", "random", "latin_hypercube", "tree_parzen", "particle_swarm", "adaptive_swarm")

    def __post_init__(self):
        if self.strategy not in self.STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")

    def candidates(self, ranges: list[Range]) -> Iterator[dict]:
        """A generator that takes the score (lower is better) of each candidate by ``send``."""
        rng = random.Random(self.seed)
        if self.strategy == "grid":
            points = itertools.product(*[r.grid(self.resolution) for r in ranges])
            for p in itertools.islice(points, None):
                yield {r.name: v for r, v in zip(ranges, p, strict=True)}
            return
        if self.strategy == "latin_hypercube":
            slots = [rng.sample(range(self.n), self.n) for _ in ranges]
            for i in range(self.n):
                yield {r.name: r.at((s[i] + rng.random()) / self.n) for r, s in zip(ranges, slots, strict=True)}
            return
        if self.strategy == "random":
            for _ in range(self.n):
                yield {r.name: r.at(rng.random()) for r in ranges}
            return
        history: list[tuple[float, list[float]]] = []
        if self.strategy == "tree_parzen":
            for i in range(self.n):
                u = [rng.random() for _ in ranges]
                if i >= 5:
                    history.sort(key=lambda h: h[0])
                    good, poor = history[: max(2, len(history) // 4)], history[max(2, len(history) // 4) :]
                    tries = [[min(max(rng.gauss(rng.choice(good)[1][k], 0.1), 0), 1) for k in range(len(ranges))] for _ in range(16)]
                    density = lambda x, h: sum(math.exp(-sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) / 0.02) for _, y in h) / max(len(h), 1) + 1e-9
                    u = max(tries, key=lambda x: density(x, good) / density(x, poor))
                score = yield {r.name: r.at(v) for r, v in zip(ranges, u, strict=True)}
                history.append((math.inf if score is None else score, u))
            return
        swarm = [{"x": [rng.random() for _ in ranges], "v": [0.0] * len(ranges), "best": (math.inf, None)} for _ in range(self.particles)]
        lead: tuple[float, list[float] | None] = (math.inf, None)
        for i in range(self.n):
            p = swarm[i % self.particles]
            if p["best"][1] is not None:
                inertia = 0.7 if self.strategy == "particle_swarm" else 0.9 - 0.5 * i / self.n
                p["v"] = [inertia * v + 1.4 * rng.random() * (b - x) + 1.4 * rng.random() * (g - x) for v, x, b, g in zip(p["v"], p["x"], p["best"][1], lead[1], strict=True)]
                p["x"] = [min(max(x + v, 0), 1) for x, v in zip(p["x"], p["v"], strict=True)]
            score = yield {r.name: r.at(v) for r, v in zip(ranges, p["x"], strict=True)}
            s = math.inf if score is None else score
            p["best"] = min(p["best"], (s, list(p["x"])), key=lambda t: t[0]) if p["best"][1] is not None else (s, list(p["x"]))
            lead = (s, list(p["x"])) if lead[1] is None or s < lead[0] else lead


def tune(score: Callable[[dict], float], ranges: list[Range], tuning: Tuning) -> tuple[dict, list[tuple[dict, float]]]:
    """(best parameters, history); ``score`` is lower for better parameters."""
    history: list[tuple[dict, float]] = []
    gen = tuning.candidates(ranges)
    try:
        params = next(gen)
        while True:
            value = score(params)
            history.append((params, value))
            params = gen.send(value)
    except StopIteration:
        pass
    return min(history, key=lambda h: h[1])[0], history


# -- learners and the analysis ----------------------------------------------------------


def _mllib(kind: str, numeric: bool):
    from pyspark.ml import classification, regression

    module, suffix = (regression, "Regressor") if numeric else (classification, "Classifier")
    return getattr(module, {"tree": "DecisionTree", "forest": "RandomForest"}[kind] + suffix)


_TREE = {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "max_bins": "maxBins", "seed": "seed"}
_FOREST = _TREE | {"n_trees": "numTrees", "sampling_fraction": "subsamplingRate"}
LEARNERS: dict[str, tuple[str, dict[str, str]]] = {"decision_tree": ("tree", _TREE), "random_forest": ("forest", _FOREST), "boosting": ("boost", {}), "stump_boosting": ("samme", {})}


def make_learner(name: str, **params) -> Callable[[DataFrame, list[str], str, bool], Model]:
    """A function (rows, features, label, numeric) -> symbolic model; unknown names or parameters raise."""
    if name not in LEARNERS:
        raise ValueError(f"unknown model {name!r}; one of {sorted(LEARNERS)}")
    kind, allowed = LEARNERS[name]
    if kind in ("tree", "forest"):
        wrong = set(params) - set(allowed)
        if wrong:
            raise TypeError(f"{name} has no parameters {sorted(wrong)}")
        return functools.partial(_fit_mllib, kind, {allowed[k]: v for k, v in params.items()})
    from . import boosting

    if kind == "boost":
        options = boosting.BoostOptions(**params)

        def fit(df, features, label, numeric):
            if not numeric:
                return BoostedModel(boosting.boost_classes(df, features, label, options))
            b = boosting.boost_regression(df, features, label, options)
            return Ensemble(tuple(_shifted(t, b, i) for i, t in enumerate(b.trees)), numeric=True)

        return fit

    def fit_samme(df, features, label, numeric):
        if numeric:
            raise TypeError("stump_boosting fits classes")
        return boosting.samme(df, features, label, **params).ensemble()

    return fit_samme


@dataclass(frozen=True)
class BoostedModel(Model):
    """Boosted classes as a model that applies like any other."""

    boosted: object

    def column(self, single: bool = False) -> Column:
        p = self.boosted.probabilities()
        best = F.greatest(*p) if len(p) > 1 else p[0]
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for c, x in zip(self.boosted.classes, p, strict=True):
            out = out.when(x == best, F.lit(c))
        return out


def _shifted(tree: Tree, b, i: int) -> Tree:
    """A tree whose mean over the ensemble is base + eta * sum."""
    from .models import Branch

    def walk(m: Model) -> Model:
        if isinstance(m, Leaf):
            return Leaf(b.base + m.outcome * b.eta * len(b.trees))
        return Branch(m.condition, walk(m.positive), walk(m.negative))

    return Tree(walk(tree.root))


def _fit_mllib(kind: str, params: dict, df: DataFrame, features: list[str], label: str, numeric: bool) -> Model:
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features], F.col(label).cast("double" if numeric else "string").alias("_y")).where("_y is not null")
    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(rows)
    classes = None
    if not numeric:
        indexer = StringIndexer(inputCol="_y", outputCol="_c", stringOrderType="alphabetAsc").fit(rows)
        rows, classes = indexer.transform(rows), list(indexer.labels)
    fitted = _mllib(kind, numeric)(featuresCol="_x", labelCol="_y" if numeric else "_c", **params).fit(rows)
    if kind == "tree":
        return convert(_raw(fitted._java_obj.rootNode() if hasattr(fitted, "_java_obj") else fitted._call_java("rootNode"), classes), features, classes, "<=")
    trees = [_raw(t._call_java("rootNode"), classes) for t in fitted.trees]
    return convert_ensemble(trees, features, classes, None, "<=") if classes else Ensemble(tuple(convert(t, features, None, "<=") for t in trees), numeric=True)


def _raw(node, classes) -> RawNode:
    """A fitted node (JVM object) as a raw node; categorical splits do not occur on plain doubles."""
    if node.getClass().getSimpleName() == "LeafNode":
        return RawNode(majority=int(node.prediction()) if classes is not None else node.prediction())
    split = node.split()
    return RawNode(split.featureIndex(), split.threshold(), _raw(node.leftChild(), classes), _raw(node.rightChild(), classes))


@dataclass(frozen=True)
class Analysis:
    """What an analysis found: models by fold, predictions of the test rows, measures, rule lists."""

    models: dict[int, Model]
    predictions: DataFrame
    measures: DataFrame
    rules: dict[int, Model]


def symbolic_analysis(
    df: DataFrame,
    features: list[str],
    label: str,
    row_id: str,
    model: str = "decision_tree",
    params: dict | None = None,
    resample: tuple[str, dict] = ("holdout", {}),
    measures: tuple[str, ...] | None = None,
    extractor=None,
    tuning: tuple[list[Range], Tuning] | None = None,
    numeric: bool | None = None,
) -> Analysis:
    """Splits, fits one symbolic model for each fold, predicts the test rows and measures them.

    Labels of floating point make it a regression; those of any other type, whole numbers too, are
    classes unless ``numeric`` says otherwise. ``resample`` names holdout, cv, stratified or time with
    their parameters. With an ``extractor`` (``rules.ExtractorOptions``) each fold's model is
    turned into a rule list on its test rows. With ``tuning`` the parameters of the first fold's
    best candidate, measured on a holdout of its training rows, are used for all folds.
    """
    numeric = dict(df.dtypes)[label] in ("double", "float") if numeric is None else numeric
    measures = measures or (("rms", "mae") if numeric else ("accuracy", "kappa"))
    kind, options = resample
    if kind in ("cv", "stratified"):  # one copy of each row, with the fold that it tests in
        k = options.get("k", 5)
        assigned = k_fold(df, row_id, **options) if kind == "cv" else stratified_fold(df, row_id, label, **options)
        rows, folds = df.join(assigned.withColumnRenamed("own", "fold"), row_id).persist(), range(k)
        part = lambda fold, role: rows.where(F.col("fold") == fold if role == "test" else F.col("fold") != fold).withColumn("fold", F.lit(fold))
    elif kind in ("holdout", "time"):
        roles = (holdout if kind == "holdout" else time_folds)(df, row_id, **options)
        rows, folds = df.join(roles, row_id).persist(), range(1 if kind == "holdout" else options.get("k", 5))
        part = lambda fold, role: rows.where((F.col("fold") == fold) & (F.col("role") == role)).drop("role")
    else:
        raise ValueError(f"unknown resampling {kind!r}")
    params = dict(params or {})
    found: dict[int, Model] = {}
    lists: dict[int, Model] = {}
    parts: list[DataFrame] = []
    for fold in folds:
        train, test = part(fold, "train"), part(fold, "test")
        if tuning is not None and not found:
            ranges, search = tuning
            inner = train.drop("fold")
            split = inner.join(holdout(inner, row_id, 0.7).drop("fold"), row_id).persist()

            def score(p, split=split):
                m = make_learner(model, **params | p)(split.where("role = 'train'"), features, label, numeric)
                out = apply_model(split.where("role = 'test'"), m)
                error = F.avg(F.pow(F.col(label) - F.col("prediction"), F.lit(2))) if numeric else F.avg((F.col(label).cast("string") != F.col("prediction")).cast("double"))
                return out.agg(error).first()[0] or 0.0

            params |= tune(score, ranges, search)[0]
            split.unpersist()
        found[fold] = make_learner(model, **params)(train, features, label, numeric)
        target = F.col(label) if numeric else F.col(label).cast("string")
        parts.append(apply_model(test, found[fold]).select(F.col(row_id).alias("row_id"), "fold", target.alias("label"), "prediction"))
        if extractor is not None and not numeric:
            from .rules import extract

            lists[fold] = extract(test, found[fold], label, extractor)
    predictions = functools.reduce(DataFrame.unionByName, parts)
    return Analysis(found, predictions, evaluate(predictions, list(measures)), lists)


def run_models(df: DataFrame, features: list[str], label: str, row_id: str, specs: list[dict], shared: dict | None = None) -> dict[str, Analysis]:
    """Several analyses with shared settings; a spec's own settings win."""
    out = {}
    for i, spec in enumerate(specs):
        merged = (shared or {}) | spec
        merged["params"] = ((shared or {}).get("params") or {}) | (spec.get("params") or {})
        out[f"{i}:{merged.get('model', 'decision_tree')}"] = symbolic_analysis(df, features, label, row_id, **merged)
    return out
