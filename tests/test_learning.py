import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.operators import boosting, evaluation, models, relational, selection
from rulewright.operators.boosting import Boosted, BoostOptions
from rulewright.operators.conditions import ScalarCondition
from rulewright.operators.evaluation import Range, Tuning
from rulewright.operators.models import Branch, Leaf, Tree
from rulewright.sources import tables

IRIS = ["sepal_length", "sepal_width", "petal_length", "petal_width"]


@pytest.fixture(scope="module")
def iris(spark):
    return tables.sample_iris(spark).persist()


# -- boosting ---------------------------------------------------------------------------------


# Thresholds and leaves of a boosted model, as 32-bit numbers.
def fixed_trees():
    a, b = ScalarCondition("petal_length", "<", 3.0), ScalarCondition("petal_length", "<", 4.9000001)
    leaf = lambda v: Leaf(None, v)
    return [
        Tree(Branch(a, leaf(0.141614899), leaf(-0.072997041))),
        Tree(Branch(a, leaf(-0.070807457), Branch(b, Branch(ScalarCondition("petal_width", "<", 1.70000005), leaf(0.141176477), leaf(-0.0120000029)), Branch(ScalarCondition("petal_width", "<", 1.70000005), leaf(-0.0206896588), leaf(-0.0707006454))))),
        Tree(Branch(ScalarCondition("petal_length", "<", 4.80000019), Branch(ScalarCondition("petal_width", "<", 1.60000002), leaf(-0.0726962537), leaf(-2.55448485e-9)), Branch(b, leaf(0.0239999983), leaf(0.137288138)))),
    ]


def test_thresholds_are_compared_as_single_floats(spark):
    row = spark.createDataFrame([(6.9, 3.1, 4.9, 1.5)], "sepal_length double, sepal_width double, petal_length double, petal_width double")
    out = boosting.boosted_inference(row, fixed_trees(), "multi:softprob", ["setosa", "versicolor", "virginica"]).first()
    assert out["prediction"] == "virginica"
    assert np.allclose(out["probabilities"], [0.304161, 0.320495, 0.375344], atol=1e-5)


def test_a_tree_of_one_leaf_keeps_its_place(spark, iris):
    trees = [Tree(Leaf(None, 0.5)), *fixed_trees()[:2]]
    named = boosting.label_boosted_leaves(iris, trees, "label")
    assert len(named) == 3 and named[0].root.score == 0.5 and named[1].root.positive.outcome == "setosa"


def test_linear_data(spark):
    df = tables.sample_linear(spark, 400).persist()
    names = [f"x{i}" for i in range(1, 6)]
    m = boosting.boost_regression(df, names, "y", BoostOptions(rounds=4, depth=2, eta=0.5))
    mse = [df.agg(F.avg(F.pow(F.col("y") - Boosted(m.base, m.eta, m.trees[:k]).column(), F.lit(2)))).first()[0] for k in range(5)]
    assert all(b < a for a, b in zip(mse, mse[1:], strict=False))
    first = m.trees[0].root.condition
    data = df.collect()
    base = sum(r["y"] for r in data) / len(data)

    def gain(f, t):
        g = [base - r["y"] for r in data]
        left = [x for x, r in zip(g, data, strict=True) if r[f] < t]
        right = [x for x, r in zip(g, data, strict=True) if r[f] >= t]
        return 0.5 * (sum(left) ** 2 / (len(left) + 1) + sum(right) ** 2 / (len(right) + 1) - sum(g) ** 2 / (len(g) + 1))

    best = max(gain(f, (a + b) / 2) for f in names for v in (sorted({r[f] for r in data}),) for a, b in zip(v, v[1:], strict=False))
    assert math.isclose(gain(first.feature, first.threshold), best, rel_tol=1e-9)


def test_binned_thresholds(spark):
    df = tables.sample_linear(spark, 500).persist()
    names = [f"x{i}" for i in range(1, 6)]
    errors = []
    for bins in (0, 32):
        m = boosting.boost_regression(df, names, "y", BoostOptions(rounds=2, depth=2, eta=0.5, bins=bins))
        errors.append(df.agg(F.avg(F.pow(F.col("y") - m.column(), F.lit(2)))).first()[0])
    assert errors[1] < 1.1 * errors[0]


@pytest.mark.parametrize("bad", [{"rounds": 0}, {"eta": 0}, {"depth": -1}, {"reg_lambda": -1}, {"bins": 1}, {"objective": "x"}])
def test_boost_options(bad):
    with pytest.raises(ValueError):
        BoostOptions(**bad)


def test_objectives_and_base(spark):
    assert boosting.default_objective(None) == "reg:squarederror" and boosting.default_objective(2) == "binary:logistic" and boosting.default_objective(3) == "multi:softprob"
    df = spark.createDataFrame([(1.0,), (3.0,)], "y double")
    assert boosting.base_score(df, "y", None) == 0.5 and boosting.base_score(df, "y", -math.inf) == 2.0


def test_stage_wise(iris):
    m = boosting.samme(iris, IRIS, "label", rounds=4)
    out = models.apply_model(iris, m.ensemble())
    assert out.where("label = prediction").count() >= 100 and math.isclose(sum(m.importance.values()), 1.0)
    assert boosting.split_importance(m.ensemble())


# -- folds, measures, tuning --------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 7])
@pytest.mark.parametrize("k", [2, 5, 9])
def test_folds_partition(iris, seed, k):
    plain = evaluation.k_fold(iris, "row_id", k, seed).toPandas()
    assert sorted(plain.row_id) == list(range(150)) and plain.own.nunique() == k and np.ptp(plain.own.value_counts().to_numpy()) <= 1
    strata = evaluation.stratified_fold(iris, "row_id", "label", k, seed).join(iris.select("row_id", "label"), "row_id").toPandas()
    counts = strata.groupby(["label", "own"]).size()
    assert counts.max() - counts.min() <= 1
    roles = evaluation.fold_roles(evaluation.k_fold(iris, "row_id", k, seed), "row_id", k).toPandas()
    assert len(roles) == 150 * k and (roles[roles.role == "test"].row_id.value_counts() == 1).all()


def test_holdout_and_time(iris):
    out = evaluation.holdout(iris, "row_id", 0.7, 0.5, 3).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in out} == {"train": 105, "valid": 22, "test": 23}
    t = evaluation.time_folds(iris, "row_id", "row_id", 4).toPandas()
    for _, f in t.groupby("fold"):
        assert f[f.role == "train"].row_id.max() < f[f.role == "test"].row_id.min()
    stamped = iris.withColumn("at", F.timestamp_seconds(F.col("row_id") * -3600))
    stamps = evaluation.time_folds(stamped, "row_id", "at", 2).toPandas()
    for _, f in stamps.groupby("fold"):
        assert f[f.role == "train"].row_id.min() > f[f.role == "test"].row_id.max()
    with pytest.raises(ValueError):
        evaluation.holdout(iris, "row_id", 1.5)


def test_group_split_is_disjoint_and_balanced(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice("ab"), rng.randrange(12)) for i in range(300)], "row_id int, label string, id int")
    df = df.withColumn("id", F.concat("label", F.col("id").cast("string")))
    out = evaluation.group_split(df, "label", "id", 0.6).toPandas()
    assert not set(out[out.role == "train"].id) & set(out[out.role == "test"].id)
    assert all(g.groupby("label").size().nunique() == 1 for _, g in out.groupby("role"))


def test_measures(spark):
    df = spark.createDataFrame([(0, "a", "a"), (0, "b", "a"), (1, "a", "a"), (1, "b", "b"), (1, "b", "b"), (1, "a", "b")], "fold int, label string, prediction string")
    out = {(r["measure"], r["fold"]): r["value"] for r in evaluation.evaluate(df, ["accuracy", "kappa", "misses"]).collect()}
    assert out["accuracy", 0] == 0.5 and out["accuracy", 1] == 0.75 and math.isclose(out["accuracy", -1], 4 / 6)
    assert math.isclose(out["kappa", 1], 0.5) and out["misses", -1] == 2
    nums = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 2.0), (1, 3.0, 5.0)], "fold int, label double, prediction double")
    out = {(r["measure"], r["fold"]): r["value"] for r in evaluation.evaluate(nums, ["rms", "mae"]).collect()}
    assert math.isclose(out["rms", -1], math.sqrt(5 / 3)) and math.isclose(out["mae", -1], 1.0)
    with pytest.raises(ValueError):
        evaluation.evaluate(df, ["nothing"])
    assert evaluation.operation_for("accuracy", "probabilistic") == "predict_mode" and evaluation.operation_for("rms", "probabilistic") == "predict_mean"
    for bad in (("log_loss", "deterministic"), ("accuracy", "x"), ("x", "deterministic")):
        with pytest.raises(ValueError):
            evaluation.operation_for(*bad)
    assert df.agg(evaluation.specificity("label", "prediction", "a")).first()[0] == pytest.approx(2 / 3)


@pytest.mark.parametrize("strategy", Tuning.STRATEGIES)
def test_tuning(strategy):
    ranges = [Range("x", 0.0, 10.0), Range("d", 1, 5), Range("s", 0.01, 100.0, "log"), Range("c", values=("u", "v"))]
    best, history = evaluation.tune(lambda p: (p["x"] - 3) ** 2 + (p["c"] == "v") + abs(math.log(p["s"])), ranges, Tuning(strategy, resolution=4, n=30))
    assert len(history) == (4 * 4 * 4 * 2 if strategy == "grid" else 30) and all(1 <= p["d"] <= 5 and p["c"] in "uv" for p, _ in history)
    assert min(v for _, v in history) == next(v for p, v in history if p == best)
    with pytest.raises(ValueError):
        Range("x", 1.0, 0.0)


def test_analyses(iris):
    out = evaluation.symbolic_analysis(iris, IRIS, "label", "row_id", params={"max_depth": 3, "seed": 1})
    value = {(r["measure"], r["fold"]): r["value"] for r in out.measures.collect()}
    assert value["accuracy", 0] > 0.85 and value["kappa", -1] > 0.8 and out.predictions.count() == 45
    many = evaluation.run_models(iris, IRIS, "label", "row_id", [{"model": "random_forest", "params": {"n_trees": 3, "seed": 2}}, {"model": "decision_tree"}], {"resample": ("cv", {"k": 2})})
    assert len(many) == 2 and all(set(a.models) == {0, 1} for a in many.values())
    for bad, error in (({"model": "x"}, ValueError), ({"resample": ("x", {})}, ValueError), ({"params": {"x": 1}}, TypeError)):
        with pytest.raises(error):
            evaluation.symbolic_analysis(iris, IRIS, "label", "row_id", **bad)


def test_regression_analysis(spark):
    df = tables.sample_linear(spark, 200)
    out = evaluation.symbolic_analysis(df, [f"x{i}" for i in range(1, 6)], "y", "row_id", "boosting", {"rounds": 3, "depth": 2})
    assert {r["measure"] for r in out.measures.collect()} == {"rms", "mae"}


# -- selection ------------------------------------------------------------------------------------


def test_digamma_and_information():
    assert math.isclose(selection.digamma(1.0), -0.5772156649015329, rel_tol=1e-10) and math.isclose(selection.digamma(7.5) - selection.digamma(6.5), 1 / 6.5, rel_tol=1e-9)
    rng = np.random.default_rng(0)
    x = rng.normal(size=600)
    rho = 0.8
    y = rho * x + math.sqrt(1 - rho**2) * rng.normal(size=600)
    assert abs(selection.neighbour_information(x, y) + 0.5 * math.log(1 - rho**2)) < 0.12
    assert selection.neighbour_information(x, rng.normal(size=600)) < 0.08
    labels = np.where(rng.random(600) < 0.5, "a", "b")
    assert abs(selection.class_information(np.where(labels == "a", 0.0, 10.0) + rng.normal(size=600), labels) - math.log(2)) < 0.05
    assert selection.class_information(np.array([1.0, 2.0]), np.array(["a", "b"])) == 0.0


def test_mann_whitney(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i % 2), float(rng.normal() + 2 * (i % 2)), float(rng.normal())) for i in range(80)]
    out = {r["name"]: r["score"] for r in selection.mann_whitney(spark.createDataFrame(rows, "label string, good double, poor double"), ["good", "poor"], "label").collect()}
    assert out["good"] < 1e-6 and out["poor"] > 0.01
    limited = {r["name"]: r["kept"] for r in selection.AtMost(0.05)(spark.createDataFrame(list(out.items()), selection.SCORES)).collect()}
    assert limited["good"]


def test_limiters_and_steps(spark, iris):
    scores = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 2.0), ("d", 2.0), ("e", None)], selection.SCORES)
    kept = lambda limiter: sorted(r["name"] for r in limiter(scores).where("kept").collect())
    assert kept(selection.Percentage(0.5)) == ["a", "c", "d"] and kept(selection.Best(1)) == ["a"] and kept(selection.Everything()) == list("abcde")
    assert kept(selection.AtMost(1.5)) == ["b"] and kept(selection.AtMost(0.0, 2)) == ["b", "c"]
    with pytest.raises(ValueError):
        selection.Percentage(1.0)
    names, mid = selection.run_selection(iris, IRIS, selection.default_steps("label", "row_id"))
    assert len(names) == 1 and names[0] in IRIS and mid.where("step = 0 and kept").count() == 2
    assert selection.names_at_step(mid, 2) == names


def test_name_parts(spark):
    names = ["v2@@@w1@@@mean", "v2@@@w2@@@mean", "v10@@@w1@@@std"]
    groups = {r["name"]: r["grp"] for r in selection.name_groups(spark, names, (0, 2)).collect()}
    assert groups[names[0]] == groups[names[1]] == "v2@@@mean"
    for bad in ((["a@@@b", "a"], (0,)), (names, (3,))):
        with pytest.raises(ValueError):
            selection.name_groups(spark, *bad)
    assert selection.selected_variables(names) == ["v2", "v10"]
    mid = spark.createDataFrame([(0, n, 1.0, i > 0) for i, n in enumerate(names)], "step int, name string, score double, kept boolean")
    study = {r["part"]: (r["total"], r["kept"]) for r in selection.survivor_study(mid, 0).collect()}
    assert study == {"v2": (2, 1), "v10": (1, 1)}


def test_relational_helpers(spark, iris):
    d = {r["label"]: r["code"] for r in relational.class_dictionary(iris, "label").collect()}
    assert d == {"setosa": 1, "versicolor": 2, "virginica": 3}
    assert relational.encode_labels(iris, "label", base=0).where("code is null").count() == 0
    assert relational.sample_rows(iris, "row_id", 10, 3).count() == 10
    assert relational.histogram(iris, "petal_width", 5).agg(F.sum("n")).first()[0] == 150
    names = spark.createDataFrame([("x10",), ("x9",), ("a",)], "n string")
    assert [r["n"] for r in relational.natural_order(names, "n").collect()] == ["a", "x9", "x10"]
    assert relational.select_by_index(iris, [1, 0]).columns == ["sepal_length", "row_id"]


def test_class_information_takes_all_rows(spark, monkeypatch):
    """Several ranges, against all pairs of all rows."""
    monkeypatch.setattr(selection, "RANGE_ROWS", 700)
    rng = np.random.default_rng(2)
    label = rng.choice(["a", "b", "c", "d"], 3_000, p=[0.6, 0.39, 0.009, 0.001])
    label[:3] = ["x", "x", "alone"]
    good, poor = rng.normal(size=3_000) + (label == "a"), rng.normal(size=3_000)
    df = spark.createDataFrame([(i, str(y), float(g), float(p)) for i, (y, g, p) in enumerate(zip(label, good, poor))], "id long, label string, good double, poor double")
    got = {r["name"]: r["score"] for r in selection.information_scores(df, ["good", "poor"], "label", "id").collect()}
    for name, x in (("good", good), ("poor", poor)):
        assert np.isclose(got[name], selection.class_information(x / x.std(ddof=1), label), atol=1e-6)


def test_boosted_classes(iris):
    m = boosting.boost_classes(iris, IRIS, "label", BoostOptions(rounds=4, depth=2), watch=iris)
    assert len(m.trees) == 12 and len(m.history) == 5 and all(b < a for a, b in zip(m.history, m.history[1:], strict=False))
    out = m.apply(iris).collect()
    assert np.mean([r["label"] == r["prediction"] for r in out]) > 0.9 and all(math.isclose(sum(r["probabilities"]), 1.0) for r in out)
    assert math.isclose(m.history[0], math.log(3))
    two = boosting.boost_classes(iris.where("label <> 'setosa'"), IRIS, "label", BoostOptions(rounds=2, depth=1))
    assert two.objective == "binary:logistic" and len(two.trees) == 2
    one = boosting.boost_classes(iris.where("label = 'setosa'"), IRIS, "label", BoostOptions(rounds=2))
    assert {r["prediction"] for r in one.apply(iris).collect()} == {"setosa"}


def test_splits_in_ranges_equal_whole_splits(iris):
    rows = iris.select(*IRIS, F.col("label").alias("node"), (F.col("petal_width") - F.col("sepal_width")).alias("g"), F.lit(1.0).alias("h"))
    ranges = boosting.quantile_cuts(iris, IRIS, 7)
    whole, parts = ({r["node"]: r for r in boosting.best_splits(rows, IRIS, ranges=x).collect()} for x in (None, ranges))
    assert whole.keys() == parts.keys()
    for k, r in whole.items():
        assert r["feature"] == parts[k]["feature"] and math.isclose(r["threshold"], parts[k]["threshold"]) and math.isclose(r["gain"], parts[k]["gain"]) and math.isclose(r["hl"], parts[k]["hl"])


def test_group_split_balances_and_is_disjoint(iris):
    rows = iris.withColumn("grp", F.col("row_id") % 20)
    out = evaluation.group_split(rows, "label", "grp", 0.6).toPandas()
    assert out.groupby(["role", "label"]).size().groupby("role").nunique().eq(1).all()
    for _, part in out.groupby("label"):
        assert not set(part[part.role == "train"].grp) & set(part[part.role == "test"].grp)
    whole = evaluation.group_split(rows, "label", "grp", 0.6, balance=False)
    assert whole.count() == 150 and whole.columns == [*sorted(set(rows.columns) - {"label", "grp"}, key=rows.columns.index), "role"] or set(whole.columns) == {*rows.columns, "role"}


def test_whole_number_labels_are_classes(iris):
    rows = iris.withColumn("y", (F.col("petal_length") > 3).cast("int"))
    out = evaluation.symbolic_analysis(rows, IRIS, "y", "row_id", params={"max_depth": 2, "seed": 1})
    assert {r["measure"] for r in out.measures.collect()} == {"accuracy", "kappa"}
    with pytest.raises(ValueError):
        evaluation.evaluate(out.predictions, ["log_loss"])


# -- rule extraction against plain steps --------------------------------------------------------


def small_forest():
    c = lambda f, t, a, b: Branch(ScalarCondition(f, "<", t), a, b)
    s, v, w = Leaf("setosa"), Leaf("versicolor"), Leaf("virginica")
    return [
        Tree(c("petal_length", 2.5, s, c("petal_width", 1.7, c("petal_length", 4.95, v, w), w))),
        Tree(c("petal_width", 0.8, s, c("petal_length", 4.7, c("sepal_width", 2.5, v, v), c("sepal_length", 6.0, v, w)))),
        Tree(c("sepal_length", 5.5, c("sepal_width", 2.8, v, s), c("petal_width", 1.6, v, w))),
    ]


def plain_holds(rule, row):
    from rulewright.operators.conditions import OPERATORS

    return all(OPERATORS[a.op](row[a.feature], a.threshold) for a in rule_atoms(rule))


def rule_atoms(rule):
    from rulewright.operators.conditions import And

    return list(rule.antecedent.parts) if isinstance(rule.antecedent, And) else [rule.antecedent]


def plain_error(rule, rows):
    own = [r for r in rows if plain_holds(rule, r)]
    return (sum(r["label"] != rule.consequent.outcome for r in own) / len(own) if own else None), len(own)


def test_pruning_equals_plain_steps(iris):
    from rulewright.operators import rules
    from rulewright.operators.conditions import conjunction
    from rulewright.operators.models import Rule

    rows = [r.asDict() for r in iris.collect()]
    given = [r for t in small_forest() for r in models.list_rules(t)]
    want = {}
    for rule in given:
        at = len(rule_atoms(rule)) - 1
        while at >= 0 and len(rule_atoms(rule)) > 1:
            shorter = Rule(conjunction(a for j, a in enumerate(rule_atoms(rule)) if j != at), rule.consequent)
            e, without = (1.0 if x is None else x for x in (plain_error(rule, rows)[0], plain_error(shorter, rows)[0]))
            if (without - e) / max(e, 1e-6) < 0.05:
                rule = shorter
            at -= 1
        want[str(rule.antecedent), rule.consequent.outcome] = rule
    got = rules.prune(iris, given, "label")
    assert [(str(r.antecedent), r.consequent.outcome) for r in got] == list(want) and len(want) < len(given)


def test_sequential_lists_equal_plain_steps(iris):
    from rulewright.operators import rules

    rows = [r.asDict() for r in iris.collect()]
    given = [r for t in small_forest() for r in models.list_rules(t)]
    left, pool, want = rows, list(given), []
    while True:
        labels = sorted({r["label"] for r in left})
        counts = {k: sum(r["label"] == k for r in left) for k in labels}
        default = min(counts, key=lambda k: (-counts[k], k)) if counts else None
        able = [(plain_error(r, left)[0], -plain_error(r, left)[1], len(rule_atoms(r)), i) for i, r in enumerate(pool) if plain_error(r, left)[1] >= max(1, 0.01 * len(rows))]
        if not left or not able or min(able)[0] >= 1 - counts[default] / len(left):
            break
        best = pool.pop(min(able)[3])
        want.append(str(best.antecedent))
        left = [r for r in left if not plain_holds(best, r)]
    got = rules.sequential_list(iris, given, "label")
    assert [str(r.antecedent) for r in got.rules] == want and len(want) > 2
    if left:
        assert got.default.outcome == default


def test_correlation_selection_equals_plain_counts(iris):
    from rulewright.operators import rules

    rows = [r.asDict() for r in iris.collect()]
    given = [r for t in small_forest() for r in models.list_rules(t)]
    masks = [[plain_holds(r, x) for x in rows] for r in given]
    labels = [x["label"] for x in rows]

    def entropy(values):
        n = len(values)
        return -sum(values.count(v) / n * math.log2(values.count(v) / n) for v in set(values))

    def su(a, b):
        ha, hb = entropy(a), entropy(b)
        return 2 * (ha + hb - entropy(list(zip(a, b, strict=True)))) / (ha + hb) if ha + hb else 0.0

    with_label = [su(m, labels) for m in masks]
    pair = [[su(a, b) for b in masks] for a in masks]

    def merit(s):
        return sum(with_label[i] for i in s) / math.sqrt(len(s) + 2 * sum(pair[a][b] for k, a in enumerate(s) for b in s[:k]))

    chosen, best, kept, stale = [], -math.inf, [], 0
    while len(chosen) < len(given) and stale < 5:
        pick = max((i for i in range(len(given)) if i not in chosen), key=lambda i: (round(merit([*chosen, i]), 12), -i))
        chosen.append(pick)
        if merit(chosen) > best + 1e-12:
            best, kept, stale = merit(chosen), list(chosen), 0
        else:
            stale += 1
    assert rules.correlation_selection(iris, given, "label") == kept


def test_covering_equals_an_exhaustive_beam(iris):
    """Each rule is the best of all conjunctions of two atoms where the beam holds them all."""
    from rulewright.operators import rules

    rows = [r.asDict() for r in iris.collect()]
    options = rules.CoveringOptions(beam=10_000, max_atoms=2, thresholds=3, max_rules=2)
    got = rules.learn_covering(iris, ["petal_length", "petal_width"], "label", options)
    cuts = boosting.quantile_cuts(iris, ["petal_length", "petal_width"], 4)
    atoms = [ScalarCondition(f, op, t) for f, ts in cuts.items() for t in ts for op in ("<", ">=")]
    left = rows
    for rule in got.rules:
        quality = lambda own: (max([sum(r["label"] == k for r in own) for k in ("setosa", "versicolor", "virginica")]) + 1) / (len(own) + 3)
        found = []
        for i, a in enumerate(atoms):
            for b in [None, *atoms[i + 1 :]]:
                own = [r for r in left if plain_holds(models.Rule(a, Leaf("")), r) and (b is None or plain_holds(models.Rule(b, Leaf("")), r))]
                if own:
                    found.append(quality(own))
        own = [r for r in left if plain_holds(rule, r)]
        assert math.isclose(quality(own), max(found))
        left = [r for r in left if not plain_holds(rule, r)]
