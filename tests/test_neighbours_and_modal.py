"""Exact neighbour information, conditions over all intervals, and modal learners, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.functions import windows
from rulewright.operators import modal_learning, models, neighbours, selection
from rulewright.operators.modal import ModalCondition
from rulewright.operators.modal_learning import ModalTest

# -- neighbours


def samples(n=500):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=n), "wide": np.exp(3 * rng.normal(size=n)), "grid": rng.integers(0, 6, n).astype(float), "hot": np.where(rng.random(n) < 0.4, 1.0, rng.normal(size=n)), "constant": np.ones(n), "few": np.array([1.0, 2.0, 3.0])}
    return {k: (v, rng.integers(0, 4, len(v)).astype(float) if k == "grid" else v + rng.normal(size=len(v))) for k, v in x.items()}


@pytest.mark.parametrize(("cell", "ranges"), [(1_024, 100_000), (20, 40)])
def test_continuous_information_equals_all_pairs(spark, monkeypatch, cell, ranges):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
    monkeypatch.setattr(neighbours, "RANGE_ROWS", ranges)
    given = samples()
    rows = [(k, i, float(a), float(b)) for k, (x, y) in given.items() for i, (a, b) in enumerate(zip(x, y, strict=True))]
    got = {r["name"]: r["score"] for r in neighbours.continuous_information(spark.createDataFrame(rows, "name string, id long, x double, y double").repartition(3)).collect()}
    for k, (x, y) in given.items():
        assert got[k] == pytest.approx(selection.neighbour_information(x, y), abs=1e-9), k
    assert neighbours.continuous_information(spark.createDataFrame([], "name string, id long, x double, y double")).count() == 0


def test_numeric_labels_by_information_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b) if i % 9 else None, float(a + 0.1 * c), float("nan") if i == 4 else 1.0) for i, (a, b, c) in enumerate(rng.normal(size=(400, 3)))]
    df = spark.createDataFrame(rows, "id long, good double, poor double, y double, flat double")
    got = {r["name"]: r["score"] for r in selection.information_scores(df, ["good", "poor", "flat"], "y", "id", numeric_label=True).collect()}
    assert got["good"] > 1.0 > 0.3 > got["poor"] and got["flat"] < 0.2


def test_digamma_expression(spark):
    out = spark.range(1, 300).select("id", neighbours.digamma(F.col("id")).alias("v")).collect()
    assert all(r["v"] == pytest.approx(selection.digamma(float(r["id"])), abs=1e-12) for r in out)


def test_counts_with_ties_and_empty_ranges(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RANGE_ROWS", 3)
    values = [0.0, 0.0, 0.0, 1.0, 5.0, 5.0, 9.0, 100.0]
    rows = [("a", i, v, r) for i, (v, r) in enumerate(zip(values, [0.0, 1.0, 5.0, 0.5, 4.0, 0.0, 200.0, 10.0], strict=True))]
    got = {r["id"]: r["m"] for r in neighbours.counts_within(spark.createDataFrame(rows, "name string, id long, x double, r double"), "x").collect()}
    assert got == {i: sum(abs(v - w) <= r for w in values) for _, i, v, r in rows}


# -- intervals


def listed(a, shortest, longest=None):
    top = min(longest or len(a), len(a))
    return [a[i : i + n] for n in range(shortest, top + 1) for i in range(len(a) - n + 1)]


def test_conditions_of_extremes_equal_the_listing(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0, 3.0, math.nan] if i % 3 == 0 else [0.0, 1.0, 2.0, 3.0]) for _ in range(rng.randint(0, 9))]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    asked = [(f, o, t, s, u) for f in ("minimum", "maximum") for o in ("<", "<=", ">", ">=") for t, s in ((1.0, 1), (2.0, 3)) for u in (False, True)]
    got = df.select("id", *[ModalCondition("e", f, o, t, s, universal=u).column().alias(f"c{k}") for k, (f, o, t, s, u) in enumerate(asked)]).collect()
    from rulewright.operators.conditions import OPERATORS

    for r in got:
        a = rows[r["id"]][1]
        for k, (f, o, t, s, u) in enumerate(asked):
            passes = [not any(map(math.isnan, w)) and OPERATORS[o]((min if f == "minimum" else max)(w), t) for w in listed(a, s)] if a is not None else []
            want = a is not None and (all(passes) if u else any(passes))
            assert r[f"c{k}"] == want, (a, asked[k])
    with pytest.raises(ValueError):
        windows.some_interval(F.col("e"), "mean", ">=", 1.0)


def test_attained_values_equal_the_listing():
    rng = random.Random(4)
    for _ in range(300):
        a = [float(rng.randint(-3, 3)) if rng.random() > 0.05 else math.nan for _ in range(rng.randint(0, 12))]
        shortest = rng.randint(1, 5)
        longest = rng.choice([None, shortest, shortest + 2])
        for fun in ("minimum", "maximum", "mean"):
            for op in (">=", "<="):
                for relation in modal_learning.RELATIONS:
                    worlds = [(x, x + n) for n in range(shortest, min(longest or len(a), len(a)) + 1) for x in range(len(a) - n + 1)]
                    whole = (0, len(a))
                    keep = {None: lambda w: True, "=": lambda w: w == whole, "B": lambda w: w[0] == 0 and w != whole, "E": lambda w: w[1] == len(a) and w != whole, "D": lambda w: w[0] > 0 and w[1] < len(a), "DBE": lambda w: w != whole}[relation]
                    values = [sum(p) / len(p) if fun == "mean" else min(p) if fun == "minimum" else max(p) for p in (a[x:y] for x, y in worlds if keep((x, y))) if not any(map(math.isnan, p))]
                    got = ModalTest("e", fun, op, shortest, longest, relation).attained(np.array(a))
                    if not values:
                        assert math.isnan(got)
                    else:
                        assert got == pytest.approx(max(values) if op == ">=" else min(values)), (a, fun, op, shortest, longest, relation)


# -- learners

TESTS = [ModalTest("e", "maximum"), ModalTest("e", "minimum", shortest=3), ModalTest("e", "mean", "<=", 2), ModalTest("e", "minimum", relation="E"), ModalTest("f", "maximum")]


def series_table(spark, n=600):
    """Label b where three values in a row are high, c where not and the series f has a peak, else a."""
    rng = random.Random(8)
    rows = []
    for i in range(n):
        e = [rng.random() for _ in range(rng.randint(8, 14))]
        f = [rng.random() * 0.5 for _ in range(6)]
        high, peak = rng.random() < 0.4, rng.random() < 0.5
        if high:
            at = rng.randint(0, len(e) - 3)
            e[at : at + 3] = [2.0 + rng.random() for _ in range(3)]
        else:
            e[rng.randint(0, len(e) - 1)] = 2.5
        if peak:
            f[rng.randint(0, 5)] = 3.0
        rows.append((i, e, f, "b" if high else "c" if peak else "a"))
    rows += [(n, None, None, "a"), (n + 1, [], [], None), (n + 2, [math.nan], [0.1], "a")]
    return spark.createDataFrame(rows, "id long, e array<double>, f array<double>, y string").repartition(3)


def accuracy(df, model):
    out = models.apply_model(df.where("y is not null"), model)
    return out.agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0]


def test_tree_finds_the_intervals_that_decide(spark):
    df = series_table(spark)
    tree = modal_learning.learn_tree(df, TESTS, "y", "id", depth=2)
    assert accuracy(df, tree) > 0.97
    assert tree.root.condition.shortest == 3 and tree.root.negative.condition.variable == "f"


def test_forest_is_grown_in_one_aggregate_a_level(spark):
    df = series_table(spark)
    forest = modal_learning.learn_forest(df, TESTS, "y", "id", n_trees=7, depth=3, tests_per_node=4)
    assert len(forest.trees) == 7 and accuracy(df, forest) > 0.9
    again = modal_learning.learn_forest(df, TESTS, "y", "id", n_trees=7, depth=3, tests_per_node=4)
    assert again == forest


def test_stagewise_rounds_lower_the_error(spark):
    df = series_table(spark)
    one, many = (modal_learning.learn_stagewise(df, TESTS, "y", "id", rounds=k) for k in (1, 6))
    assert accuracy(df, many.ensemble()) > accuracy(df, one.ensemble()) and len(many.trees) == len(many.coefficients)
    assert sum(many.importance.values()) == pytest.approx(1.0)


def test_tables_without_rows_or_with_one_class(spark):
    df = series_table(spark)
    assert models.height(modal_learning.learn_tree(df.where("y = 'a'"), TESTS, "y", "id")) == 0
    assert models.height(modal_learning.learn_tree(df.limit(0), TESTS, "y", "id")) == 0
    with pytest.raises(ValueError):
        ModalTest("e", "median")


# -- rules as a table, boosting by codes


def test_rule_table_equals_rules_one_by_one(spark, monkeypatch):
    from rulewright.operators import rule_table, rules
    from rulewright.operators.conditions import And, RangeCondition, ScalarCondition, Truth
    from rulewright.operators.models import Leaf, Rule

    rng = random.Random(6)
    value = lambda: rng.choice([None, float("nan"), float("inf"), -float("inf"), *map(float, range(-3, 4)), 0.5])
    df = spark.createDataFrame([(value(), value(), value(), rng.choice(["p", "q", None])) for _ in range(300)], "a double, b double, c double, y string").repartition(3)

    def atom():
        f, t = rng.choice("abc"), rng.choice([-2.0, 0.0, 0.5, 1.0, 3.0])
        if rng.random() < 0.3:
            return RangeCondition(f, t, t + rng.choice([0.0, 1.0, 2.0]), rng.random() < 0.5, rng.random() < 0.5)
        return ScalarCondition(f, rng.choice(["<", "<=", ">", ">=", "=="]), t)

    given = [Rule(Truth() if k == 0 else And(tuple(atom() for _ in range(n))) if (n := rng.randint(1, 4)) > 1 else atom(), Leaf(rng.choice("pq"))) for k in range(60)]
    monkeypatch.setattr(rule_table, "BLOCK_RULES", 13)
    monkeypatch.setattr(rule_table, "BATCH_ROWS", 50)
    want = rules.measure(df, given, "y")
    table = rule_table.rule_table(spark, given)
    for bounds in (1_000_000, 40):
        monkeypatch.setattr(rule_table, "PASS_BOUNDS", bounds)
        got = {r["rule_id"]: r for r in rule_table.rule_table_metrics(df, table, "y").collect()}
        for w in want:
            g = got[w["rule_id"]]
            assert (g["ncovered"], g["ninstances"]) == (w["ncovered"], w["ninstances"]), w
            for c in ("coverage", "confidence", "lift", "error"):
                assert g[c] == w[c] or g[c] == pytest.approx(w[c]), (c, w)
    empty = rule_table.rule_table_metrics(df.limit(0), table, "y").collect()
    assert len(empty) == 60 and all(r["ncovered"] == 0 and r["confidence"] is None for r in empty)
    assert rule_table.rule_table_metrics(df, table.limit(0), "y").count() == 0
    with pytest.raises(ValueError):
        rule_table.rule_table(spark, [Rule(ScalarCondition("a", "!=", 1.0), Leaf("p"))])


def test_trees_by_codes_equal_trees_by_values(spark, monkeypatch):
    from rulewright.operators import boosting
    from rulewright.operators.boosting import BoostOptions, boost_classes, boost_regression

    rng = random.Random(9)
    rows = [(rng.choice([None, float("nan"), 0.0, 1.0, 2.5, 4.0]), float(rng.randint(0, 30)), float(rng.randint(0, 3)), rng.random(), rng.choice("uvw")) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, k string").withColumn("y", F.col("y") + F.col("b") / 10 + F.coalesce(F.nanvl("a", F.lit(0.0)), F.lit(9.0)))
    one, two = (boost_regression(df, ["a", "b", "c"], "y", BoostOptions(rounds=3, depth=3, bins=b), watch=df) for b in (64, 0))
    assert one.trees == two.trees or one.history == pytest.approx(two.history, rel=1e-9)
    three, four = (boost_classes(df, ["a", "b", "c"], "k", BoostOptions(rounds=2, depth=2, bins=b), watch=df) for b in (64, 0))
    assert three.history == pytest.approx(four.history, rel=1e-9)
    wide = df.withColumn("b", F.col("b") + F.col("y"))  # more values than bins
    monkeypatch.setattr(boosting, "EXACT_VALUES", 0)
    five = boost_regression(wide, ["a", "b", "c"], "y", BoostOptions(rounds=3, depth=3, bins=8), watch=wide)
    assert all(b <= a for a, b in zip(five.history, five.history[1:], strict=False))


# -- exact quantiles


@pytest.mark.parametrize("few", [100_000, 60])
def test_exact_quantiles_of_groups(spark, monkeypatch, few):
    from rulewright.functions import quantiles

    monkeypatch.setattr(quantiles, "FEW_ROWS", few)
    monkeypatch.setattr(quantiles, "CUTS", 32)
    rng = random.Random(12)
    groups = {"wide": [math.exp(8 * rng.random()) for _ in range(700)], "hot": [1.0] * 300 + [rng.random() * 2 for _ in range(150)], "one": [5.0], "two": [1.0, 2.0], "signed": [float(rng.randint(-9, 9)) for _ in range(500)], None: [-0.0, 0.0, 3.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("nan", float("nan")), ("hot", None), ("wide", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    p = [0.0, 0.25, 0.5, 0.99]
    got = {r["g"]: r["q"] for r in quantiles.exact_quantiles(df, ["g"], "v", p).collect()}
    disc = {r["g"]: r["q"] for r in quantiles.exact_quantiles(df, ["g"], "v", p, between=False).collect()}
    assert set(got) == set(groups) == set(disc)
    for g, vs in groups.items():
        vs = sorted(vs)
        assert got[g] == pytest.approx([float(np.quantile(vs, x)) for x in p], abs=1e-9), g
        assert disc[g] == [vs[max(math.ceil(round(x * len(vs), 9)) - 1, 0)] for x in p], g
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", p).count() == 0


# -- signals longer than a row, rules of rows


def test_frames_across_chunks_equal_whole_signals(spark):
    from rulewright.functions import signal

    rng = np.random.default_rng(2)
    whole = {"a b": rng.normal(size=517), "c": rng.normal(size=40), "short": rng.normal(size=9), "one": rng.normal(size=16)}
    rows = []
    for path, x in whole.items():
        at = 0
        while at < len(x):
            n = int(rng.choice([1, 3, 16, 50, 130]))
            rows.append((path, 8, at, x[at : at + n].tolist()))
            at += n
    rows += [("c", 8, 40, []), ("none", 8, 0, [])]
    chunks = spark.createDataFrame(rows, "path string, sr int, start long, samples array<double>").repartition(4)
    kernel = lambda x, rate: {"s": signal.frames(x, 16, 6).sum(1), "first": signal.frames(x, 16, 6)[:, 0]}
    for tile in (1, 64, 1 << 16):
        got = {(r["path"], r["frame"]): (r["s"], r["first"]) for r in signal.per_frame(chunks, kernel, ["s", "first"], 16, 6, tile).collect()}
        want = {(p, k): f for p, x in whole.items() for k, f in enumerate(signal.frames(x, 16, 6))}
        assert set(got) == set(want)
        assert all(got[k] == pytest.approx((f.sum(), f[0])) for k, f in want.items())
    broken = chunks.where("not (path = 'a b' and start > 20 and start < 300)")
    with pytest.raises(Exception, match="leave a gap"):
        signal.tiles(broken, 16, 6, 1 << 16).collect()


def test_rules_of_rows_agree_with_products_and_votes(spark):
    from rulewright.operators import rule_table, rules
    from rulewright.operators.conditions import ScalarCondition
    from rulewright.operators.models import Branch, Ensemble, Leaf, Tree

    rng = random.Random(3)
    df = spark.createDataFrame([(rng.choice([float("nan"), None, *(x / 4 for x in range(12))]), rng.random() * 3, "p") for _ in range(400)], "a double, b double, y string")
    branch = lambda f, o, t, p, n: Branch(ScalarCondition(f, o, t), p, n)
    trees = [Tree(branch("a", "<", 1.0, Leaf("x"), branch("b", ">=", 2.0, Leaf("y"), Leaf("x")))), Tree(branch("b", "<=", 1.0, Leaf("y"), Leaf("x"))), Tree(branch("a", ">", 2.0, branch("a", "<", 2.5, Leaf("z"), Leaf("y")), Leaf("y")))]
    ensemble = Ensemble(tuple(trees))
    found, table = rule_table.rules_of_rows(df, ensemble)
    listed = {(w["consequent"], w["ncovered"]) for w in rules.measure(df, models.list_rules(ensemble), "y") if w["ncovered"]}
    assert {(r["consequent"], r["ncovered"]) for r in found.collect()} == listed
    counts = {r["rule_id"]: r["n"] for r in rule_table.covered_counts(df, table, "y").groupBy("rule_id").agg(F.sum("n").alias("n")).collect()}
    assert counts == {r["rule_id"]: r["ncovered"] for r in found.collect()}


# -- tuning in shared passes


def test_tuned_candidates_share_passes_and_agree_with_one_by_one(spark):
    from rulewright.operators import tuning

    rng = random.Random(4)
    rows = []
    for i in range(500):
        a, b, c = rng.random(), rng.random(), rng.choice([None, float("nan"), 1.0, 2.0])
        rows.append((i, a, b, c, "p" if (a > 0.5) != (b > 0.5) and rng.random() < 0.9 else "q"))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y string").repartition(3)
    given = [{"depth": 0}, {"depth": 1}, {"depth": 2, "least": 5}, {"depth": 4, "least": 5}, {"depth": 3, "least": 200}]
    names = ["a", "b", "c"]
    together = tuning.tune_trees(df, names, "y", "id", given)
    alone = [tuning.tune_trees(df, names, "y", "id", [g]).scores[0] for g in given[:4]]
    assert together.scores[:4] == alone and together.best == max(given, key=lambda g: together.scores[given.index(g)])
    # held-out accuracy, worked out by applying trees fitted without the fold
    data = tuning.coded_scalars(df, names, "y", "id")
    right = 0
    for f in range(3):
        tree = modal_learning.grow(data, 1, 2, F.array((tuning.fold_of(3) != f).cast("double")), least=5.0)[0][0]
        test = df.withColumn("n", F.col("id")).withColumn("id", F.col("id").cast("string")).where(tuning.fold_of(3) == f)
        right += models.apply_model(test, tree).where("y = prediction").count()
    data.rows.unpersist()
    assert together.scores[2] == pytest.approx(right / 500)
    assert accuracy(df, together.tree) > 0.85
    most = df.groupBy("y").count().agg(F.max("count")).first()[0]
    assert together.scores[0] == pytest.approx(most / 500, abs=0.02)
    halved = tuning.tune_trees(df, names, "y", "id", given, halving=True)
    assert halved.best["depth"] >= 2
    assert tuning.tune_trees(df.limit(0), names, "y", "id", given[:2]).scores == [0.0, 0.0]
    with pytest.raises(ValueError):
        tuning.tune_trees(df, names, "y", "id", [])


def test_passes_do_not_grow_with_candidates(spark):
    from rulewright.operators import tuning

    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("string").alias("y"))
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for n, group in ((1, "one"), (12, "many")):
        spark.sparkContext.setJobGroup(group, group)
        tuning.tune_trees(df, ["x"], "y", "id", [{"depth": 2, "least": k + 1} for k in range(n)])
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]
