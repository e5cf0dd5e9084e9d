import random

import pytest

from rulewright.operators import models as m
from rulewright.operators import rules as r
from rulewright.operators.conditions import OPERATORS, And, ScalarCondition, Truth, conjunction
from rulewright.operators.models import Branch, DecisionList, Ensemble, Leaf, RawNode, Rule, Tree

NAN = float("nan")


def random_tree(rng, depth=3):
    if depth == 0 or rng.random() < 0.15:
        return Leaf(rng.choice("abc"))
    return Branch(ScalarCondition(rng.choice("xyz"), rng.choice(["<", "<=", ">", ">="]), rng.randint(0, 9) / 2), random_tree(rng, depth - 1), random_tree(rng, depth - 1))


def walk(node, row):
    while isinstance(node, Branch):
        v = row[node.condition.feature]
        ok = v is not None and v == v and OPERATORS[node.condition.op](v, node.condition.threshold)
        node = node.positive if ok else node.negative
    return node.outcome


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(i, *[None if rng.random() < 0.05 else NAN if rng.random() < 0.1 else rng.randint(0, 10) / 2 for _ in "xyz"]) for i in range(120)]
    return spark.createDataFrame(data, "id int, x double, y double, z double").persist()


@pytest.mark.parametrize("seed", range(6))
def test_apply_equals_walk_and_rules_partition(rows, seed):
    tree = Tree(random_tree(random.Random(seed)))
    rules = m.list_rules(tree)
    out = m.apply_model(rows, tree)
    for i, rule in enumerate(rules):
        out = out.withColumn(f"r{i}", rule.antecedent.column())
    for row in out.collect():
        assert row["prediction"] == walk(tree.root, row)
        hit = [i for i in range(len(rules)) if row[f"r{i}"]]
        clean = all(row[c] is not None and row[c] == row[c] for c in "xyz")
        assert len(hit) == 1 if clean else len(hit) <= 1
        if hit:
            assert rules[hit[0]].consequent.outcome == row["prediction"]


@pytest.mark.parametrize("n", [5, 30])
def test_ensembles(rows, n):
    rng = random.Random(n)
    e = Ensemble(tuple(Tree(random_tree(rng)) for _ in range(n)), tuple(rng.choice((0.5, 1.0, 2.0)) for _ in range(n)))
    for row in m.apply_model(rows, e).collect():
        totals = {}
        for t, w in zip(e.trees, e.weights, strict=True):
            totals[walk(t.root, row)] = totals.get(walk(t.root, row), 0) + w
        assert row["prediction"] == min(totals, key=lambda k: (-totals[k], k))
    with pytest.raises(ValueError):
        Ensemble(())


def test_product_rules_agree_with_the_vote(rows):
    rng = random.Random(2)
    e = Ensemble(tuple(Tree(random_tree(rng, 2)) for _ in range(3)))
    rules = m.list_rules(e)
    out = m.apply_model(rows.na.drop().where("not (isnan(x) or isnan(y) or isnan(z))"), e)
    for i, rule in enumerate(rules):
        out = out.withColumn(f"r{i}", rule.antecedent.column())
    for row in out.collect():
        hit = [i for i in range(len(rules)) if row[f"r{i}"]]
        assert len(hit) == 1 and rules[hit[0]].consequent.outcome == row["prediction"]
    with pytest.raises(ValueError):
        m.list_rules(e, m.RuleOptions(most_products=2))


def test_relational_round_trip(spark, rows):
    rng = random.Random(9)
    e = Ensemble(tuple(Tree(random_tree(rng)) for _ in range(3)), (1.0, 2.0, 0.5))
    back = m.from_table(m.to_table(spark, e, "m"))
    assert back.trees == e.trees and back.weights == e.weights
    heads, atoms = m.rule_tables(spark, m.list_rules(e.trees[0], m.RuleOptions(simplify=True, ranges=True)), "m")
    assert heads.count() == len(m.leaves(e.trees[0])) and atoms.count() >= 0


def test_conversion_and_introspection():
    raw = RawNode(0, 2.5, RawNode(majority=1), RawNode(1, 0.5, RawNode(majority=0), RawNode(majority=1)))
    t = m.convert(raw, ["x", "y"], ["a", "b"])
    assert m.height(t) == 2 and len(m.leaves(t)) == 3 and m.is_complete(t)
    assert [str(x.antecedent) for x in m.list_rules(t)] == ["x < 2.5", "(x ≥ 2.5) ∧ (y < 0.5)", "(x ≥ 2.5) ∧ (y ≥ 0.5)"]
    assert not m.is_complete(Rule(Truth(True), Leaf("a")))
    assert "✔" in m.describe(t) and "…" in m.describe(t, depth=1)
    assert "else" in m.describe(DecisionList((Rule(t.root.condition, Leaf("a")),), Leaf("b")))
    assert m.rules_text(m.list_rules(t)).count("\n") == 2
    assert len(m.immediate_rules(t.root)) == 2


def test_metrics_prune_select_and_list(spark):
    rng = random.Random(1)
    data = [(x := rng.random(), y := rng.random(), "p" if x < 0.5 else "q") for _ in range(300)]
    df = spark.createDataFrame(data, "x double, y double, label string").persist()
    good = Rule(conjunction([ScalarCondition("x", "<", 0.5), ScalarCondition("y", "<", 0.9)]), Leaf("p"))
    poor = Rule(ScalarCondition("y", ">", 2.0), Leaf("q"))
    got = r.measure(df, [good, poor], "label")
    assert got[0]["confidence"] == 1.0 and got[0]["natoms"] == 2 and got[1]["confidence"] is None and got[1]["ncovered"] == 0
    assert abs(got[0]["lift"] - 300 / sum(d[2] == "p" for d in data)) < 1e-9
    pruned = r.prune(df, [good], "label")
    assert str(pruned[0].antecedent) == "x < 0.5"
    tree = Tree(Branch(ScalarCondition("x", "<", 0.5), Branch(ScalarCondition("y", "<", 0.3), Leaf("p"), Leaf("p")), Leaf("q")))
    for selector in (None, "cfs", "cbc"):
        found = r.extract(df, Ensemble((tree,)), "label", r.ExtractorOptions(selector=selector))
        assert m.apply_model(df, found).where("prediction <> label").count() == 0
    with pytest.raises(ValueError):
        r.ExtractorOptions(selector="other")
    learnt = r.learn_covering(df, ["x", "y"], "label", r.CoveringOptions(thresholds=7))
    assert m.apply_model(df, learnt).where("prediction <> label").count() < 60


def test_sequential_list_covers_every_row(rows):
    df = rows.selectExpr("*", "case when x < 2 then 'a' else 'b' end as label")
    found = r.sequential_list(df, [Rule(ScalarCondition("x", "<", 2.0), Leaf("a"))], "label")
    assert m.apply_model(df, found).where("prediction is null").count() == 0


def test_symmetric_uncertainty():
    assert abs(r.symmetric_uncertainty({(0, 0): 5, (1, 1): 5}) - 1) < 1e-12
    assert r.symmetric_uncertainty({(0, 0): 5}) == 0.0
    assert And(()).render() == "⊤"


def test_counted_votes_equal_votes_over_arrays(spark):
    """Packed counts, sums by label and the array form agree, ties and rows without a vote included."""
    from rulewright.operators import models

    rows = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else float(i % 11)) for i in range(200)], "i long, a double, b double")
    leaves = [Leaf("x"), Leaf("y"), Leaf("z"), Leaf(None)]
    trees = tuple(Tree(Branch(ScalarCondition("ab"[k % 2], "<", 1.0 + k % 6), leaves[k % 4], leaves[(k * k + 1) % 4])) for k in range(9))
    for weights in (None, tuple(0.5 + k % 3 for k in range(9))):
        m = Ensemble(trees, weights)
        out = rows.select(models._counted_votes(m, False).alias("p"), models.majority(m.predictions(), weights).alias("q")).collect()
        assert all(r["p"] == r["q"] for r in out) and len({r["p"] for r in out}) > 1
    none = Ensemble((Tree(Leaf(None)), Tree(Leaf("x"))))
    assert rows.select(none.column().alias("p")).first()["p"] == "x"


def test_forests_with_several_operators_in_batches(spark):
    from rulewright.operators import models

    rows = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else float("nan") if i % 9 == 0 else float(i % 11)) for i in range(300)], "i long, a double, b double")
    ops = ("<", "<=", ">", ">=", "==", "!=")
    trees = tuple(Tree(Branch(ScalarCondition("ab"[k % 2], ops[k % 6], float(k % 8)), Leaf("xyz"[k % 3]), Branch(ScalarCondition("a", ops[(k + 1) % 6], 3.0), Leaf("x"), Leaf("y")))) for k in range(30))
    m = Ensemble(trees)
    out = models.apply_model(rows, m).withColumn("q", models.majority(m.predictions())).collect()
    assert all(r["prediction"] == r["q"] for r in out)


def test_predictions_are_added_or_replaced(spark):
    from rulewright.operators import models

    rows = spark.createDataFrame([(1.0,), (5.0,)], "a double")
    m = Tree(Branch(ScalarCondition("a", "<", 3.0), Leaf("lo"), Leaf("hi")))
    twice = models.collect_predictions(models.collect_predictions(rows, m), m)
    assert [r["predictions"] for r in twice.collect()] == [["lo", "lo"], ["hi", "hi"]]
    assert [r["predictions"] for r in models.collect_predictions(twice, m, mode="replace").collect()] == [["lo"], ["hi"]]
    with pytest.raises(ValueError):
        models.collect_predictions(rows, m, mode="both")
