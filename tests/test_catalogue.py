import pytest
from conftest import canonical

import __spark_entry__
from rulewright.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, data, oracle, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    want = oracle.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 5
    assert sum(r["ncovered"] for r in rows) == rows[0]["ninstances"]


def test_every_query_is_named_once():
    assert set(catalogue.ORACLES) <= set(__spark_entry__.queries())


def test_forest_batches_equal_a_walk(spark, data):
    from rulewright.operators.conditions import OPERATORS
    from rulewright.operators.models import Leaf

    forest = catalogue._forest(50)
    assert catalogue.QUERIES["forest_apply"](spark, data).count() == catalogue.lineitem(spark, data).count()
    rows = catalogue.models.apply_model(catalogue.lineitem(spark, data), forest).limit(300).collect()

    def walk(m, r):
        while not isinstance(m, Leaf):
            m = m.positive if OPERATORS[m.condition.op](r[m.condition.feature], m.condition.threshold) else m.negative
        return m.outcome

    for r in rows:
        votes = [walk(t.root, r) for t in forest.trees]
        assert r["prediction"] == min(set(votes), key=lambda v: (-votes.count(v), v))


def test_boosting_error_falls(spark, data):
    mse = [r["mse"] for r in catalogue.QUERIES["boosting_fit"](spark, data).orderBy("rounds").collect()]
    assert all(b <= a for a, b in zip(mse, mse[1:], strict=False)) and mse[-1] < mse[0]


def test_learners_give_rows(spark, data):
    assert catalogue.QUERIES["samme_fit"](spark, data).first()["accuracy"] > 0.4
    assert catalogue.QUERIES["rule_extraction"](spark, data).count() >= 1
    assert sum(r["n"] for r in catalogue.QUERIES["covering_list"](spark, data).collect()) == catalogue.lineitem(spark, data).count()
    assert {r["measure"] for r in catalogue.QUERIES["analysis"](spark, data).collect()} == {"accuracy", "kappa"}


def test_selection_pipeline(spark, data):
    mid = catalogue.QUERIES["selection_pipeline"](spark, data).toPandas()
    assert mid[mid.step == 0].kept.sum() == 6 and len(mid[mid.step == 1]) == 6
