"""Queries against their SQL on small tables in which rounding, ties or row counts decide."""

import math
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import canonical
from pyspark.sql import functions as F

import __spark_entry__
from rulewright.functions import signal, treatments
from rulewright.operators import rule_table
from rulewright.operators.conditions import OPERATORS, ScalarCondition
from rulewright.operators.models import Branch, Ensemble, FunctionLeaf, Leaf, Tree
from rulewright.plans import derived


def agrees(spark, folder, name, **tables):
    """Whether a query gives what its SQL gives on the tables."""
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, str(folder)).toPandas()
    return canonical(got) == canonical(con.sql(__spark_entry__.oracle_sql()[name]).df())


def test_prices_a_radius_apart_but_for_rounding(spark, tmp_path):
    prices = [64871.32, 65871.32, 64570.35, 65570.35, 65488.38, 66488.38, 1.0]
    keys = np.arange(len(prices))
    items = pd.DataFrame({"l_orderkey": keys, "l_quantity": keys * 2.5})
    assert agrees(spark, tmp_path, "counts_in_radius", orders=pd.DataFrame({"o_orderkey": keys, "o_totalprice": prices}), lineitem=items)


def test_shares_of_row_counts_are_decimal(spark, tmp_path):
    keys = np.arange(90)  # 0.7 of 90 is 63, and 62.99999999999999 as a product of doubles
    rows = pd.DataFrame({"o_orderkey": keys, "o_custkey": keys, "o_orderpriority": "1-URGENT"})
    assert agrees(spark, tmp_path, "group_split", orders=rows)
    assert agrees(spark, tmp_path, "holdout_assign", orders=rows)


def test_cuts_of_many_rows_are_exact(spark, tmp_path):
    # more rows than an approximate quantile keeps apart
    x = np.random.default_rng(2).normal(size=(24_000, 64)).astype(np.float32)
    rows = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x), "label": (x[:, 0] > 0).astype(np.int32)})
    assert agrees(spark, tmp_path, "modal_forest_learned", embeddings=rows)


def test_clips_of_one_small_file_are_spread(spark, tmp_path):
    pd.DataFrame({"s_suppkey": np.arange(400)}).to_parquet(f"{tmp_path}/supplier.parquet")
    clips = derived.sounds(spark, tmp_path, 8, 4, lambda i, key: i + key)
    sizes = [len(part) for part in clips.rdd.map(lambda r: r["path"]).glom().collect()]
    assert sum(sizes) == 400 and max(sizes) < 60


def test_wavelet_banks_are_made_once():
    bank, freqs = signal.kept_wavelet_bank("morlet", 64, 16)
    assert signal.kept_wavelet_bank("morlet", 64, 16)[0] is bank
    assert np.array_equal(bank, signal.wavelet_bank("morlet", 64, 16)[0]) and np.array_equal(freqs, signal.wavelet_bank("morlet", 64, 16)[1])


def test_medians_at_once_equal_one_by_one():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 4, 5, 6, 40):
        for width in (1, 2, 3, 5, 8):
            x, p = rng.normal(size=n), width // 2
            assert np.array_equal(signal.moving_median(x, width), [np.median(x[max(i - p, 0) : i + p + 1]) for i in range(n)])


def test_groups_are_scaled_where_their_rows_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = treatments.normalise_groups(spark.range(9).selectExpr("id % 2 as g", "double(id) as value"), by=("g",))
        assert "SortMergeJoin" not in out._jdf.queryExecution().toString() and "BroadcastHashJoin" in out._jdf.queryExecution().toString()
        assert sorted(r["value"] for r in out.collect()) == sorted([0.0, 0.25, 0.5, 0.75, 1.0, 0.0, 1 / 3, 2 / 3, 1.0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _items(n):
    rng = np.random.default_rng(7)
    return pd.DataFrame({"l_quantity": rng.integers(1, 51, n) * 1.0, "l_discount": rng.integers(0, 11, n) / 100, "l_tax": rng.integers(0, 9, n) / 100, "l_extendedprice": rng.random(n) * 90_000, "l_returnflag": rng.choice([*"ANR"], n)})


@pytest.mark.parametrize("name", ["rules_of_ten_trees", "measured_rule_table"])
def test_rows_are_counted_by_cells_before_trees_and_rules_see_them(spark, tmp_path, monkeypatch, name):
    seen = []

    def watched(f):
        return lambda df, *rest: (seen.append(df), f(df, *rest))[1]

    monkeypatch.setattr(rule_table, "apply_model", watched(rule_table.apply_model))
    monkeypatch.setattr(rule_table, "_counted", watched(rule_table._counted))
    items = _items(500)
    assert agrees(spark, tmp_path, name, lineitem=items)
    once = [df.count() for df in seen]
    seen.clear()
    assert agrees(spark, tmp_path, name, lineitem=pd.concat([items] * 8))
    assert [df.count() for df in seen] == once and max(once) <= 500


def test_cells_keep_what_conditions_tell_apart(spark):
    inf, most = math.inf, sys.float_info.max
    odd = [None, math.nan, -inf, -most, -1.0, math.nextafter(0.0, -inf), -0.0, 0.0, 5e-324, 1.0, math.nextafter(1.0, 2.0), 2.0, most, inf]
    cuts = [-inf, -most, 0.0, 1.0, math.nextafter(1.0, 2.0), most, inf]
    df = spark.createDataFrame([(x, y) for x in odd for y in (None, "p", "q")], "`a.b` double, y string").repartition(3)
    found = rule_table.cells(df, {"a.b": set(cuts)}, F.col("y")).collect()
    for op in ("<", "<=", ">", ">="):
        for cut in cuts:
            for y in (None, "p", "q"):
                want = sum(x is not None and OPERATORS[op](x, cut) for x in odd)
                assert sum(r["_n"] for r in found if r["_label"] == y and OPERATORS[op](r["a.b"], cut)) == want, (op, cut)
    assert sum(r["_n"] for r in found if math.isnan(r["a.b"])) == 6 and sum(r["_n"] for r in found) == df.count()
    # and through trees
    for op, cut in (("<", 0.0), ("<=", most), (">", -inf), ("<", inf)):
        found, _ = rule_table.rules_of_rows(df, Ensemble((Tree(Branch(ScalarCondition("a.b", op, cut), Leaf("yes"), Leaf("no"))),)))
        yes = 3 * sum(x is not None and OPERATORS[op](x, cut) for x in odd)
        assert {r["consequent"]: r["ncovered"] for r in found.collect()} == {k: n for k, n in (("yes", yes), ("no", 36 - yes)) if n}, (op, cut)


def test_rules_without_thresholds_and_of_empty_tables(spark):
    df = spark.createDataFrame([(1.0, "p"), (2.0, "q"), (None, "q")], "a double, y string")
    one = Ensemble((Tree(Leaf("x")),))
    assert [(r["leaves"], r["consequent"], r["ncovered"]) for r in rule_table.rules_of_rows(df, one)[0].collect()] == [([0], "x", 3)]
    assert rule_table.rules_of_rows(df.limit(0), one)[0].count() == 0
    split = Ensemble((Tree(Branch(ScalarCondition("a", "<", 2.0), Leaf("x"), FunctionLeaf("own", lambda: F.col("y")))),))
    assert {(r["consequent"], r["ncovered"]) for r in rule_table.rules_of_rows(df, split)[0].collect()} == {("x", 1), ("q", 1)}
    whole = spark.createDataFrame([(5, "a", -math.inf, math.inf, False, False, "q"), (6, None, None, None, None, None, "q")], rule_table.SCHEMA)
    assert {(r["rule_id"], r["label"], r["n"]) for r in rule_table.covered_counts(df, whole, "y").collect()} == {(5, "p", 1), (5, "q", 1), (6, "p", 1), (6, "q", 2)}
    whole.persist()
    rule_table.covered_counts(df, whole, "y")
    assert whole.storageLevel.useMemory  # what the caller keeps stays kept
    whole.unpersist()
