"""Query catalogue: every operator applied to the driver's tables, with its DuckDB oracle.

Each entry runs over whole tables. Values that add up many doubles are rounded on both
sides, since two engines add in different orders. Queries without SQL are compared with
plain Python in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, catch22, signal, treatments, windows
from ..functions.windows import Windowing
from ..operators import boosting, conditions, evaluation, models, relational, rules, selection
from ..operators.conditions import ObliqueCondition, RangeCondition, ScalarCondition, conjunction, parse_condition, parse_formula
from ..operators.modal import ModalCondition
from ..operators.models import Branch, DecisionList, Ensemble, Leaf, Rule, Tree
from ..sources import tables
from ..streaming import series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, and its oracle if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

TREE = Tree(
    Branch(
        ScalarCondition("l_quantity", "<", 24.0),
        Branch(ScalarCondition("l_discount", "<", 0.05), Leaf("A"), Leaf("N")),
        Branch(ScalarCondition("l_extendedprice", "<", 60000.0), Leaf("R"), Branch(ScalarCondition("l_tax", "<", 0.04), Leaf("N"), Leaf("A"))),
    )
)
TREE_SQL = """CASE WHEN l_quantity < 24 THEN CASE WHEN l_discount < 0.05 THEN 'A' ELSE 'N' END
  ELSE CASE WHEN l_extendedprice < 60000 THEN 'R' ELSE CASE WHEN l_tax < 0.04 THEN 'N' ELSE 'A' END END END"""
STUMPS = [
    Tree(Branch(ScalarCondition("l_quantity", "<", 24.0), Leaf("A"), Leaf("R"))),
    Tree(Branch(ScalarCondition("l_discount", ">=", 0.05), Leaf("N"), Leaf("A"))),
    Tree(Branch(ScalarCondition("l_tax", "<=", 0.03), Leaf("R"), Leaf("N"))),
    Tree(Branch(ScalarCondition("l_extendedprice", ">", 40000.0), Leaf("N"), Leaf("A"))),
]
STUMPS_SQL = [
    "CASE WHEN l_quantity < 24 THEN 'A' ELSE 'R' END",
    "CASE WHEN l_discount >= 0.05 THEN 'N' ELSE 'A' END",
    "CASE WHEN l_tax <= 0.03 THEN 'R' ELSE 'N' END",
    "CASE WHEN l_extendedprice > 40000 THEN 'N' ELSE 'A' END",
]
WEIGHTS = (1.0, 0.5, 0.75, 0.5)


def lineitem(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


# -- conditions, trees and rules ----------------------------------------------------------


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {TREE_SQL} AS prediction FROM lineitem")
def tree_apply(spark, sf_dir):
    return models.apply_model(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), TREE).select(*KEYS, "prediction")


RULES = [
    ("(l_quantity < 24.0) ∧ (l_discount < 0.05)", "l_quantity < 24 AND l_discount < 0.05", "A", 2),
    ("(l_quantity < 24.0) ∧ (l_discount ≥ 0.05)", "l_quantity < 24 AND l_discount >= 0.05", "N", 2),
    ("(l_quantity ≥ 24.0) ∧ (l_extendedprice < 60000.0)", "l_quantity >= 24 AND l_extendedprice < 60000", "R", 2),
    ("(l_quantity ≥ 24.0) ∧ (l_extendedprice ≥ 60000.0) ∧ (l_tax < 0.04)", "l_quantity >= 24 AND l_extendedprice >= 60000 AND l_tax < 0.04", "N", 3),
    ("(l_quantity ≥ 24.0) ∧ (l_extendedprice ≥ 60000.0) ∧ (l_tax ≥ 0.04)", "l_quantity >= 24 AND l_extendedprice >= 60000 AND l_tax >= 0.04", "A", 3),
]
_ONE_RULE = """SELECT {i}::int AS rule_id, '{text}' AS rule, '{label}' AS consequent, {n}::int AS natoms, count(*) AS ninstances, count(*) FILTER (WHERE {sql}) AS ncovered,
  round(count(*) FILTER (WHERE {sql}) / count(*)::double, 6) AS coverage,
  round(count(*) FILTER (WHERE {sql} AND l_returnflag = '{label}') / nullif(count(*) FILTER (WHERE {sql}), 0)::double, 6) AS confidence,
  round((count(*) FILTER (WHERE {sql} AND l_returnflag = '{label}') / nullif(count(*) FILTER (WHERE {sql}), 0)::double) / (count(*) FILTER (WHERE l_returnflag = '{label}') / count(*)::double), 6) AS lift,
  round(1 - count(*) FILTER (WHERE {sql} AND l_returnflag = '{label}') / nullif(count(*) FILTER (WHERE {sql}), 0)::double, 6) AS error FROM lineitem"""
RULES_SQL = " UNION ALL ".join(_ONE_RULE.format(i=i, text=t, sql=s, label=c, n=n) for i, (t, s, c, n) in enumerate(RULES))


@query(RULES_SQL)
def rule_metrics(spark, sf_dir):
    out = rules.rule_metrics(lineitem(spark, sf_dir), models.list_rules(TREE), "l_returnflag")
    return out.select("rule_id", "rule", "consequent", "natoms", "ninstances", "ncovered", *[r6(F.col(c)).alias(c) for c in ("coverage", "confidence", "lift", "error")])


@query(f"SELECT rule_id, ncovered, confidence FROM ({RULES_SQL}) WHERE coverage >= 0.1 AND confidence >= 0.2 AND natoms <= 2")
def rule_filter(spark, sf_dir):
    metrics = rules.rule_metrics(lineitem(spark, sf_dir), models.list_rules(TREE), "l_returnflag")
    kept = rules.filter_rules(metrics, min_coverage=0.1, min_confidence=0.2, keep=lambda m: F.col("natoms") <= 2)
    return kept.select("rule_id", "ncovered", r6(F.col("confidence")).alias("confidence"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20")
def range_condition(spark, sf_dir):
    return conditions.select_rows(lineitem(spark, sf_dir), RangeCondition("l_quantity", 10.0, 20.0, True, False)).select(*KEYS)


@query("SELECT l_orderkey, l_linenumber, l_partkey, ((l_quantity - 25) * 0.5 + (l_discount - 0.05) * -100.0) >= 0 AS holds FROM lineitem")
def oblique_condition(spark, sf_dir):
    c = ObliqueCondition(("l_quantity", "l_discount"), (25.0, 0.05), (0.5, -100.0))
    return conditions.check(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), c).select(*KEYS, "holds")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity >= 30 AS dual_holds, (l_quantity < 30 AND l_tax > 0.02) OR NOT (l_discount <= 0.03) AS formula_holds FROM lineitem")
def parsed_formula(spark, sf_dir):
    df = lineitem(spark, sf_dir).select(*KEYS, *FEATURES)
    df = conditions.check(df, parse_condition("l_quantity < 30").dual, "dual_holds")
    return conditions.check(df, parse_formula("(l_quantity < 30 ∧ l_tax > 0.02) ∨ ¬ l_discount <= 0.03"), "formula_holds").select(*KEYS, "dual_holds", "formula_holds")


@query("SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS price FROM lineitem WHERE l_quantity > 5 AND l_quantity <= 20 AND l_tax >= 0.02")
def simplified_conjunction(spark, sf_dir):
    f = conjunction(ScalarCondition(*x) for x in (("l_quantity", ">", 2.0), ("l_quantity", "<=", 20.0), ("l_tax", ">=", 0.02), ("l_quantity", ">", 5.0), ("l_quantity", "<", 40.0)))
    return conditions.select_rows(lineitem(spark, sf_dir), conditions.simplify(f)).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("price"))


@query(
    "SELECT feature, op, threshold, n FROM (SELECT 'l_quantity' AS feature, '<' AS op, t AS threshold, (SELECT count(*) FROM lineitem WHERE l_quantity < t) AS n "
    "FROM (VALUES (10.0::double), (25.0::double), (40.0::double)) v(t) UNION ALL SELECT 'l_tax', '>=', t, (SELECT count(*) FROM lineitem WHERE l_tax >= t) FROM (VALUES (0.02::double), (0.06::double)) v(t))"
)
def alphabet_support(spark, sf_dir):
    """Rows that satisfy each atom of an alphabet."""
    a = conditions.Alphabet(((conditions.MetaCondition("l_quantity", "<"), (10.0, 25.0, 40.0)), (conditions.MetaCondition("l_tax", ">="), (0.02, 0.06))))
    atoms = a.atoms()
    counts = lineitem(spark, sf_dir).agg(*[F.count_if(x.column()).alias(f"n{i}") for i, x in enumerate(atoms)])
    rows = F.array(*[F.struct(F.lit(x.feature).alias("feature"), F.lit(x.op).alias("op"), F.lit(x.threshold).alias("threshold"), F.col(f"n{i}").alias("n")) for i, x in enumerate(atoms)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 10 THEN 'A' WHEN l_discount >= 0.08 AND l_tax < 0.05 THEN 'R' ELSE 'N' END AS prediction FROM lineitem"
)
def decision_list_apply(spark, sf_dir):
    m = DecisionList(
        (Rule(ScalarCondition("l_quantity", "<", 10.0), Leaf("A")), Rule(conjunction([ScalarCondition("l_discount", ">=", 0.08), ScalarCondition("l_tax", "<", 0.05)]), Leaf("R"))), Leaf("N")
    )
    return models.apply_model(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), m).select(*KEYS, "prediction")


_VOTES = " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {s} AS label, {w}::double AS w FROM lineitem" for s, w in zip(STUMPS_SQL, WEIGHTS, strict=True))


def _vote_sql(weight: str) -> str:
    parts = [f"(CASE WHEN {s} = '{c}' THEN {w if weight == 'w' else 1} ELSE 0 END)" for c in "ANR" for s, w in zip(STUMPS_SQL, WEIGHTS, strict=True)]
    a, n, r = (" + ".join(parts[4 * k : 4 * k + 4]) for k in range(3))
    return (
        f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS prediction "
        f"FROM (SELECT l_orderkey, l_linenumber, l_partkey, {a} AS a, {n} AS n, {r} AS r FROM lineitem)"
    )


@query(_vote_sql("n"))
def ensemble_vote(spark, sf_dir):
    return models.apply_model(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), Ensemble(tuple(STUMPS))).select(*KEYS, "prediction")


@query(_vote_sql("w"))
def weighted_vote(spark, sf_dir):
    return models.apply_model(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), Ensemble(tuple(STUMPS), WEIGHTS)).select(*KEYS, "prediction")


@query(
    "SELECT o_orderkey, label, total FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY total DESC, label) AS k FROM (SELECT l_orderkey AS o_orderkey, l_returnflag AS label, "
    "sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2)) WHERE k = 1"
)
def weighted_vote_rows(spark, sf_dir):
    """The flag with the largest quantity of each order, as a vote over rows."""
    votes = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("w"))
    return relational.weighted_vote(votes, "o_orderkey", "label", "w")


@query(
    "SELECT o_orderkey, label, total FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY total DESC, label) AS k FROM (SELECT l_orderkey AS o_orderkey, l_returnflag AS label, "
    "count(*)::bigint AS total FROM lineitem GROUP BY 1, 2)) WHERE k = 1"
)
def majority_vote_rows(spark, sf_dir):
    votes = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("label"))
    return relational.majority_vote(votes, "o_orderkey", "label")


NUMBERS = [Tree(Branch(ScalarCondition("l_quantity", "<", t), Leaf(lo), Leaf(hi))) for t, lo, hi in ((10.0, 8000.0, 42000.0), (25.0, 19000.0, 57000.0), (40.0, 30000.0, 67000.0))]


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, round(((CASE WHEN l_quantity < 10 THEN 8000.0 ELSE 42000.0 END)::double + (CASE WHEN l_quantity < 25 THEN 19000.0 ELSE 57000.0 END)::double "
    "+ (CASE WHEN l_quantity < 40 THEN 30000.0 ELSE 67000.0 END)::double) / 3, 6) AS prediction FROM lineitem"
)
def regression_vote(spark, sf_dir):
    return models.apply_model(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), Ensemble(tuple(NUMBERS), numeric=True)).select(*KEYS, r6(F.col("prediction")).alias("prediction"))


def _forest(n: int) -> Ensemble:
    """A forest of n trees of depth 5 from arithmetic, for the batched scorer."""
    spans = {"l_quantity": 50.0, "l_extendedprice": 100000.0, "l_discount": 0.1, "l_tax": 0.08}

    def build(i: int, depth: int, path: int):
        if depth == 5:
            return Leaf("ANR"[(i * 7 + path * 5) % 3])
        f = FEATURES[(i + depth + path) % 4]
        return Branch(ScalarCondition(f, "<", spans[f] * ((i * 13 + path * 7 + depth * 3) % 19 + 1) / 20), build(i, depth + 1, 2 * path), build(i, depth + 1, 2 * path + 1))

    return Ensemble(tuple(Tree(build(i, 0, 1)) for i in range(n)))


def _forest_sql(n: int) -> str:
    def case(m) -> str:
        if isinstance(m, Leaf):
            return f"'{m.outcome}'"
        return f"CASE WHEN {m.condition.feature} < {m.condition.threshold!r}::double THEN {case(m.positive)} ELSE {case(m.negative)} END"

    votes = ", ".join(f"{case(t.root)} AS t{k}" for k, t in enumerate(_forest(n).trees))
    sums = ", ".join(" + ".join(f"(t{k} = '{c}')::int" for k in range(n)) + f" AS {c.lower()}" for c in "ANR")
    return f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS prediction FROM (SELECT l_orderkey, l_linenumber, l_partkey, {sums} FROM (SELECT *, {votes} FROM lineitem))"


@query(_forest_sql(50))
def forest_apply(spark, sf_dir):
    """A forest of 50 trees, in Arrow batches."""
    return models.apply_model(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), _forest(50)).select(*KEYS, "prediction")


@query(
    "SELECT path, label, count(*)::bigint AS n FROM (SELECT l_returnflag AS label, unnest(CASE WHEN l_quantity < 24 THEN CASE WHEN l_discount < 0.05 THEN ['', 'p', 'pp'] ELSE ['', 'p', 'pn'] END "
    "ELSE CASE WHEN l_extendedprice < 60000 THEN ['', 'n', 'np'] ELSE CASE WHEN l_tax < 0.04 THEN ['', 'n', 'nn', 'nnp'] ELSE ['', 'n', 'nn', 'nnn'] END END END) AS path FROM lineitem) GROUP BY 1, 2"
)
def node_supports(spark, sf_dir):
    return models.node_supports(lineitem(spark, sf_dir), TREE, "l_returnflag")


BOOSTED = [
    Tree(Branch(ScalarCondition("l_quantity", "<", 24.1), Leaf(None, 0.14), Leaf(None, -0.07))),
    Tree(Branch(ScalarCondition("l_discount", "<", 0.05), Leaf(None, -0.07), Leaf(None, 0.11))),
    Tree(Branch(ScalarCondition("l_tax", "<", 0.04), Leaf(None, 0.02), Leaf(None, 0.05))),
    Tree(Branch(ScalarCondition("l_extendedprice", "<", 40000.5), Leaf(None, 0.03), Leaf(None, -0.02))),
    Tree(Leaf(None, 0.01)),
    Tree(Branch(ScalarCondition("l_discount", "<", 0.08), Leaf(None, 0.04), Leaf(None, -0.06))),
]
_BOOST_SQL = [
    "CASE WHEN l_quantity::float < 24.1::float THEN 0.14::float ELSE (-0.07)::float END",
    "CASE WHEN l_discount::float < 0.05::float THEN (-0.07)::float ELSE 0.11::float END",
    "CASE WHEN l_tax::float < 0.04::float THEN 0.02::float ELSE 0.05::float END",
    "CASE WHEN l_extendedprice::float < 40000.5::float THEN 0.03::float ELSE (-0.02)::float END",
    "0.01::float",
    "CASE WHEN l_discount::float < 0.08::float THEN 0.04::float ELSE (-0.06)::float END",
]


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS prediction,
  round(exp(a) / (exp(a) + exp(n) + exp(r)), 4) AS pa, round(exp(n) / (exp(a) + exp(n) + exp(r)), 4) AS pn FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, (({_BOOST_SQL[0]}) + ({_BOOST_SQL[3]}))::double AS a, (({_BOOST_SQL[1]}) + ({_BOOST_SQL[4]}))::double AS n, (({_BOOST_SQL[2]}) + ({_BOOST_SQL[5]}))::double AS r FROM lineitem)"""
)
def boosted_softprob(spark, sf_dir):
    out = boosting.boosted_inference(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), BOOSTED, "multi:softprob", ["A", "N", "R"])
    return out.select(*KEYS, "prediction", F.round(F.col("probabilities")[0], 4).alias("pa"), F.round(F.col("probabilities")[1], 4).alias("pn"))


_SUM6 = " + ".join(f"({s})" for s in _BOOST_SQL)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-s)), 4) AS probability, CASE WHEN 1 / (1 + exp(-s)) > 0.5 THEN 'O' ELSE 'F' END AS prediction FROM (SELECT *, ({_SUM6})::double AS s FROM lineitem)")
def boosted_logistic(spark, sf_dir):
    out = boosting.boosted_inference(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), BOOSTED, "binary:logistic", ["F", "O"])
    return out.select(*KEYS, F.round("probability", 4).alias("probability"), "prediction")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(exp(({_SUM6})::double), 4) AS prediction FROM lineitem")
def boosted_poisson(spark, sf_dir):
    return boosting.boosted_inference(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), BOOSTED, "count:poisson").select(*KEYS, F.round("prediction", 4).alias("prediction"))


@query(
    "SELECT feature, threshold, round(gain, 2) AS gain FROM (SELECT *, row_number() OVER (ORDER BY gain DESC, feature, threshold) AS k FROM (SELECT feature, (v + after) / 2 AS threshold, "
    "0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM (SELECT feature, v, lead(v) OVER w AS after, sum(g) OVER w AS gl, sum(h) OVER w AS hl, "
    "sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht FROM (SELECT feature, v, sum(g) AS g, sum(h) AS h FROM (SELECT 0 AS feature, l_quantity AS v, 0.0 - l_extendedprice AS g, 1.0 AS h FROM lineitem "
    "UNION ALL SELECT 1, l_discount + 0, 0.0 - l_extendedprice, 1.0 FROM lineitem) GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature ORDER BY v)) WHERE after IS NOT NULL AND hl >= 1 AND ht - hl >= 1)) WHERE k = 1"
)
def best_split(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select("l_quantity", (F.col("l_discount") + 0).alias("l_discount"), F.lit("root").alias("node"), (F.lit(0.0) - F.col("l_extendedprice")).alias("g"), F.lit(1.0).alias("h"))
    best = boosting.best_splits(rows, ["l_quantity", "l_discount"])
    return best.select(F.when(F.col("feature") == "l_quantity", 0).otherwise(1).alias("feature"), "threshold", F.round("gain", 2).alias("gain"))


@query(
    "SELECT round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - avg(e * e) / var_pop(l_extendedprice), 6) AS r2 "
    "FROM (SELECT l_extendedprice, l_extendedprice - (1400 * l_quantity + 2000) AS e FROM lineitem)"
)
def regression_measures(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("p", F.col("l_quantity") * 1400 + 2000)
    return boosting.regression_errors(df, "l_extendedprice", "p").select(F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), r6(F.col("r2")).alias("r2"))


@query()
def boosting_fit(spark, sf_dir):
    """Five rounds of boosting on lineitem: the error after each number of rounds."""
    df = lineitem(spark, sf_dir).select(*FEATURES[:1], *FEATURES[2:], "l_extendedprice")
    m = boosting.boost_regression(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", boosting.BoostOptions(rounds=5, depth=2))
    stages = [boosting.Boosted(m.base, m.eta, m.trees[:k]).column() for k in range(len(m.trees) + 1)]
    errors = df.agg(*[F.avg(F.pow(F.col("l_extendedprice") - s, F.lit(2))).alias(f"m{k}") for k, s in enumerate(stages)])
    found = errors.select(F.posexplode(F.array(*[F.col(f"m{k}") for k in range(len(stages))])).alias("rounds", "mse"))
    return found.select(F.col("rounds").cast("long").alias("rounds"), F.round("mse", 1).alias("mse"))


@query()
def samme_fit(spark, sf_dir):
    """Stage-wise stumps on the line status: the accuracy of the ensemble."""
    df = lineitem(spark, sf_dir).select(*FEATURES, "l_linestatus")
    m = boosting.samme(df, FEATURES, "l_linestatus", rounds=3)
    return models.apply_model(df, m.ensemble()).agg(r6(evaluation.accuracy(df, "l_linestatus", "prediction")).alias("accuracy"), F.count("*").alias("n"))


@query()
def rule_extraction(spark, sf_dir):
    """Rules of an ensemble, pruned and put in a list, with their metrics."""
    df = lineitem(spark, sf_dir).select(*FEATURES, "l_returnflag")
    found = rules.extract(df, Ensemble((TREE, *STUMPS[:2])), "l_returnflag", rules.ExtractorOptions(selector="cfs", max_rules=6))
    if not found.rules:
        return rules.rule_metrics(df, [Rule(conditions.Truth(True), found.default)], "l_returnflag")
    return rules.rule_metrics(df, list(found.rules), "l_returnflag")


@query()
def covering_list(spark, sf_dir):
    df = lineitem(spark, sf_dir).select(*FEATURES, "l_returnflag")
    found = rules.learn_covering(df, FEATURES, "l_returnflag", rules.CoveringOptions(beam=2, max_atoms=2, thresholds=3, max_rules=2))
    return models.apply_model(df, found).groupBy("prediction").agg(F.count("*").alias("n"))


# -- series -------------------------------------------------------------------------------


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


_E = "SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings"
_MEAN = "list_sum(e) / len(e)"


@query(
    f"SELECT vec_id, round(list_min(e), 6) AS minimum, round(list_max(e), 6) AS maximum, round({_MEAN}, 6) AS mean, round(list_median(e), 6) AS median, "
    f"round(sqrt(list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / (len(e) - 1)), 6) AS std, round(list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / (len(e) - 1), 6) AS var "
    f"FROM (SELECT *, {_MEAN} AS m FROM ({_E}))"
)
def array_features(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", *[r6(arrays.feature(f)(F.col("e"))).alias(f) for f in ("minimum", "maximum", "mean", "median", "std", "var")])


def _windows_sql() -> str:
    cells = [f"round({agg.format(s=f'e[{lo}:{lo + n - 1}]', n=n)}, 6) AS \"{f}(e)w{i}\"" for f, agg in (("maximum", "list_max({s})"), ("mean", "list_sum({s}) / {n}")) for i, (lo, n) in enumerate(windows.overlapping(64, 5, 0.2), 1)]
    return f"SELECT vec_id, {', '.join(cells)} FROM ({_E})"


@query(_windows_sql())
def window_features(spark, sf_dir):
    out = treatments.aggregate(embeddings(spark, sf_dir), ["e"], ["maximum", "mean"], Windowing("overlapping", 5, 0.2), 64, ["vec_id"])
    return out.select("vec_id", *[r6(F.col(f"`{c}`")).alias(c) for c in out.columns[1:]])


@query(
    "SELECT vec_id, i AS win, round(v, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT vec_id, {i} AS i, list_sum(e[{lo}:{lo + n - 1}]) / {n} AS v FROM ({_E})" for i, (lo, n) in enumerate(windows.segments(64, 6), 1)) + ")"
)
def reduce_size(spark, sf_dir):
    out = treatments.reduce_size(embeddings(spark, sf_dir), ["e"], Windowing("segments", 6), "mean", 64)
    return out.select("vec_id", F.posexplode("e").alias("k", "v")).select("vec_id", (F.col("k") + 1).alias("win"), r6(F.col("v")).alias("value"))


@query(
    "SELECT vec_id, label, 'e' AS var, win, fun, round(value, 6) AS value FROM ("
    + " UNION ALL ".join(f"SELECT vec_id, label, {i} AS win, '{f}' AS fun, {agg.format(s=f'e[{lo}:{lo + n - 1}]', n=n)} AS value FROM ({_E})" for f, agg in (("minimum", "list_min({s})"), ("mean", "list_sum({s}) / {n}")) for i, (lo, n) in enumerate(windows.overlapping(64, 3, 0.05), 1))
    + ")"
)
def long_features(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    out = treatments.long_features(df, "vec_id", ["e"], ["minimum", "mean"], Windowing("overlapping", 3, 0.05), 64)
    return out.withColumnRenamed("row_id", "vec_id").join(df.select("vec_id", "label"), "vec_id").select("vec_id", "label", "var", "win", "fun", r6(F.col("value")).alias("value"))


@query(
    f"SELECT vec_id, k, round(e[lo + 1] + (e[least(lo + 2, 64)] - e[lo + 1]) * (place - lo), 6) AS value FROM (SELECT vec_id, e, k, k * 63 / 9.0 AS place, floor(k * 63 / 9.0)::int AS lo FROM ({_E}), (SELECT unnest(range(10)) AS k))"
)
def resample_series(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(arrays.resample(F.col("e"), 10)).alias("k", "v")).select("vec_id", F.col("k").cast("long").alias("k"), r6(F.col("v")).alias("value"))


@query(f"SELECT vec_id, k, CASE WHEN k < 64 THEN round(e[k + 1], 6) ELSE -1.0 END AS value FROM ({_E}), (SELECT unnest(range(60, 70)) AS k)")
def pad_series(spark, sf_dir):
    padded = arrays.pad_or_cut(F.col("e"), 70)
    out = embeddings(spark, sf_dir).select("vec_id", F.posexplode(padded).alias("k", "v")).where("k >= 60")
    return out.select("vec_id", F.col("k").cast("long").alias("k"), r6(F.nanvl("v", F.lit(-1.0))).alias("value"))


@query(f"SELECT vec_id, f, round(list_sum(e[f * 8 + 1 : f * 8 + 16]), 6) AS total FROM ({_E}), (SELECT unnest(range(7)) AS f)")
def frames(spark, sf_dir):
    out = embeddings(spark, sf_dir).select("vec_id", F.posexplode(windows.frames(F.col("e"), 16, 8)).alias("f", "x"))
    return out.select("vec_id", F.col("f").cast("long").alias("f"), r6(arrays.total(F.col("x"))).alias("total"))


@query(
    f"""WITH e AS ({_E}), x AS (SELECT vec_id, unnest(e) AS v, unnest(range(64)) AS i FROM e), s AS (SELECT vec_id, avg(v) AS m, stddev_samp(v) AS s FROM x GROUP BY 1),
d AS (SELECT x.vec_id, x.i, x.v - lag(x.v) OVER (PARTITION BY x.vec_id ORDER BY x.i) AS d, x.v > s.m AS up, s.s FROM x JOIN s USING (vec_id)),
a AS (SELECT vec_id, round(avg(power(d / s, 3)), 5) AS trev, round(avg((abs(d) > 0.04 * s)::int::double), 6) AS high_fluctuation FROM d WHERE d IS NOT NULL GROUP BY 1),
g AS (SELECT vec_id, i, up, coalesce(d < 0, false) AS down, i - row_number() OVER (PARTITION BY vec_id, up ORDER BY i) AS gu, i - row_number() OVER (PARTITION BY vec_id, coalesce(d < 0, false) ORDER BY i) AS gd FROM d),
u AS (SELECT vec_id, max(n)::double AS stretch_high FROM (SELECT vec_id, count(*) AS n FROM g WHERE up GROUP BY vec_id, gu) GROUP BY 1),
w AS (SELECT vec_id, max(n)::double AS stretch_decreasing FROM (SELECT vec_id, count(*) AS n FROM g WHERE down GROUP BY vec_id, gd) GROUP BY 1)
SELECT vec_id, trev, high_fluctuation, stretch_high, stretch_decreasing FROM a JOIN u USING (vec_id) JOIN w USING (vec_id)"""
)
def series_shape(spark, sf_dir):
    """Features of the canonical set that are plain expressions."""
    e = F.col("e")
    return embeddings(spark, sf_dir).select("vec_id", F.round(arrays.trev(e), 5).alias("trev"), r6(arrays.high_fluctuation(e)).alias("high_fluctuation"), arrays.longest_above_mean(e).alias("stretch_high"), arrays.longest_decrease(e).alias("stretch_decreasing"))


@query()
def canonical_features(spark, sf_dir):
    """All 22 canonical features of every vector in one Arrow pass."""
    out = embeddings(spark, sf_dir).select("vec_id", catch22.all_features(F.col("e")).alias("v"))
    return out.select("vec_id", *[(F.round(F.col("v")[i], 4) + F.lit(0.0)).alias(n) for i, n in enumerate(catch22.FEATURES)])


@query(
    "SELECT event_id, user_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS moving_median FROM events"
)
def moving_median(spark, sf_dir):
    out = windows.moving_median_rows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5)
    return out.select("event_id", "user_id", r6(F.col("moving_median")).alias("moving_median"))


@query("SELECT user_id, count(*)::int AS n, round(max(value), 6) AS maximum, round(min(value), 6) AS minimum FROM events GROUP BY 1")
def event_series(spark, sf_dir):
    s = relational.series_by_key(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return s.select("user_id", F.size("series").alias("n"), r6(arrays.maximum(F.col("series"))).alias("maximum"), r6(arrays.minimum(F.col("series"))).alias("minimum"))


@query(
    f"SELECT vec_id, round(list_sum(list_transform(list_zip(e, list_reverse(e)), lambda p: p[1] * p[2])), 6) AS dot, round(list_sum(list_transform(e, lambda x: least(greatest(x, -0.5), 0.5))), 6) AS clipped, "
    f"round(e[64] - e[1], 6) AS difference, round(list_sum(e), 6) AS running FROM ({_E})"
)
def array_algebra(spark, sf_dir):
    e = F.col("e")
    return embeddings(spark, sf_dir).select(
        "vec_id", r6(arrays.dot(e, arrays.reverse(e))).alias("dot"), r6(arrays.total(arrays.clip(e, -0.5, 0.5))).alias("clipped"),
        r6(arrays.total(arrays.differences(e))).alias("difference"), r6(F.element_at(arrays.cumulative(e), -1)).alias("running"),
    )


@query(
    f"SELECT vec_id, count(*)::int AS n, bool_or(mx >= 0.9) AS diamond, bool_and(mx >= 0.0) AS box FROM (SELECT vec_id, list_max(e[x : y - 1]) AS mx FROM ({_E}), (SELECT unnest(range(1, 65)) AS x), (SELECT unnest(range(2, 66)) AS y) "
    "WHERE y > x AND y - x >= 3 AND y - x <= 4) GROUP BY 1"
)
def modal_conditions(spark, sf_dir):
    """Existential and universal conditions over the intervals of length 3 and 4."""
    worlds = windows.filter_intervals(windows.all_intervals(F.size("e"), 4), lambda w: windows.interval_length(w) >= 3)
    df = embeddings(spark, sf_dir).withColumn("worlds", worlds)
    return df.select("vec_id", F.size("worlds").alias("n"), windows.exists_interval(F.col("e"), F.col("worlds"), "maximum", ">=", 0.9).alias("diamond"), windows.all_intervals_hold(F.col("e"), F.col("worlds"), "maximum", ">=", 0.0).alias("box"))


@query(
    f"SELECT vec_id, CASE WHEN bool_or(mean >= 0.4) THEN CASE WHEN bool_and(low >= -1.5) THEN 'high' ELSE 'mixed' END ELSE 'low' END AS prediction FROM (SELECT vec_id, list_sum(e[x : x + 3]) / 4 AS mean, list_min(e[x : x + 3]) AS low FROM ({_E}), (SELECT unnest(range(1, 62)) AS x)) GROUP BY 1"
)
def modal_tree_apply(spark, sf_dir):
    """A tree whose conditions quantify over the intervals of four values."""
    some, every = ModalCondition("e", "mean", ">=", 0.4, 4, 4), ModalCondition("e", "minimum", ">=", -1.5, 4, 4, universal=True)
    tree = Tree(Branch(some, Branch(every, Leaf("high"), Leaf("mixed")), Leaf("low")))
    return models.apply_model(embeddings(spark, sf_dir), tree).select("vec_id", "prediction")


@query(
    f"SELECT vec_id, round(sum(p * k) / sum(p), 6) AS centroid FROM (SELECT vec_id, unnest(e) * unnest(e) AS p, unnest(range(64)) AS k FROM ({_E})) GROUP BY 1"
)
def spectral_centroid(spark, sf_dir):
    """Centroid of each vector whose squares are taken as a spectrum."""
    clips = embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), F.lit(64).alias("sr"), F.col("e").alias("samples"))
    out = signal.per_clip(clips, lambda x, rate: {"centroid": float(signal.centroid_and_spread(x[None] ** 2, np.arange(64.0))[0][0])}, "path string, centroid double")
    return out.select(F.col("path").cast("long").alias("vec_id"), r6(F.col("centroid")).alias("centroid"))


@query()
def spectra(spark, sf_dir):
    """Spectral descriptors of each vector taken as a clip of sound."""
    clips = embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), F.lit(64).alias("sr"), F.col("e").alias("samples"))

    def kernel(x, rate):
        spec, freqs = signal.stft(x, rate, 16)
        return {k: float(v.mean()) for k, v in signal.spectral_shape(spec, freqs).items() if k in ("centroid", "entropy", "flatness")}

    out = signal.per_clip(clips, kernel, "path string, centroid double, entropy double, flatness double")
    return out.select(F.col("path").cast("long").alias("vec_id"), *[r6(F.col(c)).alias(c) for c in ("centroid", "entropy", "flatness")])


# -- scores and selection -----------------------------------------------------------------


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce((l_quantity - lo) / nullif(hi - lo, 0), 0.5), 6) AS scaled FROM (SELECT *, min(l_quantity) OVER (PARTITION BY l_returnflag) AS lo, max(l_quantity) OVER (PARTITION BY l_returnflag) AS hi FROM lineitem)"
)
def minmax_group(spark, sf_dir):
    long = lineitem(spark, sf_dir).select(*KEYS, "l_suppkey", F.col("l_returnflag").alias("fun"), F.col("l_quantity").alias("value"))
    return treatments.normalise_groups(long, by=("fun",)).select(*KEYS, "l_suppkey", r6(F.col("value")).alias("scaled"))


@query("SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) AS z FROM events")
def zscore(spark, sf_dir):
    return treatments.standardise(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("z")), ["z"]).select("event_id", r6(F.col("z")).alias("z"))


_JOINT = """WITH j AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER () AS p FROM j),
q AS (SELECT *, sum(p) OVER (PARTITION BY x) AS px, sum(p) OVER (PARTITION BY y) AS py FROM p)"""


@query(f"{_JOINT} SELECT round(sum(p * ln(p / (px * py))), 8) AS mi, round(-sum(p * ln(px)), 8) AS hx, round(-sum(p * ln(py)), 8) AS hy, round(-sum(p * ln(p)), 8) AS hxy FROM q")
def mi_discrete(spark, sf_dir):
    out = selection.discrete_information(lineitem(spark, sf_dir), "l_returnflag", "l_linestatus")
    return out.select(*[F.round(c, 8).alias(c) for c in ("mi", "hx", "hy", "hxy")])


@query(f"{_JOINT} SELECT round(greatest(sum(p * ln(p / (px * py))), 0), 8) AS mi, round(2 * sum(p * ln(p / (px * py))) / (-sum(p * ln(px)) - sum(p * ln(py))), 8) AS su FROM q")
def symmetric_uncertainty(spark, sf_dir):
    return selection.symmetric_uncertainty(lineitem(spark, sf_dir), "l_returnflag", "l_linestatus").select(F.round("mi", 8).alias("mi"), F.round("su", 8).alias("su"))


@query(
    "SELECT name, round(score, 2) AS score, k <= 2 AS kept FROM (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS k FROM (SELECT 'l_quantity' AS name, var_samp(l_quantity) AS score FROM lineitem UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem "
    "UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', var_samp(l_tax) FROM lineitem))"
)
def variance_topk(spark, sf_dir):
    scores = selection.variance_scores(lineitem(spark, sf_dir), FEATURES)
    return selection.Percentage(0.5)(scores).select("name", F.round("score", 2).alias("score"), "kept")


@query()
def information_scores(spark, sf_dir):
    """Nearest-neighbour information of each vector element with the label; a part of the id spreads values, so that no distances tie."""
    spread = (F.col("vec_id") * 7919 % 1009) * F.lit(1e-6)
    wide = embeddings(spark, sf_dir).select("vec_id", "label", *[(F.col("e")[i] + spread * (i + 1)).alias(f"e{i}") for i in range(64)])
    found = selection.information_scores(wide, [f"e{i}" for i in range(64)], "label", "vec_id", noise=0.0)
    return found.select("name", r6(F.col("score")).alias("score"))


@query()
def mann_whitney(spark, sf_dir):
    """The least p-value of one class against the others, of every vector element."""
    wide = embeddings(spark, sf_dir).select("label", *[F.col("e")[i].alias(f"e{i}") for i in range(64)])
    return selection.mann_whitney(wide, [f"e{i}" for i in range(64)], "label").select("name", r6(F.col("score")).alias("score"))


@query()
def selection_pipeline(spark, sf_dir):
    """Variance, then identity over groups of name parts: the mid results of both steps."""
    df = embeddings(spark, sf_dir)
    cells = treatments.product_of(["e"], 4, ["minimum", "maximum", "mean"])
    wide = treatments.extract(df, cells, Windowing("segments", 4), 64)
    steps = [selection.Step(selection.variance_scores, selection.Percentage(0.5)), selection.Step(selection.identity_scores, selection.Everything(), group_parts=(2,))]
    mid = selection.run_selection(wide, wide.columns, steps)[1]
    return mid.select(F.col("step").cast("long").alias("step"), "name", r6(F.col("score")).alias("score"), "kept")


@query("SELECT n.name, coalesce(c.n, 0)::bigint AS n FROM (VALUES ('Brand#11'), ('Brand#13'), ('none'), ('Brand#55')) n(name) LEFT JOIN (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1) c USING (name)")
def count_study(spark, sf_dir):
    return selection.count_map(table(spark, sf_dir, "part"), "p_brand", ["Brand#11", "Brand#13", "none", "Brand#55"])


@query("SELECT split_part(p_type, ' ', 1) AS grp, count(*)::bigint AS n, round(avg(p_retailprice), 4) AS mean, round(min(p_retailprice), 4) AS low, round(max(p_retailprice), 4) AS high FROM part GROUP BY 1")
def name_part_groups(spark, sf_dir):
    """Scores aggregated by one part of the names."""
    df = table(spark, sf_dir, "part")
    names = [r[0] for r in df.select("p_type").distinct().collect()]  # a row for each type
    groups = selection.name_groups(spark, names, (0,), " ")
    df = df.join(F.broadcast(groups), F.col("p_type") == F.col("name")).groupBy("grp")
    return df.agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.round(F.min("p_retailprice"), 4).alias("low"), F.round(F.max("p_retailprice"), 4).alias("high"))


# -- folds and measures -------------------------------------------------------------------

_ORDER = "(o_orderkey * 7919) % 100003"


def orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _spread(column: str) -> F.Column:
    """A key for ordering that both engines can compute, spread over 64 bits."""
    return (F.col(column) * 7919 % 100003) * F.lit(1 << 45) - F.lit(1 << 61)


@query(f"SELECT o_orderkey, 0 AS fold, CASE WHEN k < floor(n * 0.7) THEN 'train' WHEN k < floor(n * 0.7) + floor((n - floor(n * 0.7)) * 0.5) THEN 'valid' ELSE 'test' END AS role FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_ORDER}, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)")
def holdout_assign(spark, sf_dir):
    return evaluation.holdout(orders(spark, sf_dir), "o_orderkey", 0.7, 0.5, order=_spread("o_orderkey"))


@query(f"SELECT o_orderkey, floor(k * 5 / n)::int AS own FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_ORDER}, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)")
def kfold_assign(spark, sf_dir):
    return evaluation.k_fold(orders(spark, sf_dir), "o_orderkey", 5, order=_spread("o_orderkey"))


@query(f"SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_ORDER}, o_orderkey) - 1) % 4)::int AS own FROM orders")
def stratified_fold(spark, sf_dir):
    return evaluation.stratified_fold(orders(spark, sf_dir), "o_orderkey", "o_orderpriority", 4, order=_spread("o_orderkey"))


@query(
    "WITH b AS (SELECT o_orderkey, least(floor((row_number() OVER (ORDER BY o_orderkey) - 1) * 4 / count(*) OVER ()), 3)::int AS block FROM orders) "
    "SELECT o_orderkey, fold::int AS fold, CASE WHEN block = fold + 1 THEN 'test' ELSE 'train' END AS role FROM b, (SELECT unnest(range(3)) AS fold) WHERE block <= fold + 1"
)
def ts_fold(spark, sf_dir):
    return evaluation.time_folds(orders(spark, sf_dir), "o_orderkey", "o_orderkey", 3)


@query(
    "WITH i AS (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY (o_custkey * 7919) % 100003, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, "
    "sum(n) OVER (PARTITION BY o_orderpriority) AS total FROM i) SELECT o_orderkey, CASE WHEN before < floor(total * 0.7) THEN 'train' ELSE 'test' END AS role FROM orders JOIN b USING (o_orderpriority, o_custkey)"
)
def group_split(spark, sf_dir):
    return evaluation.group_split(orders(spark, sf_dir), "o_orderpriority", "o_custkey", 0.7, _spread("o_custkey"), balance=False).select("o_orderkey", "role")


@query(f"SELECT l_returnflag AS label, {TREE_SQL} AS prediction, count(*) AS n FROM lineitem GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return evaluation.confusion(models.apply_model(lineitem(spark, sf_dir), TREE), "l_returnflag", "prediction")


@query(
    f"WITH c AS (SELECT l_returnflag AS y, {TREE_SQL} AS p, count(*)::double AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT sum(n) AS t, sum(n) FILTER (WHERE y = p) AS hit FROM c), "
    "a AS (SELECT sum(r.n * s.n) AS ab FROM (SELECT y AS c, sum(n) AS n FROM c GROUP BY 1) r JOIN (SELECT p AS c, sum(n) AS n FROM c GROUP BY 1) s USING (c)) SELECT round((hit / t - ab / (t * t)) / (1 - ab / (t * t)), 6) AS kappa FROM t, a"
)
def kappa(spark, sf_dir):
    counts = evaluation.confusion(models.apply_model(lineitem(spark, sf_dir), TREE), "l_returnflag", "prediction")
    return evaluation.kappa(counts).select(r6(F.col("kappa")).alias("kappa"))


@query(
    f"WITH p AS (SELECT (l_orderkey % 3)::int AS fold, l_returnflag AS y, {TREE_SQL} AS p FROM lineitem), f AS (SELECT fold, count(*) AS n, avg((y = p)::int::double) AS accuracy, sum((y <> p)::int)::double AS misses FROM p GROUP BY 1), "
    "l AS (SELECT 'accuracy' AS measure, fold, n, accuracy AS v FROM f UNION ALL SELECT 'misses', fold, n, misses FROM f) SELECT measure, fold, round(v, 6) AS value FROM l UNION ALL "
    "SELECT measure, -1, round(CASE measure WHEN 'misses' THEN sum(v) ELSE sum(v * n) / sum(n) END, 6) FROM l GROUP BY measure"
)
def fold_measures(spark, sf_dir):
    p = models.apply_model(lineitem(spark, sf_dir), TREE).select((F.col("l_orderkey") % 3).cast("int").alias("fold"), F.col("l_returnflag").alias("label"), "prediction")
    return evaluation.evaluate(p, ["accuracy", "misses"]).select("measure", "fold", r6(F.col("value")).alias("value"))


@query("SELECT round(avg(-ln(least(greatest(p, 2.22e-16), 1 - 2.22e-16))), 6) AS log_loss, round(avg((p - 1) * (p - 1) + (1 - p) * (1 - p)), 6) AS brier FROM (SELECT CASE WHEN l_linestatus = 'O' THEN l_quantity / 51 ELSE 1 - l_quantity / 51 END AS p FROM lineitem)")
def probability_measures(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("po", F.col("l_quantity") / 51)
    own = F.when(F.col("l_linestatus") == "O", F.col("po")).otherwise(1 - F.col("po"))
    return df.agg(r6(evaluation.log_loss(own)).alias("log_loss"), r6(evaluation.brier(F.array(F.col("po"), 1 - F.col("po")), ["O", "F"], "l_linestatus")).alias("brier"))


@query()
def analysis(spark, sf_dir):
    """Holdout analysis of the vectors with a decision tree: accuracy and kappa."""
    wide = embeddings(spark, sf_dir).select("vec_id", F.col("label").cast("string").alias("label"), *[F.col("e")[i].alias(f"e{i}") for i in range(64)])
    return evaluation.symbolic_analysis(wide, [f"e{i}" for i in range(64)], "label", "vec_id", params={"max_depth": 4, "seed": 1}).measures


# -- relational -----------------------------------------------------------------------------


@query("SELECT l_returnflag AS label, dense_rank() OVER (ORDER BY l_returnflag)::int AS code, n FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)")
def label_encode(spark, sf_dir):
    coded = relational.encode_labels(lineitem(spark, sf_dir), "l_returnflag")
    back = relational.decode_labels(coded.groupBy("code").agg(F.count("*").alias("n")), "code", relational.class_dictionary(lineitem(spark, sf_dir), "l_returnflag"))
    return back.select("label", "code", "n")


@query("SELECT o_custkey FROM orders WHERE o_orderkey % 10 < 7 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 10 >= 7")
def leak_check(spark, sf_dir):
    train, test = (orders(spark, sf_dir).where(c).select("o_custkey") for c in ("o_orderkey % 10 < 7", "o_orderkey % 10 >= 7"))
    return relational.leaked(train, test)


@query("SELECT o_custkey FROM orders WHERE o_orderkey % 10 < 7 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 10 >= 7")
def set_difference(spark, sf_dir):
    train, test = (orders(spark, sf_dir).where(c).select("o_custkey") for c in ("o_orderkey % 10 < 7", "o_orderkey % 10 >= 7"))
    return relational.difference(train, test)


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set_union(spark, sf_dir):
    return relational.union_distinct(orders(spark, sf_dir).select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def row_anti(spark, sf_dir):
    ids = orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"))
    return relational.rows_not_in(table(spark, sf_dir, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def row_semi(spark, sf_dir):
    ids = orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"))
    return relational.rows_in(table(spark, sf_dir, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


@query("SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def label_merge(spark, sf_dir):
    return tables.merge_labels(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id", "doc_id", "quality")


@query("WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(floor((value - lo) / ((hi - lo) / 12)), 11)::int AS bin, count(*) AS n FROM events, b GROUP BY 1) SELECT k::int AS bin, round(lo + k * (hi - lo) / 12, 6) AS low, round(lo + (k + 1) * (hi - lo) / 12, 6) AS high, coalesce(n, 0)::bigint AS n FROM b, (SELECT unnest(range(12)) AS k) LEFT JOIN c ON c.bin = k")
def histogram(spark, sf_dir):
    return relational.histogram(table(spark, sf_dir, "events"), "value", 12).select("bin", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "n")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount >= l_tax THEN 'l_discount' ELSE 'l_tax' END AS best FROM lineitem")
def argmax_columns(spark, sf_dir):
    return lineitem(spark, sf_dir).select(*KEYS, relational.argmax_name(["l_discount", "l_tax"]).alias("best"))


@query("SELECT p_partkey, p_size::float AS size, 'x_' || p_brand AS brand, len(p_name) AS length FROM part WHERE p_brand IN ('Brand#11', 'Brand#22')")
def projections(spark, sf_dir):
    df = table(spark, sf_dir, "part").where(conditions.equals_any("p_brand", ["Brand#11", "Brand#22"]))
    df = relational.cast_all(df, ["p_size"], "float").withColumnRenamed("p_size", "size")
    return df.select("p_partkey", "size", F.concat(F.lit("x_"), "p_brand").alias("brand"), F.length("p_name").cast("long").alias("length"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events")
def ordered_row_id(spark, sf_dir):
    return tables.with_row_id(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", F.col("row_id").cast("long").alias("row_id"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS minimum, round(max(value), 6) AS maximum FROM events GROUP BY 1, 2")
def time_windows(spark, sf_dir):
    """The streaming extension on a batch table."""
    out = series.windowed_features(table(spark, sf_dir, "events"), keys=("event_type",), length="1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "minimum", "maximum")])


@query(
    "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL '12 hours')::int, 1) AS new FROM events)) GROUP BY user_id, s"
)
def event_sessions(spark, sf_dir):
    out = series.sessions(table(spark, sf_dir, "events"), gap="12 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return lineitem(spark, sf_dir).cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r6(F.avg("l_quantity")).alias("quantity"))


from . import coverage, derived, learning  # noqa: E402, F401  register their queries
