"""Queries of neighbour information, conditions over all intervals, modal learners, rule tables, exact quantiles and long signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantiles, signal
from ..operators import modal_learning, neighbours, relational, rule_table, selection, tuning
from ..operators.conditions import ScalarCondition
from ..operators.modal import ModalCondition
from ..operators.modal_learning import ModalTest
from ..operators.models import Branch, Ensemble, Leaf, Tree
from .catalogue import _E, embeddings, lineitem, query, r6, table

# -- information of two numbers ------------------------------------------------------------------

_POINTS = (
    f"SELECT vec_id, i, a / stddev_samp(a) OVER (PARTITION BY i) AS x, b / stddev_samp(b) OVER (PARTITION BY i) AS y FROM (SELECT vec_id, unnest(range(1, 7)) AS i, unnest([e[k + 1] + (vec_id * 7919 % 1009) * 1e-6::double * (k + 1) FOR k IN range(1, 7)]) AS a, "
    f"e[1] + (vec_id * 7919 % 1009) * 1e-6::double AS b FROM ({_E}))"
)


@query(
    f"""WITH p AS ({_POINTS}), d AS (SELECT a.i, a.vec_id, a.x, a.y, list_sort(list(greatest(abs(a.x - b.x), abs(a.y - b.y))))[3] AS d FROM p a JOIN p b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4),
m AS (SELECT d.i, d.vec_id, count(*) FILTER (WHERE abs(d.x - b.x) < d.d) AS mx, count(*) FILTER (WHERE abs(d.y - b.y) < d.d) AS my FROM d JOIN p b ON d.i = b.i GROUP BY 1, 2),
psi AS (SELECT j + 1 AS j, -0.5772156649015329 + coalesce(sum(1.0::double / nullif(j, 0)) OVER (ORDER BY j), 0) AS psi FROM (SELECT unnest(range(20000)) AS j))
SELECT 'e' || i AS name, round(greatest(any_value(pn.psi) + any_value(pk.psi) - avg(px.psi) - avg(py.psi), 0), 6) + 0.0 AS score
FROM m JOIN (SELECT i, count(*) AS n FROM p GROUP BY 1) USING (i) JOIN psi pn ON pn.j = n JOIN psi pk ON pk.j = 3 JOIN psi px ON px.j = mx JOIN psi py ON py.j = my GROUP BY i"""
)
def continuous_information(spark, sf_dir):
    """Nearest-neighbour information of six vector elements with the first one, over all rows; a part of the id spreads values, so that no distances tie."""
    spread = (F.col("vec_id") * 7919 % 1009) * F.lit(1e-6)
    wide = embeddings(spark, sf_dir).select("vec_id", *[(F.col("e")[i] + spread * (i + 1 if i else 1)).alias(f"e{i}") for i in range(7)])
    found = selection.information_scores(wide, [f"e{i}" for i in range(1, 7)], "e0", "vec_id", numeric_label=True, noise=0.0)
    return found.select("name", r6(F.col("score")).alias("score"))


@query(
    """WITH p AS (SELECT orders.o_orderkey, o_totalprice AS x, l.q AS y FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) + l_orderkey * 1e-7::double AS q FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey),
r AS (SELECT o_orderkey, 1000.0::double AS rx, 2.5::double AS ry FROM p)
SELECT o_orderkey, count(*) OVER (ORDER BY x RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS mx, count(*) OVER (ORDER BY y RANGE BETWEEN 2.5 PRECEDING AND 2.5 FOLLOWING) AS my FROM p"""
)
def counts_in_radius(spark, sf_dir):
    """How many orders have a price, and how many a quantity, within a radius of each order's own."""
    quantity = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity") + F.col("l_orderkey") * F.lit(1e-7)).alias("y"))
    p = table(spark, sf_dir, "orders").join(quantity, F.col("o_orderkey") == F.col("l_orderkey")).select(F.lit("all").alias("name"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("x"), "y")
    mx = neighbours.counts_within(p.withColumn("r", F.lit(1000.0)), "x", rounded=True).select(F.col("id").alias("o_orderkey"), F.col("m").alias("mx"))
    my = neighbours.counts_within(p.withColumn("r", F.lit(2.5)), "y", rounded=True).select(F.col("id").alias("of"), F.col("m").alias("my"))
    return mx.join(my, F.col("o_orderkey") == F.col("of")).select("o_orderkey", "mx", "my")


# -- all intervals of long series -------------------------------------------------------------------

_FRAME = "OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query(
    f"""WITH w AS (SELECT event_type, value, min(value) {_FRAME} AS low, max(value) {_FRAME} AS high, avg(value) {_FRAME} AS mean3, count(*) {_FRAME} AS n,
  avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS mean4, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n4,
  avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean5, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n5 FROM events)
SELECT event_type, count(*) AS n, bool_or(low >= 80 AND n = 3) AS stays_high, bool_or(high <= 20 AND n = 3) AS stays_low, bool_or(value <= 0.05) AS touches, bool_and(high >= 15 OR n < 3) AS always, bool_and(value <= 99.99) AS capped,
  round(max(greatest(CASE WHEN n = 3 THEN mean3 END, CASE WHEN n4 = 4 THEN mean4 END, CASE WHEN n5 = 5 THEN mean5 END)), 6) AS best_mean FROM w GROUP BY 1"""
)
def interval_conditions(spark, sf_dir):
    """Conditions over all intervals of three values or more, in series of thousands of events; no interval is listed."""
    s = relational.series_by_key(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    asked = {
        "stays_high": ModalCondition("series", "minimum", ">=", 80.0, 3), "stays_low": ModalCondition("series", "maximum", "<=", 20.0, 3), "touches": ModalCondition("series", "minimum", "<=", 0.05, 3),
        "always": ModalCondition("series", "maximum", ">=", 15.0, 3, universal=True), "capped": ModalCondition("series", "maximum", "<=", 99.99, 3, universal=True),
    }
    mean = ModalTest("series", "mean", ">=", 3)
    best = modal_learning.attained(s, [mean], "event_type", "event_type").select(F.col("y").alias("of"), r6(F.get("u", F.lit(0))).alias("best_mean"))
    out = s.select("event_type", F.size("series").cast("long").alias("n"), *[c.column().alias(k) for k, c in asked.items()])
    return out.join(best, F.col("event_type") == F.col("of")).drop("of")


# -- learners of modal models ---------------------------------------------------------------------

_TESTS = [ModalTest("e", "maximum"), ModalTest("e", "minimum", shortest=4), ModalTest("e", "mean", shortest=2), ModalTest("e", "minimum", "<=", relation="B"), ModalTest("e", "mean", shortest=8, relation="E")]
_BINS = 8
_ATTAINED = f"""x AS (SELECT vec_id, label::varchar AS y, unnest(range(5)) AS test, unnest([list_max(e), list_max([list_min(e[k : k + 3]) FOR k IN range(1, 62)]),
  greatest(list_max([(e[k] + e[k + 1]) / 2 FOR k IN range(1, 64)]), list_max([(e[k] + e[k + 1] + e[k + 2]) / 3 FOR k IN range(1, 63)])), -list_min(e[1:63]), list_max([list_sum(e[k:64]) / (65 - k) FOR k IN range(2, 58)])]) AS u FROM ({_E})),
c AS (SELECT test, unnest(list_distinct(quantile_disc(u, [{", ".join(f"{i / _BINS}" for i in range(1, _BINS))}]))) AS cut FROM x GROUP BY test)"""


def _best(name: str, rows: str, least: float = 1.0) -> str:
    """The best split of each (tree, node) of ``rows`` (tree, node, vec_id, y, test, u, w)."""
    gini = lambda v, n: f"(1 - {v} / nullif({n} * {n}, 0))"
    return f"""{name}_c AS (SELECT tree, node, r.test, cut, y, coalesce(sum(w) FILTER (WHERE u >= cut), 0) AS p, sum(w) AS t FROM {rows} r JOIN c ON r.test = c.test GROUP BY ALL),
{name}_g AS (SELECT tree, node, test, cut, sum(p) AS m, sum(t) AS n, sum(p * p) AS pp, sum(t * t) AS tt, sum((t - p) * (t - p)) AS rr, max(p) AS yes, max(t - p) AS no,
  arg_max(y, (p, -ascii(y))) AS yes_y, arg_max(y, (t - p, -ascii(y))) AS no_y, list(p ORDER BY y) AS ps FROM {name}_c GROUP BY ALL),
{name} AS (SELECT *, {gini("tt", "n")} - coalesce(m / n * {gini("pp", "m")}, 0) - coalesce((n - m) / n * {gini("rr", "(n - m)")}, 0) AS gain FROM {name}_g WHERE m >= {least} AND n - m >= {least}
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY round(gain, 12) DESC, test, cut) = 1)"""


_FIRST = f"r1 AS (SELECT 0 AS tree, 1 AS node, *, 1.0::double AS w FROM x), {_best('b1', 'r1')}"
_SECOND = f"r2 AS (SELECT r.tree, CASE WHEN a.u >= b1.cut THEN 2 ELSE 3 END AS node, r.vec_id, r.y, r.test, r.u, r.w FROM r1 r JOIN b1 ON r.tree = b1.tree JOIN x a ON a.vec_id = r.vec_id AND a.test = b1.test), {_best('b2', 'r2')}"
_SPLIT = "node::bigint AS node, test::bigint AS test, round(cut, 6) AS cut, round(gain, 9) AS gain, m AS passed, n AS whole"


def _splits(spark, splits: dict, data) -> object:
    rows = [(t, n, s[0], float(data.cuts[s[0]][s[1] - 1]), float(s[2]), float(sum(s[3])), float(sum(s[4]))) for (t, n), s in splits.items() if s[1] is not None]
    out = spark.createDataFrame(rows, "tree long, node long, test long, cut double, gain double, passed double, whole double")
    return out.select("tree", "node", "test", r6(F.col("cut")).alias("cut"), F.round("gain", 9).alias("gain"), "passed", "whole")


@query(f"WITH {_ATTAINED}, {_FIRST}, {_SECOND} SELECT {_SPLIT} FROM b1 UNION ALL SELECT {_SPLIT} FROM b2 WHERE round(gain, 12) > 0")
def modal_tree_learned(spark, sf_dir):
    """The first two levels of a tree over vectors as series: tests over intervals of several lengths and relations."""
    data = modal_learning.coded(embeddings(spark, sf_dir), _TESTS, "label", "vec_id", _BINS)
    _, splits = modal_learning.grow(data, 1, 2)
    data.rows.unpersist()
    return _splits(spark, splits, data).drop("tree")


_TREES = 3
_DRAWN = " + ".join(f"(h >= {p!r})::int" for p in modal_learning._POISSON)


@query(
    f"""WITH {_ATTAINED}, h AS (SELECT vec_id, tree, ({_DRAWN})::double AS w FROM (SELECT vec_id, tree, ('0x' || md5(vec_id || '|1|' || tree)[1:12])::bigint / power(2, 48) AS h FROM embeddings, (SELECT unnest(range({_TREES})) AS tree))),
r1 AS (SELECT tree, 1 AS node, x.*, w FROM x JOIN h USING (vec_id) WHERE w > 0), {_best('b1', 'r1')}, {_SECOND} SELECT tree::bigint AS tree, {_SPLIT} FROM b1 UNION ALL SELECT tree, {_SPLIT} FROM b2 WHERE round(gain, 12) > 0"""
)
def modal_forest_learned(spark, sf_dir):
    """The first two levels of three trees, grown together on rows drawn by their ids."""
    data = modal_learning.coded(embeddings(spark, sf_dir), _TESTS, "label", "vec_id", _BINS)
    weight = modal_learning.drawn_weights(_TREES, 1)
    _, splits = modal_learning.grow(data, _TREES, 2, weight)
    data.rows.unpersist()
    return _splits(spark, splits, data)


_ROUND = "test::bigint AS test, round(cut, 6) AS cut, round(ln((1 - e) / e) + ln((SELECT count(DISTINCT y) FROM x) - 1), 6) AS coefficient"


@query(
    f"""WITH {_ATTAINED}, r1 AS (SELECT 0 AS tree, 1 AS node, *, 1.0::double AS w FROM x), {_best('b1', 'r1', 0)}, e1 AS (SELECT *, 1 - (yes + no) / n AS e FROM b1),
r2 AS (SELECT r.tree, r.node, r.vec_id, r.y, r.test, r.u, CASE WHEN r.y = CASE WHEN a.u >= e1.cut THEN e1.yes_y ELSE e1.no_y END THEN 1 ELSE (1 - e) / e * ((SELECT count(DISTINCT y) FROM x) - 1) END AS w FROM r1 r, e1 JOIN x a ON a.test = e1.test WHERE a.vec_id = r.vec_id), {_best('b2', 'r2', 0)},
e2 AS (SELECT *, 1 - (yes + no) / n AS e FROM b2) SELECT 1::bigint AS round, {_ROUND} FROM e1 UNION ALL SELECT 2, {_ROUND} FROM e2"""
)
def modal_stagewise_learned(spark, sf_dir):
    """The first two rounds of stage-wise boosting of modal stumps, with their coefficients."""
    found = modal_learning.learn_stagewise(embeddings(spark, sf_dir), _TESTS, "label", "vec_id", 2, _BINS)
    rows = []
    for k, (t, c) in enumerate(zip(found.trees, found.coefficients, strict=True), 1):
        q = t.root.condition
        test = next(i for i, x in enumerate(_TESTS) if (x.fun, x.op, x.shortest, x.relation) == (q.fun, q.op, q.shortest, q.relation))
        rows.append((k, test, q.threshold if q.op == ">=" else -q.threshold, c))
    return spark.createDataFrame(rows, "round long, test long, cut double, coefficient double").select("round", "test", r6(F.col("cut")).alias("cut"), r6(F.col("coefficient")).alias("coefficient"))


# -- rules as a table ----------------------------------------------------------------------------------

_RULES = 5_000
_SPLITS = (("l_quantity", 50.0), ("l_discount", 0.1), ("l_tax", 0.08), ("l_extendedprice", 90_000.0))


def _grown(t: int, node: int = 1):
    """Tree number t of depth 3, with thresholds by a rule."""
    if node >= 8:
        return Leaf("ANR"[(t + node) % 3])
    feature, top = _SPLITS[(t + node) % 4]
    return Branch(ScalarCondition(feature, "<", round(top * ((t * 7 + node * 5) % 11 + 1) / 12, 4)), _grown(t, 2 * node), _grown(t, 2 * node + 1))


def _leaf_sql(m, numbers, shown) -> str:
    if isinstance(m, Branch):
        yes = _leaf_sql(m.positive, numbers, shown)
        return f"CASE WHEN {m.condition.feature} < {m.condition.threshold!r} THEN {yes} ELSE {_leaf_sql(m.negative, numbers, shown)} END"
    return shown(next(numbers), m)


_TEN = [_grown(t) for t in range(10)]
_LEAVES = ", ".join(_leaf_sql(m, iter(range(8)), lambda k, m: str(k)) for m in _TEN)
_VOTES = ", ".join(_leaf_sql(m, iter(range(8)), lambda k, m: f"'{m.outcome}'") for m in _TEN)


@query(
    f"""WITH r AS (SELECT k AS rule_id, k % 40 AS lo, k % 40 + 5 + k % 7 AS hi, (k % 9) / 100.0::double AS d, 30000.0 + k * 11 AS p, ['A', 'N', 'R'][k % 3 + 1] AS consequent FROM (SELECT unnest(range({_RULES})) AS k)),
c AS (SELECT rule_id, consequent, count(l.l_quantity) AS ncovered, count(*) FILTER (WHERE l_returnflag = consequent) AS hits FROM r LEFT JOIN lineitem l ON l_quantity >= lo AND l_quantity < hi AND (rule_id % 2 = 0 OR l_discount > d) AND (rule_id % 3 > 0 OR l_extendedprice <= p) GROUP BY 1, 2)
SELECT rule_id::bigint AS rule_id, consequent, ncovered, round(hits / nullif(ncovered, 0)::double, 6) AS confidence FROM c"""
)
def measured_rule_table(spark, sf_dir):
    """Five thousand rules of up to three intervals, held in a table, over all rows."""
    k = F.col("id")
    inf = F.lit(float("inf"))
    low, closed = k % 40, F.lit(True)
    quantity = F.struct(F.lit("l_quantity").alias("feature"), low.cast("double").alias("low"), (low + 5 + k % 7).cast("double").alias("high"), closed.alias("low_closed"), ~closed)
    discount = F.when(k % 2 == 1, F.struct(F.lit("l_discount"), (k % 9).cast("double") / 100, inf, ~closed, closed))
    price = F.when(k % 3 == 0, F.struct(F.lit("l_extendedprice"), -inf, (30000.0 + k * 11).cast("double"), closed, closed))
    kind = "struct<feature:string,low:double,high:double,low_closed:boolean,high_closed:boolean>"
    atoms = F.array(*[x.cast(kind) for x in (quantity, discount, price)])
    consequent = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (k % 3 + 1).cast("int"))
    table_of_rules = spark.range(_RULES).select(k.alias("rule_id"), consequent.alias("consequent"), F.explode(atoms).alias("a")).where("a is not null").select("rule_id", "a.*", "consequent")
    out = rule_table.rule_table_metrics(lineitem(spark, sf_dir), table_of_rules, "l_returnflag")
    return out.select("rule_id", "consequent", "ncovered", r6(F.col("confidence")).alias("confidence"))


@query(
    f"""WITH r AS (SELECT [{_LEAVES}] AS leaves, [{_VOTES}] AS votes FROM lineitem), n AS (SELECT leaves, count(*) AS ncovered, any_value(votes) AS votes FROM r GROUP BY leaves),
v AS (SELECT leaves, ncovered, unnest(['A', 'N', 'R']) AS y, unnest([len(list_filter(votes, lambda x: x = 'A')), len(list_filter(votes, lambda x: x = 'N')), len(list_filter(votes, lambda x: x = 'R'))]) AS k FROM n)
SELECT array_to_string(leaves, ',') AS leaves, any_value(ncovered) AS ncovered, any_value(ncovered) AS measured, arg_max(y, (k, -ascii(y))) AS consequent FROM v GROUP BY 1"""
)
def rules_of_ten_trees(spark, sf_dir):
    """The rules of ten trees of depth 3 that hold for some row, with their votes, and what they cover when measured as a table of intervals."""
    df = lineitem(spark, sf_dir)
    found, intervals = rule_table.rules_of_rows(df, Ensemble(tuple(Tree(m) for m in _TEN)))
    counts = rule_table.covered_counts(df, intervals, "l_returnflag").groupBy("rule_id").agg(F.sum("n").alias("measured"))
    return found.join(counts, "rule_id").select(F.array_join("leaves", ",").alias("leaves"), "ncovered", "measured", "consequent")


# -- exact quantiles ------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, unnest([1, 2, 3])::bigint AS i, unnest(quantile_disc(l_extendedprice, [0.125, 0.5, 0.9375]))::double AS price FROM lineitem GROUP BY 1, 2")
def exact_quantiles(spark, sf_dir):
    """Quantiles of the prices in each group, exact, by ranges that get narrower."""
    found = quantiles.exact_quantiles(lineitem(spark, sf_dir), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.125, 0.5, 0.9375], between=False)
    out = found.select("l_returnflag", "l_linestatus", F.posexplode("q").alias("i", "price"))
    return out.withColumn("i", (F.col("i") + 1).cast("long"))


# -- signals longer than a row --------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
f AS (SELECT s.event_type, i // 8 - k AS frame, i - (i // 8 - k) * 8 AS t, v, n FROM s, (SELECT unnest([0, 1]) AS k) WHERE i // 8 >= k AND i - (i // 8 - k) * 8 < 16 AND (i // 8 - k) * 8 + 16 <= n),
p AS (SELECT event_type, frame, k, power(sum(w * cos(2 * pi() * k * t / 16)), 2) + power(sum(w * sin(2 * pi() * k * t / 16)), 2) AS p FROM (SELECT *, v * (0.5 - 0.5 * cos(2 * pi() * t / 16)) AS w FROM f), (SELECT unnest([0, 3, 8]) AS k) GROUP BY 1, 2, 3)
SELECT event_type, frame, """
    + ", ".join(f"round(sum(p) FILTER (WHERE k = {k}), 4) + 0.0 AS b{k}" for k in (0, 3, 8))
    + " FROM p GROUP BY 1, 2"
)
def long_signal_spectra(spark, sf_dir):
    """Spectra of the events of each type as one signal, which comes in chunks of 333 and is cut into tiles: frames are whole across both."""
    s = relational.series_by_key(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    starts = F.sequence(F.lit(0), F.size("series") - 1, F.lit(333))
    chunks = s.select(F.col("event_type").alias("path"), F.lit(8).alias("sr"), "series", F.explode(starts).alias("start")).select("path", "sr", "start", F.slice("series", F.col("start") + 1, F.lit(333)).alias("samples"))

    def kernel(x, rate):
        power = signal.stft(x, rate, 16)[0]
        return {f"b{k}": power[:, k] for k in (0, 3, 8)}

    out = signal.per_frame(chunks, kernel, ["b0", "b3", "b8"], 16, 8, 1_000)
    return out.select(F.col("path").alias("event_type"), "frame", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("b0", "b3", "b8")])


# -- tuning in shared passes ------------------------------------------------------------------------------

_FOLDED = f"""x AS (SELECT o_orderkey AS vec_id, o_orderstatus AS y, unnest([0, 1]) AS test, unnest([(o_custkey % 10)::double, (o_orderkey % 8)::double]) AS u FROM orders),
c AS (SELECT test, unnest(list_distinct(quantile_disc(u, [{", ".join(f"{i / 32}" for i in range(1, 32))}]))) AS cut FROM x GROUP BY test),
h AS (SELECT o_orderkey AS vec_id, o_orderstatus AS y, ('0x' || md5(o_orderkey::varchar)[1:12])::bigint % 3 AS fold FROM orders),
r1 AS (SELECT t AS tree, 1 AS node, x.*, 1.0::double AS w FROM x JOIN h USING (vec_id), (SELECT unnest(range(3)) AS t) WHERE fold <> t),
{_best("b1", "r1")}, m AS (SELECT t AS tree, arg_max(y, (n, -ascii(y))) AS y FROM (SELECT t, y, count(*) AS n FROM h, (SELECT unnest(range(3)) AS t) WHERE fold <> t GROUP BY 1, 2) GROUP BY 1)"""


@query(
    f"WITH {_FOLDED} SELECT 0::bigint AS depth, round(avg((h.y = m.y)::int::double), 6) AS score FROM h JOIN m ON fold = tree UNION ALL "
    "SELECT 1, round(avg((h.y = CASE WHEN x.u >= cut THEN yes_y ELSE no_y END)::int::double), 6) FROM h JOIN b1 ON fold = tree JOIN x ON x.vec_id = h.vec_id AND x.test = b1.test"
)
def tuned_in_shared_passes(spark, sf_dir):
    """Held-out accuracies of two depths of tree, of all folds grown together."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 10).cast("double").alias("a"), (F.col("o_orderkey") % 8).cast("double").alias("b"))
    found = tuning.tune_trees(df, ["a", "b"], "o_orderstatus", "o_orderkey", [{"depth": 0}, {"depth": 1}])
    return spark.createDataFrame(list(enumerate(found.scores)), "depth long, score double").select("depth", r6(F.col("score")).alias("score"))
