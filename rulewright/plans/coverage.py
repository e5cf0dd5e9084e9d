"""Further queries, grouped by the operators that they apply, each with its oracle.

Kernels of signals are held against the same sums written as SQL over long tables, or, for tones
and other made-up signals, against what the tone is. Learners are held against their first steps
written as SQL, or run on labels that a threshold decides, which they have to find.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, catch22, signal, treatments, windows
from ..functions.windows import Windowing
from ..operators import boosting, conditions, evaluation, models, relational, rules, selection
from ..operators.conditions import MetaCondition, Not, Or, ScalarCondition, conjunction, parse_condition
from ..operators.models import Branch, DecisionList, Ensemble, Leaf, MixedModel, RawNode, Rule, Tree
from ..sources import arff, audio, tables
from .catalogue import _E, FEATURES, ORACLES, KEYS, STUMPS, STUMPS_SQL, TREE, TREE_SQL, embeddings, lineitem, orders, query, r6, table


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one in local mode where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="rulewright-")
    return f"{found.rstrip('/')}/{uuid.uuid4().hex}"


def raises(f, *kinds: type) -> bool:
    try:
        f()
    except kinds:
        return True
    return False


def literals(rows: list[tuple], names: str) -> str:
    """SELECT over rows of numbers, texts and booleans."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else f"{v}::bigint"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


# -- sources ------------------------------------------------------------------------------


@query("SELECT n_nationkey::bigint AS n_nationkey, n_name, n_regionkey::bigint AS n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    return tables.read_csv(spark, path, "n_nationkey long, n_name string, n_regionkey long")


@query("SELECT p_partkey, p_brand, p_size::bigint AS p_size FROM part WHERE p_brand IN ('Brand#11', 'Brand#22')")
def store_by_values(spark, sf_dir):
    """Written partitioned by a column, read back by values of it; kept under a digest of parameters."""
    folder = scratch(spark)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("p_size"))
    tables.write_store(parts, f"{folder}/whole", partition_by=["p_brand"])
    kept = lambda: tables.read_store(spark, f"{folder}/whole", {"p_brand": ["Brand#11", "Brand#22"]})
    tables.cached(spark, folder, "parts", {"brands": 2}, kept)
    return tables.cached(spark, folder, "parts", {"brands": 2}, lambda: parts.limit(0)).select("p_partkey", "p_brand", "p_size")


_ARFF = f"SELECT vec_id::varchar AS class, k, round(e[k], 6) AS a, round(e[k + 32], 6) AS b FROM ({_E}), (SELECT unnest(range(1, 33)) AS k)"


def _arff_lines(spark, sf_dir) -> DataFrame:
    text = lambda lo: F.array_join(F.transform(F.slice("e", lo, 32), lambda x: x.cast("string")), ",")
    return embeddings(spark, sf_dir).select(F.concat(F.lit("'"), text(1), F.lit("\\n"), text(33), F.lit("',"), F.col("vec_id").cast("string")).alias("value"))


@query(_ARFF)
def arff_files(spark, sf_dir):
    """Vectors as lines of ARFF files with comments, read back by the data source."""
    folder = scratch(spark)
    head = spark.createDataFrame([("% a comment",), ("@relation r",)], "value string")
    head.unionByName(_arff_lines(spark, sf_dir)).write.text(folder)
    out = arff.read_arff(spark, {"train": folder}, ["a", "b"])
    out = out.select("class", F.posexplode(F.arrays_zip("a", "b")).alias("k", "x"))
    return out.select("class", (F.col("k") + 1).cast("long").alias("k"), r6(F.col("x.a")).alias("a"), r6(F.col("x.b")).alias("b"))


@query(_ARFF)
def arff_text(spark, sf_dir):
    out = arff.parse_arff_text(_arff_lines(spark, sf_dir))
    out = out.select("class", F.posexplode(F.arrays_zip(F.col("series")[0].alias("a"), F.col("series")[1].alias("b"))).alias("k", "x"))
    return out.select("class", (F.col("k") + 1).cast("long").alias("k"), r6(F.col("x.a")).alias("a"), r6(F.col("x.b")).alias("b"))


@query(f"SELECT vec_id, 64::bigint AS n, 8000::bigint AS sr, round(list_max(list_transform(e, lambda x: abs(x))), 6) > 0 AS sounds, 0::bigint AS far FROM ({_E})")
def audio_files(spark, sf_dir):
    """Vectors as sound files, written and read again: values that differ by more than a 16-bit step."""
    folder = scratch(spark)
    scaled = F.transform("e", lambda x: x / 8)
    clips = embeddings(spark, sf_dir).select(F.concat("vec_id", F.lit(".wav")).alias("path"), F.lit(8000).alias("sr"), scaled.cast("array<float>").alias("samples"))
    audio.write_audio(clips, folder).write.format("noop").mode("overwrite").save()
    back = audio.read_audio(spark, folder).select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("vec_id"), F.col("sr").alias("read_sr"), F.col("samples").alias("s"))
    wrong = F.size(F.filter(F.zip_with("s", scaled, lambda a, b: F.abs(a - F.greatest(F.least(b, F.lit(1.0)), F.lit(-1.0))) > 2**-14), lambda x: x))
    out = embeddings(spark, sf_dir).select(F.col("vec_id").cast("long").alias("vec_id"), "e").join(back, "vec_id")
    return out.select("vec_id", F.size("s").cast("long").alias("n"), F.col("read_sr").cast("long").alias("sr"), (F.array_max(F.transform("s", F.abs)) > 0).alias("sounds"), wrong.cast("long").alias("far"))


# -- columns and names -----------------------------------------------------------------------


@query("SELECT p_brand AS f0, p_size::bigint AS f1, p_partkey AS f2 FROM part")
def columns_by_place(spark, sf_dir):
    """Columns chosen by place, the others dropped, renamed by place."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("long").alias("p_size"), "p_name").drop("p_name")
    df = relational.select_by_index(df, [1, 2, 0])
    places = {c: f"f{i}" for i, c in enumerate(df.columns)}
    return tables.rename_all(df, places.__getitem__)


@query("SELECT p_name AS value FROM part WHERE p_partkey = 7")
def one_cell(spark, sf_dir):
    return relational.cell(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 7, 1)


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def bound_columns(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return relational.bind_columns(df.select("c_custkey", "c_name"), df.select("c_custkey", "c_acctbal", "c_mktsegment"), row_id="c_custkey").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("SELECT i, j, sum(v)::bigint AS v FROM (SELECT a.l_linenumber::bigint AS i, b.l_linenumber::bigint AS j, a.q * b.q AS v FROM (SELECT l_linenumber, l_suppkey % 5 AS k, sum(l_quantity)::bigint AS q FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_suppkey % 5 AS k, l_linenumber, sum(l_quantity)::bigint AS q FROM lineitem GROUP BY 1, 2) b USING (k)) GROUP BY 1, 2")
def matrix_product(spark, sf_dir):
    cells = lineitem(spark, sf_dir).groupBy(F.col("l_linenumber").cast("long").alias("i"), (F.col("l_suppkey") % 5).alias("j")).agg(F.sum("l_quantity").cast("long").alias("v"))
    turned = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return relational.matrix_product(cells, turned).select("i", "j", F.col("v").cast("long").alias("v"))


@query("SELECT n FROM (SELECT count(*)::bigint AS n FROM events GROUP BY user_id) ORDER BY n DESC LIMIT 5")
def longest_series(spark, sf_dir):
    """The five longest series of events; a top-k report."""
    s = relational.series_by_key(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return relational.sort_by_length(s, "series").limit(5).select(F.size("series").cast("long").alias("n"))


@query("SELECT 40::bigint AS n, 40::bigint AS n_distinct, 40::bigint AS n_known")
def sampled_rows(spark, sf_dir):
    """A sample without replacement, the same for the same seed; the sample is the feature."""
    a, b = (relational.sample_rows(orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", 40, 3) for _ in range(2))
    return a.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_distinct")).crossJoin(a.intersect(b).agg(F.count("*").alias("n_known")))  # one row each


# -- conditions and features --------------------------------------------------------------------


@query("SELECT count(*) AS n, 'l_tax ≥ 0.02, l_quantity < 30.0, l_discount ≤ 0.04' AS atoms FROM lineitem WHERE l_tax >= 0.02 AND (l_quantity < 30 OR l_discount <= 0.04)")
def normal_form(spark, sf_dir):
    """A negated formula in negation normal form, applied."""
    f = Not(Or((ScalarCondition("l_tax", "<", 0.02), Not(Or((ScalarCondition("l_quantity", "<", 30.0), ScalarCondition("l_discount", "<=", 0.04)))))))
    g = conditions.normalize(f)
    return conditions.select_rows(lineitem(spark, sf_dir), g).agg(F.count("*").alias("n")).withColumn("atoms", F.lit(", ".join(map(str, g.atoms()))))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 4 <> 0")
def rows_without_nan(spark, sf_dir):
    nan = F.lit(float("nan"))
    df = embeddings(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 3 == 0, nan).otherwise(F.col("e")[0]).alias("a"), F.when(F.col("vec_id") % 4 == 0, nan).otherwise(F.col("e")[1]).alias("b"))
    return conditions.drop_nan_rows(df, ["a", "b"]).select("vec_id")


@query("WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT user_id, user_id % 3 AS c, row_number() OVER (PARTITION BY user_id % 3 ORDER BY user_id) AS k FROM s WHERE n >= 5) SELECT user_id, 5::bigint AS n FROM r WHERE k <= 4")
def trimmed_series(spark, sf_dir):
    """Series of five events at least, cut to five, four of each class: the limits are the operator's own."""
    s = relational.series_by_key(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").withColumn("c", F.col("user_id") % 3)
    return conditions.trim_series(s, "c", "series", "user_id", 5, 4).select("user_id", F.size("series").cast("long").alias("n"))


@query(literals([("lineitem", "0"), ("embeddings", "1"), ("both", "error"), ("text", "error")], "name, dimension"))
def column_dimensions(spark, sf_dir):
    e, items = embeddings(spark, sf_dir), lineitem(spark, sf_dir)
    given = {"lineitem": (items, FEATURES), "embeddings": (e, ["e"]), "both": (e, ["vec_id", "e"]), "text": (items, ["l_returnflag"])}
    rows = [(k, "error" if raises(lambda a=a: treatments.dimension(*a), TypeError) else str(treatments.dimension(*a))) for k, a in given.items()]
    return spark.createDataFrame(rows, "name string, dimension string")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS v, l_tax::double AS second, l_quantity * l_discount AS both FROM lineitem")
def variable_features(spark, sf_dir):
    """A variable itself, one by its number, and a function of several."""
    whole, second = arrays.VariableFeature("l_quantity"), arrays.VariableFeature(4)
    both = arrays.RowFeature("both", ("l_quantity", "l_discount"), lambda a, b: a * b)
    df = lineitem(spark, sf_dir)
    return df.select(*KEYS, whole.column().alias("v"), second.column(FEATURES).cast("double").alias("second"), both.column().alias("both"))


@query(
    f"SELECT vec_id, 'minimum[e]' AS name_a, round(list_min(e), 6) AS a, round(list_sum(e) / len(e), 6) AS b, round(list_max(e), 6) AS c, '>=' AS op_c, round(list_min(e), 6) AS d, '<=' AS op_d, "
    f"round(list_max(e) - list_min(e), 6) AS span FROM ({_E})"
)
def parsed_features(spark, sf_dir):
    """Features by their texts, aliases and signs, and one that is registered here."""
    arrays.register("span", lambda a: arrays.maximum(a) - arrays.minimum(a), ("range",))
    a, b, span = (arrays.parse_feature(t, ["e"]) for t in ("min[e]", " avg [ e ] ", "range[e]"))
    (c, op_c), (d, op_d) = arrays.parse_test("⪲[e]", ["e"]), arrays.parse_test("⤓[e] ⪯", ["e"])
    columns = [x.column().alias(n) for x, n in ((a, "a"), (b, "b"), (c, "c"), (d, "d"), (span, "span"))]
    out = embeddings(spark, sf_dir).select("vec_id", F.lit(a.name).alias("name_a"), *columns, F.lit(op_c).alias("op_c"), F.lit(op_d).alias("op_d"))
    return out.select("vec_id", "name_a", "op_c", "op_d", *[r6(F.col(n)).alias(n) for n in ("a", "b", "c", "d", "span")])


@query(f"SELECT vec_id, round(list_aggregate(e, 'quantile_cont', 0.1), 6) AS low, round(list_aggregate(e, 'quantile_cont', 0.9), 6) AS high FROM ({_E})")
def soft_extremes(spark, sf_dir):
    e = F.col("e")
    return embeddings(spark, sf_dir).select("vec_id", r6(arrays.soft_minimum(e, 0.1)).alias("low"), r6(arrays.soft_maximum(e, 0.1)).alias("high"))


@query(f"SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN '-inf' ELSE round(list_max(e), 6)::varchar END = CASE WHEN vec_id % 5 = 0 THEN '-inf' ELSE round(list_max(e), 6)::varchar END AS same, vec_id % 5 = 0 AS patched_high, vec_id % 5 = 0 AS patched_low, round(list_max(e), 6) AS high FROM ({_E})")
def patched_features(spark, sf_dir):
    """NaN becomes what fails the test: minus infinity for at least, infinity for at most."""
    spoilt = F.when(F.col("vec_id") % 5 == 0, F.concat("e", F.array(F.lit(float("nan"))))).otherwise(F.col("e"))
    df = embeddings(spark, sf_dir).select("vec_id", "e", arrays.feature("maximum+")(spoilt).alias("h"), arrays.feature("minimum-")(spoilt).alias("l"), arrays.maximum(F.col("e")).alias("m"))
    clean = F.col("vec_id") % 5 == 0
    return df.select("vec_id", (clean | (F.col("h") == F.col("m"))).alias("same"), (F.col("h") == float("-inf")).alias("patched_high"), (F.col("l") == float("inf")).alias("patched_low"), r6(F.col("m")).alias("high"))


# -- windows and treatments --------------------------------------------------------------------


def _bounds_sql(bounds: str) -> str:
    return f"SELECT vec_id, i, round(list_sum(e[lo : lo + n - 1]) / n, 6) AS value FROM ({_E}), ({bounds})"


def _long_windows(df: DataFrame, windowing: Windowing) -> DataFrame:
    out = treatments.reduce_size(df, ["e"], windowing, "mean", 64).select("vec_id", F.posexplode("e").alias("k", "v"))
    return out.select("vec_id", (F.col("k") + 1).cast("long").alias("i"), r6(F.col("v")).alias("value"))


@query(_bounds_sql("SELECT k + 1 AS i, 1 + k * greatest((64 - greatest(64 // 5, 1)) // 4, 1) AS lo, greatest(64 // 5, 1) AS n FROM (SELECT unnest(range(5)) AS k)"))
def moving_windows(spark, sf_dir):
    return _long_windows(embeddings(spark, sf_dir), Windowing("moving", 5))


@query(_bounds_sql("SELECT k + 1 AS i, 1 + k * 10 AS lo, 10 AS n FROM (SELECT unnest(range(6)) AS k)"))
def tiled_windows(spark, sf_dir):
    return _long_windows(embeddings(spark, sf_dir), Windowing("tiled", size=10))


@query(
    "SELECT vec_id AS row_id, 'e' AS var, win, fun, round(value, 6) AS value FROM ("
    + " UNION ALL ".join(f"SELECT vec_id, {i} AS win, '{f}' AS fun, {g}(e[{lo}:{lo + n - 1}]) AS value FROM ({_E})" for f, g in (("minimum", "list_min"), ("maximum", "list_max")) for i, (lo, n) in enumerate(windows.overlapping(64, 3, 0.05), 1))
    + ")"
)
def preprocessed(spark, sf_dir):
    out = treatments.preprocess(embeddings(spark, sf_dir), "vec_id", ["e"], "minmax", 3, 0.05)
    return out.select("row_id", "var", "win", "fun", r6(F.col("value")).alias("value"))


_CELLS = "SELECT vec_id, " + ", ".join(f"round({g.format(s=f'e[{lo}:{lo + 15}]')}, 6) AS \"e@@@w{w}@@@{f}\"" for w, lo in ((1, 1), (2, 17), (3, 33), (4, 49)) for f, g in (("minimum", "list_min({s})"), ("mean", "list_sum({s}) / 16"))) + f" FROM ({_E})"


@query(_CELLS)
def extracted_cells(spark, sf_dir):
    """A wide table of the product of variables, windows and features."""
    cells = treatments.product_of(["e"], 4, ["minimum", "mean"])
    out = treatments.extract(embeddings(spark, sf_dir), cells, Windowing("segments", 4), 64, keep=["vec_id"])
    return out.select("vec_id", *[r6(F.col(f"`{c}`")).alias(c) for c in out.columns[1:]])


@query(_CELLS.replace("vec_id,", "vec_id AS row_id,", 1))
def pivoted_cells(spark, sf_dir):
    long = treatments.long_features(embeddings(spark, sf_dir), "vec_id", ["e"], ["minimum", "mean"], Windowing("segments", 4), 64)
    out = treatments.pivot_long(long)
    return out.select("row_id", *[r6(F.col(f"`{c}`")).alias(c) for c in out.columns[1:]])


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN -1.0 ELSE round(value, 6) END AS value FROM events")
def special_values(spark, sf_dir):
    odd = F.when(F.col("event_id") % 4 == 0, float("nan")).when(F.col("event_id") % 4 == 1, float("inf")).when(F.col("event_id") % 4 == 2, float("-inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", r6(treatments.replace_special(odd, 0.0, 1.0, -1.0)).alias("value"))


@query("SELECT count(*) AS n, count(*) AS near FROM events")
def jittered(spark, sf_dir):
    """Noise of 1e-10 times the scale: all values stay within a millionth."""
    df = table(spark, sf_dir, "events").withColumn("old", F.col("value"))
    return treatments.jitter(df, ["value"], 1).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("value") - F.col("old")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("old"))).alias("near"))


@query(
    "WITH b AS (SELECT event_type, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events GROUP BY 1) "
    "SELECT event_id, round((value - lo) / (hi - lo), 6) AS scaled FROM events JOIN b USING (event_type)"
)
def quantile_normalised(spark, sf_dir):
    out = treatments.normalise_groups(table(spark, sf_dir, "events"), 0.1, 0.9, ("event_type",), exact=True)
    return out.select("event_id", r6(F.col("value")).alias("scaled"))


@query("SELECT round(1 + abs(corr(l_quantity, l_extendedprice)), 5) AS first, round(1 - abs(corr(l_quantity, l_extendedprice)), 5) AS second, count(*) FILTER (WHERE l_returnflag = 'N')::double AS flags FROM lineitem")
def prepared_components(spark, sf_dir):
    """Principal components of two standardised columns, and a one-hot column."""
    df = lineitem(spark, sf_dir).select(*FEATURES, "l_returnflag")
    two = treatments.preparation(["l_quantity", "l_extendedprice"], pca=2).fit(df).transform(df)
    parts = two.select(vector_cells("components", 2)).agg(F.var_samp(F.col("c")[0]).alias("a"), F.var_samp(F.col("c")[1]).alias("b"))
    hot = treatments.preparation([], ["l_returnflag"]).fit(df)
    labels = hot.stages[0].labels
    n = hot.transform(df).select(vector_cells("l_returnflag_1", 3)).agg(F.sum(F.get("c", F.lit(labels.index("N")))).alias("n"))
    return parts.crossJoin(n).select(F.round(F.greatest("a", "b"), 5).alias("first"), F.round(F.least("a", "b"), 5).alias("second"), F.col("n").alias("flags"))  # one row each


def vector_cells(column: str, n: int) -> F.Column:
    from pyspark.ml.functions import vector_to_array

    return F.slice(vector_to_array(F.col(column)), 1, n).alias("c")


# -- the canonical features of series, as SQL over long tables of 64 values -------------------------

_Z = f"""x AS (SELECT vec_id, unnest(e) AS v, unnest(range(64)) AS i FROM ({_E})),
z AS (SELECT vec_id, i, (v - avg(v) OVER p) / stddev_samp(v) OVER p AS y FROM x WINDOW p AS (PARTITION BY vec_id)),
acf AS (SELECT a.vec_id, b.i - a.i AS k, sum(a.y * b.y) / 63 AS r FROM z a JOIN z b ON a.vec_id = b.vec_id AND b.i >= a.i GROUP BY 1, 2),
zero AS (SELECT vec_id, coalesce(min(k) FILTER (WHERE r <= 0), 64) AS fz FROM acf GROUP BY 1)"""


def _canonical(*names: str):
    """A query of some of the 22 features, rounded to four decimals."""

    def run(spark, sf_dir):
        values = embeddings(spark, sf_dir).select("vec_id", catch22.all_features(F.col("e")).alias("v"))
        return values.select("vec_id", *[(F.round(F.col("v")[list(catch22.FEATURES).index(n)], 4) + F.lit(0.0)).alias(n) for n in names])

    return run


def _mode_sql(bins: int) -> str:
    return f"""h{bins} AS (SELECT vec_id, lo + (bin + 0.5) * (hi - lo) / {bins} AS centre, count(*) AS n FROM (SELECT z.vec_id, lo, hi, least(floor((y - lo) / (hi - lo) * {bins}), {bins - 1}) AS bin FROM z JOIN ends USING (vec_id)) GROUP BY vec_id, bin, lo, hi),
m{bins} AS (SELECT vec_id, avg(centre) AS mode_{bins} FROM (SELECT *, max(n) OVER (PARTITION BY vec_id) AS most FROM h{bins}) WHERE n = most GROUP BY 1)"""


_HISTOGRAMS = f"""WITH {_Z}, ends AS (SELECT vec_id, min(y) AS lo, max(y) AS hi FROM z GROUP BY 1), {_mode_sql(5)}, {_mode_sql(10)},
l AS (SELECT z.vec_id, i, least(greatest(floor((y - lo + 0.1) / ((hi - lo + 0.2) / 5)), 0), 4) AS s FROM z JOIN ends USING (vec_id)),
ami AS (SELECT vec_id, sum(p * ln(p / (px * py))) AS ami2 FROM (SELECT *, sum(p) OVER (PARTITION BY vec_id, a) AS px, sum(p) OVER (PARTITION BY vec_id, b) AS py FROM (SELECT l.vec_id, l.s AS a, m.s AS b, count(*) / 62.0 AS p FROM l JOIN l m ON l.vec_id = m.vec_id AND m.i = l.i + 2 GROUP BY 1, 2, 3)) GROUP BY 1),
q AS (SELECT vec_id, i, (k > 22)::int + (k > 43)::int AS s FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY y) AS k FROM z)),
pe AS (SELECT vec_id, -sum(p * ln(p)) AS entropy_pairs FROM (SELECT a.vec_id, count(*) / 63.0 AS p FROM q a JOIN q b ON a.vec_id = b.vec_id AND b.i = a.i + 1 GROUP BY a.vec_id, a.s, b.s) GROUP BY 1)
SELECT vec_id, round(mode_5, 4) + 0.0 AS mode_5, round(mode_10, 4) + 0.0 AS mode_10, round(ami2, 4) + 0.0 AS ami2, round(entropy_pairs, 4) + 0.0 AS entropy_pairs FROM m5 JOIN m10 USING (vec_id) JOIN ami USING (vec_id) JOIN pe USING (vec_id)"""


@query(_HISTOGRAMS)
def canonical_histograms(spark, sf_dir):
    return _canonical("mode_5", "mode_10", "ami2", "entropy_pairs")(spark, sf_dir)


_CORRELATIONS = f"""WITH {_Z}, fall AS (SELECT vec_id, min(k) FILTER (WHERE k > 0 AND r < exp(-1)) AS k FROM acf GROUP BY 1),
scale AS (SELECT f.vec_id, CASE WHEN f.k IS NULL THEN 64.0 ELSE f.k - 1 + (exp(-1) - b.r) / (a.r - b.r) END AS acf_timescale FROM fall f LEFT JOIN acf a ON a.vec_id = f.vec_id AND a.k = f.k LEFT JOIN acf b ON b.vec_id = f.vec_id AND b.k = f.k - 1),
low AS (SELECT vec_id, coalesce(min(k) FILTER (WHERE r < before AND r < after), 64)::double AS acf_first_min FROM (SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after FROM acf WINDOW w AS (PARTITION BY vec_id ORDER BY k)) GROUP BY 1),
d AS (SELECT vec_id, i, y - lag(y) OVER (PARTITION BY vec_id ORDER BY i) AS v FROM z), dc AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM d WHERE v IS NOT NULL),
dz AS (SELECT vec_id, coalesce(min(k) FILTER (WHERE r <= 0), 63) AS fd FROM (SELECT a.vec_id, b.i - a.i AS k, sum(a.v * b.v) AS r FROM dc a JOIN dc b ON a.vec_id = b.vec_id AND b.i >= a.i GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT a.vec_id, b.i - a.i AS k, -0.5 * ln(1 - power(corr(a.y, b.y), 2)) AS ami FROM z a JOIN z b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 1 AND 32 GROUP BY 1, 2),
gm AS (SELECT vec_id, coalesce(min(k) FILTER (WHERE ami < before AND ami < after) - 1, 32)::double AS ami_timescale FROM (SELECT *, lag(ami) OVER w AS before, lead(ami) OVER w AS after FROM g WINDOW w AS (PARTITION BY vec_id ORDER BY k)) GROUP BY 1),
fe AS (SELECT vec_id, stddev_samp(y - m) AS forecast_error FROM (SELECT vec_id, i, y, avg(y) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM z) WHERE i >= 3 GROUP BY 1)
SELECT vec_id, round(acf_timescale, 4) AS acf_timescale, acf_first_min, round(fd / fz::double, 4) AS whiten_timescale, ami_timescale, round(forecast_error, 4) AS forecast_error
FROM scale JOIN low USING (vec_id) JOIN dz USING (vec_id) JOIN zero USING (vec_id) JOIN gm USING (vec_id) JOIN fe USING (vec_id)"""


@query(_CORRELATIONS)
def canonical_correlations(spark, sf_dir):
    return _canonical("acf_timescale", "acf_first_min", "whiten_timescale", "ami_timescale", "forecast_error")(spark, sf_dir)


_SPECTRUM = f"""WITH {_Z}, s AS (SELECT vec_id, k, (power(sum(y * cos(2 * pi() * k * i / 64)), 2) + power(sum(y * sin(2 * pi() * k * i / 64)), 2)) / 64 * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / (2 * pi()) AS p FROM z, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2),
c AS (SELECT vec_id, k, p, sum(p) OVER (PARTITION BY vec_id ORDER BY k) AS upto, sum(p) OVER (PARTITION BY vec_id) AS total FROM s)
SELECT vec_id, round(sum(p) FILTER (WHERE k < 6) * pi() / 32, 4) AS low_freq_power, round(min(k) FILTER (WHERE upto > total / 2) * pi() / 32, 4) AS centroid_freq FROM c GROUP BY 1"""


@query(_SPECTRUM)
def canonical_spectrum(spark, sf_dir):
    return _canonical("low_freq_power", "centroid_freq")(spark, sf_dir)


def _outlier_sql(name: str, sign: int) -> str:
    return f"""w{name} AS (SELECT vec_id, i + 1 AS place, {sign} * y AS v FROM z), e{name} AS (SELECT vec_id, floor(max(v) / 0.01)::int AS top, count(*) FILTER (WHERE v >= 0) AS total FROM w{name} GROUP BY 1 HAVING max(v) >= 0.01),
t{name} AS (SELECT vec_id, k, total, count(*) AS n, median(place) / 32 - 1 AS m FROM e{name} CROSS JOIN (SELECT unnest(range(800)) AS k) kk JOIN w{name} USING (vec_id) WHERE k <= top AND v >= k * 0.01 GROUP BY 1, 2, 3),
s{name} AS (SELECT vec_id, min(k) FILTER (WHERE (n - 1) * 100 / total::double <= 2) AS stop FROM t{name} GROUP BY 1),
o{name} AS (SELECT vec_id, median(m) AS v FROM t{name} JOIN s{name} USING (vec_id) WHERE stop IS NULL OR k <= stop GROUP BY 1)"""


_OUTLIERS = f"""WITH {_Z}, {_outlier_sql("a", 1)}, {_outlier_sql("b", -1)}
SELECT v.vec_id, round(coalesce(oa.v, 0), 4) + 0.0 AS outlier_timing_pos, round(coalesce(ob.v, 0), 4) + 0.0 AS outlier_timing_neg FROM (SELECT DISTINCT vec_id FROM z) v LEFT JOIN oa ON oa.vec_id = v.vec_id LEFT JOIN ob ON ob.vec_id = v.vec_id"""


@query(_OUTLIERS)
def canonical_outliers(spark, sf_dir):
    return _canonical("outlier_timing_pos", "outlier_timing_neg")(spark, sf_dir)


_EMBEDDING = f"""WITH {_Z}, tau AS (SELECT vec_id, least(fz, 6) AS t, fz FROM zero),
d AS (SELECT a.vec_id, sqrt(power(b.y - a.y, 2) + power(d.y - c.y, 2)) AS d FROM tau JOIN z a ON a.vec_id = tau.vec_id JOIN z b ON b.vec_id = a.vec_id AND b.i = a.i + 1 JOIN z c ON c.vec_id = a.vec_id AND c.i = a.i + t JOIN z d ON d.vec_id = a.vec_id AND d.i = a.i + 1 + t),
m AS (SELECT vec_id, count(*) AS n, avg(d) AS mean, min(d) AS lo, max(d) AS hi, CASE WHEN stddev_samp(d) > 0.001 THEN greatest(ceil((max(d) - min(d)) / (3.5 * stddev_samp(d) / power(count(*), 1 / 3.0))), 1) ELSE 1 END::int AS bins FROM d GROUP BY 1),
h AS (SELECT vec_id, least(floor((d - lo) / (hi - lo) * bins), bins - 1)::int AS bin, count(*) AS c FROM d JOIN m USING (vec_id) GROUP BY 1, 2),
grid AS (SELECT *, unnest(range(bins)) AS bin FROM m),
ed AS (SELECT vec_id, avg(abs(coalesce(c, 0) / n::double - exp(-(lo + (bin + 0.5) * (hi - lo) / bins) / mean) / mean)) AS embedding_dist FROM grid LEFT JOIN h USING (vec_id, bin) GROUP BY 1),
s AS (SELECT z.vec_id, i // fz AS j, y, quantile_cont(y, 1 / 3.0::double) OVER w AS c1, quantile_cont(y, 2 / 3.0::double) OVER w AS c2, count(*) OVER w AS n FROM z JOIN tau USING (vec_id) WHERE i % fz = 0 WINDOW w AS (PARTITION BY z.vec_id)),
l AS (SELECT vec_id, j, n, (y > c1)::int + (y > c2)::int AS s FROM s),
p AS (SELECT a.vec_id, a.s AS a, b.s AS b, count(*) / (max(a.n) - 1)::double AS p FROM l a JOIN l b ON a.vec_id = b.vec_id AND b.j = a.j + 1 GROUP BY 1, 2, 3),
cells AS (SELECT v.vec_id, a, b, coalesce(p, 0) AS p FROM (SELECT DISTINCT vec_id FROM l WHERE n > 2) v CROSS JOIN (SELECT unnest(range(3)) AS a) aa CROSS JOIN (SELECT unnest(range(3)) AS b) bb LEFT JOIN p USING (vec_id, a, b)),
tv AS (SELECT vec_id, sum(v) AS transition_variance FROM (SELECT vec_id, b, var_samp(p) AS v FROM cells GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, round(embedding_dist, 4) AS embedding_dist, round(transition_variance, 4) AS transition_variance FROM ed LEFT JOIN tv USING (vec_id)"""


@query(_EMBEDDING)
def canonical_embedding(spark, sf_dir):
    return _canonical("embedding_dist", "transition_variance")(spark, sf_dir)


def _fluctuation_sql(name: str, lag: int, value: str) -> str:
    scales = np.unique(np.round(np.exp(np.linspace(np.log(5), np.log(32), 50))).astype(int)).tolist()
    sums = ", ".join(f"sum({c}) OVER w AS s{n}" for n, c in (("x", "x"), ("y", "f"), ("xx", "x * x"), ("xy", "x * f"), ("yy", "f * f")))
    error = "sqrt(greatest(syy - sy * sy / k - CASE WHEN sxx - sx * sx / k > 1e-12 THEN power(sxy - sx * sy / k, 2) / (sxx - sx * sx / k) ELSE 0 END, 0))"
    return f"""k{name} AS (SELECT vec_id, i // {lag} AS i, sum(y) OVER (PARTITION BY vec_id ORDER BY i) AS w FROM z WHERE i % {lag} = 0),
g{name} AS (SELECT vec_id, s, i // s AS seg, i % s + 1 - (s + 1) / 2.0 AS t, w FROM k{name}, (SELECT unnest({scales}) AS s) WHERE i < ({64 // lag} // s) * s),
f{name} AS (SELECT *, w - avg(w) OVER p - sum(w * t) OVER p / sum(t * t) OVER p * t AS r FROM g{name} WINDOW p AS (PARTITION BY vec_id, s, seg)),
v{name} AS (SELECT vec_id, s, ln({value}) AS f, ln(s) AS x FROM (SELECT vec_id, s, seg, max(r) - min(r) AS span, sum(r * r) AS sq, count(*) AS c FROM f{name} GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{name} AS (SELECT vec_id, k, {error} AS e FROM (SELECT vec_id, row_number() OVER w AS k, {sums} FROM v{name} WINDOW w AS (PARTITION BY vec_id ORDER BY s)) q),
a{name} AS (SELECT vec_id, n - k + 1 AS place, n, {error} AS e FROM (SELECT vec_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY vec_id) AS n, {sums} FROM v{name} WINDOW w AS (PARTITION BY vec_id ORDER BY s DESC)) q),
r{name} AS (SELECT vec_id, arg_min(k / n::double, (b.e + a.e, k)) AS v FROM b{name} b JOIN a{name} a USING (vec_id) WHERE a.place = b.k AND b.k BETWEEN 6 AND n - 6 GROUP BY 1)"""


_FLUCTUATION = f"""WITH {_Z}, {_fluctuation_sql("c", 1, "sqrt(avg(span * span))")}, {_fluctuation_sql("d", 2, "sqrt(sum(sq) / sum(c))")}
SELECT rc.vec_id, round(rc.v, 4) AS rs_range, round(rd.v, 4) AS dfa FROM rc JOIN rd USING (vec_id)"""


@query(_FLUCTUATION)
def canonical_fluctuation(spark, sf_dir):
    return _canonical("rs_range", "dfa")(spark, sf_dir)


def _periodicity_sql() -> str:
    t = np.linspace(0, 1, 64)
    basis = np.stack([np.ones(64), t, t**2, t**3, *[np.maximum(t - k, 0) ** 3 for k in (1 / 3, 2 / 3)]], 1)
    rows = ", ".join(f"({j}, {[float(x) for x in row]})" for j, row in enumerate(np.linalg.pinv(basis)))
    column = "CASE j WHEN 0 THEN 1 WHEN 1 THEN u WHEN 2 THEN u * u WHEN 3 THEN u * u * u WHEN 4 THEN power(greatest(u - 1 / 3.0::double, 0), 3) ELSE power(greatest(u - 2 / 3.0::double, 0), 3) END"
    return f"""WITH {_Z}, solve AS (SELECT * FROM (VALUES {rows}) v(j, row)), coef AS (SELECT vec_id, j, sum(row[i + 1] * y) AS c FROM z, solve GROUP BY 1, 2),
r AS (SELECT z.vec_id, z.i, any_value(y) - sum(c * {column}) AS v FROM (SELECT *, i / 63.0::double AS u FROM z) z JOIN coef USING (vec_id) GROUP BY 1, 2),
a AS (SELECT a.vec_id, b.i - a.i AS k, avg(a.v * b.v) AS c FROM r a JOIN r b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 1 AND 22 GROUP BY 1, 2),
n AS (SELECT *, c < lag(c) OVER w AND c < lead(c) OVER w AS trough, c > lag(c) OVER w AND c > lead(c) OVER w AS peak FROM a WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
l AS (SELECT *, last_value(CASE WHEN trough THEN c END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM n)
SELECT vec_id, coalesce(min(k) FILTER (WHERE peak AND c - low >= 0.01 AND c >= 0), 0)::double AS periodicity FROM l GROUP BY 1"""


@query(_periodicity_sql())
def canonical_periodicity(spark, sf_dir):
    return _canonical("periodicity")(spark, sf_dir)


# -- signals ----------------------------------------------------------------------------------


def clips(spark, sf_dir) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("path"), F.lit(64).alias("sr"), F.col("e").alias("samples"))


_SPEC = f"""s AS (SELECT vec_id, f, k, power(sum(v * cos(2 * pi() * k * t / 16)), 2) + power(sum(v * sin(2 * pi() * k * t / 16)), 2) AS p FROM (
  SELECT vec_id, f, t, e[f * 8 + t + 1] * (0.5 - 0.5 * cos(2 * pi() * t / 16)) AS v FROM ({_E}), (SELECT unnest(range(7)) AS f), (SELECT unnest(range(16)) AS t)), (SELECT unnest(range(9)) AS k) GROUP BY 1, 2, 3)"""


def _framewise(spark, sf_dir, kernel, names: list[str]) -> DataFrame:
    """vec_id, f, names: what a kernel gives for each frame of each vector."""
    out = signal.per_clip(clips(spark, sf_dir), kernel, "path string, " + ", ".join(f"{n} array<double>" for n in names))
    rows = out.select(F.col("path").cast("long").alias("vec_id"), F.posexplode(F.arrays_zip(*names)).alias("f", "x"))
    return rows.select("vec_id", F.col("f").cast("long").alias("f"), *[r6(F.col(f"x.{n}")).alias(n) for n in names])


@query(f"WITH {_SPEC} SELECT vec_id, f, " + ", ".join(f"round(sum(p) FILTER (WHERE k = {k}), 6) + 0.0 AS b{k}" for k in range(9)) + ", round(sqrt(sum(p) FILTER (WHERE k = 3)), 6) + 0.0 AS m3 FROM s GROUP BY 1, 2")
def frame_spectra(spark, sf_dir):
    def kernel(x, rate):
        power, magnitude = signal.stft(x, rate, 16)[0], signal.stft(x, rate, 16, norm="magnitude")[0]
        return {f"b{k}": power[:, k] for k in range(9)} | {"m3": magnitude[:, 3]}

    return _framewise(spark, sf_dir, kernel, [*(f"b{k}" for k in range(9)), "m3"])


_SHAPES = f"""WITH {_SPEC}, g AS (SELECT vec_id, f, k, p, 4.0 * k AS fr, sum(p) OVER w AS total, avg(p) OVER w AS mean, avg(4.0 * k) OVER w AS middle, sqrt(sum(p * p) OVER w) AS norm, sum(p) OVER (w ORDER BY k) AS upto, first_value(p) OVER (w ORDER BY k) AS p0 FROM s WINDOW w AS (PARTITION BY vec_id, f)),
c AS (SELECT *, sum(p * fr) OVER w / total AS c FROM g WINDOW w AS (PARTITION BY vec_id, f)), d AS (SELECT *, sqrt(sum(p * power(fr - c, 2)) OVER w / total) AS sd FROM c WINDOW w AS (PARTITION BY vec_id, f)),
u AS (SELECT *, p / norm - lag(p / norm) OVER (PARTITION BY vec_id, k ORDER BY f) AS step FROM d)
SELECT vec_id, f, round(any_value(c), 6) AS centroid, round(any_value(sd), 6) AS spread, round(sum(p / total * power(fr - c, 3)) / power(any_value(sd), 3), 6) + 0.0 AS skewness, round(sum(p / total * power(fr - c, 4)) / power(any_value(sd), 4), 6) AS kurtosis,
  round(-sum(p / total * log2(p / total)) / log2(9), 6) AS entropy, round(exp(avg(ln(p))) / any_value(mean), 6) AS flatness, round(max(p) / any_value(mean), 6) AS crest, round(coalesce(sqrt(sum(step * step)), 0), 6) AS flux,
  round(sum((p - mean) * (fr - middle)) / sum(power(fr - middle, 2)), 6) + 0.0 AS slope, round(sum((p - p0) / k) FILTER (WHERE k > 0) / sum(p) FILTER (WHERE k > 0), 6) + 0.0 AS decrease, min(fr) FILTER (WHERE upto / total >= 0.95) AS rolloff FROM u GROUP BY 1, 2"""


@query(_SHAPES)
def frame_shapes(spark, sf_dir):
    names = ["centroid", "spread", "skewness", "kurtosis", "entropy", "flatness", "crest", "flux", "slope", "decrease", "rolloff"]
    return _framewise(spark, sf_dir, lambda x, rate: signal.spectral_shape(*signal.stft(x, rate, 16)), names)


_BANK = """bank AS (SELECT b, k, greatest(0, least((4.0 * k - lo) / (mid - lo), (hi - 4.0 * k) / (hi - mid))) / ((hi - lo) / 2) AS weight FROM (SELECT b, 700 * (power(10, m * b / 7 / 2595) - 1) AS lo, 700 * (power(10, m * (b + 1) / 7 / 2595) - 1) AS mid, 700 * (power(10, m * (b + 2) / 7 / 2595) - 1) AS hi
  FROM (SELECT unnest(range(6)) AS b, 2595 * log10(1 + 32 / 700.0::double) AS m)), (SELECT unnest(range(9)) AS k)),
mel AS (SELECT vec_id, f, b, sum(p * weight) AS v FROM s JOIN bank USING (k) GROUP BY 1, 2, 3)"""


def _mel(x, rate):
    bank = signal.triangular_filterbank(signal.band_edges("mel_htk", 6, 0, rate / 2), 16, rate)
    return signal.band_spectrum(signal.stft(x, rate, 16)[0], bank)


@query(f"WITH {_SPEC}, {_BANK} SELECT vec_id, f, " + ", ".join(f"round(sum(v) FILTER (WHERE b = {b}), 6) + 0.0 AS m{b}" for b in range(6)) + " FROM mel GROUP BY 1, 2")
def band_spectra(spark, sf_dir):
    return _framewise(spark, sf_dir, lambda x, rate: {f"m{b}": v for b, v in enumerate(_mel(x, rate).T)}, [f"m{b}" for b in range(6)])


_CEPSTRA = f"""WITH {_SPEC}, {_BANK}, c AS (SELECT vec_id, f, j, sum(log10(greatest(v, 2.2250738585072014e-308)) * cos(pi() / 6 * j * (b + 0.5))) * sqrt(2 / 6.0::double) / CASE WHEN j = 0 THEN sqrt(2) ELSE 1 END AS c FROM mel, (SELECT unnest(range(3)) AS j) GROUP BY 1, 2, 3),
d AS (SELECT vec_id, f, j, c, (2 * c + coalesce(lag(c, 1) OVER w, 0) - coalesce(lag(c, 3) OVER w, 0) - 2 * coalesce(lag(c, 4) OVER w, 0)) / 10 AS d FROM c WINDOW w AS (PARTITION BY vec_id, j ORDER BY f))
SELECT vec_id, f, {", ".join(f"round(sum({x}) FILTER (WHERE j = {j}), 6) + 0.0 AS {x}{j}" for x in "cd" for j in range(3))} FROM d GROUP BY 1, 2"""


@query(_CEPSTRA)
def cepstral_features(spark, sf_dir):
    def kernel(x, rate):
        c = signal.cepstra(_mel(x, rate), 3)
        d = signal.deltas(c, 5)
        return {f"c{j}": c[:, j] for j in range(3)} | {f"d{j}": d[:, j] for j in range(3)}

    return _framewise(spark, sf_dir, kernel, [*(f"c{j}" for j in range(3)), *(f"d{j}" for j in range(3))])


@query(f"WITH {_SPEC} SELECT vec_id, f, arg_min(4.0 * k, (-p, k))::double AS f0 FROM s GROUP BY 1, 2")
def spectrum_pitch(spark, sf_dir):
    return _framewise(spark, sf_dir, lambda x, rate: {"f0": signal.spectrum_pitch(*signal.stft(x, rate, 16))}, ["f0"])


@query(
    f"""WITH r AS (SELECT vec_id, list_sum(list_transform(e, lambda x: x * x)) AS r0, list_sum(list_transform(list_zip(e[1:63], e[2:64]), lambda p: p[1] * p[2])) AS r1, list_sum(list_transform(list_zip(e[1:62], e[3:64]), lambda p: p[1] * p[2])) AS r2,
  list_sum(list_transform(range(64), lambda i: power(e[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 64)), 2))) AS energy FROM ({_E})), k AS (SELECT *, -r1 / r0 AS k1 FROM r), l AS (SELECT *, r0 * (1 - k1 * k1) AS e1, -(r2 + k1 * r1) / (r0 * (1 - k1 * k1)) AS k2 FROM k)
SELECT vec_id, round(k1 + k2 * k1, 6) + 0.0 AS a1, round(k2, 6) + 0.0 AS a2, round(e1 * (1 - k2 * k2), 6) AS error, round(energy, 6) AS residual FROM l"""
)
def linear_prediction(spark, sf_dir):
    """Coefficients of order two, and the energy of the residual, which is that of the windowed frame."""

    def kernel(x, rate):
        a, e = signal.linear_prediction(x, 2)
        residual = signal.prediction_residual(x, 64, 32, 4)
        return {"a1": float(a[1]), "a2": float(a[2]), "error": e, "residual": float(residual @ residual)}

    out = signal.per_clip(clips(spark, sf_dir), kernel, "path string, a1 double, a2 double, error double, residual double")
    return out.select(F.col("path").cast("long").alias("vec_id"), *[r6(F.col(c)).alias(c) for c in ("a1", "a2", "error", "residual")])


@query(
    f"WITH x AS (SELECT vec_id, unnest(e) AS v, unnest(range(64)) AS i FROM ({_E})), a AS (SELECT vec_id, arg_min(i, (-v, i)) AS first FROM x GROUP BY 1) "
    "SELECT vec_id, any_value(first) AS first, arg_min(i, (-v, i)) AS second FROM x JOIN a USING (vec_id) WHERE abs(i - first) > 3 GROUP BY 1"
)
def peak_candidates(spark, sf_dir):
    def kernel(x, rate):
        first, second = signal.peak_candidates(x[None], 2, 0, 63, 3)[0]
        return {"first": int(first), "second": int(second)}

    out = signal.per_clip(clips(spark, sf_dir), kernel, "path string, first long, second long")
    return out.select(F.col("path").cast("long").alias("vec_id"), "first", "second")


@query(f"SELECT vec_id, true AS restored, round(list_sum(e) / 8, 6) + 0.0 AS first FROM ({_E})")
def cosine_transform(spark, sf_dir):
    """The transform and its inverse of type 2, and that of type 3, which is the transform of type 2."""

    def kernel(x, rate):
        c = x[None] @ signal.dct_matrix(64, 64).T
        again = signal.inverse_dct(signal.inverse_dct(c, kind=2), kind=3)
        return {"restored": bool(np.abs(signal.inverse_dct(c) - x).max() < 1e-9 and np.abs(again - c).max() < 1e-9), "first": float(c[0, 0])}

    out = signal.per_clip(clips(spark, sf_dir), kernel, "path string, restored boolean, first double")
    return out.select(F.col("path").cast("long").alias("vec_id"), "restored", r6(F.col("first")).alias("first"))


@query(
    f"""WITH s AS (SELECT vec_id, f, k, power(sum(v * cos(2 * pi() * k * t / 256)), 2) + power(sum(v * sin(2 * pi() * k * t / 256)), 2) AS p FROM (
  SELECT vec_id, f, t, e[(f * 128 + t) % 64 + 1] * (0.5 - 0.5 * cos(2 * pi() * t / 256)) AS v FROM ({_E}), (SELECT unnest(range(3)) AS f), (SELECT unnest(range(256)) AS t)), (SELECT unnest(range(129)) AS k) GROUP BY 1, 2, 3),
bank AS (SELECT b, k, greatest(0, least((0.25 * k - lo) / (mid - lo), (hi - 0.25 * k) / (hi - mid))) / ((hi - lo) / 2) AS weight FROM (SELECT b, 700 * (power(10, m * b / 27 / 2595) - 1) AS lo, 700 * (power(10, m * (b + 1) / 27 / 2595) - 1) AS mid, 700 * (power(10, m * (b + 2) / 27 / 2595) - 1) AS hi
  FROM (SELECT unnest(range(26)) AS b, 2595 * log10(1 + 32 / 700.0::double) AS m)), (SELECT unnest(range(129)) AS k))
SELECT vec_id, 'mel' || (b + 1) AS name, round(sum(p * weight) / 3, 4) + 0.0 AS value FROM s JOIN bank USING (k) GROUP BY 1, b"""
)
def audio_features(spark, sf_dir):
    """The mean band spectrum of each vector, played eight times."""
    df = clips(spark, sf_dir).withColumn("samples", F.flatten(F.array_repeat("samples", 8)))
    out = signal.audio_features(df, "mel", 26)
    rows = out.select(F.col("path").cast("long").alias("vec_id"), F.explode(F.arrays_zip("names", "values")).alias("x"))
    return rows.select("vec_id", F.col("x.names").alias("name"), (F.round("x.values", 4) + F.lit(0.0)).alias("value"))


# -- models and their rules -----------------------------------------------------------------------


def _raw_tree() -> RawNode:
    return RawNode(0, 24.0, RawNode(2, 0.05, RawNode(majority=0), RawNode(majority=1)), RawNode(1, 60000.0, RawNode(majority=2), RawNode(3, 0.04, RawNode(majority=1), RawNode(majority=0))))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {TREE_SQL} AS prediction, {STUMPS_SQL[0]} AS stump, CASE WHEN l_tax <= 0.03 THEN 1.5 ELSE 2.5 END::double AS number FROM lineitem")
def converted_trees(spark, sf_dir):
    """A learner's nodes as symbolic trees: with classes, as an ensemble, and with numbers in the leaves."""
    tree = models.convert(_raw_tree(), FEATURES, ["A", "N", "R"])
    stump = RawNode(0, 24.0, RawNode(majority=0), RawNode(majority=2))
    forest = models.convert_ensemble([stump, stump, _raw_tree()], FEATURES, ["A", "N", "R"], weights=[1.0, 1.0, 0.5])
    numbers = models.convert(RawNode(3, 0.03, RawNode(majority=1.5), RawNode(majority=2.5)), FEATURES, op="<=")
    out = models.apply_model(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), tree)
    out = models.apply_model(out, forest, "stump")
    return models.apply_model(out, numbers, "number").select(*KEYS, "prediction", "stump", "number")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {TREE_SQL} AS p0, {TREE_SQL} AS first, {STUMPS_SQL[0]} AS second, {STUMPS_SQL[1]} AS third, 1::bigint AS kept FROM lineitem")
def collected_predictions(spark, sf_dir):
    """Predictions of one model after another, added to an array or put in its place, and those of an ensemble's leaves."""
    df = models.collect_predictions(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), TREE)
    df = models.collect_predictions(df, Ensemble(tuple(STUMPS[:2])), leaves_only=True)
    out = models.collect_predictions(df.withColumn("p0", F.col("predictions")[0]).withColumn("all", F.col("predictions")), STUMPS[0], mode="replace")
    return out.select(*KEYS, "p0", F.col("all")[0].alias("first"), F.col("all")[1].alias("second"), F.col("all")[2].alias("third"), F.size("predictions").cast("long").alias("kept"))


_LIST = DecisionList((Rule(ScalarCondition("l_quantity", "<", 10.0), Leaf("A")), Rule(ScalarCondition("l_tax", ">=", 0.05), Leaf("R"))), Leaf("N"))


def _counted(sql: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS rule, '{c}' AS consequent, count(*) FILTER (WHERE {w}) AS ncovered FROM lineitem" for k, (w, c) in sql.items())


_NESTED = {
    "l_quantity < 10.0": ("l_quantity < 10", "A"), "(l_quantity ≥ 10.0) ∧ (l_tax ≥ 0.05)": ("l_quantity >= 10 AND l_tax >= 0.05", "R"), "(l_quantity ≥ 10.0) ∧ (l_tax < 0.05)": ("l_quantity >= 10 AND l_tax < 0.05", "N"),
    "(l_discount ≥ 0.05) ∧ (l_quantity < 10.0)": ("l_discount >= 0.05 AND l_quantity < 10", "A"), "(l_discount ≥ 0.05) ∧ (l_quantity ≥ 10.0) ∧ (l_tax ≥ 0.05)": ("l_discount >= 0.05 AND l_quantity >= 10 AND l_tax >= 0.05", "R"),
    "(l_discount ≥ 0.05) ∧ (l_quantity ≥ 10.0) ∧ (l_tax < 0.05)": ("l_discount >= 0.05 AND l_quantity >= 10 AND l_tax < 0.05", "N"), "l_discount < 0.05": ("l_discount < 0.05", "A"),
}


@query(_counted(_NESTED))
def rules_of_lists(spark, sf_dir):
    """The rules of a decision list, and of a mixed model with that list below a branch."""
    mixed = MixedModel(Branch(ScalarCondition("l_discount", "<", 0.05), Leaf("A"), _LIST))
    found = models.list_rules(_LIST) + models.list_rules(mixed)
    return rules.rule_metrics(lineitem(spark, sf_dir), found, "l_returnflag").select("rule", "consequent", "ncovered")


_PRODUCTS = {
    "(l_quantity < 24.0) ∧ (l_discount ≥ 0.05)": ("l_quantity < 24 AND l_discount >= 0.05", "A"), "(l_quantity < 24.0) ∧ (l_discount < 0.05)": ("l_quantity < 24 AND l_discount < 0.05", "A"),
    "(l_quantity ≥ 24.0) ∧ (l_discount ≥ 0.05)": ("l_quantity >= 24 AND l_discount >= 0.05", "N"), "(l_quantity ≥ 24.0) ∧ (l_discount < 0.05)": ("l_quantity >= 24 AND l_discount < 0.05", "A"),
}


@query(_counted(_PRODUCTS))
def rules_of_ensembles(spark, sf_dir):
    """The products of two trees' rules; of equal votes the smallest label."""
    return rules.rule_metrics(lineitem(spark, sf_dir), models.list_rules(Ensemble(tuple(STUMPS[:2]))), "l_returnflag").select("rule", "consequent", "ncovered")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, least({', '.join(STUMPS_SQL)}) AS prediction FROM lineitem")
def custom_vote(spark, sf_dir):
    m = Ensemble(tuple(STUMPS), vote=models.parity_first)
    return models.apply_model(lineitem(spark, sf_dir).select(*KEYS, *FEATURES), m).select(*KEYS, "prediction")


_METRIC = """SELECT '{rule}' AS rule, count(*) FILTER (WHERE {w}) AS ncovered, count(*) FILTER (WHERE {w} AND l_returnflag = '{c}') / count(*) FILTER (WHERE {w})::double AS confidence FROM lineitem"""


@query(
    "SELECT rank, rule FROM (SELECT *, row_number() OVER (ORDER BY confidence DESC, ncovered, rule) AS rank FROM ("
    + " UNION ALL ".join(_METRIC.format(rule=k, w=w, c=c) for k, (w, c) in {**_PRODUCTS, **{k: v for k, v in list(_NESTED.items())[:3]}}.items())
    + ")) WHERE rank <= 4"
)
def ordered_rules(spark, sf_dir):
    """Rules by falling confidence, then by what they cover, the first four: the cap is the operator's own."""
    found = models.list_rules(Ensemble(tuple(STUMPS[:2]))) + models.list_rules(_LIST)
    metrics = rules.rule_metrics(lineitem(spark, sf_dir), found, "l_returnflag")
    return rules.ordered(metrics, ("confidence", "ncovered", "rule"), (True, False, False), 4).select("rank", "rule")


# labels that thresholds decide, which learners have to find

_DECIDED = "CASE WHEN l_linenumber >= 4 THEN 'late' ELSE 'early' END"
_BOTH = "CASE WHEN l_linenumber >= 4 AND l_suppkey % 2 = 1 THEN 'odd' ELSE 'other' END"


def decided(spark, sf_dir, label: str) -> DataFrame:
    df = lineitem(spark, sf_dir).select(F.col("l_linenumber").cast("double").alias("line"), (F.col("l_suppkey") % 2).cast("double").alias("odd"), "l_quantity", F.expr(label).alias("label"))
    return df


_LATE = Tree(Branch(ScalarCondition("line", "<", 3.5), Branch(ScalarCondition("l_quantity", "<", 20.0), Leaf("early"), Leaf("early")), Branch(ScalarCondition("odd", "<", 0.5), Leaf("late"), Leaf("late"))))


def _extracted(spark, sf_dir, selector: str | None) -> DataFrame:
    df = decided(spark, sf_dir, _DECIDED)
    found = rules.extract(df, Ensemble((_LATE, _LATE)), "label", rules.ExtractorOptions(selector=selector))
    out = models.apply_model(df, found).groupBy("label", "prediction").agg(F.count("*").alias("n"))
    return out.select("label", "prediction", "n", F.lit(max(len(rules._atoms(r.antecedent)) for r in found.rules)).cast("long").alias("longest"))


_EXTRACTED = f"SELECT {_DECIDED} AS label, {_DECIDED} AS prediction, count(*) AS n, 1::bigint AS longest FROM lineitem GROUP BY 1"


@query(_EXTRACTED)
def extracted_all(spark, sf_dir):
    """Rules with a conjunct too many are pruned to the one that decides, and listed by covering."""
    return _extracted(spark, sf_dir, None)


@query(_EXTRACTED)
def extracted_by_importance(spark, sf_dir):
    return _extracted(spark, sf_dir, "cbc")


@query(_EXTRACTED)
def extracted_by_correlation(spark, sf_dir):
    return _extracted(spark, sf_dir, "cfs")


@query(f"SELECT {_BOTH} AS label, {_BOTH} AS prediction, count(*) AS n FROM lineitem GROUP BY 1")
def learned_covering(spark, sf_dir):
    """The covering learner finds a conjunction of two thresholds."""
    df = decided(spark, sf_dir, _BOTH)
    found = rules.learn_covering(df, ["line", "odd"], "label", rules.CoveringOptions(beam=4, max_atoms=2, thresholds=15))
    return models.apply_model(df, found).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query(f"SELECT m AS model, {_BOTH} AS label, {_BOTH} AS prediction, count(*) AS n FROM lineitem, (VALUES ('decision_tree'), ('random_forest'), ('boosting')) v(m) GROUP BY 1, 2")
def learned_models(spark, sf_dir):
    """Learners by name, applied: a tree, a forest and boosted classes find a conjunction of two thresholds."""
    df = decided(spark, sf_dir, _BOTH)
    out = None
    for name, params in (("decision_tree", {"max_depth": 3, "seed": 1}), ("random_forest", {"n_trees": 9, "max_depth": 5, "seed": 1}), ("boosting", {"rounds": 6, "depth": 2})):
        model = evaluation.make_learner(name, **params)(df, ["line", "odd"], "label", False)
        part = models.apply_model(df, model).groupBy("label", "prediction").agg(F.count("*").alias("n")).select(F.lit(name).alias("model"), "label", "prediction", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(literals([(s, m, f, 1.0) for s, k in (("holdout", 1), ("cv", 3), ("stratified", 3)) for m in ("accuracy", "kappa") for f in (-1, *range(k))], "resample, measure, fold, value"))
def analysed(spark, sf_dir):
    """Analyses of labels that a threshold decides, by several splits: every fold's measures are 1."""
    df = decided(spark, sf_dir, _DECIDED).withColumn("row_id", F.xxhash64("line", "odd", "l_quantity"))
    df = df.groupBy("row_id").agg(F.first("line").alias("line"), F.first("l_quantity").alias("l_quantity"), F.first("label").alias("label"))
    specs = [{"model": "decision_tree", "resample": (k, o)} for k, o in (("holdout", {}), ("cv", {"k": 3}), ("stratified", {"k": 3}))]
    found = evaluation.run_models(df, ["line", "l_quantity"], "label", "row_id", specs, {"params": {"max_depth": 3, "seed": 1}})
    out = None
    for name, a in zip(("holdout", "cv", "stratified"), found.values(), strict=True):
        part = a.measures.select(F.lit(name).alias("resample"), "measure", F.col("fold").cast("long").alias("fold"), r6(F.col("value")).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query(literals([("time", 0, True), ("time", 1, True), ("tuned", 0, True)], "resample, fold, small"))
def analysed_numbers(spark, sf_dir):
    """A regression on folds in time order, and one whose depth is tuned: errors far below the spread of the target."""
    df = orders(spark, sf_dir).select("o_orderkey", (F.col("o_orderkey") % 7).cast("double").alias("x"), ((F.col("o_orderkey") % 7) * 10.0).alias("y"))
    by_time = evaluation.symbolic_analysis(df, ["x"], "y", "o_orderkey", params={"max_depth": 4, "seed": 1}, resample=("time", {"key": "o_orderkey", "k": 2}))
    tuned = evaluation.symbolic_analysis(df, ["x"], "y", "o_orderkey", tuning=([evaluation.Range("max_depth", values=(1, 4))], evaluation.Tuning("grid")), params={"seed": 1})
    parts = [a.measures.where("fold >= 0 and measure = 'rms'").select(F.lit(n).alias("resample"), F.col("fold").cast("long").alias("fold"), (F.col("value") < 1.0).alias("small")) for n, a in (("time", by_time), ("tuned", tuned))]
    return parts[0].unionByName(parts[1])


# -- the first steps of boosting as SQL -----------------------------------------------------------------


def _split_steps(name: str, rows: str, levels: int, features: str = "qd") -> tuple[str, str]:
    """(CTEs, name of the last one): ``rows`` (rid, features, g, h, ...) with the node of each row after ``levels`` levels of splits."""
    value = "CASE b.i " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(features)) + " END"
    out, at = [f"{name}_0 AS (SELECT *, '' AS node FROM {rows})"], f"{name}_0"
    for k in range(levels):
        values = " UNION ALL ".join(f"SELECT node, {i} AS i, {f} AS v, g, h FROM {at}" for i, f in enumerate(features))
        able = f"SELECT node FROM {at} GROUP BY node HAVING length(node) = {k}" + (" AND sum(h) >= 2" if k else "")
        out += [
            f"{name}_v{k} AS (SELECT node, i, v, sum(g) AS g, sum(h) AS h FROM ({values}) WHERE node IN ({able}) GROUP BY 1, 2, 3)",
            f"{name}_c{k} AS (SELECT node, i, v, lead(v) OVER w AS after, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY node, i) AS gt, sum(h) OVER (PARTITION BY node, i) AS ht FROM {name}_v{k} WINDOW w AS (PARTITION BY node, i ORDER BY v))",
            f"{name}_g{k} AS (SELECT node, i, (v + after) / 2 AS t, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM {name}_c{k} WHERE after IS NOT NULL AND hl >= 1 AND ht - hl >= 1)",
            f"{name}_b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, i, t) AS r FROM {name}_g{k} WHERE gain > 0) WHERE r = 1)",
            f"{name}_{k + 1} AS (SELECT r.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN r.node WHEN {value} < b.t THEN r.node || 'p' ELSE r.node || 'n' END AS node FROM {at} r LEFT JOIN {name}_b{k} b ON r.node = b.node)",
        ]
        at = f"{name}_{k + 1}"
    out.append(f"{name}_w AS (SELECT node, -sum(g) / (sum(h) + 1) AS w FROM {at} GROUP BY node)")
    out.append(f"{name} AS (SELECT r.rid, w FROM {at} r JOIN {name}_w USING (node))")
    return ", ".join(out), name


_ROWS = "d AS (SELECT row_number() OVER () AS rid, l_quantity::double AS q, l_discount::double AS d, l_extendedprice::double AS y, l_linestatus AS c, l_returnflag AS f, l_tax::double AS x FROM lineitem)"


def _regression_sql(rounds: int, depth: int, features: str = "qd", shown: str = "round(sqrt(mse), 3) AS rmse") -> str:
    parts, errors = [_ROWS, "p0 AS (SELECT *, avg(y) OVER () AS p FROM d)"], ["SELECT 0 AS rounds, avg(power(y - p, 2)) AS mse FROM p0"]
    for r in range(rounds):
        parts.append(f"g{r} AS (SELECT *, p - y AS g, 1.0::double AS h FROM p{r})")
        cte, name = _split_steps(f"s{r}", f"g{r}", depth, features)
        parts += [cte, f"p{r + 1} AS (SELECT p{r}.* REPLACE (p + 0.3 * w AS p) FROM p{r} JOIN {name} USING (rid))"]
        errors.append(f"SELECT {r + 1}, avg(power(y - p, 2)) FROM p{r + 1}")
    return f"WITH {', '.join(parts)} SELECT rounds::bigint AS rounds, {shown} FROM ({' UNION ALL '.join(errors)})"


@query(_regression_sql(2, 2))
def boosting_steps(spark, sf_dir):
    """Two rounds of trees of depth two on quantity and discount: the error after each."""
    df = lineitem(spark, sf_dir).select("l_quantity", "l_discount", "l_extendedprice")
    m = boosting.boost_regression(df, ["l_quantity", "l_discount"], "l_extendedprice", boosting.BoostOptions(rounds=2, depth=2), watch=df)
    return spark.createDataFrame([(k, math.sqrt(e)) for k, e in enumerate(m.history)], "rounds long, rmse double").select("rounds", F.round("rmse", 3).alias("rmse"))


def _logistic_sql(rounds: int) -> str:
    parts, losses = [_ROWS, "p0 AS (SELECT *, 0.0::double AS p FROM d)"], []
    loss = "SELECT {r}::bigint AS rounds, round(avg(-ln(CASE WHEN c = 'O' THEN 1 / (1 + exp(-p)) ELSE 1 - 1 / (1 + exp(-p)) END)), 6) AS log_loss FROM p{r}"
    for r in range(rounds):
        parts.append(f"g{r} AS (SELECT *, 1 / (1 + exp(-p)) - (c = 'O')::int AS g, 1 / (1 + exp(-p)) * (1 - 1 / (1 + exp(-p))) AS h FROM p{r})")
        cte, name = _split_steps(f"s{r}", f"g{r}", 1)
        parts += [cte, f"p{r + 1} AS (SELECT p{r}.* REPLACE (p + 0.3 * w AS p) FROM p{r} JOIN {name} USING (rid))"]
    losses = [loss.format(r=r) for r in range(rounds + 1)]
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(losses)}"


@query(_logistic_sql(3))
def boosted_classifier_steps(spark, sf_dir):
    """Three rounds of stumps for two classes: the log loss of a watched table after each."""
    df = lineitem(spark, sf_dir).select("l_quantity", "l_discount", "l_linestatus")
    m = boosting.boost_classes(df, ["l_quantity", "l_discount"], "l_linestatus", boosting.BoostOptions(rounds=3, depth=1), watch=df)
    return spark.createDataFrame(list(enumerate(m.history)), "rounds long, log_loss double").select("rounds", r6(F.col("log_loss")).alias("log_loss"))


def _softmax_sql() -> str:
    parts = [_ROWS]
    for c in "ANR":
        parts.append(f"g{c} AS (SELECT *, 1 / 3.0::double - (f = '{c}')::int AS g, 2 / 9.0::double AS h FROM d)")
        parts.append(_split_steps(f"s{c}", f"g{c}", 1)[0])
    scores = "SELECT d.f, 0.3 * sA.w AS a, 0.3 * sN.w AS n, 0.3 * sR.w AS r FROM d JOIN sA USING (rid) JOIN sN USING (rid) JOIN sR USING (rid)"
    return f"WITH {', '.join(parts)} SELECT round(avg(-ln(exp(CASE f WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END) / (exp(a) + exp(n) + exp(r)))), 6) AS log_loss, count(*) AS n FROM ({scores})"


@query(_softmax_sql())
def boosted_softmax_step(spark, sf_dir):
    """One round of a stump for each of three classes: the log loss by the measure of folds."""
    df = lineitem(spark, sf_dir).select("l_quantity", "l_discount", "l_returnflag")
    m = boosting.boost_classes(df, ["l_quantity", "l_discount"], "l_returnflag", boosting.BoostOptions(rounds=1, depth=1))
    out = m.apply(df).select(F.lit(0).alias("fold"), F.col("l_returnflag").alias("label"), "prediction", "probabilities")
    found = evaluation.evaluate(out, ["log_loss"], classes=list(m.classes)).where("fold = -1")
    return found.crossJoin(out.agg(F.count("*").alias("n"))).select(r6(F.col("value")).alias("log_loss"), "n")  # one row each


def _samme_sql(rounds: int, features: dict[str, str], accuracy: bool = False) -> str:
    """The stumps of stage-wise boosting of the line status, or the accuracy of their vote; ``features`` are columns of ``d`` by name."""
    parts, rows = [_ROWS, "w0 AS (SELECT *, 1.0::double / count(*) OVER () AS w FROM d)"], []
    gini = lambda f, o: f"({f} + {o} - CASE WHEN {f} + {o} > 0 THEN ({f} * {f} + {o} * {o}) / ({f} + {o}) ELSE 0 END)"
    value = "CASE b.i " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(features.values())) + " END"
    for r in range(rounds):
        values = " UNION ALL ".join(f"SELECT {i} AS i, {f} AS v, c, w FROM w{r}" for i, f in enumerate(features.values()))
        label = f"CASE WHEN {value} < b.t THEN CASE WHEN fl >= ol THEN 'F' ELSE 'O' END ELSE CASE WHEN fr >= orr THEN 'F' ELSE 'O' END END"
        parts += [
            f"v{r} AS (SELECT i, v, sum(CASE c WHEN 'F' THEN w ELSE 0 END) AS f, sum(CASE c WHEN 'O' THEN w ELSE 0 END) AS o FROM ({values}) GROUP BY 1, 2)",
            f"c{r} AS (SELECT i, v, lead(v) OVER x AS after, sum(f) OVER x AS fl, sum(o) OVER x AS ol, sum(f) OVER (PARTITION BY i) AS ft, sum(o) OVER (PARTITION BY i) AS ot FROM v{r} WINDOW x AS (PARTITION BY i ORDER BY v))",
            f"b{r} AS (SELECT i, (v + after) / 2 AS t, fl, ol, ft - fl AS fr, ot - ol AS orr FROM c{r} WHERE after IS NOT NULL ORDER BY {gini('ft', 'ot')} - {gini('fl', 'ol')} - {gini('(ft - fl)', '(ot - ol)')} DESC, i, t LIMIT 1)",
            f"m{r} AS (SELECT w{r}.*, {label} AS l{r}, {label} <> c AS miss FROM w{r}, b{r} b)",
            f"e{r} AS (SELECT sum(w) FILTER (WHERE miss) / sum(w) AS e FROM m{r})",
            f"u{r} AS (SELECT m.*, CASE WHEN miss THEN w * (1 - e) / e ELSE w END AS uw FROM m{r} m, e{r})",
            f"w{r + 1} AS (SELECT * EXCLUDE (w, uw, miss), uw / sum(uw) OVER () AS w FROM u{r})",
        ]
        name = "CASE i " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(features)) + " END"
        rows.append(f"SELECT {r}::bigint AS round, {name} AS feature, round(t, 6) AS threshold, round(ln((1 - e) / e), 5) AS coefficient FROM b{r}, e{r}")
    if not accuracy:
        return f"WITH {', '.join(parts)} {' UNION ALL '.join(rows)}"
    side = lambda c: " + ".join(f"CASE l{r} WHEN '{c}' THEN ln((1 - e{r}.e) / e{r}.e) ELSE 0 END" for r in range(rounds))
    return f"WITH {', '.join(parts)} SELECT round(avg((CASE WHEN {side('F')} >= {side('O')} THEN 'F' ELSE 'O' END = c)::int::double), 6) AS accuracy, count(*) AS n FROM w{rounds}, {', '.join(f'e{r}' for r in range(rounds))}"


@query(_samme_sql(2, {"l_quantity": "q", "l_discount": "d"}))
def samme_steps(spark, sf_dir):
    """The first two stumps of stage-wise boosting with their coefficients."""
    df = lineitem(spark, sf_dir).select("l_quantity", "l_discount", "l_linestatus")
    m = boosting.samme(df, ["l_quantity", "l_discount"], "l_linestatus", rounds=2)
    rows = [(k, t.root.condition.feature, t.root.condition.threshold, c) for k, (t, c) in enumerate(zip(m.trees, m.coefficients, strict=True))]
    return spark.createDataFrame(rows, "round long, feature string, threshold double, coefficient double").select("round", "feature", r6(F.col("threshold")).alias("threshold"), F.round("coefficient", 5).alias("coefficient"))


@query(
    "WITH l AS (SELECT CASE WHEN l_quantity < 24 THEN 'p' ELSE 'n' END AS path, l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY 1, 2) "
    "SELECT tree, path, arg_min(c, (-n, c)) AS outcome, CASE path WHEN 'p' THEN 0.5 WHEN 'n' THEN -0.25 ELSE 0.125 END::double AS score FROM (SELECT 0::bigint AS tree, * FROM l UNION ALL SELECT 1, '', l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag) GROUP BY 1, 2"
)
def labelled_leaves(spark, sf_dir):
    """Boosted trees whose leaves take the most frequent label of their rows; a tree of one leaf keeps its place."""
    trees = [Tree(Branch(ScalarCondition("l_quantity", "<", 24.0), Leaf(None, 0.5), Leaf(None, -0.25))), Tree(Leaf(None, 0.125))]
    found = boosting.label_boosted_leaves(lineitem(spark, sf_dir), trees, "l_returnflag")
    rows = []
    for k, t in enumerate(found):
        nodes = [("p", t.root.positive), ("n", t.root.negative)] if isinstance(t.root, Branch) else [("", t.root)]
        rows += [(k, path, n.outcome, n.score) for path, n in nodes]
    return spark.createDataFrame(rows, "tree long, path string, outcome string, score double")


@query("SELECT round(avg(l_quantity), 6) AS mean, 0.5::double AS half, 2.0::double AS given, round(avg(l_quantity), 6) AS rescaled FROM lineitem")
def base_scores(spark, sf_dir):
    """The base score by its rule, and a regression's sum from the mean of its leaves."""
    df = lineitem(spark, sf_dir)
    mean, half, given = (boosting.base_score(df, "l_quantity", g) for g in (-math.inf, None, 2.0))
    out = df.agg(F.avg("l_quantity").alias("m")).select(F.lit(mean).alias("mean"), F.lit(half).alias("half"), F.lit(given).alias("given"), boosting.rescaled_mean((F.col("m") - 2.0) / 4, 4, 2.0).alias("rescaled"))
    return out.select(r6(F.col("mean")).alias("mean"), "half", "given", r6(F.col("rescaled")).alias("rescaled"))


# -- measures, tuning, selection ----------------------------------------------------------------------


@query(
    f"WITH p AS (SELECT (l_orderkey % 3)::bigint AS fold, l_returnflag AS y, {TREE_SQL} AS p, l_quantity / 51 AS pa FROM lineitem), f AS (SELECT fold, count(*) AS n, avg((y = p)::int::double) AS accuracy, "
    "avg(-ln(least(greatest(CASE y WHEN 'A' THEN pa ELSE (1 - pa) / 2 END, 2.22e-16), 1 - 2.22e-16))) AS log_loss, avg(power(pa - (y = 'A')::int, 2) + power((1 - pa) / 2 - (y = 'N')::int, 2) + power((1 - pa) / 2 - (y = 'R')::int, 2)) AS brier, "
    "count(*) FILTER (WHERE y <> 'A' AND p <> 'A') / count(*) FILTER (WHERE y <> 'A')::double AS specificity, avg((y = 'A' AND p = 'A')::int::double) AS pair FROM p GROUP BY 1), "
    "l AS (SELECT fold, n, unnest(['accuracy', 'log_loss', 'brier', 'specificity', 'pair']) AS measure, unnest([accuracy, log_loss, brier, specificity, pair]) AS v FROM f) "
    "SELECT measure, fold, round(v, 6) AS value FROM l UNION ALL SELECT measure, -1, round(sum(v * n) / sum(n), 6) FROM l GROUP BY 1"
)
def probability_folds(spark, sf_dir):
    """Measures of labels, of probabilities, and one of our own, by fold and over all."""
    pa = F.col("l_quantity") / 51
    p = models.apply_model(lineitem(spark, sf_dir), TREE).select((F.col("l_orderkey") % 3).alias("fold"), F.col("l_returnflag").alias("label"), "prediction", F.array(pa, (1 - pa) / 2, (1 - pa) / 2).alias("probabilities"))
    own = {"pair": lambda y, q: F.avg(((F.col(y) == "A") & (F.col(q) == "A")).cast("double"))}
    out = evaluation.evaluate(p, ["accuracy", "log_loss", "brier", "specificity", "pair"], own, ["A", "N", "R"], "A")
    return out.select("measure", F.col("fold").cast("long").alias("fold"), r6(F.col("value")).alias("value"))


@query(f"WITH c AS (SELECT (l_orderkey % 3)::bigint AS fold, l_returnflag AS label, {TREE_SQL} AS prediction, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) SELECT * FROM c UNION ALL SELECT -1, label, prediction, sum(n)::bigint FROM c GROUP BY 2, 3")
def confusion_folds(spark, sf_dir):
    p = models.apply_model(lineitem(spark, sf_dir), TREE).select((F.col("l_orderkey") % 3).alias("fold"), F.col("l_returnflag").alias("label"), "prediction")
    return evaluation.confusion_of(p).select(F.col("fold").cast("long").alias("fold"), "label", "prediction", "n")


_VARIANCES = " UNION ALL ".join(f"SELECT '{c}' AS name, var_samp({c}) AS score FROM lineitem" for c in FEATURES)


@query(
    f"WITH s AS ({_VARIANCES}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS best, row_number() OVER (ORDER BY score, name) AS least FROM s) "
    "SELECT 'best' AS limiter, name, best <= 3 AS kept FROM r UNION ALL SELECT 'at_most', name, score <= 1 OR least <= 3 FROM r UNION ALL SELECT 'everything', name, true FROM r UNION ALL SELECT 'percentage', name, least <= 2 FROM r UNION ALL SELECT 'own', name, score > 1 FROM r"
)
def limiters(spark, sf_dir):
    """Rankings, thresholds with a least number, everything, a percentage, and a limiter of our own."""
    own = lambda scores: scores.withColumn("kept", F.col("score") > 1)
    given = {"best": selection.Best(3), "at_most": selection.AtMost(1.0, 3), "everything": selection.Everything(), "percentage": selection.Percentage(0.5, descending=False), "own": own}
    out = None
    for name, limit in given.items():
        part = selection.run_step(lineitem(spark, sf_dir), FEATURES, selection.Step(selection.variance_scores, limit)).select(F.lit(name).alias("limiter"), "name", "kept")
        out = part if out is None else out.unionByName(part)
    return out


_WIDE = " UNION ALL ".join(
    f"SELECT 'e@@@w{w}@@@{f}' AS name, 'w{w}' AS win, '{f}' AS fun, var_samp(v) AS score FROM (SELECT {g.format(s=f'e[{lo}:{lo + 15}]')} AS v FROM ({_E}))"
    for w, lo in ((1, 1), (2, 17), (3, 33), (4, 49)) for f, g in (("minimum", "list_min({s})"), ("maximum", "list_max({s})"), ("mean", "list_sum({s}) / 16"))
)


def _wide(spark, sf_dir) -> DataFrame:
    return treatments.extract(embeddings(spark, sf_dir), treatments.product_of(["e"], 4, ["minimum", "maximum", "mean"]), Windowing("segments", 4), 64)


@query(
    f"WITH s AS ({_WIDE}), g AS (SELECT fun, max(score) AS score FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, fun) AS k FROM g), f AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) AS k FROM s) "
    "SELECT 'groups' AS way, name, round(r.score, 6) AS score, k <= 1 AS kept FROM s JOIN r USING (fun) UNION ALL SELECT 'features first', name, round(score, 6), bool_or(k <= 3) OVER (PARTITION BY win) FROM f"
)
def grouped_selection(spark, sf_dir):
    """Groups of name parts by an aggregate of our own, and groups of which any feature is kept."""
    df = _wide(spark, sf_dir)
    by_group = selection.run_step(df, df.columns, selection.Step(selection.variance_scores, selection.Best(1), (2,), F.max))
    first = selection.run_step(df, df.columns, selection.Step(selection.variance_scores, selection.Best(3), (1,), limit_first=True))
    rows = lambda d, way: d.select(F.lit(way).alias("way"), "name", r6(F.col("score")).alias("score"), "kept")
    return rows(by_group, "groups").unionByName(rows(first, "features first"))


_STEPS = f"WITH s AS ({_WIDE}), a AS (SELECT *, row_number() OVER (ORDER BY score DESC, name) <= 6 AS kept FROM s)"


@query(f"{_STEPS} SELECT 0::bigint AS step, fun AS part, count(*) AS total, count(*) FILTER (WHERE kept) AS kept, (SELECT count(*) FROM a WHERE kept) AS names, 'e' AS variables FROM a GROUP BY 2")
def selection_survivors(spark, sf_dir):
    """Survivors by one part of the names, the names of a step, and the variables behind them."""
    df = _wide(spark, sf_dir)
    names, mid = selection.run_selection(df, df.columns, [selection.Step(selection.variance_scores, selection.Percentage(0.5))])
    back = selection.apply_selection(embeddings(spark, sf_dir), names)
    out = selection.survivor_study(mid, 2)
    return out.select(F.col("step").cast("long").alias("step"), "part", "total", F.col("kept").cast("long").alias("kept"), F.lit(len(selection.names_at_step(mid, 0))).cast("long").alias("names"), F.lit(",".join(back.columns)).alias("variables"))


_ERFC = "-1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))"
_LONG = f"x AS (SELECT vec_id, label::varchar AS y, unnest(e) AS v, unnest(range(64)) AS i FROM ({_E}))"
_MANN_WHITNEY = f"""WITH {_LONG}, r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY i, v) AS t, count(*) OVER (PARTITION BY i) AS n FROM x WINDOW w AS (PARTITION BY i ORDER BY v)),
t AS (SELECT i, sum(t * t - 1)::double AS tie FROM r GROUP BY 1), s AS (SELECT i, y, count(*)::double AS n1, any_value(n)::double AS n, sum(r) AS r1 FROM r GROUP BY 1, 2),
z AS (SELECT i, greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) - 0.5, 0) / sqrt(n1 * (n - n1) / 12 * (n + 1 - tie / (n * (n - 1)))) / sqrt(2) AS z FROM s JOIN t USING (i)),
p AS (SELECT i, least(t * exp(-z * z + {_ERFC}), 1) AS p FROM (SELECT *, 1 / (1 + z / 2) AS t FROM z))
SELECT 'e' || i AS name, round(min(p), 6) AS score FROM p GROUP BY i"""


_INFORMATION = f"""WITH {_LONG.replace("unnest(e) AS v, unnest(range(64)) AS i", "unnest(list_transform(e, lambda a, i: a + (vec_id * 7919 % 1009) * 1e-6::double * i)) AS v, unnest(range(64)) AS i")}, k AS (SELECT i, y, count(*) AS size FROM x GROUP BY 1, 2 HAVING count(*) > 1), c AS (SELECT x.*, size, least(size - 1, 3) AS kk FROM x JOIN k USING (i, y)),
near AS (SELECT a.i, a.vec_id, any_value(a.v) AS v, any_value(a.size) AS size, any_value(a.kk) AS kk, list_sort(list(abs(a.v - b.v)))[1:3] AS d FROM c a JOIN c b ON a.i = b.i AND a.y = b.y AND a.vec_id <> b.vec_id GROUP BY 1, 2),
m AS (SELECT a.i, a.vec_id, any_value(a.size) AS size, any_value(a.kk) AS kk, count(*) AS m FROM near a JOIN c b ON a.i = b.i AND abs(a.v - b.v) < a.d[a.kk] GROUP BY 1, 2),
n AS (SELECT i, count(*) AS n FROM c GROUP BY 1), psi AS (SELECT j + 1 AS j, -0.5772156649015329 + coalesce(sum(1.0::double / nullif(j, 0)) OVER (ORDER BY j), 0) AS psi FROM (SELECT unnest(range(20000)) AS j))
SELECT 'e' || i AS name, round(greatest(any_value(pn.psi) + avg(pk.psi) - avg(ps.psi) - avg(pm.psi), 0), 6) + 0.0 AS score
FROM m JOIN n USING (i) JOIN psi pn ON pn.j = n.n JOIN psi pk ON pk.j = m.kk JOIN psi ps ON ps.j = m.size JOIN psi pm ON pm.j = m.m GROUP BY i"""


_WORLDS = f"SELECT vec_id, x, y, list_max(e[x : y - 1]) AS m FROM ({_E}), (SELECT unnest(range(1, 9)) AS x), (SELECT unnest(range(2, 10)) AS y) WHERE y > x AND y - x <= 3"


@query(
    f"WITH w AS ({_WORLDS}) SELECT a.vec_id, count(*) FILTER (WHERE holds_some) AS later, count(*) FILTER (WHERE holds_all) AS inside FROM (SELECT v.vec_id, v.x, v.y, coalesce(bool_or(w.m >= 0.5) FILTER (WHERE w.x > v.y), false) AS holds_some, "
    "coalesce(bool_and(w.m >= -0.5) FILTER (WHERE (w.x > v.x AND w.y < v.y) OR (w.x = v.x AND w.y < v.y) OR (w.y = v.y AND w.x > v.x)), true) AS holds_all FROM w v JOIN w ON v.vec_id = w.vec_id GROUP BY 1, 2, 3) a GROUP BY 1"
)
def related_worlds(spark, sf_dir):
    """Intervals with a later relative that passes a test, and those all of whose inner relatives do."""
    e = F.slice("e", 1, 8)
    worlds = windows.all_intervals(F.lit(8), 3)
    held = lambda *a, **k: F.size(F.filter(windows.related_holds(e, worlds, *a, **k), lambda b: b)).cast("long")
    return embeddings(spark, sf_dir).select("vec_id", held("L", "maximum", ">=", 0.5).alias("later"), held("DBE", "maximum", ">=", -0.5, universal=True).alias("inside"))


@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def column_ranges(spark, sf_dir):
    """Range and mean of a column by class: windows of the whole series of each class."""
    s = relational.series_by_key(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    e = F.col("series")
    return s.select("event_type", F.size(e).cast("long").alias("n"), r6(arrays.minimum(e)).alias("low"), r6(arrays.maximum(e)).alias("high"), r6(arrays.mean(e)).alias("mean"))


# -- oracles of queries of the catalogue that need what is defined here ----------------------------------

_MEANS = ", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in ("centroid", "entropy", "flatness"))
_EVERY = (_HISTOGRAMS, _CORRELATIONS, _SPECTRUM, _OUTLIERS, _EMBEDDING, _FLUCTUATION, _periodicity_sql())
_SHAPE = ORACLES["series_shape"].replace("power(d / s, 3)), 5)", "power(d / s, 3)), 4)").replace("0.04 * s)::int::double), 6)", "0.04 * s)::int::double), 4)")
ORACLES |= {
    "boosting_fit": _regression_sql(5, 2, "qdx", "round(mse, 1) AS mse"),
    "samme_fit": _samme_sql(3, {"l_quantity": "q", "l_extendedprice": "y", "l_discount": "d", "l_tax": "x"}, accuracy=True),
    "canonical_features": f"SELECT * FROM ({_SHAPE}) " + " ".join(f"JOIN ({sql}) q{i} USING (vec_id)" for i, sql in enumerate(_EVERY)),
    "spectra": _SHAPES.replace("round(any_value(c), 6) AS centroid", "any_value(c) AS centroid").replace("/ log2(9), 6) AS entropy", "/ log2(9), 12) AS entropy").replace("any_value(mean), 6) AS flatness", "any_value(mean), 12) AS flatness").join(("SELECT vec_id, " + _MEANS + " FROM (", ") GROUP BY 1")),
    "mann_whitney": _MANN_WHITNEY,
    "information_scores": _INFORMATION,
    "selection_pipeline": f"{_STEPS} SELECT 0::bigint AS step, name, round(score, 6) AS score, kept FROM a UNION ALL SELECT 1, name, 1.0, true FROM a WHERE kept",
}
