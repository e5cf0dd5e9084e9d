"""Queries of names, features, signals, models and options that take what they work on from the tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, signal, treatments
from ..operators import boosting, conditions, evaluation, models, rules, selection
from ..operators.conditions import MetaCondition, ScalarCondition
from ..operators.models import Branch, Ensemble, Leaf, Tree
from ..sources import tables
from . import coverage
from .catalogue import _E, STUMPS, STUMPS_SQL, TREE, TREE_SQL, embeddings, lineitem, orders, query, r6, table


# -- sources and names ----------------------------------------------------------------------------


@query(
    "SELECT 'part' AS source, count(*) AS n, 3::bigint AS width, count(DISTINCT p_brand) AS classes FROM part UNION ALL SELECT 'orders', count(*), 2, count(DISTINCT o_orderstatus) FROM orders "
    "UNION ALL SELECT 'names', count(*), 1, 0 FROM nation UNION ALL SELECT 'none', 0, 3, 0 FROM region WHERE r_regionkey = 0"
)
def sample_sources(spark, sf_dir):
    """The given tables as sources that know whether they are empty, their rows and their classes, and one column held in memory."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_brand").alias("label"))
    held = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").collect()]  # the nations
    made = {
        "part": tables.Source(part), "orders": tables.Source(orders(spark, sf_dir).select("o_orderkey", F.col("o_orderstatus").alias("label"))),
        "names": tables.Source.of_vector(spark, held, "name"), "none": tables.Source(part.where("p_partkey < 0")),
    }
    rows = []
    for name, s in made.items():
        classes = s.table.select("label").distinct().count() if "label" in s.table.columns else 0
        rows.append((name, 0 if s.is_empty() else s.n_rows(), len(s.table.columns), classes))
    return spark.createDataFrame(rows, "source string, n long, width long, classes long")


@query("SELECT row_number() OVER (ORDER BY s) AS place, 'mel[' || round(s * 20.2)::bigint || 'Hz]' AS name FROM (SELECT DISTINCT p_size AS s FROM part) UNION ALL SELECT count(DISTINCT p_size) + 1, 'centroid' FROM part")
def variable_names(spark, sf_dir):
    """Names of variables for the bands that the sizes of the parts stand for."""
    sizes = sorted(r[0] for r in table(spark, sf_dir, "part").select("p_size").distinct().collect())  # at most fifty
    names = treatments.variable_names(["mel", "centroid"], {"mel": [s * 20.2 for s in sizes]})
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "place long, name string")


@query("SELECT name, rank() OVER (ORDER BY t, u) AS place FROM (SELECT DISTINCT event_type || '_' || user_id AS name, event_type AS t, user_id AS u FROM events WHERE event_type IN (SELECT min(event_type) FROM events UNION SELECT max(event_type) FROM events))")
def natural_names(spark, sf_dir):
    """Names of series in the order of their numbers: ten follows nine."""
    events = table(spark, sf_dir, "events")
    kinds = events.agg(F.min("event_type"), F.max("event_type")).first()
    names = events.where(F.col("event_type").isin(*kinds)).select(F.concat_ws("_", "event_type", "user_id").alias("name")).distinct()
    return selection.natural_ranks(names, "name").select("name", "place")


@query(
    "WITH m AS (SELECT avg(l_quantity) AS q, avg(l_tax) AS t FROM lineitem) SELECT 'l_quantity' AS feature, 'l_quantity < ⍰' AS condition, count(*) FILTER (WHERE l_quantity < q) AS n FROM lineitem, m UNION ALL "
    "SELECT 'l_quantity', 'l_quantity ≥ ⍰', count(*) FILTER (WHERE l_quantity >= q) FROM lineitem, m UNION ALL SELECT 'l_tax', 'l_tax > ⍰', count(*) FILTER (WHERE l_tax > t) FROM lineitem, m UNION ALL SELECT 'l_discount', '', 0"
)
def grouped_metaconditions(spark, sf_dir):
    """Metaconditions grouped by feature, each with the rows that pass it at the feature's mean."""
    df = lineitem(spark, sf_dir)
    names = ["l_quantity", "l_tax", "l_discount"]
    found = conditions.group_by_feature([MetaCondition("l_quantity", "<"), MetaCondition("l_tax", ">"), MetaCondition("l_quantity", ">=")], names)
    means = df.agg(*[F.avg(c).alias(c) for c in names]).first()
    flat = [(f, m) for f, ms in found for m in ms]
    counts = df.agg(*[F.count_if(ScalarCondition(f, m.op, float(means[f])).column()).alias(f"c{i}") for i, (f, m) in enumerate(flat)]).first()
    rows = [(f, str(m), counts[f"c{i}"]) for i, (f, m) in enumerate(flat)] + [(f, "", 0) for f, ms in found if not ms]
    return spark.createDataFrame(rows, "feature string, condition string, n long")


# -- feature sets and texts -------------------------------------------------------------------------

_SETS = {
    "maximum": "list_max(e)", "minimum": "list_min(e)", "mean": "list_sum(e) / 64", "median": "list_aggregate(e, 'median')", "std": "list_aggregate(e, 'stddev_samp')",
}


@query(
    " UNION ALL ".join(
        f"SELECT '{s}' AS feature_set, '{n}' AS name, {str(n in ('maximum', 'minimum')).lower()} AS collapses, round(avg({_SETS[n]}), 6) AS mean FROM ({_E})"
        for s, names in (("minmax", ("maximum", "minimum")), ("custom", ("mean", "maximum")), ("catch9", ("maximum", "minimum", "mean", "median", "std"))) for n in names
    )
)
def feature_sets(spark, sf_dir):
    """The features of each set over all vectors, as far as SQL has them; unknown names are refused."""
    out, df = None, embeddings(spark, sf_dir)
    if not (coverage.raises(lambda: arrays.feature_set("no such set"), KeyError) and coverage.raises(lambda: arrays.parse_feature("nothing[e]"), KeyError)):
        raise AssertionError("unknown names are accepted")
    for s, given in (("minmax", "minmax"), ("custom", ["avg", "max"]), ("catch9", "catch9")):
        names = [arrays.ALIASES.get(n, n) for n in arrays.feature_set(given)]
        row = df.agg(*[F.avg(arrays.VariableFeature("e", n).column()).alias(n) for n in names if n in _SETS])
        cells = [F.struct(F.lit(n).alias("name"), F.lit(arrays.is_collapsing(arrays.VariableFeature("e", n))).alias("collapses"), r6(F.col(n)).alias("mean")) for n in names if n in _SETS]
        part = row.select(F.lit(s).alias("feature_set"), F.inline(F.array(*cells)))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_orderkey, '(price < ' || format('{:.2f}', floor(o_totalprice)::double / 8) || ') ∧ (priority < ' || o_shippriority || ')' AS text FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 7 AS o_shippriority FROM orders)")
def rounded_texts(spark, sf_dir):
    """Decimal numbers in texts, to two places; whole numbers stay."""
    price = (F.floor("o_totalprice").cast("double") / 8).cast("string")
    texts = orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("(price < "), price, F.lit(") ∧ (priority < "), (F.col("o_orderkey") % 7).cast("string"), F.lit(")")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            yield b.assign(text=b["text"].map(arrays.round_numbers))

    return texts.mapInPandas(run, "o_orderkey long, text string")


# -- signals -----------------------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT c_custkey, abs(c_acctbal)::double + 50 AS hz FROM customer), s AS (SELECT c_custkey, 'mel_htk' AS scale, hz, 2595 * log10(1 + hz / 700) AS value FROM f UNION ALL SELECT c_custkey, 'mel_slaney', hz, CASE WHEN hz < 1000 THEN hz * 3 / 200 ELSE 15 + ln(hz / 1000) * 27 / ln(6.4) END FROM f
UNION ALL SELECT c_custkey, 'erb', hz, 1000 * ln(10) / (24.673 * 4.368) * log10(1 + 0.004368 * hz) FROM f UNION ALL SELECT c_custkey, 'bark', hz, CASE WHEN b < 2 THEN 0.85 * b + 0.3 WHEN b > 20.1 THEN 1.22 * b - 4.422 ELSE b END FROM (SELECT c_custkey, hz, 26.81 * hz / (1960 + hz) - 0.53 AS b FROM f)
UNION ALL SELECT c_custkey, 'semitones', hz, 12 * log2(hz / 440) + 69 FROM f) SELECT c_custkey, scale, round(value, 6) AS value, round(hz, 4) AS back FROM s"""
)
def frequency_scales(spark, sf_dir):
    """The customers' balances as frequencies, on every scale and back."""
    hz = table(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal").cast("double") + 50).alias("hz"))

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for scale, (to, back) in signal.SCALES.items():
                value = to(b["hz"].to_numpy())
                yield pd.DataFrame({"c_custkey": b["c_custkey"], "scale": scale, "value": value, "back": back(value)})

    return hz.mapInPandas(run, "c_custkey long, scale string, value double, back double").select("c_custkey", "scale", r6(F.col("value")).alias("value"), F.round("back", 4).alias("back"))


_SHAPE_SQL = "CASE WHEN n = 1 THEN 1 ELSE a - b * cos(2 * pi() * {i} / {n}) END"


@query(
    f"SELECT p_partkey, kind, round(sum({_SHAPE_SQL.format(i='i', n='n')}), 6) AS periodic, round(sum({_SHAPE_SQL.format(i='i', n='nullif(n - 1, 0)')}), 6) + 0.0 AS symmetric, round(any_value({_SHAPE_SQL.format(i='((n + 1) // 2 % n)', n='n')}), 6) + 0.0 AS first "
    "FROM (SELECT p_partkey, p_size AS n, unnest(range(p_size)) AS i FROM part), (VALUES ('hann', 0.5, 0.5), ('hamming', 0.54, 0.46), ('rect', 1.0, 0.0)) v(kind, a, b) GROUP BY 1, 2"
)
def window_functions(spark, sf_dir):
    """Windows as long as each part's size: the sums of the periodic and the symmetric one, and the first value of the shifted one."""
    sizes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("n"))

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for k in ("hann", "hamming", "rect"):
                made = {n: (signal.window_function(k, n).sum(), signal.window_function(k, n, False).sum(), signal.window_function(k, n, True, True)[0]) for n in b["n"].unique().tolist()}
                yield pd.DataFrame([(p, k, *made[n]) for p, n in zip(b["p_partkey"], b["n"], strict=True)], columns=["p_partkey", "kind", "periodic", "symmetric", "first"])

    return sizes.mapInPandas(run, "p_partkey long, kind string, periodic double, symmetric double, first double").select("p_partkey", "kind", *[r6(F.col(c)).alias(c) for c in ("periodic", "symmetric", "first")])


@query(
    f"""WITH w AS (SELECT band, bin, norm, CASE norm WHEN 'none' THEN w WHEN 'area' THEN w / sum(w) OVER (PARTITION BY band, norm) ELSE w / 100 END AS weight FROM (SELECT b AS band, k AS bin, greatest(0, least((250.0 * k - 100 * b) / 100, (100 * b + 200 - 250.0 * k) / 100)) AS w
  FROM (SELECT unnest(range(10)) AS b), (SELECT unnest(range(5)) AS k)), (VALUES ('none'), ('area'), ('bandwidth')) v(norm) WHERE band IN (2, 4, 9))
SELECT vec_id, band, norm, round(sum(weight * e[bin + 1]), 6) + 0.0 AS energy FROM w, ({_E}) GROUP BY 1, 2, 3"""
)
def triangular_bank(spark, sf_dir):
    """The first five values of each vector, as a spectrum, through a bank of triangles in three normalisations."""
    banks = {n: signal.triangular_filterbank(np.arange(12) * 100.0, 8, 2000, n) for n in ("none", "area", "bandwidth")}
    e = F.col("e")
    cells = [F.struct(F.lit(b).cast("long").alias("band"), F.lit(n).alias("norm"), sum((e[k] * F.lit(float(bank[b, k])) for k in range(5)), F.lit(0.0)).alias("energy")) for n, bank in banks.items() for b in (2, 4, 9)]
    return embeddings(spark, sf_dir).select("vec_id", F.inline(F.array(*cells))).select("vec_id", "band", "norm", r6(F.col("energy")).alias("energy"))


def sounds(spark, sf_dir, rate: int, n: int, shape) -> DataFrame:
    """A clip for each supplier: ``shape`` of the sample number and the supplier's key.

    Suppliers are few bytes in one file and their clips are many, so keys are dealt to tasks before clips are made.
    """
    tasks = max(32, 4 * spark.sparkContext.defaultParallelism)
    keys = table(spark, sf_dir, "supplier").select("s_suppkey").repartition(tasks, "s_suppkey")
    i = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: shape(k.cast("double"), F.col("s_suppkey")))
    return keys.select(F.col("s_suppkey").cast("string").alias("path"), F.lit(rate).alias("sr"), i.alias("samples"))


@query("SELECT s_suppkey, 1.0::double AS gain FROM supplier")
def gammatone_gain(spark, sf_dir):
    """A gammatone filter at a frequency of each supplier's key passes it as it is."""
    tone = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 2900 + 100).cast("double").alias("f"))

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            z = np.exp(-2j * np.pi * b["f"].to_numpy() / 8000)[:, None]
            s = signal.gammatone_sections(b["f"].to_numpy(), 8000)
            gain = np.abs(np.prod((s[..., 0] + s[..., 1] * z + s[..., 2] * z**2) / (s[..., 3] + s[..., 4] * z + s[..., 5] * z**2), axis=1))
            yield pd.DataFrame({"s_suppkey": b["s_suppkey"], "gain": gain})

    return tone.mapInPandas(run, "s_suppkey long, gain double").select("s_suppkey", F.round("gain", 2).alias("gain"))


_METHODS = ("nfc", "cep", "lhs", "srh", "pef")


@query("SELECT s_suppkey, m AS method, true AS near FROM supplier, (SELECT unnest(['nfc', 'cep', 'lhs', 'srh', 'pef']) AS m)")
def pitch_methods(spark, sf_dir):
    """Every method finds the pitch of each supplier's sound, of ten harmonics, within three percent."""
    f0 = lambda key: F.lit(140.0) + 10 * (key % 5)
    voice = lambda i, key: sum((F.sin(2 * math.pi * h / 8000 * f0(key) * i) / h for h in range(1, 11)), F.lit(0.0))
    kernel = lambda x, rate: {m: float(np.median(signal.pitch(x, rate, m))) for m in _METHODS}
    out = signal.per_clip(sounds(spark, sf_dir, 8000, 2400, voice), kernel, "path string, " + ", ".join(f"{m} double" for m in _METHODS))
    long = out.select(F.col("path").cast("long").alias("s_suppkey"), F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("f0")) for m in _METHODS])).alias("x"))
    return long.select("s_suppkey", "x.method", (F.abs(F.col("x.f0") / f0(F.col("s_suppkey")) - 1) < 0.03).alias("near"))


@query("SELECT s_suppkey, s_suppkey % 2 = 0 AS harmonic, (s_suppkey % 2)::bigint AS masked FROM supplier")
def harmonic_ratios(spark, sf_dir):
    """Suppliers of even keys sound a tone, the others noise; the pitch of noise is masked."""

    def shape(i, key):
        noise = F.pmod(F.xxhash64(i, key), F.lit(2_000)) / 1_000.0 - 1
        return F.when(key % 2 == 0, F.sin(2 * math.pi / 8000 * (180 + key % 50) * i)).otherwise(noise)

    def kernel(x, rate):
        ratio = signal.harmonic_ratio(x, rate)
        f0 = signal.mask_pitch(np.full(len(ratio), 200.0), ratio)
        return {"harmonic": bool(np.median(ratio) > 0.95), "masked": int(np.isnan(f0).mean() > 0.5)}

    out = signal.per_clip(sounds(spark, sf_dir, 8000, 4000, shape), kernel, "path string, harmonic boolean, masked long")
    return out.select(F.col("path").cast("long").alias("s_suppkey"), "harmonic", "masked")


@query("SELECT s_suppkey, 1::bigint AS runs, true AS starts, true AS ends FROM supplier")
def speech_runs(spark, sf_dir):
    """Half a second of noise between two of near silence, later by the supplier's key."""
    begins = lambda key: 4000 + 200 * (key % 7)

    def shape(i, key):
        noise = F.pmod(F.xxhash64(i, key), F.lit(2_000)) / 1_000.0 - 1
        return F.when((i >= begins(key)) & (i < begins(key) + 4000), noise).otherwise(F.sin(i / 9) * 1e-3)

    def kernel(x, rate):
        found = signal.detect_speech(x, rate)
        return {"runs": len(found), "first": int(found[0][0]) if len(found) else -1, "last": int(found[0][1]) if len(found) else -1}

    out = signal.per_clip(sounds(spark, sf_dir, 8000, 14_000, shape), kernel, "path string, runs long, first long, last long").withColumn("s_suppkey", F.col("path").cast("long"))
    at = begins(F.col("s_suppkey"))
    return out.select("s_suppkey", "runs", (F.abs(F.col("first") - at) < 800).alias("starts"), (F.abs(F.col("last") - at - 4000) < 800).alias("ends"))


_WAVELETS = ("morse", "morlet", "bump")


@query("SELECT s_suppkey, w AS wavelet, true AS near FROM supplier, (SELECT unnest(['morse', 'morlet', 'bump']) AS w)")
def wavelet_peaks(spark, sf_dir):
    """The band with the largest coefficients is that of each supplier's tone, within half a step of the bands."""
    f0 = lambda key: 16.0 + key % 9

    def kernel(x, rate):
        out = {}
        for kind in _WAVELETS:
            bank, freqs = signal.kept_wavelet_bank(kind, len(x), rate)
            out[kind] = float(freqs[np.abs(signal.wavelet_transform(x, bank))[:, 100:-100].mean(1).argmax()])
        return out

    out = signal.per_clip(sounds(spark, sf_dir, 256, 512, lambda i, key: F.sin(2 * math.pi / 256 * f0(key) * i)), kernel, "path string, morse double, morlet double, bump double")
    long = out.select(F.col("path").cast("long").alias("s_suppkey"), F.explode(F.array(*[F.struct(F.lit(k).alias("wavelet"), F.col(k).alias("f")) for k in _WAVELETS])).alias("x"))
    return long.select("s_suppkey", "x.wavelet", (F.abs(F.log2(F.col("x.f") / f0(F.col("s_suppkey")))) < 0.08).alias("near"))


# -- models --------------------------------------------------------------------------------------------


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS rule, '{c}' AS consequent, count(*) FILTER (WHERE {w}) AS ncovered FROM lineitem"
        for k, w, c in (
            ("l_quantity < 24.0", "l_quantity < 24", "A"), ("l_quantity ≥ 24.0", "l_quantity >= 24", "R"), ("l_discount ≥ 0.05", "l_discount >= 0.05", "N"), ("l_discount < 0.05", "l_discount < 0.05", "A"),
            ("l_tax ≤ 0.03", "l_tax <= 0.03", "R"), ("l_tax > 0.03", "l_tax > 0.03", "N"),
        )
    )
)
def union_of_rules(spark, sf_dir):
    """What the distinct rules of all trees cover, one of which occurs twice, and those of a branch alone."""
    found = models.union_rules(Ensemble((STUMPS[0], STUMPS[1], STUMPS[0]))) + models.immediate_rules(STUMPS[2].root)
    return rules.rule_metrics(lineitem(spark, sf_dir), found, "l_returnflag").select("rule", "consequent", "ncovered")


def _cut(df: DataFrame) -> float:
    return float(df.agg(F.percentile_approx("l_quantity", 0.5, 10_000_000)).first()[0])


_TEXT_SQL = [
    ("rule", 1, "'l_quantity < ' || q || '0 ↣ A'"), ("rule", 2, "'l_quantity ≥ ' || q || '0 ↣ R'"), ("tree", 1, "'l_quantity < ' || q || '  [' || n || ' rows]'"), ("tree", 2, "'✔ A  [' || n || ' rows]'"), ("tree", 3, "'✘ R  [' || n || ' rows]'"),
    ("ensemble", 1, "'ensemble of 2 trees'"), ("ensemble", 2, "'[1/2] (w 1) l_quantity < ' || q"), ("ensemble", 3, "'✔ A'"), ("ensemble", 4, "'✘ R'"), ("ensemble", 5, "'[2/2] (w 0.5) l_tax < 0.1'"), ("ensemble", 6, "'✔ A'"), ("ensemble", 7, "'✘ N'"),
    ("list", 1, "'list of 2 rules'"), ("list", 2, "'[1/2] l_quantity < 10.0  ↣  A'"), ("list", 3, "'[2/2] l_tax ≥ 0.05  ↣  R'"), ("list", 4, "'else N'"), ("constant", 1, "'A'"), ("shallow", 1, "'…'"),
]


@query(
    "WITH m AS (SELECT quantile_disc(l_quantity, 0.5)::double::varchar AS q, count(*)::varchar AS n FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{k}' AS model, {i}::bigint AS line, {t} AS text FROM m" for k, i, t in _TEXT_SQL)
)
def model_texts(spark, sf_dir):
    """Models as text, line by line, with a threshold and a note from the data: rules, trees, lists, ensembles, a leaf, and a tree cut at its root."""
    df = lineitem(spark, sf_dir)
    stump, n = Tree(Branch(ScalarCondition("l_quantity", "<", _cut(df)), Leaf("A"), Leaf("R"))), df.count()
    ensemble = Ensemble((stump, Tree(Branch(ScalarCondition("l_tax", "<", 0.1), Leaf("A"), Leaf("N")))), (1.0, 0.5))
    texts = {
        "rule": models.rules_text(models.list_rules(stump)), "tree": models.describe(stump, metrics=lambda m: f"{n} rows"), "list": models.describe(coverage._LIST), "ensemble": models.describe(ensemble),
        "constant": models.describe(Leaf("A")), "shallow": models.describe(TREE, depth=0),
    }
    return spark.createDataFrame([(k, i, line.strip()) for k, t in texts.items() for i, line in enumerate(t.split("\n"), 1)], "model string, line long, text string")


@query(
    f"SELECT 'tree' AS model, 1::bigint AS submodels, 5::bigint AS leaves, 3::bigint AS height, true AS complete, count(*) FILTER (WHERE {TREE_SQL} = 'A') AS n FROM lineitem UNION ALL SELECT 'list', 3, 3, 1, true, count(*) FILTER (WHERE l_quantity < 10) FROM lineitem "
    "UNION ALL SELECT 'rule', 1, 1, 1, false, count(*) FILTER (WHERE l_quantity < 10) FROM lineitem UNION ALL SELECT 'leaf', 0, 1, 0, true, count(*) FROM lineitem "
    f"UNION ALL SELECT 'ensemble', 1, 2, 1, true, count(*) FILTER (WHERE {STUMPS_SQL[0]} = 'A') FROM lineitem"
)
def model_measures(spark, sf_dir):
    """Sizes of models, and how many rows each of them gives the first class."""
    given = {"tree": TREE, "rule": coverage._LIST.rules[0], "list": coverage._LIST, "ensemble": Ensemble((STUMPS[0],)), "leaf": Leaf("A")}
    df, out = lineitem(spark, sf_dir), None
    for k, m in given.items():
        sizes = [F.lit(v).cast("long").alias(n) for n, v in (("submodels", len(models.submodels(m))), ("leaves", len(models.leaves(m))), ("height", models.height(m)))]
        part = models.apply_model(df, m).agg(F.count_if(F.col("prediction") == "A").alias("n")).select(F.lit(k).alias("model"), *sizes, F.lit(models.is_complete(m)).alias("complete"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "WITH m AS (SELECT quantile_disc(l_quantity, 0.5)::double AS q FROM lineitem), t AS (SELECT * FROM (VALUES (0, -1, false, 'l_quantity', '<', 1, 2, ''), (1, 0, true, '', '', -1, -1, 'A'), (2, 0, false, 'l_tax', '<', 3, 4, ''), (3, 2, true, '', '', -1, -1, 'N'), (4, 2, true, '', '', -1, -1, 'R')) v(node_id, parent_id, is_leaf, feature, op, pos_child, neg_child, outcome)) "
    "SELECT node_id::bigint AS node_id, parent_id::bigint AS parent_id, is_leaf, feature, op, CASE feature WHEN 'l_quantity' THEN q WHEN 'l_tax' THEN 0.04::double ELSE 0 END AS threshold, pos_child::bigint AS pos_child, neg_child::bigint AS neg_child, outcome, "
    "CASE node_id WHEN 0 THEN (SELECT count(*) FROM lineitem) WHEN 1 THEN (SELECT count(*) FROM lineitem WHERE l_quantity < q) WHEN 2 THEN (SELECT count(*) FROM lineitem WHERE l_quantity >= q) "
    "WHEN 3 THEN (SELECT count(*) FROM lineitem WHERE l_quantity >= q AND l_tax < 0.04) ELSE (SELECT count(*) FROM lineitem WHERE l_quantity >= q AND l_tax >= 0.04) END AS reached FROM t, m"
)
def model_nodes(spark, sf_dir):
    """A tree with a threshold from the data in its relational form, to and fro, and the rows that reach each node; nulls as -1, 0 or the empty text."""
    df = lineitem(spark, sf_dir)
    tree = Tree(Branch(ScalarCondition("l_quantity", "<", _cut(df)), Leaf("A"), Branch(ScalarCondition("l_tax", "<", 0.04), Leaf("N"), Leaf("R"))))
    there = models.to_table(spark, tree, "fixed")
    back = models.to_table(spark, models.from_table(there), "again")
    paths = F.element_at(F.create_map(*[F.lit(x) for pair in (("", 0), ("p", 1), ("n", 2), ("np", 3), ("nn", 4)) for x in pair]), F.col("path"))
    reached = models.node_supports(df, tree, "l_returnflag").groupBy(paths.alias("of_node")).agg(F.sum("n").alias("reached"))
    whole = [F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("node_id", "parent_id", "pos_child", "neg_child")]
    out = back.join(reached, F.col("node_id") == F.col("of_node"))
    return out.select(*whole, "is_leaf", F.coalesce("threshold", F.lit(0.0)).alias("threshold"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("feature", "op", "outcome")], "reached")


_TARGETS = {"l_returnflag": "lineitem", "l_linestatus": "lineitem", "o_orderpriority": "orders", "p_brand": "part", "r_name": "region"}


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS target, count(DISTINCT {c}) AS classes, CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary:logistic' ELSE 'multi:softprob' END AS objective FROM {t}" for c, t in _TARGETS.items())
    + " UNION ALL SELECT 'l_extendedprice', -1, 'reg:squarederror' FROM region WHERE r_regionkey = 0"
)
def boost_options(spark, sf_dir):
    """The objective follows the number of classes of each target; options out of range are refused."""
    bad = {"rounds": 0, "eta": 1.5, "depth": -1, "reg_lambda": -1, "bins": 1, "objective": "none"}
    if not all(coverage.raises(lambda k=k, v=v: boosting.BoostOptions(**{k: v}), ValueError) for k, v in bad.items()):
        raise AssertionError("an option out of range is accepted")
    rows = []
    for c, t in _TARGETS.items():
        n = table(spark, sf_dir, t).agg(F.count_distinct(c)).first()[0]
        rows.append((c, n, boosting.BoostOptions(objective=boosting.default_objective(n)).objective))
    return spark.createDataFrame([*rows, ("l_extendedprice", -1, boosting.default_objective(None))], "target string, classes long, objective string")


@query(
    "WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_quantity < 24) AS low FROM lineitem) SELECT 'l_quantity' AS feature, 0.4::double AS share, n AS rows FROM c UNION ALL SELECT 'l_discount', 0.2, low FROM c UNION ALL SELECT 'l_extendedprice', 0.2, n - low FROM c "
    "UNION ALL SELECT 'l_tax', 0.2, (SELECT count(*) FROM lineitem WHERE l_quantity >= 24 AND l_extendedprice >= 60000)"
)
def split_importances(spark, sf_dir):
    """Shares of the splits that test each feature, in order, and the rows that meet such a split in the first tree."""
    shares = boosting.split_importance(Ensemble((TREE, STUMPS[0])))
    supports = models.node_supports(lineitem(spark, sf_dir), TREE, "l_returnflag")
    tested = F.element_at(F.create_map(*[F.lit(x) for pair in (("", "l_quantity"), ("p", "l_discount"), ("n", "l_extendedprice"), ("nn", "l_tax")) for x in pair]), F.col("path"))
    met = supports.where(F.col("path").isin("", "p", "n", "nn")).groupBy(tested.alias("feature")).agg(F.sum("n").alias("rows"))
    return spark.createDataFrame(list(shares.items()), "feature string, share double").join(met, "feature")


# -- measures and tuning -----------------------------------------------------------------------------


@query(
    f"SELECT 'accuracy' AS measure, 'deterministic' AS kind, 'predict' AS operation, round(avg((l_returnflag = {TREE_SQL})::int::double), 6) AS value FROM lineitem UNION ALL "
    "SELECT 'accuracy', 'probabilistic', 'predict_mode', round(avg((l_linestatus = CASE WHEN l_quantity > 25.5 THEN 'O' ELSE 'F' END)::int::double), 6) FROM lineitem UNION ALL "
    "SELECT 'log_loss', 'probabilistic', 'predict', round(avg(-ln(least(greatest(CASE WHEN l_linestatus = 'O' THEN l_quantity / 51 ELSE 1 - l_quantity / 51 END, 2.22e-16), 1 - 2.22e-16))), 6) FROM lineitem UNION ALL "
    "SELECT 'rms', 'probabilistic', 'predict_mean', round(sqrt(avg(power(l_discount * 10 - l_quantity / 51, 2))), 6) FROM lineitem UNION ALL SELECT 'log_loss', 'deterministic', 'error', NULL FROM region WHERE r_regionkey = 0"
)
def operations(spark, sf_dir):
    """What a measure takes of a prediction (itself, its mode or its mean), and the measure of that over all rows."""
    df = models.apply_model(lineitem(spark, sf_dir), TREE)
    p = F.array(F.lit(1.0) - F.col("l_quantity") / 51, F.col("l_quantity") / 51)  # of F and O
    taken = {
        "predict": lambda c: c,
        "predict_mode": lambda c: F.when(F.get(c, F.lit(1)) > F.get(c, F.lit(0)), "O").otherwise("F"),
        "predict_mean": lambda c: F.get(c, F.lit(1)),
    }
    rows = []
    for measure, kind in (("accuracy", "deterministic"), ("accuracy", "probabilistic"), ("log_loss", "probabilistic"), ("log_loss", "deterministic"), ("rms", "probabilistic")):
        if coverage.raises(lambda m=measure, k=kind: evaluation.operation_for(m, k), ValueError):
            rows.append((measure, kind, "error", None))
            continue
        how = evaluation.operation_for(measure, kind)
        label = F.col("l_discount") * 10 if measure == "rms" else F.col("l_returnflag" if kind == "deterministic" else "l_linestatus")
        given = F.col("prediction") if kind == "deterministic" else taken[how](p)
        columns = [F.lit(0).alias("fold"), label.alias("label")]
        shown = df.select(*columns, *((F.lit("O").alias("prediction"), given.alias("probabilities")) if measure == "log_loss" else (given.alias("prediction"),)))
        value = evaluation.evaluate(shown, [measure], classes=["F", "O"]).where("fold = 0").first()["value"]
        rows.append((measure, kind, how, float(value)))
    return spark.createDataFrame(rows, "measure string, kind string, operation string, value double").select("measure", "kind", "operation", r6(F.col("value")).alias("value"))


@query(
    "WITH m AS (SELECT min(l_quantity)::double AS lo, max(l_quantity)::double AS hi, max(l_linenumber)::double AS k FROM lineitem) SELECT 'linear' AS name, i AS place, round(lo + (hi - lo) * i / 2, 6) AS value FROM m, (SELECT unnest(range(3)) AS i) UNION ALL "
    "SELECT 'log10', i, round(power(10, log10(lo) + (log10(hi) - log10(lo)) * i / 2), 6) FROM m, (SELECT unnest(range(3)) AS i) UNION ALL SELECT 'whole', i, 1 + (k - 1) * i / 2 FROM m, (SELECT unnest(range(3)) AS i) UNION ALL SELECT 'values', i, CASE i WHEN 0 THEN lo ELSE hi END FROM m, (SELECT unnest(range(2)) AS i)"
)
def parameter_ranges(spark, sf_dir):
    """Grids of parameters between bounds of the data: even steps, even ratios, whole numbers and given values."""
    m = lineitem(spark, sf_dir).agg(F.min("l_quantity").cast("double").alias("lo"), F.max("l_quantity").cast("double").alias("hi"), F.max("l_linenumber").alias("k")).first()
    ranges = [evaluation.Range("linear", m["lo"], m["hi"]), evaluation.Range("log10", m["lo"], m["hi"], "log10"), evaluation.Range("whole", 1, int(m["k"])), evaluation.Range("values", values=(m["lo"], m["hi"]))]
    rows = [(r.name, i, float(v)) for r in ranges for i, v in enumerate(r.grid(3))]
    return spark.createDataFrame(rows, "name string, place long, value double").select("name", "place", r6(F.col("value")).alias("value"))


@query(
    "SELECT s AS strategy, true AS near, n AS tried, round((SELECT avg(l_quantity) FROM lineitem), 6) AS optimum FROM (VALUES ('grid', 51::bigint), ('random', 60), ('latin_hypercube', 60), ('tree_parzen', 60), ('particle_swarm', 60), ('adaptive_swarm', 60)) v(s, n)"
)
def tuning_strategies(spark, sf_dir):
    """Every strategy comes near the number that has the least squares from all quantities, within its number of candidates."""
    m = lineitem(spark, sf_dir).agg(F.avg("l_quantity").cast("double").alias("mean"), F.min("l_quantity").cast("double").alias("lo"), F.max("l_quantity").cast("double").alias("hi"), F.var_pop("l_quantity").cast("double").alias("spread")).first()
    rows = []
    for s in evaluation.Tuning.STRATEGIES:
        best, history = evaluation.tune(lambda p: (p["x"] - m["mean"]) ** 2 + m["spread"], [evaluation.Range("x", m["lo"], m["hi"])], evaluation.Tuning(s, resolution=51, n=60))
        rows.append((s, abs(best["x"] - m["mean"]) < (m["hi"] - m["lo"]) / 20, len(history), m["mean"]))
    return spark.createDataFrame(rows, "strategy string, near boolean, tried long, optimum double").withColumn("optimum", r6(F.col("optimum")))


@query(
    "SELECT 'unknown model' AS given, 'ValueError' AS error, -1::bigint AS classes FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'unknown parameter', 'TypeError', -1 FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'number for classes', 'TypeError', -1 FROM region WHERE r_regionkey = 0 "
    "UNION ALL SELECT 'known', 'none', count(DISTINCT o_orderkey % 3) FROM orders"
)
def model_registry(spark, sf_dir):
    """Learners by name: what does not fit is refused, and one that does learns the classes of the orders."""
    df = orders(spark, sf_dir).select((F.col("o_orderkey") % 3).cast("double").alias("x"), (F.col("o_orderkey") % 3).cast("string").alias("label"), "o_totalprice")
    asked = {
        "unknown model": lambda: evaluation.make_learner("nothing"), "unknown parameter": lambda: evaluation.make_learner("decision_tree", speed=1),
        "number for classes": lambda: evaluation.make_learner("stump_boosting")(df, ["x"], "o_totalprice", True), "known": lambda: evaluation.make_learner("decision_tree", max_depth=2)(df, ["x"], "label", False),
    }

    def named(f) -> tuple[str, int]:
        try:
            found = f()
        except (ValueError, TypeError) as e:
            return type(e).__name__, -1
        return "none", models.apply_model(df, found).select("prediction").distinct().count()

    return spark.createDataFrame([(k, *named(f)) for k, f in asked.items()], "given string, error string, classes long")

