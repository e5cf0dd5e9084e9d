"""Rule metrics, filters, pruning, selection, and learners of rule lists.

All rules are measured in one pass: each rule contributes a few conditional sums to a single
aggregate, so the data are read once however many rules there are.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boosting import quantile_cuts
from .conditions import And, Formula, ScalarCondition, Truth, conjunction
from .models import DecisionList, Ensemble, Leaf, Model, Rule, list_rules, union_rules

METRICS = "rule_id int, rule string, consequent string, natoms int, ninstances long, ncovered long, coverage double, confidence double, lift double, error double"
#: Rules measured in one aggregate; more are measured in several passes.
RULES_PER_PASS = 200


def _holds(f: Formula) -> Column:
    return F.coalesce(f.column(), F.lit(False))


def _atoms(f: Formula) -> list[Formula]:
    return [] if isinstance(f, Truth) else list(f.parts) if isinstance(f, And) else [f]


def measure(df: DataFrame, rules: list[Rule], label: str) -> list[dict]:
    """ninstances, ncovered, coverage, confidence, lift, error and natoms of every rule.

    coverage = covered / all; confidence = covered with the rule's label / covered;
    lift = confidence / share of that label; error = 1 - confidence. Confidence, lift and
    error of a rule that covers nothing are None.
    """
    found: list[dict] = []
    for lo in range(0, len(rules), RULES_PER_PASS):
        part = rules[lo : lo + RULES_PER_PASS]
        sums = [F.count("*").alias("n")]
        for i, r in enumerate(part):
            same = F.col(label).cast("string") == F.lit(str(r.consequent.outcome))
            sums += [F.count_if(_holds(r.antecedent)).alias(f"c{i}"), F.count_if(_holds(r.antecedent) & same).alias(f"h{i}"), F.count_if(same).alias(f"y{i}")]
        row = df.agg(*sums).first()
        for i, r in enumerate(part):
            n, c, h, y = row["n"], row[f"c{i}"], row[f"h{i}"], row[f"y{i}"]
            confidence = h / c if c else None
            found.append(
                {
                    "rule_id": lo + i, "rule": str(r.antecedent), "consequent": str(r.consequent.outcome), "natoms": len(_atoms(r.antecedent)), "ninstances": n, "ncovered": c,
                    "coverage": c / n if n else 0.0, "confidence": confidence, "lift": confidence / (y / n) if c and y else None, "error": None if confidence is None else 1 - confidence,
                }
            )
    return found


def rule_metrics(df: DataFrame, rules: list[Rule], label: str) -> DataFrame:
    """The metrics of ``measure`` as one lazy query: a row for each rule.

    The sums are one aggregate over ``df``; the rules' rows are taken from it by a stack.
    """
    sums = [F.count("*").alias("n")]
    for i, r in enumerate(rules):
        same = F.col(label).cast("string") == F.lit(str(r.consequent.outcome))
        held = _holds(r.antecedent)
        sums.append(F.struct(F.count_if(held).alias("c"), F.count_if(held & same).alias("h"), F.count_if(same).alias("y")).alias(f"r{i}"))
    heads = [F.struct(F.lit(i).alias("rule_id"), F.lit(str(r.antecedent)).alias("rule"), F.lit(str(r.consequent.outcome)).alias("consequent"), F.lit(len(_atoms(r.antecedent))).alias("natoms"), F.col(f"r{i}").alias("s")) for i, r in enumerate(rules)]
    rows = df.agg(*sums).select("n", F.explode(F.array(*heads)).alias("x")).select("n", "x.*").select("*", "s.*")
    confidence = F.try_divide("h", "c")
    return rows.select(
        "rule_id", "rule", "consequent", "natoms", F.col("n").alias("ninstances"), F.col("c").alias("ncovered"), F.coalesce(F.try_divide("c", "n"), F.lit(0.0)).alias("coverage"),
        confidence.alias("confidence"), F.try_divide(confidence, F.try_divide("y", "n")).alias("lift"), (1 - confidence).alias("error"),
    )


def filter_rules(
    metrics: DataFrame, min_coverage=None, min_ncovered=None, min_ninstances=None, min_confidence=None, min_lift=None, keep: Callable[[DataFrame], Column] | None = None
) -> DataFrame:
    """Rows of a metrics table that reach every bound given; ``keep`` adds a condition of its own."""
    bounds = {"coverage": min_coverage, "ncovered": min_ncovered, "ninstances": min_ninstances, "confidence": min_confidence, "lift": min_lift}
    conditions = [F.col(k) >= v for k, v in bounds.items() if v is not None]
    if keep is not None:
        conditions.append(keep(metrics))
    return metrics.where(functools.reduce(operator.and_, conditions)) if conditions else metrics


def ordered(metrics: DataFrame, by: tuple[str, ...], descending: tuple[bool, ...], most: int = -1) -> DataFrame:
    """A metrics table (a row for each rule) with the rank of each by several columns, from 1; at most ``most`` rows if above 0."""
    keys = [F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in zip(by, descending, strict=True)]
    out = metrics.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)))
    return out.where(F.col("rank") <= most) if most > 0 else out


@dataclass(frozen=True)
class ExtractorOptions:
    """Parameters of the extraction of a rule list from an ensemble."""

    prune: bool = True
    prune_s: float = 1e-6
    prune_decay: float = 0.05
    selector: str | None = "cbc"  # or "cfs", or None
    importance: float = 0.01
    max_rules: int = -1
    min_coverage: float = 0.01
    error_descending: bool = False
    seed: int = 1

    def __post_init__(self):
        if self.selector not in ("cbc", "cfs", None):
            raise ValueError(f"unknown selector {self.selector!r}")
        if not 0 <= self.min_coverage <= 1 or self.prune_s <= 0:
            raise ValueError("min_coverage lies in [0, 1] and prune_s above 0")


def prune(df: DataFrame, rules: list[Rule], label: str, s: float = 1e-6, decay: float = 0.05) -> list[Rule]:
    """Drops conjuncts, the last first, while (error without - error) / max(error, s) < decay.

    Each round measures, for all rules at once, the rule and what is left without its next
    conjunct; there are at most as many rounds as the longest rule has conjuncts. A rule of one
    conjunct keeps it.
    """
    out = list(rules)
    at = [len(_atoms(r.antecedent)) - 1 for r in out]
    while any(k >= 0 and len(_atoms(r.antecedent)) > 1 for k, r in zip(at, out, strict=True)):
        tried = [i for i, k in enumerate(at) if k >= 0 and len(_atoms(out[i].antecedent)) > 1]
        shorter = [Rule(conjunction(a for j, a in enumerate(_atoms(out[i].antecedent)) if j != at[i]), out[i].consequent) for i in tried]
        scores = measure(df, [out[i] for i in tried] + shorter, label)
        for k, i in enumerate(tried):
            e, without = (1.0 if m["error"] is None else m["error"] for m in (scores[k], scores[len(tried) + k]))
            if (without - e) / max(e, s) < decay:
                out[i] = shorter[k]
            at[i] -= 1
    return list({(str(r.antecedent), str(r.consequent)): r for r in out}.values())


def _mask_table(df: DataFrame, rules: list[Rule], label: str) -> DataFrame:
    return df.select(F.col(label).cast("string").alias("_label"), *[_holds(r.antecedent).cast("double").alias(f"m{i}") for i, r in enumerate(rules)])


def importances(df: DataFrame, rules: list[Rule], label: str, seed: int = 1) -> list[float]:
    """Impurity importance of each rule's mask in a forest of 50 trees on all masks."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    masks = _mask_table(df, rules, label)
    indexed = StringIndexer(inputCol="_label", outputCol="y", handleInvalid="skip", stringOrderType="alphabetAsc").fit(masks).transform(masks)
    rows = VectorAssembler(inputCols=[f"m{i}" for i in range(len(rules))], outputCol="x").transform(indexed)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=50, subsamplingRate=0.7, featureSubsetStrategy=str(min(2, len(rules))), seed=seed)
    found = forest.fit(rows).featureImportances.toArray()
    return [float(v) / (found.max() or 1.0) for v in found]


def symmetric_uncertainty(pairs: dict[tuple, int]) -> float:
    """2 * (H(x) + H(y) - H(x, y)) / (H(x) + H(y)) of joint counts; 0 if both are constant."""
    total = sum(pairs.values())
    sides: tuple[dict, dict] = ({}, {})
    for (a, b), n in pairs.items():
        sides[0][a] = sides[0].get(a, 0) + n
        sides[1][b] = sides[1].get(b, 0) + n
    entropy = lambda counts: -sum(n / total * math.log2(n / total) for n in counts.values() if n)
    hx, hy, hxy = entropy(sides[0]), entropy(sides[1]), entropy(pairs)
    return 2 * (hx + hy - hxy) / (hx + hy) if hx + hy > 0 else 0.0


def correlation_selection(df: DataFrame, rules: list[Rule], label: str, patience: int = 5) -> list[int]:
    """Greedy forward selection of rule masks by merit = r_cf / sqrt(k + 2 r_ff).

    r_cf sums the symmetric uncertainties with the label, r_ff those of all pairs chosen;
    stops after ``patience`` steps without a higher merit. The pairs of a chosen rule are counted
    when it is chosen, in one aggregate.
    """
    masks = [_holds(r.antecedent) for r in rules]
    y = F.col(label).cast("string")
    rows = df.where(y.isNotNull())
    classes = [r[0] for r in rows.select(y).distinct().orderBy(y).collect()]  # one row for each class
    total = rows.groupBy(y.alias("y")).agg(*[F.count_if(m).alias(f"m{i}") for i, m in enumerate(masks)], F.count("*").alias("n")).collect()
    by_class = {r["y"]: r for r in total}
    n = sum(r["n"] for r in total)
    held = [sum(r[f"m{i}"] for r in total) for i in range(len(rules))]

    def table(both: int, a: int, b: int) -> dict[tuple, int]:
        return {k: v for k, v in {(1, 1): both, (1, 0): a - both, (0, 1): b - both, (0, 0): n - a - b + both}.items() if v}

    with_label = []
    for i in range(len(rules)):
        joint = {(v, c): by_class[c][f"m{i}"] if v else by_class[c]["n"] - by_class[c][f"m{i}"] for c in classes for v in (0, 1)}
        with_label.append(symmetric_uncertainty({k: v for k, v in joint.items() if v}))
    with_rule: dict[int, list[float]] = {}

    def counted(j: int) -> None:
        """The symmetric uncertainty of rule j with every rule, from one aggregate for each pass."""
        both: list[int] = []
        for lo in range(0, len(rules), RULES_PER_PASS):
            both += list(rows.agg(*[F.count_if(masks[j] & m).alias(f"m{i}") for i, m in enumerate(masks[lo : lo + RULES_PER_PASS])]).first())
        with_rule[j] = [symmetric_uncertainty(table(b, held[i], held[j])) for i, b in enumerate(both)]

    def su(i: int, j: int) -> float:
        return with_label[i] if j < 0 else with_rule[j][i] if j in with_rule else with_rule[i][j]

    chosen: list[int] = []
    best, kept, stale = -math.inf, [], 0
    while len(chosen) < len(rules) and stale < patience:

        def merit(i: int) -> float:
            s = [*chosen, i]
            r_ff = sum(su(min(a, b), max(a, b)) for k, a in enumerate(s) for b in s[:k])
            return sum(su(a, -1) for a in s) / math.sqrt(len(s) + 2 * r_ff)

        pick = max((i for i in range(len(rules)) if i not in chosen), key=lambda i: (merit(i), -i))
        value = merit(pick)
        chosen.append(pick)
        counted(pick)
        if value > best:
            best, kept, stale = value, list(chosen), 0
        else:
            stale += 1
    return kept


def select(df: DataFrame, rules: list[Rule], label: str, options: ExtractorOptions) -> list[Rule]:
    """Rules that matter, ordered by (importance, error, length), at most ``max_rules``."""
    if options.selector is None or not rules:
        return rules
    scores = measure(df, rules, label)
    if options.selector == "cfs":
        weight = dict.fromkeys(correlation_selection(df, rules, label), 1.0)
    else:
        weight = {i: w for i, w in enumerate(importances(df, rules, label, options.seed)) if w > options.importance}
    sign = -1 if options.error_descending else 1
    order = sorted(weight, key=lambda i: (-weight[i], sign * (1.0 if scores[i]["error"] is None else scores[i]["error"]), sign * scores[i]["natoms"], i))
    return [rules[i] for i in (order[: options.max_rules] if options.max_rules > 0 else order)]


def sequential_list(df: DataFrame, rules: list[Rule], label: str, max_rules: int = -1, min_coverage: float = 0.01) -> DecisionList:
    """A decision list built from ``rules`` by covering.

    Each round measures the rules on the rows that are still uncovered, appends the best by
    (error, coverage descending, length), and excludes what it covers, by a filter and not a
    copy. It ends when no rule covers ``min_coverage`` of all rows, none beats the default's
    error, or ``max_rules`` are used. The default is the most frequent label left.
    """
    n_all = df.count()
    chosen: list[Rule] = []
    left = df
    pool = list(rules)
    while True:
        rows = {r["_l"]: r["count"] for r in left.groupBy(F.col(label).cast("string").alias("_l")).count().collect() if r["_l"] is not None}
        if not rows:
            counts = df.groupBy(F.col(label).cast("string").alias("_l")).count().orderBy(F.desc("count"), "_l").where("_l is not null").first()
            return DecisionList(tuple(chosen), Leaf(counts["_l"] if counts else None))
        default = min(rows, key=lambda k: (-rows[k], k))
        default_error = 1 - rows[default] / sum(rows.values())
        if not pool or (0 < max_rules <= len(chosen)):
            return DecisionList(tuple(chosen), Leaf(default))
        able = [m for m in measure(left, pool, label) if m["ncovered"] and m["ncovered"] >= min_coverage * n_all]
        best = min(able, key=lambda m: (m["error"], -m["ncovered"], m["natoms"], m["rule_id"]), default=None)
        if best is None or best["error"] >= default_error:
            return DecisionList(tuple(chosen), Leaf(default))
        rule = pool.pop(best["rule_id"])
        chosen.append(rule)
        left = left.where(~_holds(rule.antecedent))


def extract(df: DataFrame, model: Model, label: str, options: ExtractorOptions | None = None) -> DecisionList:
    """Rules of a model, pruned and selected against ``df``, as a sequential list."""
    o = options or ExtractorOptions()
    rules = union_rules(model) if isinstance(model, Ensemble) else list_rules(model)
    rules = [r for r in rules if not isinstance(r.antecedent, Truth)]
    if o.prune:
        rules = prune(df, rules, label, o.prune_s, o.prune_decay)
    rules = select(df, rules, label, replace(o))
    return sequential_list(df, rules, label, o.max_rules, o.min_coverage)


@dataclass(frozen=True)
class CoveringOptions:
    """Parameters of the covering learner."""

    beam: int = 3
    max_atoms: int = 3
    thresholds: int = 8
    min_covered: int = 1
    max_rules: int = 20
    measure: str = "laplace"  # or "entropy"


def learn_covering(df: DataFrame, features: list[str], label: str, options: CoveringOptions | None = None) -> DecisionList:
    """An ordered rule list by beam search over conjunctions of threshold atoms.

    Thresholds are approximate quantiles of all rows (the discretised domain). Each level of the beam
    is one aggregate that counts the labels under all candidates. A rule's quality is the
    Laplace accuracy (n_c + 1) / (n + K), or the negative entropy of its labels.
    """
    o = options or CoveringOptions()
    classes = sorted(r[0] for r in df.select(F.col(label).cast("string")).where(F.col(label).isNotNull()).distinct().collect())
    left, rules = df, []

    def counts(rows: DataFrame, formulas: list[Formula]) -> list[list[int]]:
        sums = [F.count_if(_holds(f) & (F.col(label).cast("string") == c)).alias(f"s{i}_{k}") for i, f in enumerate(formulas) for k, c in enumerate(classes)]
        row = rows.agg(*sums).first()
        return [[row[f"s{i}_{k}"] for k in range(len(classes))] for i in range(len(formulas))]

    def quality(n: list[int]) -> float:
        total = sum(n)
        if o.measure == "laplace":
            return (max(n) + 1) / (total + len(classes))
        return sum(x / total * math.log2(x / total) for x in n if x) if total else -math.inf

    cuts = quantile_cuts(df, features, o.thresholds + 1)
    for _ in range(o.max_rules):
        whole = counts(left, [Truth(True)])[0]
        if sum(whole) == 0 or max(whole) == sum(whole):
            break
        atoms = [ScalarCondition(f, op, t) for f in features for t in sorted(set(cuts[f] or [])) for op in ("<", ">=")]
        beam: list[tuple[float, Formula, list[int]]] = [(quality(whole), Truth(True), whole)]
        best = beam[0]
        for _level in range(o.max_atoms):
            grown = list({str(g): g for _, f, _ in beam for a in atoms if a not in _atoms(f) for g in (conjunction([f, a]),)}.values())
            scored = [(quality(n), f, n) for lo in range(0, len(grown), RULES_PER_PASS) for f, n in zip(grown[lo : lo + RULES_PER_PASS], counts(left, grown[lo : lo + RULES_PER_PASS]), strict=True) if sum(n) >= o.min_covered]
            if not scored:
                break
            beam = sorted(scored, key=lambda x: (-x[0], -sum(x[2]), str(x[1])))[: o.beam]
            if beam[0][0] > best[0]:
                best = beam[0]
        if isinstance(best[1], Truth):
            break
        rules.append(Rule(best[1], Leaf(classes[best[2].index(max(best[2]))])))
        left = left.where(~_holds(best[1]))
    rest = counts(left, [Truth(True)])[0]
    rest = rest if sum(rest) else counts(df, [Truth(True)])[0]
    return DecisionList(tuple(rules), Leaf(classes[rest.index(max(rest))]))
