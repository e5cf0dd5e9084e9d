"""Tuning of classification trees whose candidates share their passes over the data.

All candidates are grown on all folds at once: a row is reduced to codes once, and a level of every
tree of every candidate and fold is one aggregate. One more aggregate counts the held-out rows that each
of them gets right. So a search costs as many passes as its deepest candidate has levels, however many
candidates there are.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from .conditions import ScalarCondition
from .modal_learning import Coded, _walk, grow
from .models import Branch, Tree


@dataclass(frozen=True)
class ScalarTest:
    """feature >= threshold."""

    feature: str
    op: str = ">="

    def condition(self, threshold: float) -> ScalarCondition:
        return ScalarCondition(self.feature, self.op, threshold)


def coded_scalars(df: DataFrame, features: list[str], label: str, row_id: str, bins: int = 32) -> Coded:
    """Rows reduced to the places of their values among up to ``bins`` exact quantiles; the caller unpersists ``rows``.

    Nulls and NaN pass no test. Rows without label are left out.
    """
    values = F.array(*[F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double")) for f in features])
    rows = df.where(F.col(label).isNotNull()).select(F.col(row_id).cast("string").alias("id"), F.col(label).cast("string").alias("y"), values.alias("u"))
    asked = exact_quantiles(rows.select(F.posexplode("u").alias("test", "u")), ["test"], "u", [i / bins for i in range(1, bins)], between=False)
    cuts: list[list[float]] = [[] for _ in features]
    for r in asked.collect():  # a row for each feature
        cuts[r["test"]] = sorted(set(r["q"]))
    classes = sorted(r[0] for r in rows.select("y").distinct().collect())
    code = F.zip_with("u", F.from_json(F.lit(json.dumps(cuts)), "array<array<double>>"), lambda u, c: F.coalesce(F.size(F.filter(c, lambda x: x <= u)), F.lit(0)).cast("short"))
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1 if classes else F.lit(0)
    return Coded(rows.select("id", place.cast("int").alias("y"), code.alias("code")).persist(), [ScalarTest(f) for f in features], cuts, classes)


def fold_of(folds: int):
    """The fold of a row, by a digest of its id."""
    return F.pmod(F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("long"), F.lit(folds))


@dataclass(frozen=True)
class Tuned:
    """The candidates' accuracies on held-out rows, the best candidate and its tree on all rows."""

    scores: list[float]
    best: dict
    tree: Tree


def tune_trees(df: DataFrame, features: list[str], label: str, row_id: str, candidates: list[dict], folds: int = 3, bins: int = 32, halving: bool = False) -> Tuned:
    """The candidate (``depth``, and ``least`` rows on a side) with the best accuracy over ``folds`` folds; of equal ones the first.

    With ``halving`` the first fold is scored for all, each further fold only for the better half
    of those that are left; what is left out keeps the accuracy it had.
    """
    if not candidates or folds < 2:
        raise ValueError("candidates, and two folds at least")
    data = coded_scalars(df, features, label, row_id, bins)
    try:
        right, rows, left = [0] * len(candidates), [0] * len(candidates), list(range(len(candidates)))
        for part in [[f] for f in range(folds)] if halving else [list(range(folds))]:
            for c, good, n in _scored(data, candidates, left, part, folds):
                right[c] += good
                rows[c] += n
            if halving:
                left = sorted(left, key=lambda c: (-right[c] / max(rows[c], 1), c))[: max(1, -(-len(left) // 2))]
        scores = [r / n if n else 0.0 for r, n in zip(right, rows, strict=True)]
        among = left if halving else range(len(candidates))
        best = candidates[min(among, key=lambda c: (-scores[c], c))]
        tree = grow(data, 1, best["depth"], least=best.get("least", 1.0))[0][0]
        return Tuned(scores, best, tree)
    finally:
        data.rows.unpersist()


def _scored(data: Coded, candidates: list[dict], chosen: list[int], parts: list[int], folds: int) -> list[tuple[int, int, int]]:
    """(candidate, rows it gets right, rows) for each chosen candidate and held-out fold."""
    jobs = [(c, f) for c in chosen for f in parts]
    weight = F.array(*[(fold_of(folds) != f).cast("double") for _, f in jobs])
    depths = [candidates[c]["depth"] for c, _ in jobs]
    trees, splits = grow(data, len(jobs), depths, weight, least=[float(candidates[c].get("least", 1.0)) for c, _ in jobs])
    if not data.classes:
        return [(c, 0, 0) for c, _ in jobs]
    deepest = max(max(depths), 1)
    most = 2 ** (deepest + 1)
    lookup = F.from_json(F.lit(json.dumps({str(t * most + n): {"test": s[0], "place": s[1]} for (t, n), s in splits.items() if s[1] is not None})), "map<string,struct<test:int,place:int>>")
    says = {}

    def leaves(t: int, n: int, m) -> None:
        if isinstance(m, Branch):
            leaves(t, 2 * n, m.positive)
            leaves(t, 2 * n + 1, m.negative)
        else:
            says[str(t * most + n)] = data.classes.index(m.outcome)

    for t, tree in enumerate(trees):
        leaves(t, 1, tree.root)
    outcome = F.from_json(F.lit(json.dumps(says)), "map<string,int>")
    held = F.array(*[fold_of(folds) == f for _, f in jobs])
    asked = data.rows.select("y", "code", F.posexplode(held).alias("tree", "held")).where("held")
    node = F.aggregate(F.array_repeat(F.lit(0), deepest), F.lit(1), _walk(lookup, most))
    said = F.try_element_at(outcome, (F.col("tree") * most + F.col("node")).cast("string"))
    counted = asked.select("y", "tree", node.alias("node")).groupBy("tree").agg(F.count_if(said == F.col("y")).alias("right"), F.count("*").alias("n"))
    return [(jobs[r["tree"]][0], r["right"], r["n"]) for r in counted.collect()]  # a row for each tree
