"""Exact quantiles of groups of any size, by narrowing ranges.

A range is cut at approximate quantiles of what is in it, its parts are counted, and the part that
holds the wanted rank is the next range, about ``CUTS`` times smaller. That ends when a range has few
rows, or one value only, however many rows have it. No task holds the values of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a range is cut into, and rows of a range from which it is cut further.
CUTS = 32
FEW_ROWS = 200_000


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """by, rank, found: the value of each rank (from 0) among the rows of its group; ``ranks`` has by and rank, and groups are few.

    Nulls and NaN are left out of the rows beforehand.
    """
    key = F.struct(*[F.col(c) for c in by]) if by else F.lit(True)
    rows = rows.select(F.to_json(F.struct(key.alias("k"))).alias("_k"), *by, F.col(value).cast("double").alias("_v"))
    wanted = ranks.select(F.to_json(F.struct(key.alias("k"))).alias("_k"), *by, F.col("rank").cast("long").alias("rank")).distinct()
    whole = rows.groupBy("_k").count()
    opened = [(r["_k"], r["rank"], None, None, 0, r["count"]) for r in wanted.join(whole, "_k").select("_k", "rank", "count").collect()]  # a row for each group and rank
    done: list[tuple] = []
    schema = "_of string, rank long, _lo double, _hi double, _below long, _n long"
    while many := [b for b in opened if b[5] > FEW_ROWS]:
        cells = _inside(rows, rows.sparkSession.createDataFrame(many, schema))
        cuts = cells.groupBy("_k", "rank").agg(F.array_distinct(F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], 4 * CUTS)).alias("_cuts"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        cuts = cuts.withColumn("_cuts", F.array_union(F.array("_least"), "_cuts"))
        # the least and the greatest value are parts of their own, so a value that many rows share ends up alone
        place = F.when(F.col("_v") == F.col("_most"), CUTS + 1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
        cells = cells.join(F.broadcast(cuts), ["_k", "rank"]).withColumn("_part", place)
        parts = cells.groupBy("_k", "rank", "_part").agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.first("_below").alias("_below"))
        before = F.col("_below") + F.sum("n").over(Window.partitionBy("_k", "rank").orderBy("_part")) - F.col("n")
        hit = parts.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).collect()  # a row for each group and rank
        opened = [b for b in opened if b[5] <= FEW_ROWS]
        for r in hit:
            if r["least"] == r["most"]:
                done.append((r["_k"], r["rank"], r["least"]))
            else:
                opened.append((r["_k"], r["rank"], r["least"], r["most"], r["before"], r["n"]))
    found = rows.sparkSession.createDataFrame(done, "_of string, rank long, found double")
    if opened:
        few = _inside(rows, rows.sparkSession.createDataFrame(opened, schema)).groupBy("_k", "rank", "_below", "_v").agg(F.count("*").alias("n"))
        upto = F.col("_below") + F.sum("n").over(Window.partitionBy("_k", "rank").orderBy("_v"))
        few = few.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        found = found.unionByName(few.select(F.col("_k").alias("_of"), "rank", F.col("_v").alias("found")))
    names = wanted.withColumnRenamed("rank", "_rank")
    return found.join(F.broadcast(names), (F.col("_of") == F.col("_k")) & (F.col("rank") == F.col("_rank"))).select(*by, "rank", "found")


def _inside(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows in each range, ends included."""
    joined = rows.join(F.broadcast(ranges), F.col("_k") == F.col("_of"))
    return joined.where((F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))).select("_k", "rank", "_below", "_v")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], between: bool = True) -> DataFrame:
    """by, q: the quantiles of each group, as an array in the order of ``probabilities``.

    Between two rows a quantile is interpolated, or it is the first value with at least that
    share of the rows at or below it. Nulls and NaN do not count; a group without other values has no row.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias(value))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    ends = []
    for i, p in enumerate(probabilities):
        if between:
            at = F.lit(float(p)) * (F.col("_n") - 1)
            low, high, weight = F.floor(at), F.ceil(at), at - F.floor(at)
        else:
            low = high = F.greatest(F.ceil(F.round(F.lit(float(p)) * F.col("_n"), 9)) - 1, F.lit(0))
            weight = F.lit(0.0)
        ends.append(F.struct(F.lit(i).alias("i"), low.cast("long").alias("low"), high.cast("long").alias("high"), weight.alias("weight")))
    asked = sizes.select(*by, F.inline(F.array(*ends)))
    ranks = asked.select(*by, F.explode(F.array("low", "high")).alias("rank"))
    found = order_statistics(rows, by, value, ranks)
    same = lambda end: [F.col(f"a.{c}").eqNullSafe(F.col(f"{end}.{c}")) for c in by] + [F.col(f"a.{end}") == F.col(f"{end}.rank")]
    out = asked.alias("a").join(F.broadcast(found.alias("low")), same("low")).join(F.broadcast(found.alias("high")), same("high"))
    q = F.when(F.col("low.found") == F.col("high.found"), F.col("low.found")).otherwise(F.col("low.found") * (1 - F.col("a.weight")) + F.col("high.found") * F.col("a.weight"))
    out = out.select(*[F.col(f"a.{c}").alias(c) for c in by], F.struct(F.col("a.i").alias("i"), q.alias("q")).alias("e"))
    return out.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["q"]).alias("q"))
