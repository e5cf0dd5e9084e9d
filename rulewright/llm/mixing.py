"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Block j of a source of weight w (all weights add up to 1) is released at slot floor(j / w) and
due by slot ceil((j + 1) / w); in each slot the released block with the earliest deadline runs
(earlier name first on a tie). On one processor this schedule meets every deadline, so after
any number of slots each source is less than one block away from its share. It is worked out
from the weights as they are given, for a period of as many slots as it takes until a first
source can have run out. A source that the period gives no block, as its weight is 0 or next to
it, gets a slot behind the period's last one. With a_s blocks of source s in a period of Q slots,
any block's slot is

    slot(s, j) = (j div a_s) * Q + offset(s, j mod a_s).

The slots of a period are cut into runs that are worked out side by side. Before slot T a source
has had floor(w T) or one more of its blocks; which of them have had one more is guessed for
every run, by earliest deadline, and a run whose predecessor ended otherwise is worked out
again from there, until all runs fit together. What comes out is the one schedule that starts
at slot 0. A run takes as many steps as it has slots, each over all sources.

Blocks are runs of ``block_rows`` rows of a source in the order of a digest of their ids. Ids
are counted first, so the rows of one id are a range of numbers and never sorted among
themselves; ids are numbered within ranges of the digest with offsets from the ranges' counts,
and a source has ranges in proportion to its rows, so one with a third of all rows is numbered
by many tasks of the same size. A source that has run out leaves its slots empty; the others
keep their places and thus their proportions to each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import common

BLOCK_ROWS = 16
#: Rows that are numbered together, about.
BUCKET_ROWS = 2_500
#: The default target is proportional to a source's rows to this power.
TEMPERATURE = 0.7
#: Slots of a period at least, and slots that are worked out one after another.
PERIOD = 1_024
#: Quotients j / w this close to a whole number are that number.
NEAR = 1e-7
#: Rows of one id that one task lists.
LISTED = 100_000


def source_sizes(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """source, n: rows of every source; a null source is one of its own."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))


def _shares(sizes: DataFrame, weights: dict[str | None, float] | None, temperature: float) -> DataFrame:
    """source, n, w: target weights that add up to 1; equal ones if all that are given are 0."""
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        named = sizes.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "named string, given double")
        sizes = sizes.join(common.small_or_shuffled(named), F.col("source").eqNullSafe(F.col("named")), "left")
        share = F.coalesce("given", F.lit(0.0))
    one = Window.partitionBy(F.lit(0))  # one row for each source
    return sizes.select("source", "n", F.coalesce(F.try_divide(share, F.sum(share).over(one)), 1 / F.count("*").over(one)).alias("w"))


def _held(value: Column, name) -> Column:
    """``name(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), name)[0]


def _deadline(j: Column, w: Column) -> Column:
    return F.ceil((j + 1) / w - NEAR).cast("double")


def _guess(lo: Column) -> Column:
    """Blocks of every source before slot ``lo``; of blocks under way those that are due first are done."""
    never = F.lit(float("inf"))

    def known(w: Column, i: Column) -> Column:
        j = F.floor(w * lo + NEAR)
        return F.struct(F.when((w > 0) & (w * lo - j > NEAR), _deadline(j, w)).otherwise(never).alias("due"), i.alias("i"), j.alias("j"))

    def decided(known: Column) -> Column:
        more = lo - F.aggregate(known, F.lit(0).cast("long"), lambda a, x: a + x["j"])
        last = F.get(F.array_sort(F.transform(known, lambda x: F.struct(x["due"], x["i"]))), (more - 1).cast("int"))
        return _held(last, lambda z: F.transform(known, lambda x: x["j"] + F.when(z.isNotNull() & (x["due"] < never) & (F.struct(x["due"], x["i"]) <= z), 1).otherwise(0)))

    return _held(F.transform("w", known), decided)


def _run(start: Column, lo: Column, hi: Column) -> Column:
    """(done, order) after the slots from ``lo`` to ``hi`` - 1, with ``start`` blocks done before."""
    never = F.lit(float("inf"))

    def step(state: Column, slot: Column) -> Column:
        def due(c: Column, w: Column) -> Column:
            return F.when((w > 0) & (F.floor(c / w + NEAR) <= slot), _deadline(c, w)).otherwise(never)

        def after(pick: Column) -> Column:
            done = F.transform(state["done"], lambda c, i: F.when(i + 1 == pick, c + 1).otherwise(c))
            return F.struct(done.alias("done"), F.concat(state["order"], F.array(F.struct((pick - 1).alias("i"), F.element_at(state["done"], pick).alias("k")))).alias("order"))

        pick = _held(F.zip_with(state["done"], "w", due), lambda d: F.array_position(d, F.array_min(d)).cast("int"))
        return _held(pick, after)

    first = F.struct(start.alias("done"), F.array().cast("array<struct<i:int,k:bigint>>").alias("order"))
    return F.aggregate(F.sequence(lo, hi - 1), first, step)


def _period_table(shares: DataFrame, slots: int) -> DataFrame:
    """source, k, offset: the first ``slots`` slots by earliest deadline first, then one for each source without any."""
    listed = shares.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "w"))).alias("s"))
    listed = common.staged(listed.select(F.col("s.source").alias("source"), F.col("s.w").alias("w")), "listed")
    runs = -(-slots // PERIOD)

    def worked(starts: DataFrame) -> DataFrame:
        """run, start, done, order of (run, start)."""
        ranged = starts.crossJoin(F.broadcast(listed.select("w")))  # one row
        lo = F.col("run") * PERIOD
        ranged = ranged.withColumn("r", _run(F.col("start"), lo, F.least(lo + PERIOD, F.lit(slots).cast("long"))))
        return common.staged(ranged.select("run", "start", "r.done", "r.order"), "runs")

    numbers = shares.sparkSession.range(0, runs, 1, min(runs, 4_096)).withColumnRenamed("id", "run")
    found = worked(numbers.crossJoin(F.broadcast(listed.select("w"))).select("run", _guess(F.col("run") * PERIOD).alias("start")))
    while runs > 1:
        before = found.select((F.col("run") + 1).alias("next"), F.col("done").alias("true_start"))
        wrong = found.join(before, F.col("run") == F.col("next")).where(F.col("start") != F.col("true_start"))
        wrong = common.staged(wrong.select("run", F.col("true_start").alias("start")), "wrong")
        n = wrong.count()
        if not n:
            break
        again = worked(wrong.repartition(min(n, 4_096), "run"))
        found = common.staged(found.join(wrong.select("run"), "run", "left_anti").unionByName(again), "runs")

    names = F.broadcast(listed.select("source"))  # one row
    last = found.where(F.col("run") == runs - 1).select(F.posexplode("done").alias("i", "k")).where("k = 0")
    behind = Window.orderBy("i")  # of the sources without a slot, a part of the one row of sources
    none = last.select("i", "k", (F.row_number().over(behind) - 1 + slots).cast("long").alias("offset"))
    out = found.select("run", F.posexplode("order").alias("p", "x")).select("x.i", "x.k", (F.col("run") * PERIOD + F.col("p")).alias("offset"))
    return out.unionByName(none).crossJoin(names).select(F.get("source", F.col("i")).alias("source"), "k", "offset")


class _Schedule:
    """The schedule of a table's sources: slots of a period, and the sources' shares of it."""

    def __init__(self, rows: DataFrame, weights, block_rows: int, temperature: float):
        self.block_rows = block_rows
        sizes = common.staged(source_sizes(rows), "sources")
        shares = common.staged(_shares(sizes, weights, temperature), "shares")
        # after so many slots a source can have run out; never more than there are blocks
        known = shares.agg(F.count("*"), F.sum("n"), F.min(F.when(F.col("w") > 0, F.ceil(F.col("n") / block_rows) / F.col("w")))).first()
        self.total, lasts = known[1] or 0, known[2] or 0
        self.slots = max(PERIOD, 8 * known[0], math.ceil(lasts))
        table = common.staged(_period_table(shares, self.slots), "slots")
        counted = table.groupBy("source").agg(F.count("*").alias("pp")).withColumnRenamed("source", "cs")
        self.period = (table.agg(F.max("offset")).first()[0] or 0) + 1
        self.known = common.staged(shares.join(counted, F.col("source").eqNullSafe(F.col("cs"))).select(F.col("source").alias("ps"), "n", "w", "pp"), "known")
        self.table = table.select(F.col("source").alias("ts"), "k", "offset")

    def of_source(self, rows: DataFrame) -> DataFrame:
        """``rows`` with n, w and pp of their source."""
        return common.spread_join(rows, self.known, F.col("source").eqNullSafe(F.col("ps")), "n", self.total)

    def numbered(self, rows: DataFrame, bucket_rows: int) -> DataFrame:
        """doc_id, source, c, row_no, w, pp of every id of every source: its rows and the first one's number."""
        ids = self.of_source(rows.groupBy("source", "doc_id").agg(F.count("*").alias("c")))
        digest = F.conv(F.substring(F.md5(F.concat(F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
        buckets = F.ceil(F.col("n") / bucket_rows)
        # 32 bits of the digest name one of the source's ranges
        ids = ids.withColumn("h", digest).withColumn("bucket", F.shiftright(F.shiftright("h", 28) * buckets, 32))
        counts = ids.groupBy("source", "bucket").agg(F.sum("c").alias("cc"))
        before = F.sum("cc").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("start"))
        own = F.sum("c").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
        # one row for each source and bucket: joined by a shuffle if many
        ids = ids.withColumn("own", F.coalesce(own, F.lit(0))).join(common.small_or_shuffled(counts), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        return ids.select("doc_id", "source", "c", (F.col("own") + F.col("start")).alias("row_no"), "w", "pp")

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (source, row_no, w, pp) with block_no, release, deadline, slot."""
        rows = rows.withColumn("block_no", F.floor(F.col("row_no") / self.block_rows)).withColumn("kk", F.pmod("block_no", "pp"))
        rows = rows.join(common.small_or_shuffled(self.table), F.col("source").eqNullSafe(F.col("ts")) & (F.col("kk") == F.col("k")))
        kk, w = F.col("kk"), F.col("w")
        base = (F.col("block_no") - kk) / F.col("pp") * F.lit(self.period).cast("long")
        behind = F.col("offset") >= self.slots
        release = F.when(behind, F.lit(self.slots)).otherwise(F.floor(kk / w + NEAR))
        deadline = F.when(behind, F.lit(self.period)).otherwise(_deadline(kk, w))
        return rows.withColumns({"release": (base + release).cast("long"), "deadline": (base + deadline).cast("long"), "slot": (base + F.col("offset")).cast("long")})


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    temperature: float = TEMPERATURE,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """doc_id, source, weight, row_no, block_no, release, deadline, slot: one row for each row of ``docs``.

    ``weights`` are target weights by source name; by default a source's weight is its rows to
    the power ``temperature``. ``weight`` is the target as a part of 1. As long as no source has run
    out, each is less than one block away from it after any number of slots. A source that is not
    named or has weight 0 gets a slot behind each period, so that none of its rows is lost. Ordering by
    (slot, row_no) gives the mixture. A null source is a source of its own; null ids and
    repeated rows are numbered like others (rows of one id side by side), and an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    plan = _Schedule(rows, weights, block_rows, temperature)
    ids = plan.numbered(rows, bucket_rows)
    most = ids.agg(F.max("c")).first()[0] or 0
    if most > LISTED:  # an id with very many rows is listed by many tasks
        runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / LISTED)))
        ids = ids.select("*", runs.alias("part")).repartition("source", "doc_id", "part")
        ids = ids.withColumns({"row_no": F.col("row_no") + F.col("part") * LISTED, "c": F.least(F.lit(LISTED), F.col("c") - F.col("part") * LISTED)})
    rows = ids.withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))).withColumn("row_no", F.col("row_no") + F.col("e"))
    return plan.placed(rows).select("doc_id", "source", F.col("w").alias("weight"), F.col("row_no").cast("long").alias("row_no"), F.col("block_no").cast("long").alias("block_no"), "release", "deadline", "slot")


def mixed_order(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    temperature: float = TEMPERATURE,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, over range partitions of it.

    Rows that share id and source are spread over the places of that id by a hash of the row; rows
    that are alike in all columns share a place. No row is lost or repeated, null ids and sources
    are as in ``mix``, and an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    plan = _Schedule(rows, weights, block_rows, temperature)
    ids = common.staged(plan.numbered(rows, bucket_rows).select(*[F.col(c).alias(f"mix_{c}") for c in ("doc_id", "source", "c", "row_no", "w", "pp")]), "places")
    match = docs[id_col].cast("long").eqNullSafe(F.col("mix_doc_id")) & docs[source_col].cast("string").eqNullSafe(F.col("mix_source"))
    whole = F.struct(*[docs[c.name] for c in docs.schema if not isinstance(c.dataType, MapType)])
    packed = F.struct(*[docs[c] for c in docs.columns]).alias("mix_doc")
    own = F.when(F.col("mix_c") > 1, F.pmod(F.xxhash64(whole), F.col("mix_c"))).otherwise(0)
    placed = common.spread_join(docs, ids, match, "mix_c", plan.total).select(packed, F.col("mix_source").alias("source"), (F.col("mix_row_no") + own).alias("row_no"), F.col("mix_w").alias("w"), F.col("mix_pp").alias("pp"))
    placed = plan.placed(placed)
    return placed.repartitionByRange("slot", "row_no").sortWithinPartitions("slot", "row_no").select("mix_doc.*")
