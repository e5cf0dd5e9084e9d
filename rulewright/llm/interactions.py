"""Filter interaction audit by inclusion and exclusion.

Every document has one flag for each filter that it fails. For each of the 2**k sets of filters
the product of their flags, summed over the documents, counts those that fail all of them; that
one aggregate is all that is read from the documents. What follows is arithmetic on these joint
counts J(S):

* survivors of a set P:       K(P) = sum over S in P of (-1)**|S| J(S)
* failing f and nothing else: sum over S with f of (-1)**(|S| - 1) J(S)   (Moebius inversion)
* removed by f after P:       K(P) - K(P + f);  redundant: J({f}) less that
* Shapley value of f in the game v(P) = documents that P removes: v has the Harsanyi dividends
  (-1)**(|S| + 1) J(S), and f gets an equal share of every S that it is in. It is given times k!,
  which is f's removals summed over all orders, a whole number.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are what stands between these.
WHITE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 100
#: A text fails with fewer distinct words than this share of its words, in hundredths.
LEAST_DISTINCT = 80
#: A text fails with more capitals A-Z than this share of its code points, in hundredths.
MOST_CAPITALS = 10
SIGNS = r"[#$%&*|]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """The filters that a text passes or fails by itself: A few words, B repeated words, C capitals, D signs."""
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_DISTINCT,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MOST_CAPITALS,
        "D": text.rlike(SIGNS),
    }


def subsets(names: str) -> list[str]:
    """All sets of filters, the place of each being its bits."""
    return ["".join(f for i, f in enumerate(names) if mask >> i & 1) for mask in range(1 << len(names))]


def joint_failures(rows: DataFrame, fails: Mapping[str, Column], by: Column, weights: Mapping[str, Column]) -> DataFrame:
    """part, and for each weight an array: over the rows of a part the sum of weight times the flags of each set.

    ``fails`` has a flag of 0 or 1 for each filter, or the number of its rows that fail.
    """
    names = "".join(fails)

    def product(of: str, weight: Column) -> Column:
        out = weight
        for f in of:
            out = out * fails[f]
        return F.sum(out)

    return rows.groupBy(by.alias("part")).agg(*[F.array(*[product(s, w) for s in subsets(names)]).alias(name) for name, w in weights.items()])


def _times(joint: str, rows: list[list[int]]) -> Column:
    """A matrix of whole numbers, given by its rows, times an array of joint counts."""
    matrix = F.from_json(F.lit(json.dumps(rows)), "array<array<long>>")
    return F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, F.col(joint), lambda a, b: a * b), F.lit(0).cast("long"), lambda x, y: x + y))


def interactions(joint: DataFrame, names: str, lost: tuple[str, ...]) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, shapley, and for each of ``lost`` its removals.

    One row for every part, order of the filters and step. ``joint`` has ``n`` and ``lost`` as
    arrays of ``joint_failures``.
    """
    sets = subsets(names)
    survivors = [[(-1) ** len(s) if set(s) <= set(p) else 0 for s in sets] for p in sets]
    alone = [[(-1) ** (len(s) - 1) if f in s else 0 for s in sets] for f in names]
    shares = [[(-1) ** (len(s) + 1) * factorial(len(names)) // len(s) if f in s else 0 for s in sets] for f in names]
    steps = []
    for order in permutations(names):
        for step, f in enumerate(order):
            before, own = sum(1 << names.index(g) for g in order[:step]), 1 << names.index(f)
            steps.append({"filter_order": "".join(order), "step": step + 1, "filter": f, "place": names.index(f), "own": own, "before": before, "after": before | own})
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:string,place:int,own:int,before:int,after:int>>")
    solved = joint.select("part", F.col("n").alias("joint"), _times("n", alone).alias("alone"), _times("n", shares).alias("shares"), *[_times(w, survivors).alias(f"kept_{w}") for w in ("n", *lost)])
    at = solved.select("*", F.inline(steps))
    gone = lambda w: F.get(f"kept_{w}", F.col("before")) - F.get(f"kept_{w}", F.col("after"))
    return at.select(
        "part", "filter_order", "step", "filter",
        F.get("kept_n", F.col("after")).alias("kept"),
        gone("n").alias("removed"),
        (F.get("joint", F.col("own")) - gone("n")).alias("redundant"),
        F.get("alone", F.col("place")).alias("unique_fails"),
        *[gone(w).alias(w) for w in lost],
        F.get("shares", F.col("place")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The interactions of five filters in each language: one row for every part, order and step.

    A to D are ``text_filters``; a text fails E if a row with a smaller id has the same text. A null
    text counts as empty and a null language as the empty string. A row without id has no smaller
    one, so it never fails E, and rows that share the smallest id of their text do not either. A
    document is good or toxic if any row of ``labels`` with its id says so (``good_lost``,
    ``toxic_lost`` count those); labels without id do not matter. Other columns of both tables are
    not read. An empty table has no parts and gives no rows.

    Texts are told apart by SHA-256 and length. Flags A to D are the text's own, so equal rows are
    counted together before they are shuffled by text, and no task gets the copies of one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), text.alias("body"), words_of(text).alias("words"))
    flags = text_filters(F.col("body"), F.col("words"))
    rows = texts.select("id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), F.octet_length("body").alias("size"), *[f.cast("int").alias(name) for name, f in flags.items()])
    kind = ["digest", "size", "A", "B", "C", "D", "part"]
    # rows of one id and text first: they are all that a hot text and a hot id have in common
    counted = rows.groupBy(*kind, "id").agg(F.count("*").alias("n"))
    marked = counted.join(marks, F.col("id") == F.col("of_id"), "left").select(*kind, "id", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    known = F.col("id").isNotNull()
    groups = marked.groupBy(*kind, "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("loose"), F.min(F.when(known, F.struct("id", "n"))).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest", "size"))
    later = F.col("n") - F.col("loose") - F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    # the rows of a group that fail E and those that do not, as two rows with a flag
    flagged = groups.withColumn("least", least).select("part", "good", "toxic", *"ABCD", F.explode(F.array(F.struct(F.lit(1).alias("E"), later.alias("w")), F.struct(F.lit(0).alias("E"), (F.col("n") - later).alias("w")))).alias("e"))
    flagged = flagged.select("part", "good", "toxic", *"ABCD", "e.*")
    weights = {"n": F.col("w"), "good_lost": F.col("w") * F.col("good"), "toxic_lost": F.col("w") * F.col("toxic")}
    joint = joint_failures(flagged, {f: F.col(f) for f in "ABCDE"}, F.col("part"), weights)
    return interactions(joint, "ABCDE", ("good_lost", "toxic_lost"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS least FROM d GROUP BY text
), f AS (
  SELECT part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM d JOIN firsts USING (text)
), p AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed,
    count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY 1, 2
), orders AS (
  SELECT '' AS o UNION ALL SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)
), steps AS (
  SELECT o AS filter_order, s::int AS step, o[s] AS filter, o[1 : s - 1] AS earlier FROM orders, range(1, 6) t(s) WHERE length(o) = 5
), r AS (
  SELECT part, filter_order, step, filter, n, good, toxic, failed, contains(failed, filter) AS fails, len(list_intersect(string_split(earlier, ''), string_split(failed, ''))) > 0 AND earlier <> '' AND failed <> '' AS gone FROM p, steps
), t AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::bigint AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::bigint AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::bigint AS redundant, coalesce(sum(n) FILTER (WHERE failed = filter), 0)::bigint AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0)::bigint AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0)::bigint AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::bigint AS shapley FROM t
"""
