"""A corpus pipeline: quality, exact and near duplicates, mixing, encoding.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of
``documents``; what a stage returns is written as Parquet and read again by the next one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import common, exact, minmax, mixing, pieces, quality
from rulewright.llm.queries import MODEL_PATH

#: Near copies are linked at a similarity of 0.8. The operator's own query is held to 0.85.
NEAR_THRESHOLD = (80, 100)
#: 50 bands of 6: a pair at 0.8 shares no bucket with a probability of (1 - 0.8**6)**50 = 3e-7.
NEAR_PERMS = 150


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that are probably poor or toxic.

    Every row is judged by its own text, repeated rows and rows without id alike; a null text counts
    as empty. Without a labelled text all go. An empty table gives an empty one.
    """
    return quality.select_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (a null one counts as empty) the row with the smallest id stays.

    Null ids come last. Where that id repeats, or all ids are null, one of its rows stays. Rows of
    one id with different texts are different documents. An empty table gives an empty one.
    """
    return common.one_of_each(docs, exact.exact_duplicates(docs, row_key=True), "text_sha256")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the row with the smallest id, null ids last.

    Where that id repeats, or all ids are null, one of its rows stays. Texts without a word are in
    no group and stay. An empty table gives an empty one.
    """
    decided = minmax.near_duplicates(docs, threshold=NEAR_THRESHOLD, perms=NEAR_PERMS, row_key=True)
    return common.one_of_each(docs, decided, "component")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture of their sources; see ``mixing.mixed_order``."""
    return mixing.mixed_order(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's segmentations; see ``pieces.encode``.

    Ordering by (mix_file, mix_row) gives the order in which the rows were written, which is the
    mixture: the number of the file among those written together, and the row's place in it.
    Both are null for rows that come from no file.
    """
    try:
        name, row = docs["_metadata.file_name"], docs["_metadata.row_index"]
    except AnalysisException:  # not a table of files
        name, row = F.lit(None).cast("string"), F.lit(None).cast("long")
    place = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("int").alias("mix_file"), row.alias("mix_row")
    return pieces.encode(docs, MODEL_PATH, carry=place)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near-duplicates", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: SQL cannot express a trained model or a piece lattice; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each staged in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.staged(docs, "stage")
    return docs
