"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rulewright.llm import common, crossentropy, exact, langid, licenses, media, merkle, minmax, mixing, pieces, quality
from rulewright.llm.queries import MODEL_PATH

LONG = " ".join(f"word{i % 977} other{i % 13}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and slept all day long", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, "   \t\n ", "fr", "b"),
    (5, LONG, "en", "a"),
    (None, "the cat sat on the mat and slept all day long", None, "b"),
    (1, "the cat sat on the mat and slept all day long", "en", "a"),
    (7, "the  cat sat on the mat\nand slept all day long", "en", None),
    (8, "ein kurzer Satz über nichts", "de", "c"),
    (9, "🙂 ▁ \x00 mixed", "xx", "c"),
    (None, None, None, None),
]
CLASH = ["node", "text_sha256", "digest", "slot", "bucket", "score", "n", "grade", "component_id", "kept", "h", "own", "start"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(3).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, None), (8, 1, 1), (None, 1, 0), (4, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


def audited(d):
    layout = merkle.archive_layout(d.withColumnsRenamed({"doc_id": "record_id", "text": "record"}))
    out = merkle.audit(layout, layout)
    return out.select(F.col("record_id").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "intact")


OPERATORS = {
    "op1": lambda s, d, y: audited(d),
    "op2": lambda s, d, y: pieces.encode(d, MODEL_PATH),
    "op3": lambda s, d, y: langid.identify(s, d),
    "op4": lambda s, d, y: mixing.mix(d),
    "op5": lambda s, d, y: licenses.license_scan(d),
    "op6": lambda s, d, y: media.media_columns(d),
    "op7": lambda s, d, y: exact.exact_duplicates(d),
    "op8": lambda s, d, y: crossentropy.score(d, y.where("quality = 1")),
    "op9": lambda s, d, y: minmax.near_duplicates(d),
    "op10": lambda s, d, y: quality.classify(d, y),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, docs, labels, name):
    out = OPERATORS[name](spark, docs, labels).select("doc_id").collect()
    key = lambda v: (v is None, v or 0)
    assert sorted((r["doc_id"] for r in out), key=key) == sorted((r[0] for r in ROWS), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, docs, labels, name):
    assert OPERATORS[name](spark, docs.limit(0), labels.limit(0)).count() == 0


def test_clashing_columns_of_labels(spark, docs, labels):
    clashing = labels.withColumns({c: F.lit("clash") for c in ("text", "grade", "h", "n", "cells", "target_id")})
    assert quality.classify(docs, clashing).count() == len(ROWS) and crossentropy.score(docs, clashing.where("quality = 1")).count() == len(ROWS)


def test_decoding_and_components_of_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decode_column(rows, MODEL_PATH).collect()} == {1: None, 2: ""}
    links = spark.createDataFrame([(None, 1), (2, None), (3, 4)], "a long, b long")
    assert sorted(tuple(r) for r in minmax.components(links).collect()) == [(3, 3), (4, 3)]
    assert minmax.components(links.limit(0)).count() == 0


def test_first_and_last_stage_of_empty_tables(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    assert corpus_pipeline.quality_stage(spark, plain, str(tmp_path)).count() == 0 and corpus_pipeline.pieces_stage(spark, plain, str(tmp_path)).count() == 0


def test_no_labels(spark, docs, labels):
    assert quality.classify(docs, labels.limit(0)).where("kept").count() == 0
    assert {r["lang_pred"] for r in langid.identify(spark, docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_exact_defined_results(docs):
    out = {(r["doc_id"], r["text_sha256"]): r for r in exact.exact_duplicates(docs).collect()}
    cat = [r for r in out.values() if r["group_size"] == 4]
    assert {r["doc_id"] for r in cat} == {1, None, 7} and all(r["keep_id"] == 1 for r in cat)
    assert not next(r for r in cat if r["doc_id"] is None)["kept"]
    empty = [r for r in out.values() if r["doc_id"] in (2, 3)]
    assert all(r["keep_id"] == 2 and r["group_size"] == 3 for r in empty)


def test_near_defined_results(docs):
    out = minmax.near_duplicates(docs).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[7]] == [1] and not by[7][0]["kept"]
    assert by[2][0]["component_id"] == 2 and by[2][0]["n_shingles"] == 0 and by[4][0]["component_id"] == 4
    assert sorted(r["kept"] for r in by[None]) == [False, True]  # the copy goes, the empty one stays


def test_languages_of_texts_without_letters(spark, docs):
    out = {r["doc_id"]: r for r in langid.identify(spark, docs).where("doc_id in (2, 3, 4)").collect()}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out.values()) and len(out) == 3


def test_merkle_nulls_repeats_and_empty(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, None, None), (None, "u", "y"), (None, "u", "y")]
    records = spark.createDataFrame(rows, "record_id long, url string, html string").select("record_id", merkle.warc_record(F.col("url"), F.col("html")).alias("record"))
    layout = common.staged(merkle.archive_layout(records), "t")
    out = merkle.audit(layout, layout).collect()
    assert sum(r["copies"] for r in out) == 5 and all(r["intact"] for r in out)
    none = common.staged(merkle.archive_layout(records.limit(0)), "t")
    assert merkle.audit(none, none).count() == 0
    assert not any(r["intact"] for r in merkle.audit(layout, none).collect())


def test_pipeline_stages_keep_columns(spark, docs, labels, tmp_path):
    folder = str(tmp_path)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, plain, folder)
        assert out.columns == plain.columns
        assert stage(spark, plain.limit(0), folder).count() == 0
    assert corpus_pipeline.exact_stage(spark, plain, folder).where("doc_id = 1").count() == 1
    assert corpus_pipeline.mixing_stage(spark, plain, folder).count() == len(ROWS)
    assert corpus_pipeline.quality_stage(spark, plain, folder).columns == plain.columns
    assert corpus_pipeline.run(spark, folder).count() >= 0


def test_pipeline_drops_near_copies_from_a_similarity_of_080(spark, tmp_path):
    """20 pairs with 100 shingles each, 90 of them shared: a similarity of 90 / 110."""
    rows = [(2 * p + c, " ".join(f"w{p}x{i if i < 94 or not c else -i}" for i in range(104))) for p in range(20) for c in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, str(tmp_path)).collect()) == list(range(0, 40, 2))
