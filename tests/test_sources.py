import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.sources import arff, audio, tables
from rulewright.streaming import series

ARFF = """% a comment
@relation gestures
@data
'1.0,2.0,?\\n4.0,5.0,6.5',2.0
'7.0,8.0,9.0\\n1.5,-2.0,0',1.0
"""


def test_arff(spark, tmp_path):
    (tmp_path / "train.arff").write_text(ARFF)
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("test.arff", ARFF)
    paths = {"train": f"{tmp_path}/train.arff", "test": f"{tmp_path}/all.zip!test.arff"}
    df = arff.read_arff(spark, paths, ["x", "y"], {"1.0": "one"})
    rows = df.orderBy("split", "line").collect()
    assert [(r["split"], r["class"]) for r in rows] == [("test", "2.0"), ("test", "one"), ("train", "2.0"), ("train", "one")]
    assert rows[1]["y"] == [1.5, -2.0, 0.0] and math.isnan(rows[0]["x"][2])
    assert arff.read_arff(spark, paths, split="train").count() == 2
    with pytest.raises(ValueError):
        arff.read_arff(spark, paths, split="other")
    plain = arff.parse_arff_text(spark.read.text(f"{tmp_path}/train.arff")).collect()
    assert sorted(r["class"] for r in plain) == ["1.0", "2.0"] and [r["series"] for r in plain if r["class"] == "1.0"][0][0] == [7.0, 8.0, 9.0]


def test_audio_round_trip(spark, tmp_path):
    x = np.sin(np.arange(1600) / 10) * 0.5
    clips = spark.createDataFrame([("a.wav", 16000, x.tolist()), ("b.wav", 8000, x[:800].tolist()), ("c.wav", 8000, None)], "path string, sr int, samples array<float>")
    assert audio.write_audio(clips, f"file://{tmp_path}/clips").count() == 2
    (tmp_path / "clips" / "bad.wav").write_bytes(b"nothing")
    rows = {r["path"].rpartition("/")[2]: r for r in audio.read_audio(spark, str(tmp_path / "clips")).collect()}
    assert rows["bad.wav"]["samples"] is None and np.allclose(rows["a.wav"]["samples"], x, atol=1e-3)
    again = {r["path"].rpartition("/")[2]: r for r in audio.read_audio(spark, str(tmp_path / "clips"), rate=8000, norm=True).collect()}
    assert len(again["a.wav"]["samples"]) == 800 and abs(max(again["a.wav"]["samples"]) - 1) < 0.02


def test_tables(spark, tmp_path):
    (tmp_path / "l.csv").write_text("file,diagnosis\na,sick\nb,healthy\nc,other\n")
    labels = tables.read_labels(spark, f"{tmp_path}/l.csv", {"sick": "s", "healthy": "h"}, "file", "diagnosis")
    assert {(r["id"], r["label"]) for r in labels.collect()} == {("a", "s"), ("b", "h")}
    df = spark.createDataFrame([("a", 1), ("z", 2)], "filename string, x int")
    assert [r["label"] for r in tables.merge_labels(df, labels, "filename", "id", "label").collect()] == ["s"]
    tables.write_store(df, f"{tmp_path}/store")
    assert tables.read_store(spark, f"{tmp_path}/store", {"x": [2]}).first()["filename"] == "z"
    calls = []

    def build():
        calls.append(1)
        return df

    for params in ({"n": 1}, {"n": 1}, {"n": 2}):
        assert tables.cached(spark, str(tmp_path), "ds", params, build).count() == 2
    assert len(calls) == 2
    assert tables.rename_all(df, str.upper).columns == ["FILENAME", "X"]
    ids = tables.with_row_id(spark.range(100).select((F.lit(100) - F.col("id")).alias("k")), ["k"])
    assert [r["row_id"] for r in ids.orderBy("k").collect()] == list(range(100))


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    (tmp_path / "in").mkdir()
    events.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = series.windowed_features(stream, keys=("event_type",), length="1 day").writeStream.outputMode("complete").format("memory").queryName("features").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        got = spark.sql("select * from features")
        want = series.windowed_features(events, keys=("event_type",), length="1 day")
        key = lambda r: (r["start"], r["event_type"])
        assert [(key(r), r["n"]) for r in sorted(got.collect(), key=key)] == [(key(r), r["n"]) for r in sorted(want.collect(), key=key)]
    finally:
        query.stop()
    assert series.sessions(events).count() > 0


def test_row_ids_follow_the_order(spark):
    from rulewright.sources import tables

    rows = spark.createDataFrame([(i * 37 % 101 // 3, i) for i in range(101)], "a long, b long")
    out = sorted((r["row_id"], r["a"], r["b"]) for r in tables.with_row_id(rows, ["a", "b"]).collect())
    assert [x[0] for x in out] == list(range(101)) and [x[1:] for x in out] == sorted(x[1:] for x in out)


def test_bound_columns_of_one_name_raise(spark):
    from rulewright.operators import relational

    a = spark.createDataFrame([(1, 2)], "row_id long, x long")
    with pytest.raises(ValueError):
        relational.bind_columns(a, a)
