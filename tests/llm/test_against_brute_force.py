"""Each operator on the small tables against a plain Python version of what it must return."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import canonical

from rulewright.llm import crossentropy, exact, langid, licenses, media, merkle, minmax, mixing, pieces, quality, queries
from rulewright.llm.queries import MODEL_PATH


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").persist()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, data, oracle, name):
    got, want = queries.QUERIES[name](spark, data).toPandas(), oracle.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


# -- 1 ------------------------------------------------------------------------------------


def test_merkle_descends_only_where_it_must(spark, data):
    out = queries.op1_merkle_fixity(spark, data).collect()
    assert {r["record_id"] for r in out if not r["intact"]} == {r["record_id"] for r in out if r["record_id"] % 97 == 13}


def test_merkle_root_covers_order_and_offsets(spark):
    rows = spark.createDataFrame([(i, f"body {i}") for i in range(40)], "record_id long, record string")
    trees = [merkle.tree(merkle.archive_layout(x), 4) for x in (rows, rows.selectExpr("record_id", "case when record_id = 21 then 'body_21' else record end as record"))]
    assert [t.count() for t in trees[0]] == [40, 10, 3, 1]
    assert trees[0][-1].first()["hash"] != trees[1][-1].first()["hash"]
    assert [(r["file"], r["node"]) for r in merkle.differing_leaves(*trees, 4).collect()] == [(0, 21)]


BASE = [(i, f"record number {i} body") for i in range(200)]
ALTERED = [
    ([(i, r + "x" if i == 20 else r) for i, r in BASE], [("damaged", 20)]),
    ([(i, r[:-1] if i == 20 else r) for i, r in BASE], [("damaged", 20)]),
    ([(i, r.upper() if i == 20 else r) for i, r in BASE], [("damaged", 20)]),
    ([x for x in BASE if x[0] != 20], [("missing", 20)]),
    ([*BASE, (200, "new"), (20, "second 20")], [("inserted", 20), ("inserted", 200)]),
    ([(i, BASE[31 if i == 20 else 20 if i == 31 else i][1]) for i, _ in BASE], [("damaged", 20), ("damaged", 31)]),
    (BASE, []),
]


@pytest.fixture(scope="module")
def intact(spark):
    from rulewright.llm import common

    return common.staged(merkle.archive_layout(spark.createDataFrame(BASE, "record_id long, record string")), "t")


@pytest.mark.parametrize("rows,want", ALTERED)
def test_damage_is_located(spark, intact, rows, want):
    other = merkle.archive_layout(spark.createDataFrame(rows, "record_id long, record string"))
    assert sorted((r["status"], r["record_id"]) for r in merkle.audit(intact, other).collect() if not r["intact"]) == want


def test_records_out_of_order_are_located(spark, intact):
    for order, want in (([*range(20), *range(21, 150), 20, *range(150, 200)], [20]), ([*range(20), 150, *range(21, 150), 20, *range(151, 200)], [20, 150])):
        rows = intact.toPandas().set_index("record_id").loc[order].reset_index()
        rows["leaf"], rows["offset"] = range(200), rows.length.cumsum() - rows.length
        out = merkle.audit(intact, spark.createDataFrame(rows[intact.columns], intact.schema)).collect()
        assert sorted((r["status"], r["record_id"]) for r in out if not r["intact"]) == [("moved", i) for i in want]
    assert merkle.out_of_place([0, 1, 2]) == [] and merkle.out_of_place([]) == [] and len(merkle.out_of_place([3, 2, 1, 0])) == 3


def test_archives_read_back_as_they_were_laid_out(spark, data, tmp_path):
    from pyspark.sql import functions as F

    folder = f"file://{tmp_path}/warc"
    pages = spark.read.parquet(f"{data}/pages.parquet")
    records = pages.select(F.col("page_id").alias("record_id"), merkle.warc_record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))
    merkle.write_archives(records, folder, file_records=40)
    got = merkle.read_archives(spark, folder)
    assert got.where("name is null").count() == 0 and got.select("name").distinct().count() == pages.count()
    columns = ["file", "offset", "length", "digest"]
    assert canonical(got.select(columns).toPandas()) == canonical(merkle.archive_layout(records, file_records=40).select(columns).toPandas())


def test_crowded_ids_are_spread(spark):
    rows = [(7, f"c{k}") for k in range(900)] + [(None, f"n{k}") for k in range(900)] + [(i, f"r{i}") for i in range(50)]
    layout = merkle.archive_layout(spark.createDataFrame(rows, "record_id long, record string"), file_records=100)
    sizes = {r["file"]: r["count"] for r in layout.groupBy("file").count().collect()}
    assert sum(sizes.values()) == len(rows) and sizes[0] == 49 and max(sizes.values()) < 400


# -- 2 ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary(MODEL_PATH)


def all_paths(v, symbols):
    """Scores of every segmentation, by recursion without any pruning."""
    text = "".join(chr(s) if s < 0x110000 else "\0" for s in symbols)

    def walk(i):
        if i == len(symbols):
            return [0.0]
        out = []
        ends = [j for j in range(i + 1, min(len(symbols), i + v.longest) + 1) if text[i:j] in v.ids]
        for j in ends:
            out += [v.scores[v.ids[text[i:j]]] + s for s in walk(j)]
        if i + 1 not in ends:
            out += [v.unknown + s for s in walk(i + 1)]
        return out

    return sorted(walk(0), reverse=True)


@pytest.mark.parametrize("text", ["hello", "a b", "naïve!", "\n x", "▁a", "🙂", "日本語", "  ", "theerer"])
def test_nbest_equals_every_path(vocabulary, text):
    want = all_paths(vocabulary, pieces.symbols_of(text).tolist())
    got = pieces.nbest(vocabulary, text, 5)
    assert np.allclose([s for s, _ in got], want[: len(got)]) and len(got) == min(5, len(want))
    assert all(pieces.decode(vocabulary, ids) == text for _, ids in got)
    assert len({tuple(ids) for _, ids in got}) == len(got)


def test_blocks_equal_one_lattice(vocabulary, texts):
    rng = random.Random(3)
    for t in rng.sample(sorted(texts.values()), 25):
        a = rng.randrange(max(len(t) - 60, 1))
        part = t[a : a + 60]
        want = pieces.lattice_nbest(vocabulary, pieces.symbols_of(part).tolist(), 4)
        got = pieces.nbest(vocabulary, part, 4)
        assert np.allclose([s for s, _ in want], [s for s, _ in got])


def test_encoding_round_trip(spark, docs, texts):
    out = pieces.encode(docs, MODEL_PATH).persist()
    assert out.where("not round_trip").count() == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decode_column(out, MODEL_PATH).collect()}
    assert back == texts
    assert all(s == sorted(s, reverse=True) for s in (r["scores"] for r in out.select("scores").collect()))


def test_every_segmentation_is_returned(spark, docs, texts, vocabulary):
    out = pieces.encode(docs, MODEL_PATH).persist()
    paths = [{r["doc_id"]: r["ids"] for r in pieces.path_column(out, k).collect()} for k in range(pieces.NBEST)]
    assert any(r["scores"][0] > r["scores"][1] for r in out.select("scores").collect())
    for r in out.collect():
        own = [p[r["doc_id"]] for p in paths]
        assert own[0] == r["ids"] and sum(ids is not None for ids in own) == len(r["scores"])
        found = [ids for ids in own if ids is not None]
        assert len(set(map(tuple, found))) == len(found)
        for ids, score in zip(found, r["scores"], strict=True):
            assert pieces.decode(vocabulary, ids) == texts[r["doc_id"]]
            if all(i in vocabulary.scores for i in ids):
                assert np.isclose(sum(vocabulary.scores[i] for i in ids), score)


# -- 3 ------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, docs):
    out = langid.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.95 and out.score.between(0, 1).all()


def test_predictions_do_not_use_held_out_labels(spark, docs):
    from pyspark.sql import functions as F

    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit("zz")).otherwise(F.col("lang")))
    a, b = (canonical(langid.identify(spark, d).toPandas()) for d in (docs, swapped))
    assert a == b


def test_codewords():
    for n in (2, 4, 9, 20):
        c = langid.codewords(n)
        assert all((x != y).sum() == (c.shape[1] + 1) // 2 for x, y in combinations(c, 2))


def test_decoding_is_the_least_weighted_loss():
    rng = np.random.default_rng(2)
    codes = langid.codewords(5)
    model = langid.CodeModel([f"l{k}" for k in range(5)], rng.normal(size=(6, codes.shape[1])), rng.normal(size=codes.shape[1]), rng.random(codes.shape[1]))
    x = rng.normal(size=(40, 6))
    best, score, unsure = model.decode(x)
    for i, row in enumerate(x):
        losses = []
        for word in codes:
            loss = 0.0
            for b in range(len(word)):
                margin = min(max(float(row @ model.weights[:, b] + model.bias[b]), -3), 3)
                loss += model.trust[b] * np.exp(-margin * word[b])
            losses.append(loss)
        p = np.exp(-8 * np.array(losses)) / np.exp(-8 * np.array(losses)).sum()
        assert best[i] == int(np.argmin(losses)) and np.isclose(score[i], p.max()) and unsure[i] == (p.max() < langid.CERTAIN)


def test_every_language_is_learned(spark):
    rng = random.Random(1)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(40)] for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words[i % 300]) for _ in range(60)), f"l{i % 300:03}") for i in range(300 * 20)]
    out = langid.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] % 300:03}" for r in out]) > 0.98 and len({r["lang_pred"] for r in out}) > 290


# -- 4 ------------------------------------------------------------------------------------


def earliest_deadline_first(w, slots):
    """(source, block) of every slot, by a queue."""
    near, done, out = mixing.NEAR, [0] * len(w), []
    waiting, ready = [(0, i) for i in range(len(w)) if w[i] > 0], []
    heapq.heapify(waiting)
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (math.ceil((done[i] + 1) / w[i] - near), i))
        due, i = heapq.heappop(ready)
        assert due > t
        out.append((i, done[i]))
        done[i] += 1
        heapq.heappush(waiting, (math.floor(done[i] / w[i] + near), i))
    return out


@pytest.mark.parametrize("name,slots", [("thirds", 60_000), ("uneven", 12_000), ("many", 9_000)])
def test_runs_side_by_side_equal_one_schedule(spark, name, slots):
    rng = np.random.default_rng(1)
    w = {"thirds": np.array([1, 2]), "uneven": rng.pareto(1, 30) + 0.01, "many": rng.random(1_000) + 0.001}[name]
    w = w / w.sum()
    shares = spark.createDataFrame([(f"s{i:05}", 1, float(x)) for i, x in enumerate(w)], "source string, n long, w double")
    got = mixing._period_table(shares, slots).where(f"offset < {slots}").orderBy("offset").collect()
    assert [(int(r["source"][1:]), r["k"]) for r in got] == earliest_deadline_first(w.tolist(), slots)
    for i in (0, 1, len(w) - 1):
        own = np.array([r["offset"] for r in got if r["source"] == f"s{i:05}"])
        t = np.arange(1, slots + 1)
        assert (np.abs(np.searchsorted(own, t - 1, "right") - t * w[i]) < 1).all()


def test_very_many_sources(spark):
    rows = [(i, f"s{i % 5000}") for i in range(15_000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), {f"s{k}": 1.0 for k in range(0, 5000, 500)}, block_rows=1).toPandas()
    assert sorted(out.doc_id) == list(range(15_000)) and out.slot.is_unique


def test_rows_of_one_id_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LISTED", 50)
    rows = [(None, "a")] * 400 + [(5, "a")] * 3 + [(i, "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.mix(df, bucket_rows=20).toPandas()
    for s, part in out.groupby("source"):
        assert sorted(part.row_no) == list(range(sum(x == s for _, x in rows)))
    assert out.doc_id.isna().sum() == 400 and (out.doc_id == 5).sum() == 4
    assert mixing.mixed_order(df).count() == len(rows)



def test_schedule_deviates_by_less_than_a_block(docs):
    out = mixing.mix(docs, {"src0": 0.5, "src1": 0.3, "src2": 0.2}, block_rows=1, bucket_rows=7).toPandas()
    assert sorted(out.doc_id) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert (out.slot >= out.release).all() and (out.slot < out.deadline).all()
    assert out.slot.is_unique
    share = out.groupby("source").weight.first()
    last = out.groupby("source").slot.max()
    ends = int(last.min())
    for s, w in share.items():
        own = np.sort(out[out.source == s].slot)
        t = np.arange(1, ends + 2)
        assert (np.abs(np.searchsorted(own, t - 1, "right") - t * w) < 1).all()


def test_schedule_follows_the_given_weights(spark):
    """One large source among 20, over more slots than the shortest period."""
    given = {f"s{i:02}": 0.9 if i == 0 else 0.1 / 19 for i in range(20)} | {"none": 0.0}
    rows = [(i, "s00") for i in range(4_000)] + [(10_000 + i, f"s{1 + i % 19:02}") for i in range(1_900)] + [(20_000, "none"), (20_001, "none")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), given, block_rows=1).toPandas()
    assert sorted(out.doc_id) == sorted(i for i, _ in rows) and out.slot.is_unique
    assert (out.slot >= out.release).all() and (out.slot < out.deadline).all()
    t = np.arange(1, out[out.source == "s00"].slot.max() + 2)
    assert len(t) > 4_000
    for s, w in given.items():
        assert (np.abs(np.searchsorted(np.sort(out[out.source == s].slot), t - 1, "right") - t * w) < 1).all()


def test_rows_of_a_source_are_numbered_without_gaps(docs):
    out = mixing.mix(docs, bucket_rows=3).toPandas()
    for _, part in out.groupby("source"):
        assert sorted(part.row_no) == list(range(len(part)))


def test_mixed_order_keeps_rows(docs):
    places = {r["doc_id"]: (r["slot"], r["row_no"]) for r in mixing.mix(docs).collect()}
    ids = [r["doc_id"] for r in mixing.mixed_order(docs).collect()]
    assert sorted(ids) == sorted(places) and [places[i] for i in ids] == sorted(places.values())


# -- 5 ------------------------------------------------------------------------------------


def brute_scan(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    hits = [(i, label) for p, label in licenses.BASE.items() for q in (p.split(),) for i in range(len(words)) if words[i : i + len(q)] == q]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({b for _, b in hits}))


def test_scan_equals_brute_force(docs, texts):
    extra = {-1: "MIT License, mit license mit-license; Apache\nLicense GENERAL PUBLIC LICENSE v3 é", -2: None, -3: "mit licenses", -4: "lesser general public license mit license"}
    for i, t in (texts | extra).items():
        got = licenses.scan(t)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == brute_scan(t), i
    got = {r["doc_id"]: r["n_base"] for r in licenses.license_scan(docs).collect()}
    assert got == {i: brute_scan(t)[1] for i, t in texts.items()}


@pytest.mark.parametrize(
    "text,names,duty",
    [
        ("MIT", ("MIT",), 1),
        ("MIT OR Apache-2.0 AND GPL-3.0-only", ("MIT", "Apache-2.0", "GPL-3.0-only"), 1),
        ("(MIT or Apache-2.0) and GPL-3.0", ("MIT", "Apache-2.0", "GPL-3.0"), 3),
        ("GPL-2.0-only WITH Classpath-exception-2.0", ("GPL-2.0-only",), 2),
        ("LGPL-2.1 */", ("LGPL-2.1",), 2),
    ],
)
def test_expressions(text, names, duty):
    found = licenses.evaluate(text)
    assert found.names == names and found.duty == duty


@pytest.mark.parametrize("text", ["", "AND MIT", "(MIT", "MIT OR", "()"])
def test_malformed_expressions(text):
    assert licenses.evaluate(text) is None


def test_tags_reach_labels():
    got = licenses.scan("// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\ncode")
    assert got["labels"] == "gpl,mit" and got["expressions"] == ["(MIT OR GPL-2.0-only)"] and got["n_valid"] == 1 and 0 < got["score"] <= 1


def test_tags_of_one_line_and_long_expressions():
    got = licenses.scan("/* SPDX-License-Identifier: MIT */ int a; // SPDX-License-Identifier: Apache-2.0 */ SPDX-License-Identifier: (GPL-2.0 OR\nMPL-2.0)")
    assert got["expressions"] == ["MIT */ int a; //", "Apache-2.0 */", "(GPL-2.0 OR"]
    assert got["labels"] == "apache,mit" and got["n_valid"] == 2
    names = [f"LicenseRef-{i}" for i in range(20_000)]
    long = f"({' OR '.join(names)} OR (ISC AND Zlib))"
    got = licenses.scan(f"SPDX-License-Identifier: {long}\nMPL-2.0")
    assert got["labels"] == "isc,zlib" and got["n_valid"] == 1 and got["expressions"] == [long]
    assert licenses.evaluate(long).names == (*names, "ISC", "Zlib")


def test_unknown_words_are_no_licences():
    got = licenses.scan("SPDX-License-Identifier: foo\nSPDX-License-Identifier: mit or bar\nSPDX-License-Identifier: (MIT AND (gpl-2.0-or-later with classpath-exception-2.0))")
    assert got["duties"] == [None, None, 2] and got["n_valid"] == 1 and got["labels"] == "gpl,mit"
    assert got["normalised"] == ["foo", "MIT OR bar", "MIT AND GPL-2.0-or-later WITH Classpath-exception-2.0"]
    assert licenses.scan("SPDX-License-Identifier: MIT OR")["normalised"] == [None]


@pytest.mark.parametrize("text", ["MIT OR Apache-2.0 AND GPL-3.0-only", "(MIT OR Apache-2.0) AND GPL-3.0-only", "(MIT OR ISC OR (X11 AND Zlib)) AND (Vim AND curl)", "MIT AND (ISC OR (Ruby AND (PHP-3.0 OR 0BSD)))"])
def test_normalised_expressions_mean_the_same(text):
    """Both forms are true for the same sets of licences."""
    once = str(licenses.evaluate(text))
    assert str(licenses.evaluate(once)) == once
    names = re.findall(r"[A-Za-z0-9.-]+", re.sub(r"\b(OR|AND)\b", " ", text))
    as_python = [re.sub(r"[A-Za-z0-9.-]+", lambda m: m[0].lower() if m[0] in ("OR", "AND") else f"({m[0]!r} in have)", x) for x in (text, once)]
    for mask in range(1 << len(names)):
        have = {n for k, n in enumerate(names) if mask >> k & 1}
        assert eval(as_python[0], {"have": have}) == eval(as_python[1], {"have": have})


# -- 6 ------------------------------------------------------------------------------------


def test_media_columns(docs, texts):
    out = media.media_columns(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(padded)
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-16:])
        assert r["media_bytes"] == len(padded) + 44 and r["media_sha256"] == hashlib.sha256(media.to_wav(padded)).hexdigest()


def test_media_features_equal_plain_sums(texts):
    for t in [*list(texts.values())[:30], "", None, "a" * 500, "aé\n" * 70]:
        x = [b - 128 for b in media.payload(t)[1]]
        mean = sum(x) / len(x)
        crossings = sum((a > mean) != (b > mean) for a, b in zip(x, x[1:], strict=False)) / max(len(x) - 1, 1)
        energy = [sum(v * v for v in x[k : k + 192]) for k in range(0, len(x), 192)]
        got = dict(p.split("=") for p in media.features(bytes(v + 128 for v in x)).split(";"))
        assert int(got["frames"]) == len(energy) and abs(float(got["mean"]) - mean) < 1e-4 and abs(float(got["sd"]) - math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))) < 1e-3
        assert float(got["peak"]) == max(map(abs, x)) and abs(float(got["crossings"]) - crossings) < 1e-6 and energy[int(got["loudest"])] >= max(energy) * (1 - 1e-6)


def test_members_are_tried_again_by_offset(spark, docs, tmp_path):
    from pyarrow import fs

    folder = f"file://{tmp_path}/a"
    assert media.write_archives(docs.select("doc_id", "text").coalesce(1), folder)[0] == docs.count()
    reader = media.MediaReader(folder)
    part = reader.partitions()[0]
    store, _ = fs.FileSystem.from_uri(folder)

    class Flaky:
        opened = 0

        def open_input_file(self, path):
            Flaky.opened += 1
            if Flaky.opened == 2:
                raise OSError("gone")
            return store.open_input_file(path)

    members = media.MemberReader(Flaky(), part.archive, wait_s=0)
    first = members.member(part.start)
    members.file = None
    assert members.member(part.start) == first and Flaky.opened == 3
    path = part.archive
    raw = bytearray(open(path, "rb").read())
    raw[part.start + 60] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="damaged member"):
        media.MemberReader(store, path, wait_s=0).member(part.start)


def test_byte_ranges_cover_members_once(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "RANGE_BYTES", 20_000)
    folder = f"file://{tmp_path}/b"
    store, base = media._open(folder)
    store.create_dir(base)
    import pyarrow as pa

    rows = docs.select("doc_id", "text").toPandas()
    from unittest import mock

    with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda: 0)):
        list(media._writer(folder)(iter([pa.RecordBatch.from_pandas(rows, preserve_index=False)])))
    reader = media.MediaReader(folder)
    parts = reader.partitions()
    assert len(parts) > 3
    ids = [i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()]
    assert sorted(ids) == sorted(rows.doc_id)


# -- 7 ------------------------------------------------------------------------------------


def test_merged_runs(spark):
    rng = random.Random(4)
    rows = [(i, bytes([rng.randrange(5), rng.randrange(3)]) * 16, 10) for i in range(400)]
    out = exact.tree_merge(spark.createDataFrame(rows, "doc_id long, digest binary, n_bytes long").repartition(6), radix=2, records=60).collect()
    want = defaultdict(list)
    for i, d, _ in rows:
        want[d].append(i)
    assert {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in out} == {d: (min(v), len(v)) for d, v in want.items()}


# -- 8 ------------------------------------------------------------------------------------


def test_losses_equal_plain_counts(spark, docs, texts):
    targets = docs.where("doc_id % 3 = 0").select("doc_id")
    got = {r["doc_id"]: r for r in crossentropy.score(docs, targets).collect()}
    cells = {i: (u, b) for i, (u, b) in zip(texts, ((u, b) for _, u, b in crossentropy.cell_texts(list(texts.values()))), strict=True)}
    uni, bi, starts = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    for i, (u, b) in cells.items():
        side = 0 if i % 3 == 0 else 1
        uni[side].update(u.tolist())
        bi[side].update(b.tolist())
        starts[side] += len(u) > 0
    totals = [sum(c.values()) for c in uni]
    for i in list(texts)[:40]:
        u, b = cells[i]
        losses = []
        for side in (0, 1):
            logs = []
            for k in range(len(u)):
                p1 = (uni[side][u[k]] + crossentropy.SMOOTH) / (totals[side] + crossentropy.SMOOTH * crossentropy.UNI)
                context = uni[side][u[k - 1]] if k else starts[side]
                c = bi[side][b[k]]
                logs.append(-np.log2(crossentropy.BIGRAM * (c + p1) / (max(context, c) + 1) + (1 - crossentropy.BIGRAM) * p1))
            losses.append(np.mean(logs))
        assert np.isclose(got[i]["difference"], losses[0] - losses[1]) and got[i]["n_tokens"] == len(u)


def test_targets_score_lower(docs):
    out = crossentropy.score(docs, docs.where("lang = 'fr'").select("doc_id")).join(docs, "doc_id").groupBy("lang").avg("difference").collect()
    by = {r[0]: r[1] for r in out}
    assert by["fr"] < 0 < min(v for k, v in by.items() if k != "fr")


def test_every_word_and_bigram_has_counts_of_its_own(spark):
    """More distinct words than 2**17, against counts of the words themselves."""
    rng = random.Random(5)
    texts = {i: " ".join(f"{'ab'[i % 2]}{rng.randrange(10**6)}" for _ in range(500)) for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in crossentropy.score(df, df.where("doc_id % 2 = 0").select("doc_id"), least_vocabulary=0).collect()}
    uni, bi, starts, words = (Counter(), Counter()), (Counter(), Counter()), [0, 0], set()
    for i, t in texts.items():
        w = t.split()
        uni[i % 2].update(w)
        bi[i % 2].update(zip(w, w[1:]))
        starts[i % 2] += 1
        bi[i % 2][None, w[0]] += 1
        words |= set(w)
    assert len(words) > 1 << 17
    for i in range(40):
        w = texts[i].split()
        losses = []
        for side in (0, 1):
            logs = []
            for u, x in zip([None, *w], w):
                p1 = (uni[side][x] + crossentropy.SMOOTH) / (200 * 500 + crossentropy.SMOOTH * len(words))
                context = uni[side][u] if u else starts[side]
                logs.append(-np.log2(crossentropy.BIGRAM * (bi[side][u, x] + p1) / (context + 1) + (1 - crossentropy.BIGRAM) * p1))
            losses.append(np.mean(logs))
        assert np.isclose(got[i]["target_loss"], losses[0]) and np.isclose(got[i]["background_loss"], losses[1])


def test_a_text_is_no_evidence_for_itself(spark):
    """Scores without own counts are those of models that never saw the text."""
    rng = random.Random(6)
    texts = {i: " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 40))) for i in range(30)} | {30: "", 31: None}
    rows = [(i, t) for i, t in texts.items()]
    df, targets = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(0, 32, 3)], "doc_id long")
    got = {r["doc_id"]: r for r in crossentropy.score(df, targets, least_vocabulary=0, own_counts=False).collect()}
    words = {w for t in texts.values() for w in (t or "").split()}
    for i in range(30):
        w, losses = texts[i].split(), []
        for side in (0, 1):
            seen = [texts[j].split() for j in range(30) if j != i and (j % 3 == 0) == (side == 0)]
            uni, bi = Counter(x for t in seen for x in t), Counter(p for t in seen for p in zip([None, *t], t))
            logs = []
            for u, x in zip([None, *w], w):
                p1 = (uni[x] + crossentropy.SMOOTH) / (sum(uni.values()) + crossentropy.SMOOTH * len(words))
                context = uni[u] if u else len(seen)
                logs.append(-np.log2(crossentropy.BIGRAM * (bi[u, x] + p1) / (context + 1) + (1 - crossentropy.BIGRAM) * p1))
            losses.append(np.mean(logs))
        assert np.isclose(got[i]["target_loss"], losses[0]) and np.isclose(got[i]["background_loss"], losses[1])
    assert got[30]["difference"] is None and got[31]["n_tokens"] == 0


# -- 9 ------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def brute_components(texts, percent=80):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_components_equal_all_pairs(docs, texts):
    for percent, perms in ((80, 150), (85, 96)):
        out = minmax.near_duplicates(docs, threshold=(percent, 100), perms=perms).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(texts, percent)


def test_large_families_are_compared_in_tiles(spark, monkeypatch):
    """A group of near copies around the threshold, larger than a small bucket and a tile."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        t = list(base)
        for _ in range(rng.choice((0, 1, 2, 3))):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(t)
    monkeypatch.setattr(minmax, "TILE_SHINGLES", 3_000)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minmax.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common_part = rng.integers(0, 2**63, 800).astype(np.uint64)
    a, b = (np.concatenate((common_part, rng.integers(0, 2**63, 100).astype(np.uint64))) for _ in range(2))
    sig = minmax.signatures(np.concatenate((minmax.mixed(a), minmax.mixed(b))), np.array([0, 900]), 400)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.05


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (100, 100)]
    out = {r["node"]: r["comp"] for r in minmax.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[101] == 100


# -- 10 -----------------------------------------------------------------------------------


def test_quality_on_rows_kept_out(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/labels.parquet")
    out = quality.classify(docs, labels.where("doc_id % 4 <> 0")).join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    poor, clean = out[out.quality == 0], out[(out.quality == 1) & (out.toxic == 0)]
    assert (~poor.kept).mean() >= 0.9 and clean.kept.mean() >= 0.9
    tails = np.stack(out.tails)
    assert (tails[:, 0] >= tails[:, 1]).all() and np.allclose(tails.sum(1), out.expected_grade)


def test_gradient_fits_ordered_grades():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 600)
    rows = [np.unique(np.concatenate((300 + rng.integers(0, 40, 5), [400 + g] * (rng.random() < 0.95)))).astype(np.int64) for g in grades]
    model = quality.fit(rows, grades, cells=1000)
    scores = np.array([model.weights[r].sum() for r in rows])
    expected = model.tails(scores).sum(1)
    assert model.thresholds[0] < model.thresholds[1] and np.corrcoef(expected, grades)[0, 1] > 0.9


def test_features_of_a_text_are_those_of_its_words(texts):
    """Whole texts, long ones too: the cells of words are the union of the cells of each word alone."""
    given = [*list(texts.values())[:20], None, "", "Ünïcode wörds; and-more 12ab", " ".join(f"word{i % 977} other{i % 13}" for i in range(200_000))]
    words = [sorted(set(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())))) for t in given]
    every = sorted(set().union(*map(set, words)))
    alone = {}
    for (_, cells), w in zip(quality.text_features([w.decode("utf-8", "surrogateescape") if w.isascii() else w.decode() for w in every]), every, strict=True):
        alone[w] = set(cells[cells >= 256].tolist())
    for (_, cells), own in zip(quality.text_features(given), words, strict=True):
        assert set(cells[cells >= 256].tolist()) == set().union(*(alone[w] for w in own))


def test_classification_is_the_sum_of_weights(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality.learn(docs.select("doc_id", "text"), quality.graded(labels))
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    for r in docs.limit(40).collect():
        ((_, cells),) = quality.text_features([r["text"]])
        score = sum(float(model.weights[c]) for c in cells)
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        own = got[r["doc_id"]]
        assert math.isclose(own["score"], score, abs_tol=1e-4) and np.allclose(own["tails"], tails, atol=1e-4) and math.isclose(own["expected_grade"], sum(tails), abs_tol=1e-4)
        assert own["kept"] == (own["tails"][1] >= 0.5)


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    n, size = 40, 6
    grades = rng.integers(0, 3, n)
    row, column = np.repeat(np.arange(n), 3), rng.integers(0, size, 3 * n)
    scale, importance = rng.random(size) + 0.5, rng.random(n)
    p = rng.normal(size=size + 2) * 0.3
    loss, gradient = quality.objective(p, row, column, scale, grades, importance, 3)
    t = [p[size], p[size] + np.exp(p[size + 1])]
    plain = quality.DECAY / 2 * (p[:size] ** 2).sum()
    for i in range(n):
        s = sum(p[c] * scale[c] for c in column[row == i])
        below = [0.0, *(1 / (1 + np.exp(s - x)) for x in t), 1.0]
        plain -= importance[i] * np.log(below[grades[i] + 1] - below[grades[i]])
    assert np.isclose(loss, plain)
    for k in range(len(p)):
        step = np.zeros(len(p))
        step[k] = 1e-6
        up, down = (quality.objective(p + d, row, column, scale, grades, importance, 3)[0] for d in (step, -step))
        assert np.isclose((up - down) / 2e-6, gradient[k], atol=1e-6)


def test_a_bound_on_cells_takes_fewer_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    whole, part = (quality.learn(docs, quality.graded(labels), fit_cells=n) for n in (10**9, 20_000))
    assert not np.array_equal(whole.weights, part.weights) and np.isfinite(part.weights).all()


# -- pipeline -----------------------------------------------------------------------------


def test_pipeline_equals_plain_python(spark, data, docs, texts):
    import corpus_pipeline

    labels = spark.read.parquet(f"{data}/labels.parquet")
    left = {r["doc_id"] for r in quality.classify(docs, labels).where("kept").collect()}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    left = set(first.values())
    sets = {i: shingles(texts[i]) for i in left}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(left), 2):
        n = len(sets[a] & sets[b])
        if n and 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    left = {i for i in left if find(i) == i}
    out = corpus_pipeline.run(spark, data).toPandas().sort_values(["mix_file", "mix_row"])
    assert sorted(out.doc_id) == sorted(left) and out.round_trip.all()
    places = mixing.mix(docs.where(docs.doc_id.isin(sorted(left)))).orderBy("slot", "row_no").collect()
    assert [r["doc_id"] for r in places] == out.doc_id.tolist()


def test_stages_decide_by_row(spark):
    import corpus_pipeline

    rows = [(1, "x a"), (5, "x a"), (5, "y b"), (None, "z q"), (None, "z q"), (7, "x  a"), (1, "x a"), (None, None), (9, "")]
    out = corpus_pipeline.exact_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in out) == [(0, "z q"), (1, "x a"), (5, "y b"), (9, "")]
    a, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "wv")
    rows = [(3, a), (5, a + " zz"), (5, c), (6, c + " u"), (None, a), (None, c + " t"), (5, c), (5, "z " + c), (8, None), (8, None)]
    out = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert [r["doc_id"] for r in out if r["text"] is None] == [8, 8] and (3, a) in {tuple(r) for r in out}
    assert sorted(r["doc_id"] for r in out if r["text"]) == [3, 5]


def test_intermediate_tables_need_a_shared_folder():
    from rulewright.llm import common

    assert common.is_local("local[4]") and common.is_local("local") and not common.is_local("spark://host:7077") and not common.is_local("local-cluster[2,1,1024]")


def test_spread_join_splits_hot_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from rulewright.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    rows = spark.createDataFrame([(k % 7 if k % 2 else 0,) for k in range(100)] + [(None,), (99,)], "x long")
    keys = rows.where("x <> 99").groupBy(F.col("x").alias("k")).agg(F.count("*").alias("n"))
    out = common.spread_join(rows, keys, F.col("x") == F.col("k"), "n", 102).collect()
    want = Counter(r["x"] for r in rows.collect())
    assert Counter(r["x"] for r in out) == want and all(r["n"] == (want[r["x"]] if r["x"] not in (None, 99) else None) for r in out)


def test_components_with_hot_centres(spark, monkeypatch):
    from rulewright.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    edges = [(0, i) for i in range(1, 200)] + [(300 + i, 300 + i + 1) for i in range(40)]
    out = {r["node"]: r["comp"] for r in minmax.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(200)) and all(out[300 + i] == 300 for i in range(41))
