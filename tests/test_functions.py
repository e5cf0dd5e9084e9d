import math

import numpy as np
import plain_series
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulewright.functions import arrays, catch22, signal, treatments, windows
from rulewright.functions.windows import Windowing

NAN = float("nan")


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=rng.integers(5, 60))]) for i in range(20)]
    return spark.createDataFrame([*rows, (20, [2.5]), (21, []), (22, None), (23, [1.0, NAN, 3.0]), (24, [4.0] * 9)], "id int, s array<double>").persist()


REFERENCE = {
    "minimum": np.min, "maximum": np.max, "mean": np.mean, "median": np.median, "sum": np.sum,
    "std": lambda x: np.std(x, ddof=1) if len(x) > 1 else NAN, "var": lambda x: np.var(x, ddof=1) if len(x) > 1 else NAN,
}


@pytest.mark.parametrize("name", REFERENCE)
def test_reductions(series, name):
    for r in series.select("s", arrays.feature(name)(F.col("s")).alias("v")).collect():
        if not r["s"]:
            assert r["v"] is None or name == "sum"
        else:
            assert np.isclose(r["v"], REFERENCE[name](np.array(r["s"])), equal_nan=True), r["s"]


def test_expressions_equal_kernels(series):
    for name in ("trev", "high_fluctuation", "stretch_decreasing", "stretch_high"):
        out = series.where("id < 20").select("s", arrays.REGISTRY[name](F.col("s")).alias("v")).collect()
        assert all(np.isclose(r["v"], catch22.compute(name, r["s"])) for r in out), name


def test_patched_features_and_lookup(series):
    plus, minus = (series.where("id = 20").select(arrays.feature(n)(F.col("s")).alias("v")).first()["v"] for n in ("std+", "std-"))
    assert plus == -math.inf and minus == math.inf
    assert arrays.feature("avg") is arrays.mean and len(arrays.feature_set("catch9")) == 9 and len(arrays.feature_set("catch22")) == 22
    for bad in ("nothing", ["mean", "nothing"]):
        with pytest.raises(KeyError):
            arrays.feature_set(bad)


def test_parse_feature(series):
    f = arrays.parse_feature("min[V1]")
    assert f.variable == 1 and f.fun == "minimum" and f.name == "minimum[V1]" and arrays.is_collapsing(f)
    assert series.where("id = 20").select(f.column(["s"]).alias("v")).first()["v"] == 2.5
    assert arrays.parse_feature("temperature").fun is None
    for bad in ("min[", "a b", "", "min[x]"):
        with pytest.raises(ValueError):
            arrays.parse_feature(bad, names=["s"])
    with pytest.raises(KeyError):
        arrays.parse_feature("eval[V1]")
    assert arrays.round_numbers("a 1.23456 b 2") == "a 1.23 b 2"


def test_array_algebra(series):
    e = F.col("s")
    out = series.where("id < 20").select("s", arrays.resample(e, 7).alias("r"), arrays.pad_or_cut(e, 30).alias("p"), arrays.clip(e, -1, 1).alias("c"), arrays.cumulative(e).alias("cum"), arrays.differences(e).alias("d"), arrays.soft_minimum(e, 0.25).alias("q")).collect()
    for r in out:
        x = np.array(r["s"])
        assert np.allclose(r["r"], np.interp(np.linspace(0, len(x) - 1, 7), np.arange(len(x)), x))
        assert len(r["p"]) == 30 and np.allclose(r["p"][: min(30, len(x))], x[:30])
        assert np.allclose(r["c"], x.clip(-1, 1)) and np.allclose(r["cum"], np.cumsum(x)) and np.allclose(r["d"], np.diff(x))
        assert np.isclose(r["q"], np.quantile(x, 0.25))
    with pytest.raises(ValueError):
        arrays.soft_maximum(e, 1.0)


# -- windows --------------------------------------------------------------------------------


@given(st.integers(1, 200), st.integers(1, 12), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.8]))
def test_overlapping_windows_fit(length, n, overlap):
    try:
        found = windows.overlapping(length, n, overlap)
    except ValueError:
        return
    assert len(found) == n and found[0][0] == 1 and len({w for _, w in found}) == 1
    assert all(lo + w - 1 <= length for lo, w in found)


def test_window_arithmetic():
    assert windows.overlapping(100, 5, 0.5) == [(1 + 16 * i, 33) for i in range(5)]
    assert windows.segments(10, 4) == [(1, 3), (4, 2), (6, 2), (8, 3)]
    assert windows.moving_windows(100, 1) == [(1, 100)] and len(windows.moving_windows(100, 7)) == 7
    assert windows.tiled(10, 3) == [(1, 3), (4, 3), (7, 3)]
    for bad in ({"kind": "none"}, {"n": 0}, {"overlap": 1.0}, {"kind": "tiled"}):
        with pytest.raises(ValueError):
            Windowing(**bad)


def test_row_bounds_equal_driver_bounds(series):
    for r in series.where("size(s) > 0").select("s", windows.window_bounds(F.size("s"), 3, 0.25).alias("b")).collect():
        try:
            want = windows.overlapping(len(r["s"]), 3, 0.25)
        except ValueError:
            want = []
        assert [(w["lo"], w["n"]) for w in r["b"]] == want


def test_frames_medians_and_intervals(series):
    out = series.where("id < 20").select("s", windows.frames(F.col("s"), 6, 2).alias("f"), windows.moving_median(F.col("s"), 5).alias("m")).collect()
    for r in out:
        x = np.array(r["s"])
        assert np.allclose(np.array(r["f"]).reshape(-1, 6), signal.frames(x, 6, 2))
        assert np.allclose(r["m"], signal.moving_median(x, 5))
    w = windows.all_intervals(F.size("s"), 3)
    r = series.where("id = 23").select(w.alias("w"), F.size(windows.related(w, F.element_at(w, 1), "A")).alias("after"), windows.on_intervals(F.col("s"), w, "maximum").alias("v")).first()
    assert len(r["w"]) == 6 and r["after"] == 2 and sum(v != v for v in r["v"]) == 4


# -- treatments -----------------------------------------------------------------------------


def test_wide_and_long_agree(series):
    df = series.where("id < 5")
    wide = treatments.aggregate(df, ["s"], ["mean", "maximum"], Windowing("segments", 2), 60, ["id"]).collect()
    long = {(r["row_id"], r["fun"], r["win"]): r["value"] for r in treatments.long_features(df, "id", ["s"], ["mean", "maximum"], Windowing("segments", 2), 60).collect()}
    for r in wide:
        assert list(r.asDict())[1:] == ["mean(s)w1", "mean(s)w2", "maximum(s)w1", "maximum(s)w2"]
        assert all(np.isclose(r[f"{f}(s)w{w}"], long[r["id"], f, w], equal_nan=True) for f in ("mean", "maximum") for w in (1, 2))
    assert all(math.isnan(r["mean(s)w2"]) for r in wide)  # rows shorter than the window


def test_dimension_and_lengths(spark, series):
    assert treatments.dimension(series, ["s"]) == 1 and treatments.dimension(series, ["id"]) == 0
    for bad in (["id", "s"], []):
        with pytest.raises(TypeError):
            treatments.dimension(series, bad)
    with pytest.raises(ValueError):
        treatments.uniform_length(series, ["s"])
    assert treatments.uniform_length(series.where("id = 24"), ["s"]) == 9


def test_special_values_and_scaling(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 10.0), (3, "a", NAN), (4, "b", 5.0), (5, "a", math.inf)], "id int, fun string, value double")
    out = {r["id"]: r["value"] for r in treatments.normalise_groups(df, by=("fun",)).collect()}
    assert out == {1: 0.0, 2: 1.0, 3: 0.5, 4: 0.5, 5: 0.5}
    special = [r[0] for r in df.orderBy("id").select(treatments.replace_special(F.col("value"), -1.0, 9.0)).collect()]
    assert special == [0.0, 10.0, -1.0, 5.0, 9.0]
    flat = treatments.standardise(df.where("id in (1, 2)"), ["value"], True, False)
    assert sorted(r["value"] for r in flat.collect()) == [-5.0, 5.0]
    near = treatments.jitter(df.where("id in (1, 2)"), ["value"], 1).collect()
    assert all(abs(r["value"] - w) < 1e-6 for r, w in zip(sorted(near, key=lambda r: r["id"]), (0.0, 10.0), strict=True))


# -- canonical features ----------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=80))
def test_canonical_features_never_fail(x):
    for name in catch22.FEATURES:
        v = catch22.compute(name, x)
        assert v is not None and (v != v or math.isfinite(v)), name


def test_batches_equal_plain_features():
    """Every feature of random, smooth, rounded, constant and short series against one series at a time."""
    rng = np.random.default_rng(1)
    rows = []
    for n in (1, 2, 3, 5, 7, 12, 30, 64, 101, 200):
        for k in range(8):
            x = rng.normal(size=n) if k % 3 == 0 else np.cumsum(rng.normal(size=n)) if k % 3 == 1 else np.sin(np.arange(n) / (2 + k)) + 0.1 * rng.normal(size=n)
            rows.append(np.round(x) if k == 5 else np.full(n, 3.0) if k == 6 else np.arange(n) % 4 * 1.0 if k == 7 else x)
    got = catch22.batch(list(catch22.FEATURES), [*rows, None, [], [1.0, NAN, 2.0]])
    assert np.isnan(got[-3:]).all()
    for x, own in zip(rows, got, strict=False):
        want = [plain_series.compute(name, x) for name in catch22.FEATURES]
        assert np.allclose(own, want, rtol=1e-6, atol=1e-9, equal_nan=True)


def test_inverse_cosine_transform():
    x = np.random.default_rng(2).normal(size=(3, 16))
    c = x @ signal.dct_matrix(16, 16).T
    assert np.allclose(signal.inverse_dct(c), x) and np.allclose(signal.inverse_dct(x, kind=3), c)
    assert np.allclose(signal.inverse_dct(c[:, :4], 16), c[:, :4] @ signal.dct_matrix(16, 4))
    with pytest.raises(ValueError):
        signal.inverse_dct(c, kind=4)


def test_canonical_features_of_a_wave():
    t = np.arange(400)
    x = np.sin(2 * np.pi * t / 20)
    assert abs(catch22.compute("periodicity", x) - 20) <= 1
    assert abs(catch22.compute("centroid_freq", x) - 2 * np.pi / 20) < 0.05
    assert abs(catch22.compute("trev", x)) < 0.05 and catch22.compute("acf_first_min", x) == 10
    assert abs(catch22.compute("acf_timescale", x) - 20 * np.arccos(1 / np.e) / (2 * np.pi)) < 0.1 and 9 <= catch22.compute("stretch_high", x) <= 11
    noise = np.random.default_rng(0).normal(size=2000)
    assert catch22.compute("entropy_pairs", noise) > 2.1 and abs(catch22.compute("outlier_timing_pos", noise)) < 0.3


# -- signal -----------------------------------------------------------------------------------

RATE = 8000
TONE = np.sin(2 * np.pi * 200 * np.arange(RATE) / RATE)
VOICE = sum(np.sin(2 * np.pi * 120 * k * np.arange(RATE) / RATE) / k for k in range(1, 12))


def test_spectrum_of_a_tone():
    spec, freqs = signal.stft(TONE, RATE)
    assert spec.shape == ((RATE - 256) // 128 + 1, 129) and abs(freqs[spec[5].argmax()] - 200) <= RATE / 256
    frame = TONE[:256] * signal.window_function("hann", 256)
    both = np.concatenate((spec[0], spec[0][1:-1]))
    assert np.isclose(both.sum() / 256, (frame**2).sum())
    assert np.allclose(signal.window_function("hann", 1), 1)
    with pytest.raises(ValueError):
        signal.window_function("none", 8)


@pytest.mark.parametrize("scale", signal.SCALES)
def test_scales_invert(scale):
    to, back = signal.SCALES[scale]
    f = np.array([60.0, 440.0, 999.0, 1001.0, 3500.0])
    assert np.allclose(back(to(f)), f, rtol=1e-6)


def test_filterbanks_and_cepstra():
    edges = signal.band_edges("mel_htk", 20, 0, RATE / 2)
    bank = signal.triangular_filterbank(edges, 256, RATE, "area")
    sums = bank.sum(1)
    assert bank.shape == (20, 129) and np.allclose(sums[sums > 0], 1)
    tones = signal.gammatone_bank(10, 512, RATE, 100, 3500)
    peaks = tones.argmax(1) * RATE / 512
    assert (np.diff(peaks) > 0).all() and np.allclose(tones.max(1), 1, atol=0.1)
    m = signal.dct_matrix(20, 20)
    assert np.allclose(m @ m.T, np.eye(20))
    spec, _ = signal.stft(TONE, RATE)
    c = signal.cepstra(signal.band_spectrum(spec, bank), 13)
    assert c.shape == (len(spec), 13) and signal.deltas(c).shape == c.shape
    assert len(signal.tuned_edges(12)) == 14


@pytest.mark.parametrize("method", ["nfc", "cep", "srh", "lhs", "pef"])
def test_pitch(method):
    f0 = signal.pitch(VOICE, RATE, method)
    assert len(f0) and abs(np.median(f0) - 120) < 6


def test_harmonic_ratio_and_prediction():
    noise = np.random.default_rng(1).normal(size=RATE)
    assert np.median(signal.harmonic_ratio(VOICE, RATE)) > 0.9 > 0.6 > np.median(signal.harmonic_ratio(noise, RATE))
    x = np.zeros(3000)
    for i in range(2, 3000):
        x[i] = 1.2 * x[i - 1] - 0.5 * x[i - 2] + noise[i]
    a, e = signal.linear_prediction(x, 2)
    assert np.allclose(a, [1, -1.2, 0.5], atol=0.05) and e > 0
    assert np.isnan(signal.mask_pitch(np.array([1.0, 2.0]), np.array([0.5, 0.9]))[0])


@pytest.mark.parametrize("kind", ["morse", "morlet", "bump"])
def test_wavelets(kind):
    bank, freqs = signal.wavelet_bank(kind, 2000, RATE, low=50)
    power = np.abs(signal.wavelet_transform(TONE[:2000], bank)).mean(1)
    assert abs(freqs[power.argmax()] - 200) < 20 and np.isclose(bank.max(), 2, atol=0.1)


def test_speech_runs():
    rng = np.random.default_rng(5)
    quiet = rng.normal(size=RATE) * 0.001
    loud = rng.normal(size=RATE)
    found = signal.detect_speech(np.concatenate((quiet, loud, quiet)), RATE)
    assert len(found) == 1 and abs(found[0][0] - RATE) < 1000 and abs(found[0][1] - 2 * RATE) < 1000
    assert signal.runs(np.array([1, 1, 0, 1], bool)).tolist() == [[0, 2], [3, 4]]


def test_clip_tables(spark):
    clips = spark.createDataFrame([("a", RATE, TONE.tolist()), ("b", RATE, None), ("c", RATE, [])], "path string, sr int, samples array<double>")
    for kind, n in (("mel", 26), ("mfcc", 13), ("spectrals", 11)):
        out = {r["path"]: r for r in signal.audio_features(clips, kind).collect()}
        assert len(out["a"]["values"]) == n and out["b"]["values"] is None and out["c"]["values"] is None
