"""The 22 canonical time-series features (Lubba et al. 2019, doi:10.1007/s10618-019-00647-x).

Each works on the z-scored series. A constant series, or one too short for a feature, gives
NaN or the value that the definition has for it. In Spark they run as Arrow batches: the series of
one length in a batch are the rows of a matrix, and every step is taken for all of them at
once. Those that are plain reductions also exist as expressions in ``arrays``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
#: Values of a matrix that are worked on together, about.
BLOCK_VALUES = 1 << 18


def zscore(x: np.ndarray) -> np.ndarray:
    """Rows less their mean and over their sample deviation; constant rows become 0."""
    x = x - x.mean(axis=1, keepdims=True)
    s = x.std(axis=1, ddof=1, keepdims=True) if x.shape[1] > 1 else np.zeros((len(x), 1))
    return np.where(s > 0, x / np.where(s > 0, s, 1), 0.0)


def autocorrelation(y: np.ndarray) -> np.ndarray:
    """Autocorrelation of each row at all lags by FFT."""
    n = y.shape[1]
    y = y - y.mean(axis=1, keepdims=True)
    f = np.fft.rfft(y, 2 ** int(np.ceil(np.log2(max(2 * n, 2)))), axis=1)
    r = np.fft.irfft(f * np.conj(f), axis=1)[:, :n]
    first = r[:, :1]
    return np.where(first > 0, r / np.where(first > 0, first, 1), 0.0)


def _first(flags: np.ndarray, otherwise: int) -> np.ndarray:
    """Place of the first true value of each row."""
    if not flags.shape[1]:
        return np.full(len(flags), otherwise)
    return np.where(flags.any(axis=1), flags.argmax(axis=1), otherwise)


def _first_zero(r: np.ndarray) -> np.ndarray:
    return _first(r <= 0, r.shape[1])


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, rows) of each distinct value."""
    for k in np.unique(keys):
        yield int(k), np.flatnonzero(keys == k)


def _histograms(y: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, edges) of each row in equal bins from its minimum to its maximum, the last one closed."""
    low, high = y.min(axis=1), y.max(axis=1)
    flat = low == high
    edges = np.linspace(np.where(flat, low - 0.5, low), np.where(flat, high + 0.5, high), bins + 1, axis=1)
    width = edges[:, -1:] - edges[:, :1]
    place = np.minimum(((y - edges[:, :1]) / width * bins).astype(np.int64), bins - 1)
    place -= y < np.take_along_axis(edges, place, axis=1)  # where the quotient was rounded across an edge
    place += (y >= np.take_along_axis(edges, place + 1, axis=1)) & (place < bins - 1)
    counts = np.bincount((np.arange(len(y))[:, None] * bins + place).ravel(), minlength=len(y) * bins)
    return counts.reshape(len(y), bins), edges


def histogram_mode(y: np.ndarray, bins: int) -> np.ndarray:
    """Centre of the fullest of ``bins`` equal bins; the mean of the centres on a tie."""
    counts, edges = _histograms(y, bins)
    fullest = counts == counts.max(axis=1, keepdims=True)
    mode = ((edges[:, :-1] + edges[:, 1:]) / 2 * fullest).sum(axis=1) / fullest.sum(axis=1)
    return np.where(y.min(axis=1) == y.max(axis=1), y[:, 0], mode)


def embedding_distance(y: np.ndarray) -> np.ndarray:
    """Mean gap between the histogram of step lengths in the 2-d embedding and an exponential fit."""
    out = np.full(len(y), NAN)
    for tau, rows in _groups(np.minimum(_first_zero(autocorrelation(y)), y.shape[1] // 10)):
        if tau < 1 or y.shape[1] <= tau + 2:
            continue
        d = np.hypot(np.diff(y[rows, :-tau], axis=1), np.diff(y[rows, tau:], axis=1))
        mean = d.mean(axis=1)
        out[rows] = 0.0
        steps = mean > 0
        for bins, own in _groups(np.where(steps, _scott_bins(d), 0)):
            if bins:
                counts, edges = _histograms(d[own], bins)
                m = mean[own, None]
                fit = np.exp(-(edges[:, :-1] + edges[:, 1:]) / 2 / m) / m
                out[rows[own]] = np.abs(counts / d.shape[1] - fit).mean(axis=1)
    return out


def _scott_bins(d: np.ndarray) -> np.ndarray:
    """Scott's rule for the number of bins of each row."""
    s = d.std(axis=1, ddof=1)
    width = np.where(s > 0.001, 3.5 * s / d.shape[1] ** (1 / 3), 1)
    return np.where(s > 0.001, np.maximum(np.ceil(np.ptp(d, axis=1) / width), 1), 1).astype(int)


def acf_timescale(y: np.ndarray) -> np.ndarray:
    """First crossing of 1/e by the autocorrelation, linearly interpolated."""
    r, t, n = autocorrelation(y), 1 / np.e, y.shape[1]
    k = _first(r[:, 1:] < t, n)
    at = np.minimum(k, max(n - 2, 0))
    rows = np.arange(len(y))
    before, after = r[rows, at], r[rows, np.minimum(at + 1, n - 1)]
    gap = np.where(after == before, 1, after - before)
    return np.where(r[:, 0] > 0, np.where(k < n, at + (t - before) / gap, float(n)), NAN)


def acf_first_minimum(y: np.ndarray) -> np.ndarray:
    r = autocorrelation(y)
    found = (r[:, 1:-1] < r[:, :-2]) & (r[:, 1:-1] < r[:, 2:])
    return _first(found, y.shape[1] - 1).astype(float) + 1


def histogram_ami(y: np.ndarray, lag: int = 2, bins: int = 5) -> np.ndarray:
    """Mutual information of the series and itself at a lag, in equal bins."""
    if y.shape[1] <= lag:
        return np.full(len(y), NAN)
    edges = np.linspace(y.min(axis=1) - 0.1, y.max(axis=1) + 0.1, bins + 1, axis=1)[:, None, 1:-1]
    letter = (y[:, :, None] >= edges).sum(axis=2)
    p = _pair_counts(letter[:, :-lag], letter[:, lag:], bins) / (y.shape[1] - lag)
    outer = p.sum(axis=2, keepdims=True) * p.sum(axis=1, keepdims=True)
    return np.where(p > 0, p * np.log(np.where(p > 0, p, 1) / np.where(p > 0, outer, 1)), 0).sum(axis=(1, 2))


def _pair_counts(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """How often each pair of letters below ``n`` occurs in each row, rows x n x n."""
    code = (np.arange(len(a))[:, None] * n + a) * n + b
    return np.bincount(code.ravel(), minlength=len(a) * n * n).reshape(len(a), n, n)


def time_reversibility(y: np.ndarray) -> np.ndarray:
    return (np.diff(y, axis=1) ** 3).mean(axis=1) if y.shape[1] > 1 else np.full(len(y), NAN)


def outlier_timing(y: np.ndarray, sign: int, step: float = 0.01) -> np.ndarray:
    """Median, over rising thresholds, of the median place of what exceeds them, on [-1, 1].

    What exceeds a threshold are a row's largest values, so medians are taken once for each
    number of them.
    """
    z = y * sign
    n = y.shape[1]
    out = np.zeros(len(y))
    block = max(1, BLOCK_VALUES * 8 // (n * n))
    able = np.flatnonzero((z >= 0).any(axis=1) & (z.max(axis=1) >= step))
    for lo in range(0, len(able), block):
        rows = able[lo : lo + block]
        own = z[rows]
        total = (own >= 0).sum(axis=1)
        rank = np.empty(own.shape, np.int64)
        np.put_along_axis(rank, np.argsort(-own, axis=1, kind="stable"), np.arange(n)[None], axis=1)
        size = np.arange(1, n + 1)
        seen = np.cumsum(rank[:, None, :] < size[None, :, None], axis=2, dtype=np.int32)  # of the largest 1, 2, ...
        middle = [(seen >= k[None, :, None]).argmax(axis=2) + 1 for k in ((size + 1) // 2, size // 2 + 1)]
        median = (middle[0] + middle[1]) / 2 / (n / 2) - 1
        last = (own.max(axis=1) / step).astype(int)
        thresholds = np.arange(last.max() + 1) * step
        counts = np.stack([n - np.searchsorted(np.sort(v), thresholds, "left") for v in own])
        few = (counts - 1) * 100 / total[:, None] <= 2
        stop = np.minimum(_first(few, len(thresholds)), last)
        used = np.arange(len(thresholds))[None] <= stop[:, None]
        values = np.where(used, np.take_along_axis(median, np.maximum(counts, 1) - 1, axis=1), NAN)
        out[rows] = np.nanmedian(values, axis=1)
    return out


def whiten_timescale(y: np.ndarray) -> np.ndarray:
    """First zero of the autocorrelation of the differences over that of the series."""
    if y.shape[1] <= 2:
        return np.full(len(y), NAN)
    a = _first_zero(autocorrelation(y))
    return np.where(a > 0, _first_zero(autocorrelation(np.diff(y, axis=1))) / np.maximum(a, 1), NAN)


def forecast_error(y: np.ndarray, window: int = 3) -> np.ndarray:
    """Deviation of the errors of a mean forecast from the last ``window`` values."""
    if y.shape[1] <= window + 1:
        return np.full(len(y), NAN)
    means = np.lib.stride_tricks.sliding_window_view(y, window, axis=1)[:, :-1].mean(axis=2)
    return (y[:, window:] - means).std(axis=1, ddof=1)


def gaussian_ami_minimum(y: np.ndarray, lags: int = 40) -> np.ndarray:
    """First minimum over lags of -log(1 - r^2) / 2."""
    top = min(lags, int(np.ceil(y.shape[1] / 2)))
    ami = np.empty((len(y), top))
    for k in range(1, top + 1):
        a, b = y[:, :-k], y[:, k:]
        if a.shape[1] < 2:
            return np.full(len(y), NAN)
        a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        spread = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        r = np.where(spread > 0, (a * b).sum(axis=1) / np.where(spread > 0, spread, 1), NAN)
        ami[:, k - 1] = -0.5 * np.log(np.maximum(1 - r * r, 1e-300))
    found = (ami[:, 1:-1] < ami[:, :-2]) & (ami[:, 1:-1] < ami[:, 2:])
    return np.where(np.isnan(ami).any(axis=1), NAN, _first(found, top - 1) + 1)


def high_fluctuation(y: np.ndarray) -> np.ndarray:
    """Share of successive differences above 0.04 deviations."""
    return (np.abs(np.diff(y, axis=1)) * 1000 > 40).mean(axis=1) if y.shape[1] > 1 else np.full(len(y), NAN)


def _longest(flags: np.ndarray) -> np.ndarray:
    if not flags.shape[1]:
        return np.zeros(len(flags))
    place = np.arange(flags.shape[1])[None]
    return (place - np.maximum.accumulate(np.where(flags, -1, place), axis=1)).max(axis=1).astype(float)


def longest_decrease(y: np.ndarray) -> np.ndarray:
    return _longest(np.diff(y, axis=1) < 0)


def longest_above_mean(y: np.ndarray) -> np.ndarray:
    return _longest(y > y.mean(axis=1, keepdims=True))


def _symbols(y: np.ndarray, n: int = 3) -> np.ndarray:
    """Quantile letters 0..n-1."""
    cuts = np.quantile(y, np.arange(1, n) / n, axis=1)
    return (y[None] > cuts[:, :, None]).sum(axis=0)


def pair_entropy(y: np.ndarray) -> np.ndarray:
    """Entropy of pairs of successive letters in a three-letter quantile alphabet."""
    if y.shape[1] < 2:
        return np.full(len(y), NAN)
    s = _symbols(y)
    p = _pair_counts(s[:, :-1], s[:, 1:], 3) / (y.shape[1] - 1)
    return -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(axis=(1, 2))


def fluctuation_share(y: np.ndarray, lag: int, kind: str) -> np.ndarray:
    """Share of the log-spaced scales that the first of two fitted lines covers.

    ``kind`` is "range" for rescaled ranges of the cumulative sum and "dfa" for detrended
    fluctuations; the break is where the two lines' errors add up to the least.
    """
    n, least = y.shape[1], 6
    scales = np.unique(np.round(np.exp(np.linspace(np.log(5), np.log(max(n / 2, 5)), 50))).astype(int))
    out = np.zeros(len(y))
    if len(scales) < 2 * least:
        return out
    walk = np.cumsum(y[:, ::lag], axis=1)
    values = np.full((len(y), len(scales)), NAN)
    for j, s in enumerate(scales):
        m = walk.shape[1] // s
        if m < 1:
            continue
        seg = walk[:, : m * s].reshape(len(y), m, s)
        t = np.arange(1, s + 1) - (s + 1) / 2
        slope = seg @ t / (t @ t)
        rest = seg - seg.mean(axis=2, keepdims=True) - slope[:, :, None] * t
        values[:, j] = np.sqrt((np.ptp(rest, axis=2) ** 2).mean(axis=1)) if kind == "range" else np.sqrt((rest**2).mean(axis=(1, 2)))
    ok = np.isfinite(values) & (values > 0)
    patterns, which = np.unique(ok, axis=0, return_inverse=True)
    for p, keep in enumerate(patterns):
        rows = np.flatnonzero(which.ravel() == p)
        k = int(keep.sum())
        if k < 2 * least:
            continue
        x, f = np.log(scales[keep]), np.log(values[np.ix_(rows, np.flatnonzero(keep))])
        before, after = _line_errors(x, f), _line_errors(x[::-1], f[:, ::-1])[:, ::-1]
        cuts = np.arange(least, k - least + 1)
        out[rows] = ((before[:, cuts - 1] + after[:, cuts - 1]).argmin(axis=1) + least) / k
    return out


def _line_errors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Norm of the residuals of the line through the first k points of each row, for every k."""
    k = np.arange(1, len(a) + 1)
    sx, sxx = np.cumsum(a), np.cumsum(a * a)
    sy, sxy, syy = (np.cumsum(v, axis=1) for v in (b, a * b, b * b))
    vx, vy, cov = sxx - sx * sx / k, syy - sy * sy / k, sxy - sx * sy / k
    return np.sqrt(np.maximum(vy - np.where(vx > 1e-12, cov * cov / np.where(vx > 1e-12, vx, 1), 0), 0))


def _spectrum(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angular frequency, density of each row) of a rectangular Welch estimate with one segment."""
    n = 2 ** int(np.ceil(np.log2(max(y.shape[1], 2))))
    power = np.abs(np.fft.rfft(y - y.mean(axis=1, keepdims=True), n, axis=1)) ** 2 / y.shape[1]
    power[:, 1:-1] *= 2
    return np.linspace(0, np.pi, power.shape[1]), power / (2 * np.pi)


def low_frequency_power(y: np.ndarray) -> np.ndarray:
    w, s = _spectrum(y)
    return s[:, : len(w) // 5].sum(axis=1) * (w[1] - w[0])


def centroid_frequency(y: np.ndarray) -> np.ndarray:
    """Frequency at which half of the power is reached."""
    w, s = _spectrum(y)
    c = np.cumsum(s, axis=1)
    return np.where(c[:, -1] > 0, w[(c > c[:, -1:] / 2).argmax(axis=1)], 0.0)


def transition_variance(y: np.ndarray) -> np.ndarray:
    """Trace of the covariance of the three-letter transition matrix of the downsampled series."""
    out = np.full(len(y), NAN)
    tau = np.where(y.std(axis=1) > 0, np.minimum(_first_zero(autocorrelation(y)), y.shape[1]), 0)
    for step, rows in _groups(tau):
        part = y[rows, :: max(step, 1)]
        if step and part.shape[1] > 2:
            s = _symbols(part)
            p = _pair_counts(s[:, :-1], s[:, 1:], 3) / (part.shape[1] - 1)
            out[rows] = p.var(axis=1, ddof=1).sum(axis=1)
    return out


def wang_periodicity(y: np.ndarray, threshold: float = 0.01) -> np.ndarray:
    """First peak of the detrended autocovariance that follows a trough and rises enough above it."""
    n = y.shape[1]
    if n < 6:
        return np.zeros(len(y))
    t = np.linspace(0, 1, n)
    basis = np.stack([np.ones(n), t, t**2, t**3, *[np.maximum(t - k, 0) ** 3 for k in (1 / 3, 2 / 3)]], 1)
    z = y - (basis @ np.linalg.lstsq(basis, y.T, rcond=None)[0]).T
    top = int(np.ceil(n / 3))
    acf = np.stack([(z[:, :-k] * z[:, k:]).mean(axis=1) for k in range(1, top + 1)], axis=1)
    d = np.diff(acf, axis=1)
    place = np.arange(1, top - 1)[None]
    trough, peak = (d[:, :-1] < 0) & (d[:, 1:] > 0), (d[:, :-1] > 0) & (d[:, 1:] < 0)
    if not trough.shape[1]:
        return np.zeros(len(y))
    last = np.maximum.accumulate(np.where(trough, place, 0), axis=1)  # a peak is no trough, so of those before it
    rise = acf[:, 1:-1] - np.take_along_axis(acf, last, axis=1)
    found = peak & (last > 0) & (rise >= threshold) & (acf[:, 1:-1] >= 0)
    return np.where(found.any(axis=1), found.argmax(axis=1) + 2, 0).astype(float)


#: Features by name: functions from a matrix of z-scored series of one length to a value of each row.
FEATURES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "mode_5": lambda y: histogram_mode(y, 5),
    "mode_10": lambda y: histogram_mode(y, 10),
    "embedding_dist": embedding_distance,
    "acf_timescale": acf_timescale,
    "acf_first_min": acf_first_minimum,
    "ami2": histogram_ami,
    "trev": time_reversibility,
    "outlier_timing_pos": lambda y: outlier_timing(y, 1),
    "outlier_timing_neg": lambda y: outlier_timing(y, -1),
    "whiten_timescale": whiten_timescale,
    "forecast_error": forecast_error,
    "ami_timescale": gaussian_ami_minimum,
    "high_fluctuation": high_fluctuation,
    "stretch_decreasing": longest_decrease,
    "stretch_high": longest_above_mean,
    "entropy_pairs": pair_entropy,
    "rs_range": lambda y: fluctuation_share(y, 1, "range"),
    "dfa": lambda y: fluctuation_share(y, 2, "dfa"),
    "low_freq_power": low_frequency_power,
    "centroid_freq": centroid_frequency,
    "transition_variance": transition_variance,
    "periodicity": wang_periodicity,
}


def compute(name: str, x) -> float | None:
    """The feature of one series; null for null or empty ones, NaN if a value is not finite."""
    if x is None or len(x) == 0:
        return None
    return float(batch([name], [np.asarray(x, float)])[0, 0])


def batch(names: list[str], series: list) -> np.ndarray:
    """Values of features (series x names); rows of null or empty series stay NaN, as do those with a value that is not finite."""
    out = np.full((len(series), len(names)), NAN)
    lengths = np.array([0 if x is None else len(x) for x in series])
    for n, rows in _groups(lengths):
        if not n:
            continue
        block = max(1, BLOCK_VALUES // n)
        for lo in range(0, len(rows), block):
            own = rows[lo : lo + block]
            x = np.stack([np.asarray(series[i], float) for i in own])
            finite = np.isfinite(x).all(axis=1)
            y = zscore(x[finite])
            for j, name in enumerate(names if len(y) else []):
                out[own[finite], j] = FEATURES[name](y)
    return out


def column(name: str) -> Callable[[Column], Column]:
    """The feature as a function of an array column."""
    if name not in FEATURES:
        raise KeyError(f"unknown feature {name!r}")

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        found = batch([name], list(s))[:, 0]
        return pd.Series([None if x is None or len(x) == 0 else v for x, v in zip(s, found, strict=True)], dtype=object)

    return lambda a: run(a.cast("array<double>"))


def all_features(a: Column) -> Column:
    """All 22 values in one Arrow pass, as array<double> in the order of ``FEATURES``."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        found = batch(list(FEATURES), list(s))
        return pd.Series([None if x is None or len(x) == 0 else v for x, v in zip(s, found, strict=True)])

    return run(a.cast("array<double>"))


def register_all() -> None:
    """Makes the features without an expression available by name."""
    from . import arrays

    for name in FEATURES:
        if name not in arrays.REGISTRY:
            arrays.register(name, lambda a, name=name: column(name)(a))
    arrays.SETS["catch22"] = list(FEATURES)
    arrays.SETS["complete"] = ["maximum", "minimum", "mean", "median", "std", "cov", *FEATURES]


register_all()
