"""The canonical features of one series at a time, in plain steps, to hold the batched ones against."""

from collections.abc import Callable

import numpy as np

NAN = float("nan")


def zscore(x: np.ndarray) -> np.ndarray:
    s = x.std(ddof=1) if len(x) > 1 else 0.0
    return (x - x.mean()) / s if s > 0 else np.zeros(len(x))


def autocorrelation(y: np.ndarray) -> np.ndarray:
    """Autocorrelation at all lags by FFT."""
    n = len(y)
    y = y - y.mean()
    f = np.fft.rfft(y, 2 ** int(np.ceil(np.log2(max(2 * n, 2)))))
    r = np.fft.irfft(f * np.conj(f))[:n]
    return r / r[0] if r[0] > 0 else np.zeros(n)


def _first_zero(r: np.ndarray) -> int:
    found = np.flatnonzero(r <= 0)
    return int(found[0]) if len(found) else len(r)


def histogram_mode(y: np.ndarray, bins: int) -> float:
    """Centre of the fullest of ``bins`` equal bins; the mean of the centres on a tie."""
    low, high = y.min(), y.max()
    if high == low:
        return float(low)
    counts, edges = np.histogram(y, bins, (low, high))
    return float(((edges[:-1] + edges[1:]) / 2)[counts == counts.max()].mean())


def embedding_distance(y: np.ndarray) -> float:
    """Mean gap between the histogram of step lengths in the 2-d embedding and an exponential fit."""
    tau = min(_first_zero(autocorrelation(y)), len(y) // 10)
    if tau < 1 or len(y) <= tau + 2:
        return NAN
    a, b = y[:-tau], y[tau:]
    d = np.hypot(np.diff(a), np.diff(b))
    mean = d.mean()
    if not mean > 0:
        return 0.0
    bins = _square_root_bins(d)
    counts, edges = np.histogram(d, bins)
    share = counts / len(d)
    centre = (edges[:-1] + edges[1:]) / 2
    fit = np.exp(-centre / mean) / mean
    return float(np.abs(share - np.maximum(fit, 0)).mean())


def _square_root_bins(d: np.ndarray) -> int:
    """Scott's rule for the number of bins."""
    s = d.std(ddof=1)
    return max(int(np.ceil((d.max() - d.min()) / (3.5 * s / len(d) ** (1 / 3)))), 1) if s > 0.001 else 1


def acf_timescale(y: np.ndarray) -> float:
    """First crossing of 1/e by the autocorrelation, linearly interpolated."""
    r, t = autocorrelation(y), 1 / np.e
    if not r[0] > 0:
        return NAN
    below = np.flatnonzero(r[1:] < t)
    if not len(below):
        return float(len(y))
    k = int(below[0])
    return float(k + (t - r[k]) / (r[k + 1] - r[k]))


def acf_first_minimum(y: np.ndarray) -> float:
    r = autocorrelation(y)
    found = np.flatnonzero((r[1:-1] < r[:-2]) & (r[1:-1] < r[2:]))
    return float(found[0] + 1) if len(found) else float(len(y))


def histogram_ami(y: np.ndarray, lag: int = 2, bins: int = 5) -> float:
    """Mutual information of the series and itself at a lag, in equal bins."""
    if len(y) <= lag:
        return NAN
    edges = np.linspace(y.min() - 0.1, y.max() + 0.1, bins + 1)
    a, b = np.digitize(y[:-lag], edges[1:-1]), np.digitize(y[lag:], edges[1:-1])
    p = np.zeros((bins, bins))
    np.add.at(p, (a, b), 1 / len(a))
    outer = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    hit = p > 0
    return float((p[hit] * np.log(p[hit] / outer[hit])).sum())


def time_reversibility(y: np.ndarray) -> float:
    return float((np.diff(y) ** 3).mean()) if len(y) > 1 else NAN


def outlier_timing(y: np.ndarray, sign: int, step: float = 0.01) -> float:
    """Median, over rising thresholds, of the median place of what exceeds them, on [-1, 1]."""
    z = y * sign
    if not (z >= 0).any() or z.max() < step:
        return 0.0
    n = len(z)
    places = np.flatnonzero(z >= 0)
    own = z[places]
    thresholds = np.arange(int(z.max() / step) + 1) * step
    counts = len(own) - np.searchsorted(np.sort(own), thresholds, "left")
    stop = np.flatnonzero((counts - 1) * 100 / len(own) <= 2)
    used = thresholds[: int(stop[0]) + 1 if len(stop) else len(thresholds)]
    medians = []
    for lo in range(0, len(used), 64):
        seen = np.cumsum(own[None] >= used[lo : lo + 64, None], axis=1)
        total = seen[:, -1:]
        middle = [places[(seen >= k).argmax(1)] + 1 for k in ((total + 1) // 2, total // 2 + 1)]
        medians.append((middle[0] + middle[1]) / 2 / (n / 2) - 1)
    return float(np.median(np.concatenate(medians)))


def whiten_timescale(y: np.ndarray) -> float:
    """First zero of the autocorrelation of the differences over that of the series."""
    a = _first_zero(autocorrelation(y))
    return _first_zero(autocorrelation(np.diff(y))) / a if len(y) > 2 and a else NAN


def forecast_error(y: np.ndarray, window: int = 3) -> float:
    """Deviation of the errors of a mean forecast from the last ``window`` values."""
    if len(y) <= window + 1:
        return NAN
    means = np.convolve(y, np.ones(window) / window, "valid")[:-1]
    return float((y[window:] - means).std(ddof=1))


def gaussian_ami_minimum(y: np.ndarray, lags: int = 40) -> float:
    """First minimum over lags of -log(1 - r^2) / 2."""
    top = min(lags, int(np.ceil(len(y) / 2)))
    ami = []
    for k in range(1, top + 1):
        a, b = y[:-k], y[k:]
        if len(a) < 2 or not a.std() > 0 or not b.std() > 0:
            return NAN
        r = float(np.corrcoef(a, b)[0, 1])
        ami.append(-0.5 * np.log(max(1 - r * r, 1e-300)))
    for i in range(1, len(ami) - 1):
        if ami[i] < ami[i - 1] and ami[i] < ami[i + 1]:
            return float(i)
    return float(top)


def high_fluctuation(y: np.ndarray) -> float:
    """Share of successive differences above 0.04 deviations."""
    return float((np.abs(np.diff(y)) * 1000 > 40).mean()) if len(y) > 1 else NAN


def _longest(flags: np.ndarray) -> float:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return float((edges[1::2] - edges[::2]).max(initial=0))


def longest_decrease(y: np.ndarray) -> float:
    return _longest(np.diff(y) < 0)


def longest_above_mean(y: np.ndarray) -> float:
    return _longest(y > y.mean())


def _symbols(y: np.ndarray, n: int = 3) -> np.ndarray:
    """Quantile letters 0..n-1."""
    cuts = np.quantile(y, np.arange(1, n) / n)
    return (y[:, None] > cuts[None]).sum(1)


def pair_entropy(y: np.ndarray) -> float:
    """Entropy of pairs of successive letters in a three-letter quantile alphabet."""
    if len(y) < 2:
        return NAN
    s = _symbols(y)
    p = np.bincount(s[:-1] * 3 + s[1:], minlength=9) / (len(s) - 1)
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def fluctuation_share(y: np.ndarray, lag: int, kind: str) -> float:
    """Share of the log-spaced scales that the first of two fitted lines covers.

    ``kind`` is "range" for rescaled ranges of the cumulative sum and "dfa" for detrended
    fluctuations; the break is where the two lines' errors add up to the least.
    """
    n = len(y)
    scales = np.unique(np.round(np.exp(np.linspace(np.log(5), np.log(max(n / 2, 5)), 50))).astype(int))
    if len(scales) < 12:
        return 0.0
    walk = np.cumsum(y[::lag])
    values = []
    for s in scales:
        m = len(walk) // s
        if m < 1:
            values.append(np.nan)
            continue
        seg = walk[: m * s].reshape(m, s)
        t = np.arange(1, s + 1) - (s + 1) / 2
        slope = seg @ t / (t @ t)
        rest = seg - seg.mean(1, keepdims=True) - slope[:, None] * t
        values.append(np.sqrt((np.ptp(rest, axis=1) ** 2).mean()) if kind == "range" else np.sqrt((rest**2).mean()))
    x, f = np.log(scales), np.array(values)
    ok = np.isfinite(f) & (f > 0)
    x, f = x[ok], np.log(f[ok])
    least = 6
    if len(x) < 2 * least:
        return 0.0

    def errors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Norm of the residuals of the line through the first k points, for every k."""
        k = np.arange(1, len(a) + 1)
        sx, sy, sxx, sxy, syy = (np.cumsum(v) for v in (a, b, a * a, a * b, b * b))
        vx, vy, cov = sxx - sx * sx / k, syy - sy * sy / k, sxy - sx * sy / k
        return np.sqrt(np.maximum(vy - np.divide(cov * cov, vx, out=np.zeros(len(a)), where=vx > 1e-12), 0))

    before, after = errors(x, f), errors(x[::-1], f[::-1])[::-1]
    cuts = np.arange(least, len(x) - least + 1)
    return float((int((before[cuts - 1] + after[cuts - 1]).argmin()) + least) / len(x))


def _spectrum(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angular frequency, density) of a rectangular Welch estimate with one segment."""
    n = 2 ** int(np.ceil(np.log2(max(len(y), 2))))
    f = np.fft.rfft(y - y.mean(), n)
    power = np.abs(f) ** 2 / len(y)
    power[1:-1] *= 2
    return np.linspace(0, np.pi, len(power)), power / (2 * np.pi)


def low_frequency_power(y: np.ndarray) -> float:
    w, s = _spectrum(y)
    return float(s[: len(w) // 5].sum() * (w[1] - w[0]))


def centroid_frequency(y: np.ndarray) -> float:
    """Frequency at which half of the power is reached."""
    w, s = _spectrum(y)
    c = np.cumsum(s)
    return float(w[np.argmax(c > c[-1] / 2)]) if c[-1] > 0 else 0.0


def transition_variance(y: np.ndarray) -> float:
    """Trace of the covariance of the three-letter transition matrix of the downsampled series."""
    tau = min(_first_zero(autocorrelation(y)), len(y))
    if not tau or not y.std() > 0:
        return NAN
    s = _symbols(y[::tau]) if len(y[::tau]) > 2 else None
    if s is None:
        return NAN
    p = np.zeros((3, 3))
    np.add.at(p, (s[:-1], s[1:]), 1)
    p /= len(s) - 1
    return float(np.trace(np.cov(p, rowvar=False)))


def wang_periodicity(y: np.ndarray, threshold: float = 0.01) -> float:
    """First peak of the detrended autocovariance that follows a trough and rises enough above it."""
    n = len(y)
    if n < 6:
        return 0.0
    t = np.linspace(0, 1, n)
    knots = (1 / 3, 2 / 3)
    basis = np.stack([np.ones(n), t, t**2, t**3, *[np.maximum(t - k, 0) ** 3 for k in knots]], 1)
    z = y - basis @ np.linalg.lstsq(basis, y, rcond=None)[0]
    top = int(np.ceil(n / 3))
    acf = np.array([(z[:-k] * z[k:]).mean() for k in range(1, top + 1)])
    d = np.diff(acf)
    troughs = np.flatnonzero((d[:-1] < 0) & (d[1:] > 0)) + 1
    for p in np.flatnonzero((d[:-1] > 0) & (d[1:] < 0)) + 1:
        before = troughs[troughs < p]
        if len(before) and acf[p] - acf[before[-1]] >= threshold and acf[p] >= 0:
            return float(p + 1)
    return 0.0


FEATURES: dict[str, Callable[[np.ndarray], float]] = {
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
    x = np.asarray(x, float)
    return FEATURES[name](zscore(x)) if np.isfinite(x).all() else NAN
