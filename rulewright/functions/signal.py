"""Signal operators: frames, spectra, filterbanks, cepstra, pitch, wavelets, speech detection.

Kernels are numpy functions of one clip; ``per_clip`` runs them in Arrow batches, one clip at
a time, so memory is bounded by the longest clip.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_function(kind: str, n: int, periodic: bool = True, zero_phase: bool = False) -> np.ndarray:
    """hann, hamming or rect of n samples; periodic or symmetric; n = 1 gives 1."""
    shapes = {"hann": (0.5, 0.5), "hamming": (0.54, 0.46), "rect": (1.0, 0.0)}
    if kind not in shapes or n < 1:
        raise ValueError(f"no window: {kind!r} of {n}")
    if n == 1:
        return np.ones(1)
    a, b = shapes[kind]
    w = a - b * np.cos(2 * np.pi * np.arange(n) / (n if periodic else n - 1))
    return np.fft.ifftshift(w) if zero_phase else w


def frames(x: np.ndarray, size: int, overlap: int) -> np.ndarray:
    """Overlapping frames in rows; an incomplete tail is dropped."""
    hop = size - overlap
    if hop < 1:
        raise ValueError("the overlap is smaller than the frame")
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop] if len(x) >= size else np.empty((0, size))


def default_fft(rate: int) -> int:
    return 256 if rate <= 8000 else 512


def stft(x: np.ndarray, rate: int, nfft: int | None = None, size: int | None = None, overlap: int | None = None, window: str = "hann", periodic: bool = True, norm: str = "power") -> tuple[np.ndarray, np.ndarray]:
    """(one-sided spectra in rows, frequencies); norm is none, power, magnitude or pow2mag."""
    nfft = nfft or default_fft(rate)
    size = size or nfft
    overlap = size // 2 if overlap is None else overlap
    f = np.fft.rfft(frames(np.asarray(x, float), size, overlap) * window_function(window, size, periodic), nfft)
    kinds = {"none": lambda z: z, "power": lambda z: np.abs(z) ** 2, "magnitude": np.abs, "pow2mag": lambda z: np.sqrt(np.abs(z) ** 2)}
    if norm not in kinds or size > nfft:
        raise ValueError("unknown norm, or frames longer than the transform")
    return kinds[norm](f), np.arange(nfft // 2 + 1) * rate / nfft


# The constants of the published scales.
SCALES: dict[str, tuple[Callable, Callable]] = {
    "mel_htk": (lambda f: 2595 * np.log10(1 + np.asarray(f) / 700), lambda m: 700 * (10 ** (np.asarray(m) / 2595) - 1)),
    "mel_slaney": (
        lambda f: np.where(np.asarray(f) < 1000, np.asarray(f) * 3 / 200, 15 + np.log(np.maximum(np.asarray(f, float), 1e-9) / 1000) * 27 / np.log(6.4)),
        lambda m: np.where(np.asarray(m) < 15, np.asarray(m) * 200 / 3, 1000 * np.exp((np.asarray(m) - 15) * np.log(6.4) / 27)),
    ),
    "erb": (lambda f: 1000 * math.log(10) / (24.673 * 4.368) * np.log10(1 + 0.004368 * np.asarray(f)), lambda e: (10 ** (np.asarray(e) / (1000 * math.log(10) / (24.673 * 4.368))) - 1) / 0.004368),
    "bark": (lambda f: _to_bark(np.asarray(f, float)), lambda b: _from_bark(np.asarray(b, float))),
    "semitones": (lambda f: 12 * np.log2(np.asarray(f) / 440) + 69, lambda s: 440 * 2 ** ((np.asarray(s) - 69) / 12)),
}


def _to_bark(f: np.ndarray) -> np.ndarray:
    b = 26.81 * f / (1960 + f) - 0.53
    return np.where(b < 2, 0.85 * b + 0.3, np.where(b > 20.1, 1.22 * b - 4.422, b))


def _from_bark(b: np.ndarray) -> np.ndarray:
    b = np.where(b < 2, (b - 0.3) / 0.85, np.where(b > 20.1, (b + 4.422) / 1.22, b))
    return 1960 * (b + 0.53) / (26.28 - b)


def band_edges(scale: str, bands: int, low: float, high: float) -> np.ndarray:
    """bands + 2 frequencies, evenly spaced on a scale."""
    to, back = SCALES[scale]
    return back(np.linspace(float(to(low)), float(to(high)), bands + 2))


def tuned_edges(bands: int, base: float = 440.0, per_octave: int = 12) -> np.ndarray:
    """bands + 2 frequencies at equal steps of an octave from a base."""
    return base * 2.0 ** (np.arange(bands + 2) / per_octave)


def triangular_filterbank(edges: np.ndarray, nfft: int, rate: int, norm: str = "bandwidth") -> np.ndarray:
    """Filters (band x bin) that rise from one edge to the next and fall to the one after."""
    bins = np.arange(nfft // 2 + 1) * rate / nfft
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)))
    return normalise_bank(bank, edges[2:] - edges[:-2], norm)


def normalise_bank(bank: np.ndarray, widths: np.ndarray, norm: str) -> np.ndarray:
    """Bands divided by their area or half bandwidth, or left as they are."""
    if norm == "none":
        return bank
    if norm == "area":
        area = bank.sum(axis=1, keepdims=True)
        return bank / np.where(area > 0, area, 1)
    if norm == "bandwidth":
        return bank / (np.asarray(widths)[:, None] / 2)
    raise ValueError(f"unknown norm {norm!r}")


# Bandwidth 1.019 * 24.7 * (4.37 f / 1000 + 1) and the roots 3 +- 2 ** 1.5 of the published gammatone filter.
def gammatone_sections(centers: np.ndarray, rate: int) -> np.ndarray:
    """Four second-order sections (band x 4 x 6: b0 b1 b2 a0 a1 a2) of gammatone filters, of gain 1 at their centres.

    All sections have one pair of poles and differ in their zeros. The gain is that of the sections
    themselves: their response at the centre is worked out, and the first one is divided by it.
    """
    f = np.asarray(centers, float)
    angle = 2 * np.pi * f / rate
    radius = np.exp(-1.019 * 2 * np.pi * 24.7 * (4.37 * f / 1000 + 1) / rate)
    out = np.zeros((len(f), 4, 6))
    for k, root in enumerate(s * math.sqrt(3 + q * 2**1.5) for q in (1, -1) for s in (1, -1)):
        out[:, k, 0] = 1 / rate
        out[:, k, 1] = -radius * (np.cos(angle) + root * np.sin(angle)) / rate
    out[..., 3], out[..., 4], out[..., 5] = 1, (-2 * radius * np.cos(angle))[:, None], (radius**2)[:, None]
    delays = np.exp(-1j * angle[:, None] * np.arange(3))[:, None]
    at_center = np.abs(np.prod((out[..., :3] * delays).sum(2) / (out[..., 3:] * delays).sum(2), axis=1))
    out[:, 0, :3] /= at_center[:, None]
    return out


def gammatone_bank(bands: int, nfft: int, rate: int, low: float, high: float, norm: str = "none") -> np.ndarray:
    """Magnitude responses (band x bin) of gammatone filters at centres even on the erb scale."""
    to, back = SCALES["erb"]
    centers = back(np.linspace(float(to(low)), float(to(high)), bands))
    z = np.exp(-2j * np.pi * np.arange(nfft // 2 + 1) / nfft)
    s = gammatone_sections(centers, rate)
    response = np.ones((bands, len(z)), complex)
    for k in range(4):
        c = s[:, k]
        response *= (c[:, 0:1] + c[:, 1:2] * z + c[:, 2:3] * z**2) / (c[:, 3:4] + c[:, 4:5] * z + c[:, 5:6] * z**2)
    return normalise_bank(np.abs(response), 1.019 * 24.7 * (4.37 * centers / 1000 + 1), norm)


def band_spectrum(spectrum: np.ndarray, bank: np.ndarray, decibel: bool = False) -> np.ndarray:
    """Frames x bands."""
    out = spectrum @ bank.T
    return 10 * np.log10(np.maximum(out, np.finfo(float).tiny)) if decibel else out


def dct_matrix(n: int, k: int) -> np.ndarray:
    m = np.cos(np.pi / n * np.arange(k)[:, None] * (np.arange(n) + 0.5)) * math.sqrt(2 / n)
    m[0] /= math.sqrt(2)
    return m


def inverse_dct(c: np.ndarray, n: int | None = None, kind: int = 2) -> np.ndarray:
    """Rows whose orthonormal cosine transform of type 2 or 3 has the coefficients ``c``, padded to ``n``."""
    n = n or c.shape[1]
    m = dct_matrix(n, n)
    full = np.zeros((len(c), n))
    full[:, : min(n, c.shape[1])] = c[:, :n]
    if kind not in (2, 3):
        raise ValueError(f"unknown type {kind!r}")
    return full @ m if kind == 2 else full @ m.T


def cepstra(bands: np.ndarray, n: int = 13, rectify: str = "log") -> np.ndarray:
    """Coefficients of the log or cubic-rooted band spectrum."""
    if rectify == "log":
        z = np.log10(np.maximum(bands, np.finfo(float).tiny))
    elif rectify == "cubic_root":
        z = np.cbrt(bands)
    else:
        raise ValueError(f"unknown rectification {rectify!r}")
    return z @ dct_matrix(bands.shape[1], n).T


def deltas(c: np.ndarray, length: int = 9) -> np.ndarray:
    """Slopes over an odd number of frames, causal, zeros before the start."""
    m = length // 2
    b = np.arange(m, -m - 1, -1) / (2 * (np.arange(1, m + 1) ** 2).sum())
    return np.stack([np.convolve(column, b)[: len(column)] for column in c.T], 1) if len(c) else c


def centroid_and_spread(spectrum: np.ndarray, freqs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.maximum(spectrum.sum(1), np.finfo(float).tiny)
    c = spectrum @ freqs / total
    return c, np.sqrt((spectrum * (freqs[None] - c[:, None]) ** 2).sum(1) / total)


def spectral_shape(spectrum: np.ndarray, freqs: np.ndarray) -> dict[str, np.ndarray]:
    """Usual descriptors of each frame's spectrum."""
    tiny = np.finfo(float).tiny
    total = np.maximum(spectrum.sum(1), tiny)
    c, s = centroid_and_spread(spectrum, freqs)
    d, sd = freqs[None] - c[:, None], np.maximum(s, tiny)
    p = spectrum / total[:, None]
    unit = spectrum / np.maximum(np.linalg.norm(spectrum, axis=1, keepdims=True), tiny)
    f0 = freqs - freqs.mean()
    share = np.cumsum(p, 1)
    rest = np.maximum(spectrum[:, 1:].sum(1), tiny)
    return {
        "centroid": c,
        "spread": s,
        "skewness": (p * d**3).sum(1) / sd**3,
        "kurtosis": (p * d**4).sum(1) / sd**4,
        "entropy": -(p * np.log2(np.maximum(p, tiny))).sum(1) / math.log2(max(len(freqs), 2)),
        "flatness": np.exp(np.log(np.maximum(spectrum, tiny)).mean(1)) / np.maximum(spectrum.mean(1), tiny),
        "crest": spectrum.max(1) / np.maximum(spectrum.mean(1), tiny),
        "flux": np.concatenate(([0.0], np.linalg.norm(np.diff(unit, axis=0), axis=1)))[: len(spectrum)],
        "slope": (spectrum - spectrum.mean(1, keepdims=True)) @ f0 / max(float((f0**2).sum()), tiny),
        "decrease": ((spectrum[:, 1:] - spectrum[:, :1]) / np.arange(1, len(freqs))).sum(1) / rest,
        "rolloff": freqs[(share >= 0.95).argmax(1)],
    }


# -- pitch ------------------------------------------------------------------------------


def peak_in_range(score: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places of each row's largest value in [low, high]; the first of equal ones."""
    high = min(high, score.shape[1] - 1)
    return score[:, low : high + 1].argmax(1) + low


def peak_candidates(score: np.ndarray, n: int, low: int, high: int, apart: int) -> np.ndarray:
    """The n highest places of each row, each at least ``apart`` from the ones before."""
    s, out = score.copy(), np.empty((len(score), n), int)
    for k in range(n):
        out[:, k] = peak_in_range(s, low, high)
        for i, p in enumerate(out[:, k]):
            s[i, max(p - apart, 0) : p + apart + 1] = -np.inf
    return out


def linear_prediction(x: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """(coefficients with a leading 1, error) by the Levinson recursion."""
    r = np.array([x[: len(x) - k] @ x[k:] for k in range(order + 1)])
    a, e = np.zeros(order + 1), float(r[0])
    a[0] = 1.0
    for k in range(1, order + 1):
        if e <= 0:
            break
        reflection = -(r[k] + a[1:k] @ r[k - 1 : 0 : -1]) / e
        a[1 : k + 1] += reflection * a[k - 1 :: -1][:k]
        e *= 1 - reflection**2
    return a, e


def prediction_residual(x: np.ndarray, size: int, overlap: int, order: int) -> np.ndarray:
    """Residual of framewise linear prediction, put together by overlap and add."""
    hop, w = size - overlap, window_function("hann", size)
    out = np.zeros(len(x))
    for i, f in enumerate(frames(x, size, overlap)):
        f = f * w
        a, _ = linear_prediction(f, order)
        r = np.convolve(f, a)[:size]
        power = float(r @ r)
        out[i * hop : i * hop + size] += r * math.sqrt(float(f @ f) / power) if power > 0 else r
    return out


def _correlogram(f: np.ndarray) -> np.ndarray:
    n = f.shape[1]
    z = np.fft.rfft(f, 2 ** math.ceil(math.log2(2 * n)), axis=1)
    return np.fft.irfft(np.abs(z) ** 2, axis=1)[:, :n]


def pitch_comb(log_freqs: np.ndarray, harmonics: int = 10, gamma: float = 1.8) -> np.ndarray:
    """Filter on a log-frequency axis with peaks at the harmonics, summing to zero."""
    q = 10.0**log_freqs
    h = 1 / (gamma - np.cos(2 * np.pi * q))
    inside = (q > 0.5) & (q < harmonics + 0.5)
    h = np.where(inside, h, 0.0)
    h[inside] -= h[inside].mean()
    return h / np.abs(h).sum()


def pitch(x: np.ndarray, rate: int, method: str = "nfc", size: int | None = None, overlap: int | None = None, low: float = 50.0, high: float = 400.0) -> np.ndarray:
    """f0 of each frame.

    nfc: peak of the normalised autocorrelation; srh: summed residual harmonics; pef: comb filter
    on the log-frequency spectrum; cep: peak of the cepstrum; lhs: sum of log harmonics.
    """
    size = size or round(rate * 0.052)
    overlap = round(rate * 0.042) if overlap is None else overlap
    x = np.asarray(x, float)
    if len(x) < size:
        return np.empty(0)
    shortest, longest = max(int(rate / high), 1), int(rate / low)
    if method == "nfc":
        f = frames(x, size, overlap)
        r = _correlogram(f)
        energy = np.sqrt(np.maximum(np.cumsum(f[:, ::-1] ** 2, 1)[:, ::-1] * r[:, :1], np.finfo(float).tiny))
        return rate / peak_in_range(r / energy, shortest, min(longest, size - 1))
    if method == "cep":
        f = frames(x, size, overlap) * window_function("hamming", size, False)
        n = 2 ** math.ceil(math.log2(2 * size))
        c = np.fft.irfft(np.log(np.maximum(np.abs(np.fft.rfft(f, n, axis=1)) ** 2, 1e-12)), axis=1)
        return rate / peak_in_range(c, shortest, min(longest, size - 1))
    if method in ("lhs", "srh"):
        source = prediction_residual(x, round(rate * 0.025) or 2, round(rate * 0.02), 12) if method == "srh" else x
        w = window_function("hamming", size, False)
        e = np.abs(np.fft.rfft(frames(source, size, overlap) * w, rate, axis=1))  # bins of one hertz
        e = e / np.maximum(np.sqrt((e**2).sum(1, keepdims=True)), 1e-12)
        e = np.log(e + 1e-12) if method == "lhs" else e
        f0 = np.arange(int(low), int(high) + 1)
        score = e[:, f0].copy()
        for k in range(2, 6):
            score += e[:, np.minimum(k * f0, e.shape[1] - 1)]
            if method == "srh":
                score -= e[:, np.minimum(np.round((k - 0.5) * f0).astype(int), e.shape[1] - 1)]
        return f0[score.argmax(1)].astype(float)
    if method == "pef":
        n = 2 ** math.ceil(math.log2(2 * size))
        p = np.abs(np.fft.rfft(frames(x, size, overlap) * window_function("hamming", size, False), n, axis=1))
        axis = np.linspace(math.log10(10), math.log10(min(rate / 2 - 1, 4000)), n)
        bins = np.arange(n // 2 + 1) * rate / n
        y = np.stack([np.interp(10**axis, bins, row) for row in p]) if len(p) else np.empty((0, n))
        step = axis[1] - axis[0]
        shift = np.arange(int(math.log10(0.5) / step), int(math.log10(10.5) / step))
        comb = pitch_comb(shift * step)
        score = np.stack([np.correlate(np.pad(row, (-shift[0], shift[-1] + 1)), comb, "valid")[:n] for row in y]) if len(y) else y
        lo, hi = np.searchsorted(axis, (math.log10(low), math.log10(high)))
        return 10 ** axis[peak_in_range(score, int(lo), int(hi))] if len(score) else np.empty(0)
    raise ValueError(f"unknown pitch method {method!r}")


def spectrum_pitch(bands: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Frequency of the highest band of each frame."""
    return freqs[bands.argmax(1)] if len(bands) else np.empty(0)


def parabolic(y: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(height, place) of the parabola through each row's value at k and its neighbours."""
    i = np.arange(len(y))
    k = np.clip(k, 1, y.shape[1] - 2)
    a, b, c = y[i, k - 1], y[i, k], y[i, k + 1]
    bend = a - 2 * b + c
    move = np.where(np.abs(bend) > 1e-15, 0.5 * (a - c) / np.where(bend == 0, 1, bend), 0.0)
    return b - 0.25 * (a - c) * move, k + move


def harmonic_ratio(x: np.ndarray, rate: int, size: int | None = None, overlap: int | None = None) -> np.ndarray:
    """Largest normalised autocorrelation past the first zero crossing, interpolated, in [0, 1].

    Lags go up to half a frame, as longer ones rest on few samples.
    """
    size = size or round(rate * 0.03)
    overlap = round(rate * 0.02) if overlap is None else overlap
    f = frames(np.asarray(x, float), size, overlap)
    if not len(f):
        return np.empty(0)
    r = _correlogram(f)
    head, tail = np.cumsum(f**2, 1)[:, ::-1], np.cumsum(f[:, ::-1] ** 2, 1)[:, ::-1]  # of what overlaps at each lag
    g = r / np.sqrt(np.maximum(head * tail, np.finfo(float).tiny))
    top = min(int(rate * 0.04), size // 2)
    out = np.zeros(len(g))
    for i, row in enumerate(g):
        zero = np.flatnonzero(row[1:top] <= 0)
        start = int(zero[0]) + 1 if len(zero) else top
        if start < top:
            k = int(row[start:top].argmax()) + start
            out[i] = parabolic(row[None], np.array([k]))[0][0]
    return np.clip(out, 0, 1)


def mask_pitch(f0: np.ndarray, ratio: np.ndarray, least: float = 0.85) -> np.ndarray:
    """f0 with NaN where the frame is not harmonic."""
    n = min(len(f0), len(ratio))
    return np.where(ratio[:n] < least, np.nan, f0[:n])


# -- wavelets ---------------------------------------------------------------------------


def wavelet_scales(kind: str, n: int, per_octave: int = 10, gamma: float = 3.0, beta: float = 20.0, cutoff: float = 0.5) -> tuple[np.ndarray, float]:
    """(scales, centre frequency): from the shortest that stays below Nyquist to half the signal."""
    center = {"morse": (beta / gamma) ** (1 / gamma), "morlet": 6.0, "bump": 5.0}[kind]
    high = _cutoff(kind, gamma, beta, cutoff)
    shortest, longest = high / np.pi, n / (2 * math.sqrt(2) * {"morse": math.sqrt(beta * gamma) / center, "morlet": 1.0, "bump": 5 / 0.6}[kind])
    octaves = max(math.log2(max(longest / shortest, 2)), 1 / per_octave)
    return shortest * 2 ** (np.arange(int(octaves * per_octave) + 1) / per_octave), center


def _response(kind: str, w: np.ndarray, gamma: float, beta: float) -> np.ndarray:
    """Response of the unscaled wavelet, 2 at its peak and 0 for negative frequencies."""
    out = np.zeros_like(w)
    on = w > 0
    v = w[on]
    if kind == "morse":
        peak = (beta / gamma) ** (1 / gamma)
        out[on] = 2 * np.exp(beta * np.log(v / peak) - v**gamma + peak**gamma)
    elif kind == "morlet":
        out[on] = 2 * np.exp(-((v - 6) ** 2) / 2)
    elif kind == "bump":
        u = (v - 5) / 0.6
        near = np.abs(u) < 1 - 1e-12
        b = np.zeros_like(v)
        b[near] = 2 * np.exp(1 - 1 / (1 - u[near] ** 2))
        out[on] = b
    else:
        raise ValueError(f"unknown wavelet {kind!r}")
    return out


def _cutoff(kind: str, gamma: float, beta: float, share: float) -> float:
    """Frequency above the peak where the response falls to ``share`` of it, by bisection."""
    low = {"morse": (beta / gamma) ** (1 / gamma), "morlet": 6.0, "bump": 5.0}[kind]
    high = low * 4
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _response(kind, np.array([mid]), gamma, beta)[0] > 2 * share else (low, mid)
    return (low + high) / 2


def wavelet_bank(kind: str, n: int, rate: int, low: float = 0.0, per_octave: int = 10, gamma: float = 3.0, beta: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """(responses at the n transform bins, centre frequencies), bands below ``low`` left out."""
    scales, center = wavelet_scales(kind, n, per_octave, gamma, beta)
    freqs = center / scales / (2 * np.pi) * rate
    scales, freqs = scales[freqs >= low], freqs[freqs >= low]
    w = 2 * np.pi * np.arange(n) / n
    w[n // 2 + 1 :] = -1
    return np.stack([_response(kind, np.where(w > 0, w * s, w), gamma, beta) for s in scales]) if len(scales) else np.empty((0, n)), freqs


@functools.lru_cache(maxsize=4)
def kept_wavelet_bank(kind: str, n: int, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """The bank of the usual settings, made once for clips of one length; it cannot be written to."""
    made = wavelet_bank(kind, n, rate)
    for a in made:
        a.setflags(write=False)
    return made


def wavelet_transform(x: np.ndarray, bank: np.ndarray) -> np.ndarray:
    """Bands x samples, by products in the frequency domain."""
    return np.fft.ifft(np.fft.fft(x)[None] * bank, axis=1)


# -- speech -----------------------------------------------------------------------------


def moving_median(x: np.ndarray, width: int) -> np.ndarray:
    p = width // 2
    inner = np.median(np.lib.stride_tricks.sliding_window_view(x, 2 * p + 1), axis=1) if len(x) > 2 * p else np.empty(0)
    first = min(p, len(x))
    edge = lambda i: np.median(x[max(i - p, 0) : i + p + 1])  # noqa: E731  of fewer values
    return np.array([*map(edge, range(first)), *inner, *map(edge, range(first + len(inner), len(x)))])


def _valley_threshold(x: np.ndarray, bins: int = 15, weight: float = 5.0) -> float:
    """Between the two first peaks of the histogram, nearer to the first; half the mean without two."""
    counts, edges = np.histogram(x, bins)
    padded = np.concatenate(([-1], counts, [-1]))
    peaks = np.flatnonzero((padded[1:-1] > padded[:-2]) & (padded[1:-1] >= padded[2:]) & (counts > 0))
    centre = (edges[:-1] + edges[1:]) / 2
    return float((weight * centre[peaks[0]] + centre[peaks[1]]) / (weight + 1)) if len(peaks) >= 2 else float(x.mean() / 2)


def runs(flags: np.ndarray) -> np.ndarray:
    """(start, end) of each run of true, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges.reshape(-1, 2)


def detect_speech(x: np.ndarray, rate: int, size: int | None = None, overlap: int = 0, gap: int | None = None, thresholds: tuple[float, float] | None = None) -> np.ndarray:
    """(start, end) samples of speech, end exclusive.

    Frames whose smoothed energy and spectral spread both exceed their thresholds are speech;
    runs less than ``gap`` samples apart are one.
    """
    size = size or round(rate * 0.03)
    gap = size * 5 if gap is None else gap
    x = np.asarray(x, float)
    f = frames(x, size, overlap)
    if not len(f):
        return np.empty((0, 2), int)
    peak = np.abs(x).max() or 1.0
    f = f / peak
    energy = moving_median(moving_median((f**2).sum(1), 5), 5)
    power = np.abs(np.fft.rfft(f * window_function("hann", size), axis=1)) ** 2
    _, spread = centroid_and_spread(power, np.arange(power.shape[1]) * rate / size)
    spread = moving_median(moving_median(spread, 5), 5)
    limits = thresholds or (_valley_threshold(energy), _valley_threshold(spread))
    found = runs((energy > limits[0]) & (spread > limits[1])) * (size - overlap)
    out: list[list[int]] = []
    for a, b in found.tolist():
        b = min(b + overlap, len(x))
        if out and a - out[-1][1] < gap:
            out[-1][1] = b
        else:
            out.append([a, b])
    return np.array(out, int).reshape(-1, 2)


# -- over tables ------------------------------------------------------------------------


def per_clip(df: DataFrame, kernel: Callable[[np.ndarray, int], dict], schema: str, key: str = "path", samples: str = "samples", rate: str = "sr") -> DataFrame:
    """``kernel(samples, rate)`` of every clip: a dict of the columns of ``schema`` after the key.

    Null or empty clips give nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [kernel(np.asarray(x.values, float), r.as_py()) if x.is_valid and len(x) and r.is_valid else {} for x, r in zip(batch.column(1), batch.column(2), strict=True)]
            columns = [pa.array([_plain(row.get(n)) for row in found], arrow.field(n).type) for n in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *columns], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = arrow.names
    return df.select(key, samples, rate).mapInArrow(run, schema)


def _plain(v):
    return v.tolist() if isinstance(v, np.ndarray) else v


def audio_features(df: DataFrame, kind: str = "mel", bands: int = 26, coefficients: int = 13) -> DataFrame:
    """path, names of features and their mean over the frames of each clip: mel, mfcc or spectrals."""
    if kind not in ("mel", "mfcc", "spectrals"):
        raise ValueError(f"unknown feature set {kind!r}")

    def kernel(x: np.ndarray, rate: int) -> dict:
        spec, freqs = stft(x, rate)
        if not len(spec):
            return {}
        if kind == "spectrals":
            values = {k: float(np.nanmean(v)) for k, v in spectral_shape(spec, freqs).items()}
        else:
            bank = triangular_filterbank(band_edges("mel_htk", bands, 0, rate / 2), default_fft(rate), rate)
            m = band_spectrum(spec, bank)
            m = cepstra(m, coefficients) if kind == "mfcc" else m
            values = {f"{kind}{i + 1}": float(v) for i, v in enumerate(m.mean(0))}
        return {"names": list(values), "values": list(values.values())}

    return per_clip(df, kernel, "path string, names array<string>, values array<double>")


# -- signals longer than a row ------------------------------------------------------------

#: Samples of a tile of a long signal, about.
TILE = 1 << 16


def tiles(chunks: DataFrame, size: int, overlap: int, tile: int = TILE) -> DataFrame:
    """path, sr, tile, first, samples of signals that come in chunks (path, sr, start, samples).

    A tile holds the samples from ``tile`` times its length on, a multiple of the hop, and the
    size - 1 samples behind it, so the frames that begin in it are whole; ``first`` is the number of its
    first frame in the signal. Chunks of any lengths are cut where tiles meet, so a signal is
    spread over its tiles and no task holds it. Chunks without samples do not matter; chunks of a
    signal that overlap or leave a gap are an error.
    """
    hop = size - overlap
    if hop < 1:
        raise ValueError("the overlap is smaller than the frame")
    tile = max(tile // hop, 1) * hop
    n, start = F.size("samples"), F.col("start").cast("long")
    rows = chunks.where(n > 0).select("path", "sr", start.alias("start"), F.col("samples").cast("array<double>").alias("samples"))
    first = F.greatest(F.floor((F.col("start") - (size - 1)) / tile), F.lit(0))
    rows = rows.withColumn("tile", F.explode(F.sequence(first, F.floor((F.col("start") + n - 1) / tile))))
    low = F.greatest(F.col("start"), F.col("tile") * tile)
    high = F.least(F.col("start") + n, (F.col("tile") + 1) * tile + size - 1)
    piece = F.struct(low.alias("at"), F.slice("samples", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("x"))
    held = rows.where(high > low).groupBy("path", "sr", "tile").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    ends = F.transform("p", lambda q: q["at"] + F.size(q["x"]))
    begins = F.transform("p", lambda q: q["at"])
    whole = F.forall(F.arrays_zip(F.slice(begins, 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("b"), F.slice(ends, 1, F.greatest(F.size("p") - 1, F.lit(0))).alias("e")), lambda z: z["b"] == z["e"])
    whole = whole & (F.get(begins, F.lit(0)) == F.col("tile") * tile)
    samples = F.when(whole, F.flatten(F.transform("p", lambda q: q["x"]))).otherwise(F.raise_error(F.concat(F.lit("chunks of a signal overlap or leave a gap: "), F.col("path"))).cast("array<double>"))
    return held.select("path", "sr", "tile", (F.col("tile") * tile / hop).cast("long").alias("first"), samples.alias("samples"))


def per_frame(chunks: DataFrame, kernel: Callable[[np.ndarray, int], dict], names: list[str], size: int, overlap: int, tile: int = TILE) -> DataFrame:
    """path, frame, names: what a kernel gives for each frame of signals in chunks (path, sr, start, samples).

    ``kernel(samples, rate)`` gives a number for each frame under each name, in arrays; frames are numbered
    over the whole signal.
    """
    cut = tiles(chunks, size, overlap, tile).withColumn("key", F.concat_ws(" ", F.col("first").cast("string"), "path"))
    found = per_clip(cut, kernel, "key string, " + ", ".join(f"{n} array<double>" for n in names), key="key")
    rows = found.select("key", F.posexplode(F.arrays_zip(*names)).alias("k", "x"))
    first = F.substring_index("key", " ", 1).cast("long")
    path = F.expr("substring(key, length(substring_index(key, ' ', 1)) + 2)")
    return rows.select(path.alias("path"), (first + F.col("k")).alias("frame"), *[F.col(f"x.{n}").alias(n) for n in names])
