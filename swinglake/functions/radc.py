"""Frames of the angle radar in numpy, a batch of frames at a time: payloads, spectra, peaks, angles, coherence, fringes.

A frame's payload is six runs of 256 unsigned 16-bit codes: I and Q of two receivers at one frequency, and of the first at
another. All functions take and give arrays whose first axis is the frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values of the radar: payload, spectrum, speed range, antenna, and the width of a peak and of its core in bins.
SAMPLES, FFT, MASK, TOP_KMH = 256, 2048, 8, 100.0
CHANNELS = ("f1a_i", "f1a_q", "f2a_i", "f2a_q", "f1b_i", "f1b_q")
PAYLOAD = 2 * SAMPLES * len(CHANNELS)
WAVELENGTH_M, SPACING_M = 3e8 / 24.125e9, 8.0e-3
PEAK_HALF, CORE_HALF = 16, 4
#: Bins of high positive speed, where a club's energy lies.
CLUB_LOW = 150
#: Windows of a frame's parts in time.
PART, PART_STEP = 64, 16
#: Names of spectra that combine up to three channels' magnitudes.
SOURCES = ("f1a", "f2a", "f1b", "sum12", "min12", "geom12", "sum1b", "sumall")
#: Frames that are transformed together.
TOGETHER = 128


def decode(payload: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of whole payloads, their codes as frame x channel x sample); payloads of another length are left out."""
    sizes = pc.fill_null(pc.binary_length(payload), 0).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(sizes == PAYLOAD)
    data = b"".join(payload.take(pa.array(whole)).to_pylist())
    return whole, np.frombuffer(data, "<u2").reshape(-1, len(CHANNELS), SAMPLES)


def complex_channels(codes: np.ndarray) -> np.ndarray:
    """Frame x receiver x sample, each of I and Q without its mean."""
    x = codes.astype(float)
    x -= x.mean(axis=-1, keepdims=True)
    return x[:, 0::2] + 1j * x[:, 1::2]


def spectra(x: np.ndarray, fft: int = FFT, mask: int = MASK) -> np.ndarray:
    """Spectra of Hann-windowed samples (last axis), padded to ``fft``, with ``mask`` bins on both sides of zero speed silenced."""
    out = np.fft.fft(x * np.hanning(x.shape[-1]), fft, axis=-1)
    if mask:
        out[..., :mask] = 0
        out[..., -mask:] = 0
    return out


def combined(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    """The magnitudes of three channels by every source: alone, averaged, the lesser, and the geometric mean."""
    return dict(zip(SOURCES, (a, b, c, (a + b) / 2, np.minimum(a, b), np.sqrt(a * b), (a + c) / 2, (a + b + c) / 3), strict=True))


def source(x: np.ndarray, name: str) -> np.ndarray:
    """One of the :func:`combined` magnitudes of frames' spectra; only what it needs is computed for a channel alone."""
    alone = {"f1a": 0, "f2a": 1, "f1b": 2}
    return np.abs(x[:, alone[name]]) if name in alone else combined(*np.abs(x).transpose(1, 0, 2))[name]


def arrival(cross: np.ndarray) -> np.ndarray:
    """Degrees from the phase between the receivers."""
    return np.degrees(np.arcsin(np.clip(np.angle(cross) * WAVELENGTH_M / (2 * np.pi * SPACING_M), -1, 1)))


def floor_of(magnitude: np.ndarray) -> np.ndarray:
    """The median of each frame's bins above zero; 0 where there is none."""
    n = (magnitude > 0).sum(axis=-1)
    ranked = np.sort(magnitude, axis=-1)  # what isn't above zero comes first
    row, first = np.arange(len(magnitude)), magnitude.shape[-1] - n
    last = magnitude.shape[-1] - 1
    return np.where(n > 0, (ranked[row, np.minimum(first + (n - 1) // 2, last)] + ranked[row, np.minimum(first + n // 2, last)]) / 2, 0.0)


def bin_distance(a: np.ndarray, b: np.ndarray, fft: int = FFT) -> np.ndarray:
    """Bins between two places of a spectrum that closes on itself."""
    d = np.abs(a - b)
    return np.minimum(d, fft - d)


def strongest(magnitude: np.ndarray, bands: np.ndarray, near: np.ndarray | None = None, within: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, magnitude, low and high of its band) of each frame's strongest bin in its bands; bin -1 where none is above zero.

    ``bands``: frame x band x (low, high), half open. With ``near``, only bins within ``within`` of that one.
    """
    n, fft = magnitude.shape
    at, value, band = np.full(n, -1), np.zeros(n), np.zeros((n, 2), int)
    bins = np.arange(fft)
    for k in range(bands.shape[1]):
        inside = (bins >= bands[:, k, :1]) & (bins < bands[:, k, 1:])
        if near is not None:
            inside &= bin_distance(bins[None], near[:, None], fft) <= within
        m = np.where(inside, magnitude, 0.0)
        best = m.argmax(axis=1)
        top = m[np.arange(n), best]
        take = top > value
        at[take], value[take], band[take] = best[take], top[take], bands[take, k]
    return at, value, band


def around(peak: np.ndarray, band: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(bins within ``half`` of each peak, which of them lie in its band)."""
    bins = peak[:, None] + np.arange(-half, half + 1)
    return np.clip(bins, 0, None), (bins >= band[:, :1]) & (bins < band[:, 1:])


def peak_angles(a: np.ndarray, b: np.ndarray, magnitude: np.ndarray, peak: np.ndarray, band: np.ndarray, floor_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(angle, bins in the peak, coherence of the core) of each frame's peak.

    The angle is the power-weighted mean over the bins that reach ``floor_share`` of the peak (1: the peak's own).
    Coherence is of the two receivers' spectra, weighted by magnitude; not a number where a receiver is silent.
    """
    rows = np.arange(len(peak))[:, None]
    bins, inside = around(peak, band, PEAK_HALF)
    bins = np.minimum(bins, magnitude.shape[1] - 1)
    m = np.where(inside, magnitude[rows, bins], 0.0)
    top = magnitude[rows[:, 0], peak]
    m[m < floor_share * top[:, None]] = 0.0
    if floor_share >= 1.0:
        m[:] = 0.0
        m[:, PEAK_HALF] = top
    angles = arrival(a[rows, bins] * np.conj(b[rows, bins]))
    power = m * m
    total = power.sum(axis=1)
    angle = np.divide((angles * power).sum(axis=1), total, out=angles[:, PEAK_HALF].copy(), where=total > 0)
    bins, inside = around(peak, band, CORE_HALF)
    bins = np.minimum(bins, magnitude.shape[1] - 1)
    w = np.where(inside, magnitude[rows, bins], 0.0)
    x, y = a[rows, bins], b[rows, bins]
    sizes = np.sqrt((w * np.abs(x) ** 2).sum(axis=1) * (w * np.abs(y) ** 2).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        coherence = np.clip(np.abs((w * x * np.conj(y)).sum(axis=1)) / sizes, 0, 1)
    return angle, (m > 0).sum(axis=1), np.where(sizes > 0, coherence, np.nan)


def fringes(a: np.ndarray, b: np.ndarray, peak: np.ndarray, fft: int = FFT, part: int = PART, step: int = PART_STEP, half: int = PEAK_HALF, mask: int = MASK) -> dict[str, np.ndarray]:
    """How the angle and the balance of the receivers move within each frame, over short parts that overlap.

    ``a``, ``b``: samples. In each part the strongest bin near the frame's peak is followed: parts where a receiver is silent there
    don't count. Gives the number of parts, the swing and deviation of the angle, and the least and largest balance.
    """
    starts = np.arange(0, a.shape[1] - part + 1, step)
    at = starts[:, None] + np.arange(part)
    bins = peak[:, None] + np.arange(-half, half + 1)
    dark = (bins < 0) | (bins >= fft) | (bins < mask) | (bins >= fft - mask)
    waves = np.exp(-2j * np.pi * bins[:, None, :] * np.arange(part)[None, :, None] / fft) * np.hanning(part)[None, :, None]
    x, y = a[:, at] @ waves, b[:, at] @ waves  # frame x part x bin: only the bins that are looked at
    x[np.broadcast_to(dark[:, None], x.shape)] = 0
    y[np.broadcast_to(dark[:, None], y.shape)] = 0
    best = (np.abs(x) + np.abs(y)).argmax(axis=2)[..., None]
    x, y = np.take_along_axis(x, best, 2)[..., 0], np.take_along_axis(y, best, 2)[..., 0]
    fine = (np.abs(x) > 0) & (np.abs(y) > 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        balance = np.where(fine, np.abs(y) / np.abs(x), np.nan)
    angle = np.where(fine, arrival(x * np.conj(y)), np.nan)
    n, some = fine.sum(axis=1), fine.any(axis=1)
    out = {"parts": n}
    for name, f, v in (("swing", np.ptp, angle), ("deviation", np.std, angle), ("balance_min", np.min, balance), ("balance_max", np.max, balance)):
        out[name] = np.array([f(row[ok]) if s else np.nan for row, ok, s in zip(v, fine, some, strict=True)])
    return out


def angle_power(a: np.ndarray, b: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """Power of two receivers' spectra (frame x bin) steered to each angle: frame x angle x bin."""
    turn = np.exp(-2j * np.pi * SPACING_M * np.sin(np.radians(angles)) / WAVELENGTH_M)
    return np.abs(a[:, None] + b[:, None] * turn[None, :, None]) ** 2


def detections(magnitude: np.ndarray, factor: float, guard: int = 4, train: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, bin, ratio to the median of its training cells) of bins above ``factor`` times it.

    Only bins with all cells on both sides are looked at.
    """
    margin = guard + train
    n = magnitude.shape[1]
    if n <= 2 * margin:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    windows = np.lib.stride_tricks.sliding_window_view(magnitude, 2 * margin + 1, axis=1)
    cells = np.concatenate((windows[..., :train], windows[..., -train:]), axis=-1)
    noise = np.median(cells, axis=-1)
    m = magnitude[:, margin : n - margin]
    frame, at = np.nonzero((noise > 0) & (m > factor * noise))
    return frame, at + margin, m[frame, at] / noise[frame, at]
