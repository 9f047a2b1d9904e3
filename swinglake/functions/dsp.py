"""Signal processing in numpy, one batch of rows at a time; Spark deals the rows."""

from __future__ import annotations

import numpy as np

# Fixed values of the speed radar: sampling, sizes, bins that are looked at, and what a bin is in mph.
FS, BLOCK, FFT = 30_000, 128, 4096
LOW_BIN, HIGH_BIN = 150, 2047
PEAK_FLOOR, PEAK_GAP, PEAKS = 3.0, 50, 3
MPH_PER_BIN = FS / FFT * 0.01243 / 2 * 2.23694


def blocks(i: np.ndarray, q: np.ndarray, step: int, size: int = BLOCK) -> np.ndarray:
    """Overlapping complex blocks, each channel without its block mean and in volts."""
    starts = np.arange(0, len(i) - size + 1, step)
    at = starts[:, None] + np.arange(size)
    a, b = i[at].astype(float), q[at].astype(float)
    return ((a - a.mean(1, keepdims=True)) + 1j * (b - b.mean(1, keepdims=True))) * (3.3 / 4096)


def spectra(x: np.ndarray, fft: int = FFT) -> np.ndarray:
    """Magnitudes of Hann-windowed, zero-padded blocks."""
    return np.abs(np.fft.fft(x * np.hanning(x.shape[1]), fft, axis=1))


def peaks(spectrum: np.ndarray, floor: float = PEAK_FLOOR, gap: int = PEAK_GAP, most: int = PEAKS) -> list[int]:
    """Local maxima from the strongest on, none within ``gap`` bins of one already taken."""
    inner = spectrum[1:-1]
    found = np.flatnonzero((inner > spectrum[:-2]) & (inner > spectrum[2:]) & (inner >= floor)) + 1
    kept: list[int] = []
    for p in found[np.argsort(-spectrum[found], kind="stable")]:
        if all(abs(int(p) - k) >= gap for k in kept):
            kept.append(int(p))
            if len(kept) == most:
                break
    return kept


def speed_readings(i: np.ndarray, q: np.ndarray, step: int = BLOCK) -> list[tuple[float, float, float, str]]:
    """(window start in ms, mph, magnitude, direction) of a capture."""
    out = []
    for k, s in enumerate(spectra(blocks(i, q, step))):
        ms = k * step / FS * 1000
        for p in peaks(s[LOW_BIN : HIGH_BIN + 1]):
            out.append((ms, (p + LOW_BIN) * MPH_PER_BIN, float(s[p + LOW_BIN]), "outbound"))
        negative = s[FFT - LOW_BIN : FFT // 2 : -1]
        for p in peaks(negative):
            out.append((ms, (p + LOW_BIN) * MPH_PER_BIN, float(negative[p]), "inbound"))
    return out


def cfar(spectrum: np.ndarray, train: int = 16, guard: int = 4, factor: float = 3.0) -> list[tuple[int, float]]:
    """(bin, ratio to its noise) of bins above ``factor`` times the median of the training cells on both sides."""
    n = len(spectrum)
    out = []
    for k in range(n):
        cells = np.concatenate((spectrum[max(0, k - guard - train) : max(0, k - guard)], spectrum[k + guard + 1 : k + guard + 1 + train]))
        noise = float(np.median(cells)) if len(cells) else 0.0
        if noise > 0 and spectrum[k] > factor * noise:
            out.append((k, float(spectrum[k] / noise)))
    return sorted(out, key=lambda x: (-x[1], x[0]))
