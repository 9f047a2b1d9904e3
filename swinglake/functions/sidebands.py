"""Spin from the sidebands of a ball's tone, in numpy: where the ball is first heard, the tone's course, and the comb around it."""

from __future__ import annotations

import numpy as np

from swinglake.functions.spin import FS, MPS_TO_MPH, WAVELENGTH_M

# First hearing (windows, least frequency, factor), course of the tone, comb and plausible spin.
HEAR_WINDOW, HEAR_STEP, HEAR_LOW_HZ, HEAR_FACTOR, HEAR_QUIET = 128, 32, 2000.0, 3.0, 5
COURSE_WINDOW, COURSE_STEP, COURSE_HZ, COURSE_SNR, COURSE_LEAST = 256, 64, 900.0, 3.0, 5
COMB_FFT, COMB_LOW, COMB_HIGH, COMB_STEP = 1 << 17, 33.0, 400.0, 0.5
HARMONICS, SHARES, ODD_SHARE = (1.0, 2.0, 3.0), (1.0, 0.6, 0.35), 0.35
LEAST_MS, PLAUSIBLE = 25.0, (1500.0, 13000.0)


def windows(x: np.ndarray, size: int, step: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[::step] if len(x) >= size else np.zeros((0, size), x.dtype)


def onset_ms(x: np.ndarray) -> float | None:
    """When a tone well above still clutter is first heard, against the strongest lines of the first windows; None if never."""
    s = np.abs(np.fft.fft(windows(x - x.mean(), HEAR_WINDOW, HEAR_STEP) * np.hanning(HEAR_WINDOW), axis=1))
    low = int(HEAR_LOW_HZ * HEAR_WINDOW / FS)
    top = np.maximum(s[:, low : HEAR_WINDOW // 2].max(axis=1, initial=0), s[:, HEAR_WINDOW // 2 + 1 : HEAR_WINDOW - low].max(axis=1, initial=0))
    if len(top) <= HEAR_QUIET:
        return None
    loud = np.flatnonzero(top[HEAR_QUIET:] > HEAR_FACTOR * np.median(top[:HEAR_QUIET]))
    return float(((loud[0] + HEAR_QUIET) * HEAR_STEP + HEAR_WINDOW // 2) / FS * 1000) if len(loud) else None


def course(x: np.ndarray, mph: float, start: int) -> tuple[np.ndarray, int] | None:
    """(polynomial of the tone's frequency over seconds, sample at which it is lost), followed from ``start``; None if it is hardly heard.

    The course ends at the first window without the tone once enough had it; windows without it before that are passed over.
    """
    expected = 2 * mph / MPS_TO_MPH / WAVELENGTH_M
    f = np.fft.fftfreq(COURSE_WINDOW, 1 / FS)
    band = np.flatnonzero((np.abs(f - expected) <= COURSE_HZ) & (f > 0))
    w = windows(x[start:-1], COURSE_WINDOW, COURSE_STEP)
    if not len(band) or not len(w):
        return None
    s = np.abs(np.fft.fft(w * np.hanning(COURSE_WINDOW), axis=1))
    floor = np.array([np.median(r[r > 0]) if (r > 0).any() else 1.0 for r in s])
    at = s[:, band].argmax(axis=1)
    top = s[np.arange(len(s)), band[at]]
    heard = top / floor >= COURSE_SNR
    lost = np.flatnonzero(~heard & (np.cumsum(heard) >= COURSE_LEAST))
    heard[lost[0] if len(lost) else len(heard) :] = False
    places = np.flatnonzero(heard)
    if len(places) < COURSE_LEAST:
        return None
    t = (start + places * COURSE_STEP + COURSE_WINDOW / 2) / FS
    line = np.polyfit(t, f[band[at[places]]], 2 if len(places) >= 8 else 1, w=np.sqrt(top[places]))
    return line, start + int(places[-1]) * COURSE_STEP + COURSE_WINDOW


def straightened(x: np.ndarray, line: np.ndarray, start: int, end: int) -> np.ndarray:
    """The tone turned back along its course, so that it rests at zero frequency."""
    t = np.arange(start, end) / FS
    return x[start:end] * np.exp(-2j * np.pi * np.polyval(np.polyint(line), t))


def side_ratio(half: np.ndarray, k: np.ndarray, cell: int, ring: int) -> np.ndarray:
    """The strongest of the ``cell`` bins around each k, against the median of the bins around those up to ``ring``; bin 0 doesn't count."""
    inner, outer = np.arange(-cell, cell + 1), np.concatenate((np.arange(-ring, -cell), np.arange(cell + 1, ring)))
    around = half[np.maximum(k[:, None] + outer, 0)]
    middle = len(outer) // 2
    places = (middle - 1, middle) if len(outer) % 2 == 0 else (middle,)
    medians = np.partition(around, places, axis=1)[:, list(places)].mean(axis=1)
    for row in np.flatnonzero(k - ring < 1):
        medians[row] = np.median(around[row, k[row] + outer >= 1])
    return half[k[:, None] + inner].max(axis=1) / medians


def pairs(spectrum: np.ndarray, frequencies: np.ndarray, samples: int) -> np.ndarray:
    """How far both sidebands at each frequency stand out: the lesser of the two; 0 where their surroundings leave the spectrum."""
    step = FS / COMB_FFT
    cell = max(1, round(FS / samples / 2 / step))
    ring = 8 * cell
    k = np.rint(frequencies / step).astype(int)
    fine = (k - ring >= 1) & (k + ring < COMB_FFT // 2)
    out = np.zeros(len(k))
    if fine.any():
        upper, lower = spectrum[: COMB_FFT // 2], spectrum[COMB_FFT // 2 :][::-1]  # lower: -1, -2 and so on
        out[fine] = np.minimum(side_ratio(upper, k[fine], cell, ring), side_ratio(lower, k[fine] - 1, cell, ring))
    return out


def comb(tone: np.ndarray) -> dict | None:
    """The spacing of the sidebands, how far its comb stands out, and the spin it means: a turn, or half of one for a seam seen twice."""
    spectrum = np.abs(np.fft.fft(tone * np.hanning(len(tone)), COMB_FFT))
    tried = np.arange(COMB_LOW, COMB_HIGH, COMB_STEP)
    # harmonics of some frequencies are frequencies of others: each bin is looked at once
    bins, place = np.unique(np.rint(np.outer(HARMONICS, tried) / (FS / COMB_FFT)).astype(int), return_inverse=True)
    heights = pairs(spectrum, bins * (FS / COMB_FFT), len(tone))[place.reshape(len(HARMONICS), -1)]
    score = sum(share * row for share, row in zip(SHARES, heights, strict=True))
    best = int(np.argmax(score))
    if score[best] <= 0:
        return None
    spacing, once = float(tried[best]), float(tried[best]) * 60
    odd = float(pairs(spectrum, np.array([1.5 * spacing]), len(tone))[0])
    twice = odd >= ODD_SHARE * score[best] or once > PLAUSIBLE[1] and once / 2 >= PLAUSIBLE[0]
    return {"spacing_hz": spacing, "score": float(score[best]), "odd": odd, "seen": "2x" if twice else "1x", "rpm": once / 2 if twice else once}


def sideband_spin(i: np.ndarray, q: np.ndarray, mph: float, start_ms: float) -> dict | None:
    """The comb's answer for a capture; None where the tone isn't heard for long enough."""
    x = (i - np.mean(i)) + 1j * (q - np.mean(q))
    start = max(0, int(start_ms * FS / 1000))
    found = course(x, mph, start) if start < len(x) - COURSE_WINDOW else None
    if found is None or (found[1] - start) / FS * 1000 < LEAST_MS:
        return None
    answer = comb(straightened(x, found[0], start, found[1]))
    return answer and answer | {"heard_ms": (found[1] - start) / FS * 1000, "drift_hz_s": float(np.polyval(np.polyder(found[0]), start / FS))}
