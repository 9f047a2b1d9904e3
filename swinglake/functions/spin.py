"""Spin from the amplitude of a ball's Doppler tone, in numpy: the evidence of one capture.

The seam modulates the tone once a turn. The tone is cut out by a band-pass without phase, its envelope is trimmed to where the
ball is seen, and the envelope's spectrum over the seam's frequencies, with what speaks for and against each of its bins,
is what :mod:`swinglake.operators.spin` decides on.
"""

from __future__ import annotations

import numpy as np

# Sampling, wavelength, band around the tone, spectrum of the envelope and the seam's frequencies.
FS, WAVELENGTH_M, MPS_TO_MPH = 30_000, 0.01243, 2.23694
BAND_HZ, ORDER = 700, 4
FFT, LOW_HZ, HIGH_HZ = 8192, 33.0, 200.0
LEAST_SAMPLES, TREND = 600, 3
# Where the ball's signal is lost (smoothing, reference, share, duration).
SMOOTH, REFERENCE, LOST_SHARE, LOST_HOLD = 90, 450, 0.15, 150
#: Bins of the spectrum in the seam's band, and their frequencies.
BINS = np.flatnonzero((np.arange(FFT // 2) * FS / FFT >= LOW_HZ) & (np.arange(FFT // 2) * FS / FFT <= HIGH_HZ))
FREQUENCIES = BINS * FS / FFT
#: Lowest bins of the band that count as leakage of the mean.
LEAK = 1
#: Samples by which both ends are extended for the band-pass.
PAD = 1024


def band_pass(x: np.ndarray, low: float, high: float, fs: float = FS, order: int = ORDER) -> np.ndarray:
    """``x`` through a Butterworth band-pass forwards and backwards: the square of its gain on the spectrum, ends extended by odd reflection."""
    pad = min(len(x) - 1, PAD)
    y = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    warp = np.tan(np.pi * np.minimum(np.abs(np.fft.fftfreq(len(y))), 0.5 - 1e-9))
    a, b = np.tan(np.pi * low / fs), np.tan(np.pi * high / fs)
    with np.errstate(divide="ignore"):
        off = (warp * warp - a * b) / ((b - a) * warp)
    return np.fft.ifft(np.fft.fft(y) / (1 + off ** (2 * order)))[pad : pad + len(x)]


def signal_end(envelope: np.ndarray, start: int) -> int:
    """Where the ball's signal is lost for good, against its level at first; the end where it isn't."""
    tail = envelope[start:]
    if len(tail) < REFERENCE:
        return len(envelope)
    smooth = np.convolve(tail, np.full(SMOOTH, 1 / SMOOTH), mode="same")
    level = float(np.median(smooth[:REFERENCE]))
    runs = np.convolve(smooth < level * LOST_SHARE, np.ones(LOST_HOLD), mode="valid") > LOST_HOLD - 0.5
    return start + int(np.argmax(runs)) if level > 0 and runs.any() else len(envelope)


def seam_band(x: np.ndarray) -> np.ndarray:
    """Magnitudes of the Hann-windowed signal at the seam's bins."""
    return np.abs(np.fft.rfft(x * np.hanning(len(x)), FFT))[BINS]


def shoulders(band: np.ndarray, samples: int) -> np.ndarray:
    """For each bin the higher of the medians of its two sides, beyond the width that a tone has in so many samples; 0 without three live bins on a side."""
    gap = int(np.ceil(2 * FFT / max(samples, 1)))
    out = np.zeros(len(band))
    for k in range(len(band)):
        for side in (band[max(0, k - 3 * gap) : max(0, k - gap)], band[k + gap + 1 : k + 3 * gap + 1]):
            live = side[side > 0]
            if len(live) >= 3:
                out[k] = max(out[k], float(np.median(live)))
    return out


def lasting(envelope: np.ndarray) -> np.ndarray:
    """Which bins stand out, and nearly lead, in both halves of the envelope; all of them where it is too short to tell."""
    half, out = len(envelope) // 2, np.ones(len(BINS), bool)
    if half < LEAST_SAMPLES // 2:
        return out
    for part in (envelope[:half], envelope[half:]):
        band = seam_band(part - part.mean())
        near = np.abs(FREQUENCIES[:, None] - FREQUENCIES) <= 2.0 * FS / len(part)
        best = np.where(near, band, 0.0).max(axis=1)
        floor = float(np.median(band[band > 0])) if (band > 0).any() else np.inf
        out &= (best >= 2.5 * floor) & (best >= 0.7 * band.max())
    return out


def repeat(x: np.ndarray) -> tuple[float, float]:
    """(turns a minute, correlation) of the shift within the seam's band at which the signal repeats itself best."""
    spectrum = np.fft.rfft(x, 1 << (2 * len(x) - 1).bit_length())
    c = np.fft.irfft(np.abs(spectrum) ** 2)[: len(x)]
    low, high = int(FS / HIGH_HZ), min(int(FS / (LOW_HZ + LEAK * FS / FFT)), len(x) - 1)
    if c[0] <= 0 or low >= high:
        return 0.0, 0.0
    k = low + int(np.argmax(c[low:high]))
    return FS / k * 60, float(c[k] / c[0])


def without_leak(band: np.ndarray) -> np.ndarray:
    out = band.copy()
    out[:LEAK] = 0.0
    return out


def straight_residual(x: np.ndarray) -> np.ndarray:
    t = np.linspace(-1, 1, len(x))
    return x - np.polyval(np.polyfit(t, x, 1), t)


def witnesses(tone: np.ndarray) -> dict[str, np.ndarray | None]:
    """Seam bands of what the tone's phase, and its frequency, do besides a straight line; None where nothing moves or it is too short."""
    phase = np.unwrap(np.angle(tone))
    out = {}
    for name, x in (("phase_residual", phase), ("instant_frequency", np.diff(phase) * FS / (2 * np.pi))):
        rest = straight_residual(x) if len(x) >= LEAST_SAMPLES else np.zeros(1)
        rest = rest - rest.mean()
        out[name] = without_leak(seam_band(rest)) if rest.std() >= 1e-9 else None
    return out


def ball_tone(i: np.ndarray, q: np.ndarray, mph: float) -> np.ndarray | None:
    """The ball's tone, cut out of a capture; None where its frequency is outside the band that can be."""
    x = (i - np.mean(i)) + 1j * (q - np.mean(q))
    doppler = 2 * mph / MPS_TO_MPH / WAVELENGTH_M
    low, high = max(doppler - BAND_HZ, 0.0005 * FS), min(doppler + BAND_HZ, 0.4995 * FS)
    return band_pass(x, low, high) if low < high else None


def windows_of(envelope: np.ndarray, lengths_ms: tuple[int, ...], step_ms: int = 5) -> dict[str, slice]:
    """Windows of what follows the ball's onset: the whole without its edges, and for each length the first and the loudest.

    Those that are too short for an answer, or don't fit, are left out but for the whole.
    """
    edge, n = FS // BAND_HZ, len(envelope)
    out = {"whole": slice(edge, n - edge) if n > 2 * edge + LEAST_SAMPLES else slice(0, n)}
    power = np.concatenate(([0.0], np.cumsum(envelope * envelope)))
    for ms in lengths_ms:
        size = FS * ms // 1000
        end = min(n, edge + size)
        if end - edge >= LEAST_SAMPLES:
            out[f"first_{ms}"] = slice(edge, end)
        if n - 2 * edge >= max(size, LEAST_SAMPLES):
            starts = np.arange(edge, n - edge - size + 1, FS * step_ms // 1000)
            at = int(starts[np.argmax(power[starts + size] - power[starts])])
            out[f"loudest_{ms}"] = slice(at, at + size)
    return out


def window_evidence(i: np.ndarray, q: np.ndarray, mph: float, start_ms: float, lengths_ms: tuple[int, ...]) -> list[dict]:
    """What each window of a capture says alone: samples, depth and the seam's band (null where it is too short or flat)."""
    tone = ball_tone(i, q, mph)
    if tone is None:
        return []
    envelope = np.abs(tone)[max(0, int(start_ms * FS / 1000)) :]
    out = []
    for name, at in windows_of(envelope, lengths_ms).items():
        part = envelope[at]
        row = {"window": name, "samples": len(part), "depth": None, "band": None}
        if len(part) >= LEAST_SAMPLES:
            mean, spread = float(part.mean()), float(part.std())
            row["depth"] = spread / mean if mean > 0 else None
            row["band"] = without_leak(seam_band(part - mean)) if spread >= 1e-6 else None
        out.append(row)
    return out


def evidence(i: np.ndarray, q: np.ndarray, mph: float, start_ms: float) -> dict:
    """What a capture says about spin; ``stop`` names what prevents an answer."""
    tone = ball_tone(i, q, mph)
    if tone is None:
        return {"stop": "outside_filter"}
    envelope = np.abs(tone)
    start = max(0, int(start_ms * FS / 1000))
    end = signal_end(envelope, start)
    edge = FS // BAND_HZ
    if end - start > 2 * edge + LEAST_SAMPLES:
        start, end = start + edge, end - edge
    part = envelope[start:end]
    if len(part) < LEAST_SAMPLES:
        return {"stop": "too_short", "samples": len(part)}
    mean, spread = float(part.mean()), float(part.std())
    depth = spread / mean if mean > 0 else None
    out = {"stop": None, "samples": len(part), "depth": depth}
    if spread < 1e-6:
        return out | {"stop": "flat"}
    t = np.linspace(-1, 1, len(part))
    part = part - mean
    part = part - np.polyval(np.polyfit(t, part, TREND), t)
    band = without_leak(seam_band(part))
    turns, alike = repeat(part * np.hanning(len(part)))
    return out | {"band": band, "shoulder": shoulders(band, len(part)), "lasting": lasting(part), "repeat_rpm": turns, "repeat_corr": alike, **witnesses(tone[start:end])}
