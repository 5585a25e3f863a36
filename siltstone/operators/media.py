"""Pictures and sound as numbers: numpy kernels, and UDFs over arrays or binary files.

Pictures are grey arrays (rows x columns, 0 to 255); sounds are mono arrays of -1 to 1 with a rate. Decoders for PNG
and such are not part of Spark or Python's library, so pictures come as binary PGM or PPM, or as arrays; sounds as WAV.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def read_pnm(data: bytes) -> np.ndarray:
    """Grey picture of binary PGM (P5) or PPM (P6)."""
    parts, at = [], 0
    while len(parts) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        parts.append(data[at:end])
        at = end
    kind, w, h = parts[0], int(parts[1]), int(parts[2])
    pixels = np.frombuffer(data, np.uint8, w * h * (3 if kind == b"P6" else 1), at + 1)
    return pixels.reshape(h, w, 3) @ np.array([0.299, 0.587, 0.114]) if kind == b"P6" else pixels.reshape(h, w).astype(float)


def resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Block means."""
    rows = (np.arange(h + 1) * image.shape[0] / h).round().astype(int)
    cols = (np.arange(w + 1) * image.shape[1] / w).round().astype(int)
    total = np.pad(image.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    sums = total[np.ix_(rows[1:], cols[1:])] - total[np.ix_(rows[:-1], cols[1:])] - total[np.ix_(rows[1:], cols[:-1])] + total[np.ix_(rows[:-1], cols[:-1])]
    return sums / np.maximum(1, np.outer(np.diff(rows), np.diff(cols)))


def _bits(flags: np.ndarray) -> int:
    value = int("".join("1" if f else "0" for f in flags.ravel()), 2)
    return value - (1 << 64) if value >> 63 else value


def dhash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 block means is brighter than the one on its left."""
    small = resized(image, 8, 9)
    return _bits(small[:, 1:] > small[:, :-1])


def ahash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 block means is above their mean."""
    small = resized(image, 8, 8)
    return _bits(small > small.mean())


def phash(image: np.ndarray) -> int:
    """64 bits: low frequencies of the cosine transform of 32 x 32 block means, against their median."""
    n = np.arange(32)
    dct = np.cos(np.pi / 32 * (n[None, :] + 0.5) * n[:, None])
    low = (dct @ resized(image, 32, 32) @ dct.T)[:8, :8]
    return _bits(low > np.median(low.ravel()[1:]))


def image_quality(image: np.ndarray) -> dict:
    """sharpness (variance of the Laplacian), exposure (mean, clipped shares), contrast (spread of percentiles), noise (median residual)."""
    f = image.astype(float)
    lap = f[1:-1, :-2] + f[1:-1, 2:] + f[:-2, 1:-1] + f[2:, 1:-1] - 4 * f[1:-1, 1:-1]
    windows = np.lib.stride_tricks.sliding_window_view(f, (3, 3)).reshape(f.shape[0] - 2, f.shape[1] - 2, 9)
    lo, hi = np.percentile(f, [5, 95])
    return {
        "sharpness": float(lap.var()), "mean": float(f.mean()), "dark": float((f <= 5).mean()), "bright": float((f >= 250).mean()),
        "contrast": float(hi - lo), "noise": float(1.4826 * np.median(np.abs(f[1:-1, 1:-1] - np.median(windows, axis=2)))),
    }


def otsu(image: np.ndarray) -> int:
    """The level that parts dark from bright with the largest variance between."""
    counts = np.bincount(np.clip(image, 0, 255).astype(int).ravel(), minlength=256)
    w = counts.cumsum()
    m = (counts * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def blobs(mask: np.ndarray) -> np.ndarray:
    """Labels of 4-connected regions (0: outside), by repeated least-label spreading over rows and columns."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        old = labels.copy()
        for axis, step in ((0, 1), (0, -1), (1, 1), (1, -1)):
            moved = np.roll(labels, step, axis)
            edge = [slice(None)] * 2
            edge[axis] = 0 if step == 1 else -1
            moved[tuple(edge)] = 0
            labels = np.where(mask & (moved > 0), np.minimum(labels, np.where(moved > 0, moved, labels)), labels)
        if (labels == old).all():
            return np.unique(labels, return_inverse=True)[1].reshape(mask.shape) if mask.all() else np.unique(np.append(labels.ravel(), 0), return_inverse=True)[1][:-1].reshape(mask.shape)


def count_blobs(image: np.ndarray, min_area: int = 4) -> int:
    """Bright regions of at least ``min_area`` pixels on a dark ground."""
    sizes = np.bincount(blobs(image > otsu(image)).ravel())[1:]
    return int((sizes >= min_area).sum())


def best_crop(image: np.ndarray, h: int, w: int) -> tuple[int, int]:
    """Top left of the h x w window with the most edge energy."""
    f = image.astype(float)
    energy = np.abs(np.diff(f, axis=0, prepend=f[:1])) + np.abs(np.diff(f, axis=1, prepend=f[:, :1]))
    total = np.pad(energy.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    sums = total[h:, w:] - total[:-h, w:] - total[h:, :-w] + total[:-h, :-w]
    y, x = np.unravel_index(sums.argmax(), sums.shape)
    return int(y), int(x)


def redacted(image: np.ndarray, boxes: list[tuple[int, int, int, int]], block: int = 8) -> np.ndarray:
    """Boxes (top, left, bottom, right) as coarse blocks."""
    out = image.astype(float).copy()
    for a, b, c, d in boxes:
        part = out[a:c, b:d]
        small = resized(part, max(1, (c - a) // block), max(1, (d - b) // block))
        rows = np.minimum(np.arange(c - a) * small.shape[0] // (c - a), small.shape[0] - 1)
        cols = np.minimum(np.arange(d - b) * small.shape[1] // (d - b), small.shape[1] - 1)
        out[a:c, b:d] = small[np.ix_(rows, cols)]
    return out


def skew_angle(image: np.ndarray, reach: float = 5.0) -> float:
    """Degrees of rotation of dark text lines: the shear whose row profile varies most."""
    dark = image < otsu(image)
    y, x = np.nonzero(dark)
    best = (-1.0, 0.0)
    for a in np.arange(-reach, reach + 0.25, 0.25):
        rows = np.round(y - x * np.tan(np.radians(a))).astype(int)
        best = max(best, (float(np.bincount(rows - rows.min()).var()), float(a))) if len(rows) else best
    return best[1]


def binarized(image: np.ndarray) -> np.ndarray:
    """Text in black on white by Otsu's level."""
    return np.where(image > otsu(image), 255, 0).astype(np.uint8)


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and rate of a PCM WAV of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        n, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    return x.reshape(-1, n).mean(axis=1), rate


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _frames(x: np.ndarray, size: int) -> np.ndarray:
    return x[: len(x) // size * size].reshape(-1, size)


def speech_spans(x: np.ndarray, rate: int, frame_ms: float = 30, least_ms: float = 200, bridge_ms: float = 300) -> list[tuple[float, float]]:
    """Spans (seconds) louder than the adaptive floor; short gaps are bridged, short spans dropped."""
    size = max(1, int(rate * frame_ms / 1000))
    f = _frames(np.asarray(x, float), size)
    if not len(f):
        return []
    level = 10 * np.log10((f**2).mean(axis=1) + 1e-12)
    floor = np.percentile(level, 20)
    loud = level > max(floor + 9, -55)
    spans: list[list[int]] = []
    for i in np.flatnonzero(loud):
        if spans and i - spans[-1][1] <= bridge_ms / frame_ms:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return [(a * size / rate, (b + 1) * size / rate) for a, b in spans if (b - a + 1) * frame_ms >= least_ms]


def sound_quality(x: np.ndarray, rate: int) -> dict:
    """level (dBFS), clipped share, noise floor, signal-to-noise, speech share, bandwidth (99 % of the energy)."""
    x = np.asarray(x, float)
    f = _frames(x, max(1, rate // 50))
    level = 10 * np.log10((f**2).mean(axis=1) + 1e-12) if len(f) else np.array([-120.0])
    power = np.abs(np.fft.rfft(x)) ** 2 if len(x) else np.ones(1)
    share = power.cumsum() / max(power.sum(), 1e-12)
    spans = speech_spans(x, rate)
    return {
        "level": float(10 * np.log10((x**2).mean() + 1e-12)) if len(x) else -120.0, "clipped": float((np.abs(x) >= 0.999).mean()) if len(x) else 0.0,
        "noise_floor": float(np.percentile(level, 10)), "snr": float(np.percentile(level, 90) - np.percentile(level, 10)),
        "speech": sum(b - a for a, b in spans) / max(len(x) / rate, 1e-9), "bandwidth": float(np.searchsorted(share, 0.99) * rate / max(1, len(x))),
    }


def band_profile(x: np.ndarray, rate: int, bands: int = 32) -> np.ndarray:
    """Mean level (dB) of logarithmic bands: a recording's fingerprint, to hold later ones against."""
    size = 1024
    f = _frames(np.asarray(x, float), size)
    power = (np.abs(np.fft.rfft(f * np.hanning(size), axis=1)) ** 2).mean(axis=0) if len(f) else np.zeros(size // 2 + 1)
    edges = np.unique(np.geomspace(1, size // 2, bands + 1).astype(int))
    return np.array([10 * np.log10(power[a : max(b, a + 1)].mean() + 1e-12) for a, b in zip(edges, edges[1:])])


def sound_anomalies(x: np.ndarray, rate: int, profile: np.ndarray, most: float = 6.0) -> list[int]:
    """Bands whose level differs from a stored profile by more than ``most`` dB."""
    return np.flatnonzero(np.abs(band_profile(x, rate) - profile) > most).tolist()


def denoised(x: np.ndarray, strength: float = 0.8) -> np.ndarray:
    """Spectral gating: bins near the quiet frames' level are turned down."""
    size, hop = 512, 256
    x = np.asarray(x, float)
    pad = np.pad(x, (size, size))
    n = (len(pad) - size) // hop + 1
    win = np.hanning(size + 1)[:-1]
    spec = np.stack([np.fft.rfft(pad[i * hop : i * hop + size] * win) for i in range(n)])
    mag = np.abs(spec)
    quiet = mag[np.argsort(mag.sum(axis=1))[: max(1, n // 10)]].mean(axis=0)
    gain = np.where(mag > 2.5 * quiet, 1.0, 1 - strength)
    out, norm = np.zeros(len(pad)), np.zeros(len(pad))
    for i, s in enumerate(spec * gain):
        out[i * hop : i * hop + size] += np.fft.irfft(s, size) * win
        norm[i * hop : i * hop + size] += win**2
    return (out / np.maximum(norm, 1e-8))[size : size + len(x)]


def diarized(x: np.ndarray, rate: int, speakers: int = 2) -> list[tuple[float, float, int]]:
    """(start, end, speaker) of speech spans, by k-means over band profiles of one-second windows."""
    pieces = [(a + i, min(b, a + i + 1)) for a, b in speech_spans(x, rate) for i in range(int(np.ceil(b - a)))]
    feats = np.array([band_profile(x[int(a * rate) : int(b * rate)], rate) for a, b in pieces if b - a > 0.3])
    pieces = [p for p in pieces if p[1] - p[0] > 0.3]
    if not pieces:
        return []
    feats = feats - feats.mean(axis=1, keepdims=True)
    centers = [feats[0]]
    while len(centers) < min(speakers, len(feats)):
        far = np.min([((feats - c) ** 2).sum(axis=1) for c in centers], axis=0)
        centers.append(feats[far.argmax()])
    for _ in range(20):
        who = np.argmin([((feats - c) ** 2).sum(axis=1) for c in centers], axis=0)
        centers = [feats[who == k].mean(axis=0) if (who == k).any() else c for k, c in enumerate(centers)]
    return [(a, b, int(w)) for (a, b), w in zip(pieces, who)]


def frames_events(frames: list[np.ndarray], jump: float = 0.08) -> dict:
    """Of a sequence of frames: frozen runs (5 equal frames), sudden motion (share of changed pixels), darkness."""
    out = {"frozen": 0, "motion": [], "dark": []}
    run, last = 1, None
    before = 0.0
    for i, f in enumerate(frames):
        if last is not None:
            moved = float((np.abs(f.astype(float) - last) > 25).mean())
            run = run + 1 if (f == last).all() else 1
            out["frozen"] += run == 5
            if moved >= jump and moved > 2 * before:
                out["motion"].append(i)
            before = moved
        if f.mean() < 12:
            out["dark"].append(i)
        last = f.astype(float)
    return out


def crossings(tracks: list[list[tuple[float, float]]], line: float) -> int:
    """Objects followed by nearest centroid from frame to frame, counted once when they cross a height."""
    alive: list[list] = []
    counted = 0
    for points in tracks:
        left = list(points)
        for t in alive:
            if not left:
                break
            near = min(left, key=lambda p: (p[0] - t[0]) ** 2 + (p[1] - t[1]) ** 2)
            if (near[0] - t[0]) ** 2 + (near[1] - t[1]) ** 2 <= 30**2:
                if not t[2] and (t[1] < line) != (near[1] < line):
                    t[2], counted = True, counted + 1
                t[0], t[1] = near
                left.remove(near)
        alive += [[x, y, False] for x, y in left]
    return counted


def _shaped(pixels, width: int) -> np.ndarray:
    a = np.asarray(pixels, float)
    return a.reshape(-1, width)


def array_measures(width: int):
    """A UDF over pictures as flat arrays of a known width: hashes and quality."""

    @F.pandas_udf("dhash long, phash long, sharpness double, mean double, contrast double, noise double")
    def run(pixels: pd.Series) -> pd.DataFrame:
        rows = []
        for p in pixels:
            a = _shaped(p, width)
            q = image_quality(a)
            rows.append((dhash(a), phash(a), q["sharpness"], q["mean"], q["contrast"], q["noise"]))
        return pd.DataFrame(rows, columns=["dhash", "phash", "sharpness", "mean", "contrast", "noise"])

    return run


def wav_measures():
    """A UDF over WAV files (binaryFile's content): quality of sound."""

    @F.pandas_udf("level double, clipped double, noise_floor double, snr double, speech double, bandwidth double")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sound_quality(*read_wav(c)) for c in content])

    return run
