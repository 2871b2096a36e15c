"""Audio metrics in vectorised UDFs over WAV bytes."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from taleforge.functions.speech import DELIVERY

METRICS = "snr_db double, pitch_variance double, energy_variance double, syllable_rate double, duration_s double"


def samples(data: bytes | None, first_channel: bool = False) -> tuple[np.ndarray, int]:
    """Samples of a PCM file, -1 to 1, channels averaged (or the first alone); nothing if it is null or broken."""
    try:
        with wave.open(io.BytesIO(data or b"")) as f:
            width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0), 1
    kind = {1: np.uint8, 2: "<i2", 4: "<i4"}.get(width)
    if kind is None or not rate:
        return np.zeros(0), 1
    x = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], kind).astype(float)
    x = ((x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))).reshape(-1, channels)
    return (x[:, 0] if first_channel else x.mean(1)), rate


def header_duration(data: bytes | None, bytes_per_second: int = 48_000) -> float:
    """Length by the header, else by the size."""
    try:
        with wave.open(io.BytesIO(data or b"")) as f:
            return f.getnframes() / f.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return len(data or b"") / bytes_per_second


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Overlapping frames that begin before the last whole one."""
    if len(x) <= size or not size or not hop:
        return np.zeros((0, max(size, 1)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[: len(x) - size : hop]


def signal_to_noise(x: np.ndarray) -> float:
    """Level over that of the quietest tenth of the samples."""
    if not len(x):
        return 0.0
    quiet = np.sort(np.abs(x))[: len(x) // 10]
    level = lambda v: max(float(np.sqrt(np.mean(v**2))) if len(v) else 0.0, 1e-10)
    return 20 * float(np.log10(level(x) / level(quiet)))


def pitch_variance(x: np.ndarray, rate: int) -> float:
    """Variance of the pitch of voiced frames, by the highest autocorrelation between 60 and 500 Hz."""
    size, low, high = int(0.03 * rate), int(rate / 500), int(rate / 60)
    f = frames(x, size, int(0.01 * rate))
    f = f[np.abs(f).max(1) >= 0.01] if len(f) else f
    if not len(f) or high > size or high <= low:
        return 0.0
    pitches = []
    for at in range(0, len(f), 512):
        spectrum = np.fft.rfft(f[at : at + 512], 2 * size, axis=1)
        own = np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, :size]
        lag = own[:, low:high].argmax(1) + low
        pitches.append(rate / lag[own[np.arange(len(own)), lag] > 0.3 * own[:, 0]])
    pitches = np.concatenate(pitches)
    return float(np.var(pitches)) if len(pitches) > 2 else 0.0


def loudness(x: np.ndarray, rate: int, seconds: float) -> np.ndarray:
    f = frames(x, int(seconds * rate), int(0.01 * rate))
    return np.sqrt((f**2).mean(1)) if len(f) else np.zeros(0)


def energy_variance(x: np.ndarray, rate: int) -> float:
    """D3."""
    e = loudness(x, rate, 0.03)
    return float(np.var(e)) if len(e) else 0.0


def syllable_rate(x: np.ndarray, rate: int) -> float:
    """How often a second the smoothed loudness rises over half its mean."""
    e = loudness(x, rate, 0.02)
    if len(e) < 3:
        return 0.0
    smooth = np.convolve(e, np.ones(5) / 5, mode="same")
    half = smooth.mean() * 0.5
    side = np.sign(smooth - half)  # a value on the line changes nothing
    side = side[side != 0]
    rises = int(np.count_nonzero((side[1:] > 0) & (side[:-1] < 0))) + int(len(side) > 0 and side[0] > 0)
    return rises / (len(x) / rate)


def clip_metrics(data: bytes | None) -> dict[str, float]:
    """All of a clip's metrics; the first is 0 under two seconds."""
    x, rate = samples(data)
    seconds = len(x) / rate
    return {"snr_db": signal_to_noise(x) if seconds >= 2 else 0.0, "pitch_variance": pitch_variance(x, rate), "energy_variance": energy_variance(x, rate), "syllable_rate": syllable_rate(x, rate), "duration_s": seconds}


def reference_snr(data: bytes | None) -> float | None:
    """Level of frames over that of frames under a hundredth of the loudest; 60 without such, none for silence."""
    x, rate = samples(data, first_channel=True)
    size = int(rate * 0.03)
    if not size or len(x) < size:
        return None
    level = np.sqrt((x[: len(x) // size * size].reshape(-1, size) ** 2).mean(1))
    if not level.max():
        return None
    noise = level < level.max() * 0.01
    if not noise.any() or not level[noise].mean():
        return 60.0
    return round(20 * float(np.log10(level[~noise].mean() / level[noise].mean())), 1)


def delivered(x: np.ndarray, act: str) -> np.ndarray:
    """Samples with an act's volume and speed."""
    volume, speed = DELIVERY.get(act, DELIVERY["spoken"])
    out = np.clip(x * 10 ** (volume / 20), -1, 1) if volume else x
    n = int(len(x) / speed)
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), out).astype(x.dtype) if speed != 1.0 and n > 0 else out


def clip_metrics_udf():
    """D5 over a column of WAV bytes."""
    names = [f.strip().split(" ")[0] for f in METRICS.split(",")]

    @F.pandas_udf(METRICS)
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clip_metrics(d) for d in data], columns=names)

    return run


def reference_snr_udf():
    """D6 over a column of WAV bytes."""

    @F.pandas_udf("double")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([reference_snr(d) for d in data], dtype="float64")

    return run


def duration_udf():
    """S13 over a column of WAV bytes."""

    @F.pandas_udf("double")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([header_duration(d) for d in data], dtype="float64")

    return run
