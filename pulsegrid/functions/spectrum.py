"""The strongest frequency of a window: detrend, Hann taper, real transform, peak, parabolic refinement."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Keeps the logarithm of an empty bin finite.
TINY = 1e-12


def peak_offsets(spectrum: np.ndarray, peak: np.ndarray) -> np.ndarray:
    """For each row's peak bin its distance to the parabola's top through the log magnitudes, -0.5 to 0.5; else 0."""
    last = spectrum.shape[1] - 1
    inner = (peak > 0) & (peak < last)
    middle = np.clip(peak, 1, max(1, last - 1))
    rows = np.arange(len(peak))
    with np.errstate(all="ignore"):
        left, top, right = (np.log(spectrum[rows, np.clip(middle + d, 0, last)] + TINY) for d in (-1, 0, 1))
        bend = left - 2 * top + right
        offset = 0.5 * (left - right) / bend
    return np.where(inner & (bend != 0) & np.isfinite(offset) & (np.abs(offset) <= 0.5), offset, 0.0)


def dominant_frequencies(windows: np.ndarray, sample_rate_hz: float, detrend: bool = True, interpolate: bool = True) -> np.ndarray:
    """One frequency per row of ``windows``. A row with a NaN gives 0."""
    n = windows.shape[1]
    if detrend:
        windows = windows - windows.mean(axis=1, keepdims=True)
    spectrum = np.abs(np.fft.rfft(windows * np.hanning(n), axis=1))
    peak = np.argmax(spectrum, axis=1)
    place = peak + (peak_offsets(spectrum, peak) if interpolate else 0.0)
    return np.maximum(0.0, place * (sample_rate_hz / n))


def dominant_frequency(window: Column, sample_rate_hz: float, detrend: bool = True, interpolate: bool = True) -> Column:
    """For a column of equally long arrays; Arrow batches, one transform for a whole batch. A null or empty window gives null."""

    @pandas_udf("double")
    def run(windows: pd.Series) -> pd.Series:
        out = np.full(len(windows), np.nan)
        lengths = windows.map(lambda w: 0 if w is None else len(w)).to_numpy()
        for n in {*lengths.tolist()} - {0}:
            rows = np.flatnonzero(lengths == n)
            out[rows] = dominant_frequencies(np.stack(windows.iloc[rows].to_numpy()).astype(float), sample_rate_hz, detrend, interpolate)
        return pd.Series(out).where(lengths > 0, None)

    return run(window)


def hann(position: Column, n: int) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * position / (n - 1)) if n > 1 else F.lit(1.0)


def spectrum_sql(windows: DataFrame, key: str, window: str, n: int, detrend: bool = True) -> DataFrame:
    """``key``, bin, magnitude: the transform as a sum over samples and bins, by built-in functions alone. For short windows."""
    mean = F.aggregate(window, F.lit(0.0), lambda s, x: s + x) / n
    points = windows.select(key, F.posexplode(F.transform(window, lambda x: x - (mean if detrend else 0.0))).alias("j", "x"))
    bins = F.explode(F.sequence(F.lit(0), F.lit(n // 2)))
    turn = 2 * math.pi * ((F.col("bin") * F.col("j")) % n) / n
    tapered = F.col("x") * hann(F.col("j"), n)
    return points.withColumn("bin", bins).groupBy(key, "bin").agg(F.sqrt(F.pow(F.sum(tapered * F.cos(turn)), 2) + F.pow(F.sum(tapered * F.sin(turn)), 2)).alias("magnitude"))


def peak_sql(spectrum: DataFrame, key: str, n: int, sample_rate_hz: float, interpolate: bool = True) -> DataFrame:
    """``key``, peak_bin, dominant_freq_hz from ``spectrum_sql``; the lowest of equal bins."""
    top = spectrum.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "magnitude"))).alias("all"), F.max_by("bin", F.struct("magnitude", -F.col("bin"))).alias("peak_bin"))
    k = F.col("peak_bin")
    left, middle, right = (F.ln(F.coalesce(F.col("all")[k + d], F.lit(0.0)) + TINY) for d in (-1, 0, 1))
    bend = left - 2 * middle + right
    offset = F.when((k > 0) & (k < n // 2) & (bend != 0), 0.5 * (left - right) / F.when(bend != 0, bend))
    place = k + F.when(F.abs(offset) <= 0.5, offset).otherwise(0.0) if interpolate else k
    return top.select(key, "peak_bin", F.greatest(F.lit(0.0), place * (sample_rate_hz / n)).alias("dominant_freq_hz"))


def welch(window: Column, sample_rate_hz: float, segment: int = 256) -> Column:
    """Power density by averaging half-overlapping tapered segments: an array of struct(frequency_hz, density), one-sided.

    A window shorter than a segment is one segment; an empty or null one gives null.
    """

    @pandas_udf("array<struct<frequency_hz:double,density:double>>")
    def run(windows: pd.Series) -> pd.Series:
        return windows.map(lambda w: None if w is None or not len(w) else density(np.asarray(w, float), sample_rate_hz, segment))

    return run(window)


def density(values: np.ndarray, sample_rate_hz: float, segment: int) -> list[dict]:
    n = min(segment, len(values))
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = np.lib.stride_tricks.sliding_window_view(values, n)[:: max(1, n // 2)]
    parts = (parts - parts.mean(axis=1, keepdims=True)) * taper
    power = (np.abs(np.fft.rfft(parts, axis=1)) ** 2).mean(axis=0) / (sample_rate_hz * max((taper * taper).sum(), TINY))
    power[1 : len(power) - (n % 2 == 0)] *= 2
    return [{"frequency_hz": f, "density": p} for f, p in zip((np.arange(len(power)) * sample_rate_hz / n).tolist(), power.tolist(), strict=True)]


def spectrogram(samples: DataFrame, n: int, hop: int, sample_rate_hz: float) -> DataFrame:
    """sensor_id, frame_no, t, density: the power density of each hopping window."""
    from pulsegrid.config import ProcessorConfig
    from pulsegrid.operators.frames import window_stats

    windows = window_stats(samples, ProcessorConfig(sample_rate_hz=sample_rate_hz, window_s=n / sample_rate_hz, hop_s=hop / sample_rate_hz), with_values=True)
    return windows.select("sensor_id", "frame_no", "t", welch(F.col("window"), sample_rate_hz, n).alias("density"))
