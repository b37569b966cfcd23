"""Detectors over feature frames: rms and dominant frequency against a baseline, behind one debounce.

The frozen-baseline detector needs no memory but its baseline, so it is windows all the way. The adaptive ones learn
from a frame only if it looked healthy, which feeds the verdict back; they run as a fold over a sensor's frames in
order. The fold streams through sorted partitions with the state of one sensor at a time, so a sensor may have any
number of frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.config import DetectorConfig, EwmaConfig, KalmanConfig

CALIBRATING, NORMAL, ANOMALOUS = "calibrating", "normal", "anomalous"


def baseline(frames: DataFrame, config: DetectorConfig) -> DataFrame:
    """sensor_id, frames, rms_mean, rms_std, freq_mean, freq_std over the calibration frames, the spreads floored."""
    first = frames.where(F.col("frame_no") < config.calibration_frames)
    return first.groupBy("sensor_id").agg(
        F.count("*").alias("frames"),
        F.avg("rms").alias("rms_mean"), F.greatest(F.stddev_pop("rms"), F.lit(config.min_rms_std)).alias("rms_std"),
        F.avg("dominant_freq_hz").alias("freq_mean"), F.greatest(F.stddev_pop("dominant_freq_hz"), F.lit(config.min_freq_std_hz)).alias("freq_std"),
    )


def exceeds(z: Column, k: float) -> Column:
    """Strictly; a NaN exceeds nothing (Spark would order it above every number)."""
    return (F.abs(z) > k) & ~F.isnan(z)


def debounced(frames: DataFrame, raw: str, config: DetectorConfig, out: str = "is_anomaly") -> DataFrame:
    """``out``: raised by ``min_consecutive`` raw verdicts in a row, lowered by ``clear_consecutive`` of the other kind.

    Runs are islands of equal verdicts; a run's length so far decides raise or lower, and the last decision holds. Null
    verdicts are before a sensor's first one and count as none.
    """
    order = Window.partitionBy("sensor_id").orderBy("frame_no")
    verdict = F.coalesce(F.col(raw), F.lit(False))
    changes = frames.withColumn("__start", F.when(F.coalesce(F.lag(verdict).over(order), ~verdict) != verdict, 1).otherwise(0))
    islands = changes.withColumn("__island", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.row_number().over(Window.partitionBy("sensor_id", "__island").orderBy("frame_no"))
    decided = islands.withColumn("__length", length).withColumn(
        "__event", F.when(verdict & (F.col("__length") >= config.min_consecutive), True).when(~verdict & (F.col("__length") >= config.clear_consecutive), False)
    )
    last = F.last("__event", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return decided.withColumn(out, F.coalesce(last, F.lit(False))).drop("__start", "__island", "__length", "__event")


def with_state(frames: DataFrame, config: DetectorConfig) -> DataFrame:
    calibrating = F.col("frame_no") < config.calibration_frames - 1
    return frames.withColumn("state", F.when(calibrating, CALIBRATING).when(F.col("is_anomaly"), ANOMALOUS).otherwise(NORMAL))


def zscore_raw(frames: DataFrame, config: DetectorConfig | None = None) -> DataFrame:
    """``frames`` with score and raw (the verdict before the debounce). Calibration frames, the last included, score 0 and are no anomaly."""
    config = config or DetectorConfig()
    # The calibration's moments run along in frame order: past its end they stand still. So one ordered pass over a sensor
    # does it, and the frames are neither made twice nor held back.
    so_far = Window.partitionBy("sensor_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("frame_no") < config.calibration_frames
    moments = {"__n": F.count_if(first).over(so_far)}
    for name, floor in (("rms", config.min_rms_std), ("dominant_freq_hz", config.min_freq_std_hz)):
        value = F.when(first, F.col(name))
        moments |= {f"__{name}_mean": F.avg(value).over(so_far), f"__{name}_std": F.greatest(F.stddev_pop(value).over(so_far), F.lit(floor))}
    known = frames.withColumns(moments)
    z_rms, z_freq = ((F.col(name) - F.col(f"__{name}_mean")) / F.col(f"__{name}_std") for name in ("rms", "dominant_freq_hz"))
    scored = ~first & (F.col("__n") >= config.calibration_frames)
    return known.select(
        *frames.columns, F.when(scored, F.greatest(F.abs(z_rms), F.abs(z_freq))).otherwise(0.0).alias("score"),
        (scored & (exceeds(z_rms, config.k) | exceeds(z_freq, config.k))).alias("raw"),
    )


def zscore(frames: DataFrame, config: DetectorConfig | None = None) -> DataFrame:
    """``frames`` with score, is_anomaly and state, against the frozen baseline of the first frames."""
    config = config or DetectorConfig()
    raw = zscore_raw(frames, config)
    return with_state(debounced(raw, "raw", config).drop("raw"), config)


@dataclass
class Moments:
    """Count, mean and squared deviations, one value at a time."""

    n: int = 0
    mean: float = 0.0
    square: float = 0.0

    def add(self, x: float) -> None:
        self.n += 1
        from_old = x - self.mean
        self.mean += from_old / self.n
        self.square += from_old * (x - self.mean)

    def std(self) -> float:
        return (self.square / self.n) ** 0.5 if self.n else 0.0


@dataclass
class Debounce:
    raise_after: int
    clear_after: int
    fired: bool = False
    run: int = 0  # verdicts in a row that speak against the present state

    def update(self, anomalous: bool) -> bool:
        self.run = self.run + 1 if anomalous != self.fired else 0
        if self.run >= (self.clear_after if self.fired else self.raise_after):
            self.fired, self.run = not self.fired, 0
        return self.fired


@dataclass
class Frozen:
    """One feature's baseline that never moves."""

    mean: float
    spread: float

    @classmethod
    def start(cls, mean: float, std: float, floor: float, config: DetectorConfig) -> Frozen:
        return cls(mean, max(std, floor))

    def z(self, x: float) -> float:
        return (x - self.mean) / self.spread

    def learn(self, x: float) -> None:
        pass


@dataclass
class Exponential:
    """Exponentially weighted mean and variance; the spread is floored when scoring, not in the update."""

    mean: float
    var: float
    floor: float
    alpha: float

    @classmethod
    def start(cls, mean: float, std: float, floor: float, config: EwmaConfig) -> Exponential:
        return cls(mean, max(std, floor) ** 2, floor, config.alpha)

    def z(self, x: float) -> float:
        return (x - self.mean) / max(self.var**0.5, self.floor)

    def learn(self, x: float) -> None:
        off = x - self.mean
        self.mean += self.alpha * off
        self.var = (1 - self.alpha) * (self.var + self.alpha * off * off)


@dataclass
class LocalLevel:
    """A scalar Kalman filter for a level that wanders: measurement variance r, process variance q, state variance p."""

    mean: float
    p: float
    q: float
    r: float

    @classmethod
    def start(cls, mean: float, std: float, floor: float, config: KalmanConfig) -> LocalLevel:
        var = max(std, floor) ** 2
        return cls(mean, var, config.process_var_ratio * var, var)

    def z(self, x: float) -> float:
        return (x - self.mean) / (self.p + self.q + self.r) ** 0.5

    def learn(self, x: float) -> None:
        predicted = self.p + self.q
        gain = predicted / (predicted + self.r)
        self.mean += gain * (x - self.mean)
        self.p = (1 - gain) * predicted


@dataclass
class Detector:
    """One sensor's detector: ``update`` takes a frame's features and gives (is_anomaly, score)."""

    config: DetectorConfig
    tracker: Callable
    moments: tuple[Moments, Moments] = field(default_factory=lambda: (Moments(), Moments()))
    trackers: list | None = None
    debounce: Debounce | None = None

    def __post_init__(self) -> None:
        if self.debounce is None:
            self.debounce = Debounce(self.config.min_consecutive, self.config.clear_consecutive)

    @property
    def is_calibrated(self) -> bool:
        return self.trackers is not None

    @property
    def state(self) -> str:
        return CALIBRATING if not self.is_calibrated else ANOMALOUS if self.debounce.fired else NORMAL

    def update(self, rms: float, dominant_freq_hz: float) -> tuple[bool, float]:
        features = (rms, dominant_freq_hz)
        if self.trackers is None:
            for m, x in zip(self.moments, features, strict=True):
                m.add(x)
            if self.moments[0].n >= self.config.calibration_frames:
                floors = (self.config.min_rms_std, self.config.min_freq_std_hz)
                self.trackers = [self.tracker.start(m.mean, m.std(), floor, self.config) for m, floor in zip(self.moments, floors, strict=True)]
            return False, 0.0
        distance = [abs(t.z(x)) for t, x in zip(self.trackers, features, strict=True)]
        anomalous = any(d > self.config.k for d in distance)
        fired = self.debounce.update(anomalous)
        if not anomalous:
            for t, x in zip(self.trackers, features, strict=True):
                t.learn(x)
        return fired, max(distance)

    def reset(self) -> None:
        self.__init__(self.config, self.tracker)


def make(name: str, config: DetectorConfig | None = None) -> Detector:
    """``zscore``, ``ewma`` or ``kalman``."""
    kinds = {"zscore": (Frozen, DetectorConfig), "ewma": (Exponential, EwmaConfig), "kalman": (LocalLevel, KalmanConfig)}
    tracker, default = kinds[name]
    return Detector(config or default(), tracker)


def folded(frames: DataFrame, factory: Callable[[], Detector]) -> DataFrame:
    """``frames`` with is_anomaly, score and state from a detector that sees each sensor's frames in order."""
    schema = StructType([*frames.schema]).add("is_anomaly", "boolean").add("score", "double").add("state", "string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sensor, detector = object(), None
        for part in parts:
            verdicts = []
            for name, rms, freq in zip(part["sensor_id"], part["rms"], part["dominant_freq_hz"], strict=True):
                if name != sensor:
                    sensor, detector = name, factory()
                verdicts.append((*detector.update(rms, freq), detector.state))
            flags, scores, states = zip(*verdicts, strict=True) if verdicts else ((), (), ())
            yield part.assign(is_anomaly=list(flags), score=list(scores), state=list(states))

    return frames.repartition("sensor_id").sortWithinPartitions("sensor_id", "frame_no").mapInPandas(run, schema)


def ewma(frames: DataFrame, config: EwmaConfig | None = None) -> DataFrame:
    return folded(frames, lambda: make("ewma", config))


def kalman(frames: DataFrame, config: KalmanConfig | None = None) -> DataFrame:
    return folded(frames, lambda: make("kalman", config))


def detector_set(calibration_frames: int = 30, k: float = 4.0, **shared) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The three detectors with the same calibration, threshold and debounce, by name."""
    common = {"calibration_frames": calibration_frames, "k": k, **shared}
    return {
        "zscore": lambda frames: zscore(frames, DetectorConfig(**common)),
        "ewma": lambda frames: ewma(frames, EwmaConfig(**common)),
        "kalman": lambda frames: kalman(frames, KalmanConfig(**common)),
    }
