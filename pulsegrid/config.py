"""Settings, checked when they are made. Lengths in samples are rounded here, half to even, once and for all queries."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

CHANNELS = ("displacement", "velocity", "acceleration")


def require(holds: bool, message: str) -> None:
    if not holds:
        raise ValueError(message)


@dataclass(frozen=True)
class FaultConfig:
    """A change of the oscillator from ``start_s`` on, for ``duration_s`` seconds (the end itself excluded)."""

    start_s: float
    duration_s: float
    omega_n_factor: float = 1.0
    zeta_factor: float = 1.0

    def __post_init__(self) -> None:
        require(self.start_s >= 0, "start_s must not be negative")
        require(self.duration_s > 0, "duration_s must be positive")
        require(self.omega_n_factor > 0 and self.zeta_factor > 0, "factors must be positive")

    @property
    def end_s(self) -> float:
        return self.start_s + self.duration_s

    def contains(self, t: float) -> bool:
        return self.start_s <= t < self.end_s


@dataclass(frozen=True)
class SensorConfig:
    sample_rate_hz: float = 1000.0
    natural_freq_hz: float = 50.0
    zeta: float = 0.05
    force_std: float = 1.0
    channel: str = "acceleration"
    seed: int | None = 42
    duration_s: float | None = None
    warmup_s: float = 0.2
    dc_offset: float = 0.0
    fault: FaultConfig | None = None

    def __post_init__(self) -> None:
        require(self.sample_rate_hz > 0 and self.natural_freq_hz > 0, "rates must be positive")
        require(self.natural_freq_hz < self.sample_rate_hz / 2, "natural_freq_hz must be below half the sample rate")
        require(self.zeta > 0, "zeta must be positive")
        require(self.force_std >= 0 and self.warmup_s >= 0, "force_std and warmup_s must not be negative")
        require(self.channel in CHANNELS, f"channel must be one of {', '.join(CHANNELS)}")
        require(self.duration_s is None or self.duration_s > 0, "duration_s must be positive")

    @property
    def omega_n(self) -> float:
        return 2 * math.pi * self.natural_freq_hz

    @property
    def samples(self) -> int | None:
        return None if self.duration_s is None else round(self.duration_s * self.sample_rate_hz)


@dataclass(frozen=True)
class DetectorConfig:
    """What all detectors share: the calibration, the threshold in standard deviations, the debounce and the floors."""

    calibration_frames: int = 30
    k: float = 4.0
    min_consecutive: int = 3
    clear_consecutive: int = 5
    min_rms_std: float = 1e-9
    min_freq_std_hz: float = 0.5

    def __post_init__(self) -> None:
        require(self.calibration_frames >= 2, "calibration_frames must be at least 2")
        require(self.k > 0, "k must be positive")
        require(self.min_consecutive >= 1 and self.clear_consecutive >= 1, "debounce lengths must be at least 1")
        require(self.min_rms_std > 0 and self.min_freq_std_hz > 0, "floors must be positive")


@dataclass(frozen=True)
class EwmaConfig(DetectorConfig):
    alpha: float = 0.05

    def __post_init__(self) -> None:
        super().__post_init__()
        require(0 < self.alpha <= 1, "alpha must lie in (0, 1]")


@dataclass(frozen=True)
class KalmanConfig(DetectorConfig):
    process_var_ratio: float = 0.01

    def __post_init__(self) -> None:
        super().__post_init__()
        require(self.process_var_ratio > 0, "process_var_ratio must be positive")


@dataclass(frozen=True)
class ProcessorConfig:
    sample_rate_hz: float = 1000.0
    window_s: float = 1.5
    hop_s: float = 0.1
    detrend: bool = True
    interpolate_peak: bool = True
    detector: DetectorConfig = field(default_factory=DetectorConfig)

    def __post_init__(self) -> None:
        require(self.sample_rate_hz > 0 and self.window_s > 0 and self.hop_s > 0, "rates and lengths must be positive")
        require(self.hop_s <= self.window_s, "hop_s must not be longer than window_s")
        require(self.window_samples >= 8, "a window needs 8 samples at least")

    @property
    def window_samples(self) -> int:
        return round(self.window_s * self.sample_rate_hz)

    @property
    def hop_samples(self) -> int:
        return max(1, round(self.hop_s * self.sample_rate_hz))

    @property
    def feature_rate_hz(self) -> float:
        return self.sample_rate_hz / self.hop_samples


@dataclass(frozen=True)
class BackoffConfig:
    base_s: float = 0.5
    factor: float = 2.0
    max_s: float = 30.0
    jitter: float = 1.0
    max_attempts: int | None = None

    def __post_init__(self) -> None:
        require(self.base_s > 0 and self.max_s >= self.base_s, "base_s must be positive and at most max_s")
        require(self.factor >= 1, "factor must be at least 1")
        require(0 <= self.jitter <= 1, "jitter must lie in [0, 1]")
        require(self.max_attempts is None or self.max_attempts >= 1, "max_attempts must be at least 1")


@dataclass(frozen=True)
class SinkConfig:
    sensor_id: str = "sensor-0"
    queue_maxsize: int = 10_000
    batch_max_frames: int = 100
    batch_max_seconds: float = 10.0
    poll_timeout_s: float = 0.5
    backoff: BackoffConfig = field(default_factory=BackoffConfig)

    def __post_init__(self) -> None:
        require(bool(self.sensor_id), "sensor_id must not be empty")
        require(self.queue_maxsize >= 1 and self.batch_max_frames >= 1, "sizes must be at least 1")
        require(self.batch_max_seconds > 0 and self.poll_timeout_s > 0, "times must be positive")
