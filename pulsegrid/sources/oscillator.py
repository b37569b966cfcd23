"""A damped oscillator under random force, with a fault of its parameters.

The equation is linear and the force constant over a step, so the fourth-order Runge-Kutta step is one affine map of
the state. A sensor is generated by one task, in order, from one seeded generator; sensors are independent rows.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from pulsegrid.config import FaultConfig, SensorConfig

SCHEMA = "sensor_id string, i long, t double, value double"
BATCH = 50_000


def step_map(omega: float, zeta: float, h: float) -> tuple[np.ndarray, np.ndarray]:
    """R and b of state' = R state + b force: the Taylor terms of the exponential up to the fourth."""
    a = h * np.array([[0.0, 1.0], [-omega * omega, -2 * zeta * omega]])
    one = np.eye(2)
    r = one + a @ (one + a @ (one + a @ (one + a / 4) / 3) / 2)
    b = h * (one + a @ (one + a @ (one + a / 4) / 3) / 2) @ np.array([0.0, 1.0])
    return r, b


class Generator:
    """Draws a sensor's samples in turn; ``take`` continues where the last call ended."""

    def __init__(self, config: SensorConfig) -> None:
        self.config = config
        self.dt = 1.0 / config.sample_rate_hz
        self.rng = np.random.default_rng(config.seed)
        self.state = (0.0, 0.0)
        self.next = 0
        fault = config.fault
        self.healthy = (config.omega_n, config.zeta)
        self.faulty = (config.omega_n * fault.omega_n_factor, config.zeta * fault.zeta_factor) if fault else self.healthy
        self._run(round(config.warmup_s * config.sample_rate_hz), warm=True)

    def _run(self, n: int, warm: bool) -> np.ndarray:
        config, out = self.config, np.empty(n)
        force = self.rng.normal(0.0, config.force_std * math.sqrt(config.sample_rate_hz), n)
        maps = {p: [*map(float, np.concatenate([m.ravel() for m in step_map(*p, self.dt)]))] for p in {self.healthy, self.faulty}}
        x, v = self.state
        for k in range(n):
            faulty = not warm and config.fault is not None and config.fault.contains((self.next + k) * self.dt)
            omega, zeta = p = self.faulty if faulty else self.healthy
            r00, r01, r10, r11, b0, b1 = maps[p]
            f = force[k]
            x, v = r00 * x + r01 * v + b0 * f, r10 * x + r11 * v + b1 * f
            if config.channel == "acceleration":
                out[k] = f - 2 * zeta * omega * v - omega * omega * x
            else:
                out[k] = v if config.channel == "velocity" else x + config.dc_offset
        self.state = (x, v)
        return out

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.arange(self.next, self.next + n)
        value = self._run(n, warm=False)
        self.next += n
        return i, i * self.dt, value


def batches(sensor_id: str, config: SensorConfig, first: int | None = None) -> Iterator[pd.DataFrame]:
    total, source = config.samples, Generator(config)
    if first is not None:
        total = first if total is None else min(first, total)
    if total is None:
        raise ValueError("a batch source needs a duration or a number of samples; an endless sensor is a stream")
    while source.next < total:
        i, t, value = source.take(min(BATCH, total - source.next))
        yield pd.DataFrame({"sensor_id": sensor_id, "i": i, "t": t, "value": value})


def oscillators(spark: SparkSession, sensors: dict[str, SensorConfig], first: int | None = None) -> DataFrame:
    """sensor_id, i, t, value of every sensor, each made by one task; with ``first`` so many samples of each at most, of endless sensors too."""
    table = spark.createDataFrame([(name,) for name in sensors], "sensor_id string").repartition(max(1, len(sensors)), "sensor_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name in part["sensor_id"]:
                yield from batches(name, sensors[name], first)

    return table.mapInPandas(run, SCHEMA)


def labels(spark: SparkSession, sensors: dict[str, SensorConfig]) -> DataFrame:
    """sensor_id, fault_start, fault_end: the ground truth, which no sample carries. Sensors without a fault have nulls."""
    rows = [(name, c.fault.start_s, c.fault.end_s) if c.fault else (name, None, None) for name, c in sensors.items()]
    return spark.createDataFrame(rows, "sensor_id string, fault_start double, fault_end double")


def config_of(options: dict[str, str]) -> SensorConfig:
    """From a data source's options, names as in SensorConfig; a fault's start with ``fault.``."""
    lower = {k.lower(): v for k, v in options.items()}

    def some(kind, prefix: str) -> dict:
        found = {}
        for f in dataclasses.fields(kind):
            if f.name != "fault" and (text := lower.get(prefix + f.name.lower())) is not None:
                found[f.name] = text if f.name == "channel" else int(text) if f.name == "seed" else float(text)
        return found

    fault = some(FaultConfig, "fault.")
    return SensorConfig(**some(SensorConfig, ""), fault=FaultConfig(**fault) if fault else None)


class OscillatorSource(DataSource):
    """``spark.readStream.format("oscillator")``: ``rows_per_batch`` samples a trigger. Spark keeps the offset; a restart draws anew up to it."""

    @classmethod
    def name(cls) -> str:
        return "oscillator"

    def schema(self) -> StructType | str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return OscillatorStream({**self.options})


class OscillatorStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.rows = int(options.get("rows_per_batch", 1000))
        self.sensor = options.get("sensor_id", "sensor-0")
        self.config = config_of(options)
        self.source = Generator(self.config)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"i": 0}

    def _from(self, start: int, n: int) -> Iterator[tuple]:
        if start < self.source.next:
            self.source = Generator(self.config)
        if start > self.source.next:
            self.source.take(start - self.source.next)
        i, t, value = self.source.take(n)
        return iter(list(zip([self.sensor] * n, i.tolist(), t.tolist(), value.tolist(), strict=True)))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        total = self.config.samples
        n = self.rows if total is None else max(0, min(self.rows, total - start["i"]))
        return self._from(start["i"], n), {"i": start["i"] + n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self._from(start["i"], end["i"] - start["i"])
