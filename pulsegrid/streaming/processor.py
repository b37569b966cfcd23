"""Frames from an unbounded sample stream: per sensor the window's tail, a counter and the detector are kept as state."""

from __future__ import annotations

import base64
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.config import ProcessorConfig
from pulsegrid.functions.spectrum import dominant_frequencies
from pulsegrid.operators.detect import Detector, make

FRAMES = "sensor_id string, frame_no long, t double, raw_value double, rms double, mean double, std double, dominant_freq_hz double, is_anomaly boolean, score double, state string"
STATE = "next_i long, used long, late long, tail array<double>, detector string"
COLUMNS = [c.split()[0] for c in FRAMES.split(", ")]


def windows(values: np.ndarray, first: int, config: ProcessorConfig) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the samples that end a frame, and their windows, in ``values`` whose first sample has number ``first``."""
    n, hop = config.window_samples, config.hop_samples
    ends = np.arange(max(first + n - 1, n - 1), first + len(values))
    ends = ends[(ends - (n - 1)) % hop == 0]
    if not len(ends):
        return ends, np.zeros((0, n))
    return ends, np.lib.stride_tricks.sliding_window_view(values, n)[ends - first - (n - 1)]


def process(samples: DataFrame, config: ProcessorConfig, detector: str | Callable[[], Detector] = "zscore") -> DataFrame:
    """Frames of a streaming ``samples`` (sensor_id, i, t, value), in append mode; batch DataFrames work too.

    A micro-batch's samples of a sensor are put in order of ``i``. A sample whose number isn't above the highest one seen
    can't be used any more; the state counts it in ``late``. Windows count the samples that were used, so a gap in the
    numbers neither stops nor shortens one. State is bounded by the window's length.
    """
    factory = detector if callable(detector) else (lambda name=detector: make(name, config.detector if name == "zscore" else None))
    keep = config.window_samples - 1

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_i, used, late, tail, packed = state.get if state.exists else (0, 0, 0, [], None)
        own: Detector = pickle.loads(base64.b64decode(packed)) if packed else factory()
        new = pd.concat(list(parts)).sort_values("i")
        fresh = new[new["i"] >= next_i].drop_duplicates("i")
        late += len(new) - len(fresh)
        if len(fresh):
            values = np.concatenate([np.array(tail, float), fresh["value"].to_numpy(float)])
            first = used - len(tail)
            ends, some = windows(values, first, config)
            if len(ends):
                freq = dominant_frequencies(some, config.sample_rate_hz, config.detrend, config.interpolate_peak)
                rms, mean, std = np.sqrt((some * some).mean(axis=1)), some.mean(axis=1), some.std(axis=1)
                verdicts = [(*own.update(a, b), own.state) for a, b in zip(rms.tolist(), freq.tolist(), strict=True)]
                at = ends - used
                out = pd.DataFrame({"sensor_id": key[0], "frame_no": (ends - keep) // config.hop_samples, "t": fresh["t"].to_numpy()[at], "raw_value": some[:, -1], "rms": rms, "mean": mean, "std": std, "dominant_freq_hz": freq})
                yield out.assign(is_anomaly=[v[0] for v in verdicts], score=[v[1] for v in verdicts], state=[v[2] for v in verdicts])[COLUMNS]
            next_i, used = int(fresh["i"].iloc[-1]) + 1, used + len(fresh)
            tail = values[len(values) - min(keep, len(values)) :].tolist()
        state.update((next_i, used, late, tail, base64.b64encode(pickle.dumps(own)).decode()))

    return samples.groupBy("sensor_id").applyInPandasWithState(run, FRAMES, STATE, "append", GroupStateTimeout.NoTimeout)
