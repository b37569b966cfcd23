"""Verdicts against known fault windows: confusion counts, rates, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import ProcessorConfig
from pulsegrid.operators.detect import detector_set

COUNTS = ("tp", "fp", "tn", "fn")


def ratio(part: Column, whole: Column) -> Column:
    """NaN where the whole is 0."""
    return F.when(whole == 0, float("nan")).otherwise(part / F.when(whole != 0, whole))


def window_overlap(t: Column, window_s: float, start: Column, end: Column) -> Column:
    """Which part of the window that ends at ``t`` lies in the fault."""
    return F.greatest(F.lit(0.0), F.least(t, end) - F.greatest(t - window_s, start)) / window_s


def labelled(frames: DataFrame, labels: DataFrame, window_s: float, guard_frac: float = 0.5) -> DataFrame:
    """``frames`` with point_label (start <= t < end) and window_label (overlap >= guard_frac), false without a fault.

    ``labels`` (sensor_id, fault_start, fault_end) joins here and nowhere before: no detector can see it.
    """
    if not 0 <= guard_frac <= 1:
        raise ValueError("guard_frac must lie in [0, 1]")
    truth = labels.select(F.col("sensor_id").alias("__sensor"), "fault_start", "fault_end")
    t, start, end = F.col("t"), F.col("fault_start"), F.col("fault_end")
    known = frames.join(truth, F.col("sensor_id") == F.col("__sensor"), "left").drop("__sensor")
    return known.withColumns({
        "point_label": F.coalesce((t >= start) & (t < end), F.lit(False)),
        "window_label": F.coalesce(window_overlap(t, window_s, start, end) >= guard_frac, F.lit(False)) & start.isNotNull(),
    })


def counts(label: str, verdict: str = "is_anomaly", prefix: str = "") -> list[Column]:
    y, p = F.col(label), F.col(verdict)
    cells = {"tp": y & p, "fp": ~y & p, "tn": ~y & ~p, "fn": y & ~p}
    return [F.count_if(cells[name]).alias(prefix + name) for name in COUNTS]


def rates(prefix: str = "") -> dict[str, Column]:
    """precision, recall, f1, false_positive_rate and supports from the counts; NaN where undefined."""
    tp, fp, tn, fn = (F.col(prefix + name) for name in COUNTS)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    both = precision + recall
    f1 = F.when(F.isnan(both) | (both == 0), float("nan")).otherwise(2 * precision * recall / F.when(both != 0, both))
    return {
        f"{prefix}precision": precision, f"{prefix}recall": recall, f"{prefix}f1": f1, f"{prefix}false_positive_rate": ratio(fp, fp + tn),
        f"{prefix}support_positive": tp + fn, f"{prefix}support_negative": fp + tn,
    }


def confusion(judged: DataFrame, label: str, by: tuple[str, ...] = ("sensor_id",)) -> DataFrame:
    return judged.groupBy(*by).agg(*counts(label)).withColumns(rates())


def latencies(config: ProcessorConfig, guard_frac: float = 0.5) -> list[Column]:
    """first_detection_t (the first verdict from the onset on, however late), detection_latency_s, event_detected (a
    verdict from the onset up to one window after the end), latency_reference_s."""
    t, start, end = F.col("t"), F.col("fault_start"), F.col("fault_end")
    seen = F.col("is_anomaly") & (t >= start)
    reference = config.window_s * guard_frac + config.detector.min_consecutive / config.feature_rate_hz
    return [
        F.min(F.when(seen, t)).alias("first_detection_t"), F.coalesce(F.bool_or(seen & (t < end + config.window_s)), F.lit(False)).alias("event_detected"),
        (F.min(F.when(seen, t)) - F.min("fault_start")).alias("detection_latency_s"), F.lit(reference).alias("latency_reference_s"),
    ]


def latency(judged: DataFrame, config: ProcessorConfig, guard_frac: float = 0.5, by: tuple[str, ...] = ("sensor_id",)) -> DataFrame:
    return judged.groupBy(*by).agg(*latencies(config, guard_frac))


def report(judged: DataFrame, config: ProcessorConfig, guard_frac: float = 0.5, by: tuple[str, ...] = ("sensor_id",)) -> DataFrame:
    """One row per sensor: n_frames, raw and windowed counts and rates, latency."""
    late = latencies(config, guard_frac)
    base = judged.groupBy(*by).agg(F.count("*").alias("n_frames"), *counts("point_label", prefix="raw_"), *counts("window_label", prefix="windowed_"), *late)
    return base.withColumns(rates("raw_") | rates("windowed_"))


def compare(frames: DataFrame, labels: DataFrame, config: ProcessorConfig, guard_frac: float = 0.5, **detectors) -> DataFrame:
    """A report for each detector over the same frames. They are made anew for each detector unless they are a written or cached table."""
    out = None
    for name, detect in detector_set(**detectors).items():
        judged = labelled(detect(frames), labels, config.window_s, guard_frac)
        one = report(judged, config, guard_frac).withColumn("detector", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def drift_tally(features: DataFrame, **detectors) -> DataFrame:
    """detector, caught_fault, false_positives, healthy_frames over frames with a ``faulty`` column."""
    out = None
    for name, detect in detector_set(**detectors).items():
        flag, faulty = F.col("is_anomaly"), F.col("faulty")
        one = detect(features).agg(F.coalesce(F.bool_or(flag & faulty), F.lit(False)).alias("caught_fault"), F.count_if(flag & ~faulty).alias("false_positives"), F.count_if(~faulty).alias("healthy_frames"))
        one = one.select(F.lit(name).alias("detector"), "*")
        out = one if out is None else out.unionByName(one)
    return out
