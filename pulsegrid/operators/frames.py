"""Count-based hopping windows over ordered samples.

A window of N samples every hop samples is cut into panes of gcd(N, hop): each pane is summed up once, before the
windows, and a window merges its panes. So a sample is read once, not N / hop times, and what is sorted by sensor is
one row per pane. With panes of one sample there is nothing to gain and the plain row frame does it.

A sensor is cut into blocks that overlap by one window, so a sensor with a third of all samples is many tasks' work too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.config import ProcessorConfig
from pulsegrid.functions.spectrum import dominant_frequency

STATS = ("rms", "mean", "std")
#: Least rows of a block; a window of many rows gets larger blocks, so that the overlap stays an eighth at most.
PANE_BLOCK, SAMPLE_BLOCK = 256, 8192


def in_blocks(rows: DataFrame, place: str, reach: int, least: int) -> tuple[DataFrame, WindowSpec, Column]:
    """Rows with ``__block``, the ones that the next block's windows reach back to twice; the frame of ``reach`` rows in
    a block; and the test for rows that are in their own block. ``place`` numbers a sensor's rows without gaps."""
    size = max(least, 8 * reach)
    own = F.floor(F.col(place) / size).cast("long")
    shared = F.col(place) >= (own + 1) * size - (reach - 1)
    twice = rows.withColumn("__block", F.explode(F.when(shared, F.array(own, own + 1)).otherwise(F.array(own))))
    return twice, Window.partitionBy("sensor_id", "__block").orderBy(place).rowsBetween(1 - reach, 0), F.col("__block") == own


def rolling_stats(samples: DataFrame, n: int) -> DataFrame:
    """sensor_id, i, rms, mean, std over the last ``n`` samples, where there are as many."""
    blocks, frame, own = in_blocks(samples, "i", n, SAMPLE_BLOCK)
    value = F.col("value")
    stats = blocks.select("sensor_id", "i", "t", "value", "__block", F.sqrt(F.avg(value * value).over(frame)).alias("rms"), F.avg(value).over(frame).alias("mean"), F.stddev_pop(value).over(frame).alias("std"))
    return stats.where((F.col("i") >= n - 1) & own).drop("__block")


def decimated(samples: DataFrame, n: int, hop: int) -> DataFrame:
    """The samples that end a window, with their frame number."""
    i = F.col("i")
    return samples.where((i >= n - 1) & ((i - (n - 1)) % hop == 0)).withColumn("frame_no", F.floor((i - (n - 1)) / hop).cast("long"))


def pane_windows(samples: DataFrame, n: int, hop: int, with_values: bool) -> DataFrame:
    """sensor_id, frame_no, t, raw_value, rms, mean, std and, if asked for, the window's values in order."""
    pane = math.gcd(n, hop)
    number = F.floor(F.col("i") / pane).cast("long")
    values = [F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda v: v["value"]).alias("values")] if with_values else []
    panes = samples.groupBy("sensor_id", number.alias("pane")).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"),
        F.max_by(F.struct("i", "t", "value"), "i").alias("last"), *values,
    )
    blocks, frame, own = in_blocks(panes, "pane", n // pane, PANE_BLOCK)
    some = blocks.select(
        "sensor_id", "last", own.alias("own"), F.collect_list(F.struct("n", "mean", "var")).over(frame).alias("panes"), F.sum("n").over(frame).alias("size"),
        *([F.flatten(F.collect_list("values").over(frame)).alias("values")] if with_values else []),
    )
    i = F.col("last.i")
    ends = some.where(F.col("own") & (F.col("size") == n) & (i >= n - 1) & ((i - (n - 1)) % hop == 0))
    centred = ends.withColumn("mean", F.aggregate("panes", F.lit(0.0), lambda s, p: s + p["n"] * p["mean"]) / n)
    square = F.aggregate("panes", F.lit(0.0), lambda s, p: s + p["n"] * p["var"]) / n
    spread = F.aggregate(F.transform("panes", lambda p: p["n"] * F.pow(p["mean"] - F.col("mean"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x) / n
    variance = centred.withColumn("variance", square + spread)
    return variance.select(
        "sensor_id", F.floor((i - (n - 1)) / hop).cast("long").alias("frame_no"), F.col("last.t").alias("t"), F.col("last.value").alias("raw_value"),
        F.sqrt(F.col("variance") + F.col("mean") * F.col("mean")).alias("rms"), "mean", F.sqrt("variance").alias("std"),
        *([F.col("values").alias("window")] if with_values else []),
    )


def row_windows(samples: DataFrame, n: int, hop: int, with_values: bool) -> DataFrame:
    blocks, frame, own = in_blocks(samples, "i", n, SAMPLE_BLOCK)
    value = F.col("value")
    every = blocks.select(
        "sensor_id", "i", "t", own.alias("own"), F.col("value").alias("raw_value"), F.sqrt(F.avg(value * value).over(frame)).alias("rms"),
        F.avg(value).over(frame).alias("mean"), F.stddev_pop(value).over(frame).alias("std"), *([F.collect_list(value).over(frame).alias("window")] if with_values else []),
    )
    return decimated(every.where("own"), n, hop).select("sensor_id", "frame_no", "t", "raw_value", *STATS, *(["window"] if with_values else []))


def window_stats(samples: DataFrame, config: ProcessorConfig, with_values: bool = False) -> DataFrame:
    """Hopping-window statistics. Windows count samples, so a gap in time doesn't shorten one; a partial window is none.

    ``i`` must number a sensor's samples from 0 without gaps (see ``sources.events.numbered``).
    """
    n, hop = config.window_samples, config.hop_samples
    return (pane_windows if math.gcd(n, hop) > 1 else row_windows)(samples, n, hop, with_values)


def feature_frames(samples: DataFrame, config: ProcessorConfig) -> DataFrame:
    """sensor_id, frame_no, t, raw_value, rms, mean, std, dominant_freq_hz."""
    windows = window_stats(samples, config, with_values=True)
    peak = dominant_frequency(F.col("window"), config.sample_rate_hz, config.detrend, config.interpolate_peak)
    return windows.withColumn("dominant_freq_hz", peak).drop("window")
