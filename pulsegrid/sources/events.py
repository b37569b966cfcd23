"""Samples from an event table: any id column names the sensor, time orders its samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, key: str, time: Column, order: list[Column], bucket_s: int = 86_400) -> DataFrame:
    """``rows`` with ``i``: each row's number within its key, from 0, in order of time.

    A number needs the rows before it, but not their sorting in one place: rows are numbered within a key's time bucket
    and the buckets' counts, few and small, are added up. So a key with a third of all rows is still many tasks' work.
    """
    bucketed = rows.withColumn("__bucket", F.floor(time.cast("timestamp").cast("double") / bucket_s))
    counts = bucketed.groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("__key"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*order))
    joined = bucketed.withColumn("__at", within).join(offsets, F.col(key).eqNullSafe(F.col("__key")) & F.col("__bucket").eqNullSafe(F.col("__b")))
    return joined.withColumn("i", (F.col("__before") + F.col("__at") - 1).cast("long")).drop("__bucket", "__key", "__b", "__before", "__at")


def samples(events: DataFrame, key: str = "event_type", sample_rate_hz: float = 64.0) -> DataFrame:
    """sensor_id, i, t, value. ``t`` is i / rate; rows without a key, a time or a finite value are left out."""
    value = F.col("value")
    usable = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull() & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    found = numbered(usable, key, F.col("ts"), [F.col("ts"), F.col("event_id")])
    return found.select(F.col(key).cast("string").alias("sensor_id"), "i", (F.col("i") * F.lit(1.0 / sample_rate_hz)).alias("t"), "value")


def relative_time(events: DataFrame, key: str = "event_type") -> DataFrame:
    """sensor_id, event_id, t: seconds since the sensor's first event."""
    first = events.groupBy(key).agg(F.min("ts").alias("first")).withColumnRenamed(key, "__key")
    joined = events.join(first, F.col(key) == F.col("__key"))
    return joined.select(F.col(key).cast("string").alias("sensor_id"), "event_id", (F.timestamp_diff("MICROSECOND", F.col("first"), F.col("ts")) / 1e6).alias("t"), "value")


def sample_rate(timed: DataFrame, bucket_s: int = 86_400) -> DataFrame:
    """sensor_id, sample_rate_hz: one over the median of the positive steps of ``t``; null where there is none.

    Steps are taken within time buckets, so a sensor's samples aren't sorted in one place; the step from one bucket to
    the next comes from the buckets' first and last times.
    """
    bucketed = timed.select("sensor_id", "t", F.floor(F.col("t") / bucket_s).alias("bucket"))
    inside = F.col("t") - F.lag("t").over(Window.partitionBy("sensor_id", "bucket").orderBy("t"))
    ends = bucketed.groupBy("sensor_id", "bucket").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    across = F.col("first") - F.lag("last").over(Window.partitionBy("sensor_id").orderBy("bucket"))
    steps = bucketed.select("sensor_id", inside.alias("step")).unionByName(ends.select("sensor_id", across.alias("step")))
    median = F.median(F.when(F.col("step") > 0, F.col("step")))
    return steps.groupBy("sensor_id").agg((1.0 / median).alias("sample_rate_hz"))
