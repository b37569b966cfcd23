"""Replay of a delimited recording: rows with a value, timed from the first of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.sources.events import sample_rate as rate_of


def replay(spark: SparkSession, path: str, delimiter: str = ";", value_column: str = "strain", time_column: str = "date_time", temperature_column: str = "temperature", sensor_id: str = "replay") -> DataFrame:
    """sensor_id, t, value, temperature (null where blank or missing).

    A value of blanks only is no value. ``t`` counts seconds from the earliest kept row: files have no row order in
    Spark, so the time orders rows, not their place in the file.
    """
    rows = spark.read.option("sep", delimiter).option("header", True).csv(path)
    for column in (value_column, time_column):
        if column not in rows.columns:
            raise ValueError(f"{path} has no column {column}")
    text = F.trim(F.col(value_column))
    warm = F.trim(F.col(temperature_column)) if temperature_column in rows.columns else F.lit(None).cast("string")
    kept = rows.where(text != "").select(
        F.unix_micros(F.to_timestamp(F.col(time_column))).alias("micros"), text.cast("double").alias("value"), F.when(warm != "", warm).cast("double").alias("temperature")
    )
    first = kept.agg(F.min("micros").alias("first"))
    return kept.join(F.broadcast(first)).select(F.lit(sensor_id).alias("sensor_id"), ((F.col("micros") - F.col("first")) / 1e6).alias("t"), "value", "temperature")


def narrow(replayed: DataFrame) -> DataFrame:
    return replayed.select("sensor_id", "t", "value")


def sample_rate(replayed: DataFrame) -> float:
    """Raises where there are fewer than two rows or no positive step."""
    found = rate_of(replayed).first()
    if found is None or found.sample_rate_hz is None:
        raise ValueError("the sample rate needs two rows with a positive step")
    return found.sample_rate_hz
