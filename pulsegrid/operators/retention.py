"""What stays of an ordered history: the last rows, or as many of the newest batches as fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail(rows: DataFrame, n: int, order: list[Column], by: tuple[str, ...] = ("sensor_id",)) -> DataFrame:
    """The last ``n`` rows of each group by ``order`` (given ascending). Spark limits each group while sorting it."""
    newest = Window.partitionBy(*by).orderBy(*(c.desc() for c in order))
    return rows.withColumn("__at", F.row_number().over(newest)).where(F.col("__at") <= n).drop("__at")


def capped(batches: DataFrame, max_files: int | None = None, max_bytes: int | None = None, by: tuple[str, ...] = ("sensor_id",)) -> DataFrame:
    """The newest batches (batch_seq, size) within both caps; the newest one stays even if it is too large alone."""
    newest = Window.partitionBy(*by).orderBy(F.col("batch_seq").desc())
    until = newest.rowsBetween(Window.unboundedPreceding, 0)
    marked = batches.withColumn("__at", F.row_number().over(newest)).withColumn("__sum", F.sum("size").over(until))
    fits = F.lit(True)
    if max_files is not None:
        fits &= F.col("__at") <= max_files
    if max_bytes is not None:
        fits &= F.col("__sum") <= max_bytes
    return marked.where(fits | (F.col("__at") == 1)).drop("__at", "__sum")
