"""Batches of frames as gzip-compressed JSON lines, a header line first; and the keys they are stored under."""

from __future__ import annotations

import gzip
import io
import json
import math
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A frame's fields, in the order of the format.
FIELDS = ("t", "raw_value", "rms", "mean", "std", "dominant_freq_hz", "is_anomaly", "score")
PRODUCER = "pulsegrid/0.1.0"


@dataclass(frozen=True)
class BatchHeader:
    sensor_id: str
    session_id: str
    batch_seq: int
    frame_count: int
    t_min: float
    t_max: float
    created_at_utc: float
    schema_version: int = 1
    producer: str = PRODUCER


def finite(value):
    return None if isinstance(value, float) and not math.isfinite(value) else value


def serialize(frames: Iterable[dict], header: BatchHeader) -> bytes:
    """The same frames and header give the same bytes. A float that isn't finite is written as null."""
    dump = json.JSONEncoder(allow_nan=False, separators=(",", ":")).encode
    lines = [dump({"type": "header"} | asdict(header))]
    lines += [dump({name: finite(frame[name]) for name in FIELDS}) for frame in frames]
    return gzip.compress("".join(f"{line}\n" for line in lines).encode(), mtime=0)


def header_from(line: str | bytes) -> BatchHeader:
    record = json.loads(line)
    record.pop("type", None)
    return BatchHeader(**record)


def deserialize(blob: bytes) -> tuple[BatchHeader, list[dict]]:
    first, *rest = gzip.decompress(blob).decode().splitlines()
    return header_from(first), [json.loads(line) for line in rest if line.strip()]


def read_header(blob: bytes) -> BatchHeader:
    with gzip.open(io.BytesIO(blob)) as stream:
        return header_from(stream.readline())


def object_key(prefix: str, header: BatchHeader) -> str:
    """Hive partitions by sensor, UTC day and hour; the name tells session and number, so a repeated upload overwrites itself."""
    made = datetime.fromtimestamp(header.created_at_utc, tz=UTC)
    folder = f"sensor_id={header.sensor_id}/date={made:%Y-%m-%d}/hour={made:%H}"
    return f"{prefix.rstrip('/')}/{folder}/part-{header.session_id}-{header.batch_seq:08d}.ndjson.gz"


def key_column(prefix: str, sensor: Column, session: Column, seq: Column, created: Column) -> Column:
    """``object_key`` as a column; ``created`` in epoch seconds. Day and hour are counted, so no time zone matters."""
    second = F.floor(created).cast("long")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86_400).cast("int")), "yyyy-MM-dd")
    hour = F.lpad(F.floor(F.pmod(second, F.lit(86_400)) / 3_600).cast("string"), 2, "0")
    number = F.when(seq < 10**8, F.lpad(seq.cast("string"), 8, "0")).otherwise(seq.cast("string"))
    return F.concat(
        F.lit(prefix.rstrip("/") + "/sensor_id="), sensor, F.lit("/date="), day, F.lit("/hour="), hour,
        F.lit("/part-"), session, F.lit("-"), number, F.lit(".ndjson.gz"),
    )


def clean(frames: DataFrame) -> DataFrame:
    """Floats that aren't finite become null, in every double or float column."""
    def one(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)

    return frames.select(*(one(name) if kind in ("double", "float") else F.col(f"`{name}`") for name, kind in frames.dtypes))


def manifest(frames: DataFrame, batch_frames: int, session_id: str, created_at: Column, prefix: str = "telemetry/v1") -> DataFrame:
    """One row per batch of ``batch_frames`` frames of a sensor: sensor_id, session_id, batch_seq, frame_count, t_min, t_max, created_at_utc, key."""
    seq = F.floor(F.col("frame_no") / batch_frames).cast("long")
    rows = frames.withColumn("batch_seq", seq).groupBy("sensor_id", "batch_seq").agg(
        F.count("*").alias("frame_count"), F.min_by("t", "frame_no").alias("t_min"), F.max_by("t", "frame_no").alias("t_max"), F.max(created_at).alias("created_at_utc")
    )
    named = rows.withColumn("session_id", F.lit(session_id))
    return named.withColumn("key", key_column(prefix, F.col("sensor_id"), F.col("session_id"), F.col("batch_seq"), F.col("created_at_utc")))
