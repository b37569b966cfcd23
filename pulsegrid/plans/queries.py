"""The registered queries: each operator over a whole table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.config import BackoffConfig, DetectorConfig, FaultConfig, ProcessorConfig, SensorConfig
from pulsegrid.functions.spectrum import dominant_frequency, peak_sql, spectrogram, spectrum_sql, welch
from pulsegrid.operators import detect, evaluate, frames, retention
from pulsegrid.plans import sql
from pulsegrid.sources import csv_replay, drift, events, oscillator
from pulsegrid.streaming import processor
from pulsegrid.sync import backoff, codec, sink, store

CONFIG = ProcessorConfig(sample_rate_hz=sql.RATE, window_s=sql.N / sql.RATE, hop_s=sql.HOP / sql.RATE, detector=DetectorConfig(calibration_frames=sql.CALIBRATION))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for files: below the cluster's shared one, or a temporary one on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster must name a folder that driver and executors share in spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="pulsegrid-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles that both engines compute are rounded; window means of values with two digits need eight, or they tie."""
    finer = dict.fromkeys(("rms", "mean", "std"), 8)
    exact = {"t", "t_min", "t_max", "value", "raw_value", "first_detection_t", "detection_latency_s", "latency_reference_s"}
    return df.select(*(F.round(c, finer.get(c, digits)).alias(c) if kind == "double" and c not in exact else F.col(c) for c, kind in df.dtypes))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.samples(table(spark, sf_dir, "events"), "event_type", sql.RATE)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.feature_frames(samples(spark, sf_dir), CONFIG)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.window_stats(samples(spark, sf_dir), CONFIG)


def fault_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same made-up fault for every sensor."""
    start, end = sql.FAULT
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("sensor_id")).distinct()
    return names.withColumns({"fault_start": F.lit(start), "fault_end": F.lit(end)})


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.zscore(features(spark, sf_dir), CONFIG.detector)
    return evaluate.labelled(found, fault_labels(spark, sf_dir), CONFIG.window_s)


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as a delimited file and replayed; the id rides in the temperature column."""
    path = f"{scratch(spark)}/replay"
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date_time"), F.col("value").alias("strain"), F.col("event_id").alias("temperature"))
    rows.write.option("sep", ";").option("header", True).csv(path)
    return csv_replay.replay(spark, path).select(F.col("temperature").cast("long").alias("event_id"), F.round("t", 6).alias("t"), "value")


def narrow_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay's narrow projection, blank values among the rows; two digits, since a file has text."""
    path = f"{scratch(spark)}/replay"
    blank = F.when(F.col("event_id") % 4 == 0, F.lit(" ")).otherwise(F.col("value").cast("string"))
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date_time"), blank.alias("strain"))
    rows.write.option("sep", ";").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return csv_replay.narrow(csv_replay.replay(spark, path)).withColumn("t", F.round("t", 6))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("window"))


def power_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vectors(spark, sf_dir).select("vec_id", F.posexplode(welch(F.col("window"), sql.RATE, sql.N)).alias("bin", "x"))
    return made.select("vec_id", F.col("bin").cast("long").alias("bin"), F.col("x.frequency_hz").alias("frequency_hz"), F.round("x.density", 8).alias("density"))


def density_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spectrogram(samples(spark, sf_dir), sql.N, sql.HOP, sql.RATE).select("sensor_id", "frame_no", F.posexplode("density").alias("bin", "x"))
    return made.select("sensor_id", "frame_no", F.col("bin").cast("long").alias("bin"), F.col("x.frequency_hz").alias("frequency_hz"), F.round("x.density", 6).alias("density"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.manifest(stats(spark, sf_dir), sql.BATCH, sql.SESSION, F.lit(float(sql.CREATED)), sql.PREFIX)


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(spark, sf_dir).select("sensor_id", "batch_seq", (F.col("frame_count") * 100 + F.col("batch_seq")).alias("size"))


def detected(name: str) -> Callable[[SparkSession, str], DataFrame]:
    shared = {"calibration_frames": sql.CALIBRATION}
    return lambda spark, sf_dir: rounded(detect.detector_set(**shared)[name](features(spark, sf_dir)).select("sensor_id", "frame_no", "score", "is_anomaly", "state"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features(spark, sf_dir)
    return rounded(evaluate.compare(made, fault_labels(spark, sf_dir), CONFIG, calibration_frames=sql.CALIBRATION))


def unclean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three values made NaN or infinite, then cleaned."""
    kind = F.col("event_id") % 3
    spoiled = F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return codec.clean(table(spark, sf_dir, "events").select("event_id", spoiled.alias("value")))


def drift_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.drift_tally(drift.drift_features(spark))


DEMO = {"demo": SensorConfig(duration_s=15.0, fault=FaultConfig(7.0, 3.0, 0.7, 0.4))}


def oscillator_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ProcessorConfig()
    made = frames.feature_frames(oscillator.oscillators(spark, DEMO), config)
    return rounded(evaluate.report(evaluate.labelled(detect.zscore(made, config.detector), oscillator.labels(spark, DEMO), config.window_s), config))


def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from a stream over the samples that the batch query doesn't have, and the other way round: none, if all is well."""
    folder = scratch(spark)
    made = samples(spark, sf_dir).withColumn("part", F.floor(F.col("i") / 500))
    made.repartition("part").write.partitionBy("part").parquet(f"{folder}/samples")
    schema = "sensor_id string, i long, t double, value double, part long"
    live = processor.process(spark.readStream.schema(schema).parquet(f"{folder}/samples").drop("part"), CONFIG, "zscore")
    query = live.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/frames")
    query.awaitTermination()
    columns = ["sensor_id", "frame_no", "is_anomaly", "state"]
    streamed, whole = spark.read.parquet(f"{folder}/frames").select(*columns), detect.zscore(features(spark, sf_dir), CONFIG.detector).select(*columns)
    return whole.exceptAll(streamed).withColumn("side", F.lit("batch")).unionByName(streamed.exceptAll(whole).withColumn("side", F.lit("stream")))


def sync_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames delivered to a folder through a transport that fails at first, read back and counted."""
    folder = scratch(spark).removeprefix("file:")
    made = detect.zscore(features(spark, sf_dir), CONFIG.detector)
    uploader = store.FlakyUploader(store.FolderUploader(folder), fail_first_n=1)
    sent = sink.deliver(made, uploader, sql.SESSION, float(sql.CREATED), sql.BATCH, sql.PREFIX, BackoffConfig(base_s=0.01, max_s=0.02, max_attempts=8))
    sent.write.parquet(f"{folder}-sent")
    return store.audit(made, store.read_frames(spark, folder), sql.SESSION).join(spark.read.parquet(f"{folder}-sent").agg(F.count("*").alias("batches"), F.bool_and("delivered").alias("delivered")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sensor_samples": samples,
    "replay_narrow": narrow_replay,
    "relative_time": lambda s, d: events.relative_time(table(s, d, "events")).withColumn("t", F.round("t", 6)),
    "sample_rate": lambda s, d: rounded(events.sample_rate(events.relative_time(table(s, d, "events"))), 9),
    "csv_replay": replayed,
    "rolling_stats": lambda s, d: rounded(frames.rolling_stats(samples(s, d), sql.N).drop("t", "value")),
    "decimated": lambda s, d: frames.decimated(samples(s, d), sql.N, sql.HOP).drop("i"),
    "window_stats": lambda s, d: rounded(stats(s, d)),
    "feature_frames": lambda s, d: rounded(features(s, d)),
    "dft_peak": lambda s, d: rounded(peak_sql(spectrum_sql(vectors(s, d), "vec_id", "window", sql.N), "vec_id", sql.N, sql.RATE, interpolate=False)),
    "dft_peak_interp": lambda s, d: rounded(vectors(s, d).select("vec_id", dominant_frequency(F.col("window"), sql.RATE).alias("dominant_freq_hz"))),
    "power_density": power_density,
    "spectrogram": density_frames,
    "baseline_stats": lambda s, d: rounded(detect.baseline(features(s, d), CONFIG.detector)),
    "zscore_raw": lambda s, d: rounded(detect.zscore_raw(features(s, d), CONFIG.detector).select("sensor_id", "frame_no", "score", "raw")),
    "zscore_debounced": detected("zscore"),
    "ewma_detect": detected("ewma"),
    "kalman_detect": detected("kalman"),
    "eval_raw": lambda s, d: rounded(evaluate.confusion(judged(s, d), "point_label")),
    "eval_windowed": lambda s, d: rounded(evaluate.confusion(judged(s, d), "window_label")),
    "eval_latency": lambda s, d: evaluate.latency(judged(s, d), CONFIG),
    "detector_compare": compared,
    "batch_manifest": lambda s, d: batches(s, d).drop("created_at_utc", "key"),
    "object_keys": lambda s, d: batches(s, d).select("sensor_id", "batch_seq", "key"),
    "tail_n": lambda s, d: retention.tail(stats(s, d).select("sensor_id", "frame_no", "t"), 7, [F.col("frame_no")]),
    "retention_files": lambda s, d: retention.capped(sized(s, d), max_files=3),
    "retention_bytes": lambda s, d: retention.capped(sized(s, d), max_bytes=6000),
    "backoff_schedule": lambda s, d: s.range(12).select(F.col("id").alias("attempt"), backoff.schedule(F.col("id"), BackoffConfig(max_s=10.0, jitter=0.0)).alias("delay_s")),
    "clean_nonfinite": unclean,
    "drift_tally": drift_tally,
    "oscillator_report": oscillator_report,
    "stream_equals_batch": stream_equals_batch,
    "sync_audit": sync_audit,
}
