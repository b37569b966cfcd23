import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.config import BackoffConfig, DetectorConfig, ProcessorConfig
from pulsegrid.operators import detect, frames
from pulsegrid.sources.oscillator import OscillatorSource
from pulsegrid.streaming import processor, sink
from pulsegrid.sync import store

CONFIG = ProcessorConfig(sample_rate_hz=100.0, window_s=0.5, hop_s=0.1, detector=DetectorConfig(calibration_frames=5))
SAMPLES = "sensor_id string, i long, t double, value double"


def samples(spark, n=400, seed=1):
    draw = np.random.default_rng(seed)
    values = draw.normal(size=n) + np.where((np.arange(n) > 250) & (np.arange(n) < 330), 6.0, 0.0) * np.sin(np.arange(n))
    return spark.createDataFrame([("s", k, k / 100.0, float(v)) for k, v in enumerate(values)], SAMPLES)


def streamed(spark, tmp_path, parts, **more):
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = processor.process(live, CONFIG, **more).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_stream_with_restarts_equals_batch(spark, tmp_path):
    whole = samples(spark)
    parts = [whole.where((F.col("i") >= a) & (F.col("i") < b)).orderBy(F.rand(1)) for a, b in ((0, 37), (37, 49), (49, 233), (233, 400))]
    got = streamed(spark, tmp_path, parts)
    want = detect.zscore(frames.feature_frames(whole, CONFIG), CONFIG.detector)
    columns = ["frame_no", "t", "raw_value", *(F.round(c, 8).alias(c) for c in ("rms", "mean", "std", "dominant_freq_hz", "score")), "is_anomaly", "state"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect()) and any(r.is_anomaly for r in got.collect())


def test_late_samples_are_not_used(spark, tmp_path):
    whole = samples(spark, 200)
    got = streamed(spark, tmp_path, [whole.where("i < 150"), whole.where("i < 20"), whole.where("i >= 150")])
    assert sorted(r.frame_no for r in got.collect()) == [r.frame_no for r in frames.window_stats(whole, CONFIG).orderBy("frame_no").collect()]


def test_a_gap_is_passed_once(spark, tmp_path):
    """After a gap in the numbers a repeat of what was used already is late, and the windows count used samples."""
    whole = samples(spark, 200)
    parts = [whole.where("i < 100"), whole.where("i >= 150"), whole.where("i >= 150"), whole.where("i >= 90 and i < 120")]
    got = streamed(spark, tmp_path, parts).collect()
    used = [k for k in range(200) if k < 100 or k >= 150]
    ends = range(CONFIG.window_samples - 1, len(used), CONFIG.hop_samples)
    assert sorted((r.frame_no, round(r.t, 6)) for r in got) == [(n, used[e] / 100.0) for n, e in enumerate(ends)]


@pytest.mark.parametrize("name", ["ewma", "kalman"])
def test_adaptive_detectors_in_a_stream(spark, tmp_path, name):
    whole = samples(spark)
    factory = lambda n=name: detect.make(n, type(detect.make(n).config)(calibration_frames=5))
    got = streamed(spark, tmp_path, [whole.where("i < 222"), whole.where("i >= 222")], detector=factory)
    want = detect.folded(frames.feature_frames(whole, CONFIG), factory)
    columns = ["frame_no", "is_anomaly", "state", F.round("score", 6).alias("score")]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_endless_sensor_as_a_stream_delivered_in_batches(spark, tmp_path):
    spark.dataSource.register(OscillatorSource)
    live = spark.readStream.format("oscillator").options(sensor_id="press", sample_rate_hz="200", natural_freq_hz="20", duration_s="3", seed="5", rows_per_batch="150").load()
    config = ProcessorConfig(sample_rate_hz=200.0, window_s=0.5, hop_s=0.1, detector=DetectorConfig(calibration_frames=5))
    root = str(tmp_path / "store")
    query = sink.start(processor.process(live, config), store.FolderUploader(root), str(tmp_path / "check"), "run1", 1753100000.0, 10, config=BackoffConfig(max_attempts=3), trigger={"processingTime": "0 seconds"})
    try:
        for _ in range(100):
            query.processAllAvailable()
            if query.lastProgress and store_count(spark, root) == 26:
                break
    finally:
        sink.close(query, drain=False)
    back = store.read_frames(spark, root)
    assert sorted(round(r.t * 200) for r in back.collect()) == list(range(99, 600, 20))
    assert all(s.startswith("run1-") for (s,) in back.select("session_id").distinct().collect())


def store_count(spark, root):
    import os

    return store.read_frames(spark, root).count() if os.path.isdir(root) else 0
