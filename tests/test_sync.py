import gzip
import random
import time

import pytest
from pyspark.sql import functions as F

from pulsegrid.config import BackoffConfig, SinkConfig
from pulsegrid.operators import retention
from pulsegrid.sync import backoff, codec, sink, store

HEADER = codec.BatchHeader("press-042", "9f3c2b", 0, 3, 0.0, 0.2, 1753100000.0)


def frame(k):
    return {"t": 0.1 * k, "raw_value": 1.0, "rms": 2.0, "mean": 3.0, "std": 4.0, "dominant_freq_hz": 50.0, "is_anomaly": k % 5 == 0, "score": 0.5}


def test_batches_round_trip_and_are_the_same_bytes():
    rows = [frame(k) for k in range(3)]
    blob = codec.serialize(rows, HEADER)
    assert blob == codec.serialize(rows, HEADER) and codec.deserialize(blob) == (HEADER, rows) and codec.read_header(blob) == HEADER
    assert gzip.decompress(blob).count(b"\n") == 4


def test_floats_that_are_not_finite_become_null(spark):
    odd = frame(1) | {"rms": float("nan"), "dominant_freq_hz": float("inf")}
    assert codec.deserialize(codec.serialize([odd], HEADER))[1][0]["rms"] is None
    df = spark.createDataFrame([(1, float("nan")), (2, float("-inf")), (3, 1.5), (4, None)], "k long, x double")
    assert {r.k: r.x for r in codec.clean(df).collect()} == {1: None, 2: None, 3: 1.5, 4: None}


def test_keys(spark):
    want = "telemetry/v1/sensor_id=press-042/date=2025-07-21/hour=12/part-9f3c2b-00000000.ndjson.gz"
    assert codec.object_key("telemetry/v1/", HEADER) == want
    column = codec.key_column("telemetry/v1/", *map(F.lit, ("press-042", "9f3c2b", 0, 1753100000.0)))
    assert spark.range(1).select(column.alias("k")).first().k == want
    big = codec.key_column("p", F.lit("s"), F.lit("x"), F.lit(1234567890), F.lit(0.0))
    assert spark.range(1).select(big.alias("k")).first().k.endswith("part-x-1234567890.ndjson.gz")


def test_backoff(spark):
    config = BackoffConfig(max_s=10.0, jitter=0.0)
    want = [0.5, 1, 2, 4, 8, 10, 10]
    assert [backoff.delay(k, config, random.Random()) for k in range(7)] == want
    assert backoff.delay(10**6, config, random.Random()) == 10.0
    assert [r.d for r in spark.range(7).select(backoff.schedule(F.col("id"), config).alias("d")).collect()] == want
    drawn = [backoff.delay(3, BackoffConfig(), random.Random(k)) for k in range(200)]
    assert 0 <= min(drawn) < 0.5 and 3.5 < max(drawn) <= 4


def test_failures_by_status():
    assert [store.failure(s) for s in (200, 404, 429, 503, None)] == [None, store.PermanentUploadError, store.TransientUploadError, store.TransientUploadError, store.TransientUploadError]


def test_the_pattern_of_failures_goes_round():
    flaky, failed = store.FlakyUploader(store.MemoryUploader(), pattern=[False, True, False]), []
    for k in range(9):
        try:
            flaky.upload(str(k), b"x")
        except store.TransientUploadError:
            failed.append(k)
    assert failed == [1, 4, 7]


def test_caps_must_be_positive(tmp_path):
    for caps in ({"max_files": 0}, {"max_bytes": -1}):
        with pytest.raises(ValueError, match="caps"):
            store.Spool(str(tmp_path), **caps)


def test_flaky_uploader():
    inner = store.MemoryUploader()
    flaky = store.FlakyUploader(inner, fail_first_n=1, pattern=[False, True, False])
    went = []
    for k in range(5):
        try:
            flaky.upload(str(k), b"x")
            went.append(k)
        except store.TransientUploadError:
            pass
    assert went == [1, 3, 4] and flaky.attempts == 5 and set(inner.objects) == {"1", "3", "4"}


def test_spool_is_first_in_first_out_and_survives(tmp_path):
    spool = store.Spool(str(tmp_path))
    names = [spool.put(bytes([k])) for k in range(3)]
    (tmp_path / "00000000000000000009.blob.tmp").write_bytes(b"half")
    (tmp_path / "notes.txt").write_text("not ours")
    again = store.Spool(str(tmp_path))
    assert len(again) == 3 and again.total_bytes == 3 and again.peek() == (names[0], b"\0")
    again.ack(names[0])
    again.ack(names[0])
    assert again.peek()[1] == b"\1" and again.put(b"z") > names[2]
    assert not list(tmp_path.glob("*.tmp")) and (tmp_path / "notes.txt").exists()


@pytest.mark.parametrize("seed", range(20))
def test_caps_of_spool_and_query_agree(spark, tmp_path, seed):
    draw = random.Random(seed)
    sizes = [draw.randint(1, 9) for _ in range(8)]
    caps = {"max_files": draw.randint(1, 4), "max_bytes": draw.randint(1, 20)}
    spool = store.Spool(str(tmp_path), fsync=False, **caps)
    for n in sizes:
        spool.put(b"x" * n)
    kept = [int(n.split(".")[0]) for n in sorted(spool.sizes)]
    if seed < 3:
        df = spark.createDataFrame([("s", k, n) for k, n in enumerate(sizes)], "sensor_id string, batch_seq long, size long")
        assert sorted(r.batch_seq for r in retention.capped(df, **caps).collect()) == kept
    assert spool.dropped_batches == len(sizes) - len(kept) and kept[-1] == 7


def test_tail(spark):
    df = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 9)], "sensor_id string, k long")
    assert sorted((r.sensor_id, r.k) for r in retention.tail(df, 2, [F.col("k")]).collect()) == [("a", 3), ("a", 4), ("b", 9)]


def test_sinks():
    kept = sink.ListSink(2)
    for k in range(4):
        kept.emit(frame(k))
    assert [f["t"] for f in kept.frames] == [0.2, pytest.approx(0.3)]
    seen = []
    sink.CallbackSink(seen.append).emit(frame(1))
    assert len(seen) == 1
    with pytest.raises(ValueError):
        sink.ListSink(0)


def settings(**more):
    return SinkConfig(sensor_id="s", batch_max_frames=50, batch_max_seconds=60, poll_timeout_s=0.02, backoff=BackoffConfig(base_s=0.001, max_s=0.002, **more))


def test_an_outage_and_a_restart_lose_nothing(tmp_path):
    broken = store.FlakyUploader(store.MemoryUploader(), fail_prob=1.0)
    first = sink.DurableSink(broken, store.Spool(str(tmp_path)), settings(), session_id="one")
    first.start()
    slowest = 0.0
    for k in range(250):
        began = time.perf_counter()
        first.emit(frame(k))
        slowest = max(slowest, time.perf_counter() - began)
    first.close(drain=False)
    assert slowest < 0.05 and first.uploaded_batches == 0 and first.upload_failures > 0 and first.enqueued_batches == 5
    good = store.MemoryUploader()
    with sink.DurableSink(good, store.Spool(str(tmp_path)), settings(), session_id="two") as second:
        second.emit(frame(250))
    rows = [f for b in good.objects.values() for f in codec.deserialize(b)[1]]
    assert len(good.objects) == 6 and sorted(round(f["t"], 1) for f in rows) == [round(0.1 * k, 1) for k in range(251)]


def test_waits_and_dead_letters(tmp_path):
    waits = []
    flaky = store.FlakyUploader(store.MemoryUploader(), fail_first_n=3)
    config = SinkConfig(sensor_id="s", batch_max_frames=1, poll_timeout_s=0.02, backoff=BackoffConfig(jitter=0.0))
    with sink.DurableSink(flaky, store.Spool(str(tmp_path / "a")), config, sleep=waits.append) as s:
        s.emit(frame(0))
    assert waits == [0.5, 1.0, 2.0] and s.uploaded_batches == 1
    never = store.FlakyUploader(store.MemoryUploader(), fail_prob=1.0)
    with sink.DurableSink(never, store.Spool(str(tmp_path / "b")), settings(max_attempts=2), sleep=lambda _: None) as s:
        s.emit(frame(0))
    assert s.dead_lettered == 1 and never.attempts == 2


def test_a_full_queue_drops_and_counts(tmp_path):
    s = sink.DurableSink(store.MemoryUploader(), store.Spool(str(tmp_path)), SinkConfig(queue_maxsize=2))
    for k in range(5):
        s.emit(frame(k))
    assert s.dropped_frames == 3


def test_delivery_by_tasks_is_whole_and_repeats_overwrite(spark, tmp_path):
    rows = [("s" + str(k % 2), k // 2, *frame(k // 2).values()) for k in range(120)]
    columns = "sensor_id string, frame_no long, t double, raw_value double, rms double, mean double, std double, dominant_freq_hz double, is_anomaly boolean, score double"
    frames = spark.createDataFrame(rows, columns)
    root, config = str(tmp_path), BackoffConfig(base_s=0.001, max_s=0.002, max_attempts=5)
    for _ in range(2):
        sent = sink.deliver(frames, store.FlakyUploader(store.FolderUploader(root), fail_first_n=2), "x1", 1753100000.0, 25, config=config).collect()
        assert len(sent) == 6 and all(r.delivered and r.attempts >= 1 for r in sent)
    assert store.stored(spark, root).count() == 6
    back = store.read_frames(spark, root)
    assert back.count() == 120 and {(r.hour, r.date, r.session_id) for r in back.select("hour", "date", "session_id").collect()} == {("12", "2025-07-21", "x1")}
    assert store.audit(frames, back).first().asDict() == {"frames_emitted": 120, "frames_stored": 120, "missing": 0}
    failed = sink.deliver(frames, store.FlakyUploader(store.FolderUploader(root), fail_prob=1.0), "x2", 0.0, 60, config=config).collect()
    assert not any(r.delivered for r in failed)
