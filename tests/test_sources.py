import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.config import FaultConfig, SensorConfig
from pulsegrid.sources import csv_replay, drift, events, oscillator


def walked(config, n):
    """The equation integrated by the four stages themselves."""
    h, rng = 1 / config.sample_rate_hz, np.random.default_rng(config.seed)
    warm = round(config.warmup_s * config.sample_rate_hz)
    s, out = np.zeros(2), []
    for k in range(-warm, n):
        faulty = k >= 0 and config.fault is not None and config.fault.contains(k * h)
        w = config.omega_n * (config.fault.omega_n_factor if faulty else 1)
        z = config.zeta * (config.fault.zeta_factor if faulty else 1)
        force = rng.normal(0.0, config.force_std * config.sample_rate_hz**0.5)
        slope = lambda y, w=w, z=z, force=force: np.array([y[1], force - 2 * z * w * y[1] - w * w * y[0]])
        a = slope(s)
        b = slope(s + h / 2 * a)
        c = slope(s + h / 2 * b)
        d = slope(s + h * c)
        s = s + h / 6 * (a + 2 * b + 2 * c + d)
        if k >= 0:
            out.append({"displacement": s[0] + config.dc_offset, "velocity": s[1], "acceleration": slope(s)[1]}[config.channel])
    return np.array(out)


@pytest.mark.parametrize("channel", ["displacement", "velocity", "acceleration"])
def test_oscillator_is_the_integrated_equation(channel):
    config = SensorConfig(duration_s=1.0, channel=channel, dc_offset=3.0, fault=FaultConfig(0.4, 0.2, 0.7, 0.4))
    _, t, value = oscillator.Generator(config).take(1000)
    assert np.allclose(value, walked(config, 1000), rtol=1e-9, atol=1e-9 * np.abs(value).max())
    assert t[7] == 7 * (1 / 1000)


def test_oscillator_continues_where_it_stopped():
    config = SensorConfig(duration_s=1.0)
    whole, parts = oscillator.Generator(config), oscillator.Generator(config)
    assert np.array_equal(whole.take(1000)[2], np.concatenate([parts.take(n)[2] for n in (1, 499, 500)]))
    assert not np.array_equal(oscillator.Generator(SensorConfig(seed=1)).take(5)[2], oscillator.Generator(config).take(5)[2])


def test_peak_moves_with_the_fault():
    config = SensorConfig(duration_s=10.0, fault=FaultConfig(4.0, 2.0, 0.6))
    value = oscillator.Generator(config).take(10_000)[2]
    peak = lambda x: np.fft.rfftfreq(len(x), 1e-3)[np.argmax(np.abs(np.fft.rfft(x * np.hanning(len(x)))))]
    assert 45 < peak(value[:4000]) < 55 and peak(value[:4000]) - peak(value[4000:6000]) > 10


def test_oscillators_and_labels(spark):
    sensors = {"a": SensorConfig(duration_s=0.5, fault=FaultConfig(0.1, 0.2)), "b": SensorConfig(duration_s=0.25, seed=3)}
    rows = oscillator.oscillators(spark, sensors).groupBy("sensor_id").agg(F.count("*").alias("n"), F.max("i").alias("i")).collect()
    assert {r.sensor_id: (r.n, r.i) for r in rows} == {"a": (500, 499), "b": (250, 249)}
    assert {r.sensor_id: r.fault_start for r in oscillator.labels(spark, sensors).collect()} == {"a": 0.1, "b": None}
    with pytest.raises(Exception, match="duration"):
        oscillator.oscillators(spark, {"c": SensorConfig()}).count()


@pytest.mark.parametrize(
    "wrong",
    [{"zeta": 0}, {"zeta": -1}, {"natural_freq_hz": 600}, {"channel": "sound"}, {"duration_s": 0}, {"force_std": -1}, {"sample_rate_hz": 0}],
)
def test_wrong_settings_are_refused(wrong):
    with pytest.raises(ValueError):
        SensorConfig(**wrong)


def test_overdamped_sensors_are_sensors(spark):
    values = [r.value for r in oscillator.oscillators(spark, {"o": SensorConfig(duration_s=0.2, zeta=1.2)}).collect()]
    assert len(values) == 200 and np.isfinite(values).all()


def test_replay(spark, tmp_path):
    lines = ["date_time;strain;temperature", "2024-01-01 00:00:00.000;;1", "2024-01-01 00:00:00.010;1500.5;31.5", "2024-01-01 00:00:00.015;   ;", "2024-01-01 00:00:00.021;1501;", "2024-01-01 00:00:00.032;1502;  "]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    rows = csv_replay.replay(spark, str(tmp_path / "r.csv")).orderBy("t")
    assert [(round(r.t, 6), r.value, r.temperature) for r in rows.collect()] == [(0.0, 1500.5, 31.5), (0.011, 1501.0, None), (0.022, 1502.0, None)]
    assert csv_replay.sample_rate(rows) == pytest.approx(1 / 0.011)
    assert csv_replay.narrow(rows).columns == ["sensor_id", "t", "value"]
    with pytest.raises(ValueError, match="no column"):
        csv_replay.replay(spark, str(tmp_path / "r.csv"), value_column="speed")
    (tmp_path / "one.csv").write_text("date_time;strain\n2024-01-01 00:00:00;1\n")
    with pytest.raises(ValueError, match="two rows"):
        csv_replay.sample_rate(csv_replay.replay(spark, str(tmp_path / "one.csv")))


def test_numbers_do_not_depend_on_the_buckets(spark, sf):
    table = spark.read.parquet(f"{sf}/events.parquet")
    order = [F.col("ts"), F.col("event_id")]
    got = [sorted((r.event_id, r.i) for r in events.numbered(table, "event_type", F.col("ts"), order, b).select("event_id", "i").collect()) for b in (600, 10**9)]
    assert got[0] == got[1] and len(got[0]) == table.count()


def test_unusable_events_are_left_out(spark):
    rows = [(1, "2024-01-01 00:00:00", "a", 1.0), (2, "2024-01-01 00:00:01", "a", float("nan")), (3, "2024-01-01 00:00:02", "a", None), (4, None, "a", 1.0), (5, "2024-01-01 00:00:03", None, 1.0), (6, "2024-01-01 00:00:04", "a", 2.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.i, r.value) for r in events.samples(df).orderBy("i").collect()] == [(0, 1.0), (1, 2.0)]


def test_first_samples_of_an_endless_sensor(spark):
    some = oscillator.oscillators(spark, {"a": SensorConfig(duration_s=None, seed=3)}, first=70).orderBy("i").collect()
    whole = oscillator.oscillators(spark, {"a": SensorConfig(duration_s=0.1, seed=3)}).orderBy("i").collect()
    assert some == whole[:70]


def test_drift_rows_are_seeded(spark):
    rows = drift.drift_features(spark).orderBy("frame_no").collect()
    assert rows == drift.drift_features(spark).orderBy("frame_no").collect() and sum(r.faulty for r in rows) == 40 and [r.frame_no for r in rows if r.faulty][0] == 260
    assert rows[-1].dominant_freq_hz == pytest.approx(55, abs=1)


def test_sample_rate_spans_time_buckets(spark):
    """Steps within and between buckets are the ones of the whole sorted series, whatever the buckets' size."""
    times = {"a": [0.0, 0.5, 0.5, 1.0, 7.0, 7.5, 30.0, 31.0], "b": [3.0, 3.0], "c": [2.0, 12.0, 22.0, 23.0]}
    rows = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts] + [("d", None)], "sensor_id string, t double")
    want = {k: 1 / float(np.median([x for x in np.diff(ts) if x > 0])) for k, ts in times.items() if k != "b"} | {"b": None, "d": None}
    for bucket in (1, 10, 86_400):
        got = {r.sensor_id: r.sample_rate_hz for r in events.sample_rate(rows, bucket).collect()}
        assert got == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
