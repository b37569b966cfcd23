import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.config import DetectorConfig, EwmaConfig, FaultConfig, KalmanConfig, ProcessorConfig, SensorConfig
from pulsegrid.operators import detect, evaluate, frames
from pulsegrid.plans.queries import DEMO, oscillator_report
from pulsegrid.sources import drift, oscillator

FRAMES = "sensor_id string, frame_no long, t double, rms double, dominant_freq_hz double"


def made(spark, rows, sensor="s"):
    return spark.createDataFrame([(sensor, k, float(k), float(a), float(b)) for k, (a, b) in enumerate(rows)], FRAMES)


def noisy(seed, n=300):
    draw = random.Random(seed)
    return [(1 + draw.gauss(0, 0.02) + (0.4 if 120 <= k < 160 and draw.random() < 0.8 else 0), 50 + draw.gauss(0, 0.7)) for k in range(n)]


@pytest.mark.parametrize(("raise_after", "clear_after"), [(3, 5), (1, 1), (2, 1), (4, 2)])
def test_debounce_by_windows_equals_the_machine(spark, raise_after, clear_after):
    draw = random.Random(raise_after)
    raw = [draw.random() < 0.5 for _ in range(3000)]
    config = DetectorConfig(min_consecutive=raise_after, clear_consecutive=clear_after)
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(raw)], "sensor_id string, frame_no long, raw boolean")
    got = [r.is_anomaly for r in detect.debounced(df, "raw", config).orderBy("frame_no").collect()]
    machine = detect.Debounce(raise_after, clear_after)
    assert got == [machine.update(v) for v in raw]


@pytest.mark.parametrize("config", [DetectorConfig(), DetectorConfig(calibration_frames=2, k=2.0, min_consecutive=1, clear_consecutive=2)])
def test_zscore_by_windows_equals_the_fold(spark, config):
    df = made(spark, noisy(1)).unionByName(made(spark, noisy(2), "r"))
    by_windows = detect.zscore(df, config)
    by_fold = detect.folded(df, lambda: detect.make("zscore", config))
    columns = ["sensor_id", "frame_no", "is_anomaly", "state", F.round("score", 6).alias("score")]
    assert sorted(by_windows.select(*columns).collect()) == sorted(by_fold.select(*columns).collect())


@pytest.mark.parametrize("name", ["zscore", "ewma", "kalman"])
def test_calibration_never_flags(name):
    d = detect.make(name)
    assert all(d.update(1.0, 50.0) == (False, 0.0) for _ in range(30)) and d.is_calibrated and d.state == "normal"
    for _ in range(3):
        flag, _ = d.update(1.0, 90.0)
    assert flag and d.state == "anomalous"
    d.reset()
    assert not d.is_calibrated and d.state == "calibrating" and d.update(1.0, 90.0) == (False, 0.0)


@pytest.mark.parametrize("name", ["ewma", "kalman"])
def test_a_long_fault_stays_flagged_and_a_slow_drift_does_not(name):
    d = detect.make(name)
    draw = random.Random(3)
    for _ in range(60):
        d.update(1 + draw.gauss(0, 0.01), 50 + draw.gauss(0, 0.2))
    flags = [d.update(1.0, 30.0)[0] for _ in range(120)]
    assert all(flags[2:]) and not any(flags[:2])
    d = detect.make(name)
    assert not any(d.update(1 + draw.gauss(0, 0.01), 50 + 0.01 * k + draw.gauss(0, 0.2))[0] for k in range(600))


def test_floors_guard_a_flat_baseline():
    d = detect.make("zscore", DetectorConfig(calibration_frames=5))
    for _ in range(5):
        d.update(1.0, 50.0)
    assert d.update(1.0, 51.0) == (False, 2.0)


def test_nan_features_are_not_anomalous(spark):
    rows = [(1.0, 50.0 + k % 2) for k in range(40)] + [(float("nan"), 50.0)] * 5
    assert not any(r.is_anomaly for r in detect.zscore(made(spark, rows)).collect())
    assert not any(r.is_anomaly for r in detect.ewma(made(spark, rows)).collect())


def test_too_few_frames_stay_in_calibration(spark):
    rows = detect.zscore(made(spark, [(1.0, 50.0)] * 10)).collect()
    assert all((r.score, r.is_anomaly, r.state) == (0.0, False, "calibrating") for r in rows)


def test_settings_are_checked():
    for kind, wrong in ((DetectorConfig, {"k": 0}), (EwmaConfig, {"alpha": 0}), (KalmanConfig, {"process_var_ratio": 0}), (DetectorConfig, {"calibration_frames": 0})):
        with pytest.raises(ValueError):
            kind(**wrong)


def test_confusion_and_rates(spark):
    df = spark.createDataFrame([("s", *p) for p in [(True, True), (True, False), (False, True), (False, False)]], "sensor_id string, label boolean, is_anomaly boolean")
    r = evaluate.confusion(df, "label").first()
    assert (r.tp, r.fn, r.fp, r.tn) == (1, 1, 1, 1) and (r.precision, r.recall, r.f1, r.false_positive_rate) == (0.5,) * 4
    empty = evaluate.confusion(df.where("not label and not is_anomaly"), "label").first()
    assert all(x != x for x in (empty.precision, empty.recall, empty.f1)) and empty.false_positive_rate == 0


@pytest.mark.parametrize(("t", "window", "share"), [(5, 1, 1), (15, 1, 0), (11, 2, 0.5), (10, 2, 1)])
def test_window_overlap(spark, t, window, share):
    assert spark.range(1).select(evaluate.window_overlap(F.lit(float(t)), window, F.lit(0.0), F.lit(10.0)).alias("x")).first().x == share


def test_guard_band_and_latency(spark):
    rows = [("s", k, t, flag) for k, (t, flag) in enumerate([(6.0, True), (7.5, False), (9.0, True), (10.5, False), (12.0, True)])]
    df = spark.createDataFrame(rows, "sensor_id string, frame_no long, t double, is_anomaly boolean")
    labels = spark.createDataFrame([("s", 7.0, 10.0)], "sensor_id string, fault_start double, fault_end double")
    judged = evaluate.labelled(df, labels, 1.5)
    assert [(r.t, r.point_label, r.window_label) for r in judged.orderBy("t").collect()] == [(6.0, False, False), (7.5, True, False), (9.0, True, True), (10.5, False, True), (12.0, False, False)]
    late = evaluate.latency(judged, ProcessorConfig()).first()
    assert (late.first_detection_t, late.detection_latency_s, late.event_detected) == (9.0, 2.0, True)
    without = evaluate.labelled(df, labels.limit(0), 1.5)
    assert not any(r.point_label or r.window_label for r in without.collect())
    nothing = evaluate.latency(without, ProcessorConfig()).first()
    assert nothing.detection_latency_s is None and nothing.event_detected is False
    with pytest.raises(ValueError):
        evaluate.labelled(df, labels, 1.5, 1.5)


def test_published_detection_figures(spark, sf):
    r = oscillator_report(spark, sf).first()
    assert (r.n_frames, r.raw_tp, r.raw_fp, r.raw_fn, r.raw_tn) == (136, 22, 12, 8, 94)
    assert (r.windowed_tp, r.windowed_fp, r.windowed_fn, r.windowed_tn) == (29, 5, 1, 101)
    assert (round(r.raw_precision, 3), round(r.raw_recall, 3), round(r.windowed_precision, 3), round(r.windowed_recall, 3)) == (0.647, 0.733, 0.853, 0.967)
    assert r.event_detected and round(r.detection_latency_s, 2) == 0.90 and r.latency_reference_s == pytest.approx(1.05)


def test_published_drift_figures(spark):
    rows = {r.detector: (r.caught_fault, r.false_positives, r.healthy_frames) for r in evaluate.drift_tally(drift.drift_features(spark)).collect()}
    assert rows == {"zscore": (True, 176, 360), "ewma": (True, 4, 360), "kalman": (True, 4, 360)}


def test_healthy_sensor_is_quiet_and_all_detectors_find_the_fault(spark):
    config = ProcessorConfig()
    sensors = {"healthy": SensorConfig(duration_s=15.0, seed=1), **DEMO}
    made_ = frames.feature_frames(oscillator.oscillators(spark, sensors), config).cache()
    rows = evaluate.compare(made_, oscillator.labels(spark, sensors), config).collect()
    made_.unpersist()
    for r in rows:
        if r.sensor_id == "demo":
            assert r.event_detected and r.windowed_recall > 0.6 and r.windowed_precision > 0.5
        elif r.detector == "zscore":
            assert r.raw_fp / r.n_frames < 0.05
    assert len(rows) == 6


def test_fault_is_half_open():
    fault = FaultConfig(1.0, 0.5)
    assert fault.contains(1.0) and not fault.contains(1.5) and fault.end_s == 1.5
