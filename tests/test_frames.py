import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.config import ProcessorConfig
from pulsegrid.functions import spectrum
from pulsegrid.operators import frames


def numbered(spark, values, sensor="s", rate=1.0):
    return spark.createDataFrame([(sensor, i, i / rate, float(v)) for i, v in enumerate(values)], "sensor_id string, i long, t double, value double")


def config(n, hop, rate=1.0):
    return ProcessorConfig(sample_rate_hz=rate, window_s=n / rate, hop_s=hop / rate)


@pytest.mark.parametrize(("n", "hop"), [(100, 10), (64, 16), (30, 45), (137, 9), (12, 12), (60, 25)])
def test_panes_equal_numpy_at_a_large_offset(spark, n, hop):
    draw = np.random.default_rng(n)
    values = 1500 + draw.normal(size=400)
    rows = frames.window_stats(numbered(spark, values), config(n, hop)).orderBy("frame_no").collect()
    ends = range(n - 1, 400, hop)
    assert [r.frame_no for r in rows] == list(range(len(ends)))
    for r, end in zip(rows, ends, strict=True):
        w = values[end - n + 1 : end + 1]
        assert r.t == end and r.raw_value == values[end]
        assert [r.rms, r.mean, r.std] == pytest.approx([np.sqrt((w * w).mean()), w.mean(), w.std()], rel=1e-9)


@pytest.mark.parametrize("block", [1, 3, 10**6])
def test_blocks_change_nothing(spark, monkeypatch, block):
    df = numbered(spark, np.random.default_rng(5).normal(size=700)).unionByName(numbered(spark, range(90), "r"))

    def made():
        panes = frames.feature_frames(df, config(20, 4)).select("sensor_id", "frame_no", "t", F.round("std", 9), F.round("dominant_freq_hz", 9)).collect()
        rows = frames.row_windows(df, 7, 3, True).select("sensor_id", "frame_no", F.round("rms", 9), F.size("window")).collect()
        return sorted(panes), sorted(rows), sorted(frames.rolling_stats(df, 9).select("sensor_id", "i", F.round("std", 9)).collect())

    whole = made()
    monkeypatch.setattr(frames, "PANE_BLOCK", block)
    monkeypatch.setattr(frames, "SAMPLE_BLOCK", block)
    assert made() == whole and [len(x) for x in whole] == [171 + 18, 232 + 28, 692 + 82]


def test_row_frame_equals_panes(spark):
    df = numbered(spark, np.random.default_rng(2).normal(size=300))
    a, b = (sorted(map(tuple, f(df, 50, 10, False).select("frame_no", F.round("rms", 9), F.round("std", 9)).collect())) for f in (frames.pane_windows, frames.row_windows))
    assert a == b


def test_no_partial_window_and_the_first_frame(spark):
    assert frames.window_stats(numbered(spark, range(99)), config(100, 50)).count() == 0
    rows = frames.feature_frames(numbered(spark, range(200), rate=1000.0), config(100, 50, 1000.0)).orderBy("t").collect()
    assert [round(r.t * 1000) for r in rows] == [99, 149, 199]


def test_frames_do_not_look_ahead(spark):
    values = np.random.default_rng(3).normal(size=600)
    made = [frames.feature_frames(numbered(spark, v), config(100, 20)).orderBy("frame_no").collect() for v in (values[:400], values)]
    assert len(made[0]) == 16
    for a, b in zip(*made, strict=False):  # partial sums may be added in another order
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-12)


def test_rolling_and_decimated(spark):
    df = numbered(spark, [1, 2, 3, 4])
    assert [(r.i, r.mean) for r in frames.rolling_stats(df, 3).orderBy("i").collect()] == [(2, 2.0), (3, 3.0)]
    assert [(r.i, r.frame_no) for r in frames.decimated(numbered(spark, range(10)), 4, 3).orderBy("i").collect()] == [(3, 0), (6, 1), (9, 2)]


def tone(f, n=1500, rate=1000.0, offset=0.0):
    return offset + 2.0 * np.sin(2 * np.pi * f * np.arange(n) / rate)


def test_peak_of_tones():
    windows = np.stack([tone(50), tone(50, offset=1500), tone(50.3)])
    fine, coarse = (spectrum.dominant_frequencies(windows, 1000.0, interpolate=i) for i in (True, False))
    assert np.abs(fine - [50, 50, 50.3]).max() < 0.05 and abs(fine[2] - 50.3) < abs(coarse[2] - 50.3)
    assert spectrum.dominant_frequencies(np.full((1, 64), np.nan), 64.0)[0] == 0.0
    assert spectrum.dominant_frequencies(np.zeros((1, 64)), 64.0)[0] == 0.0


def test_sums_equal_the_transform(spark):
    draw = np.random.default_rng(4)
    rows = [(k, draw.normal(size=32).tolist()) for k in range(20)]
    df = spark.createDataFrame(rows, "key long, window array<double>")
    by_sum = spectrum.peak_sql(spectrum.spectrum_sql(df, "key", "window", 32), "key", 32, 32.0)
    got = {r.key: r.dominant_freq_hz for r in by_sum.collect()}
    want = spectrum.dominant_frequencies(np.array([w for _, w in rows]), 32.0)
    assert [got[k] for k in range(20)] == pytest.approx(want.tolist(), abs=1e-9)


def test_empty_windows_have_no_frequency(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1.0, 2.0, 1.0, 0.0])], "key long, window array<double>")
    got = {r.key: r.f for r in df.select("key", spectrum.dominant_frequency(F.col("window"), 4.0).alias("f")).collect()}
    assert got[1] is None and got[2] is None and got[3] is not None


def test_lengths_round_half_to_even():
    assert ProcessorConfig(sample_rate_hz=1.0, window_s=6.5, hop_s=2.5).window_samples == 6
    assert ProcessorConfig(sample_rate_hz=1.0, window_s=6.5, hop_s=2.5).hop_samples == 2
    assert ProcessorConfig(sample_rate_hz=1.0, window_s=8, hop_s=0.1).hop_samples == 1


def test_power_density_holds_the_variance(spark):
    draw = np.random.default_rng(6)
    values = draw.normal(scale=2.0, size=4096)
    rows = spectrum.density(values, 100.0, 256)
    assert sum(r["density"] for r in rows) * 100.0 / 256 == pytest.approx(4.0, rel=0.1)
    made = spectrum.spectrogram(numbered(spark, tone(50), rate=1000.0), 500, 500, 1000.0)
    for r in made.collect():
        assert max(r.density, key=lambda d: d.density).frequency_hz == 50.0
