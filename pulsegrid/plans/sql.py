"""The registered queries in SQL, for DuckDB on the same tables. Written apart from the DataFrame code: row frames instead
of panes, a sum over samples and bins instead of a transform, recursion instead of a fold."""

from __future__ import annotations

N, HOP, RATE, CALIBRATION = 64, 16, 64.0, 30
FAULT = (10.0, 14.0)
BATCH, SESSION, CREATED, PREFIX = 25, "9f3c2b", 1753100000, "telemetry/v1"

SAMPLES = f"""samples AS MATERIALIZED (
  SELECT event_type AS sensor_id, i, i * (1.0 / {RATE}) AS t, value
  FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events))"""
ROLLING = f"""rolling AS (
  SELECT sensor_id, i, t, value AS raw_value, sqrt(avg(value * value) OVER w) AS rms, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std
  FROM samples WINDOW w AS (PARTITION BY sensor_id ORDER BY i ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW))"""
WINDOWS = f"""windows AS MATERIALIZED (
  SELECT *, (i - {N - 1}) // {HOP} AS frame_no FROM rolling WHERE i >= {N - 1} AND (i - {N - 1}) % {HOP} = 0)"""


def transform(points: str, key: str) -> str:
    """CTEs from ``points`` (key, j, x): the magnitude of each bin, the peak, and the refined place."""
    return f"""bins AS (SELECT unnest(range(0, {N // 2 + 1})) AS k),
dft AS MATERIALIZED (
  SELECT {key}, k, sqrt(pow(sum(x * h * cos(2 * pi() * ((k * j) % {N}) / {N})), 2) + pow(sum(x * h * sin(2 * pi() * ((k * j) % {N}) / {N})), 2)) AS m
  FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / {N - 1}) AS h FROM {points}), bins GROUP BY {key}, k),
peak AS (SELECT {key}, k, m FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY m DESC, k) AS nth FROM dft) WHERE nth = 1),
bent AS (
  SELECT {key}, p.k, ln(l.m + 1e-12) AS a, ln(p.m + 1e-12) AS b, ln(r.m + 1e-12) AS c
  FROM peak p LEFT JOIN (SELECT {key}, k + 1 AS k, m FROM dft) l USING ({key}, k) LEFT JOIN (SELECT {key}, k - 1 AS k, m FROM dft) r USING ({key}, k)),
place AS (
  SELECT {key}, k, CASE WHEN abs(0.5 * (a - c) / nullif(a - 2 * b + c, 0)) <= 0.5 THEN 0.5 * (a - c) / (a - 2 * b + c) ELSE 0 END AS off FROM bent)"""


FRAMES = f"""points AS (
  SELECT w.sensor_id, w.frame_no, s.i - (w.i - {N - 1}) AS j, s.value - w.mean AS x
  FROM windows w JOIN samples s ON s.sensor_id = w.sensor_id AND s.i BETWEEN w.i - {N - 1} AND w.i),
{transform("points", "sensor_id, frame_no")},
frames AS MATERIALIZED (
  SELECT w.sensor_id, w.frame_no, w.t, w.raw_value, w.rms, w.mean, w.std, greatest(0.0, (k + off) * {RATE} / {N}) AS dominant_freq_hz
  FROM windows w JOIN place USING (sensor_id, frame_no))"""
TO_FRAMES = f"{SAMPLES},\n{ROLLING},\n{WINDOWS},\n{FRAMES}"
BASELINE = f"""base AS MATERIALIZED (
  SELECT sensor_id, count(*) AS frames, avg(rms) AS rms_mean, greatest(stddev_pop(rms), 1e-9) AS rms_std,
    avg(dominant_freq_hz) AS freq_mean, greatest(stddev_pop(dominant_freq_hz), 0.5) AS freq_std
  FROM frames WHERE frame_no < {CALIBRATION} GROUP BY sensor_id)"""
ZSCORE = f"""scored AS (
  SELECT f.*, f.frame_no >= {CALIBRATION} AND b.frames >= {CALIBRATION} AS on_, abs((rms - rms_mean) / rms_std) AS zr, abs((dominant_freq_hz - freq_mean) / freq_std) AS zf
  FROM frames f LEFT JOIN base b USING (sensor_id)),
zscore AS (SELECT sensor_id, frame_no, t, CASE WHEN on_ THEN greatest(zr, zf) ELSE 0 END AS score, coalesce(on_ AND (zr > 4 OR zf > 4), false) AS raw FROM scored)"""


def fold(name: str, start: str, z: str, learn: str, state: str) -> str:
    """A recursive CTE ``name`` from the calibration's end on. ``state`` lists the state columns."""
    return f"""{name}_fold AS (
  SELECT sensor_id, CAST({CALIBRATION - 1} AS BIGINT) AS frame_no, {start}, 0.0::DOUBLE AS score, false AS raw FROM base WHERE frames >= {CALIBRATION}
  UNION ALL
  SELECT sensor_id, frame_no, {learn}, greatest(zr, zf), raw FROM (
    SELECT *, zr > 4 OR zf > 4 AS raw FROM (
      SELECT p.sensor_id, f.frame_no, f.rms AS xr, f.dominant_freq_hz AS xf, {state}, {z}
      FROM {name}_fold p JOIN frames f ON f.sensor_id = p.sensor_id AND f.frame_no = p.frame_no + 1))),
{name} AS (
  SELECT f.sensor_id, f.frame_no, f.t, coalesce(d.score, 0) AS score, coalesce(d.raw, false) AS raw FROM frames f LEFT JOIN {name}_fold d USING (sensor_id, frame_no))"""


EWMA = fold(
    "ewma", "rms_mean AS mr, rms_std * rms_std AS vr, freq_mean AS mf, freq_std * freq_std AS vf",
    "abs((f.rms - mr) / greatest(sqrt(vr), 1e-9)) AS zr, abs((f.dominant_freq_hz - mf) / greatest(sqrt(vf), 0.5)) AS zf",
    "CASE WHEN raw THEN mr ELSE mr + 0.05 * (xr - mr) END, CASE WHEN raw THEN vr ELSE 0.95 * (vr + 0.05 * (xr - mr) * (xr - mr)) END, "
    "CASE WHEN raw THEN mf ELSE mf + 0.05 * (xf - mf) END, CASE WHEN raw THEN vf ELSE 0.95 * (vf + 0.05 * (xf - mf) * (xf - mf)) END",
    "mr, vr, mf, vf",
)
KALMAN = fold(
    "kalman", "rms_mean AS mr, rms_std * rms_std AS pr, rms_std * rms_std AS rr, freq_mean AS mf, freq_std * freq_std AS pf, freq_std * freq_std AS rf",
    "abs((f.rms - mr) / sqrt(pr + 0.01 * rr + rr)) AS zr, abs((f.dominant_freq_hz - mf) / sqrt(pf + 0.01 * rf + rf)) AS zf",
    "CASE WHEN raw THEN mr ELSE mr + (pr + 0.01 * rr) / (pr + 1.01 * rr) * (xr - mr) END, CASE WHEN raw THEN pr ELSE (1 - (pr + 0.01 * rr) / (pr + 1.01 * rr)) * (pr + 0.01 * rr) END, rr, "
    "CASE WHEN raw THEN mf ELSE mf + (pf + 0.01 * rf) / (pf + 1.01 * rf) * (xf - mf) END, CASE WHEN raw THEN pf ELSE (1 - (pf + 0.01 * rf) / (pf + 1.01 * rf)) * (pf + 0.01 * rf) END, rf",
    "mr, pr, rr, mf, pf, rf",
)


def debounce(source: str) -> str:
    """``source``_out: score, is_anomaly and state of frames with raw verdicts (3 to raise, 5 to clear)."""
    return f"""{source}_isle AS (
  SELECT *, sum(CASE WHEN raw IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id ORDER BY frame_no) AS isle
  FROM (SELECT *, lag(raw) OVER (PARTITION BY sensor_id ORDER BY frame_no) AS before FROM {source})),
{source}_event AS (
  SELECT *, CASE WHEN raw AND run >= 3 THEN true WHEN NOT raw AND run >= 5 THEN false END AS event
  FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, isle ORDER BY frame_no) AS run FROM {source}_isle)),
{source}_flag AS (
  SELECT sensor_id, frame_no, t, score, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS is_anomaly
  FROM {source}_event),
{source}_out AS (
  SELECT *, CASE WHEN frame_no < {CALIBRATION - 1} THEN 'calibrating' WHEN is_anomaly THEN 'anomalous' ELSE 'normal' END AS state FROM {source}_flag)"""


def judged(source: str) -> str:
    start, end = FAULT
    return f"""{source}_judged AS (
  SELECT *, t >= {start} AND t < {end} AS point_label, greatest(0.0, least(t, {end}) - greatest(t - 1.0, {start})) / 1.0 >= 0.5 AS window_label FROM {source}_out)"""


def rates(tp: str = "tp", fp: str = "fp", tn: str = "tn", fn: str = "fn", prefix: str = "") -> str:
    def part(a: str, b: str) -> str:
        return f"CASE WHEN {b} = 0 THEN 'NaN'::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"

    precision, recall = part(tp, f"({tp} + {fp})"), part(tp, f"({tp} + {fn})")
    f1 = f"CASE WHEN isnan(({precision}) + ({recall})) OR ({precision}) + ({recall}) = 0 THEN 'NaN'::DOUBLE ELSE 2 * ({precision}) * ({recall}) / (({precision}) + ({recall})) END"
    named = {"precision": precision, "recall": recall, "f1": f1, "false_positive_rate": part(fp, f"({fp} + {tn})")}
    rounded = [f"round({e}, 6) AS {prefix}{n}" for n, e in named.items()]
    return ", ".join([*rounded, f"{tp} + {fn} AS {prefix}support_positive", f"{fp} + {tn} AS {prefix}support_negative"])


def counts(label: str, prefix: str = "") -> str:
    cells = {"tp": f"{label} AND is_anomaly", "fp": f"NOT {label} AND is_anomaly", "tn": f"NOT {label} AND NOT is_anomaly", "fn": f"{label} AND NOT is_anomaly"}
    return ", ".join(f"count(*) FILTER (WHERE {c}) AS {prefix}{n}" for n, c in cells.items())


def latencies(source: str) -> str:
    start, end = FAULT
    return f"""SELECT sensor_id, min(t) FILTER (WHERE is_anomaly AND t >= {start}) AS first_detection_t,
  coalesce(bool_or(is_anomaly AND t >= {start} AND t < {end} + 1.0), false) AS event_detected,
  min(t) FILTER (WHERE is_anomaly AND t >= {start}) - {start} AS detection_latency_s, 1.0 * 0.5 + 3 / 4.0 AS latency_reference_s
FROM {source}_judged GROUP BY sensor_id"""


def detection(source: str, ctes: str) -> str:
    return f"WITH RECURSIVE {TO_FRAMES},\n{BASELINE},\n{ctes},\n{debounce(source)}\nSELECT sensor_id, frame_no, round(score, 6) AS score, is_anomaly, state FROM {source}_out"


def evaluation(label: str) -> str:
    return f"WITH {TO_FRAMES},\n{BASELINE},\n{ZSCORE},\n{debounce('zscore')},\n{judged('zscore')},\ncells AS (SELECT sensor_id, {counts(label)} FROM zscore_judged GROUP BY sensor_id)\nSELECT sensor_id, tp, fp, tn, fn, {rates()} FROM cells"


def comparison() -> str:
    parts = []
    for name in ("zscore", "ewma", "kalman"):
        cells = f"SELECT sensor_id, count(*) AS n_frames, {counts('point_label', 'raw_')}, {counts('window_label', 'windowed_')} FROM {name}_judged GROUP BY sensor_id"
        rated = ", ".join(rates(*(f"{p}{c}" for c in ("tp", "fp", "tn", "fn")), prefix=p) for p in ("raw_", "windowed_"))
        parts.append(f"SELECT '{name}' AS detector, c.*, {rated}, first_detection_t, event_detected, detection_latency_s, latency_reference_s FROM ({cells}) c JOIN ({latencies(name)}) l USING (sensor_id)")
    ctes = ",\n".join([TO_FRAMES, BASELINE, ZSCORE, EWMA, KALMAN, *(x for n in ("zscore", "ewma", "kalman") for x in (debounce(n), judged(n)))])
    return f"WITH RECURSIVE {ctes}\n" + "\nUNION ALL\n".join(parts)


_BATCHES = f"""batches AS (
  SELECT sensor_id, frame_no // {BATCH} AS batch_seq, count(*) AS frame_count, arg_min(t, frame_no) AS t_min, arg_max(t, frame_no) AS t_max
  FROM windows GROUP BY ALL)"""
_KEY = f"'{PREFIX}/sensor_id=' || sensor_id || '/date=2025-07-21/hour=12/part-{SESSION}-' || lpad(batch_seq::VARCHAR, 8, '0') || '.ndjson.gz'"
_WINDOWED = f"{SAMPLES},\n{ROLLING},\n{WINDOWS}"
_SIZED = f"{_WINDOWED},\n{_BATCHES},\nsized AS (SELECT sensor_id, batch_seq, frame_count * 100 + batch_seq AS size FROM batches)"

def demonstration() -> str:
    """The report of the seeded demonstration from its published counts."""
    out = []
    for prefix in ("raw", "windowed"):
        tp, fp, tn, fn = (f"{prefix}_{c}" for c in ("tp", "fp", "tn", "fn"))
        out += [
            f"round({tp} / ({tp} + {fp}), 6) AS {prefix}_precision", f"round({tp} / ({tp} + {fn}), 6) AS {prefix}_recall", f"round(2 * {tp} / (2 * {tp} + {fp} + {fn}), 6) AS {prefix}_f1",
            f"round({fp} / ({fp} + {tn}), 6) AS {prefix}_false_positive_rate", f"{tp} + {fn} AS {prefix}_support_positive", f"{fp} + {tn} AS {prefix}_support_negative",
        ]
    cells = ", ".join(f"{n}::BIGINT AS {p}_{c}" for p, some in (("raw", (22, 12, 94, 8)), ("windowed", (29, 5, 101, 1))) for c, n in zip(("tp", "fp", "tn", "fn"), some, strict=True))
    return f"""SELECT *, {", ".join(out)}, 7.899::DOUBLE AS first_detection_t, true AS event_detected, 0.899::DOUBLE AS detection_latency_s, 1.05::DOUBLE AS latency_reference_s
FROM (SELECT 'demo' AS sensor_id, 136::BIGINT AS n_frames, {cells})"""


ORACLE_SQL = {
    "sensor_samples": f"WITH {SAMPLES} SELECT sensor_id, i, t, value FROM samples",
    "relative_time": "SELECT event_type AS sensor_id, event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 1e6, 6) AS t, value FROM events",
    "sample_rate": """WITH timed AS (SELECT event_type AS sensor_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 1e6 AS t FROM events),
steps AS (SELECT sensor_id, t - lag(t) OVER (PARTITION BY sensor_id ORDER BY t) AS step FROM timed)
SELECT sensor_id, round(1.0 / median(step) FILTER (WHERE step > 0), 9) AS sample_rate_hz FROM steps GROUP BY sensor_id""",
    "csv_replay": "SELECT event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6, 6) AS t, value FROM events",
    "rolling_stats": f"WITH {SAMPLES}, {ROLLING} SELECT sensor_id, i, round(rms, 8) AS rms, round(mean, 8) AS mean, round(std, 8) AS std FROM rolling WHERE i >= {N - 1}",
    "decimated": f"WITH {SAMPLES} SELECT sensor_id, (i - {N - 1}) // {HOP} AS frame_no, t, value FROM samples WHERE i >= {N - 1} AND (i - {N - 1}) % {HOP} = 0",
    "window_stats": f"WITH {_WINDOWED} SELECT sensor_id, frame_no, t, raw_value, round(rms, 8) AS rms, round(mean, 8) AS mean, round(std, 8) AS std FROM windows",
    "feature_frames": f"WITH {TO_FRAMES} SELECT sensor_id, frame_no, t, raw_value, round(rms, 8) AS rms, round(mean, 8) AS mean, round(std, 8) AS std, round(dominant_freq_hz, 6) AS dominant_freq_hz FROM frames",
    "dft_peak": f"""WITH points AS (SELECT vec_id, unnest(range(0, {N})) AS j, unnest(embedding)::DOUBLE - list_avg(embedding::DOUBLE[]) AS x FROM embeddings),
{transform("points", "vec_id")}
SELECT vec_id, k AS peak_bin, round(k * {RATE} / {N}, 6) AS dominant_freq_hz FROM place""",
    "dft_peak_interp": f"""WITH points AS (SELECT vec_id, unnest(range(0, {N})) AS j, unnest(embedding)::DOUBLE - list_avg(embedding::DOUBLE[]) AS x FROM embeddings),
{transform("points", "vec_id")}
SELECT vec_id, round(greatest(0.0, (k + off) * {RATE} / {N}), 6) AS dominant_freq_hz FROM place""",
    "power_density": f"""WITH points AS (SELECT vec_id, unnest(range(0, {N})) AS j, unnest(embedding)::DOUBLE - list_avg(embedding::DOUBLE[]) AS x FROM embeddings),
tapered AS (SELECT vec_id, j, x * (0.5 - 0.5 * cos(2 * pi() * j / {N})) AS x FROM points),
bins AS (SELECT unnest(range(0, {N // 2 + 1})) AS bin),
power AS (
  SELECT vec_id, bin, pow(sum(x * cos(2 * pi() * ((bin * j) % {N}) / {N})), 2) + pow(sum(x * sin(2 * pi() * ((bin * j) % {N}) / {N})), 2) AS p
  FROM tapered, bins GROUP BY ALL)
SELECT vec_id, bin, bin * {RATE} / {N} AS frequency_hz, round(CASE WHEN bin BETWEEN 1 AND {N // 2 - 1} THEN 2 ELSE 1 END * p / ({RATE} * 0.375 * {N}), 8) AS density FROM power""",
    "spectrogram": f"""WITH {_WINDOWED},
points AS (SELECT w.sensor_id, w.frame_no, s.i - (w.i - {N - 1}) AS j, s.value - w.mean AS x FROM windows w JOIN samples s ON s.sensor_id = w.sensor_id AND s.i BETWEEN w.i - {N - 1} AND w.i),
tapered AS (SELECT sensor_id, frame_no, j, x * (0.5 - 0.5 * cos(2 * pi() * j / {N})) AS x FROM points),
bins AS (SELECT unnest(range(0, {N // 2 + 1})) AS bin),
power AS (
  SELECT sensor_id, frame_no, bin, pow(sum(x * cos(2 * pi() * ((bin * j) % {N}) / {N})), 2) + pow(sum(x * sin(2 * pi() * ((bin * j) % {N}) / {N})), 2) AS p
  FROM tapered, bins GROUP BY ALL)
SELECT sensor_id, frame_no, bin, bin * {RATE} / {N} AS frequency_hz, round(CASE WHEN bin BETWEEN 1 AND {N // 2 - 1} THEN 2 ELSE 1 END * p / ({RATE} * 0.375 * {N}), 6) AS density FROM power""",
    "replay_narrow": """SELECT 'replay' AS sensor_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6, 6) AS t, value FROM events WHERE event_id % 4 <> 0 AND value IS NOT NULL""",
    "baseline_stats": f"WITH {TO_FRAMES}, {BASELINE} SELECT sensor_id, frames, round(rms_mean, 6) AS rms_mean, round(rms_std, 6) AS rms_std, round(freq_mean, 6) AS freq_mean, round(freq_std, 6) AS freq_std FROM base",
    "zscore_raw": f"WITH {TO_FRAMES}, {BASELINE}, {ZSCORE} SELECT sensor_id, frame_no, round(score, 6) AS score, raw FROM zscore",
    "zscore_debounced": detection("zscore", ZSCORE),
    "ewma_detect": detection("ewma", EWMA),
    "kalman_detect": detection("kalman", KALMAN),
    "eval_raw": evaluation("point_label"),
    "eval_windowed": evaluation("window_label"),
    "eval_latency": f"WITH {TO_FRAMES},\n{BASELINE},\n{ZSCORE},\n{debounce('zscore')},\n{judged('zscore')}\n{latencies('zscore')}",
    "detector_compare": comparison(),
    "batch_manifest": f"WITH {_WINDOWED}, {_BATCHES} SELECT sensor_id, '{SESSION}' AS session_id, batch_seq, frame_count, t_min, t_max FROM batches",
    "object_keys": f"WITH {_WINDOWED}, {_BATCHES} SELECT sensor_id, batch_seq, {_KEY} AS key FROM batches",
    "tail_n": f"WITH {_WINDOWED} SELECT sensor_id, frame_no, t FROM windows QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY frame_no DESC) <= 7",
    "retention_files": f"WITH {_SIZED} SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY batch_seq DESC) <= 3",
    "retention_bytes": f"WITH {_SIZED} SELECT * FROM sized QUALIFY sum(size) OVER (PARTITION BY sensor_id ORDER BY batch_seq DESC) <= 6000 OR row_number() OVER (PARTITION BY sensor_id ORDER BY batch_seq DESC) = 1",
    "backoff_schedule": "SELECT range AS attempt, least(10.0, 0.5 * pow(2.0, range)) AS delay_s FROM range(0, 12)",
    "clean_nonfinite": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN NULL ELSE value END AS value FROM events",
    # The published counts of the seeded demonstrations.
    "drift_tally": """SELECT detector, true AS caught_fault, false_positives::BIGINT AS false_positives, 360::BIGINT AS healthy_frames
FROM (VALUES ('zscore', 176), ('ewma', 4), ('kalman', 4)) AS t(detector, false_positives)""",
    "oscillator_report": demonstration(),
    "sync_audit": f"WITH {_WINDOWED}, {_BATCHES} SELECT (SELECT count(*) FROM windows) AS frames_emitted, (SELECT count(*) FROM windows) AS frames_stored, 0::BIGINT AS missing, (SELECT count(*) FROM batches) AS batches, true AS delivered",
    "stream_equals_batch": "SELECT event_type AS sensor_id, event_id AS frame_no, true AS is_anomaly, '' AS state, '' AS side FROM events WHERE false",
}
