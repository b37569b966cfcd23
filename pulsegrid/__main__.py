"""python -m pulsegrid report | compare | sync | bench: the demonstrations, on a local session."""

from __future__ import annotations

import argparse
import random
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pulsegrid.config import BackoffConfig, DetectorConfig, FaultConfig, ProcessorConfig, SensorConfig
from pulsegrid.operators import detect, evaluate, frames
from pulsegrid.plans import text
from pulsegrid.ship import ship
from pulsegrid.sources import drift, oscillator
from pulsegrid.sync import sink, store


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="python -m pulsegrid", description=__doc__)
    parser.add_argument("what", choices=("report", "compare", "sync", "bench"))
    parser.add_argument("--duration", type=float, default=15.0, help="seconds")
    parser.add_argument("--rate", type=float, default=1000.0, help="samples a second")
    parser.add_argument("--sensors", type=int, default=1)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--fault-start", type=float, default=7.0)
    parser.add_argument("--fault-duration", type=float, default=3.0)
    parser.add_argument("--fault-omega", type=float, default=0.7, help="factor of the natural frequency")
    parser.add_argument("--fault-zeta", type=float, default=0.4, help="factor of the damping")
    parser.add_argument("--k", type=float, default=4.0, help="threshold in standard deviations")
    parser.add_argument("--batch-frames", type=int, default=100)
    parser.add_argument("--failure-rate", type=float, default=0.3, help="of uploads, in sync")
    parser.add_argument("--master", default="local[*]")
    return parser.parse_args()


def main() -> None:
    args = arguments()
    spark = SparkSession.builder.master(args.master).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    fault = FaultConfig(args.fault_start, args.fault_duration, args.fault_omega, args.fault_zeta)
    sensors = {f"sensor-{n}": SensorConfig(sample_rate_hz=args.rate, seed=args.seed + n, duration_s=args.duration, fault=fault) for n in range(args.sensors)}
    config = ProcessorConfig(sample_rate_hz=args.rate, detector=DetectorConfig(k=args.k))
    samples, labels = oscillator.oscillators(spark, sensors), oscillator.labels(spark, sensors)
    if args.what == "bench":
        samples = samples.cache()
        n = samples.count()
        for _ in range(2):
            began = time.perf_counter()
            detect.zscore(frames.feature_frames(samples, config), config.detector).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
        print(f"{n} samples in {took:.2f} s: {n / took:,.0f} a second, {n / took / args.rate:.0f} x real time, {1e6 * took / n:.2f} us a sample")
        return
    made = frames.feature_frames(samples, config).cache()
    if args.what == "report":
        judged = evaluate.labelled(detect.zscore(made, config.detector), labels, config.window_s)
        print("\n\n".join(map(text.summary, evaluate.report(judged, config).orderBy("sensor_id").collect())))
    elif args.what == "compare":
        print(text.comparison(evaluate.compare(made, labels, config, k=args.k).orderBy("sensor_id", "detector").collect()))
        print("\nHarmless drift with one fault:\n" + text.drift(evaluate.drift_tally(drift.drift_features(spark)).collect()))
    else:
        root = tempfile.mkdtemp(prefix="pulsegrid-sync-")
        uploader = store.FlakyUploader(store.FolderUploader(root), fail_prob=args.failure_rate, rng=random.Random(args.seed))
        found = detect.zscore(made, config.detector)
        sent = sink.deliver(found, uploader, "demo", time.time(), args.batch_frames, config=BackoffConfig(base_s=0.05, max_s=0.5)).cache()
        total = sent.agg(F.count("*").alias("n"), F.sum("raw_bytes").alias("raw"), F.sum("stored_bytes").alias("stored"), F.sum(F.col("attempts") - 1).alias("failed")).first()
        print(f"{total.n} batches in {root}, {total.failed} attempts failed; {total.stored} bytes stored, {total.raw / total.stored:.2f} times smaller")
        print(text.audit(store.audit(found, store.read_frames(spark, root)).first()))


if __name__ == "__main__":
    main()
