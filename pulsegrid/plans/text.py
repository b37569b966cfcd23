"""Reports as text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Row


def share(x: float | None) -> str:
    return "n/a" if x is None or x != x else f"{x:.3f}"


def seconds(x: float | None) -> str:
    return "none" if x is None else f"{x:.2f} s"


def table(head: list[str], rows: Iterable[list[str]]) -> str:
    lines = [head, *rows]
    width = [max(len(line[k]) for line in lines) for k in range(len(head))]
    return "\n".join("  ".join(cell.ljust(w) if k == 0 else cell.rjust(w) for k, (cell, w) in enumerate(zip(line, width, strict=True))) for line in lines)


def summary(report: Row) -> str:
    """One sensor's report: both views' counts and rates, then the event."""
    views = [
        [name, *(str(report[f"{p}{c}"]) for c in ("tp", "fp", "fn", "tn")), *(share(report[f"{p}{r}"]) for r in ("precision", "recall", "f1", "false_positive_rate"))]
        for name, p in (("point label", "raw_"), ("window label", "windowed_"))
    ]
    head = [f"{report.n_frames} frames", "TP", "FP", "FN", "TN", "precision", "recall", "F1", "FPR"]
    found = "detected" if report.event_detected else "not detected"
    return f"{report.sensor_id}\n{table(head, views)}\nEvent {found}; latency {seconds(report.detection_latency_s)}, reference {seconds(report.latency_reference_s)}"


def comparison(reports: Iterable[Row]) -> str:
    head = ["detector", "sensor", "event", "latency", "precision", "recall", "F1", "FPR"]
    rows = [
        [r.detector, r.sensor_id, "yes" if r.event_detected else "no", seconds(r.detection_latency_s), *(share(r[f"windowed_{n}"]) for n in ("precision", "recall", "f1", "false_positive_rate"))]
        for r in reports
    ]
    return table(head, rows)


def drift(tally: Iterable[Row]) -> str:
    return table(["detector", "caught fault", "false positives"], [[r.detector, "yes" if r.caught_fault else "no", f"{r.false_positives}/{r.healthy_frames}"] for r in tally])


def audit(row: Row) -> str:
    verdict = "no frame is missing" if row.missing == 0 else f"{row.missing} frames are missing"
    return f"{row.frames_emitted} frames emitted, {row.frames_stored} stored: {verdict}"
