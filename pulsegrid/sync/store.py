"""Where blobs go: transports with two kinds of failure, and the spool that holds blobs until they went."""

from __future__ import annotations

import contextlib
import os
import random
import threading
import time
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TransientUploadError(Exception):
    """May go away; worth another attempt."""


class PermanentUploadError(Exception):
    """Won't go away."""


class Uploader(Protocol):
    def upload(self, key: str, data: bytes) -> None: ...


def failure(status: int | None) -> type[Exception] | None:
    """What an HTTP status means for an upload; None for success. No status at all: the connection failed."""
    if status is None or status == 429 or status >= 500:
        return TransientUploadError
    return PermanentUploadError if status >= 400 else None


class MemoryUploader:
    def __init__(self) -> None:
        self.objects: dict[str, bytes] = {}

    def upload(self, key: str, data: bytes) -> None:
        self.objects[key] = data


class FolderUploader:
    """Writes below a folder that all executors share; a file appears whole or not at all, and a repeat replaces it."""

    def __init__(self, root: str) -> None:
        self.root = root

    def upload(self, key: str, data: bytes) -> None:
        path = os.path.join(self.root, key)
        part = f"{path}.{os.getpid()}.{threading.get_ident()}.tmp"
        try:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, path)
        except OSError as e:
            raise TransientUploadError(str(e)) from e


class FlakyUploader:
    """Fails the first so many attempts, then as a pattern says, over and over, or at random where there is none; for tests."""

    def __init__(self, inner: Uploader, fail_first_n: int = 0, pattern: Sequence[bool] | None = None, fail_prob: float = 0.0, rng: random.Random | None = None) -> None:
        self.inner, self.first, self.pattern, self.share = inner, fail_first_n, list(pattern or ()), fail_prob
        self.rng = rng or random.Random()
        self.attempts = 0

    def upload(self, key: str, data: bytes) -> None:
        k = self.attempts
        self.attempts += 1
        later = k - self.first
        fails = k < self.first or (self.pattern[later % len(self.pattern)] if self.pattern else self.rng.random() < self.share)
        if fails:
            raise TransientUploadError(f"attempt {k} was made to fail")
        self.inner.upload(key, data)


class OutageUploader:
    """Fails during an outage that starts so many seconds after the first use, and at a rate at any time; for demonstrations."""

    def __init__(self, inner: Uploader, start_s: float, duration_s: float, fail_prob: float = 0.0, rng: random.Random | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self.inner, self.outage, self.share = inner, (start_s, start_s + duration_s), fail_prob
        self.rng, self.clock, self.began = rng or random.Random(), clock, None

    def upload(self, key: str, data: bytes) -> None:
        now = self.clock()
        self.began = now if self.began is None else self.began
        if self.outage[0] <= now - self.began < self.outage[1] or self.rng.random() < self.share:
            raise TransientUploadError("made to fail")
        self.inner.upload(key, data)


class Spool:
    """A first-in first-out queue of blobs in a folder, which survives a crash: a blob is one file that was synced under
    another name first. Caps drop the oldest; the newest always stays."""

    END, PART = ".blob", ".tmp"

    def __init__(self, folder: str, fsync: bool = True, max_bytes: int | None = None, max_files: int | None = None) -> None:
        if any(cap is not None and cap < 1 for cap in (max_bytes, max_files)):
            raise ValueError("caps must be positive")
        self.folder, self.fsync, self.max_bytes, self.max_files = folder, fsync, max_bytes, max_files
        self.lock = threading.RLock()
        self.dropped_batches = 0
        os.makedirs(folder, exist_ok=True)
        for name in os.listdir(folder):
            if name.endswith(self.PART):
                self._remove(name)
        names = self._names()
        self.sizes = {n: os.path.getsize(os.path.join(folder, n)) for n in names}
        self.next = int(names[-1].split(".")[0]) + 1 if names else 0

    def _names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if n.endswith(self.END) and n[: -len(self.END)].isdigit())

    def _remove(self, name: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            os.remove(os.path.join(self.folder, name))

    def _sync(self) -> None:
        if self.fsync:
            handle = os.open(self.folder, os.O_RDONLY)
            try:
                os.fsync(handle)
            finally:
                os.close(handle)

    def put(self, data: bytes) -> str:
        with self.lock:
            name = f"{self.next:020d}{self.END}"
            part = os.path.join(self.folder, name + self.PART)
            with open(part, "wb") as f:
                f.write(data)
                f.flush()
                if self.fsync:
                    os.fsync(f.fileno())
            self._make_room(len(data))
            os.replace(part, os.path.join(self.folder, name))
            self._sync()
            self.next += 1
            self.sizes[name] = len(data)
            return name

    def _make_room(self, size: int) -> None:
        def full() -> bool:
            many = self.max_files is not None and len(self.sizes) + 1 > self.max_files
            return many or (self.max_bytes is not None and self.total_bytes + size > self.max_bytes)

        while self.sizes and full():
            self.ack(min(self.sizes))
            self.dropped_batches += 1

    def peek(self) -> tuple[str, bytes] | None:
        with self.lock:
            if not self.sizes:
                return None
            name = min(self.sizes)
            with open(os.path.join(self.folder, name), "rb") as f:
                return name, f.read()

    def ack(self, name: str) -> None:
        """Forgets a blob; again is harmless."""
        with self.lock:
            self._remove(name)
            self.sizes.pop(name, None)
            self._sync()

    @property
    def total_bytes(self) -> int:
        return sum(self.sizes.values())

    def __len__(self) -> int:
        return len(self.sizes)


def stored(spark: SparkSession, root: str) -> DataFrame:
    """path, length of the batches below a folder: the listing, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.ndjson.gz").load(root).select("path", "length")


def read_frames(spark: SparkSession, root: str) -> DataFrame:
    """The frames of all stored batches with their sensor, date and hour (kept as text) from the path; Spark unpacks them."""
    frame = "type string, t double, raw_value double, rms double, mean double, std double, dominant_freq_hz double, is_anomaly boolean, score double"
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(frame).option("recursiveFileLookup", True).option("pathGlobFilter", "*.ndjson.gz").json(root)
    parts = {name: F.regexp_extract(path, f"/{name}=([^/]*)/", 1) for name in ("sensor_id", "date", "hour")}
    more = {"session_id": F.regexp_extract(path, r"/part-(.*)-[0-9]+\.ndjson\.gz$", 1), "batch_seq": F.regexp_extract(path, r"-([0-9]+)\.ndjson\.gz$", 1).cast("long")}
    return rows.withColumns(parts | more).where("type is null").drop("type")


def audit(emitted: DataFrame, kept: DataFrame, session_id: str | None = None) -> DataFrame:
    """frames_emitted, frames_stored, missing: emitted frames, by sensor and time, that no stored batch holds. With
    ``session_id`` only that session's batches are looked at: a folder may hold earlier ones."""
    if session_id is not None:
        kept = kept.where(F.col("session_id") == session_id)
    key = ["sensor_id", "t"]
    missing = emitted.select(*key).exceptAll(kept.select(*key))
    counted = (df.agg(F.count("*").alias(name)) for df, name in ((emitted, "frames_emitted"), (kept, "frames_stored"), (missing, "missing")))
    first, second, third = counted
    return first.join(second).join(third)  # one row each
