"""A streaming query that delivers frames in batches. The checkpoint takes the spool's place: a micro-batch that fails
is run again with the same number, and so writes the same keys."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.config import BackoffConfig
from pulsegrid.sync.sink import deliver
from pulsegrid.sync.store import Uploader


def committer(uploader: Uploader, session_id: str, started_at_utc: float, batch_frames: int, prefix: str, config: BackoffConfig | None) -> Callable[[DataFrame, int], None]:
    def commit(frames: DataFrame, batch_id: int) -> None:
        # the session's start and the batch's number make the key, neither of which a retry changes
        sent = deliver(frames, uploader, f"{session_id}-{batch_id:06d}", started_at_utc, batch_frames, prefix, config)
        lost = F.when(~F.col("delivered"), F.col("key"))
        n, first = sent.agg(F.count(lost), F.min(lost)).first()
        if n:
            raise RuntimeError(f"{n} batches could not be delivered, the first is {first}")

    return commit


def start(frames: DataFrame, uploader: Uploader, checkpoint: str, session_id: str, started_at_utc: float | None = None, batch_frames: int = 100, prefix: str = "telemetry/v1", config: BackoffConfig | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts delivery. ``session_id`` and ``started_at_utc`` must be kept with the checkpoint: a restart goes on with them."""
    commit = committer(uploader, session_id, time.time() if started_at_utc is None else started_at_utc, batch_frames, prefix, config)
    return frames.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def close(query: StreamingQuery, drain: bool = True) -> None:
    if drain:
        query.processAllAvailable()
    query.stop()
