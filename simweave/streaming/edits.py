"""Streams of document edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def real_edits(events: DataFrame, root: str | None = None) -> DataFrame:
    """Edits (file_path, ts, changes) that name a file, change something and, if given, lie below ``root``."""
    out = events.where(F.col("file_path").isNotNull() & (F.col("changes") > 0))
    return out.where(F.startswith(F.col("file_path"), F.lit(root.rstrip("/") + "/"))) if root else out


def debounced(events: DataFrame, key: str, quiet: str = "500 milliseconds", late: str | None = None) -> DataFrame:
    """(key, session, edits): a row once a key has been quiet for so long. On a stream, ``late`` sets the watermark."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(key, F.session_window("ts", quiet).alias("session")).agg(F.count("*").alias("edits"))


def refresh_on_edits(events: DataFrame, refresh: Callable[[DataFrame], None], checkpoint: str, quiet: str = "500 milliseconds", late: str = "10 seconds", every: str | None = None):
    """Call ``refresh`` with the distinct dirty paths of every batch of finished sessions, one batch at a time.

    Without ``every`` it stops when all that is there has been read; with it, it goes on in such steps.
    """

    def run(batch: DataFrame, _: int) -> None:
        paths = batch.select("file_path").distinct()
        if not paths.isEmpty():
            refresh(paths)

    return debounced(events, "file_path", quiet, late).writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
