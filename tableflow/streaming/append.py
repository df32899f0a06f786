"""Checkpointed append streams and bounded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

# --- Fixed value: default trigger ----------------------------------------------------------
DEFAULT_TRIGGER = "10 seconds"
# -------------------------------------------------------------------------------------------


def start_append(
    df: DataFrame,
    path: str,
    checkpoint: str,
    *,
    trigger: str = DEFAULT_TRIGGER,
    available_now: bool = False,
    fmt: str = "parquet",
    partition_by: str | None = None,
) -> StreamingQuery:
    """Start an append stream. Checkpoint and file sink log together give each row once.

    ``available_now`` works off what is there, in several batches if needed, and stops; use it
    for backfills. Otherwise a batch starts every ``trigger``.
    """
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    when = {"availableNow": True} if available_now else {"processingTime": trigger}
    return writer.trigger(**when).start(path)


def run_bounded(query: StreamingQuery, seconds: float) -> bool:
    """Let a query run for at most ``seconds``, then stop it. True if it ended by itself.

    For runs that are meant to stop early. A failed query raises its error. Stopping between batches
    loses nothing: a batch that was not committed is repeated on the next start with the same
    checkpoint.
    """
    try:
        return bool(query.awaitTermination(seconds))
    finally:
        query.stop()


def run_to_end(query: StreamingQuery, seconds: float | None = None) -> None:
    """Wait until an ``available_now`` query has worked off what is there.

    A failed query raises its error. With a limit, a query that has not ended by then is stopped and
    this raises, so that a partial table is never taken for a complete one.
    """
    if seconds is None:
        query.awaitTermination()
    elif not run_bounded(query, seconds):
        raise TimeoutError(f"The stream did not end within {seconds} seconds; its output is partial")
