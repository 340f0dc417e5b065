"""Running a streaming query over what has arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def process_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand every batch that has arrived since the last run to ``handle``, then stop.

    The checkpoint remembers what has been processed. A batch interrupted half
    way is handed over again under its number, so ``handle`` writes under that
    number and the outcome is the same as if it had run once.
    """
    started = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
