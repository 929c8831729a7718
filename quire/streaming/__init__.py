"""Row-wise operators over streams.

The column functions and type_blocks(), classify_text() and is_noise() need no state, so they run
unchanged on a streaming DataFrame; windows over whole documents do not, and are applied to each
micro-batch of whole documents instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def per_document(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to each micro-batch and write Parquet under path, a folder for each batch.

    A batch that is run again after a failure overwrites its own folder. Documents must not be
    spread over batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
