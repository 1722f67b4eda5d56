"""The batch plans over a stream: each micro-batch of questions is answered as one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answered(questions: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes plan(batch) of every micro-batch of the stream `questions` as Parquet under path/batch=N.

    The batch number names its folder, so a batch that runs again after a failure replaces what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
