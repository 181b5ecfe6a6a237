"""Answering requests as they arrive: a stream of slice requests joined with a stored volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.volume import Volume


def serve(requests: DataFrame, volume: Volume, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the slices that a stream (axis, type, seq, index) asks for, each micro-batch as one batch read.

    A micro-batch goes to a folder of its own number and replaces it if it is run again, so each request is
    answered exactly once.
    """

    def answer(rows: DataFrame, number: int) -> None:
        volume.batch(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
