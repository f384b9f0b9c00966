"""Continuous ingest: a JSON folder becomes visible in the document log batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docsieve import schema
from docsieve.sources.store import append


def stream_json(spark: SparkSession, source: str, log: str, checkpoint: str, every: str | None = "1 second", *dynamic: str) -> StreamingQuery:
    """Append each micro-batch to the log; ``every`` None takes what is there and ends.

    A batch is known by its number and by the name that its stream has in the checkpoint, so a replayed one is not there twice,
    and a stream with a new checkpoint is a new source whose batches follow those that are there."""

    def commit(batch: DataFrame, number: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        append(batch, log, stream, number)

    reading = spark.readStream.schema(schema.struct(*dynamic)).option("multiLine", True).json(source)
    writing = reading.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writing.trigger(processingTime=every) if every else writing.trigger(availableNow=True)).start()
