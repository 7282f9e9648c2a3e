"""Replay of a log through Structured Streaming: the batch filter's rows, read as a stream to its end."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from strandlog.operators.reads import select_log
from strandlog.scratch import scratch_path


def replay(log: DataFrame, options: Mapping[str, Any]) -> DataFrame:
    """Write ``log`` as a stream's source, read it with availableNow under the options' filters, return what arrived."""
    spark = log.sparkSession
    source, sink, checkpoint = (scratch_path(spark, f"replay-{x}") for x in ("source", "sink", "checkpoint"))
    log.write.parquet(source)
    stream = select_log(spark.readStream.schema(log.schema).parquet(source), options)
    run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(log.schema).parquet(sink)
