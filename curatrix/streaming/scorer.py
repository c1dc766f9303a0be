"""The stateless request scorer as a stream: requests in, error codes or decisions out. It keeps no state, so it needs no watermark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from curatrix.operators.policies import respond


def score_stream(requests: DataFrame, payload: str, **settings) -> DataFrame:
    """A streaming DataFrame of requests scored row by row."""
    return respond(requests, payload, **settings)


def run_available(spark: SparkSession, source: str, schema: str, payload: str, sink: str, checkpoint: str, settings: Mapping[str, object]) -> StreamingQuery:
    """Scores all files that are there now and appends Parquet; run again, it takes up what is new, exactly once."""
    stream = spark.readStream.schema(schema).parquet(source)
    out = score_stream(stream, payload, **settings)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
