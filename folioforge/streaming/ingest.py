"""Documents that arrive as files: chunked as a stream and appended to a chunk table.

Chunking is stateless per document.  Word statistics of the whole corpus change with every
batch, so the lexical index is rebuilt from the chunk table, not kept as stream state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def chunk_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], schema: str = "doc_id string, text string") -> StreamingQuery:
    """Read JSON lines from ``source`` as they come and append their chunks to ``sink``.

    Each micro-batch goes to a folder of its own number, so a repeated batch replaces its
    earlier try and no chunk appears twice.
    """
    rows = spark.readStream.schema(schema).json(source)

    def write(batch: DataFrame, number: int) -> None:
        chunk(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of a stream of (ts, event_type, value) per window, late rows up to ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
