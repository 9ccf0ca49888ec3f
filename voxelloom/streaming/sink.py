"""Sink for micro-batches that may be replayed: one folder per batch, overwritten on a retry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
                  transform=None, once: bool = True) -> StreamingQuery:
    """Writes every micro-batch to ``path/batch=n``, optionally transformed by an ordinary batch job first."""
    def save(batch: DataFrame, epoch: int) -> None:
        out = batch if transform is None else transform(batch)
        out.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", batch bigint").parquet(path)
