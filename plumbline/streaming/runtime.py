"""Reading, running and storing streams.

Outputs are written per micro-batch into a folder named by the batch id, and a
repeated batch overwrites its own folder. Together with the checkpoint this
keeps results whole when executors or the driver are lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from plumbline.sources.tables import read_or_none

BATCH = "batch"


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream, with the schema of the table.

    The table may be one file. A file source takes only folders or patterns, so
    a path that names a file is turned into a pattern that matches just it.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if path.endswith(".parquet"):
        path = f"{path[:-1]}[{path[-1]}]"
    return reader.parquet(path)


def write_batch(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{BATCH}={batch_id}")


def read_batch(spark: SparkSession, root: str, batch_id: int) -> DataFrame | None:
    """What one batch wrote, from its own folder; None if it wrote nothing. No other folder is looked at."""
    return read_or_none(spark, f"{root}/{BATCH}={batch_id}")


def use_rocksdb(spark: SparkSession) -> None:
    """State that is kept as lists and timers needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def drain(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything that is available, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_files(stream: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Append to files (exactly once)."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", root).option(
        "checkpointLocation", checkpoint
    )
