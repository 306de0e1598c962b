"""Incremental ingest as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Rows of files that come into a folder, each once."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def ingest(rows: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there and ends; a later call with the same checkpoint goes on after it.

    Batches are written under their number, so one that is run again replaces its own files.
    """

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    return rows.writeStream.foreachBatch(lambda b, n: write(b, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
