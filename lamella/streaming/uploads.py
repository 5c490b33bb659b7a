"""Examinations that arrive as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamella.operators import store
from lamella.sources import ledgers


def image_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New files in a folder: path, name, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "length", "content")


def exam_stream(spark: SparkSession, path: str) -> DataFrame:
    """Saved examinations as they arrive, as JSON lines."""
    spec = " ".join(f"{c}:{'l' if c in store.COUNTS else 's'}" for c in store.COLUMNS)
    return spark.readStream.schema(ledgers.schema(spec)).json(path)


def append_exams(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving examinations to the store, each batch once even if it is tried again: its rows are written to a folder of its own.

    Readers take the latest row of a key (:func:`lamella.operators.store.current`), so an arrival replaces what was saved before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*store.COLUMNS).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Number of rows of each kind in windows of time; rows later than ``late`` are not waited for."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
