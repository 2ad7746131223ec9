"""Watching a folder: each batch of new or changed files leads to one full rebuild."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BINARY_FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
DEBOUNCE = "500 milliseconds"


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length) of files as they appear or change; hidden ones are left out."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("recursiveFileLookup", True).load(folder)
    return stream.select("path", "modificationTime", "length").filter(~F.col("path").rlike(r"/\.[^/]"))


def watch(spark: SparkSession, folder: str, rebuild: Callable[[list[str]], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Call rebuild once for each batch of changes, however many files it has.

    It gets all changed paths, in order; the file source's own list of a batch is on the driver too. With `once`, the stream ends when all that is there has been seen.
    """

    def each(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.select("path").orderBy("path").collect()]
        if paths:
            rebuild(paths)

    writer = changes(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()
