"""What a session needs: the library on its executors, and tables in the folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship_library(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application.

    Without it, workers only find the package where the driver's folders are on their path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="loomgraph-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local runs.

    Raises RuntimeError on a cluster whose session does not name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{os.path.join(tempfile.gettempdir(), 'loomgraph-checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_WRITTEN = threading.local()  # the tables that each thread has written and not deleted
_SCRATCH: set[str] = set()


def _scratch_folder(spark: SparkSession) -> str:
    """This application's folder of intermediate tables; it is deleted when the application ends."""
    where = f"{shared_folder(spark)}/loomgraph-{spark.sparkContext.applicationId}"
    if where not in _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _SCRATCH.add(where)
    return where


def _written() -> list[str]:
    if not hasattr(_WRITTEN, "paths"):
        _WRITTEN.paths = []
    return _WRITTEN.paths


def materialize(df: DataFrame, passing: bool = True) -> DataFrame:
    """Write a frame as a table in the shared folder and read it again.

    This cuts the lineage, and what a lost executor had computed is not computed anew. A table that
    is not passing stays until the application ends, whatever is settled around it.
    """
    spark = df.sparkSession
    path = f"{_scratch_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if passing:
        _written().append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], replaces: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """What `make` returns, written as a table; and its place, for a later call to name in `replaces`.

    The tables that this thread wrote on the way, and those that are replaced, are deleted:
    nothing reads them any more. All others go when the application ends.
    """
    before = len(_written())
    found = materialize(make())
    *passing, place = _written()[before:]
    for where in passing + (replaces or []):
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _written().remove(where)
    return found, [place]


#: How many rows a task should sort or join at most; some hundred bytes each.
ROWS_OF_A_TASK = 500_000


def dealt_out(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by keys to as many tasks as this number of rows needs, or as the session asks for, if that is more.

    So a task's memory doesn't grow with the input where a session has a fixed number of shuffle partitions. What is
    joined to it or grouped by the keys follows.
    """
    tasks = _tasks(df.sparkSession, rows)
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def _tasks(spark: SparkSession, rows: int) -> int | None:
    tasks = -(-rows // ROWS_OF_A_TASK)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def join_uneven(rows: DataFrame, table: DataFrame, key: str, times: str, total: int, few: int = 0) -> DataFrame:
    """Rows joined to a table with one row for each key; `times` holds at least how many rows have the key, `total` all of them.

    At most a thousand keys can have more than a thousandth of all rows each: these meet the rows by
    broadcast, so that no key's rows gather in one task. The others are joined as usual, and so are all
    if there are at most `few` rows.
    """
    if total <= few:
        return rows.join(table, key)
    many = total // 1000
    hot = table.filter(F.col(times) > many)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col(times) <= many), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def dense_ids(df: DataFrame, order: list[str], name: str, first: int) -> DataFrame:
    """Number rows first, first + 1, ... in the given order, without gaps and without one task that sees all rows.

    Rows are sorted by range, so a row's id is the number of rows in the partitions before
    its own plus its place there; only one count per partition reaches the driver.
    """
    place = "place_in_partition"
    low = (1 << 33) - 1  # monotonically_increasing_id keeps the row's place in its lower 33 bits
    tasks = _tasks(df.sparkSession, df.count())
    ranged = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if tasks else df.orderBy(*order)
    placed = materialize(ranged.withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(place, 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts, at = {}, first
    for row in counts:
        starts[row["part"]] = at
        at += row["n"]
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(starts.items()) or [(0, first)], "part long, start long")
    numbered = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return numbered.withColumn(name, F.col("start") + F.col(place).bitwiseAND(F.lit(low))).drop("part", "start", place)
