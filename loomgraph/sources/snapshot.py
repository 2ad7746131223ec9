"""Snapshots: a graph written as versioned Parquet tables, and read again.

A version is written to a folder of its own and becomes current when its `meta` table is
there, so readers never see half a snapshot. Tables are ranged by the ids that lookups
ask for; Parquet's statistics then skip most of a table.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import schema
from loomgraph.plans.tables import Graph

#: Of each table: its schema, and the column that it is ranged by.
TABLES = {
    "symbols": (schema.SYMBOLS, "id"),
    "chains": (schema.CHAINS, "func_id"),
    "call_records": (schema.CALL_RECORDS, "caller_id"),
    "call_sites": (schema.CALL_SITES, "name_key"),
    "edges": (schema.EDGES, "callee_id"),
    "files": (schema.FILES, "path"),
    "embeddings": (schema.EMBEDDINGS, "symbol_id"),
}


def _read(spark: SparkSession, path: str, kind) -> DataFrame:
    return spark.read.schema(kind).parquet(path)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, next_id) of all complete versions; none if there is no snapshot."""
    try:
        return _read(spark, f"{root}/meta", schema.META)
    except AnalysisException:
        return spark.createDataFrame([], schema.META)


def current(spark: SparkSession, root: str) -> tuple[int, int] | None:
    """The newest version and its next free id."""
    row = versions(spark, root).agg(F.max(F.struct("version", "next_id")).alias("m")).head()
    return (row["m"]["version"], row["m"]["next_id"]) if row and row["m"] else None


def write(graph: Graph, root: str, partitions: int | None = None) -> int:
    """Write the graph as the next version; returns its number."""
    spark = graph.spark
    before = current(spark, root)
    version = before[0] + 1 if before else 1

    def save(name: str) -> None:
        kind, key = TABLES[name]
        df = getattr(graph, name)
        if df is None:
            df = spark.createDataFrame([], kind)
        columns = [key] if partitions is None else [partitions, key]
        ranged = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields)).repartitionByRange(*columns)
        ranged.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{root}/v{version}/{name}")

    with ThreadPoolExecutor(4) as pool:  # the tables don't depend on each other
        list(pool.map(save, TABLES))
    # What was written is counted, not computed again.
    found = read(spark, root, version)
    counted = stats(found)
    counted.write.mode("overwrite").parquet(f"{root}/v{version}/stats")
    meta = _read(spark, f"{root}/v{version}/stats", schema.STATS).select(F.lit(version).cast("long").alias("version"), "next_id")
    meta.coalesce(1).write.mode("append").parquet(f"{root}/meta")
    return version


def remove(spark: SparkSession, root: str) -> bool:
    """Delete all versions; returns whether there was a snapshot. What else is in the folder stays."""
    there = versions(spark, root).select("version").collect()  # a row for each version
    for name in ["meta", *(f"v{r['version']}" for r in there)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return bool(there)


def read(spark: SparkSession, root: str, version: int | None = None) -> Graph:
    """A version of the graph, the newest if none is named."""
    if version is None:
        newest = current(spark, root)
        if newest is None:
            raise FileNotFoundError(f"no snapshot in {root}")
        version = newest[0]
    return Graph(**{name: _read(spark, f"{root}/v{version}/{name}", kind) for name, (kind, _) in TABLES.items()})


def stats(graph: Graph) -> DataFrame:
    """One row: how many symbols, chains, edges and files there are, and the next free id."""
    counts = [
        getattr(graph, name).agg(F.count("*").alias("n"), (F.max("id") if name == "symbols" else F.lit(None).cast("long")).alias("last"))
        .withColumn("name", F.lit(name))
        for name in ("symbols", "chains", "edges", "files")
    ]
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("n"))).alias(name)
    next_id = F.coalesce(F.max("last") + 1, F.lit(schema.FIRST_SYMBOL_ID).cast("long")).alias("next_id")
    return found.agg(*(of(name) for name in ("symbols", "chains", "edges", "files")), next_id).select(*schema.STATS.names)


def stored_stats(spark: SparkSession, root: str) -> DataFrame:
    """The statistics written with the newest version; zeros if there is none."""
    newest = current(spark, root)
    if newest is None:
        return spark.createDataFrame([(0, 0, 0, 0, schema.FIRST_SYMBOL_ID)], schema.STATS)
    return _read(spark, f"{root}/v{newest[0]}/stats", schema.STATS)
