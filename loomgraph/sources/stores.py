"""Opening graphs by name: folders of snapshots, or tables of a database over JDBC.

A name is a path or URL that Spark reads (a snapshot's root), or a `jdbc:` URL. A database
holds the same tables as a snapshot, named by the graph's number, so that many graphs can
share it; arrays and annotations are kept there as JSON text. Its `meta` table is emptied before
and filled after the others are written, so readers never take half a graph for a whole one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import schema as schemas
from loomgraph.plans.tables import Graph
from loomgraph.sources import snapshot

#: How many connections write or read a table of a database at a time.
CONNECTIONS = 16


@dataclass(frozen=True)
class Route:
    """Where a graph is kept: a path or JDBC URL, with the graph's number and options for a database.

    The option numPartitions says how many connections are used at a time.
    """

    where: str
    repo_id: int = 0
    options: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> str:
        return f"graph_{self.repo_id}_{name}"

    @property
    def is_database(self) -> bool:
        return self.where.startswith("jdbc:")


def shard_of(repo_id: int, wheres: list[str]) -> str:
    """The database of a graph when it is first registered: its number modulo how many there are."""
    if not wheres:
        raise ValueError("no databases are named")
    return wheres[repo_id % len(wheres)]


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType | T.MapType | T.StructType)


def flat(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns as a database can hold them."""
    value = lambda f: F.to_json(f.name) if _nested(f.dataType) else F.col(f.name)
    return df.select(*(value(f).alias(f.name) for f in schema.fields))


def restored(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a table of the graph from those of a database."""

    def value(f: T.StructField) -> Column:
        found = F.from_json(F.col(f.name), f.dataType) if _nested(f.dataType) else F.col(f.name).cast(f.dataType)
        return found.alias(f.name)

    return df.select(*(value(f) for f in schema.fields))


def split_column(schema: T.StructType, key: str) -> str | None:
    """The column of ids of symbols that a table is read by in parts; None: in one."""
    return next((c for c in (key, "caller_id") if c in schema.names and schema[c].dataType == T.LongType()), None)


def _connected(io, route: Route, name: str):
    """A reader or writer of a table of the graph."""
    io = io.format("jdbc").option("numPartitions", CONNECTIONS).options(**route.options)
    return io.option("url", route.where).option("dbtable", route.table(name))


def write(graph: Graph, route: Route) -> int:
    """Keep a graph; returns its version (always 1 in a database, whose tables of the graph are replaced)."""
    if not route.is_database:
        return snapshot.write(graph, route.where)
    spark = graph.spark
    _connected(spark.createDataFrame([], schemas.META).write, route, "meta").mode("overwrite").save()
    for name, (schema, _) in snapshot.TABLES.items():
        df = getattr(graph, name)
        df = spark.createDataFrame([], schema) if df is None else df
        _connected(flat(df, schema).write, route, name).mode("overwrite").save()
    last = graph.symbols.agg(F.max("id")).head()[0]
    meta = spark.createDataFrame([(1, schemas.FIRST_SYMBOL_ID if last is None else last + 1)], schemas.META)
    _connected(meta.write, route, "meta").mode("overwrite").save()
    return 1


def read(spark: SparkSession, route: Route) -> Graph:
    """The graph that a route leads to. A database's tables are read in parts by ranges of ids.

    Raises FileNotFoundError if a graph in a database has not been written to its end.
    """
    if not route.is_database:
        return snapshot.read(spark, route.where)
    meta = restored(_connected(spark.read, route, "meta").load(), schemas.META).head()
    if meta is None:
        raise FileNotFoundError(f"graph {route.repo_id} is not complete")

    def table(name: str, schema: T.StructType, key: str) -> DataFrame:
        reader, column = _connected(spark.read, route, name), split_column(schema, key)
        if column and meta["next_id"] > schemas.FIRST_SYMBOL_ID:
            bounds = {"partitionColumn": column, "lowerBound": schemas.FIRST_SYMBOL_ID, "upperBound": meta["next_id"]}
            return reader.options(**bounds).load()
        return reader.option("numPartitions", 1).load()

    return Graph(**{name: restored(table(name, schema, key), schema) for name, (schema, key) in snapshot.TABLES.items()})
