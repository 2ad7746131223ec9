"""Context for a query: matching symbols with their callers, callees and source lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.markers import is_symbol
from loomgraph.operators import search
from loomgraph.plans.tables import Graph
from loomgraph.session import materialize


def context(graph: Graph, query: str, limit: int = 5, sources: DataFrame | None = None, depth: int = 1) -> DataFrame:
    """(id, name, kind, file, line, signature, source, callers, callees) of the first matches, in order.

    sources: (path, content); lines are cut to what the file has. Callers are those within `depth` hops.
    """
    hits = search.by_name(graph.symbols, query, limit=limit).select("id", "name", "kind", "file", "line", "end_line", "signature")
    names = graph.symbols.select(F.col("id").alias("other_id"), F.col("name").alias("other"))
    ids = F.broadcast(hits.select("id"))  # at most `limit` rows
    up = graph.edges.filter("caller_id <> callee_id").select(F.col("callee_id").alias("id"), F.col("caller_id").alias("other_id"))
    met = up.join(ids, "id").distinct()
    step = met
    for _ in range(depth - 1):  # pairs of a hit and a caller of one more hop
        further = up.select(F.col("id").alias("other_id"), F.col("other_id").alias("next_id"))
        step = step.join(further, "other_id").select("id", F.col("next_id").alias("other_id")).distinct().join(met, ["id", "other_id"], "left_anti")
        met = materialize(met.unionByName(step))
    up = met.filter("id <> other_id").join(names, "other_id").groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("callers"))
    down = graph.chains.select(F.col("func_id").alias("id"), "chain").join(ids, "id")
    down = down.select("id", F.posexplode("chain").alias("pos", "other_id")).filter((F.col("pos") > 0) & is_symbol(F.col("other_id")) & (F.col("other_id") != F.col("id")))
    down = down.groupBy("id", "other_id").agg(F.min("pos").alias("pos")).join(names, "other_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "other"))), lambda r: r["other"])
    down = down.groupBy("id").agg(ordered.alias("callees"))
    found = hits.join(up, "id", "left").join(down, "id", "left")
    if sources is None:
        found = found.withColumn("source", F.lit(None).cast("string"))
    else:
        found = found.join(sources.select(F.col("path").alias("file"), "content"), "file", "left")
        lines = F.split("content", "\n")
        first, last = F.greatest("line", F.lit(1)), F.least("end_line", F.size(lines))
        found = found.withColumn("source", F.when(last >= first, F.array_join(F.slice(lines, first, last - first + 1), "\n")))
    none = F.array().cast("array<string>")
    return found.select(
        "id", "name", "kind", "file", "line", "signature", "source", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees")
    ).orderBy(F.lower("name"), "id")
