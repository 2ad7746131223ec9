"""Walking the graph: callers, callees, impact, call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.markers import is_symbol
from loomgraph.session import materialize

IMPACT_DEPTH = 3


def direct_callers(edges: DataFrame, symbol_id: int) -> DataFrame:
    """(id): functions other than the symbol whose chain holds it."""
    return edges.filter((F.col("callee_id") == symbol_id) & (F.col("caller_id") != symbol_id)).select(F.col("caller_id").alias("id")).distinct()


def reached(edges: DataFrame, start: DataFrame, depth: int, source: str, target: str) -> DataFrame:
    """(id, hop): what a walk from the start nodes (id) reaches along edges, at its first hop; start is hop 0.

    Each hop joins only what the one before it found, and is written before the next, so no
    hop is computed twice and a walk over a large graph survives lost executors.
    """
    frontier = materialize(start.select(F.col("id").cast("long").alias("id")).distinct().withColumn("hop", F.lit(0)))
    seen = frontier
    pairs = edges.select(F.col(source).alias("from_id"), F.col(target).alias("to_id"))
    for hop in range(1, max(depth, 1) + 1):
        step = pairs.join(frontier.select(F.col("id").alias("from_id")), "from_id").select(F.col("to_id").alias("id")).distinct()
        frontier = materialize(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _start(symbols: DataFrame, symbol_id: int) -> DataFrame:
    start = symbols.filter(F.col("id") == symbol_id).select("id")
    if start.isEmpty():
        raise LookupError(f"no symbol has the id {symbol_id}")
    return start


def callers(symbols: DataFrame, edges: DataFrame, symbol_id: int, depth: int = 1) -> DataFrame:
    """(id, hop) of all that call the symbol, directly or through others, within `depth` hops (1 at least)."""
    return reached(edges, _start(symbols, symbol_id), depth, "callee_id", "caller_id").filter("hop > 0")


def impact(symbols: DataFrame, edges: DataFrame, symbol_id: int, depth: int = IMPACT_DEPTH) -> DataFrame:
    """What a change of the symbol can reach: its callers."""
    return callers(symbols, edges, symbol_id, depth)


def callees(chains: DataFrame, symbols: DataFrame, symbol_id: int) -> DataFrame:
    """(id, name, position): what the symbol calls itself, each once, in the order of its chain."""
    own = chains.filter(F.col("func_id") == symbol_id).select(F.posexplode("chain").alias("position", "id"))
    first = own.filter((F.col("position") >= 1) & is_symbol(F.col("id")) & (F.col("id") != symbol_id)).groupBy("id").agg(F.min("position").alias("position"))
    return first.join(symbols.select("id", "name"), "id").select("id", "name", "position").orderBy("position")


def call_graph(symbols: DataFrame, edges: DataFrame, symbol_id: int, depth: int = 2, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, hop) within `depth` of the symbol, and the edges among them that the walk met.

    direction: callers, callees, or both. A node is as far as its shortest way; edges back to visited nodes count.
    """
    walks = {"callers": ("callee_id", "caller_id"), "callees": ("caller_id", "callee_id")}
    start = _start(symbols, symbol_id)
    found, met = None, None
    for way in walks if direction == "both" else (direction,):
        source, target = walks[way]
        nodes = reached(edges, start, depth, source, target)
        inner = nodes.filter(F.col("hop") < depth).select(F.col("id").alias(source))
        pairs = edges.select("caller_id", "callee_id").join(inner, source, "left_semi")
        found = nodes if found is None else found.unionByName(nodes)
        met = pairs if met is None else met.unionByName(pairs)
    nodes = found.groupBy("id").agg(F.min("hop").alias("hop")).join(symbols.select("id", "name"), "id", "left")
    return nodes.select("id", F.coalesce("name", F.col("id").cast("string")).alias("name"), "hop"), met.distinct()
