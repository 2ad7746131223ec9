"""Searching names: contains, prefix, suffix, exact, by vectors, and both by reciprocal ranks; runs in chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.arrays import contains_run, starts_with_run
from loomgraph.operators import vectors
from loomgraph.operators.lookup import page

MODES = ("contains", "prefix", "suffix", "exact", "semantic", "hybrid")
RANK_OFFSET = 60


def matches(symbols: DataFrame, query: str, mode: str = "contains", kind: str | None = None) -> DataFrame:
    """Symbols whose name matches, whatever its case. An empty query matches nothing but as prefix or suffix, all."""
    name, text = F.lower("name"), query.lower()
    if mode == "contains" and not text:
        raise LookupError("an empty text is contained in nothing")
    test = {
        "contains": F.contains(name, F.lit(text)),
        "prefix": F.startswith(name, F.lit(text)),
        "suffix": F.endswith(name, F.lit(text)),
        "exact": name == text,
    }[mode]
    found = symbols.filter(test)
    return found.filter(F.col("kind") == kind) if kind else found


def by_name(symbols: DataFrame, query: str, mode: str = "contains", kind: str | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    return page(matches(symbols, query, mode, kind), [F.lower("name"), "id"], limit, offset)


def semantic(symbols: DataFrame, embeddings: DataFrame | None, query: list[float], kind: str | None = None, limit: int = 20) -> DataFrame:
    """The nearest symbols; the kind filter acts on the nearest max(4 limit, 32), so fewer than limit may come."""
    if embeddings is None:
        raise ValueError("semantic search needs embeddings; build the graph with an embedding function")
    near = vectors.nearest(embeddings, query, max(4 * limit, 32))
    found = near.join(symbols, near.symbol_id == symbols.id)
    if kind:
        found = found.filter(F.col("kind") == kind)
    return found.orderBy(F.desc("similarity"), "id").limit(limit).select("id", "name", "kind", "similarity")


def fused(rankings: list[DataFrame]) -> DataFrame:
    """(id, score): for rankings (id, rank from 0), the sum of 1 / (60 + rank + 1)."""
    found = rankings[0].select("id", "rank")
    for more in rankings[1:]:
        found = found.unionByName(more.select("id", "rank"))
    score = F.sum(F.lit(1.0) / (F.col("rank") + RANK_OFFSET + 1)).alias("score")
    return found.groupBy("id").agg(score)


def hybrid(symbols: DataFrame, embeddings: DataFrame | None, text: str, query: list[float], kind: str | None = None, limit: int = 20) -> DataFrame:
    """Names that contain the text and nearest vectors, fused by rank."""
    if embeddings is None:
        raise ValueError("hybrid search needs embeddings; build the graph with an embedding function")
    k = max(4 * limit, 32)
    lexical = page(matches(symbols, text), [F.lower("name"), "id"], k).select("id", F.lower("name").alias("key"))
    near = vectors.nearest(embeddings, query, k).select(F.col("symbol_id").alias("id"), "similarity")
    ranked = [_ranked(lexical, F.col("key")), _ranked(near, F.desc("similarity"))]
    found = fused(ranked).join(symbols, "id")
    if kind:
        found = found.filter(F.col("kind") == kind)
    return found.orderBy(F.desc("score"), "id").limit(limit).select("id", "name", "kind", "score")


def _ranked(df: DataFrame, order) -> DataFrame:
    """Ranks from 0; the input is at most a few hundred rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(order, "id")) - 1)


def chains_with(chains: DataFrame, pattern: list[int], depth: int | None = None) -> DataFrame:
    """Chains that contain the run of elements; with a depth, only those of at most depth + 1 elements."""
    if not pattern:
        raise LookupError("an empty run is contained in nothing")
    found = chains.filter(contains_run(F.col("chain"), pattern))
    return found if depth is None else found.filter(F.size("chain") <= depth + 1)


def chains_from(chains: DataFrame, pattern: list[int]) -> DataFrame:
    """Chains that start with the run of elements."""
    return chains.filter(starts_with_run(F.col("chain"), pattern))


def distinct_chains(chains: DataFrame) -> DataFrame:
    """Of chains that are equal, the one of the smallest function."""
    return chains.groupBy("chain").agg(F.min("func_id").alias("func_id")).select("func_id", "chain")
