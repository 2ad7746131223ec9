"""Vectors of symbols: nearest neighbours, embedding, k-means."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.vectors import dot, hashed, literal, normalised
from loomgraph.session import materialize, ship_library

Embedding = Callable[[Column], Column]

#: Numbers that a task of k-means holds for its rows at a time.
SCORES = 1 << 22
#: An odd factor that spreads ids over 64 bits.
MIX = 0x9E3779B97F4A7C15


def nearest(embeddings: DataFrame, query: list[float], k: int = 0) -> DataFrame:
    """(symbol_id, similarity) of the k vectors with the largest dot product (0: all), best first."""
    size = sum(x * x for x in query) ** 0.5 or 1.0
    similarity = dot(F.col("vector"), literal([x / size for x in query]))
    found = embeddings.select("symbol_id", similarity.alias("similarity")).orderBy(F.desc("similarity"), "symbol_id")
    return found.limit(k) if k else found


def symbol_text(symbols: DataFrame) -> Column:
    """What of a symbol is embedded: name, signature, documentation and names of annotations."""
    names = F.concat_ws(" ", F.transform("annotations", lambda a: a["name"]))
    return F.concat_ws(" ", "name", "signature", "doc", F.when(F.length(names) > 0, names))


def embed(symbols: DataFrame, embedding: Embedding = hashed, known: DataFrame | None = None, dimension: int = 384) -> DataFrame:
    """(symbol_id, vector) of all symbols; known vectors of the right dimension are taken over."""
    rows = symbols.select(F.col("id").alias("symbol_id"), symbol_text(symbols).alias("text"))
    if known is None:
        return rows.select("symbol_id", embedding(F.col("text")).cast("array<float>").alias("vector"))
    kept = known.filter(F.size("vector") == dimension).join(rows.select("symbol_id"), "symbol_id", "left_semi")
    missing = rows.join(kept, "symbol_id", "left_anti")
    new = missing.select("symbol_id", embedding(F.col("text")).cast("array<float>").alias("vector"))
    return kept.select("symbol_id", "vector").unionByName(new)


def without_vector(symbols: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Ids of symbols that have no vector yet."""
    return symbols.select(F.col("id").alias("symbol_id")).join(embeddings.select("symbol_id"), "symbol_id", "left_anti")


def k_means(embeddings: DataFrame, k: int, rounds: int = 20) -> tuple[DataFrame, list[list[float]]]:
    """(symbol_id, cluster, similarity), and the centroids: cosine k-means, farthest points first.

    The first centroid is the vector of the smallest id, each next one the vector least similar to
    all so far. Rounds stop when no vector changes its cluster; a warning tells if `rounds` ended first.
    An empty cluster keeps its centroid. k is brought into the range from 1 to the number of vectors.
    Rows without a vector take no part; vectors of different lengths raise ValueError.

    Every centroid and every round is one pass over the vectors. Each task adds up its own vectors by
    cluster, so k rows a task are shuffled, and only k centroids and counts reach the driver.
    """
    spark = embeddings.sparkSession
    ship_library(spark)
    units = materialize(embeddings.filter("vector is not null").select("symbol_id", normalised(F.col("vector")).alias("vector")))
    n, shortest, longest = units.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).head()
    if not n:
        return units.select("symbol_id", F.lit(0).alias("cluster"), F.lit(0.0).alias("similarity")), []
    if shortest != longest:
        raise ValueError(f"vectors have from {shortest} to {longest} components")
    k = max(1, min(k, n))
    centroids = np.array([units.orderBy("symbol_id").head()["vector"]], dtype=float)
    while len(centroids) < k:
        farthest = units.mapInArrow(_farthest(centroids), "similarity double, symbol_id long, vector array<double>")
        centroids = np.vstack([centroids, farthest.orderBy("similarity", "symbol_id").head()["vector"]])
    sums, before = "cluster long, n long, state long, total array<double>", None
    for _ in range(rounds):
        parts = units.mapInArrow(_totals(centroids), sums)
        added = parts.repartition("cluster").mapInArrow(_added, sums).collect()  # k rows
        state = sorted((r["cluster"], r["n"], r["state"]) for r in added)
        if state == before:
            break
        before, centroids = state, centroids.copy()
        for r in added:
            mean = np.array(r["total"]) / r["n"]
            centroids[r["cluster"]] = mean / (np.sqrt(mean @ mean) or 1.0)
    else:
        warnings.warn(f"clusters still changed after {rounds} rounds", stacklevel=2)
    assigned = units.mapInArrow(_assigned(centroids), "symbol_id long, cluster int, similarity double")
    return assigned, centroids.tolist()


def _scored(batches: Iterable[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and similarities to all centroids, of as many rows at a time as memory is meant for."""
    step = max(1, SCORES // (len(centroids) + centroids.shape[1]))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield part.column(0).to_numpy(zero_copy_only=False), x, x @ centroids.T


def _lists(rows: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def _farthest(centroids: np.ndarray):
    """Of each task, the vector that is least similar to its closest centroid, the smallest id first."""

    def run(batches):
        best = None
        for ids, x, scores in _scored(batches, centroids):
            closest = scores.max(axis=1)
            i = np.lexsort((ids, closest))[0]
            if best is None or (closest[i], ids[i]) < best[:2]:
                best = closest[i], ids[i], x[i].copy()
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]]), _lists(best[2][None])], names=["similarity", "symbol_id", "vector"])

    return run


def _sums_batch(clusters: np.ndarray, n: np.ndarray, state: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(clusters.astype(np.int64)), pa.array(n), pa.array(state.view(np.int64)), _lists(total)]
    return pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "state", "total"])


def _totals(centroids: np.ndarray):
    """Of each task and cluster: how many vectors it has, a hash of their ids, and their sum."""

    def run(batches):
        n, state, total = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.uint64), np.zeros_like(centroids)
        for ids, x, scores in _scored(batches, centroids):
            cluster = scores.argmax(axis=1)
            mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(MIX)
            n += np.bincount(cluster, minlength=len(centroids))
            np.add.at(state, cluster, mixed ^ (mixed >> np.uint64(31)))
            np.add.at(total, cluster, x)
        met = np.flatnonzero(n)
        if len(met):
            yield _sums_batch(met, n[met], state[met], total[met])

    return run


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all tasks, one row for each cluster."""
    found: dict[int, list] = {}
    for batch in batches:
        clusters, n, state = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        totals = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for c, count, hashed_ids, total in zip(clusters.tolist(), n, state.view(np.uint64), totals, strict=True):
            have = found.setdefault(c, [np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(len(total))])
            have[0] += count
            have[1] += hashed_ids
            have[2] += total
    if found:
        n, state, total = (np.concatenate([v[i] for v in found.values()]) for i in range(3))
        yield _sums_batch(np.array(list(found)), n, state, total.reshape(len(found), -1))


def _assigned(centroids: np.ndarray):
    """Each vector's closest centroid, the first of several."""

    def run(batches):
        for ids, _, scores in _scored(batches, centroids):
            columns = [pa.array(ids), pa.array(scores.argmax(axis=1).astype(np.int32)), pa.array(scores.max(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=["symbol_id", "cluster", "similarity"])

    return run
