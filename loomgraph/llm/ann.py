"""Approximate nearest neighbours with score-aware anisotropic quantisation.

Vectors are scaled to unit length, so the largest inner product is the largest cosine.
Each pair of dimensions has a codebook of sixteen entries; two four-bit codes make a
byte. Codebooks and codes minimise a loss in which the part of the residual that is
parallel to the vector weighs more than the rest, because that part is what shifts the
scores of near neighbours.

Every row is indexed; equal vectors share an entry, which holds the smallest of their ids.
A search meets tiles of queries with tiles of codes: for each query, tables of partial
products are added up over a tile's codes, and the entries whose estimate comes within the
measured error of the best ones are estimated again, from codes of a byte for each
dimension. What is still within the error of these, among all tiles, is scored exactly, in
doubles on the original vectors. There is no cap on how many entries pass either sieve.
Vectors themselves only move for the entries that are scored.

Defined results: rows with a null id, a null or zero vector, null or non-finite
components, or another dimension than most take no part; a query whose id repeats is
asked once, with its least vector, and a repeated row is a candidate each time it occurs;
ties go to the smaller id; an empty table gives no rows. Codebooks are fitted on at most
`sample_rows` distinct vectors, those that hash smallest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_sample, materialize, ready, slices

WIDTH = 2
ENTRIES = 16
#: Most rows and queries of a tile, the fewest rows, and queries whose tables are in memory at once.
TILE_ROWS, TILE_QUERIES, LEAST_ROWS, TABLES = 1 << 20, 1 << 14, 1 << 13, 256


@dataclass
class Quantiser:
    """codebooks: (dimension pairs, entries, width); weight: what parallel residual error costs beside the rest.

    error: the root mean square error of estimates near the top; fine_error: of the estimates by byte codes.
    """

    codebooks: np.ndarray
    weight: float
    dimension: int
    error: float = 0.0
    fine_error: float = 0.0

    def _parts(self, unit: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(unit), self.codebooks.shape[0] * WIDTH))
        padded[:, : self.dimension] = unit
        return padded.reshape(len(unit), -1, WIDTH)

    def codes(self, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Entry per dimension pair, by coordinate descent on the anisotropic loss."""
        x = self._parts(unit)
        found = ((x[:, :, None, :] - self.codebooks) ** 2).sum(-1).argmin(-1)
        return self._descend(x, found, sweeps)

    def _descend(self, x: np.ndarray, found: np.ndarray, sweeps: int) -> np.ndarray:
        pairs = np.arange(x.shape[1])
        along = ((x - self.codebooks[pairs, found]) * x).sum(-1)
        total = along.sum(1)
        for _ in range(sweeps):
            for m in pairs:
                away = x[:, m, None, :] - self.codebooks[m]
                parallel = (away * x[:, m, None, :]).sum(-1)
                others = (total - along[:, m])[:, None]
                loss = (away**2).sum(-1) + (self.weight - 1) * (others + parallel) ** 2
                found[:, m] = loss.argmin(1)
                along[:, m] = parallel[np.arange(len(x)), found[:, m]]
                total = others[:, 0] + along[:, m]
        return found

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)

    def record(self, unit: np.ndarray) -> np.ndarray:
        """Rows of bytes: packed codes, a byte for each dimension, and the four bytes of what one step of these is."""
        step = (np.abs(unit).max(axis=1, keepdims=True) / 127).astype(np.float32)
        fine = np.rint(unit / step).clip(-127, 127).astype(np.int8)
        return np.hstack([self.pack(self.codes(unit)), fine.view(np.uint8), step.view(np.uint8)])

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): what each value of a byte adds to a query's estimate."""
        products = np.einsum("qmw,mew->qme", self._parts(unit), self.codebooks)
        both = products[:, 0::2, :, None] + products[:, 1::2, None, :]
        return both.reshape(len(unit), -1, ENTRIES * ENTRIES).astype(np.float32)

    def measure_error(self, unit: np.ndarray, queries: int = 64, top: int = 128) -> None:
        """Measure the error of estimates on vectors, some of which are asked for."""
        if len(unit):
            asked = unit[:: -(-len(unit) // queries)]
            codes = Codes(self, self.record(unit))
            errors, fine_errors = [], []
            for table, query in zip(self.tables(asked), asked, strict=True):
                scores = codes.estimates(table)
                best = np.argpartition(-scores, min(top, len(scores) - 1))[:top]
                exact = unit[best] @ query
                errors.append(scores[best] - exact)
                fine_errors.append(codes.finer(query.astype(np.float32), best) - exact)
            self.error, self.fine_error = (float(np.sqrt(np.mean(np.concatenate(e) ** 2))) for e in (errors, fine_errors))


class Codes:
    """The codes of a tile's rows."""

    def __init__(self, quantiser: Quantiser, records: np.ndarray):
        width = quantiser.codebooks.shape[0] // 2
        self.columns = np.ascontiguousarray(records[:, :width].T)
        self.fine = records[:, width : width + quantiser.dimension].view(np.int8)
        self.step = np.ascontiguousarray(records[:, width + quantiser.dimension :]).view(np.float32)[:, 0]

    def estimates(self, table: np.ndarray) -> np.ndarray:
        """A query's estimates for all rows: what each byte of their codes adds, column by column."""
        total = table[0][self.columns[0]]
        for part, column in zip(table[1:], self.columns[1:], strict=True):
            total += part[column]
        return total

    def finer(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.fine[rows].astype(np.float32) @ query * self.step[rows]


def fit_quantiser(unit: np.ndarray, dimension: int, threshold: float = 0.2, rounds: int = 6) -> Quantiser:
    """Codebooks from unit vectors; parallel error weighs as for scores of at least `threshold`."""
    pairs = -(-dimension // (2 * WIDTH)) * 2
    weight = max(1.0, (dimension - 1) * threshold**2 / (1 - threshold**2))
    quantiser = Quantiser(np.zeros((pairs, ENTRIES, WIDTH)), weight, dimension)
    if not len(unit):
        return quantiser
    x = quantiser._parts(unit)
    first = np.linspace(0, len(x) - 1, ENTRIES).astype(int)
    for m in range(pairs):
        angle = np.argsort(np.arctan2(x[:, m, 1], x[:, m, 0]) + 7 * np.hypot(x[:, m, 0], x[:, m, 1]), kind="stable")
        quantiser.codebooks[m] = x[angle[first], m]
    found = ((x[:, :, None, :] - quantiser.codebooks) ** 2).sum(-1).argmin(-1)
    for i in range(rounds):
        along = ((x - quantiser.codebooks[np.arange(pairs), found]) * x).sum(-1)
        total = along.sum(1)
        extra = 0.0 if i < 2 else weight - 1  # the first rounds are plain k-means
        for m in range(pairs):
            part, others = x[:, m], total - along[:, m]
            outer = np.eye(WIDTH) + extra * part[:, :, None] * part[:, None, :]
            right = part + (extra * (others + (part**2).sum(1)))[:, None] * part
            for entry in range(ENTRIES):
                if (mine := found[:, m] == entry).any():
                    quantiser.codebooks[m, entry] = np.linalg.solve(outer[mine].sum(0), right[mine].sum(0))
            along[:, m] = ((part - quantiser.codebooks[m, found[:, m]]) * part).sum(1)
            total = others + along[:, m]
        found = quantiser._descend(x, found, 1)
    return quantiser


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dimension)


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row, in doubles; scaled first, so that squares neither overflow nor vanish."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (queries, vectors))
    return (a * b).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum(axis=1)))


@dataclass
class Index:
    """rows: (id, vector) of all that take part; entries: (entry, vector, ids, codes), one for each distinct vector."""

    rows: DataFrame
    entries: DataFrame
    quantiser: Quantiser


def build_index(
    vectors: DataFrame, k: int = 5, sample_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding"
) -> Index:
    """Index every usable row. ids: of an entry's rows, the k + 1 smallest ids and how often each occurs (k at most)."""
    ready(vectors.sparkSession)
    picked = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vector"))
    picked = picked.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = picked.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").head()
    dimension = most["d"] if most else 2
    picked = picked.filter(F.size("vector") == dimension)
    sample = bounded_sample(picked, sample_rows, ["vector"]).toPandas()
    seen = np.array(sample["vector"].tolist(), dtype=float).reshape(-1, dimension)
    unit = unit_rows(seen) if len(seen) else seen
    quantiser = fit_quantiser(unit, dimension)
    quantiser.measure_error(unit)

    def encode(batches):
        for batch in slices(batches, 4096):
            records = quantiser.record(unit_rows(_matrix(batch.column(1), dimension)))
            codes = pa.array([row.tobytes() for row in records], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], names=["entry", "vector", "ids", "codes"])

    # Of a vector's ids only the smallest count, so what repeats is cut down before it meets in one task.
    each = picked.groupBy("vector", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = each.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    distinct = few.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "times"))).alias("ids"))
    distinct = materialize(distinct.select(F.monotonically_increasing_id().alias("entry"), "vector", "ids"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema.fields)
    return Index(picked, materialize(distinct.mapInArrow(encode, f"{kinds}, codes binary")), quantiser)


def scan_tile(quantiser: Quantiser, query_ids: np.ndarray, queries: np.ndarray, records: np.ndarray, only: np.ndarray, k: int):
    """Yield (query id, rows, fine estimates): of each query, the rows of a tile that may be among its k best.

    only: the id of rows whose entry has no other; a query's own are passed over.
    """
    codes = Codes(quantiser, records)

    def near_best(scores: np.ndarray, margin: float) -> np.ndarray:
        least = np.partition(scores, len(scores) - k)[len(scores) - k] - margin if len(scores) > k else -np.inf
        return np.flatnonzero((scores >= least) & (scores > -np.inf))

    for at in range(0, len(queries), TABLES):
        units = unit_rows(queries[at : at + TABLES])
        for query, unit, table in zip(query_ids[at : at + TABLES], units.astype(np.float32), quantiser.tables(units), strict=True):
            scores = codes.estimates(table)
            scores[only == query] = -np.inf
            rows = near_best(scores, 3 * quantiser.error)
            finer = codes.finer(unit, rows)
            best = near_best(finer, 3 * quantiser.fine_error)
            yield int(query), rows[best], finer[best]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    tile: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Return (query_id, rank, vec_id, score): the k nearest other rows of each row for which is_query holds.

    is_query: a condition on a column `id`. tile: rows of a tile, by default a share for each core.
    """
    index = build_index(vectors, k, id_col=id_col, vector_col=vector_col)
    quantiser, cores = index.quantiser, vectors.sparkSession.sparkContext.defaultParallelism
    dimension = quantiser.dimension
    asked = index.rows.filter(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = materialize(asked.select(F.col("id").alias("query_id"), "vector"))
    entries = index.entries.count()
    tile = tile or min(TILE_ROWS, max(LEAST_ROWS, -(-entries // (2 * cores))))
    tiles, query_tiles = max(1, -(-entries // tile)), max(1, -(-asked.count() // TILE_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    share = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    only = F.when(F.size("ids") == 1, F.col("ids")[0]["id"])
    # Codes go to each tile of queries, and queries to each tile of codes; entries are distinct, so tiles are even.
    rows = index.entries.select(share("entry", tiles).alias("tile"), every(query_tiles).alias("query_tile"), "entry", only.alias("only"), "codes", F.lit(None).cast(asked.schema["vector"].dataType).alias("vector"))
    queries = asked.select(every(tiles).alias("tile"), share("query_id", query_tiles).alias("query_tile"), F.col("query_id").alias("entry"), F.lit(None).cast("long").alias("only"), F.lit(None).cast("binary").alias("codes"), "vector")
    cells = min(tiles * query_tiles, 1 << 14)
    grid = rows.unionByName(queries).repartition(cells, "tile", "query_tile").groupBy("tile", "query_tile")

    def scan(table: pa.Table) -> pa.Table:
        is_row = table["codes"].is_valid()
        kept, wanted = table.filter(is_row), table.filter(pc.invert(is_row))
        query, entry, estimate = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        if kept.num_rows and wanted.num_rows:
            records = np.frombuffer(b"".join(kept["codes"].to_pylist()), np.uint8).reshape(kept.num_rows, -1)
            ids, alone = kept["entry"].to_numpy(), kept["only"].to_pandas().to_numpy()
            for one, found, scores in scan_tile(quantiser, wanted["entry"].to_numpy(), _matrix(wanted["vector"], dimension), records, alone, k):
                query.append(np.full(len(found), one))
                entry.append(ids[found])
                estimate.append(scores)
        return pa.table({"query_id": np.concatenate(query), "entry": np.concatenate(entry), "estimate": np.concatenate(estimate)})

    found = grid.applyInArrow(scan, "query_id long, entry long, estimate float")
    # The k-th best estimate of all tiles says how good the k best are, give or take the error.
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("estimate"), "entry"))
    least = F.max(F.when(F.col("nth") == k, F.col("estimate"))).over(Window.partitionBy("query_id"))
    close = found.withColumn("nth", nth).withColumn("least", least).filter(F.col("least").isNull() | (F.col("estimate") >= F.col("least") - F.lit(3 * quantiser.fine_error)))
    pairs = close.select("query_id", "entry").join(index.entries.select("entry", "ids", F.col("vector").alias("other")), "entry").join(asked, "query_id")

    def score(batches):
        for batch in slices(batches, 4096):
            exact = cosines(_matrix(batch.column(1), dimension), _matrix(batch.column(2), dimension)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(exact, pa.float64())], names=["query_id", "ids", "score"])

    scored = pairs.select("query_id", "vector", "other", "ids").mapInArrow(score, f"query_id long, ids {index.entries.schema['ids'].dataType.simpleString()}, score double")
    others = scored.select("query_id", "score", F.explode("ids").alias("x")).filter(F.col("x.id") != F.col("query_id"))
    others = others.select("query_id", "score", F.col("x.id").alias("vec_id"), F.explode(F.array_repeat(F.lit(0), F.col("x.times"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return others.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
