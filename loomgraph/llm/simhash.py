"""SimHash near-duplicates: tiled exact comparison, then connected components.

Each text gives a 64-bit fingerprint; distinct fingerprints link when at most `radius`
bits differ. Of `radius + k` blocks of bits, fingerprints within the radius agree in at
least k, so each is compared only with those that share some k blocks with it; this loses
no pair. k grows with the number of fingerprints, so that buckets stay small. Within a
bucket fingerprints are ordered by population count and cut into tiles; a pair of tiles is
compared by exclusive-or and bit counts in numpy unless their population counts differ by
more than the radius. Buckets that outgrow a tile are spread over tasks as pairs of tiles,
so a hot bucket never meets in one task.

A tile pair reports links as stars onto the smallest fingerprint it connects, never as
all pairs of a group. Stars are joined into components by alternating large-star and
small-star steps, each written to the shared folder; nothing is collected.

Defined results: null and blank texts have fingerprint zero, which links like any other;
equal texts share a class before anything is compared; repeated ids and rows give a row
each; a component's id is the smallest id in it (null if it has none). Where one document
of each group is kept, that is the row with the smallest id (rows without one come last;
of rows with equal ids the one whose content hashes smallest), and of rows that are equal
in all columns one; ids can be of any type that has an order.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cuts, materialize, nothing, ready, settle, slices
from loomgraph.session import join_uneven, settled

BITS = 64
SEED = 42
WORDS = 3
#: Buckets up to this size are compared side by side with others in one pass of numpy.
SMALL = 48
TILE = 4096
#: Rows of a bucket that evenly spread fingerprints should not exceed, and shares that rows of a hot one are dealt into.
PER_BUCKET, SHARES = 64, 32
#: Edges that one task could hold without noticing: with no more, hubs need no care.
FEW = 100_000


def simhash(text: str | None, part_chars: int = 1 << 20) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones, n, words = np.zeros(BITS, np.int64), 0, []
    for part in cuts(text or "", part_chars):
        words += part.encode().lower().split()  # of bytes: A-Z and the six ASCII blanks only
        hashes = [digest(b" ".join(x), SEED) for x in zip(words, words[1:], words[2:], strict=False)]
        if hashes:
            ones += _bit_sums(hashes)
            n += len(hashes)
            words = words[1 - WORDS :]
    if not n:
        if not words:
            return 0
        ones, n = _bit_sums([digest(b" ".join(words), SEED)]), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _bit_sums(hashes: list[int]) -> np.ndarray:
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long."""
    return _fingerprinted(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")))


def _fingerprinted(picked: DataFrame) -> DataFrame:
    """The rows with fp instead of text, their last column."""
    ready(picked.sparkSession)
    names = [*picked.columns[:-1], "fp"]

    def run(batches):
        settle(nothing)
        for batch in slices(batches):
            *kept, text = batch.columns
            fps = np.array([simhash(t) for t in text.to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps.view(np.int64))], names=names)

    return picked.mapInArrow(run, picked.drop("text").schema.add("fp", "long"))


def _stars(values: np.ndarray, rows: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Stars of the components that rows (i, the indices it links to) make of the values."""
    label = np.arange(len(values))
    for i, near in rows:
        met = np.unique(np.append(label[near], label[i]))
        if len(met) > 1:
            label[np.isin(label, met[1:])] = met[0]
    for root in np.unique(label[label != np.arange(len(values))]):
        members = values[label == root]
        low = members.min()
        yield from ((int(m), int(low)) for m in members[members != low])


def _compare_tiles(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """Links within tile a, or between tiles a and b, as stars."""
    values = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    counts = np.bitwise_count(other).astype(np.int16)
    order = np.argsort(counts, kind="stable")
    other, counts = other[order], counts[order]

    def rows():
        for i, value in enumerate(a):
            mine = int(value).bit_count()
            low, high = np.searchsorted(counts, [mine - radius, mine + radius + 1])
            near = np.flatnonzero(np.bitwise_count(other[low:high] ^ value) <= radius)
            if len(near) > (b is None):  # a tile finds each of its own rows in itself
                yield i, order[low + near] + shift

    return _stars(values, rows())


def _compare_small(bucket: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within many small buckets at once; rows are ordered by bucket and population count."""
    counts = np.bitwise_count(fp).astype(np.int16)
    at = np.arange(len(fp))
    for k in range(1, SMALL):
        at = at[at + k < len(fp)]
        at = at[(bucket[at] == bucket[at + k]) & (counts[at + k] - counts[at] <= radius)]
        if not len(at):
            return
        near = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= radius]
        yield fp[near + k], fp[near]


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks for which buckets of n evenly spread fingerprints stay small."""
    blocks = radius + 1
    while blocks < radius + 4 and n >> BITS * (blocks - radius) // blocks > PER_BUCKET:
        blocks += 1
    return blocks


def bucket_keys(fp: Column, radius: int, blocks: int) -> Column:
    """A number for each choice of blocks - radius blocks, which holds their bits."""
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << b - a) - 1)) if b - a < BITS else fp for a, b in itertools.pairwise(ends)]
    choices = list(itertools.combinations(range(blocks), blocks - radius))
    keys = []
    for nth, chosen in enumerate(choices):
        key = part[chosen[0]]
        for i in chosen[1:]:
            key = F.shiftleft(key, ends[i + 1] - ends[i]).bitwiseOR(part[i])
        keys.append(key * len(choices) + nth)
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = 3, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """(u, v) between distinct fingerprints, v < u: stars that connect all that are within the radius.

    distinct: one column fp of distinct signed longs.
    """
    blocks = blocks or blocks_for(distinct.count(), radius)
    share, every_share = F.pmod(F.xxhash64("fp"), F.lit(SHARES)).alias("share"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<bigint>")).alias("share")
    keyed = distinct.select("fp", F.bit_count("fp").alias("pop"), share, F.explode(bucket_keys(F.col("fp"), radius, blocks)).alias("bucket"))
    # A tile holds one population count of a bucket that is too large for one tile.
    counts = keyed.groupBy("bucket", "pop").agg(F.count("*").alias("n"))
    large = counts.groupBy("bucket").agg(F.sum("n").alias("total")).filter(F.col("total") > tile).select("bucket")
    tiles = counts.join(large, "bucket", "left_semi").select(
        "bucket", "pop", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / tile).cast("int") - 1)).alias("part"),
        F.ceil(F.col("n") / tile).cast("int").alias("parts"),
    )
    tiles = materialize(tiles)
    a, b = (tiles.select(*(F.col(c).alias(f"{c}_{x}") for c in tiles.columns)) for x in "ab")
    pairs = a.join(
        b,
        (F.col("bucket_a") == F.col("bucket_b"))
        & F.abs(F.col("pop_a") - F.col("pop_b")).between(0, radius)
        & (F.struct("pop_a", "part_a") <= F.struct("pop_b", "part_b")),
    )
    pair = F.xxhash64("bucket_a", "pop_a", "part_a", "pop_b", "part_b")
    same = (F.col("pop_a") == F.col("pop_b")) & (F.col("part_a") == F.col("part_b"))
    sides = pairs.select(
        F.col("bucket_a").alias("bucket"),
        pair.alias("pair"),
        F.explode(
            F.when(same, F.array(F.struct(F.col("pop_a").alias("pop"), F.col("part_a").alias("part"), F.lit(0).alias("side"))))
            .otherwise(F.array(
                F.struct(F.col("pop_a").alias("pop"), F.col("part_a").alias("part"), F.lit(0).alias("side")),
                F.struct(F.col("pop_b").alias("pop"), F.col("part_b").alias("part"), F.lit(1).alias("side")),
            ))
        ).alias("x"),
    ).select("bucket", "pair", "x.*")
    # Each share of a bucket's rows meets a copy of the few rows about its tiles.
    parts = tiles.groupBy("bucket", "pop").agg(F.first("parts").alias("parts")).select("*", every_share)
    spread = (
        keyed.join(parts, ["bucket", "pop", "share"])
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .join(sides, ["bucket", "pop", "part"])
        .select("pair", "side", "fp")
    )
    outgrown = tiles.select("bucket").distinct().select("*", every_share)
    few = keyed.join(outgrown, ["bucket", "share"], "left_anti").select("bucket", "pop", "fp")

    def in_buckets(batches):
        for bucket, fp in _whole_groups(batches, 0, 2):
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            sizes = np.diff(np.append(starts, len(bucket)))
            big = np.repeat(sizes > SMALL, sizes)
            for u, v in _compare_small(bucket[~big], fp[~big], radius):
                yield _edges(np.stack([u, v], axis=1))
            for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
                yield _edges(list(_compare_tiles(fp[at : at + n], None, radius)))

    def in_tiles(batches):
        for pair, fp, side in _whole_groups(batches, 0, 2, 1):
            starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            for at, end in zip(starts, np.append(starts[1:], len(pair)), strict=True):
                first = fp[at:end][side[at:end] == 0]
                second = fp[at:end][side[at:end] == 1]
                yield _edges(list(_compare_tiles(first, second if len(second) else None, radius)))

    found = (few.repartition("bucket").sortWithinPartitions("bucket", "pop").mapInArrow(in_buckets, "u long, v long"))
    hot = (spread.repartition("pair").sortWithinPartitions("pair").mapInArrow(in_tiles, "u long, v long"))
    return found.unionByName(hot).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _whole_groups(batches, *wanted: int):
    """Runs of rows that end where a key ends; wanted: the columns of the key, the fingerprint and others."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in wanted]
        if not len(columns[0]):
            continue
        columns[1] = columns[1].view(np.uint64)
        last = np.searchsorted(columns[0], columns[0][-1])
        if held and (columns[0][0] != held[-1][0][-1] or last):
            if last:
                held.append([c[:last] for c in columns])
                columns = [c[last:] for c in columns]
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        elif last:
            yield [c[:last] for c in columns]
            columns = [c[last:] for c in columns]
        held.append(columns)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _edges(pairs) -> pa.RecordBatch:
    both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["u", "v"])


def connect(edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for every node u that isn't itself the smallest.

    edges: (u, v) longs, v < u. Alternates large-star and small-star until nothing changes.
    """
    spark, before = edges.sparkSession, None
    edges, place = settled(spark, edges.distinct)
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).head()
        if now == before or not now[0]:
            return edges
        before, met = now, 2 * now[0]
        edges, place = settled(spark, lambda: _stars_of_stars(edges, met), place)  # noqa: B023 it is called at once


def _stars_of_stars(edges: DataFrame, met: int) -> DataFrame:
    """One large-star and one small-star step; met: twice the number of edges, more than any step has rows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("n"))
    wide = join_uneven(both, least, "u", "n", met, FEW).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    least = wide.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    pairs = F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))
    return join_uneven(wide, least, "u", "n", met, FEW).select(F.explode(pairs).alias("e")).select("e.*").filter("u <> v").distinct()


def _groups(rows: DataFrame, first: Column, radius: int) -> tuple[DataFrame, int]:
    """(fp, n, first) for each fingerprint: its rows, and the least `first` of its component; and the number of rows."""
    classes = materialize(rows.groupBy("fp").agg(F.min(first).alias("own"), F.count("*").alias("n")))
    stars = connect(links(classes.select("fp"), radius))
    rooted = classes.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "n", "own", F.coalesce("v", "fp").alias("root"))
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("members"))
    distinct, total = rooted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    return materialize(join_uneven(rooted, least, "root", "members", distinct).select("fp", "n", "first")), total


def near_duplicates(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, fingerprint, component_id) for each row."""
    rows = materialize(fingerprints(docs, id_col, text_col))
    groups, total = _groups(rows, F.struct(F.col("id").isNull().alias("none"), "id"), radius)
    return join_uneven(rows, groups, "fp", "n", total).select(
        F.col("id").alias(id_col), hexadecimal(F.col("fp")).alias("fingerprint"), F.col("first.id").alias("component_id")
    )


def one_of_each(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group: that with the smallest id.

    Rows are told apart by two hashes of all their columns, so what is decided about them is short,
    and texts move only if the hashes of the rows that go outgrow a broadcast.
    """
    keys = [_unused("row_hash", docs), _unused("other_row_hash", docs)]
    columns = [_plain(docs, c) for c in docs.columns]
    keyed = docs.select("*", F.xxhash64(*columns).alias(keys[0]), F.xxhash64(F.lit(SEED), *columns[::-1]).alias(keys[1]))
    a, b = (keyed[k].alias(n) for k, n in zip(keys, "ab", strict=True))
    rows = materialize(_fingerprinted(keyed.select(docs[id_col].alias("id"), a, b, docs[text_col].cast("string").alias("text"))))
    groups, total = _groups(rows, F.struct(F.col("id").isNull().alias("none"), "id", "a", "b"), radius)
    is_first = (F.col("a") == F.col("first.a")) & (F.col("b") == F.col("first.b"))
    found = join_uneven(rows, groups, "fp", "n", total).select("a", "b", is_first.alias("is_first"))
    found = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("is_first").alias("stays")).filter("n > 1 or not stays")
    # Rows that go, and rows that stay but are there more than once: all are taken out, and of the latter one comes back.
    out = materialize(found.select(F.col("a").alias(keys[0]), F.col("b").alias(keys[1]), F.col("n").alias("times_there"), "stays"))
    many, again = total // 1000, out.filter("stays")
    hot, rest = (out.filter(test).select(*keys) for test in (F.col("times_there") > many, F.col("times_there") <= many))
    kept = keyed.join(F.broadcast(hot), keys, "left_anti").join(rest, keys, "left_anti")  # at most a thousand are hot
    if not again.isEmpty():
        back = keyed.join(F.broadcast(again.join(F.broadcast(hot), keys, "left_semi")), keys, "left_semi")
        more = keyed.join(again.join(F.broadcast(hot), keys, "left_anti"), keys, "left_semi")
        kept = kept.unionByName(back.unionByName(more).dropDuplicates(keys))
    return kept.select(*(f"`{c}`" for c in docs.columns))


def _unused(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name


def _plain(docs: DataFrame, name: str) -> Column:
    """A column as something that can be hashed."""
    column = docs[f"`{name}`"]
    return F.to_json(column) if "map<" in docs.schema[name].dataType.simpleString() else column


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")
