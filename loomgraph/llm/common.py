"""Helpers that every operator of this subpackage shares.

Conventions that hold for all operators here:

* An operator reads only the columns it names, so further columns of any name
  (also names that an operator returns) never clash.
* A null text counts as an empty text unless the operator says otherwise.
* A null document id is kept as null and belongs to the held-out fold.
* Rows are never dropped, capped or merged: repeated rows give repeated results.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize, ship_library

__all__ = [
    "ENTRY_BYTES", "bounded_sample", "by_bytes", "cuts", "held_out", "labelled_sample", "materialize", "nothing", "public_vocabulary", "read", "ready", "settle",
    "slices", "weight",
]

#: The fold that no model may learn from.
HELD_OUT_FOLD = 2
FOLDS = 4


def public_vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; every operator takes a path, this is only the default."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for documents that no model learns from: crc32(id as text) mod 4 is 2, or there is no id."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % F.lit(FOLDS)
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(True))


#: Rows of an Arrow batch, and what Spark has without being told.
BATCH_ROWS, SPARK_BATCH_ROWS = 2048, 10_000


def ready(spark: SparkSession) -> None:
    """Ready a session for Arrow functions: executors get the library; batches get smaller, unless the session has chosen a size.

    A batch of Spark's own size is several times in memory, as JVM vectors, as a message and in Python.
    """
    ship_library(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == SPARK_BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024, most_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of at most `rows` rows and, as far as one row allows, about `most_bytes`.

    Spark bounds a batch by rows and bytes; this bounds what of it is in Python objects at once.
    """
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most_bytes // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: What an entry of a table in a worker takes besides its characters, about.
ENTRY_BYTES = 200


def weight(words: Iterable[str]) -> int:
    """About how many bytes a worker's table needs for these words."""
    return sum(len(w) + ENTRY_BYTES for w in words)


_FORGET: list[Callable[[], object]] = []


def settle(forget: Callable[[], object]) -> None:
    """Called by an operator's function as it starts in a worker, with what lets go of its own tables.

    What another operator has remembered there is let go of first, so that a worker that serves
    one stage after the other holds the tables of one.
    """
    if _FORGET and _FORGET[0] != forget:
        _FORGET.pop()()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # give the memory back, where the C library can
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    if not _FORGET:
        _FORGET.append(forget)


def nothing() -> None:
    """What operators that remember nothing let go of."""


def cuts(text: str, size: int, ends: str = " \n\t\r") -> Iterator[str]:
    """Cut a text into parts of about `size` characters, each ending before a run of blanks or line ends.

    Joined, the parts give the text again. Where there is no such run, a part grows up to the next one.
    """
    at, end = 0, len(text)
    forward = None
    while end - at > size:
        stop = max(text.rfind(c, at + 1, at + size) for c in ends)
        stop = at + len(text[at:stop].rstrip(ends)) if stop > at else at
        if stop <= at:
            forward = forward or re.compile(f"(?<![{ends}])[{ends}]")
            found = forward.search(text, at + size)
            if not found:
                break
            stop = found.start()
        yield text[at:stop]
        at = stop
    yield text[at:]


def by_bytes(items: Iterable[tuple[int, str]], most: int) -> Iterator[list[tuple[int, str]]]:
    """Group (row, text) items so that each group holds about `most` bytes."""
    group: list[tuple[int, str]] = []
    held = 0
    for item in items:
        group.append(item)
        held += (len(item[1]) if item[1].isascii() else len(item[1].encode())) + 1
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def bounded_sample(rows: DataFrame, n: int, content: list[str], by: str | None = None, most_groups: int = 1000) -> DataFrame:
    """At most `n` rows (of each value of `by`), alike ones in `content` once: those whose content hashes smallest.

    A share of the hash's range that holds about 2 * n distinct rows is filtered first, so neither the
    number of rows nor one that repeats decides how many are shuffled, and rows are found wherever there are any.
    Raises ValueError if `by` has more than `most_groups` values.
    """
    key, nth = "hash_of_content", "nth_of_group"
    hashed = rows.withColumn(key, F.xxhash64(*content))
    distinct = F.approx_count_distinct(key).alias("n")
    if by is None:
        found = [(None, hashed.agg(distinct).head()["n"])]
    else:
        found = [(r[by], r["n"]) for r in hashed.groupBy(by).agg(distinct).limit(most_groups + 1).collect()]
        if len(found) > most_groups:
            raise ValueError(f"{by} has more than {most_groups} values")
    if not found:
        return rows.limit(0)
    share = F.lit(2 * n / max(found[0][1], 1)) if by is None else F.create_map(*(F.lit(x) for k, d in sorted(found) for x in (k, 2 * n / max(d, 1))))[F.col(by)]
    drawn = hashed.filter(F.col(key) / F.lit(2.0**64) + 0.5 < share)
    keys = [key] if by is None else [by, key]
    chosen = drawn.select(*keys).distinct()
    if by is None:
        chosen = chosen.orderBy(key).limit(n)
    else:
        chosen = chosen.withColumn(nth, F.row_number().over(Window.partitionBy(by).orderBy(key))).filter(F.col(nth) <= n).drop(nth)
    found = drawn.join(F.broadcast(chosen), keys, "left_semi")  # n hashes of each group
    return found.groupBy(*keys).agg(*(F.first(c).alias(c) for c in rows.columns if c != by)).select(*rows.columns)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, label, text) of at most `per_class` distinct labelled texts of each class outside the held-out fold.

    Those whose ids, and then texts, hash smallest are taken. The ids are broadcast; `per_class` bounds them.
    """
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label"))
    marked = marked.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    ids = bounded_sample(marked, per_class, ["id"], "label")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    found = texts.join(F.broadcast(ids), "id").select("id", "label", "text")
    return bounded_sample(found, per_class, ["text"], "label")
