"""What a diff touches: files, symbols, calls and who calls them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.arrays import guard_markers, marker_window
from loomgraph.operators import flow
from loomgraph.plans.tables import Graph
from loomgraph.schema import CALLABLE_KINDS


@dataclass(frozen=True)
class Assessment:
    """matched (path, file, deleted); symbols (id, name, kind, file, line, change); affected calls; flows; new and unmatched paths.

    Flows need the graph's edges, all else doesn't: they are made when they are asked for.
    """

    matched: DataFrame
    symbols: DataFrame
    affected: DataFrame
    make_flows: Callable[[], DataFrame]
    new_files: DataFrame
    unmatched: DataFrame

    @cached_property
    def flows(self) -> DataFrame:
        return self.make_flows()


def match_files(diff_files: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """(path, file): the indexed file of each path: itself, below the root, or the first that ends in /path.

    Ends are matched by equality: of each indexed path all ends that start after a slash are listed,
    so the join is on equal values.
    """
    below = F.concat(F.lit(f"{root.rstrip('/')}/"), "path") if root else F.col("path")
    asked = diff_files.select("path", below.alias("rooted"))
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("end"), i.alias("i")))
    indexed = files.select(F.col("path").alias("file"), F.explode(ends).alias("e")).select("file", F.col("e.end").alias("end"), F.col("e.i").alias("i"))
    whole = indexed.filter("i = 1").select("file", F.col("end").alias("rooted"))
    exact = asked.join(whole.withColumnRenamed("rooted", "path"), "path").select("path", F.lit(0).alias("how"), "file")
    rooted = asked.join(whole, "rooted").select("path", F.lit(1).alias("how"), "file")
    tail = asked.join(indexed.filter("i > 1").select("file", F.col("end").alias("path")), "path").select("path", F.lit(2).alias("how"), "file")
    best = F.min(F.struct("how", "file")).alias("best")
    return exact.unionByName(rooted).unionByName(tail).groupBy("path").agg(best).select("path", F.col("best.file").alias("file"))


def assess(graph: Graph, diff_files: DataFrame, diff_lines: DataFrame, root: str = "", files: DataFrame | None = None) -> Assessment:
    """The effect of a diff. Symbols that overlap a changed line are modified; all of a deleted file's are removed.

    files: the files to match, by default all that symbols are in.
    """
    files = graph.symbols.select(F.col("file").alias("path")).distinct() if files is None else files
    matched = diff_files.join(match_files(diff_files, files, root), "path").select("path", "file", "deleted")
    left = diff_files.join(matched, "path", "left_anti")
    new_files = left.filter("is_new and not deleted").select("path")
    unmatched = left.filter("not is_new and not deleted").select("path")

    # Lines become ranges of neighbours, a few for each hunk, before they meet symbols.
    lines = diff_lines.join(matched.filter("not deleted").select("path", "file"), "path").select("file", "new_line").distinct()
    columns = ["id", "name", "kind", "file", "line", "end_line"]
    in_files = graph.symbols.select(*columns).join(matched.filter("not deleted").select("file").distinct(), "file", "left_semi")
    ranges = _ranges(lines)
    overlap = in_files.join(ranges, (in_files.file == ranges.in_file) & (F.col("first") <= F.greatest("line", "end_line")) & (F.col("last") >= F.col("line")))
    modified = overlap.select(*columns).distinct().withColumn("change", F.lit("modified"))
    gone = graph.symbols.select(*columns).join(matched.filter("deleted").select("file").distinct(), "file", "left_semi")
    symbols = modified.unionByName(gone.withColumn("change", F.lit("removed")))

    functions = modified.filter(F.col("kind").isin(*CALLABLE_KINDS)).select(F.col("id").alias("func_id"), "file")
    chains = graph.chains.join(functions, "func_id", "left_semi")
    calls = flow.calls(graph, chains, with_edges=False).join(functions, "func_id")
    touched = calls.join(lines.select("file", F.col("new_line").alias("line")), ["file", "line"], "left_semi")
    affected = touched.join(chains, "func_id").select(
        "func_id", "position", "to_id", "to_name", "line", guard_markers(F.col("chain"), F.col("position")).alias("markers")
    )

    def flows() -> DataFrame:
        spans = affected.groupBy("func_id").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count("*").alias("calls"))
        own_edges = graph.edges.filter("caller_id <> callee_id").join(spans.select(F.col("func_id").alias("callee_id")), "callee_id", "left_semi")
        callers = own_edges.groupBy(F.col("callee_id").alias("func_id")).agg(F.array_sort(F.collect_set("caller_id")).alias("called_by"))
        return spans.join(chains, "func_id").join(callers, "func_id", "left").select(
            "func_id", "calls", marker_window(F.col("chain"), F.col("first"), F.col("last")).alias("marker_window"),
            F.coalesce("called_by", F.array().cast("array<bigint>")).alias("called_by"),
        )

    return Assessment(matched, symbols, affected, flows, new_files, unmatched)


def _ranges(lines: DataFrame) -> DataFrame:
    """(in_file, first, last): runs of consecutive lines of a file."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("file").orderBy("new_line"))
    runs = lines.withColumn("run", F.col("new_line") - nth)
    return runs.groupBy(F.col("file").alias("in_file"), "run").agg(F.min("new_line").alias("first"), F.max("new_line").alias("last")).drop("run")


def summary(found: Assessment) -> DataFrame:
    """One row: files, matched, symbols, flows, new_files, unmatched."""
    parts = {"matched": found.matched, "symbols": found.symbols, "flows": found.flows, "new_files": found.new_files, "unmatched": found.unmatched}
    counts = [df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for name, df in parts.items()]
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.unionByName(more)
    one = rows.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts))
    return one.select((F.col("matched") + F.col("new_files") + F.col("unmatched")).alias("files"), *parts)
