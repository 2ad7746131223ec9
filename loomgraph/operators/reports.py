"""Reports over a graph: references, dependencies, extraction and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import first_name
from loomgraph.operators.lookup import page


def references(symbols: DataFrame, call_sites: DataFrame, text: str) -> DataFrame:
    """(func_id, func_name, file, call_sites) of functions with calls under a name that contains the text.

    Names are call names and names by the variable's type; a call found under both counts once.
    """
    keyed = call_sites.filter(F.contains("name_key", F.lit(text.lower())))
    site = F.struct("name_key", "line", "call_name", "condition", "is_loop_body", "arg_exprs")
    once = keyed.groupBy("caller_id", "line", "call_name", "arg_exprs").agg(F.min(site).alias("site"))
    grouped = once.groupBy(F.col("caller_id").alias("func_id")).agg(F.array_sort(F.collect_list("site")).alias("call_sites"))
    names = symbols.select(F.col("id").alias("func_id"), F.col("name").alias("func_name"), "file")
    return grouped.join(names, "func_id").select("func_id", "func_name", "file", "call_sites")


def references_page(symbols: DataFrame, call_sites: DataFrame, text: str, limit: int = 10, offset: int = 0) -> DataFrame:
    return page(references(symbols, call_sites, text), ["func_name", "func_id"], limit, offset)


def dependencies(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(name, is_internal, count): what precedes the first dot of called names, and how many calls have it.

    calls: records or sites. A name is internal if a symbol has it; calls count once for each caller, line and name.
    """
    calls = calls.select("caller_id", "line", "call_name").distinct()
    modules = calls.select(F.lower(first_name(F.col("call_name"))).alias("name")).filter("name is not null")
    counted = modules.groupBy("name").agg(F.count("*").alias("count"))
    own = symbols.select(F.lower("name").alias("name")).distinct().withColumn("own", F.lit(True))
    found = counted.join(own, "name", "left")
    return found.select("name", F.coalesce("own", F.lit(False)).alias("is_internal"), "count").orderBy(F.desc("count"), "name")


def extraction(files: DataFrame, symbols: DataFrame, chains: DataFrame, calls: DataFrame, skipped: int = 0) -> DataFrame:
    """One row: files, symbols, chains, calls, skipped."""
    parts = {"files": files, "symbols": symbols, "chains": chains, "calls": calls}
    counts = [df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for name, df in parts.items()]
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts), F.lit(skipped).cast("long").alias("skipped"))


def usage(audit: DataFrame) -> DataFrame:
    """(tool, calls, errors, answer_bytes, source_bytes, savings_pct) from audit rows (tool, ok, answer_bytes, source_bytes).

    savings_pct: the share, to one decimal, of what reading the sources would have taken beyond the answers.
    """
    found = audit.groupBy("tool").agg(
        F.count("*").alias("calls"),
        F.sum((~F.col("ok")).cast("long")).alias("errors"),
        F.sum("answer_bytes").alias("answer_bytes"),
        F.sum("source_bytes").alias("source_bytes"),
    )
    total = F.col("answer_bytes") + F.col("source_bytes")
    share = F.round(F.when(total > 0, F.col("source_bytes") / total * 100).otherwise(0.0), 1)
    return found.withColumn("savings_pct", share).orderBy(F.desc("calls"), F.desc("answer_bytes"), "tool")


def source_bytes(answers: DataFrame, files: DataFrame) -> DataFrame:
    """(call_id, source_bytes): for answers (call_id, path), the bytes of the distinct files they name."""
    named = answers.select("call_id", "path").distinct().join(files.select("path", "bytes"), "path", "left")
    return named.groupBy("call_id").agg(F.coalesce(F.sum("bytes"), F.lit(0).cast("long")).alias("source_bytes"))
