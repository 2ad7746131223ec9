"""Answers as JSON, Markdown and diagrams. Diagrams are built in Spark; the rest formats collected pages."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loomgraph.functions.text import diagram_label
from loomgraph.schema import MARKERS

PATH_KEYS = ("file", "path", "matched_path")
ZERO_IS_ABSENT = ("scope_id", "type_ref", "end_line")
MEDIUM_LEVELS = {
    "minimal": ("id", "name", "kind", "file", "line"),
    "medium": ("id", "name", "kind", "file", "line", "signature"),
}
POSITIONS = (
    "id", "name", "kind", "scope", "scope_id", "type_ref", "type_name",
    "file", "line", "end_line", "signature", "doc", "annotations", "language",
)


def plain(value: Any) -> Any:
    """Rows and what they hold as dictionaries and lists."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


def below_root(path: str, root: str) -> str:
    root = root.rstrip("/")
    return "" if path == root else path.removeprefix(root + "/")


def relative(value: Any, root: str) -> Any:
    """Paths under the known keys relative to the root, at any depth."""
    if isinstance(value, list):
        return [relative(v, root) for v in value]
    if isinstance(value, dict):
        return {k: below_root(v, root) if k in PATH_KEYS and isinstance(v, str) else relative(v, root) for k, v in value.items()}
    return value


def without_defaults(value: Any) -> Any:
    """Drop keys whose value says nothing; elements of lists stay."""
    if isinstance(value, list):
        return [without_defaults(v) for v in value]
    if not isinstance(value, dict):
        return value
    kept = {k: without_defaults(v) for k, v in value.items()}
    empty = lambda k, v: v is None or v is False or v in ("", [], {}) or (k in ZERO_IS_ABSENT and v == 0)
    return {k: v for k, v in kept.items() if not empty(k, v)}


def to_json(value: Any, root: str = "") -> str:
    found = plain(value)
    return json.dumps(without_defaults(relative(found, root) if root else found), indent=2, ensure_ascii=False)


def minimized(symbols: DataFrame) -> DataFrame:
    """(symbol): each symbol as an array of its fourteen values as text, by position."""
    text = lambda name: F.to_json(name) if name == "annotations" else F.col(name).cast("string")
    return symbols.select(F.array(*(text(p) for p in POSITIONS)).alias("symbol"))


def medium(symbols: DataFrame, level: str = "medium") -> DataFrame:
    return symbols.select(*MEDIUM_LEVELS.get(level, POSITIONS))


def context_markdown(rows: list[Row], root: str = "") -> str:
    out = ["# Context"]
    for r in rows:
        place = f"{below_root(r['file'], root) if root else r['file']}:{r['line']}"
        out += ["", f"## {r['name']} ({r['kind']})", "", f"`{place}`"]
        if r["signature"]:
            out += ["", f"```\n{r['signature']}\n```"]
        if r["source"]:
            out += ["", f"```\n{r['source']}\n```"]
        for title in ("callers", "callees"):
            if r[title]:
                out += ["", f"### {title.title()}", "", *(f"- {name}" for name in r[title])]
    return "\n".join(out) + "\n"


def _shape(element: Column, label: Column) -> Column:
    of = lambda *names: element.isin(*(MARKERS[n] for n in names))
    return (
        F.when(of("IF_TRUE", "IF_FALSE", "BRANCH_END"), F.concat(F.lit('{"'), label, F.lit('"}')))
        .when(of("LOOP", "LOOP_BACK", "RETURN", "BREAK", "CONTINUE", "THROW"), F.concat(F.lit('(["'), label, F.lit('"])')))
        .otherwise(F.concat(F.lit('["'), label, F.lit('"]')))
    )


def flow_diagram(described: DataFrame) -> DataFrame:
    """(func_id, diagram): a node for each element of a chain, joined in order."""
    node = F.concat(F.lit("  n"), F.col("position").cast("string"), _shape(F.col("element"), diagram_label(F.col("description"))))
    rows = F.array_sort(F.collect_list(F.struct("position", node.alias("node"))))
    nodes = F.transform(rows, lambda r: r["node"])
    arrow = lambda r: F.concat(F.lit("  n"), (r["position"] - 1).cast("string"), F.lit(" --> n"), r["position"].cast("string"))
    arrows = F.transform(F.filter(rows, lambda r: r["position"] > 0), arrow)
    lines = F.concat(F.array(F.lit("flowchart TD")), nodes, arrows)
    return described.groupBy("func_id").agg(F.array_join(lines, "\n").alias("diagram"))


def graph_diagram(nodes: DataFrame, edges: DataFrame, root_id: int) -> str:
    """A diagram of a bounded walk: nodes (id, name, hop), edges (caller_id, callee_id)."""
    mark = F.when(F.col("id") == root_id, F.lit(" (root)")).otherwise(F.lit(""))
    drawn = nodes.select("id", F.concat(diagram_label(F.col("name")), mark).alias("label")).orderBy("id").collect()
    out = ["graph LR"] + [f'  s{r["id"]}["{r["label"]}"]' for r in drawn]
    out += [f"  s{r['caller_id']} --> s{r['callee_id']}" for r in edges.orderBy("caller_id", "callee_id").collect()]
    return "\n".join(out)
