"""The engine: a snapshot opened for questions, with pages, cursors, deadlines and freshness.

Answers are pages of rows, collected on the driver; the plans behind them are ordinary
DataFrames from loomgraph.operators.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import context, diff, flow, lookup, reports, sandbox, search, traversal
from loomgraph.plans.tables import Graph
from loomgraph.schema import CALLABLE_KINDS
from loomgraph.sinks import render
from loomgraph.sources import snapshot, unified_diff
from loomgraph.sources.config import Config

PAGE, REFERENCES_PAGE, CONTEXT_PAGE = 20, 10, 5
TIMEOUT_MS = 20_000
SESSION_SECONDS, MOST_SESSIONS = 600, 512
LARGEST_PAGE = 500


@dataclass(frozen=True)
class Page:
    """Rows of an answer. cursor: what continues it; timed_out: whether the deadline ended it before its rows came."""

    rows: list[Row]
    total: int
    cursor: str | None = None
    timed_out: bool = False


class Sessions:
    """States by token, for ten minutes; the oldest go when there are too many."""

    def __init__(self, seconds: float = SESSION_SECONDS, most: int = MOST_SESSIONS, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self.states: OrderedDict[str, tuple[float, dict]] = OrderedDict()
        self.lock = threading.Lock()

    def put(self, state: dict) -> str:
        token = uuid.uuid4().hex
        with self.lock:
            self._expire()
            while len(self.states) >= self.most:
                self.states.popitem(last=False)
            self.states[token] = (self.clock(), state)
        return token

    def get(self, token: str) -> dict | None:
        with self.lock:
            self._expire()
            found = self.states.get(token)
        return found[1] if found else None

    def _expire(self) -> None:
        now = self.clock()
        while self.states and now - next(iter(self.states.values()))[0] > self.seconds:
            self.states.popitem(last=False)


class DeadlineError(Exception):
    """A question took longer than it was given."""


def within(spark: SparkSession, timeout_ms: int | None, work: Callable[[], Any]) -> Any:
    """Run Spark jobs of `work`, cancelling them at the deadline. None: no deadline; 0: it has passed already."""
    if timeout_ms is None:
        return work()
    if timeout_ms <= 0:
        raise DeadlineError
    group, context_ = f"loomgraph-{uuid.uuid4().hex}", spark.sparkContext
    late = threading.Event()

    def cancel() -> None:
        late.set()
        context_.cancelJobGroup(group)

    timer = threading.Timer(timeout_ms / 1000, cancel)
    context_.setJobGroup(group, "a question with a deadline", interruptOnCancel=True)
    timer.start()
    try:
        return work()
    except Exception:
        if late.is_set():
            raise DeadlineError from None
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context_.setLocalProperty(name, None)


def page_size(limit: int | None) -> int:
    """A page's size: 50 by default, from 1 to 500."""
    return 50 if limit is None else max(1, min(limit, LARGEST_PAGE))


class Engine:
    """Questions about the newest version of a snapshot."""

    def __init__(self, spark: SparkSession, root: str, settings: Config | None = None):
        if root.rstrip("/") in ("", "file:", "file://"):
            raise ValueError("the root of the file system can't be a workspace")
        self.spark, self.root = spark, root.rstrip("/")
        self.settings, self.workspace = settings or Config(), None
        self.sessions = Sessions()
        self.version, self.graph = 0, None
        self.lock = threading.Lock()

    # ---- lifecycle

    def index(self, graph: Graph) -> int:
        """Write a graph as the next version and answer from it."""
        version = snapshot.write(graph, self.root)
        self.ensure_fresh()
        return version

    def index_workspace(self, folder: str, **options) -> DataFrame:
        """Parse the files of a folder and index them; returns (files, symbols, chains, calls, skipped).

        Languages, header files and effect rules are those of the settings, unless options name others.
        """
        from loomgraph.operators import ingest
        from loomgraph.sources import workspace

        own = {"headers": self.settings.headers, "languages": self.settings.languages} | options
        found = workspace.files(self.spark, folder, **own)
        symbols, chains, calls, files = workspace.parse_tables(found, self.settings.effect_rules)
        self.index(ingest.build(symbols, chains, calls, files))
        self.workspace = (folder, options)
        g = self.graph
        return reports.extraction(g.files, g.symbols, g.chains, g.call_records, workspace.skipped(found))

    def reindex(self) -> DataFrame:
        """Index the workspace that was indexed last once more, as a new version."""
        if self.workspace is None:
            raise FileNotFoundError("no workspace has been indexed")
        folder, options = self.workspace
        return self.index_workspace(folder, **options)

    def deinit(self) -> bool:
        """Forget the snapshot and delete it, all versions; returns whether there was one."""
        was_there = snapshot.remove(self.spark, self.root)
        self.close()
        return was_there

    def ensure_fresh(self) -> bool:
        """Open a newer version if there is one; returns whether there was. If opening fails the old one stays."""
        with self.lock:
            newest = snapshot.current(self.spark, self.root)
            if newest is None or newest[0] == self.version:
                return False
            self.graph, self.version = snapshot.read(self.spark, self.root, newest[0]), newest[0]
            return True

    def close(self) -> None:
        self.graph, self.version = None, 0
        self.sessions = Sessions()

    def _ready(self) -> Graph:
        self.ensure_fresh()
        if self.graph is None:
            raise FileNotFoundError(f"no snapshot in {self.root}")
        return self.graph

    def status(self) -> Row:
        """Stored statistics; if they are all zero, counted ones."""
        row = snapshot.stored_stats(self.spark, self.root).head()
        if self.version and not any(row[c] for c in ("symbols", "chains", "edges", "files")):
            row = snapshot.stats(self.graph).head()
        return row

    # ---- pages

    def _paged(self, tool: str, key: dict, rows: DataFrame, order: list, limit: int, offset: int, cursor: str | None, timeout_ms: int | None) -> Page:
        """A page of rows; a cursor goes on where its page ended and belongs to the same question and version."""
        if cursor is not None:
            state = self.sessions.get(cursor)
            if state is None:
                raise LookupError("the cursor is unknown or has expired")
            if state["tool"] != tool:
                raise ValueError(f"the cursor is of {state['tool']}, not of {tool}")
            if state["version"] != self.version:
                raise ValueError("the cursor is of an older version")
            if state["key"] != key:
                raise ValueError("the cursor is of another question")
            offset = state["offset"]
        state = {"tool": tool, "key": key, "version": self.version, "offset": offset}
        try:
            total, found = within(self.spark, timeout_ms, lambda: (rows.count(), lookup.page(rows, order, limit, offset).collect()))
        except DeadlineError:
            return Page([], 0, self.sessions.put(state), True)
        end = offset + len(found)
        more = self.sessions.put(state | {"offset": end}) if limit and end < total else None
        return Page(found, total, more)

    def search_symbol(self, query: str, mode: str = "contains", kind: str | None = None, limit: int = PAGE, offset: int = 0, cursor: str | None = None, timeout_ms: int | None = TIMEOUT_MS) -> Page:
        g = self._ready()
        key = {"query": query, "mode": mode, "kind": kind}
        return self._paged("search_symbol", key, search.matches(g.symbols, query, mode, kind), [F.lower("name"), "id"], limit, offset, cursor, timeout_ms)

    def semantic_search(self, vector: list[float], kind: str | None = None, limit: int = PAGE) -> list[Row]:
        g = self._ready()
        return search.semantic(g.symbols, g.embeddings, vector, kind, limit).collect()

    def search_by_annotation(self, text: str, kind: str | None = None, limit: int = PAGE, offset: int = 0, cursor: str | None = None, timeout_ms: int | None = TIMEOUT_MS) -> Page:
        rows = lookup.annotated_rows(self._ready().symbols, text, kind)
        return self._paged("search_by_annotation", {"text": text, "kind": kind}, rows, ["name", "id"], limit, offset, cursor, timeout_ms)

    def list_types(self, kind: str = "class", limit: int = PAGE, offset: int = 0, cursor: str | None = None, timeout_ms: int | None = TIMEOUT_MS) -> Page:
        rows = lookup.kind_rows(self._ready().symbols, kind)
        return self._paged("list_types", {"kind": kind}, rows, ["name", "id"], limit, offset, cursor, timeout_ms)

    def references(self, text: str, limit: int = REFERENCES_PAGE, offset: int = 0, cursor: str | None = None, timeout_ms: int | None = TIMEOUT_MS) -> Page:
        g = self._ready()
        rows = reports.references(g.symbols, g.call_sites, text)
        return self._paged("references", {"text": text}, rows, ["func_name", "func_id"], limit, offset, cursor, timeout_ms)

    def search_flow(self, pattern: str, limit: int = PAGE, offset: int = 0, cursor: str | None = None, timeout_ms: int | None = TIMEOUT_MS) -> Page:
        g = self._ready()
        rows = flow.search_flow(g, flow.pattern_ids(g.symbols, pattern))
        return self._paged("search_flow", {"pattern": pattern}, rows, ["func_name", "func_id"], limit, offset, cursor, timeout_ms)

    # ---- single answers

    def symbol(self, name: str | None = None, symbol_id: int | None = None, kinds: tuple[str, ...] = ()) -> lookup.Resolved:
        return lookup.resolve(self._ready().symbols, name, symbol_id, kinds)

    def _id(self, name_or_id: str | int, kinds: tuple[str, ...] = ()) -> int:
        if isinstance(name_or_id, int):
            return name_or_id
        found = self.symbol(name_or_id, kinds=kinds)
        if found.ambiguous:
            raise LookupError(f"{name_or_id} means {len(found.matches)} symbols: {[m['id'] for m in found.matches][:20]}")
        return found.symbol["id"]

    def _named(self, found: DataFrame) -> list[Row]:
        names = self.graph.symbols.select("id", "name", "kind", "file", "line")
        return found.join(names, "id").orderBy("hop", "name", "id").collect()

    def callers(self, name_or_id: str | int, depth: int = 1) -> list[Row]:
        g = self._ready()
        return self._named(traversal.callers(g.symbols, g.edges, self._id(name_or_id), depth))

    def impact(self, name_or_id: str | int, depth: int = traversal.IMPACT_DEPTH) -> list[Row]:
        return self.callers(name_or_id, depth)

    def callees(self, name_or_id: str | int) -> list[Row]:
        g = self._ready()
        return traversal.callees(g.chains, g.symbols, self._id(name_or_id)).collect()

    def flow(self, name_or_id: str | int) -> list[Row]:
        return flow.flow(self._ready(), self._id(name_or_id)).collect()

    def calls(self, name_or_id: str | int) -> list[Row]:
        g = self._ready()
        own = g.chains.filter(F.col("func_id") == self._id(name_or_id))
        return flow.calls(g, own).orderBy("position").collect()

    def mermaid(self, name_or_id: str | int, kind: str = "flow", depth: int = 2) -> str:
        """A diagram: flow of a function's chain, or its callers, callees, or both."""
        g, symbol_id = self._ready(), self._id(name_or_id)
        if kind == "flow":
            return render.flow_diagram(flow.flow(g, symbol_id)).head()["diagram"]
        nodes, edges = traversal.call_graph(g.symbols, g.edges, symbol_id, depth, kind)
        return render.graph_diagram(nodes, edges, symbol_id)

    def class_info(self, name_or_id: str | int) -> list[Row]:
        g = self._ready()
        class_id = self._id(name_or_id, ("class", "interface", "enum"))
        target = lookup.class_targets(g.symbols).filter(F.col("id") == class_id).head()
        return lookup.class_members(g.symbols, target["target_id"]).collect() if target else []

    def function_scope(self, name_or_id: str | int) -> list[Row]:
        return lookup.function_scope(self._ready().symbols, self._id(name_or_id, ("function", "method"))).collect()

    def files(self, prefix: str = "", root: str = "") -> list[Row]:
        return lookup.files(self._ready().files, prefix, root).collect()

    def dependencies(self) -> list[Row]:
        g = self._ready()
        return reports.dependencies(g.symbols, g.call_sites).collect()

    def context(self, query: str, limit: int = CONTEXT_PAGE, sources: DataFrame | None = None, as_markdown: bool = True, depth: int = 1) -> str:
        rows = context.context(self._ready(), query, limit, sources, depth).collect()
        return render.context_markdown(rows, self.root) if as_markdown else render.to_json(rows, self.root)

    def diff(self, text: str, root: str = "") -> diff.Assessment:
        """What a unified diff touches."""
        tables = unified_diff.tables(self.spark, unified_diff.parse(text))
        return diff.assess(self._ready(), *tables, root=root)

    def sandbox(self, name_or_id: str | int, mocks: dict[str, sandbox.Mock] | None = None, loop_cap: int | None = None, policy: str | None = None) -> sandbox.Trace:
        return sandbox.simulate(self._ready(), self._id(name_or_id), *self._run_options(mocks, loop_cap, policy))

    def _run_options(self, mocks, loop_cap, policy) -> tuple:
        """Options of a run; what is not given is as the settings say."""
        own = self.settings
        return own.mocks | (mocks or {}), own.loop_cap if loop_cap is None else loop_cap, policy or own.policy

    def origin_simulate(self, name: str, origin: Graph | int, mocks: dict[str, sandbox.Mock] | None = None, loop_cap: int | None = None, policy: str | None = None) -> dict:
        """Run a function of the same name in another graph, or an older version, and in the current one, and compare.

        A version or function that is missing becomes a note, not an error.
        """
        options, traces, notes = self._run_options(mocks, loop_cap, policy), [], []
        older = lambda: origin if isinstance(origin, Graph) else snapshot.read(self.spark, self.root, origin)
        for graph_of, label in ((older, f"version {origin}" if isinstance(origin, int) else "origin"), (self._ready, "current")):
            try:
                g = graph_of()
                found = lookup.resolve(g.symbols, name)
                traces.append(sandbox.simulate(g, (found.symbol or found.matches[0])["id"], *options))
            except (LookupError, FileNotFoundError, AnalysisException) as e:
                traces.append(sandbox.Trace())
                notes.append(f"{label}: {e}")
        added, removed = sandbox.compare(*traces)
        return {"entry": name, "before": traces[0], "after": traces[1], "added": added, "removed": removed, "notes": notes}

    def diff_simulate(self, text: str, origin: Graph | int, entry: str | None = None, mocks: dict[str, sandbox.Mock] | None = None, loop_cap: int | None = None, policy: str | None = None, root: str = "") -> dict:
        """Run what a diff touches before and after it: `entry`, or else the first function with a changed call or line.

        The answer also names the affected functions, a page of them. Raises ValueError if there is none.
        """
        found = self.diff(text, root)
        names = self.graph.symbols.select(F.col("id").alias("func_id"), "name")
        flows = found.flows.select("func_id").join(names, "func_id").select("name", F.lit(0).alias("how"), F.col("func_id").alias("id"))
        touched = found.symbols.filter(F.col("kind").isin(*CALLABLE_KINDS)).select("name", F.lit(1).alias("how"), "id")
        first = flows.unionByName(touched).groupBy("name").agg(F.min(F.struct("how", "id")).alias("first"))
        affected = [r["name"] for r in first.orderBy("first").limit(LARGEST_PAGE).collect()]
        if entry is None and not affected:
            raise ValueError("the diff touches no function: name an entry")
        return self.origin_simulate(entry or affected[0], origin, mocks, loop_cap, policy) | {"affected_functions": affected}


def open_engine(spark: SparkSession, root: str) -> Engine:
    """An engine on the newest snapshot in a folder."""
    engine = Engine(spark, root)
    engine.ensure_fresh()
    return engine
