"""The registered queries of the graph operators: each returns flat columns in a fixed shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import arrays, effects, markers, text
from loomgraph.functions.vectors import hashed
from loomgraph.operators import context, diff, flow, ingest, lookup, reports, sandbox, search, traversal, vectors
from loomgraph.plans import fixtures as fx
from loomgraph.schema import MARKERS
from loomgraph.sinks import render
from loomgraph.sources import config, snapshot, star, workspace

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _joined(array: Column | str) -> Column:
    column = F.col(array) if isinstance(array, str) else array
    return F.array_join(column.cast("array<string>"), ",")


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    rows = fx.graph(spark, sf_dir).embeddings.filter(F.col("symbol_id") == star.PART + fx.VECTOR_ROW)
    return list(rows.head()["vector"])


# ---- snapshot and whole tables


@query
def s15_snapshot_stats(spark, sf_dir):
    return snapshot.stored_stats(spark, fx.root(spark, sf_dir, build=True))


@query
def k1_symbols(spark, sf_dir):
    annotations = F.coalesce(_joined(F.transform("annotations", lambda a: a["name"])), F.lit(""))
    return fx.graph(spark, sf_dir).symbols.select("id", "name", "kind", "scope", "scope_id", "type_ref", "type_name", "file", "line", "end_line", annotations.alias("annotations"))


@query
def k1_chains(spark, sf_dir):
    return fx.graph(spark, sf_dir).chains.select("func_id", _joined("chain").alias("chain"))


@query
def k1_call_records(spark, sf_dir):
    return fx.graph(spark, sf_dir).call_records.select("caller_id", "call_name", "position", _joined("arg_exprs").alias("args"), "line", "condition", "is_loop_body", "effect")


@query
def p4_files(spark, sf_dir):
    return lookup.files(fx.graph(spark, sf_dir).files, "documents/src1/").select("path", "language", "bytes", "lines")


# ---- lookups


@query
def p1_symbol_by_id(spark, sf_dir):
    return lookup.by_id(fx.graph(spark, sf_dir).symbols, fx.SUPPLIER_ID).select("id", "name", "kind", "file")


@query
def p2_resolve_name(spark, sf_dir):
    return lookup.candidates(fx.graph(spark, sf_dir).symbols, fx.PART_NAME.upper()).select("id", "name", "kind")


@query
def p3_resolve_preferred_kind(spark, sf_dir):
    return lookup.candidates(fx.graph(spark, sf_dir).symbols, "q", ("parameter",)).select("id", "kind")


@query
def p5_members(spark, sf_dir):
    return lookup.members(fx.graph(spark, sf_dir).symbols, fx.NATION_ID).select("id", "name", "kind")


@query
def p6_class_targets(spark, sf_dir):
    return lookup.class_targets(fx.graph(spark, sf_dir).symbols)


@query
def p7_methods(spark, sf_dir):
    return lookup.methods(fx.graph(spark, sf_dir).symbols, fx.CUSTOMER_ID).select("id", "name")


@query
def p8_class_members(spark, sf_dir):
    return lookup.class_members(fx.graph(spark, sf_dir).symbols, fx.CUSTOMER_ID)


@query
def p9_function_scope(spark, sf_dir):
    return lookup.function_scope(fx.graph(spark, sf_dir).symbols, fx.ORDER_ID)


@query
def p10_list_classes(spark, sf_dir):
    return lookup.of_kind(fx.graph(spark, sf_dir).symbols, "class", 50, 10).select("id", "name")


@query
def p11_annotations(spark, sf_dir):
    return lookup.annotated(fx.graph(spark, sf_dir).symbols, "promo", "function", 40, 5).select("id", "name")


@query
def p13_markers(spark, sf_dir):
    ids = fx.graph(spark, sf_dir).chains.select(F.explode("chain").alias("id")).filter(markers.is_marker(F.col("id")))
    return ids.groupBy("id").agg(F.count("*").alias("n")).select("id", markers.marker_name(F.col("id")).alias("name"), "n")


# ---- search


@query
def x1_contains(spark, sf_dir):
    return search.by_name(fx.graph(spark, sf_dir).symbols, "Gear", "contains", "function", 30, 5).select("id", "name")


@query
def x1_contains_total(spark, sf_dir):
    return search.matches(fx.graph(spark, sf_dir).symbols, "Gear").agg(F.count("*").alias("total"))


@query
def x2_prefix(spark, sf_dir):
    return search.by_name(fx.graph(spark, sf_dir).symbols, "ORDER_12", "prefix", limit=40).select("id", "name")


@query
def x2_suffix(spark, sf_dir):
    return search.by_name(fx.graph(spark, sf_dir).symbols, "RING", "suffix").select("id", "name")


@query
def x2_exact(spark, sf_dir):
    return search.by_name(fx.graph(spark, sf_dir).symbols, "User_3", "exact").select("id", "name")


@query
def x3_semantic(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    found = search.semantic(g.symbols, g.embeddings, _vector(spark, sf_dir), "function", 10)
    return found.select("id", "name", F.round("similarity", 4).alias("similarity"))


@query
def x4_hybrid(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    found = search.hybrid(g.symbols, g.embeddings, fx.TEXT, _vector(spark, sf_dir), None, 15)
    return found.select("id", "name", F.round("score", 6).alias("score"))


@query
def x6_chains_with_run(spark, sf_dir):
    run = [MARKERS["BRANCH_END"], MARKERS["LOOP"]]
    return search.chains_with(fx.graph(spark, sf_dir).chains, run, 12).select("func_id", F.size("chain").alias("n"))


@query
def x7_chains_from(spark, sf_dir):
    return search.chains_from(fx.graph(spark, sf_dir).chains, [fx.ORDER_ID]).select("func_id", _joined("chain").alias("chain"))


@query
def x8_distinct_chains(spark, sf_dir):
    tails = fx.graph(spark, sf_dir).chains.select("func_id", F.slice("chain", 2, 1 << 30).alias("chain"))
    return search.distinct_chains(tails).select("func_id", _joined("chain").alias("chain"))


# ---- ingest


def _parsed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols as a parser gives them: ids local to each file."""
    return fx.graph(spark, sf_dir).symbols.withColumn("path", F.col("file"))


def _parsed(spark: SparkSession, sf_dir: str):
    """The graph taken apart again: ids local to each file, calls not resolved."""
    g = fx.graph(spark, sf_dir)
    return _parsed_symbols(spark, sf_dir), star.chains(spark, sf_dir, placeholders=True, lines=g.lines), g.call_records


@query
def j1_global_ids(spark, sf_dir):
    return ingest.global_ids(_parsed_symbols(spark, sf_dir))


@query
def j1_remapped_symbols(spark, sf_dir):
    parsed = _parsed_symbols(spark, sf_dir)
    return ingest.remap_symbols(parsed, ingest.global_ids(parsed)).select("id", "name", "kind", "scope_id", "file")


@query
def j2_call_resolution(spark, sf_dir):
    symbols, chains, calls = _parsed(spark, sf_dir)
    return ingest.resolve_calls(symbols, chains, calls)


@query
def j3_class_methods(spark, sf_dir):
    return ingest.class_methods(fx.graph(spark, sf_dir).symbols)


@query
def j4_aliases(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    return ingest.alias_names(g.symbols, g.call_records).filter("alias is not null").select("caller_id", "position", "alias")


@query
def j6_filled_chains(spark, sf_dir):
    symbols, chains, calls = _parsed(spark, sf_dir)
    filled = ingest.fill_placeholders(chains, ingest.resolve_calls(symbols, chains, calls))
    return filled.select("func_id", _joined("chain").alias("chain"))


@query
def g1_edges(spark, sf_dir):
    return fx.graph(spark, sf_dir).edges.select("caller_id", "callee_id", "position", "condition", "effect", "is_loop_body", "is_recursive")


@query
def j8_argument_ids(spark, sf_dir):
    return fx.graph(spark, sf_dir).edges.filter(F.size("arg_ids") > 0).select("caller_id", "callee_id", _joined("arg_ids").alias("arg_ids"))


@query
def a3_call_sites(spark, sf_dir):
    return fx.graph(spark, sf_dir).call_sites.groupBy("name_key").agg(F.count("*").alias("n"), F.countDistinct("caller_id").alias("callers"))


@query
def effects_of_calls(spark, sf_dir):
    texts = star.table(spark, sf_dir, "events").select(F.concat(F.lit("client."), F.initcap("event_type"), F.lit("."), F.element_at(F.array(F.lit("Query"), F.lit("Get("), F.lit("Send"), F.lit("Set"), F.lit("none")), (F.col("event_id") % 5 + 1).cast("int"))).alias("name"))
    found = texts.distinct().withColumn("e", effects.classify(F.col("name")))
    return found.select("name", F.col("e.effect").alias("effect"), F.col("e.effect_desc").alias("rule"))


@query
def text_functions(spark, sf_dir):
    names = fx.graph(spark, sf_dir).call_records.select("call_name").distinct()
    name = F.col("call_name")
    return names.select(
        "call_name", text.short_name(name).alias("short"), text.first_name(name).alias("first"), text.after_first_dot(name).alias("rest"),
        text.negated(name).alias("negated"), text.without_git_prefix(F.concat(F.lit("a/"), name)).alias("path"),
        text.below_root(F.concat(F.lit("/root/"), name), "/root").alias("below"), text.diagram_label(F.concat(F.lit('["'), name)).alias("label"),
    )


@query
def s6_type_references(spark, sf_dir):
    """Variables whose type names a symbol of kind class, by name."""
    symbols = fx.graph(spark, sf_dir).symbols
    classes = symbols.filter("kind = 'class'").groupBy(text.base_type(F.col("name")).alias("base")).agg(F.min("id").alias("class_id"))
    typed = symbols.filter("kind = 'variable' and type_name is not null").select("id", text.base_type(F.col("type_name")).alias("base"))
    return typed.join(classes, "base").select("id", "class_id")


@query
def d5_guard_markers(spark, sf_dir):
    chains = fx.graph(spark, sf_dir).chains
    calls = chains.select("func_id", "chain", F.posexplode("chain").alias("position", "element")).filter("position > 0 and element >= 100")
    return calls.select("func_id", "position", _joined(arrays.guard_markers(F.col("chain"), F.col("position"))).alias("guards"))


@query
def p12_symbols_on_lines(spark, sf_dir):
    lines = fx.diff_tables(spark)[1]
    symbols = fx.graph(spark, sf_dir).symbols
    on = (symbols.file == lines.path) & lines.new_line.between(symbols.line, symbols.end_line)
    return symbols.join(lines, on).groupBy("id").agg(F.count("*").alias("lines"))


@query
def v6_incremental_embedding(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    found = vectors.embed(g.symbols, lambda t: hashed(t, 64), g.embeddings, 64)
    return found.join(g.symbols, found.symbol_id == g.symbols.id).groupBy("kind").agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("dimension"))


@query
def a10_reciprocal_ranks(spark, sf_dir):
    """Symbols by their line in the file and by where they are called first."""
    g = fx.graph(spark, sf_dir)
    by_line = g.symbols.select("id", F.col("line").alias("rank"))
    by_call = g.edges.groupBy(F.col("callee_id").alias("id")).agg(F.min("position").alias("rank"))
    return search.fused([by_line, by_call]).select("id", F.round("score", 6).alias("score"))


@query
def b8_policy_delta(spark, sf_dir):
    """Mocks that one policy calls and the other doesn't."""
    return sandbox.policy_delta(fx.graph(spark, sf_dir), *sandbox.POLICIES, 2)


@query
def b8_diff_simulation(spark, sf_dir):
    """What functions do in a graph without calls of suppliers, and in one without calls of nations."""
    g = fx.graph(spark, sf_dir)
    without = lambda low: g.with_chains(g.chains.select("func_id", F.filter("chain", lambda e, i: (i == 0) | ~e.between(low, 2 * low - 1)).alias("chain")))
    return sandbox.delta(without(star.SUPPLIER), without(star.NATION))


def _sources(spark: SparkSession, sf_dir: str, extension: str, language: str, head: Column, each: Column) -> DataFrame:
    """Source files made of the suppliers of each nation: a head, then a piece for each supplier."""
    rows = star.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(each)), "\n").alias("body"))
    path = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(extension))
    content = F.concat(head, F.lit("\n"), F.col("body"), F.lit("\n")).cast("binary")
    return rows.select(path.alias("path"), F.lit(language).alias("language"), F.octet_length(content).cast("long").alias("bytes"), content.alias("content"), F.lit("ok").alias("status"))


def _python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    method = F.concat(F.lit("    def f"), key, F.lit("(self):\n        store.keep(self)\n        return log.write()"))
    return _sources(spark, sf_dir, ".py", "python", F.concat(F.lit("class N"), F.col("s_nationkey").cast("string"), F.lit(":")), method)


@query
def s4_parsed_sources(spark, sf_dir):
    """What the Python parser finds in generated files."""
    tables = workspace.parse_tables(_python_sources(spark, sf_dir))
    counts = [t.groupBy("path").agg(F.count("*").alias(name)) for name, t in zip(("symbols", "chains", "calls"), tables, strict=False)]
    return counts[0].join(counts[1], "path").join(counts[2], "path")


@query
def s7_impl_methods(spark, sf_dir):
    """Methods of Rust impl blocks, by the definition that they belong to."""
    key = F.col("s_suppkey").cast("string")
    each = F.concat(F.lit("struct S"), key, F.lit(" { a: i32 }\nimpl S"), key, F.lit(" {\n    fn go"), key, F.lit("(&self) { check(self.a); }\n}"))
    symbols = workspace.parse_tables(_sources(spark, sf_dir, ".rs", "rust", F.lit("// made"), each))[0]
    owners = symbols.filter("kind = 'class'").select("path", F.col("id").alias("scope_id"), F.col("name").alias("owner"), F.col("type_name").isNull().alias("of_definition"))
    methods = symbols.filter("kind = 'method'").select("path", F.col("name").alias("method"), "scope_id")
    return methods.join(owners, ["path", "scope_id"]).select("path", "method", "owner", "of_definition")


@query
def s16_configured_effects(spark, sf_dir):
    """Effects of calls in generated files, by a rule of the settings and a default one."""
    settings = config.parse('[[effect_rules]]\neffect = "file_write"\ncall = { prefix = "store." }\n[[effect_rules]]\neffect = "nonsense"\nprefix = "log."\n')
    calls = workspace.parse_tables(_python_sources(spark, sf_dir), settings.effect_rules)[2]
    return calls.groupBy("path", "effect").agg(F.count("*").alias("n"))


@query
def r9_watched_files(spark, sf_dir):
    """Names of the files that a watcher of the folder sees at first."""
    from uuid import uuid4

    from loomgraph.session import shared_folder
    from loomgraph.streaming.watch import watch

    seen: list[str] = []
    watch(spark, sf_dir, seen.extend, f"{shared_folder(spark)}/watch-{uuid4().hex}", once=True).awaitTermination()
    return spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in seen], "name string")


# ---- traversal and flow


@query
def g2_direct_callers(spark, sf_dir):
    return traversal.direct_callers(fx.graph(spark, sf_dir).edges, fx.SUPPLIER_ID)


@query
def g3_callers(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    return traversal.callers(g.symbols, g.edges, fx.SUPPLIER_ID, 2)


@query
def g4_impact(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    return traversal.impact(g.symbols, g.edges, fx.NATION_ID, 4).select("id")


@query
def g3_callers_in_cycles(spark, sf_dir):
    edges = star.transitions(spark, sf_dir).select("caller_id", "callee_id")
    start = star.event_types(spark, sf_dir).agg(F.min("type_id").alias("id"))
    return traversal.reached(edges, start, 3, "callee_id", "caller_id").filter("hop > 0")


@query
def g5_callees(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    return traversal.callees(g.chains, g.symbols, fx.ORDER_ID)


@query
def g6_flow(spark, sf_dir):
    return flow.flow(fx.graph(spark, sf_dir), fx.ORDER_ID).select("position", "element", "description")


@query
def g6_flow_calls(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    return flow.calls(g).select("func_id", "position", "to_id", "to_name", "condition", "effect", "line", _joined("args").alias("args"), "is_loop_body")


@query
def g7_search_flow(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    run = flow.pattern_ids(g.symbols, "BRANCH_END, LOOP")
    return flow.search_flow(g, run).select("func_id", "func_name", _joined("chain").alias("chain"), "match_count")


@query
def g9_call_graph_nodes(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    return traversal.call_graph(g.symbols, g.edges, fx.PART_ID, 2)[0]


@query
def g9_call_graph_edges(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    return traversal.call_graph(g.symbols, g.edges, fx.PART_ID, 2)[1]


@query
def g10_context(spark, sf_dir):
    found = context.context(fx.graph(spark, sf_dir), fx.PART_NAME, 4)
    return found.select("id", "name", "file", _joined("callers").alias("callers"), _joined("callees").alias("callees"))


@query
def g10_context_depth(spark, sf_dir):
    found = context.context(fx.graph(spark, sf_dir), fx.PART_NAME, 4, depth=2)
    return found.select("id", "name", _joined("callers").alias("callers"))


@query
def k8_flow_diagram(spark, sf_dir):
    return render.flow_diagram(flow.described(fx.graph(spark, sf_dir)))


@query
def k6_minimized(spark, sf_dir):
    return render.minimized(fx.graph(spark, sf_dir).symbols).select(F.array_join("symbol", "|", "").alias("symbol"))


# ---- reports


@query
def a1_dependencies(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    return reports.dependencies(g.symbols, g.call_records)


@query
def a2_references(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    return reports.references(g.symbols, g.call_sites, ".COLD WIDGET").select("func_id", "func_name", "file", F.size("call_sites").alias("sites"))


@query
def r4_references_page(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    return reports.references_page(g.symbols, g.call_sites, ".cold widget", 10, 10).select("func_id", "func_name")


@query
def a6_extraction(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    return reports.extraction(g.files, g.symbols, g.chains, g.call_records)


@query
def a7_usage(spark, sf_dir):
    events = star.table(spark, sf_dir, "events")
    size = F.col("value").cast("long")
    audit = events.select(F.col("event_type").alias("tool"), (F.col("event_id") % 7 != 0).alias("ok"), size.alias("answer_bytes"), (size * (F.col("event_id") % 5)).alias("source_bytes"))
    return reports.usage(audit)


@query
def j12_source_bytes(spark, sf_dir):
    files = fx.graph(spark, sf_dir).files
    events = star.table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.concat_ws("/", F.lit("pages"), (F.col("event_id") % 60).cast("string")).alias("path"))
    return reports.source_bytes(events, files)


# ---- vectors


@query
def v1_nearest(spark, sf_dir):
    found = vectors.nearest(fx.graph(spark, sf_dir).embeddings, _vector(spark, sf_dir), 10)
    return found.select("symbol_id", F.round("similarity", 4).alias("similarity"))


@query
def v3_hashing_embedding(spark, sf_dir):
    names = fx.graph(spark, sf_dir).symbols.filter("kind = 'function'").select(F.lower("name").alias("name")).distinct()
    return names.select("name", F.round(F.array_max(hashed(F.col("name"), 64)), 6).alias("largest"))


@query
def v5_symbol_text(spark, sf_dir):
    symbols = fx.graph(spark, sf_dir).symbols
    return symbols.select("id", vectors.symbol_text(symbols).alias("text"))


@query
def j13_without_vector(spark, sf_dir):
    g = fx.graph(spark, sf_dir)
    return vectors.without_vector(g.symbols, g.embeddings).agg(F.count("*").alias("n"), F.min("symbol_id").alias("first"))


@query
def v7_k_means(spark, sf_dir):
    assigned, _ = vectors.k_means(fx.graph(spark, sf_dir).embeddings, 4, 10)
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"))


# ---- diff


def _assessed(spark: SparkSession, sf_dir: str) -> diff.Assessment:
    return diff.assess(fx.graph(spark, sf_dir), *fx.diff_tables(spark))


@query
def d1_diff_lines(spark, sf_dir):
    return fx.diff_tables(spark)[1]


@query
def d3_diff_symbols(spark, sf_dir):
    return _assessed(spark, sf_dir).symbols.select("id", "name", "kind", "file", "change")


@query
def d4_affected_calls(spark, sf_dir):
    return _assessed(spark, sf_dir).affected.select("func_id", "position", "to_id", "to_name", "line", _joined("markers").alias("markers"))


@query
def d6_diff_flows(spark, sf_dir):
    found = _assessed(spark, sf_dir).flows
    return found.select("func_id", "calls", _joined("marker_window").alias("marker_window"), _joined("called_by").alias("called_by"))


@query
def a8_diff_summary(spark, sf_dir):
    return diff.summary(_assessed(spark, sf_dir))


# ---- sandbox


@query
def b4_simulated_sequences(spark, sf_dir):
    traces = sandbox.simulate_each(fx.graph(spark, sf_dir))
    return sandbox.sequences(traces).select("func_id", _joined("sequence").alias("sequence"))


@query
def a11_mock_counts(spark, sf_dir):
    return sandbox.event_counts(sandbox.simulate_each(fx.graph(spark, sf_dir), loop_cap=3, policy="if_false"))


@query
def b2_unmocked(spark, sf_dir):
    mocks = spark.createDataFrame([("red bolt",)], "name string")
    return sandbox.unmocked(fx.graph(spark, sf_dir), fx.CUSTOMER_ID, mocks)
