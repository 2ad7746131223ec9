"""A star schema of sales and events, read as a graph.

Customers, orders, parts, suppliers, nations and regions become symbols whose chains lead
from one to the next; order lines become call records; users' events become chains over
event types, with a cyclic graph of the types' transitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.effects import classify
from loomgraph.operators import ingest
from loomgraph.plans.tables import GraphOnDemand
from loomgraph.schema import EMBEDDINGS, FILES, MARKERS, SYMBOLS
from loomgraph.session import dealt_out, materialize

REGION, NATION, EVENT_TYPE = 100, 1_000, 500
SUPPLIER, CUSTOMER, PART, ORDER, USER = 1_000_000, 2_000_000, 10_000_000, 20_000_000, 40_000_000
#: Each order has a variable `v`, typed by the supplier of its first line, and a parameter `q`.
VARIABLE, PARAMETER = 60_000_000, 80_000_000
#: The order of an order's lines; line numbers alone are not unique.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _symbol(df: DataFrame, base: int, key: str, name: Column, kind: str, **more: Column) -> DataFrame:
    number = F.col(key).cast("long")
    line = (number % 1000 * 10 + 1).cast("int")
    values = {
        "id": number + base,
        "name": name,
        "kind": F.lit(kind),
        "scope": F.lit("global"),
        "scope_id": F.lit(0).cast("long"),
        "type_ref": F.lit(0).cast("long"),
        "line": line,
        "end_line": line + 8,
        "language": F.lit("star"),
    } | more
    return df.select(
        *(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SYMBOLS.fields)
    )


def _annotations(*names: str) -> Column:
    none = F.lit(None).cast("map<string,string>")
    return F.array(*(F.struct(F.col(n).alias("name"), none.alias("args"), F.lit(1).alias("line")) for n in names))


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, type_id): a handful of rows, numbered by name."""
    names = table(spark, sf_dir, "events").select("event_type").filter("event_type is not null").distinct()
    return names.withColumn("type_id", F.row_number().over(Window.orderBy("event_type")) + F.lit(EVENT_TYPE).cast("long"))


def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their number in the order and the position of their part in its chain; what all else of lines is made of."""
    kept = dict.fromkeys((*LINE_ORDER, "l_orderkey", "l_linestatus", "l_quantity"))
    before = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    nested = F.col("l_returnflag").isin("R", "A").cast("int")
    place = F.coalesce(F.sum(nested * 2 + 1).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + nested + 1
    read = table(spark, sf_dir, "lineitem").select(*kept)
    rows = dealt_out(read, read.count(), "l_orderkey").withColumns({"nth": F.row_number().over(before), "position": place.cast("int")})
    return rows.drop("l_extendedprice", "l_shipdate")


def symbols(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    nation_of = lambda key: F.col(key).cast("long") + NATION
    own = F.lit("object_field")
    orders = dealt_out(t("orders"), t("orders").count(), "o_orderkey")
    parts = [
        _symbol(t("region"), REGION, "r_regionkey", F.col("r_name"), "module", file=F.lit("geo")),
        _symbol(t("nation"), NATION, "n_nationkey", F.col("n_name"), "module", file=F.lit("geo"), scope=own, scope_id=F.col("n_regionkey").cast("long") + REGION),
        _symbol(t("supplier"), SUPPLIER, "s_suppkey", F.col("s_name"), "class", file=F.lit("supplier"), scope=own, scope_id=nation_of("s_nationkey")),
        _symbol(
            t("customer"), CUSTOMER, "c_custkey", F.col("c_name"), "class", file=F.col("c_mktsegment"), scope=own,
            scope_id=nation_of("c_nationkey"), annotations=_annotations("c_mktsegment"),
        ),
        _symbol(t("part"), PART, "p_partkey", F.col("p_name"), "function", file=F.col("p_brand"), annotations=_annotations("p_type", "p_brand")),
        _symbol(
            t("orders"), ORDER, "o_orderkey", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), "method", scope=own,
            file=F.col("o_orderpriority"), scope_id=F.col("o_custkey") + CUSTOMER, annotations=_annotations("o_orderstatus"),
        ),
        _symbol(
            orders.join(_first_suppliers(spark, sf_dir, lines), "o_orderkey", "left"), VARIABLE, "o_orderkey", F.lit("v"), "variable",
            scope=F.lit("local"), scope_id=F.col("o_orderkey") + ORDER, file=F.col("o_orderpriority"), type_name=F.col("type_name"),
        ),
        _symbol(
            t("orders"), PARAMETER, "o_orderkey", F.lit("q"), "parameter", scope=F.lit("parameter"), scope_id=F.col("o_orderkey") + ORDER,
            file=F.col("o_orderpriority"), type_name=F.lit("Integer"),
        ),
        _symbol(event_types(spark, sf_dir), 0, "type_id", F.col("event_type"), "function", file=F.lit("events")),
        _symbol(t("events").select("user_id").distinct(), USER, "user_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")), "function", file=F.lit("events")),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _first_suppliers(spark: SparkSession, sf_dir: str, lines: DataFrame | None) -> DataFrame:
    """(o_orderkey, type_name): the supplier's name of each order's first line."""
    lines = ordered_lines(spark, sf_dir) if lines is None else lines
    first = lines.filter("nth = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    return first.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("type_name")), "s_suppkey").drop("s_suppkey")


def _ordered(df: DataFrame, owner: Column, order: list[Column], elements: Column, collect=F.collect_list) -> DataFrame:
    """(func_id, chain): the owner, then the elements of its rows in order.

    Rows are dealt out as they are: arrays of them would take several times the space on the way.
    """
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    dealt = dealt_out(df.withColumn("func_id", owner), df.count(), "func_id")
    grouped = dealt.groupBy("func_id").agg(F.array_sort(collect(F.struct(*keys, elements.alias("e")))).alias("rows"))
    chain = F.flatten(F.concat(F.array(F.array("func_id")), F.transform("rows", lambda r: r["e"])))
    return grouped.select("func_id", chain.alias("chain"))


def _ids(*values: Column | int) -> Column:
    return F.array(*((v if isinstance(v, Column) else F.lit(v)).cast("long") for v in values))


def line_elements(part: Column) -> Column:
    """What a line adds to its order's chain: returned parts in a branch, accepted ones in a loop."""
    return (
        F.when(F.col("l_returnflag") == "R", _ids(MARKERS["IF_TRUE"], part, MARKERS["BRANCH_END"]))
        .when(F.col("l_returnflag") == "A", _ids(MARKERS["LOOP"], part, MARKERS["LOOP_BACK"]))
        .otherwise(_ids(part))
    )


def chains(spark: SparkSession, sf_dir: str, placeholders: bool = False, lines: DataFrame | None = None) -> DataFrame:
    """Chains of all symbols that have one; with placeholders, calls of orders are not resolved yet."""
    t = lambda name: table(spark, sf_dir, name)
    lines = ordered_lines(spark, sf_dir) if lines is None else lines
    orders, events = t("orders").select("o_orderkey", "o_custkey"), t("events").select("event_id", "ts", "user_id", "event_type")
    part = F.lit(0).cast("long") if placeholders else F.col("l_partkey") + PART
    typed = events.join(F.broadcast(event_types(spark, sf_dir)), "event_type")
    of_event = F.when(F.col("event_type") == "error", _ids(MARKERS["THROW"], F.col("type_id"))).otherwise(_ids(F.col("type_id")))
    found = [
        _ordered(orders, F.col("o_custkey") + CUSTOMER, [F.col("o_orderkey")], _ids(F.col("o_orderkey") + ORDER)),
        _ordered(lines.select("l_orderkey", "nth", "l_partkey", "l_returnflag"), F.col("l_orderkey") + ORDER, [F.col("nth")], line_elements(part)),
        _ordered(
            lines.select("l_partkey", "l_suppkey"), F.col("l_partkey") + PART, [F.col("l_suppkey")], _ids(F.col("l_suppkey") + SUPPLIER), F.collect_set
        ),
        t("supplier").select((F.col("s_suppkey") + SUPPLIER).alias("func_id"), _ids(F.col("s_suppkey") + SUPPLIER, F.col("s_nationkey") + NATION).alias("chain")),
        t("nation").select((F.col("n_nationkey").cast("long") + NATION).alias("func_id"), _ids(F.col("n_nationkey") + NATION, F.col("n_regionkey") + REGION).alias("chain")),
        _ordered(typed, F.col("user_id") + USER, [F.col("ts"), F.col("event_id")], of_event),
    ]
    all_chains = found[0]
    for more in found[1:]:
        all_chains = all_chains.unionByName(more)
    return all_chains


def call_records(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """One record for each order line, at the position of its part in the order's chain."""
    placed = ordered_lines(spark, sf_dir) if lines is None else lines
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    named = placed.join(parts, placed.l_partkey == parts.p_partkey).join(suppliers, placed.l_suppkey == suppliers.s_suppkey)
    receiver = F.when(F.col("l_returnflag") == "A", F.lit("v")).when(F.col("l_linestatus") == "O", F.col("s_name")).otherwise(F.col("p_brand"))
    call_name = F.concat(receiver, F.lit("."), F.col("p_name"))
    quantity = F.col("l_quantity").cast("int").cast("string")
    named = named.withColumn("call_name", call_name).withColumn("found", classify(F.col("call_name")))
    text = F.lit(None).cast("string")
    return named.select(
        (F.col("l_orderkey") + ORDER).alias("caller_id"),
        "call_name",
        "position",
        F.when(F.col("l_returnflag") == "A", F.array(F.lit("v"), F.lit("q"), quantity)).otherwise(F.array(quantity)).alias("arg_exprs"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.when(F.col("l_returnflag") == "R", F.lit("returned")).alias("condition"),
        (F.col("l_returnflag") == "A").alias("is_loop_body"),
        F.col("found.effect").alias("effect"),
        F.col("found.effect_desc").alias("effect_desc"),
        text.alias("target_class"),
        text.alias("target_method"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as files."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    size = lambda text: (F.octet_length(text).cast("long"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int"))
    doc_bytes, doc_lines = size(F.col("text"))
    page_bytes, page_lines = size(F.col("html"))
    found = docs.select(F.concat_ws("/", F.lit("documents"), "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), doc_bytes.alias("bytes"), doc_lines.alias("lines"))
    more = pages.select(F.concat_ws("/", F.lit("pages"), F.col("page_id").cast("string")).alias("path"), F.lit("html").alias("language"), page_bytes.alias("bytes"), page_lines.alias("lines"))
    return found.unionByName(more).select(*FILES.names)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of parts, by key."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select((F.col("vec_id") + PART).alias("symbol_id"), F.col("embedding").cast("array<float>").alias("vector")).select(*EMBEDDINGS.names)


def graph(spark: SparkSession, sf_dir: str) -> GraphOnDemand:
    """The whole graph, with resolved chains; what is read more than once is written when it is first asked for."""
    kept = lambda df: materialize(df, passing=False)
    return GraphOnDemand(
        spark,
        {
            "lines": lambda g: kept(ordered_lines(spark, sf_dir)),
            "symbols": lambda g: kept(symbols(spark, sf_dir, g.lines)),
            "chains": lambda g: kept(chains(spark, sf_dir, lines=g.lines)),
            "call_records": lambda g: kept(call_records(spark, sf_dir, g.lines)),
            "call_sites": lambda g: ingest.call_sites(g.symbols, g.call_records),
            "edges": lambda g: kept(ingest.edges(g.symbols, g.chains, g.call_records)),
            "files": lambda g: files(spark, sf_dir),
            "embeddings": lambda g: embeddings(spark, sf_dir),
        },
    )


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller_id, callee_id, n): which event type follows which; a graph with cycles and self-loops."""
    events = table(spark, sf_dir, "events").join(F.broadcast(event_types(spark, sf_dir)), "event_type")
    following = F.lead("type_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = events.select(F.col("type_id").alias("caller_id"), following.alias("callee_id")).filter("callee_id is not null")
    return pairs.groupBy("caller_id", "callee_id").agg(F.count("*").alias("n"))
