"""From parsed files to a graph: global ids, resolved calls, edges and call sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.markers import is_symbol
from loomgraph.functions.text import after_first_dot, first_name, short_name
from loomgraph.plans.tables import Graph
from loomgraph.schema import CALL_RECORDS, CALL_SITES, CALLABLE_KINDS, EDGES, FILES, FIRST_SYMBOL_ID, SYMBOLS
from loomgraph.session import dealt_out, dense_ids, materialize

#: So many names meet calls by broadcast; if more are called, calls and symbols meet in joins.
FEW_NAMES = 100_000

#: What speaks for one of several symbols of the called name.
OVERRIDE_SCORE, CHAIN_SCORE, CALLABLE_SCORE, SAME_FILE_SCORE = 10, 5, 4, 3


def global_ids(parsed: DataFrame) -> DataFrame:
    """(path, local_id, id): ids from 100 on, by path and then local id."""
    local = parsed.select("path", F.col("id").alias("local_id"))
    return dense_ids(local, ["path", "local_id"], "id", FIRST_SYMBOL_ID).select("path", "local_id", "id")


def _mapped(df: DataFrame, ids: DataFrame, column: str, rows: int = 0) -> DataFrame:
    """Replace a file-local id by the global one; ids that are no symbol's stay. The rows are dealt out as `rows` rows need it.

    Zeros and markers are a few values on many rows, and are never looked up: they would gather in one task.
    """
    found = ids.select("path", F.col("local_id").alias(column), F.col("id").alias("new_id"))
    known = F.coalesce(is_symbol(F.col(column)), F.lit(False))
    mapped = dealt_out(df.filter(known), rows, "path", column).join(found, ["path", column], "left").withColumn(column, F.coalesce("new_id", column))
    return mapped.select(*df.columns).unionByName(df.filter(~known))


def remap_symbols(parsed: DataFrame, ids: DataFrame) -> DataFrame:
    rows = ids.count()
    renamed = dealt_out(parsed.withColumnRenamed("id", "local_id"), rows, "path", "local_id").join(ids, ["path", "local_id"]).drop("local_id")
    return _mapped(_mapped(renamed, ids, "scope_id", rows), ids, "type_ref", rows).select(*SYMBOLS.names)


def remap_chains(parsed: DataFrame, ids: DataFrame) -> DataFrame:
    """Chains with global owner and elements; markers and placeholders stay."""
    n = ids.count()
    rows = _mapped(parsed.withColumnRenamed("func_id", "owner"), ids, "owner", n)
    elements = rows.select("path", "owner", F.posexplode("chain").alias("pos", "element"))
    return _collected(_mapped(elements, ids, "element", n), "owner", "element")


def remap_calls(parsed: DataFrame, ids: DataFrame) -> DataFrame:
    return _mapped(parsed, ids, "caller_id", ids.count()).select(*CALL_RECORDS.names)


def _collected(elements: DataFrame, owner: str, element: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col(element).alias("e"))))
    return elements.groupBy(F.col(owner).alias("func_id")).agg(F.transform(rows, lambda r: r["e"]).alias("chain"))


def class_methods(symbols: DataFrame) -> DataFrame:
    """(class_name, method_name, id): lower-case names of classes and their methods; the first by class and method id."""
    classes = symbols.filter(F.col("kind").isin("class", "interface")).select(F.lower("name").alias("class_name"), F.col("id").alias("class_id"))
    methods = symbols.filter(F.col("kind").isin(*CALLABLE_KINDS)).select(F.lower("name").alias("method_name"), F.col("id"), F.col("scope_id").alias("class_id"))
    pairs = classes.join(methods, "class_id")
    return pairs.groupBy("class_name", "method_name").agg(F.min_by("id", F.struct("class_id", "id")).alias("id"))


def visible_names(symbols: DataFrame, named: DataFrame, asked: DataFrame, value: Column, rows: int) -> DataFrame:
    """(caller_id, names): a map from the names that callers ask for (caller_id, name) to their values.

    A name is looked up among the named symbols in the caller's scope, then in the scope around the caller; `value`
    is taken of all symbols of one name in a scope. Maps hold all names of the caller's scope and what was asked
    of the one around it. Thus what asks is dealt out by caller only. Names are dealt out as `rows` rows need it.
    """
    dealt = dealt_out(named.filter("scope_id <> 0 and name is not null").select("scope_id", "name", "id", "type_name"), rows, "scope_id")
    values = dealt.groupBy("scope_id", "name").agg(value.alias("value"))
    as_map = lambda name: F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias(name)
    callers = asked.select("caller_id").distinct()
    mine = values.withColumnRenamed("scope_id", "caller_id").join(callers, "caller_id", "left_semi")
    own = mine.groupBy("caller_id").agg(as_map("own"))
    around = values.withColumnRenamed("scope_id", "outer_id")
    # Few callers are defined in a scope that has names. Both tables are written, so that it is known how few: then
    # neither what asks nor the names are dealt out for them.
    outer = symbols.filter("scope_id <> 0").select(F.col("id").alias("caller_id"), F.col("scope_id").alias("outer_id"))
    scopes = dealt.select(F.col("scope_id").alias("outer_id")).distinct()
    outer = dealt_out(outer.join(scopes, "outer_id", "left_semi"), rows, "caller_id").distinct()
    outer = materialize(outer.join(callers, "caller_id"))  # callers are distinct; a semi-join would be made before dealing out
    further = materialize(asked.select("caller_id", "name").filter("name is not null").join(outer, "caller_id").distinct())
    beyond = further.join(around, ["outer_id", "name"]).groupBy("caller_id").agg(as_map("beyond"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{values.schema['value'].dataType.simpleString()}>"))
    found = own.join(beyond, "caller_id", "full").select("caller_id", F.coalesce("own", none).alias("own"), F.coalesce("beyond", none).alias("beyond"))
    hidden = F.map_filter("beyond", lambda name, _: ~F.map_contains_key("own", name))
    return found.select("caller_id", F.map_concat("own", hidden).alias("names"))


def alias_names(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """calls with `alias`: what the call is named by the type of the variable before its first dot, if it has one.

    The variable is looked up in the caller's scope, then in the scope around the caller.
    """
    variable = first_name(F.col("call_name"))
    rows = max(symbols.count(), calls.count())  # of both, so that names lie where the calls are
    asked = calls.select("caller_id", variable.alias("name"))
    types = visible_names(symbols, symbols.filter("type_name is not null"), asked, F.min_by("type_name", "id"), rows)
    alias = F.concat(F.lower(F.try_element_at("names", variable)), F.lit("."), F.lower(after_first_dot(F.col("call_name"))))
    return dealt_out(calls, rows, "caller_id").join(types, "caller_id", "left").withColumn("alias", alias).drop("names")


def resolve_calls(symbols: DataFrame, chains: DataFrame, calls: DataFrame) -> DataFrame:
    """(caller_id, position, callee_id, step): what calls refer to; the first step that finds anything counts.

    1: the method of the class that the call hints at. 2: any symbol of the call's name.
    3: a function or method of the name after the last dot. 4: any symbol of the name by the
    variable's type. Of several symbols of one step the best-scored counts, then the
    smallest id. Names compare in lower case. A call at a position that has several keeps one.
    """
    # What a call refers to depends on its names and the caller's file only: each such question is
    # answered once, and calls meet the answers in one join.
    wanted = alias_names(symbols, calls.select("caller_id", "position", "call_name", "target_class", "target_method"))
    caller_file = symbols.select(F.col("id").alias("caller_id"), F.col("file").alias("caller_file"))
    wanted = wanted.join(caller_file, "caller_id", "left").withColumns({
        "full": F.lower("call_name"),
        "short": F.lower(short_name(F.col("call_name"))),
        "class_name": F.lower("target_class"),
        "method_name": F.lower("target_method"),
    })
    question = ["caller_file", "full", "short", "alias", "class_name", "method_name"]
    # Read by each step below: computed once.
    wanted = materialize(wanted.select("caller_id", "position", *question))
    wanted_rows = wanted.count()
    # Names that no symbol has are as good as none. If few are left, so are questions, and symbols to choose from.
    called = wanted.select(F.explode(F.array_distinct(F.array("full", "short", "alias"))).alias("key")).distinct()
    known = called.join(symbols.select(F.lower("name").alias("key")).distinct(), "key", "left_semi").filter("key <> ''")
    candidates, known = symbols, materialize(known)
    if _few(known):
        for name in ("full", "short", "alias"):
            on = F.col(name) == F.col("known.key")
            wanted = wanted.join(F.broadcast(known.alias("known")), on, "left").withColumn(name, F.col("known.key")).drop("key")
        candidates = _named(symbols, known)
    asked = materialize(wanted.select(*question).distinct())

    overrides = F.exists("annotations", lambda a: a["name"] == "Override")
    owners = chains.select(F.col("func_id").alias("id"), F.lit(CHAIN_SCORE).alias("chain_score"))
    callable_ = F.col("kind").isin(*CALLABLE_KINDS)
    scored = candidates.join(owners, "id", "left").select(
        F.lower("name").alias("key"),
        "id",
        "file",
        callable_.alias("callable"),
        (
            F.coalesce(F.when(overrides, OVERRIDE_SCORE), F.lit(0))
            + F.coalesce("chain_score", F.lit(0))
            + F.when(callable_, CALLABLE_SCORE).otherwise(0)
        ).alias("score"),
    )
    best_in_file = scored.groupBy("key", "file").agg(_best("score"), _best("score", callable_only=True))
    best = scored.groupBy("key").agg(_best("score"), _best("score", callable_only=True))

    def pick(key: str, only: str) -> DataFrame:
        """For each (name, caller's file): the best symbol, one in the file ahead by its bonus."""
        names = asked.select(F.col(key).alias("key"), F.col("caller_file").alias("file")).filter("key is not null and key <> ''").distinct()
        near = best_in_file.select("key", "file", F.col(only).alias("near"))
        far = best.select("key", F.col(only).alias("far"))
        found = names.join(far, "key").filter("far is not null").join(near, ["key", "file"], "left")
        # A bonus for the caller's own file can only lift that file's best symbol.
        ahead = F.col("near.score") + SAME_FILE_SCORE
        wins = (ahead > F.col("far.score")) | ((ahead == F.col("far.score")) & (F.col("near.id") < F.col("far.id")))
        choice = F.when(F.col("near").isNotNull() & wins, F.col("near.id")).otherwise(F.col("far.id"))
        return found.select(F.col("key").alias(f"{key}_key"), F.col("file").alias(f"{key}_file"), choice.alias(f"by_{key}"))

    hint_known = F.col("class_name").isNotNull() & F.col("method_name").isNotNull()
    hints = materialize(asked.filter(hint_known).select(F.explode(F.array("class_name", "method_name")).alias("key")).distinct())
    hinted = class_methods(_named(symbols, hints) if _few(hints) else symbols).select("class_name", "method_name", F.col("id").alias("by_hint"))
    answers = _left_where(asked, hint_known, hinted.withColumnsRenamed({"class_name": "c", "method_name": "m"}), "class_name = c and method_name = m").drop("c", "m")
    for key, only in (("full", "any"), ("short", "callable"), ("alias", "any")):
        found = pick(key, only)
        on = (F.col(key) == F.col(f"{key}_key")) & F.col("caller_file").eqNullSafe(F.col(f"{key}_file"))
        # Most calls have no alias, all have names.
        answers = _left_where(answers, F.col(key).isNotNull(), found, on) if key == "alias" else answers.join(found, on, "left")
        answers = answers.drop(f"{key}_key", f"{key}_file")
    steps = ("by_hint", "by_full", "by_short", "by_alias")
    step = F.coalesce(*(F.when(F.col(s).isNotNull(), F.lit(i + 1)) for i, s in enumerate(steps)))
    # Written, so that Spark knows how few there are: then calls are not dealt out by question.
    answers = materialize(answers.select(*question, F.coalesce(*steps).alias("callee_id"), step.alias("step")).filter("callee_id is not null"))
    same = reduce(Column.__and__, (F.col(f"w.{c}").eqNullSafe(F.col(f"a.{c}")) for c in question))
    resolved = wanted.alias("w").join(answers.alias("a"), same).select("caller_id", "position", "callee_id", "step")
    return dealt_out(resolved, wanted_rows, "caller_id", "position").groupBy("caller_id", "position").agg(
        F.min("callee_id").alias("callee_id"), F.min_by("step", "callee_id").alias("step")
    )


def _few(names: DataFrame) -> bool:
    return names.limit(FEW_NAMES + 1).count() <= FEW_NAMES


def _named(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Symbols of these few names (key) in lower case."""
    return symbols.join(F.broadcast(names), F.lower(symbols["name"]) == names["key"], "left_semi")


def _left_where(rows: DataFrame, known: Column, table: DataFrame, on: Column | str) -> DataFrame:
    """A left join in which only rows with known keys are shuffled: those without can't gather in one task."""
    on = F.expr(on) if isinstance(on, str) else on
    rest = rows.filter(~known).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema))
    return rows.filter(known).join(table, on, "left").unionByName(rest)


def _best(score: str, callable_only: bool = False) -> Column:
    rank = F.struct(-F.col(score), F.col("id"))
    if callable_only:
        rank = F.when(F.col("callable"), rank)
    row = F.struct(F.col("id").alias("id"), F.col(score).alias("score"))
    return F.min_by(row, rank).alias("callable" if callable_only else "any")


def fill_placeholders(chains: DataFrame, resolved: DataFrame) -> DataFrame:
    """Chains in which the zeros at positions of resolved calls are replaced; nothing else changes."""
    elements = chains.select("func_id", F.posexplode("chain").alias("pos", "element"))
    calls = resolved.select(F.col("caller_id").alias("func_id"), F.col("position").alias("pos"), "callee_id")
    filled = elements.join(calls, ["func_id", "pos"], "left").withColumn(
        "element", F.when(F.col("element") == 0, F.coalesce("callee_id", "element")).otherwise(F.col("element"))
    )
    return _collected(filled, "func_id", "element")


def with_records(elements: DataFrame, records: DataFrame, columns: list[str], edges: DataFrame | None = None) -> DataFrame:
    """Elements (caller_id, position, element, ...) with `record`: these columns of the record at their place, or null.

    Of several records at a place the one whose name and line sort last counts. With edges (caller_id, element, edge)
    also `edge`: that of the caller and element. All are dealt out by caller, once; then each element reads what
    sorts just before it.
    """
    record = F.struct(*dict.fromkeys(["call_name", "line", *columns]))
    rows = elements.withColumn("what", F.lit(2))
    rows = rows.unionByName(records.select("caller_id", "position", F.lit(1).alias("what"), record.alias("record")), allowMissingColumns=True)
    if edges is not None:
        rows = rows.unionByName(edges.select("caller_id", "element", F.lit(0).alias("what"), "edge"), allowMissingColumns=True)
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = so_far(Window.partitionBy("caller_id", "position").orderBy("what", "record.call_name", "record.line"))
    found = rows.repartition("caller_id").withColumn("record", F.last("record", ignorenulls=True).over(place)).filter("what <> 1")
    if edges is not None:
        pair = so_far(Window.partitionBy("caller_id", "element").orderBy("what"))
        found = found.withColumn("edge", F.last("edge", ignorenulls=True).over(pair)).filter("what = 2")
    return found.drop("what")


def edges(symbols: DataFrame, chains: DataFrame, records: DataFrame) -> DataFrame:
    """One edge for each caller and callee, described by the call at the last position.

    Its arguments are the symbols that they name, in the caller's scope or the one around it, or 0.
    """
    elements = chains.select(F.col("func_id").alias("caller_id"), F.posexplode("chain").alias("position", "element"))
    elements = elements.filter((F.col("position") >= 1) & is_symbol(F.col("element")))
    columns = ["condition", "effect", "effect_desc", "arg_exprs", "is_loop_body"]
    last = F.max_by(F.struct("position", "record"), "position").alias("last")
    described = with_records(elements, records, columns).groupBy("caller_id", F.col("element").alias("callee_id")).agg(last)
    asked = records.select("caller_id", F.explode("arg_exprs").alias("name"))
    described = described.join(visible_names(symbols, symbols, asked, F.min("id"), symbols.count()), "caller_id", "left")
    record = F.col("last.record")
    known = lambda expr: F.coalesce(F.try_element_at("names", expr), F.lit(0).cast("long"))
    return described.select(
        "caller_id",
        "callee_id",
        "last.position",
        record["condition"].alias("condition"),
        F.coalesce(record["effect"], F.lit("none")).alias("effect"),
        record["effect_desc"].alias("effect_desc"),
        F.coalesce(F.transform(record["arg_exprs"], known), F.array().cast("array<bigint>")).alias("arg_ids"),
        F.coalesce(record["is_loop_body"], F.lit(False)).alias("is_loop_body"),
        (F.col("caller_id") == F.col("callee_id")).alias("is_recursive"),
    ).select(*EDGES.names)


def call_sites(symbols: DataFrame, records: DataFrame) -> DataFrame:
    """Each record under its lower-case name and, if it has another, its name by the variable's type."""
    named = alias_names(symbols, records).withColumn("raw", F.lower("call_name"))
    keys = F.when(F.col("alias").isNotNull() & (F.col("alias") != F.col("raw")), F.array("raw", "alias")).otherwise(F.array("raw"))
    return named.withColumn("name_key", F.explode(keys)).select(*CALL_SITES.names)


def build(parsed_symbols: DataFrame, parsed_chains: DataFrame, parsed_calls: DataFrame, files: DataFrame) -> Graph:
    """The graph of parsed files, whose ids are local to their file."""
    ids = materialize(global_ids(parsed_symbols))
    symbols = materialize(remap_symbols(parsed_symbols, ids))
    chains, calls = remap_chains(parsed_chains, ids), materialize(remap_calls(parsed_calls, ids))
    chains = materialize(fill_placeholders(chains, resolve_calls(symbols, chains, calls)))
    return Graph(
        symbols=symbols,
        chains=chains,
        call_records=calls,
        call_sites=call_sites(symbols, calls),
        edges=edges(symbols, chains, calls),
        files=files.select(*FILES.names),
    )
