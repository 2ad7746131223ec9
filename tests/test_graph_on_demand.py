"""Questions pay for the tables that they read; joins hold no table at the driver and gather no key in one task."""

from pyspark.sql import functions as F

from loomgraph import session
from loomgraph.operators import diff, flow, ingest, sandbox
from loomgraph.plans import fixtures as fx
from loomgraph.plans import queries
from loomgraph.plans.tables import GraphOnDemand
from loomgraph.schema import MARKERS
from loomgraph.sources import star
from tests.builders import call, chain, graph, symbol


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_made_when_asked_for_and_once(spark):
    made = []
    g = GraphOnDemand(spark, {"symbols": lambda g: made.append("symbols") or spark.range(3), "chains": lambda g: made.append("chains") or g.symbols})
    assert made == []
    assert g.chains.count() == 3 and g.symbols.count() == 3
    assert made == ["chains", "symbols"]
    other = g.with_chains(spark.range(1))
    assert other.chains.count() == 1 and other.symbols is g.symbols and made == ["chains", "symbols"]


def test_symbols_need_neither_chains_nor_edges(spark, small):
    g = star.graph(spark, small)
    assert g.symbols.count() > 0
    assert set(g._made) == {"lines", "symbols"}


def test_names_of_all_symbols_are_not_broadcast(spark):
    g = graph(spark, [symbol(100, "f"), symbol(101, "g")], [chain(100, 101)])
    assert "BroadcastExchange" not in plan(flow.described(g))


def test_zeros_are_never_looked_up(spark):
    """All symbols have a type_ref of 0 or their own: of the join by it only those with one may be part."""
    rows = spark.createDataFrame([("a", 0), ("a", 7), ("a", 100), ("a", 555)], "path string, type_ref long")
    ids = spark.createDataFrame([("a", 100, 900), ("a", 0, 1)], "path string, local_id long, id long")
    assert sorted(r["type_ref"] for r in ingest._mapped(rows, ids, "type_ref").collect()) == [0, 7, 555, 900]


def test_the_last_record_of_a_place_counts(spark):
    symbols = [symbol(100, "f"), symbol(101, "g"), symbol(102, "x", kind="variable", scope_id=100)]
    calls = [call(100, "g", 2, line=5, condition="late"), call(100, "g", 2, line=3, condition="early"), call(100, "g", 4, args=["x", "y"])]
    g = graph(spark, symbols, [chain(100, MARKERS["LOOP"], 101, MARKERS["LOOP_BACK"], 101)], calls)
    found = {r["position"]: r for r in flow.calls(g).collect()}
    assert found[2]["line"] == 5 and found[4]["args"] == ["x", "y"]
    edge = g.edges.head()
    assert edge["position"] == 4 and edge["arg_ids"] == [102, 0] and edge["condition"] is None
    assert found[2]["condition"] == "late"


def test_names_come_from_the_scope_around_if_the_own_has_none(spark):
    symbols = [symbol(100, "C", kind="class"), symbol(101, "m", kind="method", scope_id=100), symbol(102, "db", kind="field", scope_id=100, type_name="Store")]
    found = ingest.alias_names(graph(spark, symbols).symbols, graph(spark, symbols, calls=[call(101, "db.save", 1), call(101, "no.save", 2), call(101, "plain", 3)]).call_records)
    assert sorted((r["position"], r["alias"]) for r in found.collect()) == [(1, "store.save"), (2, None), (3, None)]


def test_runs_are_compared_where_they_happen(spark, small):
    """Traces of two policies or graphs meet in one task: no event is dealt out, and each chain's elements are read once for both."""
    g = star.graph(spark, small)
    for found in (sandbox.policy_delta(g, *sandbox.POLICIES, 2), sandbox.delta(g, g.with_chains(g.chains))):
        shown = plan(found)
        above = shown[: shown.index("MapInArrow")]  # what comes after the runs
        assert shown.count("MapInArrow") == 1 and "Join" not in above and "Exchange" not in above and "Broadcast" not in shown
    assert found.count() == 0


def test_changes_of_functions_by_name_and_side(spark):
    """Repeats stay, of several functions of a name the first runs, and one that is in one graph only is compared with nothing."""
    symbols = [symbol(100, "f"), symbol(101, "g"), symbol(102, "h"), symbol(103, "f")]
    chains = [chain(100, 101, 101, 102), chain(102, 101), chain(103, 102)]
    g = graph(spark, symbols, chains)
    after = g.with_chains(g.chains.filter("func_id <> 102").selectExpr("func_id", "filter(chain, (e, i) -> i = 0 or e <> 101) chain"))
    found = sorted(tuple(r) for r in sandbox.delta(g, after).collect())
    assert found == [("f", "removed", "call:g"), ("f", "removed", "call:g"), ("h", "removed", "call:g")]


def test_affected_calls_need_no_edges(spark, small):
    g = star.graph(spark, small)
    found = diff.assess(g, *fx.diff_tables(spark))
    assert found.affected.columns and found.symbols.columns and "edges" not in g._made


def test_dependencies_look_up_no_aliases(spark, small):
    assert "map_from_entries" not in plan(queries.a1_dependencies(spark, small))


def test_tasks_follow_the_number_of_rows(spark, monkeypatch):
    """A session's shuffle partitions are the fewest, not the most: else each task's memory grows with the input."""
    rows = spark.range(10)
    assert session.dealt_out(rows, 10, "id").rdd.getNumPartitions() <= 2
    monkeypatch.setattr(session, "ROWS_OF_A_TASK", 2)
    found = session.dealt_out(rows, 10, "id")
    assert found.rdd.getNumPartitions() == 5 and found.count() == 10


def test_aliases_are_looked_up_in_as_many_tasks_as_rows_need(spark, monkeypatch):
    """Own names go ahead of those around, and what asks is not dealt out by (caller, name) for the few scopes around."""
    symbols = [symbol(100, "C", kind="class"), symbol(101, "m", kind="method", scope_id=100), symbol(102, "db", kind="field", scope_id=100, type_name="Store")]
    symbols += [symbol(103, "db", kind="variable", scope_id=101, type_name="Own"), symbol(104, "n", kind="method", scope_id=100), symbol(105, "to", scope_id=100, type_name="T")]
    calls = [call(101, "db.save", 1), call(101, "to.save", 2), call(104, "db.save", 1), call(104, "none.save", 2), call(100, "db.x", 1)]
    g = graph(spark, symbols, calls=calls)
    monkeypatch.setattr(session, "ROWS_OF_A_TASK", 1)
    found = ingest.alias_names(g.symbols, g.call_records)
    assert "hashpartitioning(caller_id" in plan(found) and ", 6)" in plan(found)
    assert sorted((r["caller_id"], r["position"], r["alias"]) for r in found.filter("alias is not null").collect()) == [
        (100, 1, "store.x"), (101, 1, "own.save"), (101, 2, "t.save"), (104, 1, "store.save"),
    ]


def test_calls_meet_the_answers_to_few_questions_by_broadcast(spark, monkeypatch):
    """What calls refer to is the same whether the names that symbols have are few or many; if few, calls are not dealt out by question."""
    symbols = [
        symbol(100, "Store", kind="class"), symbol(101, "save", kind="method", scope_id=100), symbol(102, "f"), symbol(103, "db", kind="variable", scope_id=102, type_name="Old"),
        symbol(104, "old.load", kind="variable"), symbol(105, "a.b", kind="variable"), symbol(109, "b", path="z.ts"), symbol(106, "B"), symbol(107, "", kind="function"),
    ]
    calls = [
        call(102, "x.unknown", 1), call(102, "a.b", 2), call(102, "q.b", 3), call(102, "db.load", 4), call(102, "any", 5, target=("STORE", "Save")),
        call(102, "x.", 6), call(999, "q.B", 1), call(102, "gone", 7, target=("No", "save")),
    ]
    g = graph(spark, symbols, [chain(109, 102, path="z.ts")], calls)
    found = ingest.resolve_calls(g.symbols, g.chains, g.call_records)
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [(102, 2, 105, 2), (102, 3, 108, 3), (102, 4, 104, 4), (102, 5, 101, 1), (999, 1, 108, 3)]
    assert "SortMergeJoin" not in plan(found)
    monkeypatch.setattr(ingest, "FEW_NAMES", 0)
    assert sorted(tuple(r) for r in ingest.resolve_calls(g.symbols, g.chains, g.call_records).collect()) == rows


def test_ids_are_mapped_in_as_many_tasks_as_rows_need(spark, monkeypatch):
    rows = [(f"{i % 3}.ts", i, f"s{i}", i - 3 if i >= 103 else 0) for i in range(100, 120)]
    parsed = graph(spark, [symbol(i, name, path=path, scope_id=scope) for path, i, name, scope in rows]).symbols.withColumn("path", F.col("file"))
    monkeypatch.setattr(session, "ROWS_OF_A_TASK", 3)
    ids = ingest.global_ids(parsed)
    new = {(r["path"], r["local_id"]): r["id"] for r in ids.collect()}
    assert [new[key] for key in sorted(new)] == list(range(100, 120))
    found = ingest.remap_symbols(parsed, ids)
    assert "hashpartitioning(path" in plan(found) and ", 7)" in plan(found)
    old = {new[r["file"], r["id"]]: (r["name"], new.get((r["file"], r["scope_id"]), r["scope_id"])) for r in parsed.collect()}
    assert {r["id"]: (r["name"], r["scope_id"]) for r in found.collect()} == old
