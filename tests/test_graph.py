"""Ingest, lookup, search, traversal and flow on graphs made by hand."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import flow, ingest, lookup, reports, search, traversal, vectors
from loomgraph.schema import MARKERS
from loomgraph.sources import snapshot
from tests.builders import call, chain, graph, symbol

M = MARKERS


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


@pytest.fixture(scope="module")
def basic(spark):
    return graph(spark, [symbol(100, "a"), symbol(101, "b"), symbol(102, "c")], [chain(100, 101), chain(101, M["IF_TRUE"], 102, M["BRANCH_END"])])


def test_basic(spark, basic, tmp_path):
    assert rows(traversal.callees(basic.chains, basic.symbols, 100), "name") == [("b",)]
    assert rows(traversal.callers(basic.symbols, basic.edges, 102, 1), "id") == [(101,)]
    assert sorted(rows(traversal.callers(basic.symbols, basic.edges, 102, 2))) == [(100, 2), (101, 1)]
    assert rows(flow.flow(basic, 101), "description") == [("b",), ("IF_TRUE",), ("c",), ("BRANCH_END",)]
    root = str(tmp_path / "snap")
    assert snapshot.write(basic, root) == 1
    assert tuple(snapshot.stored_stats(spark, root).head()) == (3, 2, 2, 1, 103)
    assert snapshot.write(basic, root) == 2
    assert snapshot.current(spark, root) == (2, 103)
    assert snapshot.read(spark, root).edges.count() == 2


def test_no_snapshot(spark, tmp_path):
    assert snapshot.current(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        snapshot.read(spark, str(tmp_path / "none"))


def test_placeholders_are_filled(spark):
    g = graph(spark, [symbol(100, "f"), symbol(101, "g"), symbol(102, "h")], [chain(100, 0, 0)], [call(100, "g", 1), call(100, "h", 2, line=2)])
    assert rows(g.chains, "chain") == [([100, 101, 102],)]


def test_unresolved_call(spark):
    g = graph(spark, [symbol(100, "f")], [chain(100, 0)], [call(100, "fmt.Println", 1, args=["msg"], line=7, effect="log")])
    assert [r[1] for r in rows(flow.flow(g, 100), "position", "description")] == ["f", "fmt.Println"]
    (found,) = flow.calls(g).collect()
    assert (found.to_id, found.to_name, found.line, found.effect, found.args) == (None, "fmt.Println", 7, "log", ["msg"])
    assert rows(traversal.callees(g.chains, g.symbols, 100)) == []
    assert [(r.func_name, len(r.call_sites)) for r in reports.references(g.symbols, g.call_sites, "PRINTLN").collect()] == [("f", 1)]


def test_duplicate_names(spark):
    g = graph(spark, [symbol(100, "process", "a.ts"), symbol(100, "process", "b.ts")])
    found = lookup.resolve(g.symbols, "PROCESS")
    assert found.ambiguous and [m["id"] for m in found.matches] == [100, 101]
    assert lookup.resolve(g.symbols, "process", 101).symbol["file"] == "b.ts"
    with pytest.raises(LookupError):
        lookup.resolve(g.symbols, "Process", 101)
    with pytest.raises(LookupError):
        lookup.resolve(g.symbols, "nothing")


def test_ids_are_dense_over_files(spark):
    g = graph(spark, [symbol(100, "x", "b.ts"), symbol(101, "y", "b.ts", scope_id=100), symbol(100, "z", "a.ts")])
    assert sorted(rows(g.symbols, "id", "name", "scope_id")) == [(100, "z", 0), (101, "x", 0), (102, "y", 101)]


def test_loop_and_pattern(spark):
    g = graph(spark, [symbol(100, "f"), symbol(101, "validate"), symbol(102, "save")], [chain(100, M["LOOP"], 101, 102, M["LOOP_BACK"])])
    assert [d for (d,) in rows(flow.flow(g, 100), "description")] == ["f", "LOOP", "validate", "save", "LOOP_BACK"]
    assert flow.pattern_ids(g.symbols, "LOOP, validate") == [1, 101]
    assert rows(flow.search_flow(g, [1, 101]), "func_name", "match_count") == [("f", 1)]
    assert rows(flow.search_flow(g, [101, 1])) == []
    assert rows(flow.search_flow(g, [])) == []
    with pytest.raises(ValueError):
        flow.pattern_ids(g.symbols, " , ")


def test_resolution_steps_and_scores(spark):
    symbols = [
        symbol(100, "caller", "a.ts"), symbol(101, "run", "a.ts", kind="variable"), symbol(102, "svc", "a.ts", kind="variable", scope_id=100, type_name="Service"),
        symbol(100, "run", "b.ts"), symbol(101, "run", "b.ts", annotations=["Override"]),
        symbol(100, "Service", "c.ts", kind="class"), symbol(101, "go", "c.ts", kind="method", scope_id=100), symbol(102, "Service.stop", "c.ts"),
        symbol(103, "ok", "c.ts", kind="field"),
    ]
    calls = [call(100, "run", 1), call(100, "x.run", 2), call(100, "go", 3, target=("SERVICE", "Go")), call(100, "svc.stop", 4), call(100, "resp.ok", 5)]
    g = graph(spark, symbols, [chain(100, 0, 0, 0, 0, 0), ("b.ts", 101, [101])], calls)
    ids = {(r.file, r.name, r.kind): r.id for r in g.symbols.collect() if r.name != "run"}
    override = g.symbols.filter("name = 'run' and size(annotations) > 0").head()["id"]
    (filled,) = rows(g.chains.filter("size(chain) > 1"), "chain")
    assert filled[0][1:] == [override, override, ids["c.ts", "go", "method"], ids["c.ts", "Service.stop", "function"], 0]


def test_same_file_wins_only_when_scores_allow(spark):
    symbols = [symbol(100, "caller", "b.ts"), symbol(101, "f", "b.ts"), symbol(100, "f", "a.ts"), symbol(100, "f", "c.ts")]
    plain = graph(spark, symbols, [chain(100, 0, path="b.ts")], [call(100, "f", 1, path="b.ts")])
    assert rows(plain.chains, "chain") == [([101, 102],)]
    chained = graph(spark, symbols, [chain(100, 0, path="b.ts"), chain(100, path="c.ts")], [call(100, "f", 1, path="b.ts")])
    assert sorted(rows(chained.chains, "chain"))[0] == ([101, 103],)


def test_edges_keep_the_last_position_and_arguments(spark):
    symbols = [symbol(100, "f"), symbol(101, "g"), symbol(102, "x", kind="variable", scope_id=100)]
    calls = [call(100, "g", 1, args=["x"]), call(100, "g", 2, args=["x", "y"], condition="late", loop=True)]
    g = graph(spark, symbols, [chain(100, 0, 0, 100)], calls)
    assert sorted(rows(g.edges, "caller_id", "callee_id", "position", "condition", "arg_ids", "is_loop_body", "is_recursive")) == [
        (100, 100, 3, None, [], False, True),
        (100, 101, 2, "late", [102, 0], True, False),
    ]
    assert rows(traversal.direct_callers(g.edges, 100)) == []


def test_call_sites_also_under_alias(spark):
    g = graph(spark, [symbol(100, "f"), symbol(101, "svc", kind="variable", scope_id=100, type_name="Mailer")], [chain(100, 0)], [call(100, "svc.Send", 1)])
    assert sorted(rows(g.call_sites, "name_key")) == [("mailer.send",), ("svc.send",)]
    assert len(reports.references(g.symbols, g.call_sites, "send").head().call_sites) == 1


def test_classes_scopes_and_pages(spark):
    symbols = [
        symbol(100, "OrderController", kind="class", annotations=["RestController"]), symbol(101, "OrderRef", kind="class", type_ref=100),
        symbol(102, "Repo", kind="interface"), symbol(103, "getOrders", kind="method", scope_id=100, annotations=["GetMapping"]), symbol(104, "repo", kind="field", scope_id=100),
        symbol(105, "helper"), symbol(106, "limit", kind="parameter", scope_id=105), symbol(107, "tmp", kind="variable", scope_id=105),
        symbol(108, "OrderController", "b.ts", kind="class", type_ref=100),
    ]
    g = graph(spark, symbols)
    assert rows(lookup.class_members(g.symbols, 100), "role", "name") == [("field", "repo"), ("method", "getOrders")]
    assert rows(lookup.class_members(g.symbols, 105)) == []
    assert rows(lookup.function_scope(g.symbols, 105), "role", "name") == [("local", "tmp"), ("parameter", "limit")]
    assert dict(rows(lookup.class_targets(g.symbols)))[101] == 100
    assert rows(lookup.of_kind(g.symbols, "class"), "id") == [(100,), (101,)]
    assert rows(search.by_name(g.symbols, "ORDER"), "name") == [("getOrders",), ("OrderController",), ("OrderController",), ("OrderRef",)]
    assert rows(search.by_name(g.symbols, "order", limit=1, offset=1), "id") == [(100,)]
    assert rows(lookup.annotated(g.symbols, "MAPPING", "method"), "name") == [("getOrders",)]
    assert lookup.resolve(g.symbols, "ordercontroller").symbol["id"] == 100
    with pytest.raises(LookupError):
        search.matches(g.symbols, "")
    assert search.matches(g.symbols, "", "prefix").count() == 9


def test_dependencies(spark):
    g = graph(
        spark,
        [symbol(100, "f"), symbol(101, "OrderService", kind="class")],
        [chain(100, 0, 0, 0)],
        [call(100, "fmt.Println", 1), call(100, "requests.get", 2), call(100, "OrderService.getOrders", 3), call(100, "plain", 4)],
    )
    assert rows(reports.dependencies(g.symbols, g.call_sites)) == [("fmt", False, 1), ("orderservice", True, 1), ("requests", False, 1)]


def test_cycles_and_self_loops_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 1)], "caller_id long, callee_id long")
    start = spark.createDataFrame([(1,)], "id long")
    assert sorted(rows(traversal.reached(edges, start, 10, "callee_id", "caller_id"))) == [(1, 0), (2, 2), (3, 1)]


def test_exact_containment_where_a_trie_could_miss(spark):
    chains = spark.createDataFrame([(1, [9, 1, 1, 1, 2]), (2, [9, 1, 1, 2])], "func_id long, chain array<long>")
    assert sorted(rows(search.chains_with(chains, [1, 1, 2]), "func_id")) == [(1,), (2,)]
    assert rows(search.chains_with(chains, [1, 1, 2], 3), "func_id") == [(2,)]
    assert sorted(rows(search.chains_from(chains, [9, 1]), "func_id")) == [(1,), (2,)]
    with pytest.raises(LookupError):
        search.chains_with(chains, [])


def test_semantic_and_embeddings(spark):
    names = ["authenticate_user", "authorize_request", "query_database", "parse_config"]
    g = graph(spark, [symbol(100 + i, n) for i, n in enumerate(names)])
    found = vectors.embed(g.symbols)
    query = spark.range(1).select(vectors.hashed(F.lit("authenticte"))).head()[0]
    assert search.semantic(g.symbols, found, query, None, 2).head()["name"] == "authenticate_user"
    with pytest.raises(ValueError):
        search.semantic(g.symbols, None, query)
    known = spark.createDataFrame([(100, [1.0] * 384), (101, [1.0])], "symbol_id long, vector array<float>")
    again = {r.symbol_id: r.vector for r in vectors.embed(g.symbols, known=known).collect()}
    assert len(again) == 4 and again[100] == [1.0] * 384 and len(again[101]) == 384


def test_k_means(spark):
    points = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 0.9]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(points, "symbol_id long, vector array<float>")
    assigned, centroids = vectors.k_means(df, 2)
    cluster = dict(rows(assigned, "symbol_id", "cluster"))
    assert cluster[1] == cluster[2] != cluster[3] == cluster[4] and len(centroids) == 2
    assert len(vectors.k_means(df.limit(2), 9)[1]) == 2
    assert vectors.k_means(df.limit(0), 3)[0].count() == 0
    missing = df.unionByName(spark.createDataFrame([(6, None)], "symbol_id long, vector array<float>"))
    assert sorted(rows(vectors.k_means(missing, 2)[0], "symbol_id", "cluster")) == sorted(cluster.items())
    uneven = df.unionByName(spark.createDataFrame([(6, [1.0])], "symbol_id long, vector array<float>"))
    with pytest.raises(ValueError):
        vectors.k_means(uneven, 2)
    with pytest.warns(UserWarning, match="still changed"):
        vectors.k_means(df, 2, rounds=1)


def test_k_means_in_parts_and_with_repeats(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.2, (60, 3)) for c in np.eye(3)])
    points = [(i % 170, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(points, "symbol_id long, vector array<double>")
    whole, centroids = vectors.k_means(df.repartition(7), 3)
    sizes = sorted(r["n"] for r in whole.groupBy("cluster").agg(F.count("*").alias("n")).collect())
    assert sizes == [60, 60, 60]
    monkeypatch.setattr(vectors, "SCORES", 12)  # two rows at a time in this process
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(180)), pa.array(unit.tolist())], names=["symbol_id", "vector"])
    c = np.array(centroids)
    got = [b.to_pydict() for b in vectors._assigned(c)([batch])]
    assert len(got) == 90 and sum((g["cluster"] for g in got), []) == (unit @ c.T).argmax(1).tolist()
    (sums,) = vectors._added(vectors._totals(c)([batch, batch]))
    for cluster, n, total in zip(*(sums.to_pydict()[k] for k in ("cluster", "n", "total")), strict=True):
        mine = unit[(unit @ c.T).argmax(1) == cluster]
        assert n == 2 * len(mine) and np.allclose(total, 2 * mine.sum(0))


def test_many_ids_are_dense(spark):
    parsed = spark.range(1000).select(F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("path"), (F.col("id") + 100).alias("id"))
    ids = ingest.global_ids(parsed.repartition(5)).orderBy("path", "local_id").collect()
    assert [r.id for r in ids] == list(range(100, 1100))


def test_routes(spark, basic, tmp_path):
    from loomgraph.sources import stores

    route = stores.Route(str(tmp_path / "kept"))
    assert stores.write(basic, route) == 1
    assert stores.read(spark, route).symbols.count() == 3
    for name, (schema, _) in snapshot.TABLES.items():
        df = getattr(basic, name)
        if df is not None:
            kept = stores.flat(df, schema)
            assert all("<" not in t for _, t in kept.dtypes)
            back = stores.restored(kept, schema)
            assert sorted(map(str, back.collect())) == sorted(map(str, df.select(*schema.names).collect()))
    database = stores.Route("jdbc:postgresql://db/x", 7)
    assert database.is_database and database.table("edges") == "graph_7_edges"
    assert [stores.shard_of(i, ["a", "b"]) for i in range(3)] == ["a", "b", "a"]
    with pytest.raises(ValueError):
        stores.shard_of(1, [])


def test_database(spark, basic, tmp_path):
    from loomgraph.sources import stores

    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "numPartitions": "3"}
    route = stores.Route(f"jdbc:derby:{tmp_path}/graphs;create=true", 7, options)
    other = stores.Route(route.where, 8, options)
    assert stores.write(basic, route) == 1
    back = stores.read(spark, route)
    for name, (schema, key) in snapshot.TABLES.items():
        df = getattr(basic, name)
        want = [] if df is None else df.select(*schema.names).collect()
        assert sorted(map(str, getattr(back, name).collect())) == sorted(map(str, want))
        assert (stores.split_column(schema, key) is None) == (name == "files")
    assert back.symbols.rdd.getNumPartitions() > 1
    stores.write(snapshot_of_nothing(spark), other)
    assert stores.read(spark, other).symbols.count() == 0 and stores.read(spark, route).symbols.count() == 3
    empty = spark.createDataFrame([], stores.schemas.META)
    stores._connected(empty.write, route, "meta").mode("overwrite").save()
    with pytest.raises(FileNotFoundError):
        stores.read(spark, route)


def snapshot_of_nothing(spark):
    from loomgraph.plans.tables import Graph

    return Graph(**{name: spark.createDataFrame([], schema) for name, (schema, _) in snapshot.TABLES.items()})
