"""DuckDB SQL for the registered queries, written from the base tables and independent of the Spark plans."""

from __future__ import annotations

from loomgraph.plans import fixtures as fx

_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag"
_EMPTY = "CAST(NULL AS VARCHAR)"


def _symbol(base: str, key: str, name: str, kind: str, file: str, table: str, scope="'global'", scope_id="0", ann="CAST([] AS VARCHAR[])", type_name=_EMPTY) -> str:
    return (
        f"SELECT CAST({base} + {key} AS BIGINT) AS id, {name} AS name, '{kind}' AS kind, {scope} AS scope, CAST({scope_id} AS BIGINT) AS scope_id, "
        f"CAST(0 AS BIGINT) AS type_ref, {type_name} AS type_name, {file} AS file, CAST({key} % 1000 * 10 + 1 AS INTEGER) AS line, "
        f"CAST({key} % 1000 * 10 + 9 AS INTEGER) AS end_line, {ann} AS ann FROM {table}"
    )


_OF = "'object_field'"
_SYMBOLS = " UNION ALL ".join(
    [
        _symbol("100", "r_regionkey", "r_name", "module", "'geo'", "region"),
        _symbol("1000", "n_nationkey", "n_name", "module", "'geo'", "nation", _OF, "100 + n_regionkey"),
        _symbol("1000000", "s_suppkey", "s_name", "class", "'supplier'", "supplier", _OF, "1000 + s_nationkey"),
        _symbol("2000000", "c_custkey", "c_name", "class", "c_mktsegment", "customer", _OF, "1000 + c_nationkey", "[c_mktsegment]"),
        _symbol("10000000", "p_partkey", "p_name", "function", "p_brand", "part", ann="[p_type, p_brand]"),
        _symbol("20000000", "o_orderkey", "'order_' || o_orderkey", "method", "o_orderpriority", "orders", _OF, "2000000 + o_custkey", "[o_orderstatus]"),
        _symbol("60000000", "o_orderkey", "'v'", "variable", "o_orderpriority", "orders LEFT JOIN first_supplier USING (o_orderkey)", "'local'", "20000000 + o_orderkey", type_name="first_name"),
        _symbol("80000000", "o_orderkey", "'q'", "parameter", "o_orderpriority", "orders", "'parameter'", "20000000 + o_orderkey", type_name="'Integer'"),
        _symbol("0", "type_id", "event_type", "function", "'events'", "types"),
        _symbol("40000000", "user_id", "'user_' || user_id", "function", "'events'", "(SELECT DISTINCT user_id FROM events)"),
    ]
)


def _elements(part: str) -> str:
    line = "SELECT 20000000 + l_orderkey AS func_id, CAST(rn AS BIGINT) AS ord, {sub} AS sub, CAST({e} AS BIGINT) AS element FROM lines WHERE l_returnflag {test}"
    rows = [
        "SELECT 2000000 + o_custkey AS func_id, o_orderkey AS ord, 0 AS sub, 20000000 + o_orderkey AS element FROM orders",
        line.format(sub=0, e=3, test="= 'R'"), line.format(sub=1, e=part, test="= 'R'"), line.format(sub=2, e=5, test="= 'R'"),
        line.format(sub=0, e=1, test="= 'A'"), line.format(sub=1, e=part, test="= 'A'"), line.format(sub=2, e=7, test="= 'A'"),
        line.format(sub=1, e=part, test="NOT IN ('R', 'A')"),
        "SELECT 10000000 + l_partkey, l_suppkey, 0, 1000000 + l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)",
        "SELECT 1000000 + s_suppkey, 0, 0, 1000 + s_nationkey FROM supplier",
        "SELECT 1000 + n_nationkey, 0, 0, 100 + n_regionkey FROM nation",
        "SELECT 40000000 + user_id, rn, 0, 12 FROM user_events WHERE event_type = 'error'",
        "SELECT 40000000 + user_id, rn, 1, type_id FROM user_events",
    ]
    return " UNION ALL ".join(rows)


def _numbered(raw: str) -> str:
    return (
        f"SELECT DISTINCT func_id, CAST(0 AS BIGINT) AS position, func_id AS element FROM {raw} UNION ALL "
        f"SELECT func_id, row_number() OVER (PARTITION BY func_id ORDER BY ord, sub) AS position, element FROM {raw}"
    )


_POSITION = (
    "coalesce(sum(CASE WHEN l_returnflag IN ('R', 'A') THEN 3 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY rn "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN l_returnflag IN ('R', 'A') THEN 2 ELSE 1 END"
)
_RECEIVER = "CASE WHEN l_returnflag = 'A' THEN 'v' WHEN l_linestatus = 'O' THEN s_name ELSE p_brand END"


#: What the names in these tables can match, worked out by hand from the ordered rules: (text, effect).
_EFFECTS = ((".Query", "sql_query"), (".Get(", "http_call"), (".Send", "event_emit"), (".Error", "log"), (".Set", "cache_write"))


def _classified(name: str) -> tuple[str, str]:
    effect = "CASE " + " ".join(f"WHEN contains({name}, '{t}') THEN '{e}'" for t, e in _EFFECTS) + " ELSE 'none' END"
    rule = "CASE " + " ".join(f"WHEN contains({name}, '{t}') THEN '{t}'" for t, _ in _EFFECTS) + " END"
    return effect, rule


_CTES = {
    "lines": f"SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS rn FROM lineitem",
    "types": "SELECT event_type, 500 + row_number() OVER (ORDER BY event_type) AS type_id FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)",
    "user_events": "SELECT user_id, event_type, type_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events JOIN types USING (event_type)",
    "first_supplier": "SELECT l_orderkey AS o_orderkey, s_name AS first_name FROM lines JOIN supplier ON l_suppkey = s_suppkey WHERE rn = 1",
    "sym": _SYMBOLS,
    "raw": _elements("10000000 + l_partkey"),
    "elems": _numbered("raw"),
    "chain_text": "SELECT func_id, string_agg(CAST(element AS VARCHAR), ',' ORDER BY position) AS chain, count(*) AS n FROM elems GROUP BY func_id",
    "raw0": _elements("0"),
    "elems0": _numbered("raw0"),
    "recs": (
        f"SELECT 20000000 + l_orderkey AS caller_id, {_RECEIVER} || '.' || p_name AS call_name, CAST({_POSITION} AS INTEGER) AS position, "
        "CASE WHEN l_returnflag = 'A' THEN ['v', 'q', CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR)] ELSE [CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR)] END AS args, "
        "CAST(l_linenumber AS INTEGER) AS line, CASE WHEN l_returnflag = 'R' THEN 'returned' END AS condition, l_returnflag = 'A' AS is_loop_body "
        "FROM lines JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"
    ),
    "recs_e": f"SELECT *, {_classified('call_name')[0]} AS effect, {_classified('call_name')[1]} AS rule FROM recs",
    "edg": (
        "SELECT e.caller_id, e.callee_id, CAST(e.position AS INTEGER) AS position, r.condition, coalesce(r.effect, 'none') AS effect, "
        "coalesce(r.is_loop_body, false) AS is_loop_body, e.caller_id = e.callee_id AS is_recursive, r.args "
        "FROM (SELECT func_id AS caller_id, element AS callee_id, max(position) AS position FROM elems WHERE position >= 1 AND element >= 100 GROUP BY 1, 2) e "
        "LEFT JOIN recs_e r ON r.caller_id = e.caller_id AND r.position = e.position"
    ),
    "alias": (
        "SELECT r.caller_id, r.position, r.call_name, r.line, lower(s.first_name) || '.' || lower(substr(r.call_name, 3)) AS alias "
        "FROM recs r JOIN first_supplier s ON r.caller_id = 20000000 + s.o_orderkey WHERE starts_with(r.call_name, 'v.')"
    ),
    "sites": "SELECT lower(call_name) AS name_key, caller_id, call_name, line, args FROM recs UNION ALL SELECT alias, a.caller_id, a.call_name, a.line, NULL FROM alias a",
    "emb": "SELECT 10000000 + vec_id AS symbol_id, embedding FROM embeddings",
    "sim": f"SELECT e.symbol_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS raw_s FROM emb e, emb q WHERE q.symbol_id = {10_000_000 + fx.VECTOR_ROW}",
    "described": (
        "SELECT e.func_id, e.position, e.element, coalesce(CASE e.element WHEN 1 THEN 'LOOP' WHEN 3 THEN 'IF_TRUE' WHEN 5 THEN 'BRANCH_END' WHEN 7 THEN 'LOOP_BACK' WHEN 12 THEN 'THROW' END, s.name) AS description "
        "FROM elems e LEFT JOIN sym s ON e.element = s.id"
    ),
    # Elements with the one before, how many throws there were so far, and how many elements that are no markers before.
    "steps": (
        "SELECT e.func_id, e.position, e.element, s.name, lag(e.element) OVER w AS prev, sum(CASE WHEN e.element = 12 THEN 1 ELSE 0 END) OVER w AS thrown, "
        "sum(CASE WHEN e.element >= 100 THEN 1 ELSE 0 END) OVER w - CASE WHEN e.element >= 100 THEN 1 ELSE 0 END AS nth "
        "FROM elems e LEFT JOIN sym s ON s.id = e.element WINDOW w AS (PARTITION BY e.func_id ORDER BY e.position)"
    ),
    "cands": (  # symbols by the last part of the called name: parts only, as nothing else is named so
        "SELECT r.caller_id, r.position, s.id, row_number() OVER (PARTITION BY r.caller_id, r.position ORDER BY "
        "CASE WHEN s.id IN (SELECT func_id FROM elems0) THEN 5 ELSE 0 END + 4 + CASE WHEN s.file = c.file THEN 3 ELSE 0 END DESC, s.id) AS nth "
        "FROM recs r JOIN sym c ON c.id = r.caller_id JOIN sym s ON s.name = split_part(r.call_name, '.', 2) AND s.kind = 'function'"
    ),
}


def _with(sql: str) -> str:
    """The query with the tables that it and they need, in order."""
    import re

    needed, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name, body in _CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(body)
    order, done = [], set()

    def add(name: str) -> None:
        if name in done:
            return
        done.add(name)
        for other in _CTES:
            if other != name and other in needed and re.search(rf"\b{other}\b", _CTES[name]):
                add(other)
        order.append(name)

    for name in _CTES:
        if name in needed:
            add(name)
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({_CTES[n]})" for n in order) + " " if order else "") + sql


def _walk(start: str, depth: int, edges: str = "edg", source: str = "callee_id", target: str = "caller_id") -> str:
    """(id, hop) of a walk, by one union of all hops."""
    steps = [f"w0 AS (SELECT CAST({start} AS BIGINT) AS id)"]
    for i in range(1, depth + 1):
        steps.append(f"w{i} AS (SELECT DISTINCT e.{target} AS id FROM w{i - 1} JOIN {edges} e ON e.{source} = w{i - 1}.id)")
    rows = " UNION ALL ".join(f"SELECT id, {i} AS hop FROM w{i}" for i in range(depth + 1))
    return f"WITH {', '.join(steps)} SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM ({rows}) GROUP BY id"


#: The new lines of the fixture's diff, read off by hand.
_DIFF_LINES = (
    "(SELECT path, CAST(n AS INTEGER) AS new_line FROM (VALUES ('3-MEDIUM', 1), ('3-MEDIUM', 2), ('3-MEDIUM', 3), ('3-MEDIUM', 4), ('3-MEDIUM', 5), "
    "('3-MEDIUM', 20), ('3-MEDIUM', 21), ('src/new.py', 1), ('src/new.py', 2), ('nowhere.txt', 3)) t(path, n))"
)
_MODIFIED = f"SELECT DISTINCT s.id, s.name, s.kind, s.file FROM sym s JOIN {_DIFF_LINES} d ON d.path = s.file AND d.new_line BETWEEN s.line AND s.end_line WHERE s.file <> 'FURNITURE'"
_AFFECTED = (
    "SELECT m.id AS func_id, CAST(e.position AS INTEGER) AS position, e.element AS to_id, p.name AS to_name, r.line, "
    "coalesce(CASE WHEN b.element = 3 THEN 'IF_TRUE' WHEN b.element = 1 AND b2.element IN (5, 7) THEN NULL WHEN b.element = 1 THEN 'LOOP' END, '') AS own, b.element AS b1 "
    f"FROM ({_MODIFIED}) m JOIN elems e ON e.func_id = m.id AND e.position > 0 AND e.element >= 100 JOIN recs r ON r.caller_id = m.id AND r.position = e.position "
    f"JOIN {_DIFF_LINES} d ON d.path = m.file AND d.new_line = r.line JOIN sym p ON p.id = e.element "
    "JOIN elems b ON b.func_id = m.id AND b.position = e.position - 1 LEFT JOIN elems b2 ON b2.func_id = m.id AND b2.position = e.position - 2"
)
_MARKER = "CASE {e} WHEN 1 THEN 'LOOP' WHEN 3 THEN 'IF_TRUE' WHEN 5 THEN 'BRANCH_END' WHEN 7 THEN 'LOOP_BACK' WHEN 12 THEN 'THROW' END"
#: The first position of the unbroken run of markers before each call.
_GUARDS = (
    "SELECT e.func_id, e.position, coalesce(max(CASE WHEN o.element >= 100 THEN o.position + 1 END), 0) AS start "
    "FROM elems e JOIN elems o ON o.func_id = e.func_id AND o.position < e.position GROUP BY 1, 2"
)
#: The marker names between a call and the last element before it that is no marker, whichever chain it is in.
_GUARDED = (
    f"SELECT func_id, nth, string_agg({_MARKER.format(e='element')}, ',' ORDER BY position) AS guards FROM steps WHERE element < 100 GROUP BY 1, 2"
)

_SQL = {
    "s15_snapshot_stats": (
        "SELECT (SELECT count(*) FROM sym) AS symbols, (SELECT count(DISTINCT func_id) FROM elems) AS chains, (SELECT count(*) FROM edg) AS edges, "
        "(SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) AS files, (SELECT max(id) + 1 FROM sym) AS next_id"
    ),
    "k1_symbols": "SELECT id, name, kind, scope, scope_id, type_ref, type_name, file, line, end_line, array_to_string(ann, ',') AS annotations FROM sym",
    "k1_chains": "SELECT func_id, chain FROM chain_text",
    "k1_call_records": "SELECT caller_id, call_name, position, array_to_string(args, ',') AS args, line, condition, is_loop_body, effect FROM recs_e",
    "p4_files": (
        "SELECT 'documents/' || source || '/' || doc_id AS path, lang AS language, CAST(strlen(text) AS BIGINT) AS bytes, "
        "CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS lines FROM documents WHERE source = 'src1'"
    ),
    "p1_symbol_by_id": f"SELECT id, name, kind, file FROM sym WHERE id = {fx.SUPPLIER_ID}",
    "p2_resolve_name": f"SELECT id, name, kind FROM sym WHERE lower(name) = '{fx.PART_NAME}'",
    "p3_resolve_preferred_kind": "SELECT id, kind FROM sym WHERE name = 'q'",
    "p5_members": f"SELECT id, name, kind FROM sym WHERE scope_id = {fx.NATION_ID}",
    "p6_class_targets": "SELECT id, CASE WHEN type_ref <> 0 AND id NOT IN (SELECT scope_id FROM sym WHERE kind = 'method') THEN type_ref ELSE id END AS target_id FROM sym WHERE kind = 'class'",
    "p7_methods": f"SELECT id, name FROM sym WHERE scope_id = {fx.CUSTOMER_ID} AND kind IN ('function', 'method')",
    "p8_class_members": f"SELECT CASE WHEN kind IN ('function', 'method') THEN 'method' ELSE 'field' END AS role, id, name, kind, line FROM sym WHERE scope_id = {fx.CUSTOMER_ID} AND kind IN ('function', 'method', 'field', 'variable', 'constant')",
    "p9_function_scope": f"SELECT CASE kind WHEN 'parameter' THEN 'parameter' ELSE 'local' END AS role, id, name, kind, line FROM sym WHERE scope_id = {fx.ORDER_ID} AND kind IN ('parameter', 'variable', 'constant')",
    "p10_list_classes": "SELECT id, name FROM (SELECT id, name FROM sym WHERE kind = 'class' QUALIFY row_number() OVER (PARTITION BY name ORDER BY type_ref <> 0, id) = 1) ORDER BY name, id LIMIT 50 OFFSET 10",
    "p11_annotations": "SELECT id, name FROM sym WHERE kind = 'function' AND contains(lower(array_to_string(ann, chr(10))), 'promo') ORDER BY name, id LIMIT 40 OFFSET 5",
    "p13_markers": "SELECT element AS id, CASE element WHEN 1 THEN 'LOOP' WHEN 3 THEN 'IF_TRUE' WHEN 5 THEN 'BRANCH_END' WHEN 7 THEN 'LOOP_BACK' WHEN 12 THEN 'THROW' END AS name, count(*) AS n FROM elems WHERE element BETWEEN 1 AND 99 GROUP BY 1, 2",
    "x1_contains": "SELECT id, name FROM sym WHERE kind = 'function' AND contains(lower(name), 'gear') ORDER BY lower(name), id LIMIT 30 OFFSET 5",
    "x1_contains_total": "SELECT count(*) AS total FROM sym WHERE name ILIKE '%gear%'",
    "x2_prefix": "SELECT id, name FROM sym WHERE starts_with(lower(name), 'order_12') ORDER BY lower(name), id LIMIT 40",
    "x2_suffix": "SELECT id, name FROM sym WHERE lower(name) LIKE '%ring'",
    "x2_exact": "SELECT id, name FROM sym WHERE lower(name) = 'user_3'",
    "x3_semantic": "SELECT id, name, round(raw_s / sqrt((SELECT raw_s FROM sim WHERE symbol_id = 10000003)), 4) AS similarity FROM (SELECT * FROM sim ORDER BY raw_s DESC, symbol_id LIMIT 40) JOIN sym ON id = symbol_id WHERE kind = 'function' ORDER BY similarity DESC, id LIMIT 10",
    "x4_hybrid": (
        "SELECT id, s.name, round(score, 6) AS score FROM (SELECT id, sum(1.0 / (60 + rank + 1)) AS score FROM ("
        "SELECT id, row_number() OVER (ORDER BY lower(name), id) - 1 AS rank FROM sym WHERE contains(lower(name), 'gear') QUALIFY rank < 60 "
        "UNION ALL SELECT symbol_id, row_number() OVER (ORDER BY raw_s DESC, symbol_id) - 1 AS rank FROM sim QUALIFY rank < 60) GROUP BY id) JOIN sym s USING (id) ORDER BY score DESC, id LIMIT 15"
    ),
    "x6_chains_with_run": "SELECT func_id, CAST(n AS INTEGER) AS n FROM chain_text WHERE contains(',' || chain || ',', ',5,1,') AND n <= 13",
    "x7_chains_from": f"SELECT func_id, chain FROM chain_text WHERE func_id = {fx.ORDER_ID}",
    "x8_distinct_chains": "SELECT min(func_id) AS func_id, tail AS chain FROM (SELECT func_id, coalesce(string_agg(CAST(element AS VARCHAR), ',' ORDER BY position) FILTER (position > 0), '') AS tail FROM elems GROUP BY func_id) GROUP BY tail",
    "j1_global_ids": "SELECT file AS path, id AS local_id, row_number() OVER (ORDER BY file, id) + 99 AS id FROM sym",
    "j1_remapped_symbols": "WITH ids AS (SELECT file, id AS old, row_number() OVER (ORDER BY file, id) + 99 AS new FROM sym) SELECT i.new AS id, s.name, s.kind, coalesce(o.new, s.scope_id) AS scope_id, s.file FROM sym s JOIN ids i ON i.old = s.id LEFT JOIN ids o ON o.old = s.scope_id AND o.file = s.file",
    "j2_call_resolution": "SELECT caller_id, position, id AS callee_id, 3 AS step FROM cands WHERE nth = 1",
    "j3_class_methods": "SELECT lower(c.name) AS class_name, lower(m.name) AS method_name, min(m.id) AS id FROM sym c JOIN sym m ON m.scope_id = c.id WHERE c.kind = 'class' AND m.kind IN ('function', 'method') GROUP BY 1, 2",
    "j4_aliases": "SELECT caller_id, position, alias FROM alias",
    "j6_filled_chains": "SELECT e.func_id, string_agg(CAST(CASE WHEN e.element = 0 THEN coalesce(c.id, 0) ELSE e.element END AS VARCHAR), ',' ORDER BY e.position) AS chain FROM elems0 e LEFT JOIN cands c ON c.caller_id = e.func_id AND c.position = e.position AND c.nth = 1 GROUP BY e.func_id",
    "g1_edges": "SELECT caller_id, callee_id, position, condition, effect, is_loop_body, is_recursive FROM edg",
    "j8_argument_ids": "SELECT caller_id, callee_id, CASE WHEN len(args) = 3 THEN (caller_id + 40000000) || ',' || (caller_id + 60000000) || ',0' ELSE '0' END AS arg_ids FROM edg WHERE args IS NOT NULL",
    "a3_call_sites": "SELECT name_key, count(*) AS n, count(DISTINCT caller_id) AS callers FROM sites GROUP BY name_key",
    "effects_of_calls": (
        "WITH names AS (SELECT DISTINCT 'client.' || upper(event_type[1]) || lower(event_type[2:]) || '.' || ['Query', 'Get(', 'Send', 'Set', 'none'][event_id % 5 + 1] AS name FROM events) "
        f"SELECT name, {_classified('name')[0]} AS effect, {_classified('name')[1]} AS rule FROM names"
    ),
    "text_functions": "SELECT DISTINCT call_name, split_part(call_name, '.', 2) AS short, split_part(call_name, '.', 1) AS first, substr(call_name, instr(call_name, '.') + 1) AS rest, '!' || call_name AS negated, call_name AS path, call_name AS below, ' ''' || call_name AS label FROM recs",
    "s6_type_references": "SELECT s.id, min(c.id) AS class_id FROM sym s JOIN sym c ON c.name = s.type_name WHERE s.kind = 'variable' AND c.kind = 'class' GROUP BY s.id",
    "d5_guard_markers": (
        "SELECT s.func_id, CAST(s.position AS INTEGER) AS position, coalesce(g.guards, '') AS guards "
        f"FROM steps s LEFT JOIN ({_GUARDED}) g ON g.func_id = s.func_id AND g.nth = s.nth WHERE s.position > 0 AND s.element >= 100"
    ),
    "p12_symbols_on_lines": f"SELECT s.id, count(*) AS lines FROM sym s JOIN {_DIFF_LINES} d ON d.path = s.file AND d.new_line >= s.line AND d.new_line <= s.end_line GROUP BY s.id",
    "v6_incremental_embedding": "SELECT kind, count(*) AS n, CAST(64 AS INTEGER) AS dimension FROM sym GROUP BY kind",
    "a10_reciprocal_ranks": (
        "SELECT id, round(sum(1.0 / (61 + rank)), 6) AS score FROM (SELECT id, line AS rank FROM sym UNION ALL SELECT callee_id, min(position) FROM edg GROUP BY callee_id) GROUP BY id"
    ),
    "b8_policy_delta": "SELECT func_id, name FROM steps WHERE position > 0 AND element >= 100 AND thrown <= 1 GROUP BY func_id, name HAVING bool_and(prev = 3)",
    "b8_diff_simulation": (
        "WITH f AS (SELECT s.name AS function, min(e.func_id) AS func_id FROM elems e JOIN sym s ON s.id = e.func_id WHERE e.position = 0 GROUP BY s.name) "
        "SELECT f.function, CASE WHEN t.element >= 1000000 THEN 'added' ELSE 'removed' END AS change, 'call:' || t.name AS token FROM f JOIN steps t ON t.func_id = f.func_id "
        "WHERE t.position > 0 AND (t.element BETWEEN 1000000 AND 1999999 OR t.element BETWEEN 1000 AND 1999)"
    ),
    "s4_parsed_sources": (
        "SELECT 'n' || s_nationkey || '.py' AS path, 1 + 2 * count(*) AS symbols, 1 + count(*) AS chains, 2 * count(*) AS calls FROM supplier GROUP BY s_nationkey"
    ),
    "s7_impl_methods": "SELECT 'n' || s_nationkey || '.rs' AS path, 'go' || s_suppkey AS method, 'S' || s_suppkey AS owner, true AS of_definition FROM supplier",
    "s16_configured_effects": (
        "SELECT 'n' || s_nationkey || '.py' AS path, effect, CAST(count(*) AS BIGINT) AS n FROM supplier, (VALUES ('file_write'), ('log')) t(effect) GROUP BY 1, 2"
    ),
    "g2_direct_callers": f"SELECT DISTINCT func_id AS id FROM elems WHERE element = {fx.SUPPLIER_ID} AND func_id <> {fx.SUPPLIER_ID} AND position > 0",
    "g3_callers": f"SELECT * FROM ({_walk(str(fx.SUPPLIER_ID), 2)}) WHERE hop > 0",
    "g4_impact": f"SELECT id FROM ({_walk(str(fx.NATION_ID), 4)}) WHERE hop > 0",
    "g3_callers_in_cycles": "SELECT * FROM (" + _walk(
        "501", 3, "(SELECT DISTINCT a.type_id AS caller_id, b.type_id AS callee_id FROM user_events a JOIN user_events b ON a.user_id = b.user_id AND b.rn = a.rn + 1)"
    ) + ") WHERE hop > 0",
    "g5_callees": f"SELECT element AS id, s.name, CAST(min(position) AS INTEGER) AS position FROM elems JOIN sym s ON s.id = element WHERE func_id = {fx.ORDER_ID} AND position > 0 AND element >= 100 GROUP BY 1, 2",
    "g6_flow": f"SELECT CAST(position AS INTEGER) AS position, element, description FROM described WHERE func_id = {fx.ORDER_ID}",
    "g6_flow_calls": (
        "SELECT d.func_id, CAST(d.position AS INTEGER) AS position, d.element AS to_id, d.description AS to_name, coalesce(g.condition, r.condition) AS condition, g.effect AS effect, "
        "coalesce(r.line, 0) AS line, coalesce(array_to_string(r.args, ','), '') AS args, g.is_loop_body FROM described d JOIN edg g ON g.caller_id = d.func_id AND g.callee_id = d.element "
        "LEFT JOIN recs r ON r.caller_id = d.func_id AND r.position = d.position WHERE d.position > 0 AND d.element >= 100 AND d.element <> d.func_id"
    ),
    "g7_search_flow": "SELECT func_id, s.name AS func_name, chain, 1 AS match_count FROM chain_text JOIN sym s ON s.id = func_id WHERE contains(',' || chain || ',', ',5,1,')",
    "g9_call_graph_nodes": (
        f"SELECT w.id, s.name, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT * FROM ({_walk(str(fx.PART_ID), 2)}) UNION ALL "
        f"SELECT * FROM ({_walk(str(fx.PART_ID), 2, source='caller_id', target='callee_id')})) w JOIN sym s ON s.id = w.id GROUP BY 1, 2"
    ),
    "g9_call_graph_edges": (
        f"SELECT DISTINCT e.caller_id, e.callee_id FROM edg e JOIN ({_walk(str(fx.PART_ID), 1)}) w ON e.callee_id = w.id UNION "
        f"SELECT DISTINCT e.caller_id, e.callee_id FROM edg e JOIN ({_walk(str(fx.PART_ID), 1, source='caller_id', target='callee_id')}) w ON e.caller_id = w.id"
    ),
    "g10_context": (
        f"WITH hits AS (SELECT * FROM sym WHERE contains(lower(name), '{fx.PART_NAME}') ORDER BY lower(name), id LIMIT 4) SELECT h.id, h.name, h.file, "
        "coalesce((SELECT string_agg(c.name, ',' ORDER BY c.name) FROM edg e JOIN sym c ON c.id = e.caller_id WHERE e.callee_id = h.id AND e.caller_id <> h.id), '') AS callers, "
        "coalesce((SELECT string_agg(c.name, ',' ORDER BY e.position) FROM elems e JOIN sym c ON c.id = e.element WHERE e.func_id = h.id AND e.position > 0), '') AS callees FROM hits h"
    ),
    "g10_context_depth": (
        f"WITH hits AS (SELECT * FROM sym WHERE contains(lower(name), '{fx.PART_NAME}') ORDER BY lower(name), id LIMIT 4), up AS (SELECT DISTINCT caller_id, callee_id FROM edg WHERE caller_id <> callee_id), "
        "met AS (SELECT h.id, u.caller_id FROM hits h JOIN up u ON u.callee_id = h.id UNION SELECT h.id, w.caller_id FROM hits h JOIN up u ON u.callee_id = h.id JOIN up w ON w.callee_id = u.caller_id) "
        "SELECT h.id, h.name, coalesce((SELECT string_agg(c.name, ',' ORDER BY c.name) FROM met m JOIN sym c ON c.id = m.caller_id WHERE m.id = h.id AND m.caller_id <> h.id), '') AS callers FROM hits h"
    ),
    "k8_flow_diagram": (
        "WITH own AS (SELECT *, description AS label FROM described) "
        "SELECT func_id, 'flowchart TD' || chr(10) || string_agg('  n' || position || CASE WHEN element IN (3, 4, 5) THEN '{\"' || label || '\"}' "
        "WHEN element IN (1, 7, 6, 10, 11, 12) THEN '([\"' || label || '\"])' ELSE '[\"' || label || '\"]' END, chr(10) ORDER BY position) || chr(10) || "
        "string_agg('  n' || (position - 1) || ' --> n' || position, chr(10) ORDER BY position) FILTER (position > 0) AS diagram FROM own GROUP BY func_id"
    ),
    "k6_minimized": (
        "SELECT id || '|' || name || '|' || kind || '|' || scope || '|' || scope_id || '|0|' || coalesce(type_name, '') || '|' || file || '|' || line || '|' || end_line || '|||' || "
        "CASE WHEN len(ann) = 0 THEN '' ELSE '[' || array_to_string(list_transform(ann, lambda a: '{\"name\":\"' || a || '\",\"line\":1}'), ',') || ']' END || '|star' AS symbol FROM sym"
    ),
    "a1_dependencies": "SELECT lower(split_part(call_name, '.', 1)) AS name, bool_or(lower(split_part(call_name, '.', 1)) IN (SELECT lower(name) FROM sym)) AS is_internal, count(*) AS count FROM (SELECT DISTINCT caller_id, line, call_name FROM recs) GROUP BY 1",
    "a2_references": (
        f"SELECT caller_id AS func_id, s.name AS func_name, s.file, CAST(count(*) AS INTEGER) AS sites FROM (SELECT DISTINCT caller_id, line, call_name, args FROM recs WHERE contains(lower(call_name), '.{fx.PART_NAME}')) r JOIN sym s ON s.id = caller_id GROUP BY 1, 2, 3"
    ),
    "r4_references_page": f"SELECT DISTINCT caller_id AS func_id, s.name AS func_name FROM recs JOIN sym s ON s.id = caller_id WHERE contains(lower(call_name), '.{fx.PART_NAME}') ORDER BY func_name, func_id LIMIT 10 OFFSET 10",
    "a6_extraction": "SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) AS files, (SELECT count(*) FROM sym) AS symbols, (SELECT count(DISTINCT func_id) FROM elems) AS chains, (SELECT count(*) FROM recs) AS calls, CAST(0 AS BIGINT) AS skipped",
    "a7_usage": (
        "SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (event_id % 7 = 0) AS errors, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS answer_bytes, "
        "CAST(sum(CAST(trunc(value) AS BIGINT) * (event_id % 5)) AS BIGINT) AS source_bytes, "
        "round(sum(CAST(trunc(value) AS BIGINT) * (event_id % 5)) * 100.0 / (sum(CAST(trunc(value) AS BIGINT)) + sum(CAST(trunc(value) AS BIGINT) * (event_id % 5))), 1) AS savings_pct FROM events GROUP BY 1"
    ),
    "j12_source_bytes": "SELECT call_id, CAST(coalesce(sum(strlen(html)), 0) AS BIGINT) AS source_bytes FROM (SELECT DISTINCT user_id AS call_id, event_id % 60 AS page_id FROM events) LEFT JOIN pages USING (page_id) GROUP BY call_id",
    "v1_nearest": "SELECT symbol_id, round(raw_s / sqrt((SELECT raw_s FROM sim WHERE symbol_id = 10000003)), 4) AS similarity FROM sim ORDER BY raw_s DESC, symbol_id LIMIT 10",
    "v5_symbol_text": "SELECT id, name || CASE WHEN len(ann) > 0 THEN ' ' || array_to_string(ann, ' ') ELSE '' END AS text FROM sym",
    "j13_without_vector": "SELECT count(*) AS n, min(id) AS first FROM sym WHERE id NOT IN (SELECT symbol_id FROM emb)",
    "d1_diff_lines": f"SELECT path, new_line FROM {_DIFF_LINES}",
    "d3_diff_symbols": f"SELECT id, name, kind, file, 'modified' AS change FROM ({_MODIFIED}) UNION ALL SELECT id, name, kind, file, 'removed' FROM sym WHERE file = 'FURNITURE'",
    "d4_affected_calls": (
        f"SELECT a.func_id, a.position, a.to_id, a.to_name, a.line, coalesce((SELECT string_agg({_MARKER.format(e='g.element')}, ',' ORDER BY g.position) FROM elems g "
        f"WHERE g.func_id = a.func_id AND g.position >= x.start AND g.position < a.position AND g.element < 100), '') AS markers FROM ({_AFFECTED}) a JOIN ({_GUARDS}) x ON x.func_id = a.func_id AND x.position = a.position"
    ),
    "d6_diff_flows": (
        f"WITH span AS (SELECT func_id, count(*) AS calls, min(position) AS first, max(position) AS last FROM ({_AFFECTED}) GROUP BY func_id), "
        f"seen AS (SELECT s.func_id, {_MARKER.format(e='g.element')} AS marker, min(g.position) AS nth FROM span s JOIN ({_GUARDS}) x ON x.func_id = s.func_id AND x.position = s.first "
        "JOIN elems g ON g.func_id = s.func_id AND g.position BETWEEN x.start AND s.last AND g.element < 100 GROUP BY 1, 2) "
        "SELECT s.func_id, s.calls, coalesce((SELECT string_agg(marker, ',' ORDER BY nth) FROM seen WHERE seen.func_id = s.func_id), '') AS marker_window, "
        "coalesce((SELECT string_agg(CAST(caller_id AS VARCHAR), ',' ORDER BY caller_id) FROM (SELECT DISTINCT caller_id, callee_id FROM edg) e WHERE e.callee_id = s.func_id AND e.caller_id <> s.func_id), '') AS called_by FROM span s"
    ),
    "a8_diff_summary": (
        "SELECT CAST(4 AS BIGINT) AS files, CAST(2 AS BIGINT) AS matched, "
        f"(SELECT count(*) FROM ({_MODIFIED})) + (SELECT count(*) FROM sym WHERE file = 'FURNITURE') AS symbols, (SELECT count(DISTINCT func_id) FROM ({_AFFECTED})) AS flows, CAST(1 AS BIGINT) AS new_files, CAST(1 AS BIGINT) AS unmatched"
    ),
    "b4_simulated_sequences": (
        "SELECT func_id, string_agg(CASE WHEN element = 3 THEN 'if:1' WHEN prev = 1 THEN repeat('loop:1,call:' || name || ',', 10) || 'loop:0' ELSE 'call:' || name END, ',' ORDER BY position) AS sequence "
        "FROM steps WHERE position > 0 AND thrown <= 1 AND (element = 3 OR element >= 100) GROUP BY func_id"
    ),
    "a11_mock_counts": (
        "SELECT func_id, name, CAST(sum(CASE WHEN prev = 1 THEN 3 ELSE 1 END) AS BIGINT) AS n FROM steps "
        "WHERE position > 0 AND element >= 100 AND thrown <= 1 AND prev <> 3 GROUP BY func_id, name"
    ),
    "b2_unmocked": (
        "SELECT DISTINCT s.name FROM (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 5) JOIN sym s ON s.id = 10000000 + l_partkey WHERE s.name <> 'red bolt'"
    ),
}


def _reworked(sql: str) -> str:
    """DuckDB takes one WITH: a query that starts with its own keeps it inside a subquery."""
    return _with(f"SELECT * FROM ({sql})") if sql.startswith("WITH ") else _with(sql)


def oracle_sql() -> dict[str, str]:
    return {name: _reworked(sql) for name, sql in _SQL.items()}
