"""Graph and cycle operators over projections of the fixed tables: orders and line items as methods, customers as callees."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import cycles, graph
from quarrylens.plans.bind import duck, rows

NODES = """
SELECT concat('C', c_custkey) AS signature, 'Method' AS node_type, c_name AS name, concat('pkg.', c_mktsegment) AS fqn FROM {customer}
UNION ALL SELECT concat('O', o_orderkey), 'Method', concat('order', o_orderkey), 'pkg.Order' FROM {orders}
UNION ALL SELECT DISTINCT concat('L', l_orderkey, '-', l_linenumber), 'Lambda', 'line', 'pkg.Line' FROM {lineitem}
UNION ALL SELECT 'annotation:org.junit.Test', 'Annotation', 'Test', 'org.junit.Test'
"""
EDGES = """
SELECT DISTINCT concat('O', l_orderkey) AS source_id, 'ENCLOSES' AS type, concat('L', l_orderkey, '-', l_linenumber) AS target_id FROM {lineitem}
UNION ALL SELECT DISTINCT concat('L', l_orderkey, '-', l_linenumber), 'CALLS', concat('C', o_custkey) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
UNION ALL SELECT concat('O', o_orderkey), 'CALLS', concat('C', o_custkey) FROM {orders}
UNION ALL SELECT concat('O', o_orderkey), 'ANNOTATED_BY', 'annotation:org.junit.Test' FROM {orders} WHERE o_orderpriority <> '5-LOW'
UNION ALL SELECT concat('N', c_nationkey), 'CONTAINS', concat('C', c_custkey) FROM {customer}
UNION ALL SELECT concat('R', n_regionkey), 'CONTAINS', concat('N', n_nationkey) FROM {nation}
UNION ALL SELECT concat('L', l_orderkey, '-', l_linenumber), 'USES', concat('P', l_partkey) FROM {lineitem}
"""
DEPENDENCIES = """
SELECT DISTINCT s AS src, t AS dst FROM (SELECT CAST(s_suppkey AS BIGINT) AS s, CAST(s_suppkey - s_suppkey % 5 + (s_suppkey + 1) % 5 AS BIGINT) AS t FROM {supplier}
UNION ALL SELECT CAST(s_suppkey AS BIGINT), CAST(s_suppkey - s_suppkey % 5 + (s_suppkey + 3) % 5 AS BIGINT) FROM {supplier} WHERE s_suppkey % 2 = 0
UNION ALL SELECT CAST(s_suppkey AS BIGINT), CAST(s_suppkey + 5 AS BIGINT) FROM {supplier} WHERE s_suppkey % 10 = 3) WHERE s <> t
"""
NODE_WRITES = "SELECT concat('U', user_id) AS signature, event_type AS node_type, concat(event_type, '-', event_id) AS name, concat('pkg.U', user_id) AS fqn, event_id AS seq FROM {events}"
EDGE_WRITES = "SELECT concat('U', user_id) AS source_id, 'CALLS' AS type, event_type AS target_id, concat('k', event_id % 3) AS akey, CAST(event_id AS STRING) AS aval, event_id AS seq FROM {events}"


def _beans(spark, d):
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("FIELD", "SETTER", "CONSTRUCTOR")]), (F.col("src") % 3 + 1).cast("int"))
    return rows(spark, d, DEPENDENCIES).withColumn("injection_type", kinds).withColumn("method_count", (F.col("dst") % 4).cast("int"))


def _edge_writes(spark, d):
    w = rows(spark, d, EDGE_WRITES)
    return w.select("source_id", "type", "target_id", F.create_map("akey", "aval").alias("attributes"), "seq")


def _merged(spark, d):
    out = graph.upsert_edges(_edge_writes(spark, d))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("source_id", "type", "target_id", text.alias("attributes"))


def _signatures(spark, d, prefix, key, table):
    return rows(spark, d, f"SELECT concat('{prefix}', {key}) AS signature FROM {{{table}}}")


def _stubs(spark, d):
    out = graph.with_stubs(rows(spark, d, NODES), rows(spark, d, EDGES))
    return out.groupBy(F.coalesce("node_type", F.lit("stub")).alias("node_type")).agg(F.count("*").alias("n"))


def _cut(spark, d):
    beans = _beans(spark, d)
    return cycles.greedy_cut(cycles.elementary_cycles(beans), cycles.edge_weights(beans))


def _after_cut(spark, d):
    beans = _beans(spark, d)
    return cycles.cyclic_components(cycles.without(beans, _cut(spark, d))).select("node", "component")


QUERIES = {
    "q1_callers": lambda s, d: graph.callers(rows(s, d, EDGES), _signatures(s, d, "C", "c_custkey", "customer")),
    "q2_callees": lambda s, d: graph.callees(rows(s, d, EDGES), _signatures(s, d, "O", "o_orderkey", "orders")),
    "q3_usages": lambda s, d: graph.usages(rows(s, d, EDGES), _signatures(s, d, "P", "p_partkey", "part")),
    "q4_test_only_callees": lambda s, d: graph.test_only_callees(rows(s, d, NODES), rows(s, d, EDGES)),
    "q5_outgoing": lambda s, d: graph.outgoing(rows(s, d, NODES), rows(s, d, EDGES), rows(s, d, "SELECT concat('O', o_orderkey) AS name FROM {orders} UNION ALL SELECT 'pkg.Line'")),
    "q6_incoming": lambda s, d: graph.incoming(rows(s, d, NODES), rows(s, d, EDGES), rows(s, d, "SELECT concat('C', c_custkey) AS name FROM {customer} UNION ALL SELECT 'org.junit.Test'")),
    "q7_edge_count": lambda s, d: rows(s, d, EDGES).groupBy("type").agg(F.count("*").alias("n")),
    "k1_upsert_nodes": lambda s, d: graph.upsert_nodes(rows(s, d, NODE_WRITES)),
    "k3_upsert_edges": _merged,
    "k3_stub_nodes": _stubs,
    "y1_dependency_sets": lambda s, d: cycles.dependency_sets(_beans(s, d)).select("src", F.array_join(F.transform("dependencies", lambda x: x.cast("string")), ",").alias("dependencies")),
    "y2_strong_components": lambda s, d: cycles.cyclic_components(_beans(s, d)),
    "y3_elementary_cycles": lambda s, d: cycles.elementary_cycles(_beans(s, d)).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle")),
    "y4_greedy_cut": _cut,
    "y5_edge_weights": lambda s, d: cycles.edge_weights(_beans(s, d)).withColumn("weight", F.round("weight", 6)),
    "y6_reverse_edges": lambda s, d: cycles.with_reverse(_beans(s, d).filter("src < dst"), _beans(s, d)),
    "y7_fixes": lambda s, d: cycles.fixes(_beans(s, d).filter("src < dst"), _beans(s, d)),
    "y8_cycles_through": lambda s, d: cycles.cycles_through(cycles.elementary_cycles(_beans(s, d)), rows(s, d, "SELECT CAST(s_suppkey AS BIGINT) AS bean FROM {supplier} WHERE s_suppkey % 7 = 0")).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle")),
    "y9_formatted_cycles": lambda s, d: cycles.formatted(cycles.elementary_cycles(_beans(s, d))),
    "y10_check_after_cut": _after_cut,
}

_N, _E, _D = duck(NODES), duck(EDGES), duck(DEPENDENCIES)
_B = f"e AS ({_D}), b AS (SELECT src, dst, CASE src % 3 WHEN 0 THEN 'FIELD' WHEN 1 THEN 'SETTER' ELSE 'CONSTRUCTOR' END AS injection_type, dst % 4 AS method_count FROM e)"
_P = f"""WITH RECURSIVE e AS ({_D}), p AS (SELECT src AS start, dst AS cur, [src, dst] AS path FROM e WHERE dst >= src
UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.cur WHERE p.cur <> p.start AND e.dst >= p.start AND (e.dst = p.start OR NOT list_contains(p.path, e.dst))),
c AS (SELECT path FROM p WHERE cur = start)"""

ORACLES = {
    "q1_callers": f"WITH e AS ({_E}) SELECT target_id AS signature, source_id AS caller FROM e WHERE type = 'CALLS' AND target_id IN (SELECT concat('C', c_custkey) FROM customer)",
    "q2_callees": f"WITH e AS ({_E}) SELECT source_id AS signature, target_id AS callee FROM e WHERE type = 'CALLS' AND source_id IN (SELECT concat('O', o_orderkey) FROM orders)",
    "q3_usages": f"""WITH e AS ({_E}) SELECT target_id AS signature, source_id AS "user" FROM e WHERE type = 'USES' AND target_id IN (SELECT concat('P', p_partkey) FROM part)""",
    "q4_test_only_callees": f"""WITH RECURSIVE n AS ({_N}), e AS ({_E}),
t AS (SELECT e.source_id FROM e JOIN n a ON a.signature = e.target_id AND a.fqn IN ('org.junit.Test','org.junit.jupiter.api.Test','org.junit.jupiter.params.ParameterizedTest','Test','ParameterizedTest') WHERE e.type = 'ANNOTATED_BY'),
r AS (SELECT t.source_id AS node FROM t JOIN n m ON m.signature = t.source_id AND m.node_type = 'Method' UNION SELECT e.target_id FROM r JOIN e ON e.source_id = r.node AND e.type = 'ENCLOSES'),
c AS (SELECT target_id, count(DISTINCT source_id) AS a, count(DISTINCT CASE WHEN source_id IN (SELECT node FROM r) THEN source_id END) AS b FROM e WHERE type = 'CALLS' GROUP BY target_id)
SELECT n.fqn, n.signature, c.b AS testCallerCount FROM c JOIN n ON n.signature = c.target_id AND n.node_type = 'Method' WHERE a = b AND a > 0 AND n.signature NOT IN (SELECT source_id FROM t)""",
    "q5_outgoing": f"WITH n AS ({_N}), e AS ({_E}), k AS (SELECT concat('O', o_orderkey) AS name FROM orders UNION ALL SELECT 'pkg.Line') SELECT DISTINCT k.name, e.type, e.target_id AS other FROM k JOIN n ON n.signature = k.name OR n.fqn = k.name JOIN e ON e.source_id = n.signature",
    "q6_incoming": f"WITH n AS ({_N}), e AS ({_E}), k AS (SELECT concat('C', c_custkey) AS name FROM customer UNION ALL SELECT 'org.junit.Test') SELECT DISTINCT k.name, e.type, e.source_id AS other FROM k JOIN n ON n.signature = k.name OR n.fqn = k.name JOIN e ON e.target_id = n.signature",
    "q7_edge_count": f"WITH e AS ({_E}) SELECT type, count(*) AS n FROM e GROUP BY type",
    "k1_upsert_nodes": f"WITH w AS ({duck(NODE_WRITES)}) SELECT signature, node_type, name, fqn FROM w QUALIFY row_number() OVER (PARTITION BY signature ORDER BY seq DESC) = 1",
    "k3_upsert_edges": f"WITH w AS ({duck(EDGE_WRITES)}), l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY source_id, type, target_id, akey ORDER BY seq DESC) = 1) SELECT source_id, type, target_id, string_agg(akey || '=' || aval, ',' ORDER BY akey) AS attributes FROM l GROUP BY ALL",
    "k3_stub_nodes": f"WITH n AS ({_N}), e AS ({_E}), x AS (SELECT source_id AS s FROM e UNION SELECT target_id FROM e) SELECT node_type, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'stub', count(*) FROM x WHERE s NOT IN (SELECT signature FROM n)",
    "y1_dependency_sets": f"WITH e AS ({_D}) SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS dependencies FROM e GROUP BY src",
    "y2_strong_components": f"WITH RECURSIVE e AS ({_D}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src",
    "y3_elementary_cycles": f"{_P} SELECT array_to_string(path, ',') AS cycle FROM c",
    "y5_edge_weights": f"WITH {_B}, i AS (SELECT dst, count(*) AS n FROM e GROUP BY dst) SELECT src, b.dst, round(CASE injection_type WHEN 'FIELD' THEN 1.0 WHEN 'SETTER' THEN 2.0 ELSE 3.0 END + 0.1 * method_count + 0.5 * n, 6)::DOUBLE AS weight FROM b JOIN i USING (dst)",
    "y6_reverse_edges": f"WITH e AS ({_D}) SELECT src, dst FROM e WHERE src < dst UNION SELECT e.src, e.dst FROM e JOIN e f ON e.src = f.dst AND e.dst = f.src WHERE f.src < f.dst",
    "y7_fixes": f"WITH {_B} SELECT src, dst, injection_type, CASE injection_type WHEN 'FIELD' THEN '{cycles.FIXES['FIELD']}' WHEN 'SETTER' THEN '{cycles.FIXES['SETTER']}' ELSE '{cycles.FIXES['CONSTRUCTOR']}' END AS fix FROM b WHERE src < dst",
    "y8_cycles_through": f"{_P} SELECT array_to_string(path, ',') AS cycle FROM c WHERE len(list_filter(path, lambda x: x % 7 = 0)) > 0",
    "y9_formatted_cycles": f"{_P} SELECT array_to_string(path, ' -> ') AS text FROM c",
    # nothing is left: no node of a cycle reaches itself once the chosen edges are gone
    "y10_check_after_cut": "SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS component WHERE false",
}
