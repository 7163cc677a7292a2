"""The Java scan over source texts made from the fixed tables, one file a customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import graph
from quarrylens.plans.bind import rows
from quarrylens.sources import java

_SOURCE = "package p;\nimport org.junit.Test;\nclass C%d extends B%d {\n  Repo%d repo;\n  @Test void run(String s) { repo.save(s); other.go(() -> { helper(); }); }\n  void helper() {}\n}\nclass Repo%d { void save(String s) {} }\n"


def _scanned(s, d):
    c = rows(s, d, "SELECT c_custkey, c_nationkey FROM {customer}")
    k = F.col("c_custkey")
    return java.graph_rows(c.select(F.concat(F.lit("f"), k.cast("string")).alias("file"), F.format_string(_SOURCE, k, F.col("c_nationkey"), k, k).alias("source")))


def _edges(s, d):
    e = graph.upsert_edges(java.edges_of(_scanned(s, d)))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return e.select("source_id", "type", "target_id", text.alias("attributes"))


QUERIES = {
    "g1_java_nodes": lambda s, d: graph.upsert_nodes(java.nodes_of(_scanned(s, d))),
    "g6_java_edges": _edges,
    "g14_java_test_only": lambda s, d: graph.test_only_callees(graph.upsert_nodes(java.nodes_of(_scanned(s, d))), java.edges_of(_scanned(s, d)).withColumn("target_id", F.regexp_replace("target_id", r"#save\(\)$", "#save(String)"))),
}
_K = "k AS (SELECT c_custkey AS k, concat('p.C', c_custkey) AS c, concat('p.Repo', c_custkey) AS r, c_nationkey AS n FROM customer)"
_L = "concat(c, '#run(String)$lambda_L5C53_0')"
ORACLES = {
    "g1_java_nodes": f"""WITH {_K} SELECT c AS signature, 'Class' AS node_type, concat('C', k) AS name, c AS fqn FROM k UNION ALL SELECT r, 'Class', concat('Repo', k), r FROM k UNION ALL SELECT concat(c, '#repo'), 'Field', 'repo', c FROM k
UNION ALL SELECT concat(c, '#run(String)'), 'Method', 'run', c FROM k UNION ALL SELECT concat(c, '#helper()'), 'Method', 'helper', c FROM k UNION ALL SELECT concat(r, '#save(String)'), 'Method', 'save', r FROM k
UNION ALL SELECT {_L}, 'Lambda', 'lambda', c FROM k UNION ALL SELECT 'annotation:org.junit.Test', 'Annotation', 'Test', 'org.junit.Test'""",
    "g6_java_edges": f"""WITH {_K} SELECT c AS source_id, 'EXTENDS' AS type, concat('B', n) AS target_id, '' AS attributes FROM k UNION ALL SELECT c, 'CONTAINS', concat(c, unnest(['#repo', '#run(String)', '#helper()'])), '' FROM k
UNION ALL SELECT r, 'CONTAINS', concat(r, '#save(String)'), '' FROM k UNION ALL SELECT concat(c, '#repo'), 'USES', r, '' FROM k UNION ALL SELECT concat(c, '#run(String)'), 'ANNOTATED_BY', 'annotation:org.junit.Test', '' FROM k
UNION ALL SELECT concat(c, '#run(String)'), 'CALLS', concat(r, '#save()'), 'parameterValues=["s"]' FROM k UNION ALL SELECT concat(c, '#run(String)'), 'CALLS', 'other#go()', 'parameterValues=["()->{{helper();}}"];resolution=partial' FROM k
UNION ALL SELECT concat(c, '#run(String)'), 'ENCLOSES', {_L}, 'kind=lambda' FROM k UNION ALL SELECT {_L}, 'CALLS', concat(c, '#helper()'), '' FROM k""",
    "g14_java_test_only": f"WITH {_K} SELECT r AS fqn, concat(r, '#save(String)') AS signature, 1 AS testCallerCount FROM k UNION ALL SELECT c, concat(c, '#helper()'), 1 FROM k",
}
