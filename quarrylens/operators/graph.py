"""A property graph of code elements: upserts, neighbours, and methods that only tests call.

nodes(signature, node_type, name, fqn[, seq]) and edges(source_id, target_id, type[, attributes map, seq]); ``seq`` orders writes.
A node without a type is a stub: an edge's end that was never declared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.lineage import cut

EDGE_TYPES = ("CONTAINS", "ENCLOSES", "IMPLEMENTS", "EXTENDS", "CALLS", "ACCESSES", "USES", "REFERENCES", "ANNOTATED_BY")
#: Annotations that make a method a test; the bare names stand for imports that were not resolved.
TEST_ANNOTATIONS = ("org.junit.Test", "org.junit.jupiter.api.Test", "org.junit.jupiter.params.ParameterizedTest", "Test", "ParameterizedTest")


def upsert_nodes(writes: DataFrame) -> DataFrame:
    """One row a signature, from its last write. An aggregate, so hot signatures are combined before the shuffle."""
    last = F.max_by(F.struct("node_type", "name", "fqn"), "seq").alias("last")
    return writes.groupBy("signature").agg(last).select("signature", "last.*")


def upsert_edges(writes: DataFrame) -> DataFrame:
    """One row a (source, type, target); attributes merged, the last value of a key wins."""
    keys = writes.select("source_id", "type", "target_id", "seq", F.explode_outer("attributes").alias("key", "value"))
    last = keys.groupBy("source_id", "type", "target_id", "key").agg(F.max_by("value", "seq").alias("value"))
    entries = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value")))
    return last.groupBy("source_id", "type", "target_id").agg(F.map_from_entries(F.array_sort(entries)).alias("attributes"))


def with_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` and a typeless one for each end of an edge that has none."""
    ends = edges.select(F.col("source_id").alias("signature")).union(edges.select("target_id")).distinct()
    return nodes.unionByName(ends.join(nodes, "signature", "left_anti"), allowMissingColumns=True)


def callers(edges: DataFrame, signatures: DataFrame) -> DataFrame:
    """(signature, caller) for each of ``signatures``."""
    found = edges.filter(F.col("type") == "CALLS").select(F.col("target_id").alias("signature"), F.col("source_id").alias("caller"))
    return found.join(signatures, "signature", "left_semi")


def callees(edges: DataFrame, signatures: DataFrame) -> DataFrame:
    """(signature, callee) for each of ``signatures``."""
    found = edges.filter(F.col("type") == "CALLS").select(F.col("source_id").alias("signature"), F.col("target_id").alias("callee"))
    return found.join(signatures, "signature", "left_semi")


def usages(edges: DataFrame, signatures: DataFrame) -> DataFrame:
    """(signature, user) over USES edges for each of ``signatures``."""
    found = edges.filter(F.col("type") == "USES").select(F.col("target_id").alias("signature"), F.col("source_id").alias("user"))
    return found.join(signatures, "signature", "left_semi")


def outgoing(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (name, type, other) of edges that leave a node whose signature or fqn is one of ``names`` (column name)."""
    starts = _named(nodes, names)
    return edges.select("source_id", "type", "target_id").join(starts, F.col("source_id") == F.col("node")).select("name", "type", F.col("target_id").alias("other")).distinct()


def incoming(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (name, type, other) of edges that reach such a node."""
    ends = _named(nodes, names)
    return edges.select("source_id", "type", "target_id").join(ends, F.col("target_id") == F.col("node")).select("name", "type", F.col("source_id").alias("other")).distinct()


def _named(nodes: DataFrame, names: DataFrame) -> DataFrame:
    keys = nodes.select(F.col("signature").alias("node"), F.explode(F.array_distinct(F.array("signature", "fqn"))).alias("name"))
    return keys.join(names, "name", "left_semi")


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes (column node) on a path of any length, none included, from ``seeds`` (column node) over (source_id, target_id).

    A round adds the targets of the last round's new nodes; cycles end because nodes that were seen are left out.
    """
    steps = edges.select("source_id", "target_id").distinct()
    seen = front = cut(seeds.select("node").distinct())
    while not front.isEmpty():
        found = steps.join(front, F.col("source_id") == F.col("node"), "left_semi").select(F.col("target_id").alias("node")).distinct()
        front = cut(found.join(seen, "node", "left_anti"))
        seen = seen.union(front)
    return seen


def test_only_callees(nodes: DataFrame, edges: DataFrame, annotations=TEST_ANNOTATIONS) -> DataFrame:
    """(fqn, signature, testCallerCount): methods all of whose callers are tests, or inside one, and which aren't tests."""
    marks = nodes.filter((F.col("node_type") == "Annotation") & F.col("fqn").isin(*annotations)).select(F.col("signature").alias("target_id"))
    annotated = edges.filter(F.col("type") == "ANNOTATED_BY").join(marks, "target_id", "left_semi").select(F.col("source_id").alias("node")).distinct()
    methods = nodes.filter(F.col("node_type") == "Method")
    tests = annotated.join(methods, F.col("node") == F.col("signature"), "left_semi")
    within = reach(edges.filter(F.col("type") == "ENCLOSES"), tests).withColumn("is_test", F.lit(True))
    calls = edges.filter(F.col("type") == "CALLS").select(F.col("source_id").alias("node"), F.col("target_id").alias("signature")).distinct()
    told = calls.join(within, "node", "left")
    counts = told.groupBy("signature").agg(F.count("*").alias("callers"), F.count("is_test").alias("testCallerCount")).filter("callers = testCallerCount")
    found = counts.join(methods.select("signature", "fqn"), "signature").join(annotated, F.col("signature") == F.col("node"), "left_anti")
    return found.select("fqn", "signature", "testCallerCount")
