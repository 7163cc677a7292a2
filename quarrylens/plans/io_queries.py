"""Readers and writers over the fixed tables: each query writes to a folder of its own in the shared one and gives what it reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylens.functions.lineage import shared_folder
from quarrylens.plans.bind import duck, rows
from quarrylens.plans.catalog_queries import MAPPINGS
from quarrylens.plans.graph_queries import EDGE_WRITES, EDGES
from quarrylens.plans.graph_queries import ORACLES as GRAPH
from quarrylens.sources import files, java, sinks
from quarrylens.streaming import edges


def _folder(s, name):
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


_HEAD, _END = '<databaseChangeLog xmlns="http://www.liquibase.org/xml/ns/dbchangelog">', "</databaseChangeLog>"
_CHANGE = """CASE CAST(s_suppkey % 4 AS INT)
 WHEN 0 THEN concat('<createIndex indexName="i', s_suppkey, '" tableName="t', s_suppkey % 7, '" unique="true"><column name="a', s_suppkey, '"/><column name=" b "/></createIndex>')
 WHEN 1 THEN concat('<addPrimaryKey constraintName="pk', s_suppkey, '" tableName="t', s_suppkey % 7, '" columnNames="id, x', s_suppkey, '"/>')
 WHEN 2 THEN concat('<sql>DROP INDEX i', s_suppkey, ';</sql>')
 ELSE concat('<addForeignKeyConstraint constraintName="fk', s_suppkey, '" baseTableName="o" baseColumnNames="c" referencedTableName="t', s_suppkey % 7, '" referencedColumnNames="id"/>') END"""


def _changelog(s, d):
    at = _folder(s, "changelog")
    sets = rows(s, d, f"SELECT s_suppkey, concat('<changeSet id=\"', s_suppkey, '\" author=\"x\">', {_CHANGE}, '</changeSet>') AS xml FROM {{supplier}}")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "xml"))), lambda x: x["xml"]), "\n")
    for odd, name in ((0, "even.xml"), (1, "more/odd.xml")):  # a document is one row
        sinks.write_text(s, f"{at}/{name}", f"{_HEAD}\n{sets.filter(F.col('s_suppkey') % 2 == odd).agg(text).first()[0]}\n{_END}")
    sinks.write_text(s, f"{at}/master.xml", f'{_HEAD}<include file="even.xml" relativeToChangelogFile="true"/><includeAll path="more" relativeToChangelogFile="true"/>{_END}')
    return files.read_changelog(s, f"{at}/master.xml")


def _java(s, d):
    at = _folder(s, "java")
    for r in rows(s, d, "SELECT n_nationkey AS k, n_name AS name FROM {nation}").collect():  # a file a row
        sinks.write_text(s, f"{at}/p{r['k'] % 3}/C{r['k']}.java", f"package p{r['k'] % 3};\nclass C{r['k']} {{ String name = \"{r['name']}\"; void m() {{ }} }}\n")
        sinks.write_text(s, f"{at}/notes{r['k']}.txt", "no source")
    return java.nodes_of(java.graph_rows(java.read_java(s, at))).select("signature", "node_type", "name")


def _roots(s, d):
    p = rows(s, d, "SELECT s_suppkey, CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN concat('/a/src/main/resources/db/c', s_suppkey, '.xml') WHEN 1 THEN concat('/a/src/test/resources/c', s_suppkey, '.xml') ELSE concat('/b/d/c', s_suppkey, '.xml') END AS path FROM {supplier}")
    root = files.resource_root(F.col("path"))
    return p.select("s_suppkey", root.alias("root"), files.relative_path(F.col("path"), root).alias("relative"))


def _properties(s, d):
    at = _folder(s, "properties")
    text = rows(s, d, """SELECT CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN concat('# note\nkey.', s_suppkey, ' = value ', s_suppkey) WHEN 1 THEN concat('key.', s_suppkey, ': a', chr(92), '\n   b') ELSE concat('\nkey.', s_suppkey, '=') END AS value FROM {supplier}""")
    text.write.text(at)
    return files.read_properties(s, at).select("key", "value")


def _yaml(s, d):
    at = _folder(s, "yaml")
    value = F.concat(*[F.col("k") if x is None else F.lit(x) for x in ("root", None, ':\n  a: "x # ', None, "\" # note\n  flow: {b: ", None, ", list: [1, 'two, 2']}\n  text: |\n    line # one\n    line two\n  items:\n    - y: z\n    - last")])
    rows(s, d, "SELECT CAST(s_suppkey AS STRING) AS k FROM {supplier}").select(value).write.text(at)
    return files.read_yaml(s, at).select("key", "value")


def _poms(s, d):
    at = _folder(s, "poms")
    n = rows(s, d, "SELECT n_nationkey AS k, n_name AS name FROM {nation}").orderBy("k").collect()
    properties = lambda step, tag: "".join(f"<p{r['k']}>{tag}{r['name']}</p{r['k']}>" for r in n if r["k"] % step == 0)
    sinks.write_text(s, f"{at}/repo/g/top/1/top-1.pom", f"<project><groupId>g</groupId><artifactId>top</artifactId><version>1</version><properties>{properties(1, 'top-')}</properties></project>")
    sinks.write_text(s, f"{at}/w/pom.xml", f"<project><parent><groupId>g</groupId><artifactId>top</artifactId><version>1</version><relativePath/></parent><artifactId>mid</artifactId><properties>{properties(2, 'mid-')}</properties></project>")
    sinks.write_text(s, f"{at}/w/app/pom.xml", f"<project><parent><groupId>g</groupId><artifactId>mid</artifactId><version>1</version></parent><artifactId>app</artifactId><properties>{properties(3, 'app-')}</properties></project>")
    return files.pom_layers(s, f"{at}/w/app/pom.xml", f"{at}/repo").select("level", "kind", "key", "value")


STATS = "SELECT CAST(o_orderdate AS STRING) AS date, concat(' repo', o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END) AS repository, CAST(o_orderkey % 9 AS INT) AS queries_analyzed, 1 AS annotations_changed, 2 AS positions_changed, 3 AS indexes_created, 4 AS indexes_dropped FROM {orders}"


def _stats(s, d):
    at = _folder(s, "stats")
    for odd in (0, 1):  # a run appends to what the last one wrote
        sinks.write_stats(rows(s, d, STATS).filter(F.col("queries_analyzed") % 2 == odd), at)
    return files.read_stats(s, at)


def _checkpoint(s, d):
    at = _folder(s, "state")
    state = rows(s, d, "SELECT 's' AS sessionId, '1' AS startTime, '2' AS lastUpdateTime, array_sort(collect_list(n_name)) AS processed, array('i') AS suggestedIndexes, array() AS modifiedFiles, 'x' AS unknown FROM {nation}")
    sinks.write_checkpoint(state.withColumn("modifiedFiles", F.lit(None).cast("array<string>")).withColumn("sessionId", F.lit("old")), at)
    sinks.write_checkpoint(state.withColumn("modifiedFiles", F.array(F.lit("f"))), at)
    back = files.read_checkpoint(s, at)
    return back.select("sessionId", F.explode("processed").alias("processed"), F.array_join("modifiedFiles", ",").alias("modified"))


def _edges(s, d):
    at = _folder(s, "edges")
    sinks.write_edges(rows(s, d, EDGES).filter("type = 'USES'"), at)
    sinks.write_edges(rows(s, d, EDGES), at, "overwrite")  # clears the graph first
    return s.read.parquet(at).groupBy("type").agg(F.count("*").alias("n"))


def _stream(s, d):
    at = _folder(s, "stream")
    w = rows(s, d, EDGE_WRITES)
    w.select("source_id", "target_id", "type", F.create_map("akey", "aval").alias("attributes"), "seq").write.json(f"{at}/in")
    edges.append_batches(edges.edge_stream(s, f"{at}/in"), f"{at}/out", f"{at}/cp").awaitTermination()
    text = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return edges.graph_table(s, f"{at}/out").select("source_id", "type", "target_id", text.alias("attributes"))


def _csv(s, d):
    at = _folder(s, "csv")
    q = rows(s, d, "SELECT concat('r', o_custkey) AS repository, concat('select \"x\",', chr(13), chr(10), o_orderkey) AS query FROM {orders}")
    sinks.write_queries_csv(q, at)
    return s.read.csv(at, header=True, quote='"', escape='"').select("repository", "query")


def _changeset(s, d):
    at = _folder(s, "written")
    n = rows(s, d, "SELECT n_nationkey AS k, n_name AS name FROM {nation}").orderBy("k").collect()
    sinks.write_text(s, f"{at}/src/main/resources/db/b.xml", sinks.changeset_xml([(f"c{r['k']}", f"UPDATE t SET a = '<{r['name']}>' WHERE b < {r['k']} & 1", "SELECT 1") for r in n]))
    master = f'{_HEAD}<include file="db/a.xml"/>\n{_END}'
    sinks.write_text(s, f"{at}/src/main/resources/db/a.xml", sinks.changeset_xml([("first", "SELECT 'a'", "")]))
    sinks.write_text(s, f"{at}/src/main/resources/master.xml", sinks.with_include(sinks.with_include(master, "b.xml"), "b.xml"))
    return files.read_changelog(s, f"{at}/src/main/resources/master.xml").select("seq", "kind", F.col("object_name").alias("text"))


QUERIES = {
    "s1_java_files": _java,
    "s2_changelog": _changelog,
    "s3_resource_roots": _roots,
    "s5_statistics": _stats,
    "s5_processed": lambda s, d: files.processed_repositories(_stats(s, d)),
    "s6_checkpoint": _checkpoint,
    "s7_properties": _properties,
    "s7_yaml": _yaml,
    "s8_pom_layers": _poms,
    "k2_edges_by_type": _edges,
    "k4_edge_stream": _stream,
    "k5_queries_csv": _csv,
    "k8_changesets": _changeset,
    "k10_mapping_documents": lambda s, d: sinks.mapping_documents(rows(s, d, MAPPINGS)),
}
ORACLES = {
    "s1_java_files": """WITH n AS (SELECT concat('p', n_nationkey % 3, '.C', n_nationkey) AS c, concat('C', n_nationkey) AS s FROM nation)
SELECT c AS signature, 'Class' AS node_type, s AS name FROM n UNION ALL SELECT c || '#name', 'Field', 'name' FROM n UNION ALL SELECT c || '#m()', 'Method', 'm' FROM n""",
    "s2_changelog": """WITH c AS (SELECT s_suppkey AS k, s_suppkey % 4 AS r, row_number() OVER (ORDER BY s_suppkey % 2, s_suppkey) - 1 AS seq FROM supplier)
SELECT seq, ['createIndex', 'addPrimaryKey', 'sql', 'addForeignKey'][1 + r] AS kind, CASE r WHEN 2 THEN NULL WHEN 3 THEN 'o' ELSE 't' || k % 7 END AS table_name, CASE r WHEN 0 THEN 'i' || k WHEN 1 THEN 'pk' || k WHEN 2 THEN 'DROP INDEX i' || k || ';' ELSE 'fk' || k END AS object_name,
CASE r WHEN 0 THEN 'a' || k || ',b' WHEN 1 THEN 'id,x' || k WHEN 3 THEN 'c>t' || k % 7 || '>id' END AS column_csv, r = 0 AS is_unique FROM c""",
    "s3_resource_roots": "SELECT s_suppkey, ['/a/src/main/resources', '/a/src/test/resources', '/b/d'][1 + s_suppkey % 3] AS root, CASE WHEN s_suppkey % 3 = 0 THEN 'db/' ELSE '' END || 'c' || s_suppkey || '.xml' AS relative FROM supplier",
    "s5_statistics": f"WITH w AS ({duck(STATS)}) SELECT date, trim(repository) AS repository, queries_analyzed, annotations_changed, positions_changed, indexes_created, indexes_dropped FROM w",
    "s5_processed": "SELECT DISTINCT concat('repo', o_custkey) AS name FROM orders",
    "s6_checkpoint": "SELECT 's' AS sessionId, n_name AS processed, 'f' AS modified FROM nation",
    "s7_properties": "SELECT concat('key.', s_suppkey) AS key, CASE s_suppkey % 3 WHEN 0 THEN concat('value ', s_suppkey) WHEN 1 THEN 'ab' ELSE '' END AS value FROM supplier",
    "s7_yaml": """SELECT concat('root', s_suppkey, t.k) AS key, replace(t.v, '?', CAST(s_suppkey AS VARCHAR)) AS value FROM supplier,
(VALUES ('.a', 'x # ?'), ('.flow.b', '?'), ('.flow.list[0]', '1'), ('.flow.list[1]', 'two, 2'), ('.text', 'line # one' || chr(10) || 'line two' || chr(10)), ('.items[0].y', 'z'), ('.items[1]', 'last')) t(k, v)""",
    "s8_pom_layers": """SELECT 0 AS level, 'properties' AS kind, concat('p', n_nationkey) AS key, concat('top-', n_name) AS value FROM nation UNION ALL SELECT 1, 'properties', concat('p', n_nationkey), concat('mid-', n_name) FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 2, 'properties', concat('p', n_nationkey), concat('app-', n_name) FROM nation WHERE n_nationkey % 3 = 0""",
    "k2_edges_by_type": GRAPH["q7_edge_count"],
    "k4_edge_stream": GRAPH["k3_upsert_edges"],
    "k5_queries_csv": "SELECT concat('r', o_custkey) AS repository, concat('select \"x\",', chr(9), o_orderkey) AS query FROM orders",
    "k8_changesets": "SELECT 0 AS seq, 'sql' AS kind, 'SELECT ''a''' AS text UNION ALL SELECT n_nationkey + 1, 'sql', concat('UPDATE t SET a = ''<', n_name, '>'' WHERE b < ', n_nationkey, ' & 1') FROM nation",
    "k10_mapping_documents": f"""WITH m AS ({duck(MAPPINGS)}) SELECT source_table, '{{"source_table":"' || source_table || '","mappings":[' || string_agg('{{"view_column":"' || view_column || '","target_table":"' || target_table || '","target_column":"' || target_column || '"}}', ',' ORDER BY seq) || ']}}' AS document FROM m GROUP BY source_table""",
}
