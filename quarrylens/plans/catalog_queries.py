"""Catalog, advisor, SQL-scan and normalization operators over projections of the fixed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import advisor, catalog, normalize, sqlscan
from quarrylens.plans.against import AGAINST
from quarrylens.plans.bind import bound, duck, rows, stated

CHANGES = """
SELECT p_partkey AS seq, CASE CAST(p_partkey % 12 AS INT) WHEN 0 THEN 'createIndex' WHEN 1 THEN 'createIndex' WHEN 2 THEN 'addPrimaryKey' WHEN 3 THEN 'addUniqueConstraint' WHEN 4 THEN 'createTable' WHEN 5 THEN 'createTableUnique'
 WHEN 6 THEN 'addColumnUnique' WHEN 7 THEN 'dropIndex' WHEN 8 THEN 'dropPrimaryKey' WHEN 9 THEN 'dropUniqueConstraint' WHEN 10 THEN 'dropIndex' ELSE 'createIndex' END AS kind,
 CASE WHEN p_partkey % 24 = 10 THEN NULL ELSE p_brand END AS table_name, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 12 IN (0, 1, 8) THEN NULL ELSE concat('i', p_size % 20) END AS object_name,
 CASE WHEN p_size % 9 = 0 THEN '' WHEN p_size % 3 = 0 THEN concat('c', p_size % 5) ELSE concat('c', p_size % 5, ',is_c', p_partkey % 7) END AS column_csv, p_size % 2 = 0 AS is_unique FROM {part}
"""
KEY_CHANGES = "SELECT CAST(n_nationkey AS BIGINT) AS seq, 'addForeignKey' AS kind, n_name AS table_name, concat('fk', n_nationkey) AS object_name, concat('r', n_nationkey % 3, '>region>', CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'r_regionkey' END) AS column_csv, false AS is_unique FROM {nation}"
ASKED_KEYS = "SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS table_name, concat('R', n_nationkey % 2) AS column_name, 'region' AS ref_table FROM {nation}"
ASKED = "SELECT DISTINCT p_brand AS table_name, concat('C', p_size % 5) AS column_name FROM {part}"
ASKED_CSV = "SELECT DISTINCT p_brand AS table_name, concat('C', p_size % 5, ',is_c', p_partkey % 3) AS column_csv FROM {part}"
COLUMNS = "SELECT DISTINCT CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_brand END AS table_name, concat(CASE p_size % 4 WHEN 0 THEN 'is_c' WHEN 1 THEN 'c' WHEN 2 THEN 'x_flag' ELSE 'c9' END, p_partkey % 7) AS column_name, CASE WHEN p_partkey % 5 = 0 THEN 'boolean' WHEN p_partkey % 5 = 1 THEN 'other' END AS data_type FROM {part}"
HIGH = "SELECT 'is_c0' AS name"
LOW = "SELECT 'c9' || '1' AS name"
CONDITIONS = """
SELECT CAST(l_orderkey AS BIGINT) AS query_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('T', l_suppkey % 10) END AS table_name, concat('Col', l_partkey % 6) AS column_name,
 CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS cardinality, l_linenumber AS position, l_linenumber % 3 = 0 AS is_join FROM {lineitem} WHERE l_linenumber < 8
"""
PRIMARY = "SELECT CAST(o_orderkey AS BIGINT) AS query_id, 'T0' AS primary_table, concat('repo', o_custkey % 20) AS repository, CASE o_orderkey % 4 WHEN 0 THEN 'save' ELSE concat('find', o_orderkey % 9) END AS method, o_orderkey % 5 = 0 AS has_body FROM {orders}"
T_INDEXES = "SELECT concat('t', s_suppkey % 10) AS table_name, 'INDEX' AS index_type, concat('i', s_suppkey) AS index_name, CASE WHEN s_suppkey % 3 = 0 THEN concat('col', s_suppkey % 6) ELSE concat('col', s_suppkey % 6, ',col', (s_suppkey + 1) % 6) END AS column_csv, s_suppkey AS seq FROM {supplier}"
COMPOSITES = "SELECT DISTINCT concat('T', l_suppkey % 10) AS table_name, CASE WHEN l_partkey % 3 = 0 THEN concat('a', l_partkey % 5, ',b', l_suppkey % 4) WHEN l_partkey % 3 = 1 THEN concat('A', l_partkey % 5, ',b', l_suppkey % 4, ',c', l_linenumber) ELSE concat('a', l_partkey % 9, ',d_') END AS column_csv FROM {lineitem}"
SINGLES = "SELECT DISTINCT concat('t', l_suppkey % 10) AS table_name, concat('a', l_partkey % 12) AS column_csv FROM {lineitem}"
CARDS = "SELECT DISTINCT concat('t', s_suppkey % 10) AS table_name, concat('col', s_suppkey % 6) AS column_name, CASE WHEN s_suppkey % 6 < 2 THEN 'LOW' ELSE 'HIGH' END AS cardinality FROM {supplier}"
PLANS = "SELECT c_name AS source_table, concat('b', c_custkey % 7) AS base_table, c_custkey AS seq, c_custkey % 3 > 0 AS usable FROM {customer} UNION ALL SELECT c_name, 'b9', c_custkey + 1000000, true FROM {customer}"
NEW_TABLES = "SELECT c_name AS source_table, concat('b', c_custkey % 5) AS table_name FROM {customer}"
MAPPINGS = "SELECT c_name AS source_table, concat('v', n_nationkey) AS view_column, concat('b', n_nationkey % 5) AS target_table, concat('t', n_nationkey) AS target_column, n_nationkey AS seq FROM {customer} JOIN {nation} ON c_nationkey % 5 = n_nationkey % 5"
KEYS = "SELECT c_name AS source_table, concat('b', c_custkey % 5) AS from_table, 'x' AS from_column, concat('b', c_custkey % 6) AS to_table, 'id' AS to_column FROM {customer}"
RELATIONS = "SELECT c_mktsegment AS entity, c_name AS field, concat('b', c_nationkey) AS target FROM {customer}"

_MEMBERS = "SELECT table_name, column_name, index_type, place FROM {m}"


def _indexes(s, d):
    return catalog.replay(rows(s, d, CHANGES))


def _with_members(op, indexes_sql=None, **inputs):
    def query(s, d):
        ix = rows(s, d, indexes_sql) if indexes_sql else _indexes(s, d)
        held = {k: rows(s, d, v) for k, v in inputs.items()}
        names = {n for n in ("indexes", "members") if "{" + n + "}" in op.sql}
        return op(**held, **({"indexes": ix} if "indexes" in names else {}), **({"members": catalog.members(ix)} if "members" in names else {}))

    return query


def _proposed(s, d):
    return advisor.proposals(advisor.COLUMNS_BY_TABLE(conditions=rows(s, d, CONDITIONS.replace("CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('T', l_suppkey % 10) END", "concat('T', l_suppkey % 10)"))))


_COND_T = CONDITIONS.replace("CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('T', l_suppkey % 10) END", "concat('T', l_suppkey % 10)")
def _missing(s, d):
    return _with_members(advisor.MISSING_WHERE, T_INDEXES, conditions=CONDITIONS, queries=PRIMARY)(s, d)


def _missing_join(s, d):
    m = catalog.members(rows(s, d, T_INDEXES))
    return advisor.MISSING_JOIN(conditions=rows(s, d, CONDITIONS), members=m, missing=_missing(s, d))


def _ddl(s, d):
    c = rows(s, d, COMPOSITES).withColumn("name", advisor.index_name(F.col("table_name"), F.col("column_csv")))
    c = c.withColumn("dialect", F.explode(F.array(*[F.lit(x) for x in advisor.DIALECTS])))
    return c.select("dialect", "name", advisor.create_ddl(F.col("dialect"), F.col("name"), F.col("table_name"), F.col("column_csv")).alias("create_sql"), advisor.drop_ddl(F.col("dialect"), F.col("name"), F.col("table_name")).alias("drop_sql"))


LONG_NAMES = "SELECT p_partkey, concat('a_long_schema.table name ', p_brand) AS t, concat('first column ', p_type, ',second_', p_partkey) AS c FROM {part}"


def _long_names(s, d):
    p = rows(s, d, LONG_NAMES)
    return p.select("p_partkey", advisor.index_name(F.col("t"), F.col("c")).alias("name"))


def _raw(s, d):
    text = "concat(CASE p_partkey % 4 WHEN 0 THEN 'CREATE UNIQUE INDEX ' WHEN 1 THEN 'create index concurrently ' WHEN 2 THEN 'DROP INDEX IF EXISTS ' ELSE 'SELECT ' END, 'i', p_partkey, CASE WHEN p_partkey % 4 < 2 THEN concat(' ON ', p_brand, ' (a, b', p_size, ');') ELSE ';' END)"
    return catalog.raw_sql_changes(rows(s, d, f"SELECT p_partkey AS seq, {text} AS sql FROM {{part}}"))


STATEMENTS = """SELECT o_orderkey AS query_id, CASE CAST(o_orderkey % 5 AS INT)
 WHEN 0 THEN concat('SELECT * FROM orders o JOIN customers c ON o.customer_id = c.id WHERE o.status = ? AND c.k', o_custkey % 7, ' > 5')
 WHEN 1 THEN concat('UPDATE users SET a = 1 WHERE user_id = ? AND k', o_custkey % 7, ' NOT LIKE ''x%''')
 WHEN 2 THEN concat('DELETE FROM log WHERE k', o_custkey % 7, ' BETWEEN ? AND ?')
 WHEN 3 THEN concat('SELECT * FROM a WHERE x IS NULL UNION SELECT * FROM b WHERE k', o_custkey % 7, ' IN (1, 2)')
 ELSE 'SELECT 1' END AS sql FROM {orders}"""


def _scanned(s, d):
    return sqlscan.conditions(rows(s, d, STATEMENTS))


_SCAN = """o AS (SELECT o_orderkey AS q, CAST(o_orderkey % 5 AS INT) AS r, concat('k', o_custkey % 7) AS k FROM orders), sc AS (
SELECT q AS query_id, 'WHERE' AS kind, 'orders' AS table_name, 'status' AS column_name, '=' AS operator, 0 AS position, NULL AS right_table, NULL AS right_column FROM o WHERE r = 0
UNION ALL SELECT q, 'WHERE', 'customers', k, '>', 1, NULL, NULL FROM o WHERE r = 0 UNION ALL SELECT q, 'JOIN', 'orders', 'customer_id', '=', 0, 'customers', 'id' FROM o WHERE r = 0
UNION ALL SELECT q, 'WHERE', 'users', 'user_id', '=', 0, NULL, NULL FROM o WHERE r = 1 UNION ALL SELECT q, 'WHERE', 'users', k, 'NOT LIKE', 1, NULL, NULL FROM o WHERE r = 1
UNION ALL SELECT q, 'WHERE', 'log', k, 'BETWEEN', 0, NULL, NULL FROM o WHERE r = 2
UNION ALL SELECT q, 'WHERE', 'a', 'x', 'IS NULL', 0, NULL, NULL FROM o WHERE r = 3 UNION ALL SELECT q, 'WHERE', 'b', k, 'IN', 0, NULL, NULL FROM o WHERE r = 3)"""

_MAP = [("id", "customer", "id"), ("name", "customer", "name"), ("nkey", "customer", "nkey"), ("nkey", "nation", "id"), ("nation", "nation", "nation"), ("rkey", "nation", "rkey"), ("rkey", "region", "id"), ("region", "region", "region")]
_KEYS = [("customer", "nkey", "nation", "id"), ("nation", "rkey", "region", "id")]
_WIDE = "SELECT c_custkey AS id, c_name AS name, CAST(n_nationkey AS BIGINT) AS nkey, n_name AS nation, CAST(r_regionkey AS BIGINT) AS rkey, r_name AS region FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"


def _parts(s, d):
    order = normalize.ordered(["customer", "nation", "region"], [(a, b) for a, _, b, _ in _KEYS])
    return normalize.split(rows(s, d, _WIDE), _MAP, order), order


def _split(s, d):
    parts, order = _parts(s, d)
    counts = [p.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), F.lit(k).alias("place"), "n") for k, (t, p) in enumerate((t, parts[t]) for t in order)]
    return counts[0].union(counts[1]).union(counts[2])


def _rebuilt(s, d):
    parts, _ = _parts(s, d)
    parts = {t: p if t == "customer" else p.distinct() for t, p in parts.items()}
    view = [m for m in _MAP if m not in (("nkey", "nation", "id"), ("rkey", "region", "id"))]
    return normalize.rebuilt(parts, "customer", view, _KEYS)


def _propagated(s, d):
    parts, order = _parts(s, d)
    new = rows(s, d, _WIDE).filter("id % 10 = 0").withColumn("id", F.col("id") + 1_000_000)
    gone = rows(s, d, _WIDE).filter("id % 4 = 1").select("id", F.lit(-1).cast("long").alias("nkey"), F.lit(-1).cast("long").alias("rkey"))
    out = normalize.deleted(normalize.inserted(parts, new, _MAP, order), gone.withColumn("name", F.lit("")), _MAP, order)["customer"]
    change = rows(s, d, _WIDE).filter("id % 4 = 2").select("id", F.upper("name").alias("name"), "nkey")
    return normalize.updated(out, change, [("id", "id"), ("name", "name"), ("nkey", "nkey")])


def _profiles(s, d):
    f = rows(s, d, "SELECT c_mktsegment AS entity, concat('f', c_custkey) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Long' ELSE 'String' END AS java_type, c_custkey % 7 = 0 AS is_transient, c_custkey % 11 = 0 AS is_static, CASE WHEN c_custkey % 3 = 0 THEN 'Other' END AS target, c_custkey AS seq FROM {customer}")
    return normalize.entity_profiles(f)


def _parsed(s, d):
    n = rows(s, d, "SELECT n_nationkey, n_name FROM {nation}")
    text = F.format_string('```json\n{"issues": [{"sourceTable": "%s", "baseTable": "b%d", "newTables": ["x", "y"]}]}\n```', "n_name", "n_nationkey")
    p = normalize.parsed_plans(n.select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, "no json").otherwise(text).alias("text")))
    return p.select("n_nationkey", F.col("plan.sourceTable").alias("source_table"), F.col("plan.baseTable").alias("base_table"), F.size("plan.newTables").alias("n_tables"))


def _cases(s, d):
    return rows(s, d, "SELECT p_partkey, lower(replace(p_type, ' ', '_')) AS n FROM {part}").select("p_partkey", normalize.pascal_case(F.col("n")).alias("pascal"), normalize.camel_case(F.col("n")).alias("camel"))


QUERIES, ORACLES = {}, {}


def _sql(name, op, **inputs):
    QUERIES[name], ORACLES[name] = bound(op, AGAINST[name], **inputs)


_sql("c1_catalog_replay", catalog.REPLAYED, changes=CHANGES, added=catalog.ADDED)
_sql("c2_catalog_additions", catalog.ADDED, changes=CHANGES)
_sql("c10_foreign_keys", catalog.FOREIGN_KEYS, changes=KEY_CHANGES)
_sql("c11_catalog_report", catalog.REPORT, changes=CHANGES, added=catalog.ADDED, indexes=catalog.REPLAYED)
_sql("d8_constraint_names", catalog.CONSTRAINT_NAME, changes=KEY_CHANGES, keys=catalog.FOREIGN_KEYS, asked=ASKED_KEYS)
_sql("d6_prefix_coverage", catalog.COVERED, changes=CHANGES, added=catalog.ADDED, indexes=catalog.REPLAYED, asked=ASKED_CSV)
_sql("a3_columns_by_table", advisor.COLUMNS_BY_TABLE, conditions=CONDITIONS)
_sql("a6_pruned_composites", advisor.PRUNED_COMPOSITES, composites=COMPOSITES)
_sql("a7_pruned_singles", advisor.PRUNED_SINGLES, composites=COMPOSITES, singles=SINGLES)
_sql("a8_drop_candidates", advisor.DROP_CANDIDATES, indexes=T_INDEXES, cardinalities=CARDS)
_sql("a9_covered_by_composite", advisor.COVERED_BY_COMPOSITE, singles=SINGLES, composites="SELECT lower(table_name) AS table_name, column_csv FROM {raw}".replace("{raw}", f"({COMPOSITES}) r"))
_sql("a14_batches", advisor.BATCHES, queries=PRIMARY)
_sql("a16_recommendations", advisor.RECOMMENDED, queries=PRIMARY, batches=advisor.BATCHES, recommendations="SELECT CAST(o_orderkey AS BIGINT) AS query_id, o_orderpriority AS recommendation FROM {orders} WHERE o_orderkey % 3 = 0")
_sql("n2_plan_validation", normalize.VALIDATION, plans=PLANS, new_tables=NEW_TABLES, mappings=MAPPINGS, keys=KEYS)
_sql("n12_external_keys", normalize.EXTERNAL_KEYS, new_tables=NEW_TABLES, relationships=RELATIONS)
_sql("n14_first_plan", normalize.FIRST_PLAN, plans=PLANS)

QUERIES |= {
    "c9_raw_sql_changes": _raw,
    "d1_cardinality": _with_members(catalog.CARDINALITY, columns=COLUMNS, high=HIGH, low=LOW),
    "d3_key_columns": _with_members(catalog.KEY_COLUMNS),
    "d4_unique_columns": _with_members(catalog.UNIQUE_COLUMNS),
    "d5_leading_index": _with_members(catalog.HAS_LEADING, asked=ASKED),
    "a1_missing_where": _missing,
    "a2_missing_join": _missing_join,
    "a4_single_proposals": lambda s, d: advisor.SINGLES(proposals=_proposed(s, d), members=catalog.members(rows(s, d, T_INDEXES))),
    "a5_composite_proposals": lambda s, d: advisor.COMPOSITES(proposals=_proposed(s, d), indexes=rows(s, d, T_INDEXES)),
    "a10_long_index_names": _long_names,
    "a11_index_ddl": _ddl,
    "a12_changeset_ids": lambda s, d: advisor.with_changeset_ids(rows(s, d, COMPOSITES), "idx", 1700000000000, "column_csv"),
    "a15_schema_text": lambda s, d: advisor.schema_text(rows(s, d, CARDS)),
    "x1_conditions": _scanned,
    "x15_where_text": lambda s, d: rows(s, d, STATEMENTS).select("query_id", sqlscan.where_text("sql").alias("where_text")),
    "x17_where_clause": lambda s, d: sqlscan.where_clause(_scanned(s, d).filter("table_name <> 'b'")),
    "x18_first_condition": lambda s, d: sqlscan.first_condition(_scanned(s, d)),
    "x19_first_table": lambda s, d: rows(s, d, STATEMENTS).select("query_id", sqlscan.first_table(F.col("sql")).alias("table_name")),
    "x20_find_condition": lambda s, d: sqlscan.find_condition(_scanned(s, d), "K3"),
    "x2_resolved_conditions": lambda s, d: sqlscan.resolved(_scanned(s, d), rows(s, d, "SELECT 'Orders' AS entity, 't_orders' AS table_name UNION ALL SELECT 'CUSTOMERS', 't_customers'")),
    "x3_derived_conditions": lambda s, d: sqlscan.derived_conditions(rows(s, d, "SELECT CAST(n_nationkey AS BIGINT) AS query_id, n_name AS table_name, array(n_name, concat('r', n_regionkey)) AS params FROM {nation}")),
    "n3_split": _split,
    "n4_grouped_mappings": lambda s, d: normalize.GROUPED_MAPPINGS(mappings=rows(s, d, MAPPINGS)),
    "n5_rebuilt_view": _rebuilt,
    "n8_propagated_changes": _propagated,
    "n16_parsed_plans": _parsed,
    "n17_case_conversion": _cases,
    "s11_entity_profiles": _profiles,
}
ORACLES |= {
    "a10_long_index_names": stated(AGAINST["a10_long_index_names"], names=LONG_NAMES),
    "c9_raw_sql_changes": "SELECT p_partkey AS seq, CASE WHEN p_partkey % 4 < 2 THEN 'createIndex' ELSE 'dropIndex' END AS kind, CASE WHEN p_partkey % 4 < 2 THEN p_brand END AS table_name, concat('i', p_partkey) AS object_name, CASE WHEN p_partkey % 4 < 2 THEN concat('a,b', p_size) END AS column_csv, p_partkey % 4 = 0 AS is_unique FROM part WHERE p_partkey % 4 < 3",
    "d1_cardinality": stated(AGAINST["d1_cardinality"], changes=CHANGES, columns=COLUMNS, high=HIGH, low=LOW),
    "d3_key_columns": stated(AGAINST["d3_key_columns"], changes=CHANGES),
    "d4_unique_columns": stated(AGAINST["d4_unique_columns"], changes=CHANGES),
    "d5_leading_index": stated(AGAINST["d5_leading_index"], changes=CHANGES, asked=ASKED),
    "a1_missing_where": stated(AGAINST["a1_missing_where"], indexes=T_INDEXES, conditions=CONDITIONS, queries=PRIMARY),
    "a2_missing_join": stated(AGAINST["a2_missing_join"], indexes=T_INDEXES, conditions=CONDITIONS, queries=PRIMARY),
    "a4_single_proposals": stated(AGAINST["a4_single_proposals"], indexes=T_INDEXES, conditions=_COND_T),
    "a5_composite_proposals": stated(AGAINST["a5_composite_proposals"], indexes=T_INDEXES, conditions=_COND_T),
    "a11_index_ddl": f"""WITH c AS ({duck(COMPOSITES)}), n AS (SELECT *, lower('idx_' || table_name || '_' || replace(column_csv, ',', '_')) AS name, unnest(['POSTGRESQL', 'ORACLE', 'MYSQL', 'H2']) AS dialect FROM c)
SELECT dialect, name, 'CREATE INDEX ' || CASE dialect WHEN 'POSTGRESQL' THEN 'CONCURRENTLY ' ELSE '' END || name || ' ON ' || table_name || ' (' || replace(column_csv, ',', ', ') || ')' || CASE dialect WHEN 'ORACLE' THEN ' ONLINE;' ELSE ';' END AS create_sql,
CASE dialect WHEN 'POSTGRESQL' THEN 'DROP INDEX CONCURRENTLY IF EXISTS ' || name WHEN 'ORACLE' THEN 'DROP INDEX ' || name WHEN 'MYSQL' THEN 'DROP INDEX ' || name || ' ON ' || table_name ELSE 'DROP INDEX IF EXISTS ' || name END || ';' AS drop_sql FROM n""",
    "a12_changeset_ids": f"WITH c AS ({duck(COMPOSITES)}) SELECT *, 'idx_1700000000000_' || table_name || '_' || row_number() OVER (PARTITION BY table_name ORDER BY column_csv) AS changeset_id FROM c",
    "a15_schema_text": f"WITH c AS ({duck(CARDS)}) SELECT table_name, table_name || ' (' || string_agg(column_name || ':' || cardinality, ', ' ORDER BY column_name || ':' || cardinality) || ')' AS schema FROM c GROUP BY table_name",
    "x1_conditions": f"WITH {_SCAN} SELECT * FROM sc",
    "x15_where_text": "SELECT o_orderkey AS query_id, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN concat('o.status = ? AND c.k', o_custkey % 7, ' > 5') WHEN 1 THEN concat('user_id = ? AND k', o_custkey % 7, ' NOT LIKE ''x%''') WHEN 2 THEN concat('k', o_custkey % 7, ' BETWEEN ? AND ?') WHEN 3 THEN 'x IS NULL' END AS where_text FROM orders",
    "n17_case_conversion": "WITH w AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS w FROM part), p AS (SELECT p_partkey, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), '') AS pascal FROM w) SELECT p_partkey, pascal, lower(pascal[1]) || pascal[2:] AS camel FROM p",
    "x17_where_clause": f"WITH {_SCAN} SELECT query_id, string_agg(column_name || ' ' || operator || ' ?', ' AND ' ORDER BY position) AS clause FROM sc WHERE kind = 'WHERE' AND table_name <> 'b' GROUP BY query_id",
    "x18_first_condition": f"WITH {_SCAN} SELECT query_id, column_name FROM sc WHERE kind = 'WHERE' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position, column_name) = 1",
    "x19_first_table": "SELECT o_orderkey AS query_id, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'orders' WHEN 2 THEN 'log' WHEN 3 THEN 'a' END AS table_name FROM orders",
    "x20_find_condition": f"WITH {_SCAN} SELECT query_id, operator FROM sc WHERE kind = 'WHERE' AND column_name = 'k3'",
    "x2_resolved_conditions": f"WITH {_SCAN} SELECT * REPLACE (CASE table_name WHEN 'orders' THEN 't_orders' WHEN 'customers' THEN 't_customers' ELSE table_name END AS table_name, CASE right_table WHEN 'customers' THEN 't_customers' ELSE right_table END AS right_table) FROM sc",
    "x3_derived_conditions": "SELECT CAST(n_nationkey AS BIGINT) AS query_id, n_name AS table_name, n_name AS column_name, '=' AS operator, 0 AS position FROM nation UNION ALL SELECT n_nationkey, n_name, concat('r', n_regionkey), '=', 1 FROM nation",
    "n3_split": f"WITH w AS ({duck(_WIDE)}) SELECT 'region' AS table_name, 0 AS place, count(*) AS n FROM w UNION ALL SELECT 'nation', 1, count(*) FROM w UNION ALL SELECT 'customer', 2, count(*) FROM w",
    "n4_grouped_mappings": f"WITH m AS ({duck(MAPPINGS)}) SELECT source_table, target_table, string_agg(target_column || '=' || view_column, ',' ORDER BY seq) AS columns FROM m GROUP BY ALL",
    "n5_rebuilt_view": duck(_WIDE),
    "n8_propagated_changes": "WITH c AS (SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nkey FROM customer), a AS (SELECT * FROM c UNION ALL SELECT id + 1000000, name, nkey FROM c WHERE id % 10 = 0) SELECT id, CASE WHEN id % 4 = 2 AND id < 1000000 THEN upper(name) ELSE name END AS name, nkey FROM a WHERE NOT (id % 4 = 1 AND id < 1000000)",
    "n16_parsed_plans": "SELECT n_nationkey, n_name AS source_table, concat('b', n_nationkey) AS base_table, 2 AS n_tables FROM nation WHERE n_nationkey % 5 <> 0",
    "s11_entity_profiles": "WITH f AS (SELECT c_mktsegment AS entity, concat('f', c_custkey) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Long' ELSE 'String' END AS t, c_custkey % 3 = 0 AS r, c_custkey AS seq FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0) SELECT entity, coalesce(string_agg(name || ':' || t, ',' ORDER BY seq) FILTER (NOT r), '') AS columns, coalesce(string_agg(name || '->Other', ',' ORDER BY seq) FILTER (r), '') AS relations FROM f GROUP BY entity",
}
