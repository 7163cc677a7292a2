"""What operators compute, stated again in SQL of the other engine, by query: other joins, windows and functions than the operators' own.

Tables named here are the queries' projections (see ``bind.stated``); none comes from an operator's SQL.
"""

from __future__ import annotations

_ADDED = """added AS (
  SELECT lower(c.table_name) AS table_name, k.t AS index_type, CASE WHEN trim(coalesce(c.object_name, '')) = '' THEN '<unnamed>' ELSE trim(c.object_name) END AS index_name, lower(c.column_csv) AS column_csv, c.seq
  FROM changes c JOIN (VALUES ('createIndex', true, 'UNIQUE_INDEX'), ('createIndex', false, 'INDEX'), ('addPrimaryKey', NULL, 'PRIMARY_KEY'), ('createTable', NULL, 'PRIMARY_KEY'), ('addColumnKey', NULL, 'PRIMARY_KEY'),
    ('addUniqueConstraint', NULL, 'UNIQUE_CONSTRAINT'), ('createTableUnique', NULL, 'UNIQUE_CONSTRAINT'), ('addColumnUnique', NULL, 'UNIQUE_CONSTRAINT')) k(kind, u, t) ON k.kind = c.kind AND (k.u IS NULL OR k.u = c.is_unique)
  WHERE trim(c.column_csv) <> '')"""
# the last drop of each sort that could match, against the place of the entry
_INDEXES = f"""{_ADDED}, drops AS (SELECT kind, lower(table_name) AS t, object_name AS o, max(seq) AS s FROM changes WHERE starts_with(kind, 'drop') GROUP BY ALL),
lost AS (
  SELECT a.seq, a.table_name, a.index_type, a.index_name, a.column_csv FROM added a JOIN drops d ON d.s > a.seq AND d.kind = CASE WHEN contains(a.index_type, 'INDEX') THEN 'dropIndex' WHEN a.index_type = 'PRIMARY_KEY' THEN 'dropPrimaryKey' ELSE 'dropUniqueConstraint' END
  AND (d.t = a.table_name OR d.t IS NULL AND d.kind = 'dropIndex') AND (d.o = a.index_name OR d.o IS NULL AND d.kind = 'dropPrimaryKey')),
indexes AS (SELECT table_name, index_type, index_name, column_csv, min(seq) AS seq FROM (SELECT table_name, index_type, index_name, column_csv, seq FROM added EXCEPT SELECT table_name, index_type, index_name, column_csv, seq FROM lost) GROUP BY ALL)"""
_LEADING = "heads AS (SELECT DISTINCT table_name AS t, lower(trim(string_split(column_csv, ',')[1])) AS c FROM indexes)"
_PROPOSED = """firsts AS (SELECT query_id, lower(table_name) AS t, lower(column_name) AS c, is_join, position FROM conditions WHERE cardinality <> 'LOW' QUALIFY row_number() OVER (PARTITION BY query_id, t, c ORDER BY is_join, position) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY is_join, position, c) AS place FROM firsts),
proposed AS (SELECT query_id, t AS table_name, list(c ORDER BY place) FILTER (place <= 4) AS cs FROM ranked GROUP BY ALL)"""
_MISSING = f"""{_LEADING}, wanted AS (SELECT c.query_id, lower(CASE WHEN c.table_name IS NULL THEN q.primary_table ELSE c.table_name END) AS table_name, lower(c.column_name) AS column_name FROM conditions c JOIN queries q USING (query_id) WHERE NOT is_join AND cardinality <> 'LOW'),
missing AS (SELECT DISTINCT w.* FROM wanted w LEFT JOIN heads l ON l.t = w.table_name AND l.c = w.column_name WHERE l.t IS NULL)"""
_LATEST = "QUALIFY row_number() OVER (PARTITION BY file, key ORDER BY level DESC, seq {}) = 1"
_SCOPED = """p AS (SELECT caller, method, name, max(type_text) AS t FROM params GROUP BY ALL), f AS (SELECT class_fqn, name, max(type_text) AS t FROM fields GROUP BY ALL),
scoped AS (SELECT c.call_id, c.caller, c.method, c.callee, coalesce(l.type_text, p.t, f.t, c.scope) AS scope_type FROM calls c
  ASOF LEFT JOIN locals l ON l.caller = c.caller AND l.method = c.method AND l.name = c.scope AND c.pos > l.pos
  LEFT JOIN p ON p.caller = c.caller AND p.method = c.method AND p.name = c.scope LEFT JOIN f ON f.class_fqn = c.caller AND f.name = c.scope)"""
_INDEX = r"""index AS (SELECT DISTINCT f.type_text AS repo, c.callee AS method, c.caller, f.name AS field FROM calls c JOIN fields f ON f.class_fqn = c.caller
  AND (c.scope IN (f.name, 'this.' || f.name) OR regexp_matches(c.scope, '(^|[.])(verify|when|given)[(](this[.])?' || f.name || '[)]$')))"""
_CONTAINERS = """kinds AS (SELECT f.field, coalesce(arg_min(v.c, v.k), 'NONE') AS container FROM fields f LEFT JOIN (VALUES (1, 'PostgreSQLContainer', 'POSTGRESQL'), (2, 'MySQLContainer', 'MYSQL'), (3, 'MariaDBContainer', 'MARIADB'), (4, 'KafkaContainer', 'KAFKA'),
  (5, 'Redis', 'REDIS'), (6, 'MongoDBContainer', 'MONGODB')) v(k, s, c) ON contains(f.type_text, v.s) GROUP BY f.field)"""
_COUNTED = "queries_analyzed annotations_changed signatures_changed calls_changed repositories_modified dependents_modified indexes_generated indexes_dropped".split()

# The reported phases of each step, in order.
_PHASES = """phases AS (SELECT step, unnest(ps) AS phase, unnest(range(1, 1 + len(ps))) AS k FROM (VALUES
  ('2.1-2.2', ['POM Migration', 'Property Migration', 'Kafka Migration', 'Redis Migration', 'Jedis Configuration Migration', 'JMX Detection', 'ConfigurationPropertiesScan', 'Actuator Configuration Detection', 'Lazy Initialization Configuration', 'Jakarta EE Preparatory Comments', 'Validation']),
  ('2.2-2.3', ['POM Migration', 'Property Migration', 'Validation Starter Detection', 'H2 Console Configuration', 'Spring Cloud Version Migration', 'Cassandra Driver v4 Migration', 'Elasticsearch REST Client Migration', 'Validation']),
  ('2.3-2.4', ['POM Migration', 'Property Migration', 'Configuration Processing', 'Data.sql Processing', 'Neo4j Properties', 'Logback Properties', 'Elasticsearch Detection', 'Hazelcast Detection', 'HTTP Traces Detection', 'R2DBC Detection', 'Validation']),
  ('2.4-2.5', ['POM Migration', 'Property Migration', 'Actuator /info Endpoint', 'Cassandra Throttling', 'Groovy/Spock Upgrade', 'Deprecated Code Fixes', 'Error Message Attribute Detection', 'Validation'])) v(step, ps))"""

AGAINST = {
    # the catalog
    "c1_catalog_replay": f"WITH {_INDEXES} SELECT * FROM indexes",
    "c2_catalog_additions": f"WITH {_ADDED} SELECT * FROM added",
    "c10_foreign_keys": "SELECT object_name AS constraint_name, table_name AS base_table, string_split(column_csv, '>')[1] AS base_column, string_split(column_csv, '>')[2] AS ref_table, CASE string_split(column_csv, '>')[3] WHEN '' THEN NULL ELSE string_split(column_csv, '>')[3] END AS ref_column, seq FROM changes",
    "c11_catalog_report": f"""WITH {_INDEXES}, r AS (SELECT *, list_position(['PRIMARY_KEY', 'UNIQUE', 'INDEX'], regexp_extract(index_type, '^(PRIMARY_KEY|UNIQUE|INDEX)')) AS o FROM indexes)
SELECT table_name, index_type, index_name, column_csv, row_number() OVER (PARTITION BY table_name ORDER BY o, seq, index_name, column_csv) AS place FROM r""",
    "d1_cardinality": f"""WITH {_INDEXES}, keys AS (SELECT DISTINCT table_name AS t, lower(trim(unnest(string_split(column_csv, ',')))) AS c FROM indexes WHERE index_type <> 'INDEX'), l AS (SELECT *, lower(column_name) AS c FROM columns)
SELECT l.table_name, l.column_name, CASE WHEN l.table_name IS NULL OR l.c IS NULL THEN 'MEDIUM' WHEN l.c IN (SELECT name FROM high) THEN 'HIGH' WHEN l.c IN (SELECT name FROM low) THEN 'LOW' WHEN k.t IS NOT NULL THEN 'HIGH' WHEN upper(l.data_type) IN ('BOOLEAN', 'ENUM') THEN 'LOW'
 WHEN l.data_type IS NULL AND regexp_matches(l.c, '^(is|has|can|should)_|_(flag|enabled|active)$|^(active|enabled|deleted|visible)$') THEN 'LOW' ELSE 'MEDIUM' END AS cardinality FROM l LEFT JOIN keys k ON k.t = lower(l.table_name) AND k.c = l.c""",
    "d3_key_columns": f"WITH {_INDEXES}, x AS (SELECT table_name, unnest(string_split(column_csv, ',')) AS c FROM indexes WHERE index_type = 'PRIMARY_KEY') SELECT table_name, lower(trim(c)) AS column_name FROM x GROUP BY ALL",
    "d4_unique_columns": f"WITH {_INDEXES}, x AS (SELECT table_name, unnest(string_split(column_csv, ',')) AS c FROM indexes WHERE starts_with(index_type, 'UNIQUE')) SELECT table_name, lower(trim(c)) AS column_name FROM x GROUP BY ALL",
    "d5_leading_index": f"WITH {_INDEXES}, {_LEADING} SELECT a.table_name, a.column_name FROM asked a JOIN heads l ON l.t = lower(a.table_name) AND l.c = lower(a.column_name)",
    "d6_prefix_coverage": f"WITH {_INDEXES} SELECT a.table_name, a.column_csv FROM asked a WHERE EXISTS (SELECT 1 FROM indexes i WHERE i.table_name = lower(a.table_name) AND starts_with(i.column_csv || ',', lower(a.column_csv) || ','))",
    "d8_constraint_names": """WITH k AS (SELECT object_name AS o, table_name AS t, string_split(column_csv, '>')[1] AS c, seq FROM changes)
SELECT a.table_name, a.column_name, a.ref_table, CASE WHEN k.o IS NULL THEN 'fk_' || a.ref_table || '_' || a.table_name ELSE k.o END AS constraint_name FROM asked a LEFT JOIN k ON lower(k.t) = lower(a.table_name) AND lower(k.c) = lower(a.column_name)
QUALIFY row_number() OVER (PARTITION BY a.table_name, a.column_name, a.ref_table ORDER BY (k.t = a.table_name) DESC, k.seq) = 1""",
    # advice
    "a1_missing_where": f"WITH {_MISSING} SELECT * FROM missing",
    "a2_missing_join": f"""WITH {_MISSING}, j AS (SELECT DISTINCT query_id, lower(table_name) AS table_name, lower(column_name) AS column_name FROM conditions WHERE is_join), open AS (SELECT * FROM j EXCEPT SELECT * FROM missing)
SELECT o.*, o.column_name || ' (JOIN)' AS label FROM open o LEFT JOIN heads l ON l.t = o.table_name AND l.c = o.column_name WHERE l.t IS NULL AND o.table_name IS NOT NULL
UNION ALL SELECT o.*, o.column_name || ' (JOIN)' FROM open o WHERE o.table_name IS NULL""",
    "a3_columns_by_table": f"WITH {_PROPOSED} SELECT query_id, t AS table_name, c AS column_name, place FROM ranked",
    "a4_single_proposals": f"WITH {_PROPOSED}, {_LEADING}, s AS (SELECT DISTINCT table_name, cs[1] AS column_csv FROM proposed WHERE len(cs) = 1) SELECT s.* FROM s WHERE (table_name, column_csv) NOT IN (SELECT (t, c) FROM heads)",
    "a5_composite_proposals": f"WITH {_PROPOSED}, s AS (SELECT DISTINCT table_name, array_to_string(cs, ',') AS column_csv FROM proposed WHERE len(cs) > 1) SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM indexes i WHERE i.table_name = s.table_name AND starts_with(i.column_csv || ',', s.column_csv || ','))",
    "a6_pruned_composites": "WITH c AS (SELECT DISTINCT lower(table_name) AS table_name, lower(column_csv) AS column_csv FROM composites) SELECT a.* FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.table_name = a.table_name AND starts_with(b.column_csv, a.column_csv || ','))",
    "a7_pruned_singles": "WITH s AS (SELECT DISTINCT lower(table_name) AS table_name, lower(column_csv) AS column_csv FROM singles) SELECT * FROM s EXCEPT SELECT lower(table_name), lower(regexp_extract(column_csv, '^[^,]*')) FROM composites",
    "a8_drop_candidates": "WITH low AS (SELECT lower(table_name) AS t, lower(column_name) AS c FROM cardinalities WHERE cardinality = 'LOW') SELECT DISTINCT table_name, index_name FROM indexes WHERE index_type = 'INDEX' AND index_name <> '<unnamed>' AND (lower(table_name), lower(string_split(column_csv, ',')[1])) IN (SELECT (t, c) FROM low)",
    "a9_covered_by_composite": "SELECT table_name, column_csv FROM singles INTERSECT SELECT table_name, string_split(column_csv, ',')[1] FROM composites",
    "a10_long_index_names": """WITH n AS (SELECT p_partkey, lower(regexp_replace('idx_' || t || '_' || c, '[^A-Za-z0-9_]', '_', 'g')) AS f FROM names),
h AS (SELECT *, list_reduce(list_concat([0::BIGINT], list_transform(string_split(f, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS u FROM n)
SELECT p_partkey, CASE WHEN length(f) <= 60 THEN f ELSE left(f, 52) || '_' || lpad(CAST(abs(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) % 10000000 AS VARCHAR), 7, '0') END AS name FROM h""",
    "a14_batches": "SELECT repository, query_id, method, (rank() OVER (PARTITION BY repository ORDER BY query_id) - 1) // 5 AS batch FROM queries WHERE method <> 'save' AND has_body = false",
    "a16_recommendations": "SELECT q.repository, query_id, r.recommendation FROM recommendations r JOIN queries q USING (query_id) WHERE q.method <> 'save' AND q.has_body = false",
    # decomposition
    "n2_plan_validation": """WITH used AS (SELECT source_table, 'mapping' AS fault, target_table AS name FROM mappings UNION SELECT source_table, 'key', unnest([from_table, to_table]) FROM keys UNION SELECT source_table, 'base', base_table FROM plans)
SELECT u.* FROM used u LEFT JOIN new_tables n ON n.source_table = u.source_table AND n.table_name = u.name WHERE n.table_name IS NULL""",
    "n12_external_keys": "SELECT target AS table_name, entity, field FROM relationships r JOIN new_tables t ON t.table_name = r.target WHERE r.target IS DISTINCT FROM r.entity",
    "n14_first_plan": "SELECT source_table, arg_min(base_table, seq) AS base_table, min(seq) AS seq FROM plans WHERE usable GROUP BY source_table",
    # usage
    "u1_collection_fields": "SELECT class_fqn, type_text, name FROM fields WHERE regexp_matches(type_text, 'List|Set|Map|Collection|Queue|Deque') AND NOT contains(lower(class_fqn), 'dto') AND class_fqn IN (SELECT fqn FROM types WHERE NOT is_entity)",
    "u2_collection_count": "SELECT count(*) AS n FROM fields WHERE regexp_matches(type_text, 'List|Set|Map|Collection|Queue|Deque') AND NOT contains(lower(class_fqn), 'dto') AND class_fqn IN (SELECT fqn FROM types WHERE NOT is_entity)",
    "u3_method_usages": f"WITH {_SCOPED} SELECT a.class_name, a.method AS target, s.caller, CASE WHEN s.call_id IN (SELECT call_id FROM refs) THEN s.method || '[ref]' ELSE s.method END AS method FROM asked a, scoped s WHERE (s.scope_type, s.callee) = (a.class_name, a.method)",
    "u4_scope_types": f"WITH {_SCOPED} SELECT * FROM scoped",
    "u5_class_usages": "SELECT DISTINCT base_type AS target, class_fqn AS using_class, kind, member FROM members WHERE base_type <> class_fqn AND base_type IN (SELECT name FROM asked)",
    "u9_annotated": "SELECT DISTINCT target, member FROM annotations a WHERE EXISTS (SELECT 1 FROM asked q WHERE q.name IN (a.fqn, a.name) OR ends_with(a.fqn, '.' || q.name))",
    "u11_field_dependencies": "SELECT type_text AS target, class_fqn AS cls, name AS field FROM fields GROUP BY ALL",
    "u13_call_index": f"WITH {_INDEX} SELECT * FROM index",
    "u14_indexed_methods": f"WITH {_INDEX} SELECT repo, method FROM index GROUP BY ALL",
    "u15_rewrites": f"WITH {_INDEX} SELECT caller, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM index WHERE repo = 'Repo' AND method IN ('delete', 'deleteById', 'click') GROUP BY caller",
    "u16_hard_deletes": f"""WITH {_SCOPED} SELECT call_id, caller, callee FROM scoped WHERE scope_type IN (SELECT name FROM repos)
AND regexp_matches(callee, '^(delete(ById|All|AllById|InBatch|AllInBatch|AllByIdInBatch)?$|deleteBy|removeBy)') AND (scope_type, callee) NOT IN (SELECT (repo, method) FROM queries WHERE first AND NOT starts_with(upper(query), 'DELETE'))""",
    "u20_admitted_renames": "WITH c AS (SELECT * FROM asked WHERE mappable AND old_name <> new_name AND (repo, new_name) NOT IN (SELECT (repo, name) FROM reserved)) SELECT repo, old_name, new_name, seq FROM c QUALIFY seq = min(seq) OVER (PARTITION BY repo, new_name)",
    "u21_logger_actions": "SELECT call_id, CASE WHEN is_print THEN 'REMOVE' WHEN in_catch THEN 'ERROR' ELSE ['DEBUG', 'REMOVE'][1 + CAST(greatest(in_loop, in_controller, in_lambda) AS INT)] END AS action FROM calls",
    # configuration
    "m1_merged_properties": f"SELECT file, key, value FROM layers {_LATEST.format('DESC')}",
    "m2_managed_versions": f"WITH m AS (SELECT file, key, value FROM layers {_LATEST.format('ASC')}) SELECT d.project, d.ga, CASE WHEN d.version <> '' THEN d.version ELSE m.value END AS version FROM dependencies d LEFT JOIN m ON m.file = d.project AND m.key = d.ga",
    "m3_nearest_management": f"SELECT file AS project, key AS ga, value AS version FROM layers {_LATEST.format('ASC')}",
    "m4_overlaid_plugins": f"""WITH v AS (SELECT file, key, value FROM layers {_LATEST.format("DESC")}), p AS (SELECT file, key, level, seq FROM layers QUALIFY row_number() OVER (PARTITION BY file, key ORDER BY level, seq) = 1)
SELECT file, key, value, row_number() OVER (PARTITION BY file ORDER BY level, seq, key) AS place FROM v JOIN p USING (file, key)""",
    "m5_merged_profiles": f"SELECT file, key, value FROM layers {_LATEST.format('DESC')}",
    "m6_flatten_summary": "WITH k AS (SELECT file, key, bool_or(level = 0) AS root FROM layers GROUP BY ALL) SELECT file, count(*) AS n_keys, count(*) FILTER (root) AS n_root FROM k GROUP BY file",
    "m7_detected_version": "SELECT project, version FROM found WHERE version <> '' QUALIFY row_number() OVER (PARTITION BY project ORDER BY priority) = 1",
    "m8_renamed_properties": "SELECT p.file, CASE WHEN r.old_key IS NULL THEN p.key ELSE r.new_key END AS key, CASE WHEN p.key <> 'server.use-forward-headers' THEN p.value WHEN lower(p.value) = 'true' THEN 'native' ELSE 'none' END AS value FROM properties p LEFT JOIN renames r ON r.old_key = p.key",
    "m10_release_trains": r"SELECT version, CASE WHEN version ^@ 'Greenwich' THEN 'ERROR' WHEN version ^@ '2020.0' OR regexp_matches(version, '^Hoxton.*\.SR0*([89]|[1-9][0-9]+)') THEN 'OK' ELSE 'WARNING' END AS verdict FROM versions",
    "m11_has_dependency": "SELECT project, ga FROM dependencies WHERE ga IN (SELECT ga FROM asked) GROUP BY ALL",
    "m12_missing_dependency": "SELECT d.project, r.needs FROM rules r, dependencies d WHERE d.ga = r.has EXCEPT SELECT project, ga FROM dependencies",
    "m13_import_rules": "SELECT DISTINCT class_fqn, rule FROM imports i JOIN rules r ON starts_with(i.name || '.', r.prefix || '.')",
    "m14_key_rules": "SELECT DISTINCT file, rule FROM properties p JOIN rules r ON starts_with(p.key || '.', r.prefix || '.')",
    "m16_roll_up": "SELECT run, sum((kind = 'change')::INT)::BIGINT AS changes, NOT bool_or(kind IN ('error', 'critical')) AS successful FROM results GROUP BY run",
    "m17_containers": f"WITH {_CONTAINERS} SELECT * FROM kinds",
    "m17_live_urls": r"SELECT url, contains(url, 'jdbc:') AND NOT regexp_matches(url, ':h2:|:hsqldb:|:derby:|localhost|127\.0\.0\.1|^\$[{]') AS live FROM urls",
    "m18_migrated_annotations": "SELECT target, CASE name WHEN 'Before' THEN 'BeforeEach' WHEN 'After' THEN 'AfterEach' WHEN 'BeforeClass' THEN 'BeforeAll' WHEN 'AfterClass' THEN 'AfterAll' WHEN 'Ignore' THEN 'Disabled' WHEN 'RunWith' THEN 'ExtendWith' WHEN 'Category' THEN 'Tag' ELSE name END AS name FROM annotations",
    "m19_embedded": f"WITH {_CONTAINERS} SELECT field, CASE WHEN container LIKE '%SQL' OR container = 'MARIADB' THEN 'H2' WHEN container = 'MONGODB' THEN 'EmbeddedMongo' ELSE 'Embedded' || container[1] || lower(container[2:]) END AS embedded FROM kinds WHERE container <> 'NONE'",
    "m20_outcomes": "SELECT DISTINCT action, count(*) OVER (PARTITION BY action) AS n FROM outcomes",
    "m22_test_decisions": """WITH k AS (SELECT p_partkey AS p, ['NONE', 'WEB', 'JSON', 'DATABASE_JPA', 'GRAPHQL'] AS k, p_size AS z FROM part),
r AS (SELECT p, list_sort(list_distinct(list_filter([k[1 + p % 5], k[1 + z % 5]], lambda x: x <> 'NONE'))) AS r FROM k),
t AS (SELECT p, CASE WHEN p % 13 = 0 THEN NULL WHEN p % 11 = 0 THEN 'SpringBootTest(RANDOM_PORT)' WHEN len(r) = 0 THEN 'UnitTest' WHEN p % 2 = 1 THEN 'SpringBootTest' WHEN r = ['DATABASE_JPA'] THEN 'DataJpaTest'
  WHEN r IN (['WEB'], ['JSON', 'WEB']) THEN 'WebMvcTest' WHEN r = ['JSON'] THEN 'JsonTest' WHEN r = ['GRAPHQL'] THEN 'GraphQlTest' ELSE 'SpringBootTest' END AS target FROM r)
SELECT p AS p_partkey, target, CASE WHEN target IS NULL THEN 'SKIPPED' WHEN target = 'WebMvcTest' THEN 'KEPT' WHEN target = 'SpringBootTest' THEN 'REVERTED' ELSE 'CONVERTED' END AS action FROM t""",
    "m26_groovy": """WITH g AS (SELECT project, kind, artifact, version, '3.0.8' AS r, false AS w FROM versions WHERE kind <> 'spock'), s AS (SELECT project, kind, artifact, version, '2.0-groovy-3.0' AS r, coalesce(artifact = 'spock-core' AND version LIKE '1.%', false) AS w FROM versions WHERE kind = 'spock')
SELECT project, kind, artifact, CASE WHEN kind = 'property' OR version NOT LIKE '${%' THEN r END AS raised_to, w AS warns FROM g UNION ALL SELECT project, kind, artifact, CASE WHEN version IS NULL OR version = r THEN NULL ELSE r END, w FROM s""",
    "m27_phases": f"""WITH {_PHASES}, told AS (SELECT r.run, p.phase, p.k FROM runs r JOIN phases p ON p.step = r.step
  WHERE CASE WHEN r.pom_critical THEN p.k = 1 WHEN p.phase = 'Validation' THEN NOT r.dry_run WHEN p.phase LIKE 'Lazy%' THEN r.lazy_init WHEN p.phase LIKE 'Jakarta%' THEN r.jakarta ELSE true END)
SELECT run, phase, rank() OVER (PARTITION BY run ORDER BY k) AS place FROM told""",
    # statistics
    "r1_counters": f"SELECT repo, {', '.join(f'sum({c})::BIGINT AS {c}' for c in _COUNTED)} FROM runs GROUP BY repo UNION ALL SELECT NULL, {', '.join(f'sum({c})::BIGINT' for c in _COUNTED)} FROM runs",
    "r2_csv_dedup": """WITH c AS (SELECT file, line_no, trim(replace(date, '﻿', '')) AS date, trim(replace(repo, '﻿', '')) AS repo, trim(queries) AS queries, trim(annotations) AS annotations FROM lines),
h AS (SELECT *, lower(date) = 'date' AND lower(repo) = 'repository name' AS head FROM c), b AS (SELECT *, max(head) OVER (PARTITION BY file ORDER BY line_no) AS begun FROM h)
SELECT file, lower(repo) AS repo_key, queries, annotations, line_no, repo, count(*) OVER k AS n FROM b WHERE begun AND NOT head WINDOW k AS (PARTITION BY file, lower(repo), queries, annotations) QUALIFY line_no = min(line_no) OVER k""",
    "r3_costs": """SELECT u.id, CAST(round((u.input_tokens - u.cached_tokens + u.cached_tokens * p.cached) * if(u.input_tokens <= p.tier, p.in_low, p.in_high) / 1e6, 12) AS DOUBLE) AS input_cost,
CAST(round(u.output_tokens * if(u.input_tokens <= p.tier, p.out_low, p.out_high) / 1e6, 12) AS DOUBLE) AS output_cost FROM used u JOIN rules p USING (model)""",
    "r5_token_usage": "SELECT model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, coalesce(round(100.0 * sum(cached_tokens) / nullif(sum(input_tokens), 0), 6), 0)::DOUBLE AS cached_percent FROM used GROUP BY model",
    "r7_to_do": "SELECT name FROM types WHERE name IN (SELECT name FROM targets) EXCEPT SELECT name FROM skipped EXCEPT SELECT name FROM done",
    "r11_majority": "WITH c AS (SELECT grp, value, count(*) AS n FROM pairs GROUP BY ALL) SELECT grp, min(value) AS value FROM c WHERE (grp, n) IN (SELECT (grp, max(n)) FROM c GROUP BY grp) GROUP BY grp",
}
