"""Usage, configuration and statistics operators over projections of the fixed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import config, graph, normalize, stats, usage
from quarrylens.plans.against import AGAINST
from quarrylens.plans.bind import bound, rows, stated

FIELDS = "SELECT concat('pkg.', CASE WHEN c_custkey % 9 = 0 THEN 'dto.' ELSE '' END, 'C', c_nationkey) AS class_fqn, concat('f', c_custkey % 30) AS name, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'List<Order>' WHEN 1 THEN 'Repo' WHEN 2 THEN 'Map<String,Item>' ELSE 'long' END AS type_text FROM {customer}"
TYPES = "SELECT DISTINCT class_fqn AS fqn, class_fqn AS name, 'class' AS kind, right(class_fqn, 1) = '7' AS is_entity FROM {fields}"
CALLS = "SELECT event_id AS call_id, concat('pkg.C', user_id % 25) AS caller, concat('m', user_id % 7) AS method, CASE CAST(event_id % 7 AS INT) WHEN 0 THEN concat('this.f', event_id % 30) WHEN 1 THEN concat('verify(f', event_id % 30, ')') WHEN 2 THEN concat('doReturn(x).when(this.f', event_id % 30, ')') WHEN 3 THEN concat('other.f', event_id % 30) ELSE concat('f', event_id % 30) END AS scope, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'delete' WHEN 1 THEN 'deleteByName' WHEN 2 THEN 'deleteById' ELSE event_type END AS callee, event_id AS pos FROM {events}"
LOCALS = "SELECT concat('pkg.C', user_id % 40) AS caller, concat('m', user_id % 11) AS method, concat('f', event_id % 15) AS name, concat('Repo', event_id % 4) AS type_text, event_id AS pos FROM {events}"
REFERENCES = "SELECT event_id AS call_id FROM {events} WHERE event_id % 10 = 4"
PARAMS = "SELECT concat('pkg.C', n_nationkey) AS caller, 'm3' AS method, concat('f', n_nationkey) AS name, 'Param' AS type_text FROM {nation}"
ASKED_METHODS = "SELECT 'Repo1' AS class_name, 'delete' AS method UNION ALL SELECT 'Repo', 'deleteById' UNION ALL SELECT 'Param', 'click'"
MEMBERS = "SELECT concat('pkg.C', s_suppkey % 40) AS class_fqn, concat('m', s_suppkey) AS member, CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'EXTENDS' WHEN 1 THEN 'IMPLEMENTS' WHEN 2 THEN 'FIELD' WHEN 3 THEN 'PARAMETER' ELSE 'RETURN_TYPE' END AS kind, concat('pkg.C', s_nationkey) AS base_type FROM {supplier}"
ASKED_TYPES = "SELECT concat('pkg.C', n_nationkey) AS name FROM {nation} WHERE n_nationkey % 2 = 0"
ANNOTATIONS = "SELECT concat('T', o_custkey) AS target, concat('m', o_orderkey % 10) AS member, CASE WHEN o_orderkey % 3 = 0 THEN 'Test' ELSE 'Before' END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'org.junit.Test' ELSE concat('a.b', o_orderkey % 4, '.Before') END AS fqn FROM {orders}"
ASKED_ANNOTATIONS = "SELECT 'Test' AS name UNION ALL SELECT 'b1.Before' UNION ALL SELECT 'a.b2.Before'"
REPOS = "SELECT DISTINCT concat('Repo', n_nationkey % 4) AS name FROM {nation} UNION SELECT 'Repo'"
REPO_QUERIES = "SELECT 'Repo1' AS repo, 'deleteById' AS method, 'update x set gone = 1' AS query, true AS first UNION ALL SELECT 'Repo2', 'delete', 'delete from x', true"
RENAMES = "SELECT concat('r', c_nationkey) AS repo, concat('find', c_custkey) AS old_name, CASE WHEN c_custkey % 13 = 0 THEN concat('find', c_custkey) ELSE concat('by', c_custkey % 6) END AS new_name, c_custkey % 5 > 0 AS mappable, c_custkey AS seq FROM {customer}"
RESERVED = "SELECT concat('r', n_nationkey) AS repo, 'by3' AS name FROM {nation} WHERE n_nationkey % 2 = 0"
LOGS = "SELECT event_id AS call_id, event_id % 11 = 0 AS is_print, event_id % 5 = 0 AS in_catch, event_id % 7 = 0 AS in_loop, event_id % 13 = 0 AS in_controller, false AS in_lambda FROM {events}"
LAYERS = "SELECT concat('p', user_id % 50) AS file, CAST(event_id % 3 AS INT) AS level, event_type AS key, concat('v', event_id) AS value, event_id AS seq FROM {events}"
DEPENDENCIES = "SELECT DISTINCT concat('p', user_id % 50) AS project, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN event_type ELSE concat('g:a', event_id % 9) END AS ga, CASE WHEN event_id % 2 = 0 THEN '' ELSE concat('1.', event_id % 5) END AS version FROM {events}"
FOUND = "SELECT concat('p', o_custkey) AS project, o_orderkey % 4 AS priority, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('2.', o_custkey % 4, '.', o_orderkey % 4) END AS version FROM {orders}"
VERSIONS = "SELECT DISTINCT CASE CAST(p_size % 6 AS INT) WHEN 0 THEN concat('Hoxton.SR', p_size) WHEN 1 THEN 'Greenwich.SR3' WHEN 2 THEN concat('2020.0.', p_size) WHEN 3 THEN concat('2021.0.', p_size) WHEN 4 THEN 'Hoxton' ELSE concat('x', p_size) END AS version FROM {part}"
IMPORTS = "SELECT concat('pkg.C', p_partkey) AS class_fqn, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'javax.persistence.Entity' WHEN 1 THEN 'javax.persistencex.Y' WHEN 2 THEN 'org.springframework.kafka.core.K' WHEN 3 THEN 'com.hazelcast' WHEN 4 THEN 'javax.xml.bind.A' ELSE 'java.util.List' END AS name FROM {part}"
PROPERTIES = "SELECT concat('f', s_suppkey) AS file, CASE CAST(s_suppkey % 6 AS INT) WHEN 0 THEN 'logging.file' WHEN 1 THEN 'server.use-forward-headers' WHEN 2 THEN 'spring.profiles' WHEN 3 THEN 'spring.data.neo4j.uri' WHEN 4 THEN 'spring.profilesx' ELSE 'other' END AS key, CASE WHEN s_suppkey % 4 < 2 THEN 'true' ELSE 'x' END AS value FROM {supplier}"
RESULTS = "SELECT o_custkey AS run, CASE CAST(o_orderkey % 40 AS INT) WHEN 0 THEN 'error' WHEN 1 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'change' END AS kind FROM {orders}"
URLS = "SELECT DISTINCT CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'jdbc:h2:mem:x' WHEN 1 THEN concat('jdbc:postgresql://db', p_size, '/x') WHEN 2 THEN 'jdbc:mysql://localhost/x' WHEN 3 THEN '$URL' ELSE 'http://x' END AS url FROM {part}"
CONTAINER_FIELDS = "SELECT p_partkey AS field, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'PostgreSQLContainer<?>' WHEN 1 THEN 'KafkaContainer' WHEN 2 THEN 'MongoDBContainer' WHEN 3 THEN 'RedisContainer' ELSE 'String' END AS type_text FROM {part}"
OUTCOMES = "SELECT o_orderpriority AS action FROM {orders}"
GROOVY = """SELECT concat('p', o_custkey) AS project, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'property' WHEN 1 THEN 'groovy' ELSE 'spock' END AS kind,
 CASE WHEN o_orderkey % 2 = 0 THEN 'spock-core' ELSE concat('a', o_orderkey) END AS artifact,
 CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN concat('$', chr(123), 'v', chr(125)) WHEN 1 THEN '1.3' WHEN 2 THEN '2.5' WHEN 3 THEN '2.0-groovy-3.0' END AS version FROM {orders}"""
STEP_RUNS = "SELECT o_orderkey AS run, CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN '2.1-2.2' WHEN 1 THEN '2.2-2.3' WHEN 2 THEN '2.3-2.4' ELSE '2.4-2.5' END AS step, o_orderkey % 2 = 0 AS lazy_init, o_orderkey % 3 = 0 AS jakarta, o_custkey % 5 = 0 AS dry_run, o_orderkey % 17 = 0 AS pom_critical FROM {orders}"
RUNS = "SELECT event_type AS repo, " + ", ".join(f"CAST(event_id % {k + 2} AS BIGINT) AS {c}" for k, c in enumerate(stats.COUNTED)) + " FROM {events}"
LINES = """SELECT concat('f', user_id % 3) AS file, event_id AS line_no, CASE WHEN event_id % 3 = 2 THEN 'Date' ELSE concat('d', event_id) END AS date,
 CASE CAST(event_id % 3 AS INT) WHEN 0 THEN upper(event_type) WHEN 1 THEN concat(' ', event_type, chr(65279)) ELSE 'Repository Name' END AS repo,
 CASE WHEN event_id % 2 = 0 THEN concat(' ', user_id % 5) ELSE CAST(user_id % 5 AS STRING) END AS queries, CAST(event_id % 2 AS STRING) AS annotations FROM {events}"""
USED = "SELECT concat(conv_id, '-', turn) AS id, CASE CAST(conv_id % 3 AS INT) WHEN 0 THEN 'gemini-2.5-pro' WHEN 1 THEN 'gpt-4o' ELSE 'gemini-1.5-flash' END AS model, CAST(length(text) * 500 AS BIGINT) AS input_tokens, CAST(length(text) AS BIGINT) AS output_tokens, CAST(length(text) * (turn % 3) AS BIGINT) AS cached_tokens FROM {conversations}"
NAMES = "SELECT c_name AS name FROM {customer}"
SKIPPED = "SELECT c_name AS name FROM {customer} WHERE c_custkey % 5 = 0"
TARGETS = "SELECT c_name AS name FROM {customer} WHERE c_custkey % 2 = 0"
DONE = "SELECT c_name AS name FROM {customer} WHERE c_custkey % 3 = 0"
PAIRS = "SELECT event_type AS grp, concat('u', user_id % 20) AS value FROM {events}"

QUERIES, ORACLES = {}, {}


def _sql(name, op, **inputs):
    QUERIES[name], ORACLES[name] = bound(op, AGAINST[name], **inputs)


_SCOPED = {"calls": CALLS, "locals": LOCALS, "params": PARAMS, "fields": FIELDS, "scoped": usage.SCOPE_TYPES}
_INDEX = {"fields": FIELDS, "deps": usage.FIELD_DEPENDENCIES, "calls": CALLS, "index": usage.CALL_INDEX}


def _table(name, op, rules, names, **inputs):
    """A query whose rules are a fixed table, as VALUES in both engines."""
    values = f"SELECT * FROM (VALUES {', '.join(str(r) for r in rules)}) AS v({', '.join(names)})"
    _sql(name, op, rules=values, renames=values, **inputs)


_sql("u1_collection_fields", usage.COLLECTION_FIELDS, fields=FIELDS, types=TYPES)
_sql("u2_collection_count", usage.COLLECTION_COUNT, fields=FIELDS, types=TYPES, found=usage.COLLECTION_FIELDS)
_sql("u3_method_usages", usage.METHOD_USAGES, **_SCOPED, asked=ASKED_METHODS, refs=REFERENCES)
_sql("u4_scope_types", usage.SCOPE_TYPES, calls=CALLS, locals=LOCALS, params=PARAMS, fields=FIELDS)
_sql("u5_class_usages", usage.CLASS_USAGES, members=MEMBERS, asked=ASKED_TYPES)
_sql("u9_annotated", usage.ANNOTATED, annotations=ANNOTATIONS, asked=ASKED_ANNOTATIONS)
_sql("u11_field_dependencies", usage.FIELD_DEPENDENCIES, fields=FIELDS)
_sql("u13_call_index", usage.CALL_INDEX, fields=FIELDS, deps=usage.FIELD_DEPENDENCIES, calls=CALLS)
_sql("u14_indexed_methods", usage.INDEXED_METHODS, **_INDEX)
_sql("u16_hard_deletes", usage.HARD_DELETES, **_SCOPED, repos=REPOS, queries=REPO_QUERIES)
_sql("u20_admitted_renames", usage.RENAMES, asked=RENAMES, reserved=RESERVED)
_sql("u21_logger_actions", usage.LOGGER_ACTIONS, calls=LOGS)
_sql("m1_merged_properties", config.MERGED, layers=LAYERS)
_sql("m2_managed_versions", config.MANAGED_VERSIONS, layers=LAYERS, dependencies=DEPENDENCIES, managed=config.NEAREST)
_sql("m3_nearest_management", config.NEAREST, layers=LAYERS)
_sql("m4_overlaid_plugins", config.OVERLAID, layers=LAYERS)
_sql("m5_merged_profiles", config.MERGED, layers=LAYERS.replace("event_type AS key", "concat('profile-', event_type) AS key"))
_sql("m6_flatten_summary", config.FLATTEN_SUMMARY, layers=LAYERS)
_sql("m7_detected_version", config.VERSION, found="SELECT project, priority, max(version) AS version FROM (" + FOUND + ") f GROUP BY project, priority")
_table("m8_renamed_properties", config.RENAMED, [p for t in config.RENAMES.values() for p in t.items()], ("old_key", "new_key"), properties=PROPERTIES)
_sql("m10_release_trains", config.TRAINS, versions=VERSIONS)
_sql("m11_has_dependency", config.HAS_DEPENDENCY, dependencies=DEPENDENCIES, asked="SELECT 'g:a1' AS ga UNION ALL SELECT 'click'")
_table("m12_missing_dependency", config.MISSING_DEPENDENCY, [("g:a1", "g:a2"), ("g:a3", "g:zz"), ("click", "g:a5")], ("has", "needs"), dependencies=DEPENDENCIES)
_table("m13_import_rules", config.IMPORT_HITS, [*((f"jakarta {x}", x) for x in config.JAKARTA), *config.IMPORT_RULES.items()], ("rule", "prefix"), imports=IMPORTS)
_table("m14_key_rules", config.KEY_HITS, list(config.KEY_RULES.items()), ("rule", "prefix"), properties=PROPERTIES)
_sql("m16_roll_up", config.ROLL_UP, results=RESULTS)
_sql("m17_containers", config.CONTAINERS, fields=CONTAINER_FIELDS)
_sql("m17_live_urls", config.LIVE_URLS, urls=URLS)
_table("m18_migrated_annotations", config.MIGRATED, list(config.JUNIT.items()), ("old_key", "new_key"), annotations=ANNOTATIONS)
_sql("m19_embedded", config.EMBEDDED, fields=CONTAINER_FIELDS, containers=config.CONTAINERS)
_sql("m20_outcomes", config.OUTCOMES, outcomes=OUTCOMES)
_sql("m26_groovy", config.GROOVY, versions=GROOVY)
_sql("r1_counters", stats.COUNTERS, runs=RUNS)
_sql("r2_csv_dedup", stats.DEDUPED, lines=LINES)
_sql("r5_token_usage", stats.USAGE, used=USED)
_sql("r7_to_do", stats.TO_DO, types=NAMES, targets=TARGETS, skipped=SKIPPED, done=DONE)
_sql("r11_majority", stats.MAJORITY, pairs=PAIRS)
_table("r3_costs", normalize.SqlOp(stats.COSTS.about, stats.COSTS.sql.replace("{prices}", "{rules}")), [(m, *p) for m, p in stats.PRICES.items()], ("model", "in_low", "in_high", "out_low", "out_high", "cached", "tier"), used=USED)


def _inherited(s, d):
    own = rows(s, d, "SELECT concat('T', n_regionkey) AS target, concat('C', n_nationkey) AS cls, n_name AS field FROM {nation} WHERE n_nationkey % 5 = 0")
    return usage.inherited_fields(own, rows(s, d, "SELECT concat('C', (n_nationkey * 3 + 1) % 25) AS child, concat('C', n_nationkey) AS parent FROM {nation}"))


def _rewrites(s, d):
    index = usage.CALL_INDEX(calls=rows(s, d, CALLS), deps=usage.FIELD_DEPENDENCIES(fields=rows(s, d, FIELDS)))
    return usage.REWRITES(index=index, renames=rows(s, d, "SELECT 'Repo' AS repo, 'delete' AS method UNION ALL SELECT 'Repo', 'deleteById' UNION ALL SELECT 'Repo', 'click'"))


def _types(s, d):
    t = rows(s, d, "SELECT p_partkey, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat('List<B', p_size, '>') WHEN 1 THEN concat('a.b.B', p_size, '[]') WHEN 2 THEN concat('B', p_size) ELSE concat('Map<String, B', p_size, '>') END AS t FROM {part}")
    return t.select("p_partkey", usage.base_type(F.col("t")).alias("base"), usage.type_matches(F.col("t"), F.lit("B7")).alias("simple"), usage.type_matches(F.col("t"), F.lit("a.b.B7")).alias("dotted"), usage.type_contains(F.col("t"), F.lit("B7")).alias("contained"))


def _signatures(s, d):
    t = rows(s, d, "SELECT p_partkey, concat('a.C', p_size, '#m', p_partkey, '(int, B)') AS sig FROM {part}")
    cls, method = usage.parsed_signature(F.col("sig"))
    return t.select("p_partkey", cls.alias("cls"), method.alias("method"), usage.method_signature(cls, method, F.array(F.lit("int"), F.lit("B"))).alias("signature"))


def _permuted(s, d):
    t = rows(s, d, "SELECT n_nationkey, array('a', 'b', 'c') AS old, CASE CAST(n_nationkey % 3 AS INT) WHEN 0 THEN array('c', 'a', 'b') WHEN 1 THEN array('a', 'b', 'c') ELSE array('a', 'x', 'c') END AS new FROM {nation}")
    m = usage.position_mapping("old", "new")
    t = t.withColumn("perm", F.transform("new", lambda x: (F.array_position("old", x) - 1).cast("int"))).withColumn("args", F.array(*[F.concat(F.lit(x), "n_nationkey") for x in "pqrs"]))
    ok = t.filter("n_nationkey % 3 < 2").withColumn("moved", F.array_join(usage.reordered("args", "perm"), ","))
    return ok.select("n_nationkey", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit(">"), e["value"].cast("string"))), ",").alias("mapping"), "moved", usage.early_change("old", "new", 2).alias("early"))


def _compared(s, d):
    t = rows(s, d, "SELECT p_partkey, concat('2.', p_size % 5, CASE WHEN p_partkey % 3 = 0 THEN '.0.RELEASE' WHEN p_partkey % 3 = 1 THEN '' ELSE '.1' END) AS a, concat('2.', p_partkey % 4) AS b FROM {part}")
    return t.select("p_partkey", config.compare_versions(F.col("a"), F.col("b")).alias("cmp"))


def _decided(s, d):
    t = rows(s, d, "SELECT p_partkey, p_size FROM {part}")
    kinds = F.array(*[F.lit(x) for x in ("NONE", "WEB", "JSON", "DATABASE_JPA", "GRAPHQL")])
    t = t.withColumn("r", F.array_distinct(F.array(F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")), F.element_at(kinds, (F.col("p_size") % 5 + 1).cast("int")))))
    target, action = config.test_decision(F.col("r"), F.col("p_partkey") % 11 == 0, F.col("p_partkey") % 13 != 0, F.lit("WebMvcTest"), F.col("p_partkey") % 2 == 0)
    return t.select("p_partkey", target.alias("target"), action.alias("action"))


def _unasserted(s, d):
    """Tests from which no asserting method is reached over calls, found by reaching backwards from those."""
    calls = rows(s, d, "SELECT concat('C', CAST(floor(c_custkey / 3) AS BIGINT)) AS source_id, concat('C', c_custkey) AS target_id FROM {customer}")
    seeds = rows(s, d, "SELECT concat('C', c_custkey) AS node FROM {customer} WHERE c_custkey % 9 = 4")
    return config.WITHOUT_ASSERTION(tests=rows(s, d, "SELECT concat('C', c_custkey) AS test FROM {customer}"), asserting=graph.reach(calls, seeds))


def _placeholders(s, d):
    mark = "concat('$', chr(123), '{}', chr(125))".format
    v = rows(s, d, f"SELECT c_custkey AS project, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN concat('1.', c_custkey) WHEN 1 THEN {mark('a')} WHEN 2 THEN concat('1.', {mark('a')}, '-', {mark('gone')}) ELSE {mark('loop')} END AS version FROM {{customer}}")
    p = rows(s, d, f"SELECT c_custkey AS project, 'a' AS key, concat({mark('b')}, '.x') AS value FROM {{customer}} UNION ALL SELECT c_custkey, 'b', concat('9.', c_custkey) FROM {{customer}} UNION ALL SELECT c_custkey, 'loop', {mark('loop')} FROM {{customer}}")
    return config.resolved_placeholders(v, p)


def _asserted(s, d):
    t = rows(s, d, "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN array('msg', 'a', 'b') ELSE array('a') END AS args FROM {nation}")
    return t.select("n_nationkey", F.array_join(config.message_last("args"), ",").alias("args"))


def _json(s, d):
    t = rows(s, d, "SELECT c_custkey, c_name FROM {customer}")
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit('so:\n```json\n["x"]\n```\nor\n```json\n{"results": "'), "c_name", F.lit('"}\n```'))).when(k == 1, F.concat(F.lit("text\n{\"data\": \""), "c_name", F.lit('"}')))
    text = text.when(k == 2, F.concat(F.lit('[not json\n{"z": ["'), "c_name", F.lit('"], "a": [2]}'))).otherwise("none")
    j = t.select("c_custkey", stats.extract_json(text).alias("json"))
    return j.withColumn("inner_text", stats.unwrapped("json"))


QUERIES |= {
    "u6_types": _types,
    "u8_signatures": _signatures,
    "u12_inherited_fields": _inherited,
    "u15_rewrites": _rewrites,
    "u17_permutations": _permuted,
    "m7_placeholders": _placeholders,
    "m27_phases": lambda s, d: config.RUN_PHASES(runs=rows(s, d, STEP_RUNS), phases=config.phase_table(s)),
    "m17_without_assertion": _unasserted,
    "m18_message_last": _asserted,
    "m22_test_decisions": _decided,
    "m24_compared_versions": _compared,
    "r8_json_extraction": _json,
}
ORACLES |= {
    "u6_types": "SELECT p_partkey, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'List' WHEN 1 THEN concat('a.b.B', p_size) WHEN 2 THEN concat('B', p_size) ELSE 'Map' END AS base, p_partkey % 4 IN (1, 2) AND p_size = 7 AS simple, p_partkey % 4 = 1 AND p_size = 7 AS dotted, p_partkey % 4 IN (0, 3) AND p_size = 7 AS contained FROM part",
    "u8_signatures": "SELECT p_partkey, concat('a.C', p_size) AS cls, concat('m', p_partkey) AS method, concat('a.C', p_size, '#m', p_partkey, '(int, B)') AS signature FROM part",
    "u12_inherited_fields": "WITH RECURSIVE x AS (SELECT concat('C', (n_nationkey * 3 + 1) % 25) AS child, concat('C', n_nationkey) AS parent FROM nation), r AS (SELECT concat('T', n_regionkey) AS target, concat('C', n_nationkey) AS cls, n_name AS field FROM nation WHERE n_nationkey % 5 = 0 UNION SELECT r.target, x.child, r.field FROM r JOIN x ON x.parent = r.cls) SELECT * FROM r",
    "u15_rewrites": stated(AGAINST["u15_rewrites"], fields=FIELDS, calls=CALLS),
    "u17_permutations": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '0>1,1>2,2>0' ELSE '0>0,1>1,2>2' END AS mapping, CASE WHEN n_nationkey % 3 = 0 THEN concat('r', n_nationkey, ',p', n_nationkey, ',q', n_nationkey, ',s', n_nationkey) ELSE concat('p', n_nationkey, ',q', n_nationkey, ',r', n_nationkey, ',s', n_nationkey) END AS moved, n_nationkey % 3 = 0 AS early FROM nation WHERE n_nationkey % 3 < 2",
    "m7_placeholders": "SELECT c_custkey AS project, CASE c_custkey % 4 WHEN 0 THEN '1.' || c_custkey WHEN 1 THEN '9.' || c_custkey || '.x' WHEN 2 THEN '1.9.' || c_custkey || '.x-${gone}' ELSE '${loop}' END AS version FROM customer",
    "m22_test_decisions": AGAINST["m22_test_decisions"],
    "m27_phases": stated(AGAINST["m27_phases"], runs=STEP_RUNS),
    "m17_without_assertion": "WITH RECURSIVE e AS (SELECT c_custkey AS caller, c_custkey // 3 AS callee FROM customer), r AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 9 = 4 UNION SELECT e.caller FROM r JOIN e ON e.callee = r.node) SELECT concat('C', c_custkey) AS test FROM customer WHERE c_custkey NOT IN (SELECT node FROM r)",
    "m18_message_last": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a,b,msg' ELSE 'a' END AS args FROM nation",
    "m24_compared_versions": "SELECT p_partkey, CASE WHEN p_size % 5 < p_partkey % 4 THEN -1 WHEN p_size % 5 > p_partkey % 4 THEN 1 WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END AS cmp FROM part",
    "r8_json_extraction": """WITH c AS (SELECT c_custkey, c_name, c_custkey % 4 AS k FROM customer) SELECT c_custkey,
CASE k WHEN 0 THEN '{"results": "' || c_name || '"}' WHEN 1 THEN '{"data": "' || c_name || '"}' WHEN 2 THEN '{"z": ["' || c_name || '"], "a": [2]}' END AS json,
CASE k WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN '["' || c_name || '"]' END AS inner_text FROM c""",
}
