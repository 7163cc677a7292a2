"""Layered configuration and build files: merges by precedence, property renames, version rules, detectors, test decisions.

layers(file, level, key, value, seq): level 0 is the root parent. Rule tables are DataFrames of fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators.sqlop import SqlOp

# Properties renamed between versions; forward headers also change their value.
RENAMES = {
    "2.1-2.2": {"logging.file": "logging.file.name", "logging.path": "logging.file.path", "server.connection-timeout": "server.tomcat.connection-timeout", "server.use-forward-headers": "server.forward-headers-strategy"},
    "2.2-2.3": {
        "spring.http.encoding.charset": "server.servlet.encoding.charset",
        "spring.http.encoding.enabled": "server.servlet.encoding.enabled",
        "spring.http.encoding.force": "server.servlet.encoding.force",
        "spring.http.encoding.force-request": "server.servlet.encoding.force-request",
        "spring.http.encoding.force-response": "server.servlet.encoding.force-response",
        "spring.http.converters.preferred-json-mapper": "spring.mvc.converters.preferred-json-mapper",
    },
    "2.3-2.4": {},
    "2.4-2.5": {
        "spring.datasource.initialization-mode": "spring.sql.init.mode",
        "spring.datasource.schema": "spring.sql.init.schema-locations",
        "spring.datasource.data": "spring.sql.init.data-locations",
        "spring.datasource.platform": "spring.sql.init.platform",
        "spring.datasource.continue-on-error": "spring.sql.init.continue-on-error",
        "spring.datasource.separator": "spring.sql.init.separator",
        "spring.datasource.sql-script-encoding": "spring.sql.init.encoding",
    },
}
# Packages that move to jakarta.
JAKARTA = ("javax.persistence", "javax.validation", "javax.servlet", "javax.annotation", "javax.transaction", "javax.ejb", "javax.jms", "javax.inject", "javax.xml.bind", "javax.xml.ws", "javax.xml.soap")
# Import prefixes and the migration each asks for.
IMPORT_RULES = {
    "kafka": "org.springframework.kafka", "redis": "org.springframework.data.redis", "hazelcast": "com.hazelcast", "elasticsearch": "org.elasticsearch.client", "cassandra": "com.datastax.driver.core", "r2dbc": "org.springframework.data.r2dbc",
    "hibernate": "org.hibernate.annotations.TypeDef", "validation": "javax.validation", "jmx": "org.springframework.jmx", "httptrace": "org.springframework.boot.actuate.trace.http",
}
# Configuration keys (prefixes) and the detector each belongs to.
KEY_RULES = {
    "legacy-profile": "spring.profiles", "data-sql": "spring.datasource.data", "h2": "spring.h2.console", "http-trace": "management.trace.http", "logback": "logging.pattern.rolling-file-name", "neo4j": "spring.data.neo4j",
    "cassandra-throttling": "spring.data.cassandra.request.throttler", "actuator-info": "management.info", "jedis": "spring.redis.jedis", "lazy-init": "spring.main.lazy-initialization",
}
# Annotations of the older test framework and what replaces them.
JUNIT = {"Before": "BeforeEach", "After": "AfterEach", "BeforeClass": "BeforeAll", "AfterClass": "AfterAll", "Ignore": "Disabled", "RunWith": "ExtendWith", "Category": "Tag"}
# Slices in the order they are tried, with the resource each is for.
SLICES = (("DATABASE_JPA", "DataJpaTest"), ("DATABASE_JDBC", "JdbcTest"), ("WEB", "WebMvcTest"), ("WEBFLUX", "WebFluxTest"), ("REST_CLIENT", "RestClientTest"), ("JSON", "JsonTest"), ("GRAPHQL", "GraphQlTest"))
# Phases of each step in report order; those in OPTIONAL only if they are enabled. Every step begins with FIRST and ends with LAST.
FIRST, LAST = ("POM Migration", "Property Migration"), "Validation"
PHASES = {
    "2.1-2.2": (
        "Kafka Migration",
        "Redis Migration",
        "Jedis Configuration Migration",
        "JMX Detection",
        "ConfigurationPropertiesScan",
        "Actuator Configuration Detection",
        "Lazy Initialization Configuration",
        "Jakarta EE Preparatory Comments",
    ),
    "2.2-2.3": (
        "Validation Starter Detection",
        "H2 Console Configuration",
        "Spring Cloud Version Migration",
        "Cassandra Driver v4 Migration",
        "Elasticsearch REST Client Migration",
    ),
    "2.3-2.4": (
        "Configuration Processing",
        "Data.sql Processing",
        "Neo4j Properties",
        "Logback Properties",
        "Elasticsearch Detection",
        "Hazelcast Detection",
        "HTTP Traces Detection",
        "R2DBC Detection",
    ),
    "2.4-2.5": (
        "Actuator /info Endpoint",
        "Cassandra Throttling",
        "Groovy/Spock Upgrade",
        "Deprecated Code Fixes",
        "Error Message Attribute Detection",
    ),
}
OPTIONAL = ("Lazy Initialization Configuration", "Jakarta EE Preparatory Comments")
# The versions that Groovy and Spock are raised to.
GROOVY_VERSION, SPOCK_VERSION = "3.0.8", "2.0-groovy-3.0"

MERGED = SqlOp(
    "The value of each key: of the deepest level, then the last.",
    """
SELECT file, key, max_by(value, struct(level, seq)) AS value FROM {layers} GROUP BY file, key""",
)
MANAGED_VERSIONS = SqlOp(
    "Dependencies with empty versions filled by group and artifact.",
    """
SELECT d.project, d.ga, coalesce(nullif(d.version, ''), m.version) AS version
FROM {dependencies} d LEFT JOIN {managed} m ON m.project = d.project AND m.ga = d.ga""",
)
NEAREST = SqlOp(
    "Managed versions of the nearest level: the child's own first.",
    """
SELECT file AS project, key AS ga, max_by(value, struct(level, -seq)) AS version FROM {layers} GROUP BY file, key""",
)
OVERLAID = SqlOp(
    "Plugins: a deeper level's configuration wins, the first level's place stays.",
    """
SELECT file, key, max_by(value, struct(level, seq)) AS value,
  row_number() OVER (PARTITION BY file ORDER BY min(struct(level, seq)), key) AS place
FROM {layers} GROUP BY file, key""",
)
FLATTEN_SUMMARY = SqlOp(
    "How many keys each file has, and how many come from which level.",
    """
SELECT file, count(DISTINCT key) AS n_keys, count(DISTINCT CASE WHEN level = 0 THEN key END) AS n_root
FROM {layers} GROUP BY file""",
)
VERSION = SqlOp(
    "A project's version: of its parent, else a dependency, else a property, else the management.",
    """
SELECT project, min_by(version, priority) AS version FROM {found} WHERE coalesce(version, '') <> '' GROUP BY project""",
)
RENAMED = SqlOp(
    "Properties under their new names; forward headers become a strategy.",
    """
SELECT p.file, coalesce(r.new_key, p.key) AS key,
  CASE WHEN r.new_key <> 'server.forward-headers-strategy' OR r.new_key IS NULL THEN p.value
       WHEN lower(p.value) = 'true' THEN 'native' ELSE 'none' END AS value
FROM {properties} p LEFT JOIN {renames} r ON r.old_key = p.key""",
)
TRAINS = SqlOp(
    "Compatibility of release trains.",
    """
SELECT version, CASE
  WHEN left(version, 9) = 'Greenwich' THEN 'ERROR'
  WHEN left(version, 6) = 'Hoxton' AND coalesce(CAST(nullif(regexp_extract(version, '[.]SR([0-9]+)', 1), '') AS INT), 0) < 8 THEN 'WARNING'
  WHEN left(version, 6) IN ('Hoxton', '2020.0') THEN 'OK'
  ELSE 'WARNING' END AS verdict
FROM {versions}""",
)
HAS_DEPENDENCY = SqlOp(
    "Projects with each asked dependency, by group and artifact.",
    """
SELECT DISTINCT d.project, a.ga FROM {dependencies} d JOIN {asked} a ON a.ga = d.ga""",
)
MISSING_DEPENDENCY = SqlOp(
    "Rules whose trigger a project has and whose need it lacks.",
    """
SELECT DISTINCT d.project, r.needs FROM {dependencies} d JOIN {rules} r ON r.has = d.ga
WHERE NOT EXISTS (SELECT 1 FROM {dependencies} e WHERE e.project = d.project AND e.ga = r.needs)""",
)
IMPORT_HITS = SqlOp(
    "Classes an import rule is about: the package itself or below it. The rules are a fixed table.",
    """
SELECT DISTINCT i.class_fqn, r.rule FROM {imports} i
JOIN {rules} r ON i.name = r.prefix OR left(i.name, length(r.prefix) + 1) = concat(r.prefix, '.')""",
)
KEY_HITS = SqlOp(
    "Files a key rule is about: the key itself or below it. The rules are a fixed table.",
    """
SELECT DISTINCT p.file, r.rule FROM {properties} p
JOIN {rules} r ON p.key = r.prefix OR left(p.key, length(r.prefix) + 1) = concat(r.prefix, '.')""",
)
ROLL_UP = SqlOp(
    "Success of a run and its number of changes: no errors, no phase with critical ones.",
    """
SELECT run, count(CASE WHEN kind = 'change' THEN 1 END) AS changes,
  count(CASE WHEN kind IN ('error', 'critical') THEN 1 END) = 0 AS successful
FROM {results} GROUP BY run""",
)
RUN_PHASES = SqlOp(
    "Phases that runs (run, step, lazy_init, jakarta, dry_run, pom_critical) report, in order: all of the step, optional ones if enabled, no validation in a dry run, and the first alone after a critical error in it.",
    """
SELECT r.run, p.phase, row_number() OVER (PARTITION BY r.run ORDER BY p.place) AS place
FROM {runs} r JOIN {phases} p ON p.step = r.step
WHERE (p.place = 1 OR NOT r.pom_critical) AND (p.needs = '' OR p.needs = 'lazy_init' AND r.lazy_init OR p.needs = 'jakarta' AND r.jakarta OR p.needs = 'writes' AND NOT r.dry_run)""",
)
WITHOUT_ASSERTION = SqlOp(
    "Tests from which no assertion is reached.",
    """
SELECT t.test FROM {tests} t WHERE NOT EXISTS (SELECT 1 FROM {asserting} a WHERE a.node = t.test)""",
)
LIVE_URLS = SqlOp(
    "Connection URLs of real servers: no in-memory database, no local host, no placeholder.",
    """
SELECT url, instr(url, 'jdbc:') > 0 AND left(url, 2) <> '$' || chr(123) AND instr(url, ':h2:') = 0 AND instr(url, ':hsqldb:') = 0
  AND instr(url, ':derby:') = 0 AND instr(url, 'localhost') = 0 AND instr(url, '127.0.0.1') = 0 AS live
FROM {urls}""",
)
CONTAINERS = SqlOp(
    "Container types by field type.",
    """
SELECT field, CASE
  WHEN instr(type_text, 'PostgreSQLContainer') > 0 THEN 'POSTGRESQL'
  WHEN instr(type_text, 'MySQLContainer') > 0 THEN 'MYSQL'
  WHEN instr(type_text, 'MariaDBContainer') > 0 THEN 'MARIADB'
  WHEN instr(type_text, 'KafkaContainer') > 0 THEN 'KAFKA'
  WHEN instr(type_text, 'Redis') > 0 THEN 'REDIS'
  WHEN instr(type_text, 'MongoDBContainer') > 0 THEN 'MONGODB'
  ELSE 'NONE' END AS container
FROM {fields}""",
)
EMBEDDED = SqlOp(
    "What replaces each container.",
    """
SELECT field, CASE
  WHEN container IN ('POSTGRESQL', 'MYSQL', 'MARIADB') THEN 'H2'
  WHEN container = 'KAFKA' THEN 'EmbeddedKafka'
  WHEN container = 'REDIS' THEN 'EmbeddedRedis'
  WHEN container = 'MONGODB' THEN 'EmbeddedMongo' END AS embedded
FROM {containers} WHERE container <> 'NONE'""",
)
OUTCOMES = SqlOp("Outcomes by action.", "SELECT action, count(*) AS n FROM {outcomes} GROUP BY action")
MIGRATED = SqlOp(
    "Annotations under their new names.",
    """
SELECT a.target, coalesce(r.new_key, a.name) AS name FROM {annotations} a LEFT JOIN {renames} r ON r.old_key = a.name""",
)
GROOVY = SqlOp(
    "What becomes of versions(project, kind, artifact, version), kind property, groovy or spock: the version it is raised to, or null, and whether it warns. Groovy's property is always raised, its dependencies unless they are placeholders; Spock's always, and its core of 1.x warns too.",
    f"""
SELECT project, kind, artifact, CASE
  WHEN kind = 'property' THEN '{GROOVY_VERSION}'
  WHEN kind = 'groovy' AND version IS NOT NULL AND left(version, 2) <> '$' || chr(123) THEN '{GROOVY_VERSION}'
  WHEN kind = 'spock' AND version <> '{SPOCK_VERSION}' THEN '{SPOCK_VERSION}' END AS raised_to,
  coalesce(kind = 'spock' AND artifact = 'spock-core' AND left(version, 2) = '1.', false) AS warns
FROM {{versions}}""",
)


def phase_table(spark: SparkSession) -> DataFrame:
    """(step, place, phase, needs): ``PHASES`` with what comes before and after."""
    rows = []
    for step, phases in PHASES.items():
        for k, phase in enumerate((*FIRST, *phases, LAST)):
            needs = dict(zip(OPTIONAL, ("lazy_init", "jakarta"), strict=True)).get(phase, "writes" if phase == LAST else "")
            rows.append((step, k + 1, phase, needs))
    return spark.createDataFrame(rows, "step string, place int, phase string, needs string")


def rules(spark: SparkSession, table: dict[str, str], names: tuple[str, str]) -> DataFrame:
    """A rule table as a DataFrame of two columns."""
    return spark.createDataFrame(list(table.items()), f"{names[0]} string, {names[1]} string")


def version_parts(version):
    """Numbers of a dotted version: digits of each part, 0 without any."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(F.nullif(F.regexp_replace(p, "[^0-9]", ""), F.lit("")).try_cast("int"), F.lit(0)))


def compare_versions(a, b):
    """-1, 0 or 1 part by part, missing parts 0; a null is least."""
    pa, pb = version_parts(a), version_parts(b)
    pad = lambda x, n: F.concat(x, F.array_repeat(F.lit(0), n - F.size(x)))
    n = F.greatest(F.size(pa), F.size(pb))
    x, y = pad(pa, n), pad(pb, n)
    return F.when(a.isNull(), -1).when(b.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)


def test_decision(resources, needs_server, known, current, slices_supported):
    """(target, action) of a test class: the annotation its resources ask for, first match wins; KEPT, CONVERTED, REVERTED or SKIPPED."""
    real = F.array_except(resources, F.array(F.lit("NONE")))
    target = F.when(~known, F.lit(None).cast("string")).when(needs_server, "SpringBootTest(RANDOM_PORT)").when(F.size(real) == 0, "UnitTest")
    for resource, annotation in SLICES:
        allowed = F.array(F.lit(resource), F.lit("JSON")) if resource == "WEB" else F.array(F.lit(resource))
        target = target.when(slices_supported & F.array_contains(real, resource) & (F.size(F.array_except(real, allowed)) == 0), annotation)
    target = target.otherwise("SpringBootTest")
    action = F.when(~known, "SKIPPED").when(target == current, "KEPT").when(target == "SpringBootTest", "REVERTED").otherwise("CONVERTED")
    return target, action


def message_last(args: str):
    """Assertion arguments with a leading message moved to the end."""
    a = F.col(args)
    return F.when(F.size(a) > 1, F.concat(F.slice(a, F.lit(2), F.size(a) - 1), F.slice(a, 1, 1))).otherwise(a)


def resolved_placeholders(versions: DataFrame, properties: DataFrame) -> DataFrame:
    """(project, version) with every ``${name}`` in it replaced by properties(project, key, value), again while that changes anything.

    Names without a property stay; so does a name that its own value leads back to. A project's properties are one file's, few: they
    travel as a map, and a row is done within as many rounds as its project has properties.
    """
    held = properties.filter("key IS NOT NULL").groupBy("project").agg(F.map_from_entries(F.collect_set(F.struct("key", F.coalesce("value", F.lit(""))))).alias("_map"))
    rows = versions.join(held, "project", "left")
    none = F.create_map().cast("map<string,string>")

    def once(text, table):
        parts = F.split(text, r"\$\{")

        def part(x, i):
            name = F.substring_index(x, "}", 1)
            found = (i > 0) & x.contains("}") & F.map_contains_key(table, name)
            whole = F.when(i > 0, F.concat(F.lit("${"), x)).otherwise(x)
            return F.when(found, F.concat(table[name], F.substr(x, F.length(name) + 2))).otherwise(whole)

        return F.array_join(F.transform(parts, part), "")

    table = F.coalesce("_map", none)
    rounds = F.sequence(F.lit(1), F.greatest(F.size(table), F.lit(1)))
    resolved = F.aggregate(rounds, F.col("version"), lambda text, _: once(text, table))
    return rows.select("project", F.when(F.col("version").contains("${"), resolved).otherwise(F.col("version")).alias("version"))
