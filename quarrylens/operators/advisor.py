"""Index advice from conditions of queries: what is missing, what to propose, what is redundant, names and DDL.

conditions(query_id, table_name, column_name, cardinality, position, is_join); indexes and members as in the catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.sqlop import SqlOp, starts

MISSING_WHERE = SqlOp(
    "Columns of conditions, not LOW, that lead no index; a condition without a table is of the query's first one.",
    """
SELECT DISTINCT c.query_id, lower(coalesce(c.table_name, q.primary_table)) AS table_name, lower(c.column_name) AS column_name
FROM {conditions} c JOIN {queries} q ON q.query_id = c.query_id
WHERE NOT c.is_join AND c.cardinality <> 'LOW' AND NOT EXISTS (
  SELECT 1 FROM {members} m WHERE m.place = 1 AND m.table_name = lower(coalesce(c.table_name, q.primary_table)) AND m.column_name = lower(c.column_name))""",
)
MISSING_JOIN = SqlOp(
    "Right-hand columns of joins that lead no index and aren't missing already.",
    """
SELECT DISTINCT j.query_id, lower(j.table_name) AS table_name, lower(j.column_name) AS column_name, concat(lower(j.column_name), ' (JOIN)') AS label
FROM {conditions} j
WHERE j.is_join
  AND NOT EXISTS (SELECT 1 FROM {members} m WHERE m.place = 1 AND m.table_name = lower(j.table_name) AND m.column_name = lower(j.column_name))
  AND NOT EXISTS (SELECT 1 FROM {missing} w WHERE w.query_id = j.query_id AND w.table_name = lower(j.table_name) AND w.column_name = lower(j.column_name))""",
)
COLUMNS_BY_TABLE = SqlOp(
    "Columns a query needs of a table, in order of first use, LOW ones left out; joins after conditions.",
    """
SELECT query_id, table_name, column_name, row_number() OVER (PARTITION BY query_id, table_name ORDER BY first_use, column_name) AS place
FROM (
  SELECT query_id, lower(table_name) AS table_name, lower(column_name) AS column_name, min(struct(is_join, position)) AS first_use
  FROM {conditions} WHERE cardinality <> 'LOW' GROUP BY query_id, lower(table_name), lower(column_name)
) x""",
)
SINGLES = SqlOp(
    "Proposals of one column: not led by an index.",
    """
SELECT DISTINCT table_name, column_csv FROM {proposals} p
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM {members} m WHERE m.place = 1 AND m.table_name = p.table_name AND m.column_name = p.column_csv)""",
)
COMPOSITES = SqlOp(
    "Proposals of several columns, the first k of each: not the start of an index. Each index gives its starts, so tables with many are no products.",
    f"""
WITH starts AS (SELECT DISTINCT table_name, start FROM {{indexes}} LATERAL VIEW explode({starts("column_csv")}) v AS start)
SELECT DISTINCT p.table_name, p.column_csv FROM {{proposals}} p LEFT ANTI JOIN starts s ON s.table_name = p.table_name AND s.start = p.column_csv
WHERE p.n > 1""",
)
PRUNED_COMPOSITES = SqlOp(
    "Composites that no other of their table strictly starts with; case is ignored. Each gives its own starts, which are then left out.",
    f"""
WITH lists AS (SELECT DISTINCT lower(table_name) AS table_name, lower(column_csv) AS column_csv FROM {{composites}}),
starts AS (SELECT DISTINCT table_name, start FROM lists LATERAL VIEW explode({starts("column_csv")}) v AS start WHERE start <> column_csv)
SELECT l.table_name, l.column_csv FROM lists l LEFT ANTI JOIN starts s ON s.table_name = l.table_name AND s.start = l.column_csv""",
)
PRUNED_SINGLES = SqlOp(
    "Singles that lead no composite of their table.",
    """
SELECT DISTINCT lower(table_name) AS table_name, lower(column_csv) AS column_csv FROM {singles} s
WHERE NOT EXISTS (SELECT 1 FROM {composites} b WHERE lower(b.table_name) = lower(s.table_name) AND lower(split_part(b.column_csv, ',', 1)) = lower(s.column_csv))""",
)
DROP_CANDIDATES = SqlOp(
    "Plain named indexes whose leading column is LOW.",
    """
SELECT DISTINCT i.table_name, i.index_name
FROM {indexes} i JOIN {cardinalities} c ON lower(c.table_name) = lower(i.table_name) AND lower(c.column_name) = lower(split_part(i.column_csv, ',', 1))
WHERE i.index_type = 'INDEX' AND c.cardinality = 'LOW' AND i.index_name <> '<unnamed>'""",
)
COVERED_BY_COMPOSITE = SqlOp(
    "Singles that a composite of their table starts with.",
    """
SELECT DISTINCT s.table_name, s.column_csv FROM {singles} s
WHERE EXISTS (SELECT 1 FROM {composites} b WHERE b.table_name = s.table_name AND split_part(b.column_csv, ',', 1) = s.column_csv)""",
)
BATCHES = SqlOp(
    "Batches of five queries a repository, in order; methods with a body, and save, are left out.",
    """
SELECT repository, query_id, method, CAST(floor((row_number() OVER (PARTITION BY repository ORDER BY query_id) - 1) / 5) AS BIGINT) AS batch
FROM {queries} WHERE NOT has_body AND method <> 'save'""",
)
RECOMMENDED = SqlOp(
    "Recommendations with their queries, matched by id, so that left-out queries shift nothing.",
    """
SELECT b.repository, b.query_id, r.recommendation FROM {batches} b JOIN {recommendations} r ON r.query_id = b.query_id""",
)

DIALECTS = ("POSTGRESQL", "ORACLE", "MYSQL", "H2")


def proposals(columns: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, table_name, column_csv, n): the first ``most`` columns of each query and table. ``columns``: COLUMNS_BY_TABLE."""
    if not 1 <= most <= 16:
        raise ValueError("an index has 1 to 16 columns here")
    rows = columns.filter(F.col("place") <= most).groupBy("query_id", "table_name").agg(F.array_sort(F.collect_list(F.struct("place", "column_name"))).alias("cs"))
    return rows.select("query_id", "table_name", F.array_join(F.transform("cs", lambda c: c["column_name"]), ",").alias("column_csv"), F.size("cs").alias("n"))


def java_hash(text):
    """Java's String.hashCode of ASCII text, as an expression: h = 31 h + c modulo 2^32, signed."""
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: F.pmod(acc * 31 + F.ascii(c), F.lit(1 << 32)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def index_name(table, csv):
    """idx_table_columns, other characters as _, lower case; over 60 characters: 52 and a hash of 7 digits."""
    clean = lambda c: F.regexp_replace(c, r"\W", "_")
    full = F.lower(F.concat(F.lit("idx_"), clean(table), F.lit("_"), F.array_join(F.transform(F.split(csv, ","), clean), "_")))
    digits = F.lpad((F.abs(java_hash(full)) % 10_000_000).cast("string"), 7, "0")
    return F.when(F.length(full) <= 60, full).otherwise(F.concat(F.substring(full, 1, 52), F.lit("_"), digits))


def create_ddl(dialect, name, table, csv):
    """CREATE INDEX in each dialect."""
    columns = F.concat(F.lit(" ("), F.array_join(F.split(csv, ","), ", "), F.lit(")"))
    tail = F.when(dialect == "ORACLE", " ONLINE;").otherwise(";")
    return F.concat(F.lit("CREATE INDEX "), F.when(dialect == "POSTGRESQL", "CONCURRENTLY ").otherwise(""), name, F.lit(" ON "), table, columns, tail)


def drop_ddl(dialect, name, table):
    """DROP INDEX in each dialect; MySQL's needs the table."""
    return F.when(dialect == "POSTGRESQL", F.concat(F.lit("DROP INDEX CONCURRENTLY IF EXISTS "), name, F.lit(";"))).when(dialect == "ORACLE", F.concat(F.lit("DROP INDEX "), name, F.lit(";"))).when(dialect == "MYSQL", F.concat(F.lit("DROP INDEX "), name, F.lit(" ON "), table, F.lit(";"))).otherwise(F.concat(F.lit("DROP INDEX IF EXISTS "), name, F.lit(";")))


def with_changeset_ids(rows: DataFrame, prefix: str, clock_ms: int, order: str) -> DataFrame:
    """``rows`` with an id each, unique in a run: prefix, the injected clock, and a number within equal (table_name)."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("table_name").orderBy(order))
    return rows.withColumn("changeset_id", F.concat(F.lit(f"{prefix}_{clock_ms}_"), "table_name", F.lit("_"), n.cast("string")))


def schema_text(cardinalities: DataFrame) -> DataFrame:
    """(table_name, schema): table (column:CARDINALITY, …), columns by name."""
    rows = cardinalities.groupBy("table_name").agg(F.array_sort(F.collect_list(F.concat("column_name", F.lit(":"), "cardinality"))).alias("cs"))
    return rows.select("table_name", F.concat("table_name", F.lit(" ("), F.array_join("cs", ", "), F.lit(")")).alias("schema"))
