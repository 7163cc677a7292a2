"""An index catalog replayed from a changelog, lookups in it, and column cardinality.

changes(seq, kind, table_name, object_name, column_csv, is_unique): one row a change, in the order of ``seq``. A table's columns
that are its key come as kind ``createTable`` (column_csv: the key), each unique one as ``createTableUnique``, before the key.
indexes(table_name, index_type, index_name, column_csv, seq). Names are matched without regard to case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.sqlop import SqlOp, starts

ADDED = SqlOp(
    "Entries that changes add: indexes, keys and unique constraints; entries without a column are none, unnamed ones are <unnamed>.",
    """SELECT lower(table_name) AS table_name,
  CASE WHEN kind = 'createIndex' AND is_unique THEN 'UNIQUE_INDEX' WHEN kind = 'createIndex' THEN 'INDEX'
       WHEN kind IN ('addPrimaryKey', 'createTable', 'addColumnKey') THEN 'PRIMARY_KEY' ELSE 'UNIQUE_CONSTRAINT' END AS index_type,
  coalesce(nullif(trim(object_name), ''), '<unnamed>') AS index_name, lower(column_csv) AS column_csv, seq
FROM {changes} WHERE kind IN ('createIndex', 'addPrimaryKey', 'addUniqueConstraint', 'createTable', 'createTableUnique', 'addColumnKey', 'addColumnUnique') AND coalesce(trim(column_csv), '') <> ''""",
)
REPLAYED = SqlOp(
    "The catalog after all changes: an entry stays unless a later drop matches it; added again after a drop, it is there again. Index drops match by name, in any table if none is named; key drops without a name match every key; unique drops need a name. Of drops alike the last one decides, so an entry meets at most two rows.",
    """
WITH drops AS (SELECT kind, lower(table_name) AS t, object_name AS o, max(seq) AS last FROM {changes} WHERE kind IN ('dropIndex', 'dropPrimaryKey', 'dropUniqueConstraint') GROUP BY kind, lower(table_name), object_name),
  entries AS (SELECT *, CASE WHEN index_type IN ('INDEX', 'UNIQUE_INDEX') THEN 'dropIndex' WHEN index_type = 'PRIMARY_KEY' THEN 'dropPrimaryKey' WHEN index_type = 'UNIQUE_CONSTRAINT' THEN 'dropUniqueConstraint' END AS by FROM {added}),
  wide AS (SELECT kind, coalesce(t, o) AS k, last FROM drops WHERE kind = 'dropIndex' AND t IS NULL OR kind = 'dropPrimaryKey' AND t IS NOT NULL AND o IS NULL)
SELECT a.table_name, a.index_type, a.index_name, a.column_csv, min(a.seq) AS seq FROM entries a
LEFT JOIN drops d ON d.kind = a.by AND d.t = a.table_name AND d.o = a.index_name
LEFT JOIN wide w ON w.kind = a.by AND w.k = CASE a.by WHEN 'dropIndex' THEN a.index_name ELSE a.table_name END
WHERE NOT coalesce(d.last > a.seq, false) AND NOT coalesce(w.last > a.seq, false)
GROUP BY a.table_name, a.index_type, a.index_name, a.column_csv""",
)
REPORT = SqlOp(
    "The catalog in report order: table, then keys, unique entries, indexes.",
    """
SELECT table_name, index_type, index_name, column_csv, row_number() OVER (PARTITION BY table_name
  ORDER BY CASE index_type WHEN 'PRIMARY_KEY' THEN 0 WHEN 'UNIQUE_CONSTRAINT' THEN 1 WHEN 'UNIQUE_INDEX' THEN 1 ELSE 2 END, seq, index_name, column_csv) AS place
FROM {indexes}""",
)
FOREIGN_KEYS = SqlOp(
    "Foreign keys of a changelog; object_name is the constraint, column_csv is column>table>column.",
    """SELECT object_name AS constraint_name, table_name AS base_table, split_part(column_csv, '>', 1) AS base_column, split_part(column_csv, '>', 2) AS ref_table, nullif(split_part(column_csv, '>', 3), '') AS ref_column, seq FROM {changes} WHERE kind = 'addForeignKey'""",
)
CONSTRAINT_NAME = SqlOp(
    "Name of the foreign key on each (table_name, column_name): tables as written before tables alike but for case, then the first; else a made name.",
    """SELECT a.table_name, a.column_name, a.ref_table, coalesce(min_by(f.constraint_name, struct(f.base_table <> a.table_name, f.seq)), concat('fk_', a.ref_table, '_', a.table_name)) AS constraint_name
FROM {asked} a LEFT JOIN {keys} f ON lower(f.base_table) = lower(a.table_name) AND lower(f.base_column) = lower(a.column_name) GROUP BY a.table_name, a.column_name, a.ref_table""",
)
CARDINALITY = SqlOp(
    "HIGH, MEDIUM or LOW for columns(table_name, column_name, data_type): the first of: null names MEDIUM; listed as high; listed as low; in a key or unique entry HIGH; boolean or enum type LOW; without a type, a name like a flag's LOW; else MEDIUM.",
    """SELECT c.table_name, c.column_name, CASE
  WHEN c.table_name IS NULL OR c.column_name IS NULL THEN 'MEDIUM'
  WHEN EXISTS (SELECT 1 FROM {high} h WHERE h.name = lower(c.column_name)) THEN 'HIGH'
  WHEN EXISTS (SELECT 1 FROM {low} l WHERE l.name = lower(c.column_name)) THEN 'LOW'
  WHEN EXISTS (SELECT 1 FROM (SELECT table_name, column_name FROM {members} GROUP BY table_name, column_name HAVING bool_or(index_type <> 'INDEX')) m WHERE m.table_name = lower(c.table_name) AND m.column_name = lower(c.column_name)) THEN 'HIGH'
  WHEN upper(c.data_type) IN ('BOOLEAN', 'ENUM') THEN 'LOW'
  WHEN c.data_type IS NULL AND (left(lower(c.column_name), 3) = 'is_' OR left(lower(c.column_name), 4) IN ('has_', 'can_') OR left(lower(c.column_name), 7) = 'should_'
    OR right(lower(c.column_name), 5) = '_flag' OR right(lower(c.column_name), 8) = '_enabled' OR right(lower(c.column_name), 7) = '_active' OR lower(c.column_name) IN ('active', 'enabled', 'deleted', 'visible')) THEN 'LOW'
  ELSE 'MEDIUM' END AS cardinality FROM {columns} c""",
)
KEY_COLUMNS = SqlOp("(table_name, column_name) in a primary key, at any place.", "SELECT DISTINCT table_name, column_name FROM {members} WHERE index_type = 'PRIMARY_KEY'")
UNIQUE_COLUMNS = SqlOp("(table_name, column_name) in a unique constraint or index.", "SELECT table_name, column_name FROM {members} GROUP BY table_name, column_name HAVING bool_or(index_type IN ('UNIQUE_CONSTRAINT', 'UNIQUE_INDEX'))")
HAS_LEADING = SqlOp("Asked (table_name, column_name) that lead an index.", "SELECT a.table_name, a.column_name FROM {asked} a WHERE EXISTS (SELECT 1 FROM {members} m WHERE m.table_name = lower(a.table_name) AND m.column_name = lower(a.column_name) AND m.place = 1)")
COVERED = SqlOp(
    "Asked (table_name, column_csv) that an index starts with, in order. Each index gives its starts, so tables with many are no products.",
    f"""
WITH starts AS (SELECT DISTINCT table_name, start FROM {{indexes}} LATERAL VIEW explode({starts("column_csv")}) v AS start)
SELECT a.table_name, a.column_csv FROM {{asked}} a LEFT SEMI JOIN starts s ON s.table_name = lower(a.table_name) AND s.start = lower(a.column_csv)""",
)

_CREATE = r"(?i)^\s*create\s+(unique\s+)?index\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?([^\s(]+)\s+on\s+([^\s(]+)\s*\(([^)]*)\)"
_DROP = r"(?i)^\s*drop\s+index\s+(?:concurrently\s+)?(?:if\s+exists\s+)?([^\s;]+)(?:\s+on\s+([^\s;]+))?"


def members(indexes: DataFrame) -> DataFrame:
    """(table_name, column_name, index_type, place): each column of each entry, places from 1."""
    rows = indexes.select("table_name", "index_type", F.posexplode(F.split("column_csv", ",")).alias("p", "c"))
    return rows.select("table_name", F.lower(F.trim("c")).alias("column_name"), "index_type", (F.col("p") + 1).alias("place"))


def raw_sql_changes(statements: DataFrame) -> DataFrame:
    """changes from (seq, sql): CREATE and DROP INDEX statements, several in one text too; others give none."""
    one = statements.select("seq", F.posexplode(F.split("sql", ";")).alias("p", "s"))
    made = F.regexp_extract("s", _CREATE, 2) != ""
    name = F.when(made, F.regexp_extract("s", _CREATE, 2)).otherwise(F.regexp_extract("s", _DROP, 1))
    table = F.when(made, F.regexp_extract("s", _CREATE, 3)).otherwise(F.regexp_extract("s", _DROP, 2))
    csv = F.array_join(F.filter(F.transform(F.split(F.regexp_extract("s", _CREATE, 4), ","), lambda c: F.trim(c)), lambda c: c != ""), ",")
    rows = one.select("seq", "p", F.when(made, "createIndex").otherwise("dropIndex").alias("kind"), F.nullif(table, F.lit("")).alias("table_name"), name.alias("object_name"), F.when(made, csv).alias("column_csv"), (F.trim(F.regexp_extract("s", _CREATE, 1)) != "").alias("is_unique"))
    return rows.filter("object_name <> ''").drop("p")


def replay(changes: DataFrame) -> DataFrame:
    """The catalog after all of ``changes``."""
    return REPLAYED(changes=changes, added=ADDED(changes=changes))
