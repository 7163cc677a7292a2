"""Checked table decomposition: order by foreign keys, split, rebuild by a view, propagate changes, parse plans.

plans(source_table, base_table); mappings(source_table, view_column, target_table, target_column, seq);
keys(source_table, from_table, from_column, to_table, to_column).
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators.sqlop import SqlOp

# Java types and their SQL and changelog types; anything else is a text of 255.
SQL_TYPES = {
    "Long": "BIGINT", "long": "BIGINT", "Integer": "INTEGER", "int": "INTEGER", "String": "VARCHAR(255)", "BigDecimal": "NUMERIC(19,2)", "Boolean": "BOOLEAN", "boolean": "BOOLEAN",
    "Double": "DOUBLE PRECISION", "double": "DOUBLE PRECISION", "Float": "REAL", "float": "REAL", "Short": "SMALLINT", "short": "SMALLINT", "Date": "DATE", "LocalDate": "DATE", "LocalDateTime": "TIMESTAMP", "Timestamp": "TIMESTAMP",
}
LIQUIBASE_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR(255)": "varchar(255)", "NUMERIC(19,2)": "decimal(19,2)", "BOOLEAN": "boolean", "DOUBLE PRECISION": "double", "REAL": "float", "SMALLINT": "smallint", "DATE": "date", "TIMESTAMP": "timestamp"}
SPARK_TYPES = {"BIGINT": T.LongType(), "INTEGER": T.IntegerType(), "VARCHAR(255)": T.StringType(), "NUMERIC(19,2)": T.DecimalType(19, 2), "BOOLEAN": T.BooleanType(), "DOUBLE PRECISION": T.DoubleType(), "REAL": T.FloatType(), "SMALLINT": T.ShortType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType()}


def sql_type(java: str | None) -> str:
    return SQL_TYPES.get(java or "", "VARCHAR(255)")


def liquibase_type(java: str | None) -> str:
    return LIQUIBASE_TYPES[sql_type(java)]


def spark_type(java: str | None) -> T.DataType:
    return T.TimestampNTZType() if java == "LocalDateTime" else SPARK_TYPES[sql_type(java)]


def is_numeric(java: str | None) -> bool:
    return sql_type(java) in {"BIGINT", "INTEGER", "NUMERIC(19,2)", "DOUBLE PRECISION", "REAL", "SMALLINT"}


def ordered(tables: list[str], keys: list[tuple[str, str]]) -> list[str]:
    """Tables with parents first, by (child, parent) keys; ties in input order, unknown tables and self keys ignored. A plan's tables are few."""
    known = set(tables)
    parents = {t: {p for c, p in keys if c == t and p in known and p != t} for t in tables}
    queue, out = deque(t for t in tables if not parents[t]), []
    while queue:
        done = queue.popleft()
        out.append(done)
        for t in tables:
            if done in parents[t]:
                parents[t].discard(done)
                if not parents[t]:
                    queue.append(t)
    if len(out) < len(tables):
        raise ValueError(f"foreign keys form a cycle among {[t for t in tables if t not in out]}")
    return out


def split(view: DataFrame, mappings: list[tuple[str, str, str]], order: list[str]) -> dict[str, DataFrame]:
    """Table to its rows, by (view column, table, column); in order, duplicates kept, tables without columns left out."""
    out = {}
    for t in order:
        columns = [F.col(v).alias(c) for v, table, c in mappings if table == t]
        if columns:
            out[t] = view.select(*columns)
    return out


def rebuilt(parts: dict[str, DataFrame], base: str, mappings: list[tuple[str, str, str]], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """The view over the parts: inner joins from the base on, each key joining the table not joined yet, whichever end it is."""
    side = {t: df.select(*[F.col(c).alias(f"{t}.{c}".replace(".", "__")) for c in df.columns]) for t, df in parts.items()}
    out, joined, left = side[base], {base}, list(keys)
    while left:
        k = next((k for k in left if (k[0] in joined) != (k[2] in joined)), None)
        if k is None:
            break
        left.remove(k)
        new = k[2] if k[0] in joined else k[0]
        out = out.join(side[new], F.col(f"{k[0]}__{k[1]}") == F.col(f"{k[2]}__{k[3]}"))
        joined.add(new)
    if lost := sorted({t for _, t, _ in mappings} - joined):
        raise ValueError(f"no key joins {', '.join(lost)} to {base}")
    return out.select(*[F.col(f"{t}__{c}").alias(v) for v, t, c in mappings])


def inserted(parts: dict[str, DataFrame], change: DataFrame, mappings, order: list[str]) -> dict[str, DataFrame]:
    """The parts with the rows of ``change`` (view rows) added, parents first."""
    more = split(change, mappings, order)
    return {t: parts[t].unionByName(more[t]) if t in more else parts[t] for t in parts}


def deleted(parts: dict[str, DataFrame], change: DataFrame, mappings, order: list[str]) -> dict[str, DataFrame]:
    """The parts without the rows whose first mapped column is in ``change``, children first."""
    out = dict(parts)
    for t in reversed(order):
        v, c = next(((v, c) for v, table, c in mappings if table == t), (None, None))
        if v is not None:
            out[t] = parts[t].join(change.select(F.col(v).alias(c)).distinct(), c, "left_anti")
    return out


def updated(part: DataFrame, change: DataFrame, mapping: list[tuple[str, str]]) -> DataFrame:
    """A part with all but its first mapped column set from ``change`` where the first (its key) matches."""
    (v0, key), rest = mapping[0], mapping[1:]
    new = change.select(F.col(v0).alias("_k"), *[F.col(v).alias(f"_n_{c}") for v, c in rest], F.lit(True).alias("_hit"))
    out = part.join(new, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in {x for _, x in rest} else F.col(c) for c in part.columns])


def create_table(table: str, columns: list[tuple[str, str, bool, bool]]) -> str:
    """DDL from (name, Java type, key, nullable)."""
    lines = [f"    {n} {sql_type(j)}" + (" NOT NULL" if k or not null else "") for n, j, k, null in columns]
    keys = [n for n, _, k, _ in columns if k]
    return f"CREATE TABLE {table} (\n" + ",\n".join(lines + ([f"    PRIMARY KEY ({', '.join(keys)})"] if keys else [])) + "\n);"


def create_table_changeset(table: str, columns: list[tuple[str, str, bool, bool]], generated: frozenset = frozenset()) -> str:
    """A changelog's createTable from the same; numeric keys in ``generated`` count up."""
    rows = []
    for n, j, k, null in columns:
        auto = ' autoIncrement="true"' if n in generated and is_numeric(j) else ""
        limits = ' primaryKey="true"' * k + ' nullable="false"' * (k or not null)
        rows.append(f'    <column name="{n}" type="{liquibase_type(j)}"{auto}' + (f"><constraints{limits}/></column>" if limits else "/>"))
    return f'<createTable tableName="{table}">\n' + "\n".join(rows) + "\n</createTable>"


def insert_select(view: str, mappings, order: list[str]) -> list[str]:
    """INSERT ... SELECT statements of a split, in order."""
    out = []
    for t in order:
        pairs = [(v, c) for v, table, c in mappings if table == t]
        if pairs:
            out.append(f"INSERT INTO {t} ({', '.join(c for _, c in pairs)}) SELECT {', '.join(v for v, _ in pairs)} FROM {view};")
    return out


def triggers(view: str, dialect: str) -> list[tuple[str, str]]:
    """(create head, rollback) of the three INSTEAD OF triggers of a view."""
    out = []
    for event in ("INSERT", "UPDATE", "DELETE"):
        name = f"trg_{view}_{event.lower()}"
        if dialect == "POSTGRESQL":
            out.append((f"CREATE TRIGGER {name} INSTEAD OF {event} ON {view} FOR EACH ROW EXECUTE FUNCTION {name}_fn();", f"DROP TRIGGER IF EXISTS {name} ON {view}; DROP FUNCTION IF EXISTS {name}_fn();"))
        else:
            out.append((f"CREATE OR REPLACE TRIGGER {name} INSTEAD OF {event} ON {view} FOR EACH ROW", f"DROP TRIGGER {name};"))
    return out


def _key_of(table: str, base: str, mappings, keys) -> tuple[str, str]:
    """(column, view column) that find a view row's rows in a table: the base's first mapped column, else the key to its parent."""
    if table == base:
        return next((c, v) for v, t, c in mappings if t == base)
    key = next((k for k in keys if k[0] == table), None)
    if key is None:
        raise ValueError(f"no key leads from {table} to a parent")
    view = next((v for v, t, c in mappings if (t, c) == (key[2], key[3])), None)
    if view is None:
        raise ValueError(f"the view has no column for {key[2]}.{key[3]}")
    return key[1], view


def trigger_statements(base: str, mappings: list[tuple[str, str, str]], keys: list[tuple[str, str, str, str]], event: str, prefix: str = "") -> list[str]:
    """The statements by which a change of the view reaches its tables: inserts and updates parents first, deletes children first.

    ``prefix`` stands before NEW and OLD. An update sets all but a table's first mapped column; tables with no other have none.
    """
    tables = list(dict.fromkeys(t for _, t, _ in mappings))
    order = ordered(tables, [(k[0], k[2]) for k in keys])
    out = []
    for table in reversed(order) if event == "DELETE" else order:
        pairs = [(v, c) for v, t, c in mappings if t == table]
        if event == "INSERT":
            out.append(f"INSERT INTO {table} ({', '.join(c for _, c in pairs)}) VALUES ({', '.join(f'{prefix}NEW.{v}' for v, _ in pairs)});")
            continue
        column, view = _key_of(table, base, mappings, keys)
        if event == "DELETE":
            out.append(f"DELETE FROM {table} WHERE {column} = {prefix}OLD.{view};")
        elif pairs[1:]:
            out.append(f"UPDATE {table} SET {', '.join(f'{c} = {prefix}NEW.{v}' for v, c in pairs[1:])} WHERE {column} = {prefix}NEW.{view};")
    return out


def trigger_bodies(view: str, base: str, mappings, keys, dialect: str) -> list[tuple[str, str, str]]:
    """(event, DDL, rollback) of a view's three INSTEAD OF triggers: in PostgreSQL a function each, in Oracle a block."""
    out = []
    for (head, back), event in zip(triggers(view, dialect), ("INSERT", "UPDATE", "DELETE"), strict=True):
        body = "".join(f"    {x}\n" for x in trigger_statements(base, mappings, keys, event, "" if dialect == "POSTGRESQL" else ":"))
        if dialect == "POSTGRESQL":
            row = "OLD" if event == "DELETE" else "NEW"
            name = f"trg_{view}_{event.lower()}_fn"
            ddl = f"CREATE OR REPLACE FUNCTION {name}() RETURNS TRIGGER AS $$\nBEGIN\n{body}    RETURN {row};\nEND;\n$$ LANGUAGE plpgsql;\n{head}"
        else:
            ddl = f"{head}\nBEGIN\n{body}END;\n/"
        out.append((event, ddl, back))
    return out


def view_query(base: str, mappings, keys) -> str:
    """SELECT of the view over its tables: joined from the base on, whichever end of a key is not joined yet."""
    joined, left, text = {base}, list(keys), base
    while k := next((k for k in left if (k[0] in joined) != (k[2] in joined)), None):
        left.remove(k)
        new = k[2] if k[0] in joined else k[0]
        text += f" JOIN {new} ON {k[0]}.{k[1]} = {k[2]}.{k[3]}"
        joined.add(new)
    if lost := sorted({t for _, t, _ in mappings} - joined):
        raise ValueError(f"no key joins {', '.join(lost)} to {base}")
    return f"SELECT {', '.join(f'{t}.{c} AS {v}' for v, t, c in mappings)} FROM {text}"


#: Steps of a plan, in the order they run.
STEPS = ("create tables", "move data", "drop foreign keys", "rename source", "create view", "insert trigger", "update trigger", "delete trigger")


def plan_steps(source: str, base: str, columns: dict[str, list[tuple[str, str, bool, bool]]], mappings, keys, external: list[tuple[str, str]], dialect: str) -> list[tuple[str, str, str]]:
    """(step, SQL, rollback) of a whole plan in ``STEPS``' order; ``external``: (table, constraint) of keys of other tables into the source."""
    order = ordered(list(columns), [(k[0], k[2]) for k in keys])
    old = f"{source}_old"
    out = [("create tables", create_table(t, columns[t]), f"DROP TABLE {t};") for t in order]
    tables = {t: [c for c in order if c == t] for t in order}
    out += [("move data", sql, f"DELETE FROM {t};") for t in order for sql in insert_select(source, mappings, tables[t])]
    out += [("drop foreign keys", f"ALTER TABLE {t} DROP CONSTRAINT {name};", "") for t, name in external]
    out.append(("rename source", f"ALTER TABLE {source} RENAME TO {old};", f"ALTER TABLE {old} RENAME TO {source};"))
    out.append(("create view", f"CREATE VIEW {source} AS {view_query(base, mappings, keys)};", f"DROP VIEW {source};"))
    return out + [(f"{event.lower()} trigger", ddl, back) for event, ddl, back in trigger_bodies(source, base, mappings, keys, dialect)]


VALIDATION = SqlOp("Faults of plans: a mapped table or key end that is not a new table, a base that is none.", """
SELECT source_table, 'mapping' AS fault, target_table AS name FROM {mappings} m WHERE NOT EXISTS (SELECT 1 FROM {new_tables} n WHERE n.source_table = m.source_table AND n.table_name = m.target_table)
UNION SELECT source_table, 'key', from_table FROM {keys} k WHERE NOT EXISTS (SELECT 1 FROM {new_tables} n WHERE n.source_table = k.source_table AND n.table_name = k.from_table)
UNION SELECT source_table, 'key', to_table FROM {keys} k WHERE NOT EXISTS (SELECT 1 FROM {new_tables} n WHERE n.source_table = k.source_table AND n.table_name = k.to_table)
UNION SELECT source_table, 'base', base_table FROM {plans} p WHERE NOT EXISTS (SELECT 1 FROM {new_tables} n WHERE n.source_table = p.source_table AND n.table_name = p.base_table)""")
GROUPED_MAPPINGS = SqlOp("Mapped columns of each table, in order, as column=view column.", "SELECT source_table, target_table, string_agg(concat(target_column, '=', view_column), ',') WITHIN GROUP (ORDER BY seq) AS columns FROM {mappings} GROUP BY source_table, target_table")
EXTERNAL_KEYS = SqlOp(
    "Relationships of other entities that target each table, once for each row of new_tables. The rows of a name are counted into blocks of up to 100,000; a relationship meets blocks, which are dealt over all tasks and only there become rows, so a few names are no few tasks. Whole thousands come from a product with 1,000 rows of no columns, which joins a row's bytes as they stand; exploding would build and copy each row anew.",
    """
WITH counted AS (SELECT table_name, count(*) AS n FROM {new_tables} WHERE table_name IS NOT NULL GROUP BY table_name),
  blocks AS (SELECT table_name, least(100000, n - 100000 * b) AS size FROM counted LATERAL VIEW explode(sequence(0L, (n - 1) div 100000)) v AS b),
  met AS (SELECT /*+ REPARTITION(200) */ t.table_name, r.entity, r.field, t.size FROM blocks t JOIN {relationships} r ON r.target = t.table_name AND r.entity <> t.table_name),
  thousands AS (SELECT table_name, entity, field FROM met LATERAL VIEW explode(sequence(1L, size div 1000)) v AS thousand WHERE size >= 1000),
  rest AS (SELECT table_name, entity, field FROM met LATERAL VIEW explode(sequence(1L, size % 1000)) v AS copy WHERE size % 1000 > 0)
SELECT /*+ SHUFFLE_REPLICATE_NL(copies) */ table_name, entity, field FROM thousands CROSS JOIN range(0, 1000, 1, 1) copies
UNION ALL SELECT table_name, entity, field FROM rest""",
)
FIRST_PLAN = SqlOp("The first usable plan of each source table.", "SELECT source_table, base_table, seq FROM (SELECT *, row_number() OVER (PARTITION BY source_table ORDER BY seq) AS n FROM {plans} WHERE usable) x WHERE n = 1")

PLAN_SCHEMA = "array<struct<sourceTable:string,baseTable:string,newTables:array<string>,columnMappings:array<struct<viewColumn:string,targetTable:string,targetColumn:string>>,foreignKeys:array<struct<fromTable:string,fromColumn:string,toTable:string,toColumn:string>>>>"


def parsed_plans(responses: DataFrame, text_col: str = "text") -> DataFrame:
    """Plans in JSON responses: fences off, a bare array or the first array of an object; broken text gives no plan, missing parts null."""
    body = F.trim(F.regexp_replace(text_col, r"(?s)^\s*```\w*\s*|\s*```\s*$", ""))
    array = F.when(F.substring(body, 1, 1) == "[", body).otherwise(F.regexp_extract(body, r"(?s)^\s*\{[^\[]*?(\[.*\])\s*[^\]]*\}\s*$", 1))
    return responses.withColumn("plan", F.explode_outer(F.from_json(array, PLAN_SCHEMA))).filter("plan IS NOT NULL")


def pascal_case(name):
    """words_joined to WordsJoined."""
    return F.replace(F.initcap(F.regexp_replace(name, "_+", " ")), F.lit(" "), F.lit(""))


def camel_case(name):
    p = pascal_case(name)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))


def entity_profiles(fields: DataFrame) -> DataFrame:
    """(entity, columns, relations) from fields(entity, name, java_type, is_transient, is_static, target, seq)."""
    kept = fields.filter(~F.col("is_transient") & ~F.col("is_static")).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "java_type", "target"))).alias("f"))
    plain = F.transform(F.filter("f", lambda x: x["target"].isNull()), lambda x: F.concat(x["name"], F.lit(":"), x["java_type"]))
    return kept.select("entity", F.array_join(plain, ",").alias("columns"), F.array_join(F.transform(F.filter("f", lambda x: x["target"].isNotNull()), lambda x: F.concat(x["name"], F.lit("->"), x["target"])), ",").alias("relations"))


def empty_table(spark: SparkSession, columns: list[tuple[str, str]]) -> DataFrame:
    """An empty table of (name, Java type) columns."""
    return spark.createDataFrame([], T.StructType([T.StructField(n, spark_type(j)) for n, j in columns]))
