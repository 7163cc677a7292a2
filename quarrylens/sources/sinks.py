"""Writers: edges by type, CSV exports, checkpoints, changesets, mapping and validation documents."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file with that text, in any file system that Spark reaches; replaces what is there. For single documents."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_edges(edges: DataFrame, path: str, mode: str = "append") -> None:
    """Edges as Parquet by type, so a type's queries read its files alone; mode overwrite clears the graph first."""
    edges.repartition("type").write.mode(mode).partitionBy("type").parquet(path)


def write_queries_csv(queries: DataFrame, path: str) -> None:
    """Repository queries as CSV, appended: line ends become tabs, carriage returns go, quotes only where needed."""
    clean = [F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "\r", ""), "\n", "\t").alias(c) for c in queries.columns]
    queries.select(*clean).write.mode("append").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("append").csv(path, header=True)


def write_checkpoint(state: DataFrame, path: str) -> None:
    """A run's state as JSON, replacing the last."""
    state.coalesce(1).write.mode("overwrite").json(path)


def changeset_xml(changes: list[tuple[str, str, str]], author: str = "quarrylens") -> str:
    """A changelog of (id, SQL, rollback SQL)."""
    body = "\n".join(f"  <changeSet id={quoteattr(i)} author={quoteattr(author)}>\n    <sql>{escape(sql)}</sql>\n    <rollback>{escape(back)}</rollback>\n  </changeSet>" for i, sql, back in changes)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<databaseChangeLog xmlns="http://www.liquibase.org/xml/ns/dbchangelog">\n{body}\n</databaseChangeLog>\n'


def with_include(master: str, file: str) -> str:
    """A master changelog that includes ``file`` under the directory most of its includes have; once."""
    import re
    from collections import Counter

    found = re.findall(r'<include[^>]*\bfile="([^"]*)"', master)
    prefix = Counter(f.rpartition("/")[0] for f in found).most_common(1)
    path = "/".join(x for x in (prefix[0][0] if prefix else "", file) if x)
    return master if path in found else master.replace("</databaseChangeLog>", f'  <include file="{path}"/>\n</databaseChangeLog>')


def mapping_documents(mappings: DataFrame) -> DataFrame:
    """(source_table, document): each plan's column mappings as JSON, in order. mappings(source_table, view_column, target_table, target_column, seq)."""
    rows = mappings.groupBy("source_table").agg(F.array_sort(F.collect_list(F.struct("seq", "view_column", "target_table", "target_column"))).alias("m"))
    return rows.select("source_table", F.to_json(F.struct("source_table", F.transform("m", lambda x: x.dropFields("seq")).alias("mappings"))).alias("document"))


def validation_json(errors: list[str], warnings: list[str]) -> str:
    return json.dumps({"valid": not errors, "errors": errors, "warnings": warnings})


def validated_changelog(xml: str | None) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a changelog: missing, not readable, raw SQL that can't be read (CONCURRENTLY and ONLINE may), and its size."""
    import xml.etree.ElementTree as ET

    from quarrylens.operators.sqlscan import tokens
    from quarrylens.sources.files import changes_of

    if xml is None:
        return ["file not found"], []
    try:
        changes = changes_of(xml)
    except ET.ParseError as e:
        return [f"not readable: {e}"], []
    errors = []
    for kind, _, sql, _, _ in changes:
        if kind == "sql" and not {"CONCURRENTLY", "ONLINE"} & {t.upper() for t in tokens(sql)}:
            first = next(iter(tokens(sql)), "").upper()
            if sql.count("(") != sql.count(")") or first not in {"CREATE", "DROP", "ALTER", "INSERT", "UPDATE", "DELETE", "SELECT", "WITH", "COMMENT", "GRANT"}:
                errors.append(f"raw SQL not readable: {sql.strip()[:80]}")
    return errors, [f"{len(changes)} changes"]


def changeset(kind: str, dialects: tuple[str, ...] = (), **given: str) -> tuple[str, str]:
    """(SQL, rollback) of the other changes: rename_table, drop_foreign_key, create_view, sql; with dialects, a comment names them."""
    if kind == "rename_table":
        out = f"ALTER TABLE {given['old']} RENAME TO {given['new']};", f"ALTER TABLE {given['new']} RENAME TO {given['old']};"
    elif kind == "drop_foreign_key":
        back = f"ALTER TABLE {given['table']} ADD CONSTRAINT {given['name']} FOREIGN KEY ({given['column']}) REFERENCES {given['ref_table']} ({given['ref_column']});"
        out = f"ALTER TABLE {given['table']} DROP CONSTRAINT {given['name']};", back
    elif kind == "create_view":
        out = f"CREATE VIEW {given['name']} AS {given['query']};", f"DROP VIEW {given['name']};"
    elif kind == "sql":
        out = given["sql"], given.get("rollback", "")
    else:
        raise ValueError(f"no such change: {kind}")
    return (f"-- dialects: {', '.join(dialects)}\n{out[0]}" if dialects else out[0]), out[1]


def composite(changes: list[tuple[str, str]]) -> tuple[str, str]:
    """Several changes as one: rollbacks run in reverse."""
    return "\n".join(sql for sql, _ in changes), "\n".join(back for _, back in reversed(changes) if back)
