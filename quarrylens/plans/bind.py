"""SQL with tables as {names}: bound to DataFrames for Spark, to plain names for the other engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"\{(\w+)\}")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of ``sql``, whose {table} names are read from ``sf_dir``."""
    names = sorted(set(_NAME.findall(sql)))
    return spark.sql(sql, **dict(zip(names, tables(spark, sf_dir, *names), strict=True)))


def duck(sql: str) -> str:
    return _NAME.sub(r"\1", sql)


def bound(op, against: str, **projections: str):
    """(query, SQL for the other engine) of an SqlOp whose inputs are projections: SQL over the fixed tables, or over earlier inputs.

    A projection may be an SqlOp itself, whose inputs come before it. ``against`` states the operator again, in another way and for the
    other engine alone: it sees the projections that are SQL, and none of an operator's own SQL.
    """
    sqls = {k: getattr(p, "sql", p) for k, p in projections.items()}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        held: dict[str, DataFrame] = {}
        for name, sql in [*sqls.items(), ("", op.sql)]:
            names = sorted(set(_NAME.findall(sql)))
            held[name] = spark.sql(sql, **{n: held[n] if n in held else tables(spark, sf_dir, n)[0] for n in names})
        return held[""]

    return query, stated(against, **{k: p for k, p in projections.items() if isinstance(p, str)})


def stated(sql: str, **projections: str) -> str:
    """``sql`` for the other engine, with the projections as its first named tables; it may go on with its own."""
    steps = ", ".join(f"{k} AS ({duck(p)})" for k, p in projections.items())
    return f"WITH {steps}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {steps} {sql}"
