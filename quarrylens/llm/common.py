"""What the operators of this subpackage share: reading, checkpoints, and mapping whole texts."""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.lineage import shared_folder

#: Arrow batches that go to Python: long texts make records alone a poor bound.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000

#: The words of a text, as all contracts of this subpackage count them.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Seconds between two collections of the driver's garbage, at least, and how often as long as the last took they are apart.
COLLECT_S, COLLECT_APART = 4.0, 30
_due = 0.0


def collected(spark: SparkSession) -> None:
    """Has the driver collect its garbage, if that is due: shuffle files, broadcasts and checkpoints stay until it does.

    By itself it collects the old ones seldom, and its heap grows to its limit first. Many small stages leave much of both.
    """
    global _due
    began = time.monotonic()
    if began >= _due:
        spark.sparkContext._jvm.System.gc()
        ended = time.monotonic()
        _due = ended + max(COLLECT_S, COLLECT_APART * (ended - began))


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, which lost executors don't take along."""
    shared_folder(df.sparkSession)
    collected(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again; for rows that hold text."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    collected(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Narrow rows, of a few numbers, that are sent whole to every task: some 40 MB at most.
NEARBY_ROWS = 1_000_000


def nearby(df: DataFrame) -> DataFrame:
    """``df``, narrow rows, cut and counted: marked for a broadcast if they are few, else to be joined by a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= NEARBY_ROWS else df


#: Keys whose prints are sent whole to every task, at 2 bytes and their share of a row: some 50 MB at most; and how many share a row.
PRINTED_KEYS, KEYS_A_ROW = 16_000_000, 64


def parted(rows: DataFrame, on: Sequence[str], keys: DataFrame, keys_on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have a key of ``keys``, and those that have none, by 16 bits of each key's hash: a few rows in a thousand are
    among the first without need. So a join has no need to shuffle the second. ``keys`` come from a checkpoint and are counted; beyond
    ``PRINTED_KEYS`` all rows may have one. ``rows`` are read for each part, and must be the same each time."""
    n = keys.count()
    if n > PRINTED_KEYS:
        return rows, rows.filter(F.lit(False))
    shelf, prints = fresh(rows, "shelf", "prints")
    shelves = F.lit(n // KEYS_A_ROW + 1)
    place = lambda cols: (F.pmod(F.xxhash64(*cols), shelves), F.shiftright(F.xxhash64(*cols), 48).cast("smallint"))
    at, own = place(keys_on)
    held = F.broadcast(keys.groupBy(at.alias(shelf)).agg(F.collect_set(own).alias(prints)))
    at, own = place(on)
    match = (at == F.col(shelf)) & F.array_contains(F.col(prints), own)
    return rows.join(held, match, "left_semi"), rows.join(held, match, "left_anti")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` doesn't have, however its own are spelled."""
    have = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = next(n for n in itertools.chain([f"_{base}"], (f"_{base}{i}" for i in itertools.count())) if n.lower() not in have)
        have.add(name.lower())
        out.append(name)
    return out


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Batches to Python get a bound in bytes, and a lower one in rows, for this session; workers find this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """A row of ``schema`` for each row of ``df``: ``make()`` once a task gives ``f(*columns) -> tuple``.

    Rows go through one batch at a time, in bounded memory; no shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            rows = [f(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)] if rows else [pa.array([], t.type) for t in out], schema=out)

    return df.mapInArrow(run, schema)
