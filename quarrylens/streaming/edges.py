"""Edges from files as they come, kept in a graph table of one row a (source, type, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens.operators.graph import upsert_edges

EDGE = "source_id string, target_id string, type string, attributes map<string,string>, seq long"


def edge_stream(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EDGE).option("maxFilesPerTrigger", files_a_trigger).json(path)


def append_batches(stream: DataFrame, table: str, checkpoint: str):
    """Each batch is upserted on its own and appended, by type and batch; a batch that comes again replaces itself, so a restart repeats nothing."""

    def write(batch: DataFrame, number: int) -> None:
        upsert_edges(batch).write.mode("overwrite").partitionBy("type").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graph_table(spark: SparkSession, table: str) -> DataFrame:
    """The graph after all batches: attributes of later batches win."""
    return upsert_edges(spark.read.parquet(table).withColumnRenamed("batch", "seq"))
