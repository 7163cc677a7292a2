"""Operators stated as one SQL query over named inputs, run lazily on DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class SqlOp:
    """``sql`` names its inputs in braces; calling it binds DataFrames to them. ``about`` says what it computes."""

    about: str
    sql: str

    def __call__(self, **inputs: DataFrame) -> DataFrame:
        spark = next(iter(inputs.values())).sparkSession
        return spark.sql(self.sql, **inputs)


def starts(csv: str) -> str:
    """SQL for the array of all column lists that the list ``csv`` starts with, itself last."""
    return f"transform(sequence(1, size(split({csv}, ','))), k -> array_join(slice(split({csv}, ','), 1, k), ','))"
