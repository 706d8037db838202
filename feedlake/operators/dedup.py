"""Latest version of each entity, and one row of each version, within a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def latest(rows: DataFrame) -> DataFrame:
    """Highest ``_version`` of each ``_entity``; of equals, the one in the later file, then the later row."""
    return _first(rows, ["_partition_key", "_entity"], [F.col("_version").desc(), F.col("_file").desc(), F.col("_row").desc()])


def history(rows: DataFrame) -> DataFrame:
    """Each version of each ``_entity`` once."""
    return _first(rows, ["_partition_key", "_entity", "_version"], [F.col("_file"), F.col("_row")])
