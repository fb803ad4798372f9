"""Reading tables and picking the row that holds for a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder; with ``columns``, only those are scanned."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order``.

    Rows tied on ``order`` are taken to be identical, any of them is kept.
    Rows with a null key are kept as a key of their own group; a null order
    value is older than any other. An empty frame gives an empty frame.
    """
    rank = "__latest_rank"
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)
