"""Aggregates over the record of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def calls(raw: DataFrame) -> DataFrame:
    """Every call once: rows that repeat a call_id are the same call."""
    return raw.dropDuplicates(["call_id"])


def totals(c: DataFrame) -> DataFrame:
    return c.agg(F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6).alias("usd"), F.coalesce(F.sum("tokens_in"), F.lit(0)).cast("bigint").alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).cast("bigint").alias("tokens_out"), F.count("*").alias("calls"))


def by(c: DataFrame, *keys: str) -> DataFrame:
    return c.groupBy(*keys).agg(F.round(F.sum("usd"), 6).alias("usd"), F.count("*").alias("calls"))


def rollup(c: DataFrame) -> DataFrame:
    """Cost by stage and role with subtotals; ``level`` is 0 for pairs, 1 for stages, 3 for all."""
    return c.rollup("stage", "model_role").agg(F.round(F.sum("usd"), 6).alias("usd"), F.count("*").alias("calls"), F.grouping_id().cast("bigint").alias("level"))


def running(c: DataFrame) -> DataFrame:
    """(stage, call_id, created_at, usd, spent_before): what its stage had spent before every call."""
    w = Window.partitionBy("stage").orderBy("created_at", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    return c.select("stage", "call_id", "created_at", "usd", F.round(F.coalesce(F.sum("usd").over(w), F.lit(0.0)), 6).alias("spent_before"))


def chunk_links(c: DataFrame) -> DataFrame:
    """(call_id, paragraph_id) for every id of the JSON array of a call."""
    return c.filter("chunk_uuids is not null").select("call_id", F.explode(F.from_json("chunk_uuids", "array<string>")).alias("paragraph_id")).distinct()
