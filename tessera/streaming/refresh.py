"""Keeping leaf aggregates fresh from a stream: all of them merge, so a micro-batch adds its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tree import leaf_aggregates


def streaming_leaves(stream: DataFrame, leaf: Column, dims: list[str], targets: list[str]) -> DataFrame:
    """Running aggregates by leaf of a streaming table (for update or complete output)."""
    return leaf_aggregates(stream.withColumn("__leaf", leaf), "__leaf", dims, targets)


def windowed_leaves(stream: DataFrame, leaf: Column, event_time: str, target: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Aggregates by leaf and tumbling window; rows later than the watermark are left out."""
    return (
        stream.withColumn("__leaf", leaf)
        .withWatermark(event_time, late)
        .groupBy(F.window(event_time, every), "__leaf")
        .agg(F.count("*").alias("cnt"), F.sum(target).alias("sum"), F.min(target).alias("min"), F.max(target).alias("max"))
    )
