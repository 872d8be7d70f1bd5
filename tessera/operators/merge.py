"""Small combiners over estimates: inverse-variance weighting, and deduplication by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.partition import by_cuts


def inverse_variance(df: DataFrame, group: str, value: str, variance: str) -> DataFrame:
    """Mean of independent estimates by group, each weighted by 1 / variance (0 where it isn't positive)."""
    w = F.when(F.col(variance) > 0, 1 / F.col(variance)).otherwise(0.0)
    return df.groupBy(group).agg((F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias(value), (1 / F.nullif(F.sum(w), F.lit(0.0))).alias(variance))


def keep_last(df: DataFrame, by: str, order: list[str | Column]) -> DataFrame:
    """One row of each value of ``by``: the last in the order."""
    columns = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__r")).select(by, *[F.col(f"__r.{c}").alias(c) for c in columns])


def layer_estimate(df: DataFrame, box: Column, group: str, layers: str, key: str, target: str, rate: float) -> DataFrame:
    """An estimate of SUM per tree layer's own random part, merged by inverse variance.

    ``df`` has the layer of each row's random chunk and its stratum in that layer; every layer gives
    scaled totals and their variance, so that layers of finer strata weigh more.
    """
    t = F.when(box, F.col(target)).otherwise(0).cast("double")
    strata = df.groupBy(layers, group).agg(F.count("*").alias("n"), F.sum(t).alias("s"), F.sum(t * t).alias("ss"))
    n, s = F.col("n"), F.col("s")
    by_layer = strata.groupBy(layers).agg(F.sum(s / rate).alias("value"), F.sum((F.col("ss") / n - (s / n) * (s / n)) * n / (rate * rate)).alias("variance"))
    return inverse_variance(by_layer.withColumn("__one", F.lit(1)), "__one", "value", "variance").drop("__one")


def zero_padded_variance(df: DataFrame, box: Column, target: str) -> DataFrame:
    """Population variance of a target that counts 0 outside of the box, in one pass."""
    t = F.when(box, F.col(target)).otherwise(0).cast("double")
    n = F.count(F.lit(1))
    return df.agg((F.sum(t * t) / n - (F.sum(t) / n) * (F.sum(t) / n)).alias("variance"))


def prefix_sums(df: DataFrame, order: list[str], target: str, groups: str | None = None, ranges: int = 64) -> DataFrame:
    """Position, running sum and running sum of squares in sorted order.

    With ``groups`` in each group apart. Else over the whole table, in ranges of the order: windows
    inside ranges, to which the totals of the ranges before are added, so that no task has all rows.
    The order should be total.
    """
    t, by = F.col(target), groups
    if not groups:
        df, by = df.withColumn("__range", by_cuts(F.struct(*order), _range_starts(df, order, ranges))), "__range"
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns({"pos": F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long") - 1, "s": F.sum(t).over(w), "ss": F.sum(t * t).over(w)})
    if groups:
        return out
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = df.groupBy("__range").agg(F.count("*").alias("n"), F.sum(t).alias("a"), F.sum(t * t).alias("b"))
    offsets = totals.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"), F.sum("a").over(before).alias("__s"), F.sum("b").over(before).alias("__ss"))
    added = lambda c: F.coalesce(F.col(c) + F.col(f"__{c}"), c, f"__{c}")
    return out.join(F.broadcast(offsets), "__range").withColumns({"pos": F.col("pos") + F.col("__n"), "s": added("s"), "ss": added("ss")}).drop("__range", "__n", "__s", "__ss")


def _range_starts(df: DataFrame, order: list[str], ranges: int) -> list[Column]:
    """First order values of about equal ranges, from a bounded sample; where they lie changes no result."""
    n = df.count()
    rows = df.select(*order).sample(min(1.0, 100 * ranges / max(n, 1)), seed=1).orderBy(*order).collect()
    picked = list(dict.fromkeys(tuple(rows[i * len(rows) // ranges]) for i in range(ranges))) if rows else [(None,) * len(order)]
    return [F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, x, strict=True)]) for x in picked]
