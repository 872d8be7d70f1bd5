"""Reproducible samples: the n rows of least md5 priority, overall or by stratum.

No global or whole-stratum sort. Where the sizes of the strata are known, a priority is drawn so low that
all but the first ranks are left out in the one pass that hashes the rows: the limit has room for twelve
standard deviations and fifty rows more than wanted, so that a rank is missed with a probability below
1e-20. Else, and where a stratum's sample is too large for one task, priorities are counted by their first
hex digits, which gives every bucket's first rank; only the rows of buckets that can hold wanted ranks are
kept, and ranked within their bucket. The number of digits follows from the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.moments import priority

TASK_ROWS = 1_000_000  # that one window task ranks


def priority_limit(wanted: int, size: int) -> str | None:
    """Hex digits that the ``wanted`` least priorities of ``size`` rows are below; None: there's no limit."""
    share = (wanted + 12 * math.sqrt(wanted) + 50) / max(size, 1)
    return f"{int(share * 16**12):012x}" if share < 1 else None


def ranked(df: DataFrame, key: str, seed: str, most: Column | DataFrame, group: str | None = None, total: int | None = None, wanted: int | None = None) -> DataFrame:
    """The rows of rank 1..most in the seed's order, with ``rnk``.

    ``most`` is a Column (one number for all), or a small table (group, most) by stratum; with a third
    column ``size``, the strata's rows are known. Without strata, ``total`` and ``wanted`` tell the same:
    rows of the table, and ranks that are asked for.
    """
    g = group or "__all"
    rows = (df if group else df.withColumn(g, F.lit(0))).withColumn("__u", priority(seed, F.col(key)))
    if total is not None and wanted is not None and wanted <= TASK_ROWS:
        limit = priority_limit(wanted, total)
        few = rows.where(F.col("__u") < limit) if limit else rows
        if limit or total <= TASK_ROWS:
            out = few.withColumn("rnk", F.row_number().over(Window.partitionBy(g).orderBy("__u", key)).cast("long"))
            return out.where(F.col("rnk") <= most).drop("__u", *([] if group else [g]))
    if isinstance(most, DataFrame) and "size" in most.columns:
        known = {r[g]: (r["most"], r["size"]) for r in most.collect()}  # a row a stratum
        most = most.drop("size")
        limits = {k: priority_limit(n, size) for k, (n, size) in known.items()}
        if all(n <= TASK_ROWS and (limits[k] or size <= TASK_ROWS) for k, (n, size) in known.items()):
            kind = df.schema[g].dataType.simpleString()
            wanted_rows = F.broadcast(df.sparkSession.createDataFrame([(k, n, limits[k]) for k, (n, _) in known.items()], f"{g} {kind}, __most long, __limit string"))
            few = rows.join(wanted_rows, g).where(F.col("__limit").isNull() | (F.col("__u") < F.col("__limit")))
            out = few.withColumn("rnk", F.row_number().over(Window.partitionBy(g).orderBy("__u", key)).cast("long"))
            return out.where(F.col("rnk") <= F.col("__most")).drop("__u", "__limit", "__most")
    n = df.count() if total is None else total
    digits = max(3, math.ceil(math.log(max(n, 1) / TASK_ROWS, 16)) if n > TASK_ROWS else 3)
    rows = rows.withColumn("__b", F.substring("__u", 1, digits))
    counts = rows.groupBy(g, "__b").agg(F.count("*").alias("__n"))
    running = Window.partitionBy(g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(g, "__b", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__before"))
    starts = starts.join(most, g).withColumnRenamed("most", "__most") if isinstance(most, DataFrame) else starts.withColumn("__most", most)
    kept = rows.join(starts.where(F.col("__before") < F.col("__most")), [g, "__b"])
    within = Window.partitionBy(g, "__b").orderBy("__u", key)
    out = kept.withColumn("rnk", (F.col("__before") + F.row_number().over(within)).cast("long")).where(F.col("rnk") <= F.col("__most"))
    return out.drop("__u", "__b", "__before", "__most", *([] if group else [g]))


def uniform_sample(df: DataFrame, key: str, rate: float, seed: str, total: int) -> DataFrame:
    """round(rate * total) rows without replacement."""
    n = int(total * rate + 0.5)
    return ranked(df, key, seed, F.lit(n), total=total, wanted=n).drop("rnk")


def fraction_by_group(df: DataFrame, key: str, group: str, rate: float, seed: str) -> DataFrame:
    """The same fraction of each partition's rows, rounded."""
    most = df.groupBy(group).agg(F.floor(F.count("*") * rate + 0.5).cast("long").alias("most"))
    return ranked(df, key, seed, most, group).drop("rnk")


def layer_samples(chunks: DataFrame, layers: int, stratum: dict[int, Column]) -> DataFrame:
    """``layer`` and ``stratum`` of each row of ``equal_chunks``: each layer of a tree has a random part of the
    rows, cut by that layer's own boxes (a Column per layer)."""
    out = F.lit(None)
    for layer in range(layers):
        out = F.when(F.col("chunk") == layer, stratum[layer]).otherwise(out)
    return chunks.withColumn("layer", F.col("chunk")).withColumn("stratum", out.cast("long"))


def equal_chunks(df: DataFrame, key: str, chunks: int, seed: str, total: int) -> DataFrame:
    """``chunk`` 0.. of each row: a random split into parts of ceil(total / chunks) rows."""
    size = -(-total // chunks)
    return ranked(df, key, seed, F.lit(total)).withColumn("chunk", F.floor((F.col("rnk") - 1) / size).cast("int")).drop("rnk")


def scramble(df: DataFrame, key: str, rate: float, seed: str, total: int, path: str) -> DataFrame:
    """A sample table that outlives the session, until ``drop_scramble``."""
    uniform_sample(df, key, rate, seed, total).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_scramble(spark: SparkSession, path: str) -> bool:
    """Remove a scramble; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scramble_sum(sample: DataFrame, where: Column, target: str, rate: float) -> DataFrame:
    """SUM over the table, from a scramble of it; null if no row matches."""
    return sample.where(where).agg((F.sum(target) / F.lit(rate)).alias("sum"))


def proportional(strata: list[tuple[int, int]], n: int) -> dict[int, int]:
    """Rows to take of each (stratum, size): floor of its share."""
    total = sum(s for _, s in strata)
    return {i: n * s // total if total else 0 for i, s in strata}


def by_variance(strata: list[tuple[int, int, float]], n: int) -> dict[int, int]:
    """Floor of the share by size times variance of each (stratum, size, variance)."""
    total = sum(s * (v or 0.0) for _, s, v in strata)
    return {i: int(n * s * (v or 0.0) / total) if total else 0 for i, s, v in strata}


def allocation(df: DataFrame, group: str, target: str, n: int) -> DataFrame:
    """group, size, variance, n_proportional, n_variance of each stratum."""
    t = F.col(target)
    sizes = df.groupBy(group).agg(F.count("*").alias("size"), F.coalesce(F.var_samp(t), F.lit(0.0)).alias("variance"))
    all_ = Window.partitionBy()
    return sizes.select(  # a row per stratum: the window over all of them is small
        group,
        "size",
        F.round("variance", 4).alias("variance"),
        F.floor(F.lit(n) * F.col("size") / F.sum("size").over(all_)).cast("long").alias("n_proportional"),
        F.floor(F.lit(n) * F.col("size") * F.col("variance") / F.sum(F.col("size") * F.col("variance")).over(all_)).cast("long").alias("n_variance"),
    )
