"""Error metrics of results (query_id, cnt, sum, ...) against exact answers, joined by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("cnt", "sum", "avg", "min", "max")


def paired(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Each result beside its exact answer (``gt_`` columns)."""
    return results.join(truth.select("query_id", *[F.col(c).cast("double").alias(f"gt_{c}") for c in MEASURES if c in truth.columns]), "query_id")


def relative_error(measure: str) -> Column:
    gt, est = F.col(f"gt_{measure}"), F.coalesce(measure, F.lit(0.0))
    return F.when(gt == 0, F.abs(est)).otherwise(F.abs(gt - est) / F.abs(gt))


def external_error(gt: str, est: str) -> Column:
    """Of an outside engine's answer, which may be null: 1."""
    return F.coalesce(F.abs(F.col(gt) - F.col(est)) / F.abs(F.col(gt)), F.lit(1.0))


def ci_ratio(measure: str) -> Column:
    gt = F.col(f"gt_{measure}")
    return F.col(f"ci_{measure}") / F.when(gt == 0, 1.0).otherwise(F.abs(gt))


def ci_error_ratio(measure: str) -> Column:
    off, ci = F.abs(F.col(f"gt_{measure}") - F.col(measure)), F.col(f"ci_{measure}")
    return F.when(off == 0, ci).otherwise(ci / off)


def failed(measure: str) -> Column:
    """1 where the truth is outside of the interval."""
    return (F.abs(F.col(f"gt_{measure}") - F.col(measure)) > F.col(f"ci_{measure}")).cast("int")


def estimate_ratio(results: DataFrame, truth: DataFrame, measure: str) -> DataFrame:
    """One row: mean and median of estimate / exact answer."""
    ratio = F.col(measure) / F.nullif(F.col(f"gt_{measure}"), F.lit(0.0))
    return paired(results, truth).agg(F.avg(ratio).alias("mean"), F.percentile(ratio, F.lit(0.5)).alias("median"))


def skip_rate() -> Column:
    return 1 - F.col("delta_leaf_frac")


def against_baseline(results: DataFrame, baseline: DataFrame, measure: str) -> DataFrame:
    """query_id, ratio of interval widths; 10 where the baseline's is 0."""
    b = baseline.select("query_id", F.col(f"ci_{measure}").alias("base"))
    return results.join(b, "query_id").select("query_id", F.when(F.col("base") == 0, 10.0).otherwise(F.col(f"ci_{measure}") / F.col("base")).alias("ratio"))


def percentiles(df: DataFrame, value: Column, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row: p50, p95, ... with linear interpolation, and the mean."""
    return df.agg(*[F.percentile(value, F.lit(p)).alias(f"p{round(100 * p)}") for p in at], F.avg(value).alias("mean"))


def report(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of the usual figures: median errors, median interval ratios, failure and skip rates."""
    both = paired(results, truth)
    med = lambda c: F.percentile(c, F.lit(0.5))
    aggs = [F.count("*").alias("queries")]
    aggs += [med(relative_error(m)).alias(f"re_{m}") for m in MEASURES if f"gt_{m}" in both.columns and m in results.columns]
    for m in ("cnt", "sum", "avg"):
        aggs += [med(ci_ratio(m)).alias(f"ci_ratio_{m}"), F.avg(failed(m)).alias(f"failure_{m}"), med(F.col(f"ci_{m}")).alias(f"half_width_{m}")]
    aggs.append(F.avg(skip_rate()).alias("skip_rate"))
    return both.agg(*aggs)
