"""Query workloads: random, inside a window, and every interval of a small domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.intervals import Box, inside, to_sql
from tessera.operators.exact import batch_aggregate
from tessera.operators.sampling import ranked


TRIES = 16  # pairs of rows that are drawn for each query wanted, at most


def _pairs(df: DataFrame, key: str, dims: list[str], pairs: int, seed: str, total: int) -> tuple[dict[str, Box], bool]:
    """Boxes around the first pairs of rows in the seed's order, without those of one value in a dimension;
    whether the table has no more rows."""
    rows = ranked(df.select(key, *dims), key, seed, F.lit(2 * pairs), total=total, wanted=2 * pairs).orderBy("rnk").collect()
    out = {}
    for i in range(len(rows) // 2):
        a, b = rows[2 * i], rows[2 * i + 1]
        box = {d: (int(min(a[d], b[d])), int(max(a[d], b[d]))) for d in dims}
        if all(lo != hi for lo, hi in box.values()):
            out[f"q{i:05d}"] = box
    return out, len(rows) < 2 * pairs


def random_boxes(df: DataFrame, key: str, dims: list[str], n: int, seed: str) -> dict[str, Box]:
    """n boxes around two random rows each; a box of one value in a dimension is drawn again. Fewer only if
    ``TRIES`` times as many pairs, or all rows, don't give more."""
    total, pairs = df.count(), n
    while True:
        out, all_ = _pairs(df, key, dims, pairs, seed, total)
        if len(out) >= n or all_ or pairs >= TRIES * n:
            return dict(list(out.items())[:n])
        pairs *= 2


def random_workload(df: DataFrame, key: str, dims: list[str], target: str, n: int, seed: str, least: int = 20, source: DataFrame | None = None) -> DataFrame:
    """query_id, box limits and exact answers of n queries with ``least`` matching rows or more, in the order
    of their draws; others are drawn again as in ``random_boxes``. End points are from ``source`` (``df``)."""
    source = df if source is None else source
    total, pairs = source.count(), n
    while True:
        boxes, all_ = _pairs(source, key, dims, pairs, seed, total)
        answers = batch_aggregate(df, boxes, target).where(F.col("cnt") >= least)
        good = sorted(r["query_id"] for r in answers.select("query_id").collect())
        if len(good) >= n or all_ or pairs >= TRIES * n:
            break
        pairs *= 2
    kept = good[:n]
    limits = df.sparkSession.createDataFrame([(q, *(x for d in dims for x in boxes[q][d])) for q in kept], "query_id string, " + ", ".join(f"lo_{d} long, hi_{d} long" for d in dims))
    return limits.join(answers, "query_id")


def window_workload(df: DataFrame, key: str, dims: list[str], target: str, n: int, seed: str, low, high, least: int = 20) -> DataFrame:
    """The same with end points from rows of a window on the first dimension only."""
    return random_workload(df, key, dims, target, n, seed, least, df.where(F.col(dims[0]).between(low, high)))


def every_interval(df: DataFrame, p: str, target: str, least: int = 5, block: int = 1000) -> DataFrame:
    """lo, hi, cnt, sum of each interval of the domain's values with hi >= lo + 2 and ``least`` rows.

    From prefix sums over the distinct values; these meet by blocks, so that a task has a block of lower
    and one of upper ends. (The result is the square of the values; the window has a row a value.)
    """
    by = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("v")).agg(F.count("*").alias("n"), F.sum(target).alias("s"))
    order = Window.orderBy("v")
    run = by.select("v", F.sum("n").over(order).alias("cn"), F.sum("s").over(order).alias("cs"), "n", "s", F.floor((F.row_number().over(order) - 1) / block).alias("block"))
    last = by.count() // block
    a = run.select(F.col("v").alias("lo"), (F.col("cn") - F.col("n")).alias("under"), (F.col("cs") - F.col("s")).alias("below"), F.explode(F.sequence("block", F.lit(last).cast("long"))).alias("block"))
    b = run.select(F.col("v").alias("hi"), "cn", "cs", "block")
    out = a.join(b, "block").where(F.col("hi") >= F.col("lo") + 2)
    return out.select("lo", "hi", (F.col("cn") - F.col("under")).alias("cnt"), (F.col("cs") - F.col("below")).alias("sum")).where(F.col("cnt") >= least)


def random_predicates(spark: SparkSession, n: int, low: int, high: int, seed: str) -> DataFrame:
    """query_id, lo, hi: n pairs of distinct uniform whole numbers of [low, high]."""
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    number = lambda at, size: F.conv(F.substring(digits, at, 12), 16, 10).cast("long") % F.lit(size)
    rows = spark.range(n).select("id", number(1, high - low + 1).alias("a"), number(13, high - low).alias("b"))
    b = F.when(F.col("b") >= F.col("a"), F.col("b") + 1).otherwise(F.col("b"))
    return rows.select(F.concat(F.lit("q"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("query_id"), (F.least("a", b) + low).alias("lo"), (F.greatest("a", b) + low).alias("hi"))


def special_query(p: str = "p") -> dict[str, Box]:
    """The fixed query of the original workload."""
    return {"special": {p: (6597, 6619)}}


def refresh(df: DataFrame, workload: DataFrame, dims: list[str], target: str) -> DataFrame:
    """Exact answers of a stored workload (query_id, lo_d, hi_d) anew. The queries are planned on the driver."""
    boxes = {r["query_id"]: {d: (r[f"lo_{d}"], r[f"hi_{d}"]) for d in dims} for r in workload.select("query_id", *(f"{e}_{d}" for d in dims for e in ("lo", "hi"))).toLocalIterator()}
    return batch_aggregate(df, boxes, target)


def first_queries(workload: DataFrame, n: int) -> DataFrame:
    return workload.orderBy("query_id").limit(n)


def sql_texts(boxes: dict[str, Box], target: str, table: str) -> dict[str, str]:
    return {q: to_sql(b, target, table) for q, b in sorted(boxes.items())}


def exact_by_sql(df: DataFrame, boxes: dict[str, Box], target: str) -> dict[str, float]:
    """SUM of each query through SQL text on a view."""
    df.createOrReplaceTempView("tessera_workload")
    spark = df.sparkSession
    return {q: spark.sql(s).first()[0] for q, s in sql_texts(boxes, target, "tessera_workload").items()}


__all__ = ["every_interval", "exact_by_sql", "first_queries", "inside", "random_boxes", "random_predicates", "random_workload", "refresh", "special_query", "sql_texts", "window_workload"]
