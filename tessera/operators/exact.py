"""Exact range aggregates: single, and a batch of queries in one pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.intervals import Box, constants, inside

BATCH = 4096  # queries in one pass
CELLS = 64  # parts of the first dimension that queries over several are dealt to


def range_aggregate(df: DataFrame, box: Box, target: str) -> DataFrame:
    """cnt, sum, avg, min, max of the rows in the box; avg and sum are 0 where there's none."""
    t = F.col(target)
    return df.where(inside(box)).agg(F.count(t).alias("cnt"), F.coalesce(F.sum(t), F.lit(0)).alias("sum"), F.coalesce(F.avg(t), F.lit(0.0)).alias("avg"), F.min(t).alias("min"), F.max(t).alias("max"))


def query_table(spark: SparkSession, queries: dict[str, Box], dims: list[str]) -> DataFrame:
    """One row a query: query_id, lo_d and hi_d of each dimension (null where it has none)."""
    rows = [(q, *(float(x) if x is not None else None for d in dims for x in box.get(d, (None, None)))) for q, box in sorted(queries.items())]
    return spark.createDataFrame(rows, "query_id string" + "".join(f", lo_{d} double, hi_{d} double" for d in dims))


def batch_aggregate(df: DataFrame, queries: dict[str, Box], target: str) -> DataFrame:
    """The aggregates of each query, in one pass over the table per ``BATCH`` queries. No row is compared
    with every query: over one dimension rows are aggregated by elementary cell between the queries' end
    points (4 * BATCH + 1 at most), and cells are put together by query; over several, a row meets the
    queries of its part of the first dimension.
    """
    dims = sorted({d for b in queries.values() for d in b})
    names, out = sorted(queries), None
    for at in range(0, max(1, len(names)), BATCH):
        some = {q: queries[q] for q in names[at : at + BATCH]}
        part = _by_cells(df, some, dims[0], target) if len(dims) == 1 and all(b for b in some.values()) else _by_parts(df, some, dims, target)
        out = part if out is None else out.unionByName(part)
    return out


def cell_of(p: Column, ends: list) -> Column:
    """Elementary cell of a value among sorted end points: 2 i + 1 at the i-th, 2 i before it."""
    at, steps = constants(ends), [1 << i for i in reversed(range(len(ends).bit_length()))]
    ahead = lambda lo, step: F.when((lo + step <= len(ends)) & (F.get(at, (lo + step - 1).cast("int")) <= p), lo + step).otherwise(lo)
    reached = F.aggregate(constants(steps), F.lit(0).cast("long"), ahead)  # end points up to p
    here = lambda i: i * 2 - F.when(F.get(at, (i - 1).cast("int")) == p, 1).otherwise(0)
    return F.when(p.isNotNull(), F.get(F.transform(F.array(reached), here), 0))


def _by_cells(df: DataFrame, queries: dict[str, Box], dim: str, target: str) -> DataFrame:
    spark, t = df.sparkSession, F.col(target)
    ends = sorted({x for b in queries.values() for x in b[dim]})
    cells = df.select(cell_of(F.col(dim), ends).alias("cell"), t.alias("t")).groupBy("cell").agg(F.count("t").alias("cnt"), F.sum("t").alias("sum"), F.min("t").alias("min"), F.max("t").alias("max"))
    kinds = {f.name: f.dataType for f in cells.schema}
    held = sorted((r for r in cells.where("cell is not null and cnt > 0").collect()), key=lambda r: r["cell"])  # as many as cells
    number, place = np.array([r["cell"] for r in held], dtype=np.int64), {x: i for i, x in enumerate(ends)}
    zero = type(held[0]["sum"])(0) if held else 0
    rows = []
    for q, b in sorted(queries.items()):
        lo, hi = (2 * place[x] + 1 for x in b[dim])
        mine = held[int(np.searchsorted(number, lo)) : int(np.searchsorted(number, hi, side="right"))]
        n, total = sum(r["cnt"] for r in mine), sum((r["sum"] for r in mine), zero)
        rows.append((q, n, total, float(total) / n if n else 0.0, min((r["min"] for r in mine), default=None), max((r["max"] for r in mine), default=None)))
    schema = f"query_id string, cnt long, sum {kinds['sum'].simpleString()}, avg double, min {kinds['min'].simpleString()}, max {kinds['max'].simpleString()}"
    return spark.createDataFrame(rows, schema)


def _by_parts(df: DataFrame, queries: dict[str, Box], dims: list[str], target: str) -> DataFrame:
    """Parts of the first dimension hold about as many end points each; a query is in those that it meets."""
    spark, hit = df.sparkSession, F.lit(True)
    ends = sorted(float(x) for b in queries.values() if dims and dims[0] in b for x in b[dims[0]])
    cuts = sorted({ends[i * len(ends) // CELLS] for i in range(CELLS)}) if ends else []
    asked = query_table(spark, queries, dims)
    reach = lambda c: _part(F.col(c), cuts)
    if cuts:
        first, last = F.coalesce(reach(f"lo_{dims[0]}"), F.lit(0)), F.coalesce(reach(f"hi_{dims[0]}"), F.lit(len(cuts)))
        parts = asked.withColumn("__part", F.explode(F.when(first <= last, F.sequence(first, last))))
    else:
        parts = asked.withColumn("__part", F.lit(0))
    for d in dims:
        hit = hit & F.coalesce(F.col(d).between(F.col(f"lo_{d}"), F.col(f"hi_{d}")), F.col(f"lo_{d}").isNull())
    rows = df.select(*dims, F.col(target).alias("__t"), (F.coalesce(reach(dims[0]), F.lit(0)) if cuts else F.lit(0)).alias("__part"))
    found = rows.join(F.broadcast(parts), "__part").where(hit).groupBy("query_id").agg(F.count("__t").alias("cnt"), F.sum("__t").alias("sum"), F.avg("__t").alias("avg"), F.min("__t").alias("min"), F.max("__t").alias("max"))
    return asked.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("sum", F.lit(0)).alias("sum"), F.coalesce("avg", F.lit(0.0)).alias("avg"), "min", "max")


def _part(p: Column, cuts: list[float]) -> Column:
    """How many cuts are at or below p."""
    return F.when(p.isNotNull(), sum((F.when(p >= F.lit(x), 1).otherwise(0) for x in cuts), F.lit(0)))
