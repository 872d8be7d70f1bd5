"""Catalogue of the engine's operators as queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import intervals as iv
from tessera.functions.moments import query_id, seed_of
from tessera.operators import buckets, exact, merge, partition, sampling, tree
from tessera.plans import metrics, workload
from tessera.plans.synopsis import Synopsis
from tessera.sources import axes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# SQL building blocks: the same axes, samples and estimates in plain SQL

ORD = "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_custkey AS p, CAST(round(o_totalprice) AS BIGINT) AS t, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS f FROM orders"
EVT = "SELECT CAST(event_id AS VARCHAR) AS key, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS d, CAST(strftime(ts, '%H%M%S') AS BIGINT) AS p, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(round(value * 100) AS BIGINT) AS t FROM events"
LIN = "SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS key, l_partkey AS p, l_suppkey AS s, CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT) AS d, CAST(round(l_extendedprice) AS BIGINT) AS t FROM lineitem"


def width_sql(dims: list[str], k: int) -> str:
    """Equal-width leaf number from columns lo_d, hi_d."""
    out = "0"
    for d in dims:
        out = f"({out}) * {k + 1} + CAST(floor(({d} - (lo_{d} - 2)) / CAST((hi_{d} - lo_{d} + {3 + k - 1}) // {k} AS DOUBLE)) AS BIGINT)"
    return out


def values_sql(queries: dict[str, iv.Box], dims: list[str]) -> str:
    rows = ", ".join("(" + ", ".join([f"'{q}'", *(str(x) for d in dims for x in b.get(d, ("NULL::BIGINT", "NULL::BIGINT")))]) + ")" for q, b in sorted(queries.items()))
    return f"(VALUES {rows}) AS v(query_id, {', '.join(f'qlo_{d}, qhi_{d}' for d in dims)})"


def leaves_sql(base: str, dims: list[str], k: int) -> str:
    ends = ", ".join(f"min({d}) AS lo_{d}, max({d}) AS hi_{d}" for d in dims)
    box = ", ".join(f"min({d}) AS lo_{d}, max({d}) AS hi_{d}" for d in dims)
    return f"""base AS ({base}), ends AS (SELECT {ends} FROM base),
     l AS (SELECT base.*, {width_sql(dims, k)} AS leaf FROM base, ends),
     node AS (SELECT leaf, count(*) AS n, {box}, sum(t) AS s, min(t) AS mn, max(t) AS mx FROM l GROUP BY leaf)"""


def in_box_sql(dims: list[str], row: str = "r") -> str:
    return " AND ".join(f"(q.qlo_{d} IS NULL OR {row}.{d} BETWEEN q.qlo_{d} AND q.qhi_{d})" for d in dims)


def estimate_sql(base: str, tree_dims: list[str], k: int, queries: dict[str, iv.Box], rate: float, method: str, seed: str = "tessera") -> str:
    """All of a method's answers in one statement."""
    dims = sorted({d for b in queries.values() for d in b})
    meets = " AND ".join(f"(qlo_{d} IS NULL OR (lo_{d} <= qhi_{d} AND hi_{d} >= qlo_{d}))" for d in dims if d in tree_dims) or "TRUE"
    same = "FALSE" if set(dims) != set(tree_dims) else "TRUE"
    covered = " AND ".join([same, *(f"coalesce(qlo_{d} <= lo_{d} AND hi_{d} <= qhi_{d}, FALSE)" for d in tree_dims if d in dims)])
    if method in ("uniform", "stratified"):
        meets, covered = "TRUE", "FALSE"
    limit = "(SELECT CAST(floor(count(*) * {r}) AS BIGINT) FROM base)".format(r=rate)
    size = "(SELECT CAST(floor(count(*) * {r} + 0.5) AS BIGINT) FROM base)".format(r=rate)
    sampled = method in ("uniform", "stratified")
    if method in ("hybrid", "stratified"):
        parts = f"""
     al AS (SELECT query_id, leaf, n AS big_n, least({limit}, sum(n) OVER (PARTITION BY query_id)) * n // sum(n) OVER (PARTITION BY query_id) AS n FROM cls WHERE NOT covered),
     rk AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY md5('{seed}:' || key), key) AS rnk FROM l),
     st AS (SELECT q.query_id, a.leaf, any_value(a.big_n) AS big_n, any_value(a.n) AS n, count(*) AS k, sum(CAST(r.t AS DOUBLE)) AS s, sum(CAST(r.t AS DOUBLE) * r.t) AS ss, min(r.t) AS mn, max(r.t) AS mx
            FROM al a JOIN q ON q.query_id = a.query_id JOIN rk r ON r.leaf = a.leaf AND r.rnk <= a.n AND {in_box_sql(dims)} GROUP BY ALL),"""
    else:
        narrowed = "" if method == "uniform" else "JOIN cls c ON c.query_id = q.query_id AND c.leaf = r.leaf AND NOT c.covered"
        parts = f"""
     rk AS (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || key), key) AS rnk FROM l),
     st AS (SELECT q.query_id, {size} / {rate} AS big_n, {size} AS n, count(*) AS k, sum(CAST(r.t AS DOUBLE)) AS s, sum(CAST(r.t AS DOUBLE) * r.t) AS ss, min(r.t) AS mn, max(r.t) AS mx
            FROM q JOIN rk r ON r.rnk <= {size} AND {in_box_sql(dims)} {narrowed} GROUP BY q.query_id),"""
    v_avg = "CASE WHEN coalesce(d_cnt, 0) > 0 THEN v_sum / (d_cnt * d_cnt) ELSE 0 END" if method in ("hybrid", "stratified") else "coalesce((n_all / k_all) * (n_all / k_all) * (ss_all / n_all - (s_all / n_all) * (s_all / n_all)) / n_all, 0)"
    half = lambda v: f"2.576 * sqrt(greatest({v}, 0))"
    return f"""
WITH {leaves_sql(base, tree_dims, k)},
     q AS (SELECT * FROM {values_sql(queries, dims)}),
     cls AS (SELECT query_id, leaf, n, s, mn, mx, {covered} AS covered FROM q JOIN node ON {meets}),
     ex AS (SELECT q.query_id, coalesce(sum(CASE WHEN covered THEN n END), 0) AS e_cnt, coalesce(sum(CASE WHEN covered THEN s END), 0) AS e_sum, min(mn) AS b_min, max(mx) AS b_max,
                   count(CASE WHEN NOT covered THEN 1 END) / CAST((SELECT count(*) FROM node) AS DOUBLE) AS lf, coalesce(sum(CASE WHEN NOT covered THEN n END), 0) / CAST((SELECT count(*) FROM base) AS DOUBLE) AS rf
            FROM q LEFT JOIN cls ON cls.query_id = q.query_id GROUP BY q.query_id),{parts}
     es AS (SELECT query_id, sum(big_n * CAST(k AS DOUBLE) / n) AS d_cnt, sum(big_n * s / n) AS d_sum, sum((CAST(k AS DOUBLE) / n - (CAST(k AS DOUBLE) / n) * (CAST(k AS DOUBLE) / n)) * big_n * CAST(big_n AS DOUBLE) / n) AS v_cnt,
                   sum((ss / n - (s / n) * (s / n)) * big_n * CAST(big_n AS DOUBLE) / n) AS v_sum, min(mn) AS s_min, max(mx) AS s_max, CAST(sum(k) AS DOUBLE) AS k_all, CAST(max(n) AS DOUBLE) AS n_all, sum(s) AS s_all, sum(ss) AS ss_all FROM st GROUP BY query_id),
     o AS (SELECT ex.query_id, e_cnt + coalesce(d_cnt, 0) AS cnt, e_sum + coalesce(d_sum, 0) AS sum, {half("coalesce(v_cnt, 0)")} AS ci_cnt, {half("coalesce(v_sum, 0)")} AS ci_sum, {half(v_avg)} AS ci_avg,
                  {"s_min" if sampled else "b_min"} AS mn, {"s_max" if sampled else "b_max"} AS mx, {"NULL::DOUBLE" if sampled else "lf"} AS lf, {"NULL::DOUBLE" if sampled else "rf"} AS rf FROM ex LEFT JOIN es ON es.query_id = ex.query_id)
SELECT query_id, round(CAST(cnt AS DOUBLE), 4) AS cnt, round(CAST(sum AS DOUBLE), 3) AS sum, round(CASE WHEN cnt > 0 THEN sum / cnt ELSE 0 END, 5) AS avg, round(ci_cnt, 3) AS ci_cnt, round(ci_sum, 2) AS ci_sum, round(ci_avg, 4) AS ci_avg,
       CAST(mn AS DOUBLE) AS min, CAST(mx AS DOUBLE) AS max, round(lf, 8) AS delta_leaf_frac, round(rf, 8) AS delta_row_frac FROM o
"""


def rounded(df: DataFrame) -> DataFrame:
    digits = {"cnt": 4, "sum": 3, "avg": 5, "ci_cnt": 3, "ci_sum": 2, "ci_avg": 4, "delta_leaf_frac": 8, "delta_row_frac": 8}
    return df.select("query_id", *[F.round(F.col(c).cast("double"), digits[c]).alias(c) if c in digits else F.col(c).cast("double").alias(c) for c in df.columns if c != "query_id"])


# fixed workloads

ORDER_BOXES = {"a": {"p": (100, 900)}, "b": {"p": (37, 61)}, "c": {"p": (1, 10**9)}, "d": {"p": (10**8, 10**9)}, "e": {"p": (500, 520)}}
EVENT_BOXES = {"a": {"p": (80000, 173000)}, "b": {"p": (120000, 120500)}, "c": {"p": (0, 235959)}}
EVENT_BOXES_2D = {"a": {"d": (20240105, 20240120), "p": (60000, 180000)}, "b": {"d": (20000101, 20991231), "p": (93000, 94500)}, "c": {"d": (20000101, 20991231), "p": (0, 235959)}}
EVENT_BOXES_1D_OF_2D = {"a": {"p": (80000, 173000)}, "b": {"p": (0, 235959)}}
EVENT_BOXES_3D = {"a": {"d": (20000101, 20991231), "p": (60000, 180000), "s": (0, 4 * 10**9)}}
LINE_BOXES = {"a": {"p": (50, 900), "s": (2, 60)}, "b": {"p": (1, 10**9), "s": (5, 9)}}

# exact answers



def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({"avg": F.round("avg", 5), "min": F.col("min").cast("double"), "max": F.col("max").cast("double")})



@query("SELECT count(*) AS cnt, CAST(coalesce(sum(t), 0) AS BIGINT) AS sum, round(coalesce(avg(t), 0), 5) AS avg, min(t) AS min, max(t) AS max FROM (" + LIN + ") WHERE p BETWEEN 100 AND 900")
def exact_range_1d(spark: SparkSession, sf: str) -> DataFrame:
    return exact.range_aggregate(axes.lineitem(spark, sf), {"p": (100, 900)}, "t").withColumn("avg", F.round("avg", 5))


@query("SELECT count(*) AS cnt, CAST(coalesce(sum(t), 0) AS BIGINT) AS sum, round(coalesce(avg(t), 0), 5) AS avg, min(t) AS min, max(t) AS max FROM (" + LIN + ") WHERE p BETWEEN 100 AND 900 AND s BETWEEN 3 AND 50")
def exact_range_2d(spark: SparkSession, sf: str) -> DataFrame:
    return exact.range_aggregate(axes.lineitem(spark, sf), {"p": (100, 900), "s": (3, 50)}, "t").withColumn("avg", F.round("avg", 5))


@query("SELECT count(*) AS cnt, CAST(coalesce(sum(t), 0) AS BIGINT) AS sum, round(coalesce(avg(t), 0), 5) AS avg, min(t) AS min, max(t) AS max FROM (" + LIN + ") WHERE p BETWEEN 100 AND 900 AND s BETWEEN 3 AND 50 AND d BETWEEN 19940101 AND 19961231")
def exact_range_3d(spark: SparkSession, sf: str) -> DataFrame:
    return exact.range_aggregate(axes.lineitem(spark, sf), {"p": (100, 900), "s": (3, 50), "d": (19940101, 19961231)}, "t").withColumn("avg", F.round("avg", 5))


@query("SELECT count(*) AS cnt, CAST(coalesce(sum(t), 0) AS BIGINT) AS sum, coalesce(avg(t), 0) AS avg, CAST(min(t) AS DOUBLE) AS min, CAST(max(t) AS DOUBLE) AS max FROM (" + ORD + ") WHERE p BETWEEN 1000000000 AND 2000000000")
def exact_empty(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(exact.range_aggregate(axes.orders(spark, sf), {"p": (10**9, 2 * 10**9)}, "t"))


def _truth_sql(base: str, boxes: dict[str, iv.Box]) -> str:
    dims = sorted({d for b in boxes.values() for d in b})
    return f"SELECT q.query_id, count(r.t) AS cnt, CAST(coalesce(sum(r.t), 0) AS BIGINT) AS sum, round(coalesce(avg(r.t), 0), 5) AS avg, CAST(min(r.t) AS DOUBLE) AS min, CAST(max(r.t) AS DOUBLE) AS max FROM {values_sql(boxes, dims).replace('AS v(', 'AS q(')} LEFT JOIN ({base}) r ON {in_box_sql(dims)} GROUP BY q.query_id"


@query(_truth_sql(ORD, ORDER_BOXES))
def ground_truth_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(exact.batch_aggregate(axes.orders(spark, sf), ORDER_BOXES, "t"))


@query(_truth_sql(EVT, EVENT_BOXES_2D))
def ground_truth_2d(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(exact.batch_aggregate(axes.events(spark, sf), EVENT_BOXES_2D, "t"))


# sources


@query("SELECT key, d, p, s FROM (" + EVT + ")")
def axis_derivation(spark: SparkSession, sf: str) -> DataFrame:
    return axes.events(spark, sf).select("key", "d", "p", "s")


@query("SELECT 'p' AS \"column\", count(p) AS n, round(avg(p), 4) AS mean, round(stddev_samp(p), 4) AS std, CAST(min(p) AS DOUBLE) AS min, CAST(max(p) AS DOUBLE) AS max FROM (" + ORD + ") UNION ALL SELECT 't', count(t), round(avg(t), 4), round(stddev_samp(t), 4), CAST(min(t) AS DOUBLE), CAST(max(t) AS DOUBLE) FROM (" + ORD + ")")
def profile(spark: SparkSession, sf: str) -> DataFrame:
    return axes.profile(axes.orders(spark, sf), ["p", "t"]).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("SELECT key, p FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key, nullif(o_custkey % 7, 0) AS p FROM orders) WHERE p IS NOT NULL")
def null_rows_dropped(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("key"), F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("p"))
    return axes.without_nulls(df)


# partitions and their aggregates

_NODE_OUT = "leaf, n AS cnt, {box}, CAST(s AS BIGINT) AS sum_t, mn AS min_t, mx AS max_t, round(s / CAST(n AS DOUBLE), 4) AS avg_t"


def _nodes(df: DataFrame, leaf, dims: list[str]) -> DataFrame:
    return tree.leaf_aggregates(df.withColumn("leaf", leaf.cast("long")), "leaf", dims, ["t"]).withColumn("avg_t", F.round("avg_t", 4))


@query(f"WITH {leaves_sql(ORD, ['p'], 16)} SELECT {_NODE_OUT.format(box='lo_p, hi_p')} FROM node")
def equal_width_nodes(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.orders(spark, sf)
    return _nodes(df, partition.equal_width(df, ["p"], 16), ["p"])


@query(f"WITH {leaves_sql(EVT, ['d', 'p'], 4)} SELECT {_NODE_OUT.format(box='lo_d, hi_d, lo_p, hi_p')} FROM node")
def equal_width_nodes_2d(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.events(spark, sf)
    return _nodes(df, partition.equal_width(df, ["d", "p"], 4), ["d", "p"])


@query(f"WITH {leaves_sql(EVT, ['d'], 8)} SELECT {_NODE_OUT.format(box='lo_d, hi_d')} FROM node")
def random_dimension_nodes(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.events(spark, sf)
    d, leaf = partition.random_dimension(df, ["p", "d"], 8, seed=2)
    assert d == "d"
    return _nodes(df, leaf, [d])


def _median_sql(base: str, dims: list[str]) -> str:
    med = ", ".join(f"CAST(floor(quantile_cont({d}, 0.5)) AS BIGINT) AS m_{d}" for d in dims)
    leaf = " + ".join(f"CASE WHEN {d} > m_{d} THEN {1 << i} ELSE 0 END" for i, d in enumerate(dims))
    box = ", ".join(f"min({d}) AS lo_{d}, max({d}) AS hi_{d}" for d in dims)
    out = ", ".join(f"lo_{d}, hi_{d}" for d in dims)
    return f"WITH base AS ({base}), m AS (SELECT {med} FROM base), l AS (SELECT base.*, CAST({leaf} AS BIGINT) AS leaf FROM base, m), node AS (SELECT leaf, count(*) AS n, {box}, sum(t) AS s, min(t) AS mn, max(t) AS mx FROM l GROUP BY leaf) SELECT {_NODE_OUT.format(box=out)} FROM node"


@query(_median_sql(ORD, ["p"]))
def median_nodes_1d(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.orders(spark, sf)
    return _nodes(df, partition.median_split(df, ["p"]), ["p"])


@query(_median_sql(EVT, ["d", "p"]))
def median_nodes_2d(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.events(spark, sf)
    return _nodes(df, partition.median_split(df, ["d", "p"]), ["d", "p"])


_POINTS = """base AS ({base}), big AS (SELECT count(*) AS n FROM base),
     rk AS (SELECT *, row_number() OVER (ORDER BY md5('12345:' || key), key) AS rnk, row_number() OVER (ORDER BY p, key) AS first, row_number() OVER (ORDER BY p DESC, key DESC) AS last FROM base),
     pick AS (SELECT key, p, t FROM rk, big WHERE rnk <= CAST(floor(n * {rate}) AS BIGINT) OR first = 1 OR last = 1 QUALIFY row_number() OVER (PARTITION BY p ORDER BY key DESC) = 1),
     pt AS (SELECT p, t, row_number() OVER (ORDER BY p) - 1 AS i, (SELECT count(*) FROM base b WHERE b.p <= pick.p) - 1 AS pos FROM pick)"""


@query(
    f"WITH {_POINTS.format(base=ORD, rate=0.02)}, k AS (SELECT least(16, count(*)) AS k, count(*) AS m FROM pt), cuts AS (SELECT pt.p AS start, b FROM k, range(0, 16) r(b), pt WHERE b < k AND pt.i = b * m // k), "
    f"l AS (SELECT base.*, (SELECT greatest(count(*) - 1, 0) FROM cuts WHERE start <= base.p) AS leaf FROM base), node AS (SELECT leaf, count(*) AS n, min(p) AS lo_p, max(p) AS hi_p, sum(t) AS s, min(t) AS mn, max(t) AS mx FROM l GROUP BY leaf) SELECT {_NODE_OUT.format(box='lo_p, hi_p')} FROM node"
)
def equal_depth_nodes(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.orders(spark, sf)
    points = partition.sample_points(df, "key", "p", "t", 0.02)
    return _nodes(df, partition.by_cuts(F.col("p"), partition.choose_cuts(points, 16, "depth")), ["p"])


@query(f"WITH {_POINTS.format(base=ORD, rate=0.02)} SELECT p, CAST(t AS DOUBLE) AS t, i, pos FROM pt")
def sample_points(spark: SparkSession, sf: str) -> DataFrame:
    pts = partition.sample_points(axes.orders(spark, sf), "key", "p", "t", 0.02)
    return spark.createDataFrame([(int(x), float(t), i, int(pos)) for i, (x, t, pos) in enumerate(zip(pts.x, pts.t, pts.pos, strict=True))], "p long, t double, i long, pos long")


@query("SELECT p, any_value(key) AS key, any_value(t) AS t FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY key DESC) AS r FROM (" + ORD + ")) WHERE r = 1 GROUP BY p")
def distinct_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return merge.keep_last(axes.orders(spark, sf).select("p", "key", "t"), "p", ["key"])


@query(
    f"WITH {_POINTS.format(base=ORD, rate=0.02)}, k AS (SELECT least(16, count(*)) AS k, count(*) AS m FROM pt), cuts AS (SELECT pt.p AS lo FROM k, range(0, 16) r(b), pt WHERE b < k AND pt.i = b * m // k) "
    "SELECT lo, coalesce(lead(lo) OVER (ORDER BY lo) - 1, (SELECT max(p) FROM base)) AS hi FROM cuts"
)
def adjacent_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-number intervals of an equal-depth partition."""
    df = axes.orders(spark, sf)
    starts = partition.choose_cuts(partition.sample_points(df, "key", "p", "t", 0.02), 16, "depth")
    return partition.adjacent_intervals(spark.createDataFrame([(int(x),) for x in starts], "start long"), "start", partition.ranges(df, ["p"])["p"][1])


# trees


def _rollup_sql(k: int, levels: int) -> str:
    parts = [f"SELECT {d} AS up, leaf // {2**d} AS node, CAST(sum(n) AS BIGINT) AS cnt, min(lo_p) AS lo_p, max(hi_p) AS hi_p, CAST(sum(s) AS BIGINT) AS sum_t, min(mn) AS min_t, max(mx) AS max_t FROM node GROUP BY ALL" for d in range(levels)]
    return f"WITH {leaves_sql(ORD, ['p'], k)} " + " UNION ALL ".join(parts)


@query(_rollup_sql(16, 5))
def binary_tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.orders(spark, sf)
    level = tree.leaf_aggregates(df.withColumn("node", partition.equal_width(df, ["p"], 16).cast("long")), "node", ["p"], ["t"])
    out = None
    for up in range(5):
        part = level.select(F.lit(up).alias("up"), "node", "cnt", "lo_p", "hi_p", "sum_t", "min_t", "max_t")
        out = part if out is None else out.unionByName(part)
        level = tree.merge_up(level, F.floor(F.col("node") / 2), ["p"], ["t"])
    return out


@query("SELECT TRUE AS layers, TRUE AS leaves, count(*) AS cnt, CAST(sum(t) AS BIGINT) AS sum FROM (" + ORD + ")")
def tree_verify(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.orders(spark, sf)
    s = Synopsis.fit(df, "key", ["p"], "t", 16, "depth", 0.02)
    return spark.createDataFrame([(tree.verify_layers(s.root), tree.verify_leaves(s.root, df.count()), s.root.cnt, int(s.root.aggs["t"][0]))], "layers boolean, leaves boolean, cnt long, sum long")


@query(f"""WITH RECURSIVE {leaves_sql(ORD, ['p'], 16)}, c AS (SELECT count(*) AS leaves, CAST(max(n) AS BIGINT) AS largest_leaf FROM node),
     up AS (SELECT leaves AS n, 0 AS deep, 0 AS last FROM c UNION ALL SELECT (n + 1) // 2, deep + 1, last + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END FROM up WHERE n > 1),
     v AS (SELECT max(v) AS v FROM (SELECT var_samp(t) AS v FROM l GROUP BY leaf))
SELECT leaves, CAST(2 * leaves - 1 AS BIGINT) AS nodes, largest_leaf, CAST((SELECT max(last) FROM up) AS BIGINT) AS min_depth, CAST((SELECT max(deep) FROM up) AS BIGINT) AS max_depth, round((SELECT v FROM v) / 1e6, 3) AS max_variance FROM c""")
def tree_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = tree.summary(Synopsis.fit(axes.orders(spark, sf), "key", ["p"], "t", 16, "width").root)
    row = (s["leaves"], s["nodes"], s["largest_leaf"], s["min_depth"], s["max_depth"], s["max_variance"] / 1e6)
    return spark.createDataFrame([row], "leaves long, nodes long, largest_leaf long, min_depth long, max_depth long, max_variance double").withColumn("max_variance", F.round("max_variance", 3))


@query(f"WITH {leaves_sql(EVT, ['d', 'p'], 3)} SELECT CAST(sum(n) AS BIGINT) AS cnt, min(lo_d) AS lo_d, max(hi_d) AS hi_d, min(lo_p) AS lo_p, max(hi_p) AS hi_p, CAST(sum(s) AS BIGINT) AS sum_t FROM node GROUP BY leaf // 4 // 2, leaf % 4 // 2")
def grid_tree_layer(spark: SparkSession, sf: str) -> DataFrame:
    """The layer above the leaves of the complete grid tree."""
    df = axes.events(spark, sf)
    s = Synopsis.fit(df, "key", ["d", "p"], "t", 3, "grid")
    rows, level = [], s.root.children or [s.root]
    for x in level:
        rows.append((x.cnt, *(int(v) for d in ("d", "p") for v in x.box[d]), int(x.aggs["t"][0])))
    return spark.createDataFrame(rows, "cnt long, lo_d long, hi_d long, lo_p long, hi_p long, sum_t long")


@query()
def tree_dump(spark: SparkSession, sf: str) -> DataFrame:
    s = Synopsis.fit(axes.orders(spark, sf), "key", ["p"], "t", 8, "depth", 0.02)
    return spark.createDataFrame([(i, line) for i, line in enumerate(tree.dump(s.root).split("\n"))], "at int, line string")


def _tree_rows(spark: SparkSession, root: tree.Node) -> DataFrame:
    return tree.node_table(spark, root).select("node_id", "parent_id", "depth", "is_leaf", "cnt")


@query()
def kd_error_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_rows(spark, Synopsis.fit(axes.events(spark, sf), "key", ["d", "p"], "t", 32, "median_error").root)


@query()
def kd_breadth_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_rows(spark, Synopsis.fit(axes.events(spark, sf), "key", ["d", "p"], "t", 32, "median_breadth").root)


@query()
def kd_variance_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_rows(spark, Synopsis.fit(axes.events(spark, sf), "key", ["d", "p"], "t", 32, "median_variance").root)


# errors of buckets, and cuts


@query("SELECT key, p, t, row_number() OVER (ORDER BY p, key) - 1 AS pos, CAST(sum(t) OVER w AS BIGINT) AS s, CAST(sum(CAST(t AS HUGEINT) * t) OVER w AS BIGINT) AS ss FROM (" + ORD + ") WINDOW w AS (ORDER BY p, key ROWS UNBOUNDED PRECEDING)")
def prefix_sums(spark: SparkSession, sf: str) -> DataFrame:
    return merge.prefix_sums(axes.orders(spark, sf).select("key", "p", "t"), ["p", "key"], "t")


@query("WITH base AS (" + ORD + "), z AS (SELECT CAST(CASE WHEN p BETWEEN 100 AND 900 THEN t ELSE 0 END AS DOUBLE) AS t FROM base) SELECT round((sum(t * t) / count(*) - (sum(t) / count(*)) * (sum(t) / count(*))) / 1e6, 3) AS variance FROM z")
def interval_variance(spark: SparkSession, sf: str) -> DataFrame:
    return merge.zero_padded_variance(axes.orders(spark, sf), F.col("p").between(100, 900), "t").select(F.round(F.col("variance") / 1e6, 3).alias("variance"))


@query(
    f"""WITH {_POINTS.format(base=ORD, rate=0.004)}, c AS (SELECT count(*) AS n, max(pos) - min(pos) AS rows FROM pt),
     run AS (SELECT i, sum(CAST(t AS DOUBLE)) OVER (ORDER BY i) AS s, sum(CAST(t AS DOUBLE) * t) OVER (ORDER BY i) AS ss FROM pt),
     v AS (SELECT (n * (b.ss - coalesce(a.ss, 0)) - (b.s - coalesce(a.s, 0)) * (b.s - coalesce(a.s, 0))) / ((b.i - f.i + 1.0) * (b.i - f.i + 1.0)) * (1.0 / n) * (1 - n / CAST(rows AS DOUBLE)) AS v
           FROM run f JOIN run b ON b.i >= f.i + 2 LEFT JOIN run a ON a.i = f.i - 1, c)
SELECT round(greatest(max(v), 0) / 1e6, 2) AS error FROM v"""
)
def bucket_max_variance(spark: SparkSession, sf: str) -> DataFrame:
    pts = partition.sample_points(axes.orders(spark, sf), "key", "p", "t", 0.004)
    error = buckets.BucketError(pts.t, pts.pos)(0, len(pts.t) - 1)
    return spark.createDataFrame([(float(round(error / 1e6, 2)),)], "error double")


def _cuts(spark: SparkSession, sf: str, k: int, how: str, rate: float = 0.02) -> DataFrame:
    pts = partition.sample_points(axes.orders(spark, sf), "key", "p", "t", rate)
    starts = partition.choose_cuts(pts, k, how)
    cuts = [int(np.searchsorted(pts.x, s)) for s in starts]
    report = buckets.bucket_report(buckets.BucketError(pts.t, pts.pos), cuts)
    return spark.createDataFrame([(b, int(pts.x[x]), int(pts.x[y]), float(e), float(h)) for b, (x, y, e, h) in enumerate(report)], "bucket int, lo long, hi long, max_variance double, half_width double")


@query()
def minimax_partition(spark: SparkSession, sf: str) -> DataFrame:
    return _cuts(spark, sf, 8, "minimax")


@query()
def minimax_sampled_partition(spark: SparkSession, sf: str) -> DataFrame:
    return _cuts(spark, sf, 8, "minimax_sampled")


@query()
def minimax_fast_partition(spark: SparkSession, sf: str) -> DataFrame:
    return _cuts(spark, sf, 8, "minimax_fast")


@query()
def hill_climb_partition(spark: SparkSession, sf: str) -> DataFrame:
    return _cuts(spark, sf, 8, "climb")


@query(
    f"""WITH {_POINTS.format(base=ORD, rate=0.02)}, k AS (SELECT least(8, count(*)) AS k, count(*) AS m FROM pt),
     cut AS (SELECT b, b * m // k AS a, (b + 1) * m // k - 1 AS z FROM k, range(0, 8) r(b) WHERE b < k),
     own AS (SELECT b, i, p, pos, t, count(*) OVER (PARTITION BY b) AS n, max(pos) OVER (PARTITION BY b) - min(pos) OVER (PARTITION BY b) AS rows FROM pt JOIN cut ON i BETWEEN a AND z),
     run AS (SELECT *, sum(CAST(t AS DOUBLE)) OVER w AS s, sum(CAST(t AS DOUBLE) * t) OVER w AS ss FROM own WINDOW w AS (PARTITION BY b ORDER BY i)),
     v AS (SELECT e.b, max((e.n * (e.ss - f.ss + CAST(f.t AS DOUBLE) * f.t) - (e.s - f.s + f.t) * (e.s - f.s + f.t)) / ((e.i - f.i + 1.0) * (e.i - f.i + 1.0)) * (1.0 / e.n) * (1 - e.n / CAST(e.rows AS DOUBLE))) AS v
           FROM run f JOIN run e ON e.b = f.b AND e.i >= f.i + 2 WHERE e.rows > 0 GROUP BY e.b),
     o AS (SELECT own.b, min(p) AS lo, max(p) AS hi, greatest(coalesce(any_value(v.v), 0), 0) AS v FROM own LEFT JOIN v ON v.b = own.b GROUP BY own.b)
SELECT CAST(b AS INTEGER) AS bucket, lo, hi, round(v / 1e6, 2) AS max_variance, round(2.576 * sqrt(v) / 1e3, 3) AS half_width FROM o"""
)
def equal_depth_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Variances in millions, half widths in thousands."""
    return _cuts(spark, sf, 8, "depth").withColumns({"max_variance": F.round(F.col("max_variance") / 1e6, 2), "half_width": F.round(F.col("half_width") / 1e3, 3)})


# samples


def _uniform_pick(base: str, rate: float, seed: str) -> str:
    return f"SELECT key, p, t FROM ({base}) QUALIFY row_number() OVER (ORDER BY md5('{seed}:' || key), key) <= (SELECT CAST(floor(count(*) * {rate} + 0.5) AS BIGINT) FROM ({base}))"


@query(_uniform_pick(EVT, 0.03, "u"))
def uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.events(spark, sf).select("key", "p", "t")
    return sampling.uniform_sample(df, "key", 0.03, "u", df.count())


@query(f"WITH {leaves_sql(EVT, ['p'], 8)} SELECT key, leaf, rnk FROM (SELECT key, leaf, row_number() OVER (PARTITION BY leaf ORDER BY md5('s:' || key), key) AS rnk FROM l) WHERE rnk <= 5")
def stratum_ranks(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.events(spark, sf).select("key", "p")
    rows = df.withColumn("leaf", partition.equal_width(df, ["p"], 8).cast("long"))
    most = rows.select("leaf").distinct().withColumn("most", F.lit(5).cast("long"))
    return sampling.ranked(rows, "key", "s", most, "leaf").select("key", "leaf", "rnk")


@query(f"WITH {leaves_sql(EVT, ['p'], 8)} SELECT key, leaf FROM (SELECT key, l.leaf, node.n, row_number() OVER (PARTITION BY l.leaf ORDER BY md5('s:' || key), key) AS rnk FROM l JOIN node ON l.leaf = node.leaf) WHERE rnk <= CAST(floor(n * 0.05 + 0.5) AS BIGINT)")
def fraction_by_partition(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.events(spark, sf).select("key", "p")
    return sampling.fraction_by_group(df.withColumn("leaf", partition.equal_width(df, ["p"], 8).cast("long")), "key", "leaf", 0.05, "s").select("key", "leaf")


@query("WITH b AS (" + EVT + "), c AS (SELECT count(*) AS n FROM b) SELECT key, CAST((row_number() OVER (ORDER BY md5('c:' || key), key) - 1) // ((n + 5) // 6) AS INTEGER) AS chunk FROM b, c")
def equal_chunks(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.events(spark, sf).select("key")
    return sampling.equal_chunks(df, "key", 6, "c", df.count()).select("key", "chunk")


_ALLOC = f"""WITH {leaves_sql(EVT, ["p"], 8)}, v AS (SELECT leaf, count(*) AS size, coalesce(var_samp(t), 0) AS variance FROM l GROUP BY leaf)
SELECT leaf, size, round(variance, 4) AS variance, CAST(floor(500 * size / CAST(sum(size) OVER () AS DOUBLE)) AS BIGINT) AS n_proportional, CAST(floor(500 * size * variance / sum(size * variance) OVER ()) AS BIGINT) AS n_variance FROM v"""


@query(_ALLOC)
def allocation(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.events(spark, sf)
    return sampling.allocation(df.withColumn("leaf", partition.equal_width(df, ["p"], 8).cast("long")), "leaf", "t", 500)


@query(f"WITH s AS ({_uniform_pick(EVT, 0.1, 'x')}) SELECT CAST(sum(t) / 0.1 AS DOUBLE) AS sum FROM s WHERE p BETWEEN 80000 AND 173000")
def scramble_sum(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.events(spark, sf).select("key", "p", "t")
    return sampling.scramble_sum(sampling.uniform_sample(df, "key", 0.1, "x", df.count()), F.col("p").between(80000, 173000), "t", 0.1)


# estimates


def _fit(spark: SparkSession, sf: str, table: str, dims: list[str], k: int) -> Synopsis:
    return Synopsis.fit(getattr(axes, table)(spark, sf), "key", dims, "t", k, "width")


@query(estimate_sql(ORD, ["p"], 16, ORDER_BOXES, 0.02, "hybrid"))
def hybrid_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fit(spark, sf, "orders", ["p"], 16).solve(ORDER_BOXES, "hybrid", 0.02))


@query(estimate_sql(ORD, ["p"], 16, ORDER_BOXES, 0.02, "hybrid_uniform"))
def hybrid_uniform_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fit(spark, sf, "orders", ["p"], 16).solve(ORDER_BOXES, "hybrid_uniform", 0.02))


@query(estimate_sql(ORD, ["p"], 16, ORDER_BOXES, 0.05, "uniform"))
def uniform_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fit(spark, sf, "orders", ["p"], 16).solve(ORDER_BOXES, "uniform", 0.05))


@query(estimate_sql(ORD, ["p"], 16, ORDER_BOXES, 0.05, "stratified"))
def stratified_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fit(spark, sf, "orders", ["p"], 16).solve(ORDER_BOXES, "stratified", 0.05))


@query(estimate_sql(EVT, ["p"], 12, EVENT_BOXES, 0.05, "hybrid"))
def hybrid_estimate_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fit(spark, sf, "events", ["p"], 12).solve(EVENT_BOXES, "hybrid", 0.05))


@query(estimate_sql(EVT, ["d", "p"], 5, EVENT_BOXES_2D, 0.1, "hybrid"))
def hybrid_estimate_2d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fit(spark, sf, "events", ["d", "p"], 5).solve(EVENT_BOXES_2D, "hybrid", 0.1))


@query(estimate_sql(LIN, ["p", "s"], 6, LINE_BOXES, 0.02, "hybrid"))
def hybrid_estimate_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fit(spark, sf, "lineitem", ["p", "s"], 6).solve(LINE_BOXES, "hybrid", 0.02))


@query(estimate_sql(EVT, ["d", "p"], 5, EVENT_BOXES_1D_OF_2D, 0.1, "hybrid"))
def workload_shift_fewer(spark: SparkSession, sf: str) -> DataFrame:
    """Queries over one dimension of a two-dimensional tree: nothing is covered, only skipped."""
    return rounded(_fit(spark, sf, "events", ["d", "p"], 5).solve(EVENT_BOXES_1D_OF_2D, "hybrid", 0.1))


@query(estimate_sql(EVT, ["d", "p"], 5, EVENT_BOXES_3D, 0.1, "hybrid"))
def workload_shift_more(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fit(spark, sf, "events", ["d", "p"], 5).solve(EVENT_BOXES_3D, "hybrid", 0.1))


@query(estimate_sql(ORD.replace("CAST(round(o_totalprice) AS BIGINT) AS t", "CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS t"), ["p"], 16, ORDER_BOXES, 0.05, "hybrid"))
def hybrid_estimate_binary(spark: SparkSession, sf: str) -> DataFrame:
    df = axes.orders(spark, sf).select("key", "p", F.col("f").alias("t"))
    return rounded(Synopsis.fit(df, "key", ["p"], "t", 16, "width").solve(ORDER_BOXES, "hybrid", 0.05))


_CLASSES = f"""WITH {leaves_sql(ORD, ["p"], 16)}, q AS (SELECT * FROM {values_sql(ORDER_BOXES, ["p"])})
SELECT query_id, leaf, CASE WHEN NOT (lo_p <= qhi_p AND hi_p >= qlo_p) THEN -2 WHEN qlo_p <= lo_p AND hi_p <= qhi_p THEN -1 WHEN lo_p <= qlo_p AND qhi_p <= hi_p THEN 1 ELSE 2 END AS relation FROM q, node"""


@query(_CLASSES)
def covered_delta_classification(spark: SparkSession, sf: str) -> DataFrame:
    s = _fit(spark, sf, "orders", ["p"], 16)
    rows = [(q, int(x.leaf), tree.relate(b, x)) for q, b in ORDER_BOXES.items() for x in s.root.leaves()]
    return spark.createDataFrame(rows, "query_id string, leaf long, relation int")


_BOUNDS = f"""WITH {leaves_sql(ORD, ["p"], 16)}, q AS (SELECT * FROM {values_sql(ORDER_BOXES, ["p"])})
SELECT query_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS cnt, CAST(coalesce(sum(s), 0) AS DOUBLE) AS sum FROM q LEFT JOIN node ON lo_p <= qhi_p AND hi_p >= qlo_p GROUP BY query_id"""


@query(_BOUNDS)
def aggregate_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _fit(spark, sf, "orders", ["p"], 16).bounds(ORDER_BOXES)


@query(_BOUNDS)
def leaf_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _fit(spark, sf, "orders", ["p"], 16).bounds(ORDER_BOXES, leaves_only=True)


@query(f"""WITH {leaves_sql(ORD, ["p"], 16)}, q AS (SELECT * FROM {values_sql(ORDER_BOXES, ["p"])})
SELECT query_id, CAST(min(mn) AS DOUBLE) AS min, CAST(max(mx) AS DOUBLE) AS max FROM q LEFT JOIN node ON lo_p <= qhi_p AND hi_p >= qlo_p GROUP BY query_id""")
def minmax_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _fit(spark, sf, "orders", ["p"], 16).solve(ORDER_BOXES, "hybrid", 0.02).select("query_id", "min", "max")


@query()
def budget_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """A small budget of nodes: coarser frontier, more sampled leaves, nothing lost."""
    return rounded(_fit(spark, sf, "orders", ["p"], 16).solve(ORDER_BOXES, "hybrid", 0.05, budget=5))


@query()
def error_tree_estimate(spark: SparkSession, sf: str) -> DataFrame:
    s = Synopsis.fit(axes.events(spark, sf), "key", ["d", "p"], "t", 32, "median_error")
    return rounded(s.solve(EVENT_BOXES_2D, "hybrid", 0.1))


@query("WITH e AS (SELECT p % 11 AS g, CAST(t AS DOUBLE) AS value, CAST(p % 5 AS DOUBLE) AS variance FROM (" + ORD + ")), w AS (SELECT g, value, CASE WHEN variance > 0 THEN 1 / variance ELSE 0 END AS w FROM e) SELECT g, round(sum(value * w) / sum(w), 4) AS value, round(1 / sum(w), 8) AS variance FROM w GROUP BY g")
def inverse_variance_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the order totals by group, each weighted by a variance that may be 0."""
    df = axes.orders(spark, sf).select((F.col("p") % 11).alias("g"), F.col("t").cast("double").alias("value"), (F.col("p") % 5).cast("double").alias("variance"))
    return merge.inverse_variance(df, "g", "value", "variance").withColumns({"value": F.round("value", 4), "variance": F.round("variance", 8)})


@query(
    f"""WITH {leaves_sql(ORD, ["p"], 16)}, big AS (SELECT count(*) AS n FROM base),
     ch AS (SELECT l.*, (row_number() OVER (ORDER BY md5('layers:' || key), key) - 1) // ((n + 2) // 3) AS layer FROM l, big),
     st AS (SELECT layer, CASE layer WHEN 0 THEN 0 WHEN 1 THEN leaf // 4 ELSE leaf END AS stratum, CASE WHEN p BETWEEN 100 AND 900 THEN CAST(t AS DOUBLE) ELSE 0 END AS t FROM ch),
     g AS (SELECT layer, stratum, count(*) AS n, sum(t) AS s, sum(t * t) AS ss FROM st GROUP BY ALL),
     y AS (SELECT layer, sum(s * 3) AS value, sum((ss / n - (s / n) * (s / n)) * n * 9) AS variance FROM g GROUP BY layer),
     w AS (SELECT value, CASE WHEN variance > 0 THEN 1 / variance ELSE 0 END AS w FROM y)
SELECT round(sum(value * w) / sum(w) / 1e3, 2) AS value, round(1 / sum(w) / 1e9, 4) AS variance FROM w"""
)
def layered_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Each layer of the tree gets its own random third of the rows; the layers' sums are merged (in
    thousands, the variance in thousand millions)."""
    df = axes.orders(spark, sf)
    chunks = sampling.equal_chunks(df, "key", 3, "layers", df.count())
    leaf = partition.equal_width(df, ["p"], 16)
    samples = sampling.layer_samples(chunks, 3, {0: F.lit(0), 1: F.floor(leaf / 4), 2: leaf})
    out = merge.layer_estimate(samples, F.col("p").between(100, 900), "stratum", "layer", "key", "t", 1 / 3)
    return out.select(F.round(F.col("value") / 1e3, 2).alias("value"), F.round(F.col("variance") / 1e9, 4).alias("variance"))


@query(f"WITH s AS ({_uniform_pick(EVT, 0.1, 'x')}), b(query_id, lo, hi) AS (VALUES ('a', 80000, 173000), ('none', 300000, 400000)), e AS (SELECT query_id, (SELECT sum(t) / 0.1 FROM s WHERE p BETWEEN lo AND hi) AS est, (SELECT sum(t) FROM ({EVT}) r WHERE r.p BETWEEN lo AND hi) AS gt FROM b) SELECT query_id, round(coalesce(abs(gt - est) / abs(gt), 1), 8) AS error FROM e")
def scramble_error(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of SUMs over a scramble as those of an outside engine are counted: 1 where it has no answer."""
    df = axes.events(spark, sf).select("key", "p", "t")
    sample, out = sampling.uniform_sample(df, "key", 0.1, "x", df.count()), None
    for q, (lo, hi) in {"a": (80000, 173000), "none": (300000, 400000)}.items():
        here = F.col("p").between(lo, hi)
        one = sampling.scramble_sum(sample, here, "t", 0.1).crossJoin(df.where(here).agg(F.sum("t").alias("gt")))  # a row each
        one = one.select(F.lit(q).alias("query_id"), F.round(metrics.external_error("gt", "sum"), 8).alias("error"))
        out = one if out is None else out.unionByName(one)
    return out


# metrics over results

_EST = estimate_sql(ORD, ["p"], 16, ORDER_BOXES, 0.02, "hybrid").strip()
_BOTH = f"r AS ({_EST}), g AS ({_truth_sql(ORD, ORDER_BOXES)}), b AS (SELECT r.*, CAST(g.cnt AS DOUBLE) AS gt_cnt, CAST(g.sum AS DOUBLE) AS gt_sum, g.avg AS gt_avg, CAST(g.min AS DOUBLE) AS gt_min, CAST(g.max AS DOUBLE) AS gt_max FROM r JOIN g ON r.query_id = g.query_id)"


def _re_sql(m: str) -> str:
    return f"CASE WHEN gt_{m} = 0 THEN abs(coalesce({m}, 0)) ELSE abs(gt_{m} - coalesce({m}, 0)) / abs(gt_{m}) END"


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.paired(hybrid_estimate(spark, sf), ground_truth_batch(spark, sf))


@query(f"WITH {_BOTH} SELECT query_id, " + ", ".join(f"round({_re_sql(m)}, 8) AS re_{m}" for m in metrics.MEASURES) + " FROM b")
def relative_error(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(spark, sf).select("query_id", *[F.round(metrics.relative_error(m), 8).alias(f"re_{m}") for m in metrics.MEASURES])


@query(f"WITH {_BOTH} SELECT query_id, " + ", ".join(f"round(ci_{m} / CASE WHEN gt_{m} = 0 THEN 1 ELSE abs(gt_{m}) END, 8) AS ratio_{m}, ci_{m} AS half_{m}" for m in ("cnt", "sum", "avg")) + " FROM b")
def ci_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(spark, sf).select("query_id", *[x for m in ("cnt", "sum", "avg") for x in (F.round(metrics.ci_ratio(m), 8).alias(f"ratio_{m}"), F.col(f"ci_{m}").alias(f"half_{m}"))])


@query(f"WITH {_BOTH} SELECT query_id, round(CASE WHEN gt_sum = sum THEN ci_sum ELSE ci_sum / abs(gt_sum - sum) END, 6) AS ratio FROM b")
def ci_error_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(spark, sf).select("query_id", F.round(metrics.ci_error_ratio("sum"), 6).alias("ratio"))


@query(f"WITH {_BOTH} SELECT " + ", ".join(f"avg(CASE WHEN abs(gt_{m} - {m}) > ci_{m} THEN 1.0 ELSE 0.0 END) AS failure_{m}" for m in ("cnt", "sum")) + " FROM b")
def failure_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _paired(spark, sf).agg(*[F.avg(metrics.failed(m)).alias(f"failure_{m}") for m in ("cnt", "sum")])


@query(f"WITH r AS ({_EST}) SELECT query_id, round(1 - delta_leaf_frac, 8) AS skipped FROM r")
def skip_rate(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_estimate(spark, sf).select("query_id", F.round(metrics.skip_rate(), 8).alias("skipped"))


@query(f"WITH {_BOTH}, e AS (SELECT {_re_sql('sum')} AS e FROM b) SELECT round(quantile_cont(e, 0.5), 8) AS p50, round(quantile_cont(e, 0.95), 8) AS p95, round(quantile_cont(e, 0.99), 8) AS p99, round(avg(e), 8) AS mean FROM e")
def metric_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.percentiles(_paired(spark, sf), metrics.relative_error("sum"))
    return got.select(*[F.round(c, 8).alias(c) for c in got.columns])


@query(f"WITH a AS ({_EST}), u AS ({estimate_sql(ORD, ['p'], 16, ORDER_BOXES, 0.05, 'uniform').strip()}) SELECT a.query_id, round(CASE WHEN u.ci_sum = 0 THEN 10 ELSE a.ci_sum / u.ci_sum END, 8) AS ratio FROM a JOIN u ON a.query_id = u.query_id")
def ci_against_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.against_baseline(hybrid_estimate(spark, sf), uniform_estimate(spark, sf), "sum").withColumn("ratio", F.round("ratio", 8))


@query(f"WITH {_BOTH} SELECT round(avg(min / nullif(gt_min, 0)), 8) AS mean_min, round(quantile_cont(min / nullif(gt_min, 0), 0.5), 8) AS median_min, round(avg(max / nullif(gt_max, 0)), 8) AS mean_max, round(quantile_cont(max / nullif(gt_max, 0), 0.5), 8) AS median_max FROM b")
def minmax_ratio(spark: SparkSession, sf: str) -> DataFrame:
    results, truth = hybrid_estimate(spark, sf), ground_truth_batch(spark, sf)
    low, high = (metrics.estimate_ratio(results, truth, m) for m in ("min", "max"))
    return low.select(F.round("mean", 8).alias("mean_min"), F.round("median", 8).alias("median_min")).crossJoin(high.select(F.round("mean", 8).alias("mean_max"), F.round("median", 8).alias("median_max")))


_UNION = f"""WITH base AS ({ORD}), z AS (SELECT CAST(floor(count(*) * 0.05 + 0.5) AS BIGINT) AS n FROM base),
     rk AS (SELECT *, row_number() OVER (ORDER BY md5('tessera:' || key), key) AS rnk FROM base),
     m AS (SELECT z.n, count(*) AS k, sum(CAST(t AS DOUBLE)) AS s, sum(CAST(t AS DOUBLE) * t) AS ss FROM rk, z WHERE rnk <= z.n AND (p BETWEEN 100 AND 400 OR p BETWEEN 700 AND 900) GROUP BY z.n),
     e AS (SELECT k / 0.05 AS cnt, s / 0.05 AS sum, sqrt((CAST(k AS DOUBLE) / n - (CAST(k AS DOUBLE) / n) * (CAST(k AS DOUBLE) / n)) / n) * (n / 0.05) AS v_cnt, sqrt((ss / n - (s / n) * (s / n)) / n) * (n / 0.05) AS v_sum FROM m)
SELECT 'u' AS query_id, round(cnt, 4) AS cnt, round(sum, 3) AS sum, round(2.576 * v_cnt, 3) AS ci_cnt, round(2.576 * v_sum, 2) AS ci_sum FROM e"""


@query(_UNION)
def union_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """A uniform estimate of two disjoint boxes together."""
    s = _fit(spark, sf, "orders", ["p"], 16)
    return rounded(s.solve_union({"u": [{"p": (100, 400)}, {"p": (700, 900)}]}, "uniform", 0.05)).select("query_id", "cnt", "sum", "ci_cnt", "ci_sum")


_UNION_STRATA = f"""WITH {leaves_sql(ORD, ["p"], 16)}, z AS (SELECT count(*) AS n_all, CAST(floor(count(*) * 0.05) AS BIGINT) AS take FROM base),
     al AS (SELECT leaf, n AS big_n, take * n // n_all AS n FROM node, z),
     rk AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY md5('tessera:' || key), key) AS rnk FROM l),
     m AS (SELECT al.leaf, any_value(big_n) AS big_n, CAST(any_value(al.n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum(CAST(t AS DOUBLE)) AS s, sum(CAST(t AS DOUBLE) * t) AS ss FROM rk JOIN al ON al.leaf = rk.leaf AND rnk <= al.n
           WHERE p BETWEEN 100 AND 400 OR p BETWEEN 700 AND 900 GROUP BY al.leaf),
     e AS (SELECT sum(big_n * k / n) AS cnt, sum(big_n * s / n) AS sum, sum((k / n - (k / n) * (k / n)) * big_n * CAST(big_n AS DOUBLE) / n) AS v_cnt, sum((ss / n - (s / n) * (s / n)) * big_n * CAST(big_n AS DOUBLE) / n) AS v_sum FROM m)
SELECT 'u' AS query_id, round(coalesce(cnt, 0), 4) AS cnt, round(coalesce(sum, 0), 3) AS sum, round(2.576 * sqrt(greatest(coalesce(v_cnt, 0), 0)), 3) AS ci_cnt, round(2.576 * sqrt(greatest(coalesce(v_sum, 0), 0)), 2) AS ci_sum FROM e"""


@query(_UNION_STRATA)
def union_estimate_stratified(spark: SparkSession, sf: str) -> DataFrame:
    s = _fit(spark, sf, "orders", ["p"], 16)
    return rounded(s.solve_union({"u": [{"p": (100, 400)}, {"p": (700, 900)}]}, "stratified", 0.05)).select("query_id", "cnt", "sum", "ci_cnt", "ci_sum")


# workloads

_WORK = """WITH base AS ({base}), src AS (SELECT * FROM base {where}), rk AS (SELECT p, row_number() OVER (ORDER BY md5('{seed}:' || key), key) AS r FROM src),
     q AS (SELECT 'q' || lpad(CAST((a.r - 1) // 2 AS VARCHAR), 5, '0') AS query_id, least(a.p, b.p) AS lo_p, greatest(a.p, b.p) AS hi_p FROM rk a JOIN rk b ON b.r = a.r + 1 WHERE a.r % 2 = 1 AND b.r <= 32 * {n} AND a.p <> b.p)
SELECT q.query_id, lo_p, hi_p, count(*) AS cnt, CAST(sum(t) AS BIGINT) AS sum, round(avg(t), 5) AS avg, min(t) AS min, max(t) AS max FROM q JOIN base ON base.p BETWEEN lo_p AND hi_p GROUP BY ALL HAVING count(*) >= 20 ORDER BY query_id LIMIT {n}"""


@query(_WORK.format(base=EVT, where="", seed="w1", n=40))
def random_workload(spark: SparkSession, sf: str) -> DataFrame:
    return workload.random_workload(axes.events(spark, sf), "key", ["p"], "t", 40, "w1").withColumn("avg", F.round("avg", 5))


@query(_WORK.format(base=EVT, where="WHERE p BETWEEN 120000 AND 130000", seed="w2", n=40))
def challenging_workload(spark: SparkSession, sf: str) -> DataFrame:
    return workload.window_workload(axes.events(spark, sf), "key", ["p"], "t", 40, "w2", 120000, 130000).withColumn("avg", F.round("avg", 5))


@query("WITH v AS (SELECT d AS p, count(*) AS n, sum(t) AS s FROM (" + EVT + ") GROUP BY d), r AS (SELECT p, n, s, sum(n) OVER (ORDER BY p) AS cn, sum(s) OVER (ORDER BY p) AS cs FROM v) SELECT a.p AS lo, b.p AS hi, CAST(b.cn - a.cn + a.n AS BIGINT) AS cnt, CAST(b.cs - a.cs + a.s AS BIGINT) AS sum FROM r a JOIN r b ON b.p >= a.p + 2 WHERE b.cn - a.cn + a.n >= 5")
def every_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Of the dates of all events."""
    return workload.every_interval(axes.events(spark, sf), "d", "t")


@query("""WITH d AS (SELECT i, md5('rp:' || i) AS h FROM range(0, 50) r(i)), n AS (SELECT i, CAST(('0x' || substr(h, 1, 12)) AS BIGINT) % 1000 AS a, CAST(('0x' || substr(h, 13, 12)) AS BIGINT) % 999 AS b FROM d),
     m AS (SELECT i, a, CASE WHEN b >= a THEN b + 1 ELSE b END AS b FROM n) SELECT 'q' || lpad(CAST(i AS VARCHAR), 5, '0') AS query_id, least(a, b) + 1 AS lo, greatest(a, b) + 1 AS hi FROM m""")
def random_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return workload.random_predicates(spark, 50, 1, 1000, "rp")


@query(_truth_sql(ORD, {"special": {"p": (6597, 6619)}}))
def special_query(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(exact.batch_aggregate(axes.orders(spark, sf), workload.special_query(), "t"))


@query("SELECT query_id, CAST(sum(t) AS BIGINT) AS sum FROM (" + ORD + ") JOIN (VALUES ('a', 100, 900), ('b', 37, 61)) v(query_id, lo, hi) ON p BETWEEN lo AND hi GROUP BY query_id")
def workload_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The answers through the workload's SQL texts."""
    found = workload.exact_by_sql(axes.orders(spark, sf), {q: ORDER_BOXES[q] for q in ("a", "b")}, "t")
    return spark.createDataFrame(sorted(found.items()), "query_id string, sum long")


@query("SELECT query_id, id, CAST(('0x' || substr(id, 1, 6)) AS BIGINT) AS seed FROM (SELECT query_id, substr(sha1('p[' || lo || ', ' || hi || ']'), 1, 10) AS id FROM (VALUES ('a', 100, 900), ('b', 37, 61)) v(query_id, lo, hi))")
def query_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = {q: query_id(ORDER_BOXES[q]) for q in ("a", "b")}
    return spark.createDataFrame([(q, i, seed_of(i)) for q, i in ids.items()], "query_id string, id string, seed long")


# boxes


@query("SELECT * FROM (VALUES (0, 9, 0, 1), (0, 9, 6, 9), (0, 2, 2, 5), (6, 9, 2, 5)) v(lo_a, hi_a, lo_b, hi_b)")
def box_difference(spark: SparkSession, sf: str) -> DataFrame:
    parts = iv.difference({"a": (0, 9), "b": (0, 9)}, {"a": (3, 5), "b": (2, 5)})
    return spark.createDataFrame([(*b["a"], *b["b"]) for b in parts], "lo_a int, hi_a int, lo_b int, hi_b int")


@query(f"""WITH {leaves_sql(ORD, ["p"], 16)}, q AS (SELECT * FROM {values_sql(ORDER_BOXES, ["p"])})
SELECT query_id, coalesce(min(lo_p), any_value(qlo_p)) AS lo, coalesce(max(hi_p), any_value(qhi_p)) AS hi FROM q LEFT JOIN node ON lo_p <= qhi_p AND hi_p >= qlo_p GROUP BY query_id""")
def covering_box(spark: SparkSession, sf: str) -> DataFrame:
    s = _fit(spark, sf, "orders", ["p"], 16)
    boxes = [x.box for x in s.root.leaves()]
    return spark.createDataFrame([(q, *(int(x) for x in iv.covering_box(b, boxes)["p"])) for q, b in ORDER_BOXES.items()], "query_id string, lo long, hi long")
