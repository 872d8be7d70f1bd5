"""The approximate query planner: a synopsis of a table, and the methods that answer from it.

A synopsis is a tree of exact aggregates (on the driver, a few thousand nodes) and an assignment of
rows to its leaves (a Column). A batch of queries is planned on the driver: what covered nodes hold is
added up exactly, and the sample budget goes to the leaves that a query cuts. One Spark job then
reads the ranked samples of those leaves for all queries of the batch. Leaves that no query cuts
are not read.

Methods: ``uniform``, ``stratified`` (over all leaves), ``hybrid`` (exact nodes, stratified sample of the
cut leaves), ``hybrid_uniform`` (exact leaves, uniform sample of the rest), ``bounds`` and
``leaf_bounds`` (aggregates only).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.intervals import COVERED, Box
from tessera.functions.moments import Z, half_width, padded_variance, query_id, seed_of
from tessera.operators import partition, tree
from tessera.operators.sampling import priority_limit, proportional, ranked

RESULT = ("cnt", "sum", "avg", "ci_cnt", "ci_sum", "ci_avg", "min", "max", "delta_leaf_frac", "delta_row_frac")


@dataclass
class Plan:
    """What a query needs: exact totals, value bounds, and the cut leaves."""

    box: Box
    cnt: int = 0
    sum: float = 0
    least: float | None = None
    most: float | None = None
    covered: bool = False
    cut: list[tree.Node] = field(default_factory=list)


@dataclass
class Synopsis:
    df: DataFrame | None  # None: a stored synopsis, which answers from its samples
    key: str
    dims: list[str]
    target: str
    leaf: Column
    root: tree.Node
    seed: str = "tessera"
    strict: bool = True
    stored: str | None = None  # where ranked samples of the leaves are kept
    kept: dict[int, int] = field(default_factory=dict)  # ranks kept there, by leaf
    spec: dict | None = None  # of the assignment

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession if self.df is not None else SparkSession.active()

    @property
    def table(self) -> DataFrame:
        if self.df is None:
            raise ValueError("this needs the table, or more ranks than the synopsis stores")
        return self.df

    @property
    def rows(self) -> int:
        return self.root.cnt

    # building

    @classmethod
    def fit(cls, df: DataFrame, key: str, dims: list[str], target: str, leaves: int = 64, how: str = "depth", rate: float = 0.005, seed: str = "tessera", strict: bool = True) -> Synopsis:
        """how: width, depth, minimax, minimax_sampled, minimax_fast, climb (one dimension); grid,
        median_error, median_breadth, median_variance (any number)."""
        df = df.na.drop("any", subset=[key, *dims, target])
        split = None
        if how == "width" or how == "grid":
            spec = partition.width_spec(df, dims, leaves)
        elif how.startswith("median_"):
            n, points = df.count(), max(10_000, partition.LEAF_POINTS * leaves)
            sample = ranked(df, key, seed, F.lit(points), total=n, wanted=points).select(*dims, target).toPandas().astype(float)
            split = partition.median_tree(sample[dims].to_numpy(), sample[target].to_numpy(), leaves, how.removeprefix("median_"), scale=max(1.0, n / max(1, len(sample))))
            if len(sample) < n:
                split = partition.exact_medians(df, dims, split)
            spec = {"kind": "tree", "dims": dims, "root": split.spec()}
        else:
            points = partition.sample_points(df, key, dims[0], target, rate, seed)
            spec = {"kind": "cuts", "dim": dims[0], "starts": partition.choose_cuts(points, leaves, how) if points.rows else [0]}
        leaf = partition.assignment(spec)
        found = tree.collect_leaves(df.withColumn("__leaf", leaf), "__leaf", dims, [target])
        if split is not None:
            root = tree.split_tree(split, found)
        elif how == "grid":
            root = tree.grid_tree(found, len(dims), leaves + 1)
        else:
            root = tree.pairwise_tree(found)
        if root is None:
            raise ValueError("no row without a null: nothing to summarise")
        return cls(df, key, dims, target, leaf, root, seed, strict, spec=spec)

    def store(self, path: str, rate: float) -> Synopsis:
        """Write each leaf's first rows by rank (as many as any query at ``rate`` can ask of it), a folder
        a leaf. Queries then read the folders of the leaves that they cut, and not the table."""
        budget = int(self.rows * rate)
        self.kept = {int(x.leaf): min(x.cnt, budget) for x in self.root.leaves()}
        sizes = {int(x.leaf): x.cnt for x in self.root.leaves()}
        wanted = self.spark.createDataFrame([(i, n, sizes[i]) for i, n in sorted(self.kept.items())], "__leaf int, most long, size long")
        columns = dict.fromkeys([self.key, *self.dims, self.target])
        rows = ranked(self.table.select(*columns, self.leaf.alias("__leaf")), self.key, self.seed, wanted, "__leaf")
        rows.repartition("__leaf", F.floor(F.col("rnk") / 1_000_000)).write.mode("overwrite").partitionBy("__leaf").parquet(path)
        self.stored = path
        return self

    def save(self, path: str, rate: float | None = None) -> Synopsis:
        """All of the synopsis in one folder: nodes, assignment, settings and, with a rate, the ranked samples."""
        if self.spec is None:
            raise ValueError("only a fitted synopsis can be saved")
        if rate is not None:
            self.store(f"{path}/strata", rate)
        tree.save(self.spark, self.root, f"{path}/nodes")
        meta = {"key": self.key, "dims": self.dims, "target": self.target, "seed": self.seed, "strict": self.strict, "spec": self.spec, "kept": sorted(self.kept.items()), "stored": "strata" if rate is not None else self.stored}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str, df: DataFrame | None = None) -> Synopsis:
        """A saved synopsis in any session. With the table, it also answers what its samples don't hold."""
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        stored = f"{path}/strata" if meta["stored"] == "strata" else meta["stored"]
        if df is not None:
            df = df.na.drop("any", subset=[meta["key"], *meta["dims"], meta["target"]])
        return cls(df, meta["key"], meta["dims"], meta["target"], partition.assignment(meta["spec"]), tree.load(spark, f"{path}/nodes"), meta["seed"], meta["strict"], stored, dict(meta["kept"]), meta["spec"])

    def check(self) -> bool:
        """The tree agrees with itself and with the table."""
        return tree.verify_layers(self.root) and tree.verify_leaves(self.root, self.table.count())

    # planning

    def plan(self, box: Box, leaves_only: bool = False, budget: int = 10_000_000) -> Plan:
        nodes = self.root.leaves() if leaves_only else tree.frontier(self.root, box, budget, self.strict)
        out = Plan(box)
        for x in nodes:
            how = tree.relate(box, x, self.strict)
            if how < COVERED:
                continue
            s, lo, hi = x.aggs[self.target]
            out.least = lo if out.least is None else min(out.least, lo)
            out.most = hi if out.most is None else max(out.most, hi)
            if how == COVERED:
                out.covered = True
                out.cnt, out.sum = out.cnt + x.cnt, out.sum + s
            elif not x.children:
                out.cut.append(x)
            else:  # the budget ended here: its leaves, covered or not, are sampled
                out.cut += [y for y in x.leaves() if tree.relate(box, y, self.strict) >= COVERED]
        return out

    # answering

    def solve(self, queries: dict[str, Box], method: str = "hybrid", rate: float = 0.005, budget: int = 10_000_000, z: float = Z, own_seeds: bool = False) -> DataFrame:
        """query_id and the ten numbers of ``RESULT`` of each query. The queries of a batch share a sample; with
        ``own_seeds`` (hybrid, stratified) each has one by its own seed, so that their errors are independent."""
        if method == "uniform":
            plans = {q: Plan(b) for q, b in queries.items()}
            return self._combine(plans, self._uniform(queries, None, rate), rate, z, sampled_bounds=True)
        if method == "stratified":
            every = [(x.leaf, x.cnt) for x in self.root.leaves()]
            n = proportional(every, int(self.rows * rate))
            plans = {q: Plan(b, cut=self.root.leaves()) for q, b in queries.items()}
            return self._combine(plans, self._strata(plans, dict.fromkeys(queries, n), own_seeds), None, z, sampled_bounds=True)
        plans = {q: self.plan(b, method == "hybrid_uniform", budget) for q, b in queries.items()}
        if method == "hybrid":
            n = {}
            for q, p in plans.items():
                held = sum(x.cnt for x in p.cut)
                n[q] = proportional([(x.leaf, x.cnt) for x in p.cut], min(int(self.rows * rate), held))
            return self._combine(plans, self._strata(plans, n, own_seeds), None, z)
        if method == "hybrid_uniform":
            return self._combine(plans, self._uniform(queries, {q: [x.leaf for x in p.cut] for q, p in plans.items()}, rate), rate, z)
        raise ValueError(f"no method {method}")

    def solve_union(self, unions: dict[str, list[Box]], method: str = "uniform", rate: float = 0.005, z: float = Z) -> DataFrame:
        """One estimate per list of boxes: of all their rows together (a row counts once per box that
        holds it). ``uniform``, or ``stratified`` over all leaves."""
        parts = {f"{q}#{i}": b for q, boxes in unions.items() for i, b in enumerate(boxes)}
        leaves = self.root.leaves()
        if method == "uniform":
            found = self._uniform(parts, None, rate).withColumn("__leaf", F.lit(0))
        elif method == "stratified":
            n = proportional([(x.leaf, x.cnt) for x in leaves], int(self.rows * rate))
            found = self._strata({q: Plan(b, cut=leaves) for q, b in parts.items()}, dict.fromkeys(parts, n))
        else:
            raise ValueError(f"no method {method} for unions")
        whole = F.regexp_replace("query_id", "#[0-9]+$", "")
        added = found.groupBy(whole.alias("query_id"), "__leaf").agg(F.first("big_n").alias("big_n"), F.first("n").alias("n"), *[F.sum(c).alias(c) for c in ("k", "s", "ss")], F.min("least").alias("least"), F.max("most").alias("most"))
        return self._combine({q: Plan({}) for q in unions}, added, rate if method == "uniform" else None, z, sampled_bounds=True)

    def bounds(self, queries: dict[str, Box], leaves_only: bool = False, budget: int = 10_000_000) -> DataFrame:
        """query_id, cnt, sum: totals over every node that the query meets; upper bounds for targets
        that are nowhere negative."""
        rows = []
        for q, box in sorted(queries.items()):
            nodes = [x for x in (self.root.leaves() if leaves_only else tree.frontier(self.root, box, budget, self.strict)) if tree.relate(box, x, self.strict) >= COVERED]
            rows.append((q, sum(x.cnt for x in nodes), float(sum(x.aggs[self.target][0] for x in nodes))))
        return self.spark.createDataFrame(rows, "query_id string, cnt long, sum double")

    def _asked(self, rows: list[tuple], columns: str) -> DataFrame:
        dims = "".join(f", lo_{i} double, hi_{i} double" for i in range(len(self._dims_of)))
        return F.broadcast(self.spark.createDataFrame(rows, columns + dims))  # bounded by queries x leaves

    def _limits(self, box: Box) -> tuple:
        return tuple(None if d not in box else float(x) for d in self._dims_of for x in box.get(d, (0, 0)))

    def _inside(self) -> Column:
        out = F.lit(True)
        for i, d in enumerate(self._dims_of):
            out = out & (F.col(f"lo_{i}").isNull() | F.col(d).between(F.col(f"lo_{i}"), F.col(f"hi_{i}")))
        return out

    def _set_dims(self, boxes: list[Box]) -> None:
        self._dims_of = sorted({d for b in boxes for d in b})

    def _strata(self, plans: dict[str, Plan], n: dict[str, dict[int, int]], own_seeds: bool = False) -> DataFrame:
        """Per query and leaf: N, n, matching rows k, their sum and sum of squares, min and max."""
        spark = self.spark
        self._set_dims([p.box for p in plans.values()])
        rows = [(q, x.leaf, x.cnt, n[q].get(x.leaf, 0), *self._limits(p.box)) for q, p in sorted(plans.items()) for x in p.cut if n[q].get(x.leaf, 0) > 0]
        if own_seeds:
            return self._own_strata(rows, plans)
        most: dict[int, int] = {}
        for r in rows:
            most[r[1]] = max(most.get(r[1], 0), r[3])
        asked = self._asked(rows, "query_id string, __leaf int, big_n long, n long")
        cut = F.col("__leaf").isin([int(x) for x in most]) if most else F.lit(False)
        if self.stored and set(self._dims_of) <= set(self.dims) and all(n <= self.kept.get(int(x), -1) for x, n in most.items()):
            sample = spark.read.parquet(self.stored).where(cut).where(F.col("rnk") <= max(most.values(), default=0))
        else:
            sizes = {x.leaf: x.cnt for p in plans.values() for x in p.cut}
            wanted = spark.createDataFrame([(i, m, sizes[i]) for i, m in sorted(most.items())], "__leaf int, most long, size long")
            data = self.table.select(self.key, *dict.fromkeys([*self._dims_of, self.target]), self.leaf.alias("__leaf")).where(cut)
            sample = ranked(data, self.key, self.seed, wanted, "__leaf")
        hit = sample.join(asked, "__leaf").where((F.col("rnk") <= F.col("n")) & self._inside())
        return self._sums(hit)

    def _own_strata(self, rows: list[tuple], plans: dict[str, Plan]) -> DataFrame:
        """The same, a row's priority depending on the query: rows meet the queries that cut their leaf."""
        seeds = {q: str(seed_of(query_id(p.box))) for q, p in plans.items()}
        limited = [(*r[:4], seeds[r[0]], priority_limit(r[3], r[2]), *r[4:]) for r in rows]
        asked = self._asked(limited, "query_id string, __leaf int, big_n long, n long, seed string, limit string")
        data = self.table.select(self.key, *dict.fromkeys([*self._dims_of, self.target]), self.leaf.alias("__leaf"))
        drawn = data.join(asked, "__leaf").withColumn("__u", F.md5(F.concat("seed", F.lit(":"), F.col(self.key).cast("string"))))
        drawn = drawn.where(F.col("limit").isNull() | (F.col("__u") < F.col("limit")))
        at = F.row_number().over(Window.partitionBy("query_id", "__leaf").orderBy("__u", self.key))
        return self._sums(drawn.withColumn("rnk", at).where((F.col("rnk") <= F.col("n")) & self._inside()))

    def _sums(self, hit: DataFrame) -> DataFrame:
        t = F.col(self.target).cast("double")
        return hit.groupBy("query_id", "__leaf").agg(F.first("big_n").alias("big_n"), F.first("n").alias("n"), F.count("*").alias("k"), F.sum(t).alias("s"), F.sum(t * t).alias("ss"), F.min(t).alias("least"), F.max(t).alias("most"))

    def _uniform(self, queries: dict[str, Box], leaves: dict[str, list[int]] | None, rate: float) -> DataFrame:
        """Per query (one stratum): the whole sample's n, matching k, s, ss, min and max."""
        self._set_dims(list(queries.values()))
        size = int(self.rows * rate + 0.5)
        data = self.table.select(self.key, *dict.fromkeys([*self._dims_of, self.target]), self.leaf.alias("__leaf"))
        sample = ranked(data, self.key, self.seed, F.lit(size), total=self.rows, wanted=size)
        t = F.col(self.target).cast("double")
        if leaves is None:
            joined = sample.join(self._asked([(q, *self._limits(b)) for q, b in sorted(queries.items())], "query_id string"), self._inside())
        else:
            asked = self._asked([(q, x, *self._limits(queries[q])) for q, xs in sorted(leaves.items()) for x in xs], "query_id string, __leaf int")
            joined = sample.join(asked, "__leaf").where(self._inside())
        out = joined.groupBy("query_id").agg(F.count("*").alias("k"), F.sum(t).alias("s"), F.sum(t * t).alias("ss"), F.min(t).alias("least"), F.max(t).alias("most"))
        return out.withColumns({"big_n": F.lit(size / rate if rate else 0.0), "n": F.lit(size)})

    def _combine(self, plans: dict[str, Plan], parts: DataFrame, rate: float | None, z: float, sampled_bounds: bool = False) -> DataFrame:
        """Exact totals and the estimate of the cut leaves."""
        leaves, spark = len(self.root.leaves()), self.spark
        fixed = [
            (q, int(p.cnt), float(p.sum), None if sampled_bounds or p.least is None else float(p.least), None if sampled_bounds or p.most is None else float(p.most), len(p.cut) / leaves, sum(x.cnt for x in p.cut) / self.rows if self.rows else 0.0)
            for q, p in sorted(plans.items())
        ]
        exact = spark.createDataFrame(fixed, "query_id string, e_cnt long, e_sum double, b_min double, b_max double, delta_leaf_frac double, delta_row_frac double")
        n, big, k, s, ss = (F.col(c) for c in ("n", "big_n", "k", "s", "ss"))
        scale2 = big * big / n
        estimate = parts.groupBy("query_id").agg(
            F.sum(big * k / n).alias("d_cnt"),
            F.sum(big * s / n).alias("d_sum"),
            F.sum(padded_variance(k, k, n) * scale2).alias("v_cnt"),
            F.sum(padded_variance(s, ss, n) * scale2).alias("v_sum"),
            F.min("least").alias("s_min"),
            F.max("most").alias("s_max"),
            # over one uniform sample, the mean's variance is taken at the matching share
            F.sum(k).alias("k_all"), F.max(n).alias("n_all"), F.sum(s).alias("s_all"), F.sum(ss).alias("ss_all"),
        )
        d = {c: F.coalesce(c, F.lit(0.0)) for c in ("d_cnt", "d_sum", "v_cnt", "v_sum")}
        cnt, total = F.col("e_cnt") + d["d_cnt"], F.col("e_sum") + d["d_sum"]
        if rate is None:
            v_avg = F.when(d["d_cnt"] > 0, d["v_sum"] / (d["d_cnt"] * d["d_cnt"])).otherwise(0.0)
        else:
            share = F.col("n_all") / F.col("k_all")
            v_avg = F.coalesce(F.when(F.col("k_all") > 0, share * share * padded_variance(F.col("s_all"), F.col("ss_all"), F.col("n_all")) / F.col("n_all")), F.lit(0.0))
        out = exact.join(estimate, "query_id", "left")
        return out.select(
            "query_id",
            cnt.alias("cnt"),
            total.alias("sum"),
            F.when(cnt > 0, total / cnt).otherwise(0.0).alias("avg"),
            half_width(d["v_cnt"], z).alias("ci_cnt"),
            half_width(d["v_sum"], z).alias("ci_sum"),
            half_width(v_avg, z).alias("ci_avg"),
            F.coalesce("b_min", "s_min").alias("min") if sampled_bounds else F.col("b_min").alias("min"),
            F.coalesce("b_max", "s_max").alias("max") if sampled_bounds else F.col("b_max").alias("max"),
            *([F.lit(None).cast("double").alias("delta_leaf_frac"), F.lit(None).cast("double").alias("delta_row_frac")] if sampled_bounds else ["delta_leaf_frac", "delta_row_frac"]),
        )
