"""Assigning rows to leaves: cuts come from the driver (a bounded list), the assignment is a Column."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.intervals import constants
from tessera.operators import buckets
from tessera.operators.sampling import ranked

DRIVER_POINTS = 5_000_000  # of a sample that the driver takes; more is an error, never a smaller sample
LEAF_POINTS = 100  # of a sample that the shape of a median tree is chosen on, by leaf
NESTED = 128  # leaves up to which an assignment is one generated expression


def by_cuts(p: Column, starts: list) -> Column:
    """Number of the interval that holds p, in log2 comparisons a row: a balanced tree of them, or beyond
    ``NESTED`` intervals, whose code would be too long to be compiled, a bisection in a constant array.

    Values below the first start belong to the first interval.
    """
    if len(starts) > NESTED:
        at, steps = constants(starts), [1 << i for i in reversed(range((len(starts) - 1).bit_length()))]
        ahead = lambda lo, step: F.when((lo + step < len(starts)) & (F.get(at, (lo + step).cast("int")) <= p), lo + step).otherwise(lo)
        return F.aggregate(constants(steps), F.lit(0).cast("long"), ahead).cast("int")

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(p < F.lit(starts[mid]), tree(lo, mid)).otherwise(tree(mid, hi))

    return tree(0, len(starts)).cast("int")


def adjacent_intervals(starts: DataFrame, lo: str, last) -> DataFrame:
    """lo, hi of the whole-number intervals that begin at ``lo``: each ends before the next, the last at ``last``."""
    return starts.select(F.col(lo).alias("lo"), F.coalesce(F.lead(lo).over(Window.orderBy(lo)) - 1, F.lit(last)).alias("hi"))


def ranges(df: DataFrame, dims: list[str]) -> dict[str, tuple]:
    row = df.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {d: (row[f"lo_{d}"], row[f"hi_{d}"]) for d in dims}


def equal_width_cell(p: Column, lo: int, hi: int, k: int) -> Column:
    """Cell of a closed whole-number range widened by two below and one above, in ceil-sized steps."""
    step = -(-(hi + 1 - (lo - 2)) // k)
    return F.floor((p - F.lit(lo - 2)) / F.lit(step)).cast("int")


def equal_width(df: DataFrame, dims: list[str], k: int) -> Column:
    """Grid cell of k steps a dimension, as one number. Empty cells simply have no rows."""
    return assignment(width_spec(df, dims, k))


def width_spec(df: DataFrame, dims: list[str], k: int) -> dict:
    return {"kind": "width", "dims": dims, "k": k, "ranges": {d: list(r) for d, r in ranges(df, dims).items()}}


def assignment(spec: dict) -> Column:
    """The leaf of a row, from a description that can be stored: width, cuts, tree, or one leaf for all."""
    if spec["kind"] == "cuts":
        return by_cuts(F.col(spec["dim"]), spec["starts"])
    if spec["kind"] == "tree":
        return by_tree(Split.read(spec["root"]), spec["dims"])
    out = F.lit(0)
    for d in spec["dims"]:
        out = out * F.lit(spec["k"] + 1) + equal_width_cell(F.col(d), *spec["ranges"][d], spec["k"])
    return out.cast("int")


def random_dimension(df: DataFrame, dims: list[str], k: int, seed: int) -> tuple[str, Column]:
    """Equal width along one dimension, chosen by the seed."""
    d = dims[int(np.random.default_rng(seed).integers(len(dims)))]
    return d, equal_width(df, [d], k)


def medians(df: DataFrame, dims: list[str], group: str | None = None, exact: bool = True) -> DataFrame:
    """Whole-number median of each dimension (of each group). Without ``exact``, of a rank that is off by
    1/10,000 of the rows at most, from sketches of bounded size; exact ones hold a group's distinct values."""
    med = (lambda d: F.percentile(d, F.lit(0.5))) if exact else (lambda d: F.percentile_approx(d, 0.5, 10_000))
    aggs = [F.floor(med(d)).cast("long").alias(f"m_{d}") for d in dims]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


def median_split(df: DataFrame, dims: list[str]) -> Column:
    """Child number: bit i is set where dimension i is above its median."""
    row = medians(df, dims).first()
    out = F.lit(0)
    for i, d in enumerate(dims):
        out = out + F.when(F.col(d) > F.lit(row[f"m_{d}"]), 1 << i).otherwise(0)
    return out.cast("int")


@dataclass
class Points:
    """A sorted sample of (x, t), with each one's position in the sorted table of ``rows`` rows."""

    x: np.ndarray
    t: np.ndarray
    pos: np.ndarray
    rows: int


def sample_points(df: DataFrame, key: str, p: str, t: str, rate: float, seed: str = "12345", most: int = DRIVER_POINTS) -> Points:
    """floor(rate * N) rows by priority, with the first and last of the table; one of each predicate value
    (the last by key). Positions come from one counting pass, not from a sort. More than ``most`` points
    are an error: the driver holds them."""
    rows = df.select(F.col(key).alias("k"), F.col(p).alias("p"), F.col(t).alias("t"))
    head = rows.agg(F.count("*").alias("n"), F.min_by(F.struct("k", "p", "t"), F.struct("p", "k")).alias("a"), F.max_by(F.struct("k", "p", "t"), F.struct("p", "k")).alias("z")).first()
    n = int(head["n"])
    if not n:
        return Points(np.empty(0), np.empty(0), np.empty(0, int), 0)
    if int(n * rate) > most:
        raise ValueError(f"{int(n * rate)} points of {n} rows; {most} at most: lower the rate")
    picked = ranked(rows, "k", seed, F.lit(int(n * rate)), total=n, wanted=int(n * rate)).select("k", "p", "t").collect()
    chosen: dict = {}
    for r in sorted([*picked, head["a"], head["z"]], key=lambda r: (r["p"], r["k"])):
        chosen[r["p"]] = r
    x = sorted(chosen)
    tally = _tally(rows.select("p"), np.array(x)).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("same").alias("same")).collect()  # a row a point
    held, same = np.zeros(len(x) + 1, dtype=np.int64), np.ones(len(x), dtype=np.int64)
    for r in tally:
        held[r["cell"] + 1] = r["n"]
        if r["cell"] >= 0:
            same[r["cell"]] = max(1, r["same"])
    # a sample's position is that of the last row of its value
    pos = np.cumsum(held)[:-1] + same - 1
    return Points(np.array(x), np.array([float(chosen[v]["t"]) for v in x]), pos, n)


def _tally(values: DataFrame, x: np.ndarray) -> DataFrame:
    """cell, n, same: rows with x[cell] <= p < x[cell + 1], and of these with p = x[cell]; per task.

    A search in a sorted array, for which there is no built-in function.
    """

    def run(batches):
        n, same = np.zeros(len(x) + 1, dtype=np.int64), np.zeros(len(x) + 1, dtype=np.int64)
        for b in batches:
            p = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            cell = np.searchsorted(x, p, side="right")
            n += np.bincount(cell, minlength=len(n))
            same += np.bincount(cell[(cell > 0) & (x[cell - 1] == p)], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at - 1, pa.int32()), pa.array(n[at]), pa.array(same[at])], names=["cell", "n", "same"])

    return values.mapInArrow(run, "cell int, n long, same long")


def choose_cuts(points: Points, k: int, how: str, share: float = 0.1) -> list:
    """Starts of the intervals. how: depth, minimax, minimax_sampled (looks at ``share`` of the intervals in a
    bucket), minimax_fast, climb. All search all points. Too few points for k buckets are an error."""
    m = len(points.x)
    if how == "depth":
        cuts = buckets.equal_depth(m, max(1, min(k, m)))
    elif how == "climb":
        cuts = buckets.hill_climb(points.t, min(k, m)) if min(k, m) >= 2 else [0]
    else:
        error = buckets.BucketError(points.t, points.pos, share if how == "minimax_sampled" else 1.0)
        cuts = (buckets.minimax_fast if how == "minimax_fast" else buckets.minimax)(error, k)
        if cuts is None:
            raise ValueError(f"{m} points for {k} buckets of {buckets.LEAST} or more: raise the rate")
    return [points.x[c].item() for c in sorted(set(cuts))]


@dataclass
class Split:
    """A node of a median tree: children by bit pattern of (value > median), or a leaf."""

    rows: np.ndarray
    depth: int
    medians: list[float] = field(default_factory=list)
    children: dict[int, Split] = field(default_factory=dict)
    number: int = -1

    def leaves(self) -> list[Split]:
        return [x for c in self.children.values() for x in c.leaves()] if self.children else [self]

    def spec(self) -> list:
        """Medians, children by pattern, number: what ``read`` needs."""
        return [self.medians, {str(k): c.spec() for k, c in self.children.items()}, self.number]

    @classmethod
    def read(cls, spec: list, depth: int = 0) -> Split:
        return cls(np.empty(0, dtype=int), depth, spec[0], {int(k): cls.read(c, depth + 1) for k, c in spec[1].items()}, spec[2])


def median_tree(values: np.ndarray, t: np.ndarray, leaves: int, how: str = "error", max_spread: int = 2, seed: int = 7, scale: float = 1.0) -> Split:
    """A tree over a sample (rows x dimensions), of which each row stands for ``scale`` rows of the table;
    leaves of 10 rows of the table or fewer have no error. how: error (the leaf of the largest error
    next, all dimensions split; the shallowest leaf with most rows whenever depths differ by more
    than ``max_spread``), breadth (the shallowest next), variance (one dimension in turn, the
    leaf of the largest variance next)."""
    root = Split(np.arange(len(t)), 0)
    dims = values.shape[1]

    def urgency(s: Split) -> float:
        if how == "breadth":
            return -s.depth
        if len(s.rows) * scale <= 10 or len(s.rows) < 2:
            return 0.0
        if how == "variance":
            return float(np.var(t[s.rows], ddof=1))
        v = [values[s.rows, d] for d in range(dims)]
        pos = [np.searchsorted(np.sort(values[:, d]), np.sort(x), side="right") - 1 for d, x in enumerate(v)]
        return buckets.dimension_error(v, t[s.rows], pos, 1.0 if len(s.rows) < 60 else 0.1, seed)

    open_, done, force, order = [(0.0, 0, root)], 0, False, 0
    while open_ and len(open_) + done < leaves:
        if force:
            at = min(range(len(open_)), key=lambda i: (open_[i][2].depth, -len(open_[i][2].rows), open_[i][1]))
        else:
            at = max(range(len(open_)), key=lambda i: (open_[i][0], -open_[i][1]))
        _, _, s = open_.pop(at)
        use = [s.depth % dims] if how == "variance" else list(range(dims))
        s.medians = [float(np.floor(np.median(values[s.rows, d]))) if d in use else np.inf for d in range(dims)]
        bits = sum(((values[s.rows, d] > s.medians[d]).astype(int) << d) for d in range(dims))
        parts = {int(b): s.rows[bits == b] for b in np.unique(bits)}
        if len(parts) < 2:  # nothing to split: it stays a leaf
            s.medians = []
            done += 1
        else:
            for b, rows in parts.items():
                order += 1
                child = s.children[b] = Split(rows, s.depth + 1)
                open_.append((urgency(child), order, child))
        depths = [x.depth for _, _, x in open_]
        force = how == "error" and bool(depths) and max(x.depth for x in root.leaves()) - min(depths) > max_spread
    for i, s in enumerate(root.leaves()):
        s.number = i
    return root


def exact_medians(df: DataFrame, dims: list[str], root: Split, exact_rows: int = 10_000_000) -> Split:
    """The tree with the medians of all rows in place of the sample's: a grouped pass per level, top down.

    Exact up to ``exact_rows`` rows, else to 1/10,000 of a node's rows."""
    exact, level = df.limit(exact_rows + 1).count() <= exact_rows, [root]
    while any(s.children for s in level):
        inner = [s for s in level if s.children]
        at = by_tree(root, dims, {id(s): i for i, s in enumerate(inner)})
        found = medians(df.select(*dims, at.alias("__node")).where("__node >= 0"), dims, "__node", exact).collect()  # a row a node
        for r in found:
            inner[r["__node"]].medians = [float(r[f"m_{d}"]) if old != np.inf else np.inf for d, old in zip(dims, inner[r["__node"]].medians, strict=True)]
        level = [c for s in inner for c in s.children.values()]
    return root


def by_tree(root: Split, dims: list[str], nodes: dict[int, int] | None = None) -> Column:
    """Leaf number of a row; or with ``nodes`` (number by id()) that of the node on its way, -1 where there's
    none. A pattern that the sample didn't have goes to the nearest child that it had.

    Nested comparisons, or beyond ``NESTED`` leaves a walk over constant arrays of medians and children.
    """
    every, patterns = [root], 1 << len(dims)
    for s in every:
        every += s.children.values()
    number = {id(s): i for i, s in enumerate(every)}
    end = lambda s: (nodes.get(id(s), -1) if not s.children or id(s) in nodes else None) if nodes is not None else (None if s.children else s.number)
    if sum(not s.children for s in every) <= NESTED:

        def walk(s: Split) -> Column:
            return F.lit(end(s)) if end(s) is not None else choose(s, 0, list(s.children.items()))

        def choose(s: Split, d: int, some: list[tuple[int, Split]]) -> Column:
            if len(some) == 1:
                return walk(some[0][1])
            low, high = [x for x in some if not x[0] >> d & 1], [x for x in some if x[0] >> d & 1]
            if not low or not high:
                return choose(s, d + 1, some)
            return F.when(F.col(dims[d]) > F.lit(s.medians[d]), choose(s, d + 1, high)).otherwise(choose(s, d + 1, low))

        return walk(root).cast("int")

    def nearest(s: Split, pattern: int) -> Split:
        some = list(s.children.items())
        for d in range(len(dims)):
            mine = [x for x in some if (x[0] ^ pattern) >> d & 1 == 0]
            some = mine or some
        return some[0][1]

    stop = [end(s) for s in every]
    child = [number[id(s if e is not None else nearest(s, p))] for s, e in zip(every, stop, strict=True) for p in range(patterns)]
    depth = max(s.depth for s in every)
    held = {f"m{d}": constants([float(s.medians[d]) if s.medians else 0.0 for s in every]) for d in range(len(dims))}
    bits = lambda at: sum((F.when(F.col(d) > F.get(held[f"m{i}"], at.cast("int")), 1 << i).otherwise(0) for i, d in enumerate(dims)), F.lit(0))
    went = F.aggregate(constants(list(range(depth))), F.lit(0).cast("long"), lambda at, _: F.get(constants(child), (at * patterns + bits(at)).cast("int")))
    return F.get(constants([-1 if e is None else e for e in stop]), went.cast("int")).cast("int")
