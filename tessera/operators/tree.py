"""Trees of precomputed aggregates: one pass over the rows for the leaves, parents by merging."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.intervals import COVERED, DISJOINT, Box, hull, relation


@dataclass
class Node:
    """Tight box, row count, and (sum, min, max) of each target."""

    node_id: int
    box: Box
    cnt: int
    aggs: dict[str, tuple[float, float, float]]
    depth: int = 0
    parent_id: int | None = None
    children: list[Node] = field(default_factory=list)
    leaf: int | None = None
    variance: dict[str, float] = field(default_factory=dict)  # of each target, for leaves

    def walk(self) -> list[Node]:
        return [self, *(x for c in self.children for x in c.walk())]

    def leaves(self) -> list[Node]:
        return [x for x in self.walk() if not x.children]


def leaf_aggregates(df: DataFrame, leaf: str, dims: list[str], targets: list[str], variance: bool = False) -> DataFrame:
    """One row a leaf: cnt, lo/hi of each dimension, sum/min/max/avg (and var) of each target; one pass."""
    aggs = [F.count("*").alias("cnt")]
    aggs += [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    aggs += [f(t).alias(f"{n}_{t}") for t in targets for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max), ("avg", F.avg))]
    aggs += [F.var_samp(t).alias(f"var_{t}") for t in targets if variance]
    return df.groupBy(leaf).agg(*aggs)


def merge_up(leaves: DataFrame, parent: Column, dims: list[str], targets: list[str]) -> DataFrame:
    """Aggregates of parents from those of their children; no row is read again."""
    aggs = [F.sum("cnt").alias("cnt")]
    aggs += [f(f"{n}_{d}").alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
    aggs += [f(f"{n}_{t}").alias(f"{n}_{t}") for t in targets for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))]
    out = leaves.groupBy(parent.alias("node")).agg(*aggs)
    return out.withColumns({f"avg_{t}": F.col(f"sum_{t}") / F.col("cnt") for t in targets})


def collect_leaves(df: DataFrame, leaf: str, dims: list[str], targets: list[str], most: int = 200_000) -> list[Node]:
    """The leaves on the driver, which plans on them. More than ``most`` are an error, and are not collected."""
    rows = leaf_aggregates(df, leaf, dims, targets, True).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} leaves: a coarser partition is needed")
    rows.sort(key=lambda r: (r[leaf] is not None, r[leaf]))
    return [
        Node(
            i, {d: (r[f"lo_{d}"], r[f"hi_{d}"]) for d in dims}, r["cnt"], {t: (r[f"sum_{t}"] or 0, r[f"min_{t}"], r[f"max_{t}"]) for t in targets},
            leaf=r[leaf], variance={t: float(r[f"var_{t}"] or 0.0) for t in targets},
        )
        for i, r in enumerate(rows)
        if all(r[f"lo_{d}"] is not None for d in dims)
    ]


def merged(parts: list[Node]) -> Node:
    least = lambda f, xs: f((x for x in xs if x is not None), default=None)
    aggs = {t: (sum(p.aggs[t][0] for p in parts), least(min, [p.aggs[t][1] for p in parts]), least(max, [p.aggs[t][2] for p in parts])) for t in parts[0].aggs}
    return Node(-1, hull([p.box for p in parts]), sum(p.cnt for p in parts), aggs, children=parts)


def numbered(root: Node) -> Node:
    """Ids in breadth-first order, parents and depths set."""
    level, n = [root], 0
    root.depth, root.parent_id = 0, None
    while level:
        for x in level:
            x.node_id = n
            n += 1
        for x in level:
            for c in x.children:
                c.parent_id, c.depth = x.node_id, x.depth + 1
        level = [c for x in level for c in x.children]
    return root


def pairwise_tree(leaves: list[Node], fan_out: int = 2) -> Node | None:
    """Neighbours become parents, level by level; an odd last node goes up as it is."""
    level = list(leaves)
    while len(level) > 1:
        level = [merged(level[i : i + fan_out]) if len(level[i : i + fan_out]) > 1 else level[i] for i in range(0, len(level), fan_out)]
    return numbered(level[0]) if level else None


def grid_tree(leaves: list[Node], dims: int, cells: int, fan_out: int = 2) -> Node | None:
    """The complete grid tree over leaves numbered row by row on a grid of ``cells`` a dimension:
    a parent holds fan_out ** dims children."""
    level = {}
    for x in leaves:
        number, at = x.leaf, []
        for _ in range(dims):
            number, c = divmod(number, cells)
            at.append(c)
        level[tuple(reversed(at))] = x
    while len(level) > 1:
        up: dict[tuple, list[Node]] = {}
        for at in sorted(level):
            up.setdefault(tuple(c // fan_out for c in at), []).append(level[at])
        level = {at: merged(xs) if len(xs) > 1 else xs[0] for at, xs in up.items()}
    return numbered(next(iter(level.values()))) if level else None


def split_tree(root, leaves: list[Node]) -> Node | None:
    """The tree of a median split (``partition.Split``) over the aggregates of its leaves."""
    by = {x.leaf: x for x in leaves}

    def build(s) -> Node | None:
        if not s.children:
            return by.get(s.number)
        parts = [x for x in map(build, s.children.values()) if x]
        return merged(parts) if len(parts) > 1 else (parts[0] if parts else None)

    out = build(root)
    return numbered(out) if out else None


# verification and reports


def verify_layers(root: Node, tolerance: float = 1e-9) -> bool:
    """Each complete layer, its shallower leaves included, sums to the root."""
    layer = [root]
    while layer:
        for t, (total, _, _) in root.aggs.items():
            if sum(x.cnt for x in layer) != root.cnt or not math.isclose(sum(x.aggs[t][0] for x in layer), total, rel_tol=tolerance, abs_tol=tolerance):
                return False
        below = [c for x in layer for c in (x.children or [x])]
        if len(below) == len(layer) and all(a is b for a, b in zip(below, layer, strict=True)):
            return True
        layer = below
    return True


def verify_leaves(root: Node, rows: int, tolerance: float = 1e-9) -> bool:
    """The leaves hold every row of the table, and sum to the root."""
    leaves = root.leaves()
    return sum(x.cnt for x in leaves) == rows == root.cnt and all(math.isclose(sum(x.aggs[t][0] for x in leaves), a[0], rel_tol=tolerance, abs_tol=tolerance) for t, a in root.aggs.items())


def summary(root: Node) -> dict[str, float]:
    leaves = root.leaves()
    depths = [x.depth for x in leaves]
    return {"nodes": len(root.walk()), "leaves": len(leaves), "min_depth": min(depths), "max_depth": max(depths), "largest_leaf": max(x.cnt for x in leaves), "max_variance": max((v for x in leaves for v in x.variance.values()), default=0.0)}


def dump(root: Node) -> str:
    """One line a node, indented by depth."""
    lines = []
    for x in root.walk():
        box = ", ".join(f"{d} [{lo}, {hi}]" for d, (lo, hi) in x.box.items())
        lines.append(f"{'  ' * x.depth}#{x.node_id} n={x.cnt} {box}")
    return "\n".join(lines)


# persistence

NODE_SCHEMA = "node_id int, parent_id int, depth int, is_leaf boolean, leaf int, cnt long, box map<string,struct<lo:double,hi:double>>, aggs map<string,struct<sum:double,min:double,max:double>>, variance map<string,double>"


def node_table(spark: SparkSession, root: Node) -> DataFrame:
    rows = []
    for x in root.walk():
        box = {d: (float(lo), float(hi)) for d, (lo, hi) in x.box.items()}
        aggs = {t: tuple(None if v is None else float(v) for v in a) for t, a in x.aggs.items()}
        rows.append((x.node_id, x.parent_id, x.depth, not x.children, x.leaf, x.cnt, box, aggs, x.variance))
    return spark.createDataFrame(rows, NODE_SCHEMA)


def save(spark: SparkSession, root: Node, path: str) -> None:
    node_table(spark, root).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Node:
    by = {}
    for r in spark.read.parquet(path).orderBy("depth", "node_id").collect():
        by[r["node_id"]] = Node(r["node_id"], {d: (v["lo"], v["hi"]) for d, v in r["box"].items()}, r["cnt"], {t: (v["sum"], v["min"], v["max"]) for t, v in r["aggs"].items()}, r["depth"], r["parent_id"], leaf=r["leaf"], variance=dict(r["variance"] or {}))
        if r["parent_id"] is not None:
            by[r["parent_id"]].children.append(by[r["node_id"]])
    return next(x for x in by.values() if x.parent_id is None)


# traversal


def frontier(root: Node, query: Box, budget: int = 10_000_000, strict: bool = True) -> list[Node]:
    """Best-first expansion: the node that most of the query is about first, while the budget of nodes
    lasts. What remains: covered nodes, and nodes that the query cuts (leaves, or not expanded)."""
    heap: list[tuple[int, int, Node]] = []
    out: list[Node] = []
    order = 0

    def offer(x: Node) -> None:
        nonlocal order
        how = relate(query, x, strict)
        if how == DISJOINT:
            return
        if how == COVERED or not x.children:
            out.append(x)
        else:
            order += 1
            heapq.heappush(heap, (-how, order, x))

    offer(root)
    left = budget - 1
    while heap:
        _, _, x = heapq.heappop(heap)
        if left > len(x.children):
            left -= len(x.children)
            for c in x.children:
                offer(c)
        else:
            out.append(x)
    return out


def relate(query: Box, node: Node, strict: bool = True) -> int:
    """Without ``strict``, a dimension that the query doesn't have is unbounded in it."""
    if not strict and query.keys() < node.box.keys():
        query = dict(query) | {d: node.box[d] for d in node.box.keys() - query.keys()}
    return relation(query, node.box)
