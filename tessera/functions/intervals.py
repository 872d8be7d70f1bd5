"""Closed boxes over named dimensions: Python values for planning, Columns for row filters.

A box is ``{dimension: (low, high)}``. Two boxes intersect if they do on every dimension that both
have (touching counts); one covers another only if both have the same dimensions.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = dict[str, tuple[float, float]]

DISJOINT, COVERED, INSIDE, PARTIAL = -2, -1, 1, 2


def intersects(a: Box, b: Box) -> bool:
    return all(max(a[d][0], b[d][0]) <= min(a[d][1], b[d][1]) for d in a.keys() & b.keys())


def covers(a: Box, b: Box) -> bool:
    """``a`` holds all of ``b``; false over different dimensions."""
    return a.keys() == b.keys() and all(a[d][0] <= b[d][0] and b[d][1] <= a[d][1] for d in a)


def relation(query: Box, node: Box) -> int:
    """How far a node has to be expanded for a query."""
    if not intersects(query, node):
        return DISJOINT
    if covers(query, node):
        return COVERED
    return INSIDE if covers(node, query) else PARTIAL


def meet(a: Box, b: Box) -> Box | None:
    """The common box; dimensions of one side only are taken over. None if there's none."""
    if not intersects(a, b):
        return None
    out = dict(a) | dict(b)
    for d in a.keys() & b.keys():
        out[d] = (max(a[d][0], b[d][0]), min(a[d][1], b[d][1]))
    return out


def hull(boxes: list[Box]) -> Box | None:
    """The least box around all of ``boxes``."""
    if not boxes:
        return None
    return {d: (min(b[d][0] for b in boxes), max(b[d][1] for b in boxes)) for d in boxes[0]}


def covering_box(query: Box, nodes: list[Box]) -> Box:
    """The least box around the nodes that meet the query; the query itself if none does."""
    return hull([n for n in nodes if intersects(query, n)]) or query


def difference(outer: Box, inner: Box) -> list[Box]:
    """``outer`` without ``inner`` as disjoint boxes over whole numbers, few by greedy merging."""
    core = meet(outer, inner)
    if core is None:
        return [dict(outer)]
    dims = sorted(outer)
    cells = []
    for d in dims:
        lo, hi = outer[d]
        a, b = core[d]
        cells.append([c for c in ((lo, a - 1), (a, b), (b + 1, hi)) if c[0] <= c[1]])
    inside = tuple(core[d] for d in dims)
    left = {c for c in product(*cells) if c != inside}
    for axis in range(len(dims)):
        rows: dict[tuple, list[tuple]] = {}
        for c in left:
            rows.setdefault(c[:axis] + c[axis + 1 :], []).append(c[axis])
        left = set()
        for rest, spans in rows.items():
            spans.sort()
            run = [spans[0]]
            for s in spans[1:]:
                if s[0] == run[-1][1] + 1:
                    run[-1] = (run[-1][0], s[1])
                else:
                    run.append(s)
            left |= {(*rest[:axis], s, *rest[axis:]) for s in run}
    return [dict(zip(dims, c, strict=True)) for c in sorted(left)]


def inside(box: Box) -> Column:
    """Rows of the box: a conjunction of BETWEENs, which reaches the Parquet scan."""
    return reduce(and_, (F.col(d).between(F.lit(lo), F.lit(hi)) for d, (lo, hi) in sorted(box.items())), F.lit(True))


def constants(values: list) -> Column:
    """An array of numbers (or Columns); numbers go as one text, which is much faster than a literal each."""
    if values and all(type(x) in (int, float) for x in values):
        return F.expr("array(" + ", ".join(f"{x}L" if type(x) is int else f"double('{x}')" for x in values) + ")")
    return F.array(*[x if isinstance(x, Column) else F.lit(x) for x in values])


def to_sql(box: Box, target: str, table: str, agg: str = "SUM") -> str:
    """The query as SQL text."""
    where = " AND ".join(f"{d} >= {lo} AND {d} <= {hi}" for d, (lo, hi) in sorted(box.items()))
    return f"SELECT {agg}({target}) FROM {table}" + (f" WHERE {where}" if where else "")
