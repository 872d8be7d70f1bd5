"""Exact top-k inner product search by ball-tree branch and bound.

Vectors become whole numbers floor(scale * x), so that scores are exact. Queries come in blocks of
a bounded size, which are broadcast; each task cuts its rows into shards, builds a ball tree of
each and searches it best-first: nodes are ordered by the bound q.c + |q| r, and a node is dropped
for the queries whose bound is below their kth score so far. That kth score is shared: it starts
from a pilot (the block's queries scored against each other) and goes from shard to shard.

Defined results: null vectors, and vectors with a null or non-finite component, take no part; a
query meets only vectors of its own length; rows with the query's own id are not its candidates;
of repeated ids the best score counts, and the smallest vector asks; ties go to the smaller id;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, tune_arrow

SCHEMA = "query_id long, vec_id long, score long"


class BallTree:
    """Balls over the rows of ``x``; leaves hold at most ``leaf`` rows."""

    def __init__(self, x: np.ndarray, leaf: int = 128):
        self.x, self.nodes = x, []
        self._build(np.arange(len(x)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        at, points = len(self.nodes), self.x[rows]
        center = points.mean(axis=0)
        away = ((points - center) ** 2).sum(axis=1)
        self.nodes.append([center, float(np.sqrt(away.max())), rows, None])
        if len(rows) > leaf and away.max() > 0:
            a = points[int(away.argmax())]
            b = points[int(((points - a) ** 2).sum(axis=1).argmax())]
            side = points @ (b - a)
            half = np.argpartition(side, len(rows) // 2)
            self.nodes[at][2] = None
            self.nodes[at][3] = (self._build(rows[half[: len(rows) // 2]], leaf), self._build(rows[half[len(rows) // 2 :]], leaf))
        return at


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor
        self.kept: list[list[tuple[int, int]]] = [[] for _ in ids]

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = (scores >= self.floor[q]) & (ids != self.ids[q])
        if not ok.any():
            return
        best: dict[int, int] = {}
        for i, s in [(-i, s) for s, i in self.kept[q]] + list(zip(ids[ok].tolist(), scores[ok].tolist(), strict=True)):
            best[i] = max(int(s), best.get(i, int(s)))
        self.kept[q] = heapq.nlargest(self.k, ((s, -i) for i, s in best.items()))
        if len(self.kept[q]) == self.k:
            self.floor[q] = max(self.floor[q], self.kept[q][-1][0])


def whole(vectors: list, scale: float) -> np.ndarray:
    return np.floor(np.asarray(vectors, dtype=np.float64) * scale)


def exact_scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; in Python integers where doubles wouldn't be exact."""
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    if largest < 2**53:
        return (rows @ queries.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for q in queries] for r in rows]
    return np.array(exact, dtype=object).reshape(len(rows), len(queries))


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, best: Best, which: np.ndarray) -> int:
    """Best-first search of one tree for queries ``which`` of a block; the number of leaves read."""
    length = np.sqrt((queries**2).sum(axis=1))
    read, order, heap = 0, 0, []

    def push(at: int, active: np.ndarray) -> None:
        nonlocal order
        center, radius = tree.nodes[at][:2]
        bound = queries[active] @ center + length[active] * radius
        bound += np.abs(bound) * 1e-9 + 1.0
        keep = bound >= best.floor[which[active]].astype(np.float64)
        if keep.any():
            order += 1
            heapq.heappush(heap, (-float(bound[keep].max()), order, at, active[keep], bound[keep]))

    push(0, np.arange(len(queries)))
    while heap:
        _, _, at, active, bound = heapq.heappop(heap)
        active = active[bound >= best.floor[which[active]].astype(np.float64)]
        if not len(active):
            continue
        _, _, rows, children = tree.nodes[at]
        if children:
            for child in children:
                push(child, active)
            continue
        read += 1
        scores = exact_scores(tree.x[rows], queries[active])
        for j, q in enumerate(which[active].tolist()):
            best.offer(q, scores[:, j], ids[rows])
    return read


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, block: int = 2048, shard: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows.

    ``vectors`` has vec_id and embedding; ``is_query`` is a Column over it. A block has about
    ``block`` queries (ids are dealt by hash), so what is broadcast doesn't grow with the data;
    more queries take more passes.
    """
    spark = vectors.sparkSession
    tune_arrow(spark)
    e = F.col("embedding")
    usable = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.col("vec_id").isNotNull()
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
    asked = vectors.where(usable & is_query).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(e.cast("array<double>")).alias("embedding"))
    n = asked.count()
    passes = max(1, -(-n // block))
    found = None
    for b in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == b).toArrow()
        ids = np.array(mine.column(0).to_pylist(), dtype=np.int64)
        lists = mine.column(1).to_pylist()
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        kept = {}
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            kept[int(size)] = (which, whole([lists[i] for i in which], scale).reshape(len(which), int(size)))
        floor = np.full(len(ids), -(2**62), dtype=object if any(len(q) and float(np.abs(q).max(initial=0)) ** 2 * max(1, q.shape[1]) >= 2**53 for _, q in kept.values()) else np.int64)
        for which, q in kept.values():  # the pilot
            for at in range(0, len(which), 256):
                own = exact_scores(q[at : at + 256], q)
                for j, i in enumerate(which[at : at + 256]):
                    others = np.delete(own[j], at + j)
                    if len(others) >= k:
                        floor[i] = np.sort(others)[-k]
        sent = spark.sparkContext.broadcast((ids, kept, floor))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, kept, floor = sent.value
            best = Best(ids, k, floor.copy())
            held: dict[int, list] = {}

            def flush(size: int) -> None:
                if size in kept and held.get(size):
                    which, q = kept[size]
                    x = whole([v for _, v in held[size]], scale).reshape(len(held[size]), size)
                    search(BallTree(x), np.array([i for i, _ in held[size]], dtype=np.int64), q, best, which)
                held[size] = []

            for batch in batches:
                for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if len(v) in kept:
                        held.setdefault(len(v), []).append((i, v))
                        if len(held[len(v)]) >= shard:
                            flush(len(v))
            for size in list(held):
                flush(size)
            out = [(int(ids[q]), -i, s) for q, kept_q in enumerate(best.kept) for s, i in kept_q]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

        one = rows.mapInArrow(run, SCHEMA).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        part = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if passes > 1:  # each pass is done before the next one's queries are sent
            part = materialize(part, "topk", len(ids) * k)
        found = part if found is None else found.unionByName(part)
    return found
