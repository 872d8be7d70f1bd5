"""Experiments: pairs of method and partitioner over one workload, with a report row each."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame

from tessera.functions.intervals import Box
from tessera.operators.exact import batch_aggregate
from tessera.plans import metrics
from tessera.plans.synopsis import Synopsis

PAIRS = (("hybrid", "minimax_sampled"), ("uniform", "depth"), ("stratified", "depth"), ("hybrid_uniform", "climb"))
KD_PAIRS = (("hybrid", "median_error"), ("hybrid_uniform", "median_breadth"))
CUT_PAIRS = (("hybrid", "minimax_sampled"), ("hybrid", "depth"))


def run(df: DataFrame, key: str, dims: list[str], target: str, queries: dict[str, Box], leaves: int = 64, rate: float = 0.005, pairs: Iterable[tuple[str, str]] = PAIRS, point_rate: float = 0.005, out: str | None = None) -> list[dict]:
    """A report per pair; results go to ``out``/method-partitioner as JSON."""
    truth = batch_aggregate(df, queries, target).persist()
    built: dict[str, Synopsis] = {}
    reports = []
    try:
        for method, how in pairs:
            began = time.perf_counter()
            if how not in built:
                built[how] = Synopsis.fit(df, key, dims, target, leaves, how, point_rate)
            fitted = time.perf_counter()
            results = built[how].solve(queries, method, rate).persist()
            row = metrics.report(results, truth).first().asDict()
            reports.append({"method": method, "partitioner": how, "build_s": fitted - began, "solve_s": time.perf_counter() - fitted} | row)
            if out:
                results.write.mode("overwrite").json(f"{out}/{method}-{how}")
            results.unpersist()
    finally:
        truth.unpersist()
    return reports


def shifted(df: DataFrame, key: str, tree_dims: list[str], target: str, workloads: dict[str, dict[str, Box]], leaves: int = 1024, rate: float = 0.005) -> dict[str, list[dict]]:
    """Workload shift: a tree over some dimensions, workloads over fewer or more."""
    built = Synopsis.fit(df, key, tree_dims, target, leaves, "median_error")
    out = {}
    for name, queries in workloads.items():
        truth = batch_aggregate(df, queries, target)
        out[name] = [{"method": m} | metrics.report(built.solve(queries, m, rate), truth).first().asDict() for m in ("hybrid", "stratified")]
    return out
