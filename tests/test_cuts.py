"""Searches for cuts beyond the points that a table of all buckets is made for."""

import numpy as np
import pytest

from tessera.operators import buckets, partition
from tessera.operators.cuts import Peaks


def samples(seed, m):
    r = np.random.default_rng(seed)
    kinds = [r.integers(0, 50, m), r.normal(size=m) * 10, np.full(m, 7), r.gamma(0.2, 50, m), r.integers(-3, 4, m)]
    return kinds[seed % 5].astype(float), np.cumsum(r.integers(1, 9, m))


@pytest.mark.parametrize("share", [1.0, 0.4, 0.1, 0.0])
def test_errors_looked_up_are_those_of_the_table(share):
    for seed in range(15):
        error = buckets.BucketError(*samples(seed, 11 + 5 * seed), share)
        table = error.table()
        a, b = np.nonzero(np.isfinite(table))
        assert np.allclose(Peaks(error, buckets.LEAST).errors(a, b), table[a, b], rtol=1e-9, atol=1e-9)


def test_fast_search_finds_the_same_without_a_table(monkeypatch):
    for seed in (0, 1, 3):
        t, pos = samples(seed, 400)
        t = t + np.random.default_rng(seed).random(400)  # no ties
        want = [buckets.minimax_fast(buckets.BucketError(t, pos), k) for k in (1, 2, 8, 30)]
        with monkeypatch.context() as few:
            few.setattr(buckets, "MOST", 10)
            assert [buckets.minimax_fast(buckets.BucketError(t, pos), k) for k in (1, 2, 8, 30)] == want


def test_fast_search_takes_many_points():
    m = buckets.MOST + 500
    r = np.random.default_rng(4)
    pts = partition.Points(np.arange(m), r.random(m) * 1000, np.arange(m) * 50, m * 50)
    error = buckets.BucketError(pts.t, pts.pos)
    cuts = partition.choose_cuts(pts, 8, "minimax_fast")
    assert len(cuts) == 8 and buckets.worst(error, cuts) < buckets.worst(error, buckets.equal_depth(m, 8))


def least_errors(monkeypatch, share, seeds):
    for seed in seeds:
        t, pos = samples(seed, 13 + 6 * seed)
        error = buckets.BucketError(t, pos, share)
        for k in (1, 2, 3, 5):
            want = buckets.minimax(error, k)
            with monkeypatch.context() as few:
                few.setattr(buckets, "MOST", 10)
                got = buckets.minimax(buckets.BucketError(t, pos, share), k)
            if want is None:
                assert got is None
                continue
            assert len(got) == k and all(b - a >= buckets.LEAST for a, b in zip(got, [*got[1:], len(t)]))
            assert buckets.worst(error, got) == pytest.approx(buckets.worst(error, want), rel=1e-9, abs=1e-9)


def test_search_without_a_table_has_the_least_error(monkeypatch):
    least_errors(monkeypatch, 1.0, range(15))


@pytest.mark.parametrize("values", ["even", "same", "heavy", "signed"])
def test_search_takes_many_points(values):
    m = buckets.MOST + 500
    r = np.random.default_rng(6)
    t = {"even": r.random(m), "same": np.ones(m), "heavy": r.pareto(1.2, m), "signed": r.normal(size=m)}[values]
    pos = np.cumsum(r.integers(1, 100, m))
    pts = partition.Points(np.arange(m), t, pos, int(pos[-1]) + 1)
    error = buckets.BucketError(t, pos)
    cuts, fast = partition.choose_cuts(pts, 8, "minimax"), partition.choose_cuts(pts, 8, "minimax_fast")
    assert len(cuts) == 8 and buckets.worst(error, cuts) <= buckets.worst(error, fast) * (1 + 1e-9)
    assert buckets.worst(error, cuts) < buckets.worst(error, buckets.equal_depth(m, 8))


@pytest.mark.parametrize("share", [0.5, 0.1, 0.0])
def test_search_by_a_share_of_the_intervals_has_the_least_error(monkeypatch, share):
    least_errors(monkeypatch, share, range(0, 15, 2))


@pytest.mark.parametrize("values", ["even", "heavy", "signed", "zeros"])
def test_search_by_a_share_of_the_intervals_takes_many_points(values):
    m = buckets.MOST + 500
    r = np.random.default_rng(8)
    t = {"even": r.random(m), "heavy": r.pareto(1.2, m), "signed": r.normal(size=m), "zeros": (r.random(m) < 0.01) * 5.0}[values]
    pos = np.cumsum(r.integers(1, 100, m))
    pts = partition.Points(np.arange(m), t, pos, int(pos[-1]) + 1)
    cuts = partition.choose_cuts(pts, 8, "minimax_sampled")
    some = buckets.BucketError(t, pos, 0.1)
    peaks = Peaks(some, buckets.LEAST)
    assert len(cuts) == 8 and buckets.worst(some, cuts) < buckets.worst(some, buckets.equal_depth(m, 8))
    ends = np.array([*cuts[1:], m])
    assert peaks.errors(np.array(cuts), ends) == pytest.approx([some(a, b - 1) for a, b in zip(cuts, ends, strict=True)], rel=1e-9)
