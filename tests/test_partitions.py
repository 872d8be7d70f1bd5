import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import buckets, partition

values = st.lists(st.integers(0, 50), min_size=6, max_size=12)


def plain_error(t, pos, a, b):
    n, rows = b - a + 1, pos[b] - pos[a]
    if n < 3 or rows <= 0:
        return 0.0
    best = 0.0
    for i in range(a, b + 1):
        for j in range(i + 2, b + 1):
            q, x = j - i + 1, t[i : j + 1]
            best = max(best, (1 / n) * (1 - n / rows) * (n / q**2 * sum(v * v for v in x) - sum(x) ** 2 / q**2))
    return best


def test_bucket_error_golden():
    e = buckets.BucketError([1, 2, 3, 10], [0, 10, 20, 30])
    assert e(0, 3) == pytest.approx(5.464815, abs=1e-6)


@settings(max_examples=60, deadline=None)
@given(values, st.integers(2, 9))
def test_bucket_error_is_the_plain_one(t, gap):
    pos = [gap * i for i in range(len(t))]
    e = buckets.BucketError(t, pos)
    for a, b in itertools.combinations(range(len(t)), 2):
        assert e(a, b) == pytest.approx(plain_error(t, pos, a, b))


@settings(max_examples=60, deadline=None)
@given(values, st.integers(1, 4))
def test_minimax_is_the_best(t, k):
    e = buckets.BucketError(t, [7 * i for i in range(len(t))])
    got = buckets.minimax(e, k)
    ok = [c for c in ([0, *x] for x in itertools.combinations(range(3, len(t) - 2), k - 1)) if all(b - a >= 3 for a, b in zip(c, [*c[1:], len(t)]))]
    if not ok:
        assert got is None
        return
    assert all(b - a >= 3 for a, b in zip(got, [*got[1:], len(t)]))
    assert buckets.worst(e, got) == pytest.approx(min(buckets.worst(e, c) for c in ok))
    fast = buckets.minimax_fast(e, k)
    assert len(fast) == k and buckets.worst(e, fast) >= buckets.worst(e, got) - 1e-9


def test_fast_search_is_near_the_best():
    r = np.random.default_rng(2)
    for _ in range(5):
        t = r.gamma(1, 30, 60)
        e = buckets.BucketError(t, np.arange(60) * 20)
        assert buckets.worst(e, buckets.minimax_fast(e, 6)) <= 1.3 * buckets.worst(e, buckets.minimax(e, 6)) + 1e-9


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 99), min_size=10, max_size=30), st.integers(2, 4))
def test_hill_climb_never_gets_worse(t, k):
    err = buckets.SplitError(t)

    def total(c):
        return sum(sorted((err(a, b)[0] for a, b in zip(c, [*c[1:], len(t)])), reverse=True)[:2])

    got = buckets.hill_climb(np.array(t), k)
    assert got[0] == 0 and len(got) == k and got == sorted(set(got))
    assert total(got) <= total(buckets.equal_depth(len(t), k)) + 1e-9


def test_split_error_is_the_variance():
    t = np.array([5.0, 1, 4, 9, 2, 6, 8, 3])
    e, mid = buckets.SplitError(t)(0, 8)
    assert e == pytest.approx(max(max(np.var(t[:m], ddof=1), np.var(t[m:], ddof=1)) for m in range(3, 7))) and 3 <= mid < 7


def test_sampled_errors_look_at_the_whole_bucket():
    e = buckets.BucketError([1, 2, 3, 10], [0, 10, 20, 30], share=0.0)
    assert e(0, 3) == pytest.approx(2.708333, abs=1e-6)


def test_cuts_hold_every_row(spark):
    rows = [(str(i), v, float(i)) for i, v in enumerate([5] * 30 + [9] * 3 + list(range(20, 60)))]
    df = spark.createDataFrame(rows, "key string, p long, t double")
    pts = partition.sample_points(df, "key", "p", "t", 0.5)
    assert pts.x[0] == 5 and pts.x[-1] == 59 and pts.pos[-1] == len(rows) - 1 and pts.pos[0] == 29
    for how in ("depth", "minimax", "minimax_sampled", "minimax_fast", "climb"):
        starts = partition.choose_cuts(pts, 4, how)
        got = df.select("p", partition.by_cuts(F.col("p"), starts).alias("leaf")).collect()
        assert all(r.leaf == max(0, sum(s <= r.p for s in starts) - 1) for r in got)
    many = spark.createDataFrame([(str(i), i // 2, 1.0) for i in range(1000)], "key string, p long, t double")
    pts = partition.sample_points(many, "key", "p", "t", 0.7)
    assert len(pts.x) > 200 and (pts.pos == 2 * pts.x + 1).all()
    assert partition.sample_points(df.limit(0), "key", "p", "t", 0.5).rows == 0


@pytest.mark.parametrize("how", ["error", "breadth", "variance"])
def test_median_trees(spark, how):
    r = np.random.default_rng(8)
    v = r.integers(0, 40, (400, 2)).astype(float)
    v[:100] = 7  # many equal points
    root = partition.median_tree(v, r.gamma(1, 10, 400), 20, how)
    leaves = root.leaves()
    assert 20 <= len(leaves) <= 23 and sorted(np.concatenate([x.rows for x in leaves])) == list(range(400))
    if how == "error":
        depths = [x.depth for x in leaves if len(x.rows) > 100]
        assert not depths or max(x.depth for x in leaves) - min(depths) <= 3
    df = spark.createDataFrame([(float(a), float(b)) for a, b in v], "x double, y double")
    got = [r.leaf for r in df.select(partition.by_tree(root, ["x", "y"]).alias("leaf")).collect()]
    want = np.empty(400, dtype=int)
    for x in leaves:
        want[x.rows] = x.number
    assert got == want.tolist()


@pytest.mark.parametrize("k", [64, 128])
def test_many_buckets_beat_equal_depth(k):
    r = np.random.default_rng(3)
    t = np.where(np.arange(1500) % 500 < 60, r.gamma(1, 500, 1500), r.gamma(2, 5, 1500))
    e = buckets.BucketError(t, np.arange(1500) * 40)
    pts = partition.Points(np.arange(1500), t, np.arange(1500) * 40, 60_000)
    even = buckets.worst(e, buckets.equal_depth(1500, k))
    for how in ("minimax", "minimax_fast", "minimax_sampled"):
        cuts = partition.choose_cuts(pts, k, how)
        if how == "minimax_sampled":  # by the intervals that it looks at
            some = buckets.BucketError(t, np.arange(1500) * 40, 0.1)
            assert len(cuts) == k and buckets.worst(some, cuts) < 0.8 * buckets.worst(some, buckets.equal_depth(1500, k))
        else:
            assert len(cuts) == k and buckets.worst(e, cuts) < 0.8 * even, how


def test_too_few_or_too_many_points_are_errors(spark):
    pts = partition.Points(np.arange(20), np.ones(20), np.arange(20) * 9, 200)
    with pytest.raises(ValueError, match="raise the rate"):
        partition.choose_cuts(pts, 7, "minimax")
    df = spark.createDataFrame([(str(i), i, 1.0) for i in range(50)], "key string, p long, t double")
    with pytest.raises(ValueError, match="lower the rate"):
        partition.sample_points(df, "key", "p", "t", 0.9, most=10)
    with pytest.raises(ValueError, match="lower the rate"):
        buckets.BucketError(np.ones(buckets.MOST + 1), np.arange(buckets.MOST + 1)).table()


def test_many_leaves_are_found_in_arrays(spark):
    r = np.random.default_rng(5)
    starts = sorted(set(r.integers(0, 5000, 300).tolist()))
    df = spark.createDataFrame([(int(x), float(y)) for x, y in zip(r.integers(-10, 5100, 400), r.normal(size=400))], "p long, y double")
    assert len(starts) > partition.NESTED
    got = df.select("p", partition.by_cuts(F.col("p"), starts).alias("leaf")).collect()
    assert all(x.leaf == max(0, sum(s <= x.p for s in starts) - 1) for x in got)
    root = partition.median_tree(np.stack([r.integers(0, 5000, 3000), r.normal(size=3000)], axis=1).astype(float), r.gamma(1, 9, 3000), 400, "breadth")
    some = df.collect()
    found = [x.leaf for x in df.select(partition.by_tree(root, ["p", "y"]).alias("leaf")).collect()]
    back = partition.Split.read(root.spec())
    nested, partition.NESTED = partition.NESTED, 10**6
    try:
        assert found == [x.leaf for x in df.select(partition.by_tree(back, ["p", "y"]).alias("leaf")).collect()]
    finally:
        partition.NESTED = nested
    assert len(set(found)) > 100 and len(some) == 400


def test_medians_of_a_tree_are_those_of_all_rows(spark):
    r = np.random.default_rng(6)
    v, t = r.integers(0, 1000, (4000, 2)), r.gamma(1, 10, 4000)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in v], "x long, y long")
    root = partition.exact_medians(df, ["x", "y"], partition.median_tree(v[:400].astype(float), t[:400], 30, scale=10.0))

    def check(s, rows):
        if s.children:
            assert s.medians == [float(np.floor(np.median(rows[:, d]))) for d in (0, 1)]
            for b, c in s.children.items():
                check(c, rows[[all((x[d] > s.medians[d]) == bool(b >> d & 1) for d in (0, 1)) for x in rows]])

    check(root, v)


def test_one_value_cannot_be_split():
    assert len(partition.median_tree(np.zeros((50, 1)), np.ones(50), 8).leaves()) == 1
