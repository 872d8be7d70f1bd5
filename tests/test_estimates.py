import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import exact, merge, partition, sampling, tree
from tessera.plans import metrics, runner, workload
from tessera.plans.synopsis import Synopsis


@pytest.fixture(scope="module")
def g(spark):
    """Key p = 1..8, t = 10 p."""
    return spark.createDataFrame([(str(i), i, 10 * i) for i in range(1, 9)], "key string, p long, t long")


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(4)
    p, q = r.integers(0, 1000, 20_000), r.integers(0, 100, 20_000)
    t = r.gamma(2, 50, 20_000) + p / 10
    return spark.createDataFrame([(str(i), int(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(p, q, t))], "key string, p long, q long, t double").persist()


def fixed(df, cuts, seed="tessera"):
    leaf = partition.by_cuts(F.col("p"), cuts)
    root = tree.pairwise_tree(tree.collect_leaves(df.withColumn("__leaf", leaf), "__leaf", ["p"], ["t"]))
    return Synopsis(df, "key", ["p"], "t", leaf, root, seed)


Q = {"q": {"p": (2, 6)}}


def near(row, **want):
    for k, v in want.items():
        assert row[k] == pytest.approx(v, abs=1e-6), k


def test_uniform_golden(g):
    row = fixed(g, [1, 3, 5, 7]).solve(Q, "uniform", 1.0).first()
    near(row, cnt=5, sum=200, avg=40, ci_cnt=3.527333, ci_sum=162.920545, ci_avg=32.584109, min=20, max=60)


def test_hybrid_golden(g):
    row = fixed(g, [1, 3, 5, 7]).solve(Q, "hybrid", 1.0).first()
    near(row, cnt=5, sum=200, avg=40, ci_cnt=1.821507, ci_sum=36.430141, ci_avg=36.430141, min=10, max=60, delta_leaf_frac=0.25, delta_row_frac=0.25)


def test_stratified_golden(spark, g):
    """Strata [1,4] and [5,8], sampled p = {1, 3} and {5, 8}."""
    want = {frozenset({"1", "3"}), frozenset({"5", "8"})}
    for i in range(20_000):  # a seed that samples these rows
        import hashlib

        rank = lambda keys: frozenset(sorted(keys, key=lambda k: hashlib.md5(f"{i}:{k}".encode()).hexdigest())[:2])  # noqa: B023, E731
        if {rank("1234"), rank("5678")} == want:
            break
    row = fixed(g, [1, 5], str(i)).solve(Q, "stratified", 0.5).first()
    near(row, cnt=4, sum=160, avg=40, ci_cnt=5.152, ci_sum=212.422402, ci_avg=53.1056)


def test_aligned_and_disjoint(g):
    s = fixed(g, [1, 3, 5, 7])
    row = s.solve({"q": {"p": (3, 6)}}, "hybrid", 0.1).first()
    near(row, cnt=4, sum=180, ci_cnt=0, ci_sum=0, ci_avg=0, delta_leaf_frac=0, delta_row_frac=0)
    row = s.solve({"q": {"p": (100, 200)}}, "hybrid", 0.5).first()
    near(row, cnt=0, sum=0, avg=0)
    assert row["min"] is None and row["max"] is None


@pytest.mark.parametrize("how", ["width", "depth", "minimax_sampled", "minimax_fast", "climb", "median_error", "median_breadth", "median_variance"])
def test_full_sample_is_exact_and_bounds_hold(table, how):
    s = Synopsis.fit(table, "key", ["p"], "t", 12, how, 0.01)
    assert s.check()
    boxes = workload.random_boxes(table, "key", ["p"], 25, "x")
    truth = {r.query_id: r for r in exact.batch_aggregate(table, boxes, "t").collect()}
    for r in s.solve(boxes, "hybrid", 1.0).collect():
        gt = truth[r.query_id]
        near(r, cnt=gt["cnt"], avg=gt["avg"])
        assert r["min"] <= gt["min"] and r["max"] >= gt["max"] and r["sum"] == pytest.approx(gt["sum"])
    for r in s.bounds(boxes).collect():
        assert r["cnt"] >= truth[r.query_id]["cnt"] and r["sum"] >= truth[r.query_id]["sum"] - 1e-6


@pytest.mark.parametrize("how", ["grid", "median_error"])
def test_two_dimensions(table, how):
    s = Synopsis.fit(table, "key", ["p", "q"], "t", 6 if how == "grid" else 40, how)
    assert s.check()
    boxes = workload.random_boxes(table, "key", ["p", "q"], 20, "y")
    truth = exact.batch_aggregate(table, boxes, "t")
    for r in metrics.paired(s.solve(boxes, "hybrid", 1.0), truth).collect():
        assert r["sum"] == pytest.approx(r["gt_sum"]) and r["cnt"] == pytest.approx(r["gt_cnt"])


def test_intervals_hold_the_truth(table):
    """Over many queries, the 99 % intervals seldom miss."""
    s = Synopsis.fit(table, "key", ["p"], "t", 16, "depth", 0.05)
    boxes = workload.random_boxes(table, "key", ["p"], 300, "z")
    truth = exact.batch_aggregate(table, boxes, "t")
    for method in ("hybrid", "uniform", "stratified", "hybrid_uniform"):
        both = metrics.paired(s.solve(boxes, method, 0.05), truth)
        row = both.agg(F.avg(metrics.failed("cnt")).alias("cnt"), F.avg(metrics.failed("sum")).alias("sum"), F.percentile(metrics.relative_error("sum"), F.lit(0.5)).alias("re")).first()
        assert row["cnt"] <= 0.06 and row["sum"] <= 0.06 and row["re"] < 0.1, (method, row)


def test_a_small_budget_loses_nothing(table):
    s = Synopsis.fit(table, "key", ["p"], "t", 16, "depth", 0.05)
    boxes = workload.random_boxes(table, "key", ["p"], 20, "b")
    for budget in (1, 4, 9, 10**6):
        for r in metrics.paired(s.solve(boxes, "hybrid", 1.0, budget=budget), exact.batch_aggregate(table, boxes, "t")).collect():
            assert r["cnt"] == pytest.approx(r["gt_cnt"]) and r["sum"] == pytest.approx(r["gt_sum"])


def test_unions_add_up(table):
    s = Synopsis.fit(table, "key", ["p"], "t", 8, "depth", 0.05)
    parts = [{"p": (10, 200)}, {"p": (300, 410)}, {"p": (900, 5000)}]
    truth = table.where(" or ".join(f"p between {b['p'][0]} and {b['p'][1]}" for b in parts)).agg(F.count("*"), F.sum("t"), F.min("t"), F.max("t")).first()
    for method in ("uniform", "stratified"):
        r = s.solve_union({"u": parts}, method, 1.0).first()
        assert (r["cnt"], r["min"], r["max"]) == (pytest.approx(truth[0]), truth[2], truth[3]) and r["sum"] == pytest.approx(truth[1])
    with pytest.raises(ValueError, match="unions"):
        s.solve_union({"u": parts}, "hybrid")


def test_other_dimensions_than_the_tree(table):
    s = Synopsis.fit(table, "key", ["p", "q"], "t", 5, "grid")
    fewer, more = {"a": {"p": (100, 700)}}, {"a": {"p": (100, 700), "q": (10, 60), "t": (0, 100)}}
    assert not s.plan(fewer["a"]).covered
    for boxes in (fewer, more):
        r = metrics.paired(s.solve(boxes, "hybrid", 1.0), exact.batch_aggregate(table, boxes, "t")).first()
        assert r["cnt"] == pytest.approx(r["gt_cnt"])
    loose = Synopsis(table, "key", ["p", "q"], "t", s.leaf, s.root, strict=False)
    assert loose.plan(fewer["a"]).covered
    r = metrics.paired(loose.solve(fewer, "hybrid", 1.0), exact.batch_aggregate(table, fewer, "t")).first()
    assert r["cnt"] == pytest.approx(r["gt_cnt"])


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("1", 1, 1.0), ("2", None, 2.0), (None, 3, 3.0), ("4", 4, None), ("5", 5, 5.0)], "key string, p long, t double")
    s = Synopsis.fit(df, "key", ["p"], "t", 2, "depth", 1.0)
    assert s.rows == 2
    with pytest.raises(ValueError, match="no row"):
        Synopsis.fit(df.limit(0), "key", ["p"], "t", 2, "depth")
    row = exact.range_aggregate(df.limit(0), {"p": (0, 9)}, "t").first()
    assert (row["cnt"], row["sum"], row["avg"], row["min"]) == (0, 0, 0, None)
    assert exact.batch_aggregate(df, {}, "t").count() == 0


def test_ranks_are_those_of_a_full_sort(spark, table):
    import hashlib

    rows = table.select("key", (F.col("p") % 3).alias("g")).limit(3000)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    most = spark.createDataFrame([(0, 7), (1, 2000), (2, 0)], "g long, most long")
    got = {(r.g, r.key): r.rnk for r in sampling.ranked(rows, "key", "s", most, "g").collect()}
    want = {}
    for g, m in ((0, 7), (1, 2000)):
        keys = sorted((r.key for r in rows.collect() if r.g == g), key=lambda k: hashlib.md5(f"s:{k}".encode()).hexdigest())
        want |= {(g, k): i + 1 for i, k in enumerate(keys[:m])}
    assert got == want
    assert sampling.ranked(rows.repartition(7), "key", "s", F.lit(50)).count() == 50


def test_tree_is_stored_and_read(spark, table, tmp_path):
    s = Synopsis.fit(table, "key", ["p"], "t", 7, "depth", 0.05)
    tree.save(spark, s.root, f"{tmp_path}/nodes")
    back = tree.load(spark, f"{tmp_path}/nodes")
    assert tree.dump(back).replace(".0", "") == tree.dump(s.root).replace(".0", "")
    assert tree.summary(back) == tree.summary(s.root)
    again = Synopsis(table, "key", ["p"], "t", s.leaf, back)
    boxes = {"q": {"p": (100, 480)}}
    assert again.solve(boxes, "hybrid", 0.1).collect() == s.solve(boxes, "hybrid", 0.1).collect()


def test_runner_and_workloads(spark, table, tmp_path):
    boxes = workload.random_boxes(table, "key", ["p"], 12, "r")
    got = runner.run(table, "key", ["p"], "t", boxes, 8, 0.05, out=str(tmp_path / "out"))
    assert [r["method"] for r in got] == ["hybrid", "uniform", "stratified", "hybrid_uniform"]
    assert all(0 <= r["re_sum"] < 1 and r["queries"] == len(boxes) for r in got)
    assert spark.read.json(str(tmp_path / "out" / "hybrid-minimax_sampled")).count() == len(boxes)
    shifted = runner.shifted(table, "key", ["p", "q"], "t", {"one": boxes}, 20, 0.05)
    assert [r["method"] for r in shifted["one"]] == ["hybrid", "stratified"]
    w = workload.random_workload(table, "key", ["p"], "t", 12, "r")
    assert {r.query_id: r["sum"] for r in workload.refresh(table, w, ["p"], "t").collect()} == pytest.approx({r.query_id: r["sum"] for r in w.collect()})
    assert workload.first_queries(w, 3).count() == 3
    assert workload.exact_by_sql(table, {"q": {"p": (1, 9)}}, "t")["q"] == pytest.approx(exact.range_aggregate(table, {"p": (1, 9)}, "t").first()["sum"])
    few = {(r.lo, r.hi): (r.cnt, r["sum"]) for r in workload.every_interval(table, "q", "t", block=7).collect()}
    assert len(few) == 98 * 99 // 2
    for lo, hi in ((0, 99), (13, 15), (40, 77)):
        cnt, total = table.where(F.col("q").between(lo, hi)).agg(F.count("*"), F.sum("t")).first()
        assert few[lo, hi] == (cnt, pytest.approx(total))
    assert len(workload.random_boxes(table, "key", ["q"], 400, "many")) == 400
    assert workload.random_workload(table, "key", ["q"], "t", 60, "many").count() == 60


def test_stored_samples_give_the_same_answers(spark, table, tmp_path):
    s = Synopsis.fit(table, "key", ["p"], "t", 8, "depth", 0.05)
    boxes = workload.random_boxes(table, "key", ["p"], 10, "st")
    want = sorted(map(repr, s.solve(boxes, "hybrid", 0.02).collect()))
    s.store(str(tmp_path / "strata"), 0.02)
    got = s.solve(boxes, "hybrid", 0.02)
    assert got.inputFiles() and all("/strata/__leaf=" in f for f in got.inputFiles())
    assert sorted(map(repr, got.collect())) == want
    assert s.solve(boxes, "hybrid", 1.0).count() == len(boxes)  # more than is kept: from the table


def test_prefix_sums_in_ranges(spark):
    rows = sorted((i % 7, f"{i:04d}", i * 3 % 11) for i in range(700))
    df = spark.createDataFrame(rows, "p long, key string, t long")
    made = merge.prefix_sums(df, ["p", "key"], "t", ranges=9)
    got = {r.key: (r.pos, r.s, r.ss) for r in made.collect()}
    s = ss = 0
    for pos, (_, key, t) in enumerate(rows):
        s, ss = s + t, ss + t * t
        assert got[key] == (pos, s, ss)
    assert "__range" in made._jdf.queryExecution().analyzed().toString()
    assert merge.prefix_sums(df.limit(0), ["p", "key"], "t").count() == 0


def test_a_saved_synopsis_answers_without_the_table(spark, table, tmp_path):
    boxes = workload.random_boxes(table, "key", ["p"], 10, "sv")
    for how in ("width", "depth", "minimax_sampled", "median_error"):
        s = Synopsis.fit(table, "key", ["p"], "t", 9, how, 0.05)
        want = sorted(map(repr, s.solve(boxes, "hybrid", 0.02).collect()))
        s.save(str(tmp_path / how), 0.02)
        back = Synopsis.load(spark, str(tmp_path / how))
        assert back.df is None and tree.summary(back.root) == tree.summary(s.root)
        got = back.solve(boxes, "hybrid", 0.02)
        assert sorted(map(repr, got.collect())) == want
        with pytest.raises(ValueError, match="table"):
            back.solve(boxes, "hybrid", 1.0)
        again = Synopsis.load(spark, str(tmp_path / how), table)
        assert again.check() and again.solve(boxes, "uniform", 0.02).count() == 10
        leaf = lambda x: [r[0] for r in table.orderBy("key").limit(500).select(x.leaf).collect()]
        assert leaf(again) == leaf(s)


def test_queries_with_seeds_of_their_own(table):
    s = Synopsis.fit(table, "key", ["p"], "t", 12, "depth", 0.05)
    boxes = workload.random_boxes(table, "key", ["p"], 20, "own")
    for rate, method in ((1.0, "hybrid"), (1.0, "stratified")):
        for r in metrics.paired(s.solve(boxes, method, rate, own_seeds=True), exact.batch_aggregate(table, boxes, "t")).collect():
            assert r["cnt"] == pytest.approx(r["gt_cnt"]) and r["sum"] == pytest.approx(r["gt_sum"])
    box = {"p": (101, 702)}
    assert len({r["sum"] for r in s.solve({"a": box, "b": box}, "hybrid", 0.02, own_seeds=True).collect()}) == 1
    shifted = {"a": box, "b": {"p": (101, 703)}}
    assert s.solve(shifted, "hybrid", 0.02).count() == 2


def test_batches_meet_no_nested_loop(spark, table):
    """Answers by cells and by parts are those of single queries, odd boxes included."""
    boxes = {"a": {"p": (10, 20)}, "b": {"p": (20, 20)}, "c": {"p": (-5, 10**6)}, "d": {"p": (30, 25)}, "e": {"p": (2000, 3000)}, "f": {"p": (20, 30)}, "g": {"p": (10.5, 19.5)}}
    two = {"a": {"p": (10, 400), "q": (3, 60)}, "b": {"q": (5, 5)}, "c": {"p": (399, 401)}, "d": {}, "e": {"p": (10**7, 10**8), "q": (0, 1)}}
    nulls = table.unionByName(spark.createDataFrame([("x", None, 3, 1.0), ("y", 15, None, 2.0), ("z", 15, 15, None)], table.schema))
    for some in (boxes, two):
        got = {r.query_id: r for r in exact.batch_aggregate(nulls, some, "t").collect()}
        assert set(got) == set(some)
        for q, b in some.items():
            want = exact.range_aggregate(nulls, b, "t").first()
            assert all(got[q][c] == (pytest.approx(want[c]) if want[c] is not None else None) for c in ("cnt", "sum", "avg", "min", "max")), q
        plan = exact.batch_aggregate(nulls, some, "t")._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scrambles_are_made_and_dropped(spark, table, tmp_path):
    path = str(tmp_path / "scramble")
    made = sampling.scramble(table, "key", 0.1, "s", 20_000, path)
    assert made.count() == 2000 and sampling.scramble_sum(made, F.lit(True), "t", 0.1).first()["sum"] == pytest.approx(table.agg(F.sum("t")).first()[0], rel=0.1)
    assert sampling.drop_scramble(spark, path) and not (tmp_path / "scramble").exists() and not sampling.drop_scramble(spark, path)


def test_one_pass_ranks_are_those_of_two(spark, table):
    rows = table.select("key", (F.col("p") % 3).alias("g"))
    sizes = {r.g: r["count"] for r in rows.groupBy("g").count().collect()}
    known = spark.createDataFrame([(g, m, sizes[g]) for g, m in ((0, 0), (1, 40), (2, 10**6))], "g long, most long, size long")
    one = sampling.ranked(rows, "key", "s", known, "g")
    two = sampling.ranked(rows, "key", "s", known.drop("size"), "g")
    assert sorted(one.collect()) == sorted(two.select(one.columns).collect())
    assert "__b" not in one._jdf.queryExecution().analyzed().toString()
    assert sorted(sampling.ranked(rows, "key", "s", F.lit(70), total=20_000, wanted=70).collect()) == sorted(sampling.ranked(rows, "key", "s", F.lit(70)).collect())
