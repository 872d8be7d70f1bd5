import pytest
from pyspark.sql import functions as F

from tessera.operators import partition
from tessera.sources import axes
from tessera.streaming import refresh


def test_sensors(spark, tmp_path):
    (tmp_path / "s.txt").write_text("date time epoch moteid temperature humidity light voltage\n2004-03-31 03:38:15.757551 2 1 122.153 -3.91901 11.04 2.03397\n2004-02-28 00:59:16 3 1 19.98 37.09 45.08 2.69964\n2004-02-28 01:00:00 3 1 19.98  45.08 2.69964\n")
    got = axes.read_sensors(spark, str(tmp_path / "s.txt")).orderBy("idate").collect()
    assert [(r.idate, r.itime, round(r.voltage, 3)) for r in got] == [(228, 5916, 269.964), (331, 33815, 203.397)]


def test_order_lines_and_numbers(spark, tmp_path):
    (tmp_path / "o.csv").write_text("order_id,product_id,add_to_cart_order,reordered\n1,10,1,0\n2,,2,1\n")
    assert [tuple(r) for r in axes.read_order_lines(spark, str(tmp_path / "o.csv")).collect()] == [(1, 10, 1, 0)]
    (tmp_path / "n.csv").write_text("A,C\n1.5,2\n,3\n")
    assert axes.read_numbers(spark, str(tmp_path / "n.csv")).count() == 1


def test_trips(spark, tmp_path):
    df = spark.createDataFrame([("2019-01-01 00:46:40", "2019-01-01 00:53:20", 151, 239, 1.5, "x")], "tpep_pickup_datetime string, tpep_dropoff_datetime string, PULocationID int, DOLocationID int, trip_distance double, other string")
    out = axes.trip_axes(df)
    r = out.first()
    assert len(out.columns) == 9 and (r.pickup_date, r.pickup_time, r.pickup_datetime, r.dropoff_time) == (20190101, 4640, 1546303600, 5320)
    axes.write_csv(out, str(tmp_path / "t"))
    assert axes.read_csv(spark, str(tmp_path / "t"), out.schema).collect() == out.collect()
    axes.write_json(out, str(tmp_path / "j"))
    assert axes.read_json(spark, str(tmp_path / "j"), out.schema).collect() == out.collect()
    axes.write_columns(out, str(tmp_path / "p"), ["pickup_date"])
    assert axes.read_table(spark, str(tmp_path / "p"), ["trip_distance"]).first()[0] == 1.5
    assert [axes.trip_dimensions(i) for i in (1, 2, 3)] == [["pickup_time"], ["pickup_date", "pickup_time"], ["pickup_date", "pickup_time", "PULocationID"]]
    assert len(axes.trip_dimensions(6)) == 6


def test_filters_reach_the_scan(spark, data):
    from tessera.functions.intervals import inside

    plan = spark.read.parquet(f"{data}/orders.parquet").where(inside({"o_custkey": (1, 50)})).select("o_totalprice")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_custkey,1)" in plan and "LessThanOrEqual(o_custkey,50)" in plan and "o_orderstatus" not in plan


def test_streaming_leaves(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "value", F.col("user_id").alias("p"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    leaf = partition.by_cuts(F.col("p"), [0, 20, 50])
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = refresh.streaming_leaves(stream, leaf, ["p"], ["value"]).writeStream.outputMode("complete").format("memory").queryName("leaves").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = refresh.streaming_leaves(events, leaf, ["p"], ["value"])
    assert {r["__leaf"]: (r.cnt, round(r.sum_value, 4), r.lo_p, r.hi_p) for r in spark.table("leaves").collect()} == {r["__leaf"]: (r.cnt, round(r.sum_value, 4), r.lo_p, r.hi_p) for r in want.collect()}
    w = refresh.windowed_leaves(stream.withColumn("ts", F.col("ts").cast("timestamp")), leaf, "ts", "value").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.table("windows").count() > 0


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (3, None)], "a int, b double")
    got = {r.column: r for r in axes.profile(df, ["a", "b"]).collect()}
    assert got["a"].mean == pytest.approx(2) and got["b"].n == 0 and got["b"].min is None
