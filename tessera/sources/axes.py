"""Readers, writers and derived numeric axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# readers


def read_csv(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text with a declared schema (no inference pass over the data)."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def without_nulls(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Rows without any null; an option of every loader."""
    return df.na.drop("any") if enabled else df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, drop_nulls: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return without_nulls(df.select(*columns) if columns else df, drop_nulls)


SENSOR_SCHEMA = "date string, time string, epoch long, moteid long, temperature double, humidity double, light double, voltage double"
ORDER_LINES_SCHEMA = "order_id long, product_id long, add_to_cart_order long, reordered int"


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    """Space-delimited sensor readings: ``idate``, ``itime`` and scaled voltage."""
    df = without_nulls(read_csv(spark, path, SENSOR_SCHEMA, sep=" "))
    return df.withColumns({
        "idate": F.regexp_replace("date", "-", "").cast("long") - 20040000,
        "itime": F.regexp_replace(F.regexp_extract("time", r"^([^.]*)", 1), ":", "").cast("long"),
        "voltage": F.col("voltage") * 100,
    })


def read_order_lines(spark: SparkSession, path: str) -> DataFrame:
    return without_nulls(read_csv(spark, path, ORDER_LINES_SCHEMA))


def read_numbers(spark: SparkSession, path: str, schema: str = "A double, C double") -> DataFrame:
    """Plain numeric columns, such as a synthetic data set with target A and predicate C."""
    return without_nulls(read_csv(spark, path, schema))


# axes


def date_number(ts: Column) -> Column:
    """yyyymmdd as a whole number."""
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("long")


def time_number(ts: Column) -> Column:
    """HHMMSS as a whole number."""
    return (F.hour(ts) * 10000 + F.minute(ts) * 100 + F.second(ts)).cast("long")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 in the session's time zone, which is to be UTC."""
    return F.unix_timestamp(ts)


TRIP_ATTRIBUTES = ("pickup_time", "pickup_date", "PULocationID", "dropoff_date", "dropoff_time", "DOLocationID")


def trip_axes(df: DataFrame, pickup: str = "tpep_pickup_datetime", dropoff: str = "tpep_dropoff_datetime") -> DataFrame:
    """Trips with date, time and epoch axes of both ends, projected to nine columns."""
    out = df
    for name, col in (("pickup", F.to_timestamp(pickup)), ("dropoff", F.to_timestamp(dropoff))):
        out = out.withColumns({f"{name}_date": date_number(col), f"{name}_time": time_number(col), f"{name}_datetime": epoch_seconds(col)})
    return out.select("pickup_date", "pickup_time", "pickup_datetime", "dropoff_date", "dropoff_time", "dropoff_datetime", "PULocationID", "DOLocationID", "trip_distance")


def trip_dimensions(n: int) -> list[str]:
    """Predicate attributes of the n-dimensional trip set, 1 to 6."""
    return [TRIP_ATTRIBUTES[0]] if n == 1 else [TRIP_ATTRIBUTES[1], TRIP_ATTRIBUTES[0], *TRIP_ATTRIBUTES[2:n]]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, standard deviation, min and max of each column, one row a column; one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


# writers


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_columns(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet; by stratum where readers will want to skip strata."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


# tables of the test data as numeric axes (key, p..., t)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, p = customer, t = whole price, f = 1 for finished orders."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").alias("p"), F.round("o_totalprice").cast("long").alias("t"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("long").alias("f")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, d = date, p = time of day, s = epoch seconds, t = value in hundredths."""
    ts = F.col("ts")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("key"), date_number(ts).alias("d"), time_number(ts).alias("p"), epoch_seconds(ts).alias("s"), F.round(F.col("value") * 100).cast("long").alias("t")
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, p = part, s = supplier, d = ship date, t = whole price."""
    day = date_number(F.col("l_shipdate"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", day).alias("key"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), day.alias("d"), F.round("l_extendedprice").cast("long").alias("t")
    )
