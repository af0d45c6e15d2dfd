"""The library's inputs made of the given tables: catalog, series, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeunits import trunc_grain
from tidemark.operators.scores import index_rows
from tidemark.sources.catalog import Catalog, Metric, Table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def catalog(spark: SparkSession, sf: str) -> Catalog:
    """Orders and events as facts; customer, nation and region as a chain of dimensions."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("dim_priority"), F.col("o_orderstatus").alias("dim_status"), F.col("o_totalprice").alias("m_total"))
    events = table(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.col("event_type").alias("dim_event_type"), F.col("value").alias("m_value"))
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("dim_segment"))
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("nation_id"), F.col("n_regionkey").alias("region_id"), F.col("n_name").alias("dim_nation"))
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("dim_region"))
    return Catalog(
        spark,
        [Table.from_frame("fct_orders", "fact", orders), Table.from_frame("fct_events", "fact", events),
         Table.from_frame("dim_customers", "dim", customer, ("nation_id",)), Table.from_frame("dim_nations", "dim", nation, ("region_id",)),
         Table.from_frame("dim_regions", "dim", region)],
        [Metric("order_amount", "SUM(m_total)"), Metric("num_orders", "COUNT(order_id)"), Metric("num_customers", "COUNT(DISTINCT customer_id)"),
         Metric("num_events", "COUNT(event_id)"), Metric("event_value", "SUM(m_value)")],
    )


def hourly(spark: SparkSession, sf: str, agg: str = "sum(value)") -> DataFrame:
    """Hourly series per event type (rounded so that sums do not depend on the order of addition)."""
    return table(spark, sf, "events").groupBy("event_type", trunc_grain("ts", "hour").alias("ts")).agg(
        F.round(F.expr(agg).cast("double"), 4).alias("value"))


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), trunc_grain("o_orderdate", "day").alias("ts")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("value"))


def user_series(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")


def user_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score = value, label = error events, one series per user in time order."""
    rows = table(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"))
    return index_rows(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "idx", "score", "label")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines; all double columns by default."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})
