"""Series in and out: wide tables, JSON, forecasting sets, score tables, result files."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import join_on
from tidemark.functions.timeunits import Granularity, frequency_granularity, micros, parse_granularity, step_from, to_int_scale
from tidemark.operators.ordered import OrderedRows
from tidemark.operators.series import TS, VALUE


def to_wide(df: DataFrame, key: str, names: Sequence[str], time_col: str = "time", as_timestamp: bool = False) -> DataFrame:
    """One row per time, one column per listed series; time as timestamp or integer seconds."""
    if time_col in names:
        raise ValueError(f"a series is already called {time_col!r}")
    wide = df.groupBy(TS).pivot(key, list(names)).agg(F.first(VALUE))
    at = F.col(TS) if as_timestamp else to_int_scale(TS)
    return wide.select(at.alias(time_col), *[F.col(f"`{n}`") for n in names])


_POINTS = "array<struct<ts:timestamp_ntz,value:double>>"


def to_json_rows(df: DataFrame, keys: Sequence[str], gran: str | Granularity, t0: str = "1970-01-01", unit: str = "second", rows_per_part: int = 100_000) -> DataFrame:
    """JSON texts of every series in ``part``s of at most ``rows_per_part`` rows; ``parts`` tells how many belong together.

    One text can't hold a series of any length, so long ones have several whatever the setting.
    """
    gran = parse_granularity(gran)
    rows = OrderedRows(df.select(*keys, TS, VALUE), keys, [TS]).position("_i", start=0).total(_n=F.count(F.lit(1))).frame()
    parts = rows.groupBy(*keys, F.floor(F.col("_i") / rows_per_part).cast("int").alias("part"), F.ceil(F.col("_n") / rows_per_part).cast("int").alias("parts"))
    points = parts.agg(F.array_sort(F.collect_list(F.struct(TS, VALUE))).alias("points"))
    body = F.struct(
        F.transform("points", lambda p: p[TS].cast("string")).alias("time_array"), F.transform("points", lambda p: p[VALUE]).alias("values"),
        F.struct(*[F.col(k).cast("string").alias(k) for k in keys]).alias("key") if keys else F.struct(F.lit("").alias("all")).alias("key"),
        F.lit(t0).alias("unixtime_t0"), F.lit(unit).alias("unixtime_unit"), F.lit(json.dumps(gran.to_dict())).alias("granularity"),
    )
    return points.select(*keys, "part", "parts", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def from_json_rows(df: DataFrame, keys: Sequence[str], column: str = "json") -> DataFrame:
    """Series rows of JSON texts written by ``to_json_rows``; keys come back as strings. A series of which parts are
    missing raises when read."""
    if {"part", "parts", *keys} <= set(df.columns):
        seen = df.groupBy(*keys).agg((F.count_distinct("part") < F.max("parts")).alias("_cut"))
        checked = join_on(df, seen, list(keys)) if keys else df.crossJoin(F.broadcast(seen))  # one row without keys
        df = checked.withColumn(column, F.when(F.col("_cut"), F.raise_error(F.lit("parts of a series are missing")).cast("string")).otherwise(F.col(column)))
    key = ", ".join(f"`{k}`: string" for k in keys) or "`all`: string"
    schema = f"time_array array<string>, `values` array<double>, key struct<{key}>, granularity string"
    parsed = df.select(F.from_json(column, schema).alias("_j"))
    rows = parsed.select("_j.key", F.explode(F.arrays_zip("_j.time_array", "_j.values")).alias("_p"))
    return rows.select(*[F.col(f"key.{k}").alias(k) for k in keys], F.col("_p.time_array").cast("timestamp_ntz").alias(TS), F.col("_p.values").alias(VALUE))


def json_granularity(df: DataFrame, column: str = "json") -> DataFrame:
    text = F.get_json_object(column, "$.granularity")
    return df.select("*", F.get_json_object(text, "$.kind").alias("kind"), F.get_json_object(text, "$.n").cast("long").alias("n"))


# --- wide forecasting sets -------------------------------------------------------------------------

# The two layouts of start dates (12-hour clock without a day half).
START_FORMATS = ("dd-MM-yy hh:mm", "yyyy-MM-dd hh:mm:ss")


def parse_start(text: Column) -> Column:
    """First layout that fits; a date that fits none raises when read. Hour 12 without a day half is midnight."""
    tries = [F.try_to_timestamp(F.concat(text, F.lit(" AM")), F.lit(f + " a")) for f in START_FORMATS]
    found = F.coalesce(*tries)
    message = F.concat(F.lit("cannot parse start time "), F.coalesce(text, F.lit("null")))
    return F.coalesce(found, F.raise_error(message).cast("timestamp")).cast("timestamp_ntz")


def wide_to_long(df: DataFrame, id_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Wide rows padded with nulls or NaN to (id, pos, value), positions from 0 after dropping the gaps."""
    values = F.filter(F.array(*[F.col(c).cast("double") for c in value_cols]), lambda v: v.isNotNull() & ~F.isnan(v))
    return df.select(F.col(id_col).alias("id"), F.posexplode(values).alias("pos", VALUE))


def array_to_long(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    values = F.filter(F.col(array_col).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v))
    return df.select(F.col(id_col).alias("id"), F.posexplode(values).alias("pos", VALUE))


def read_forecast_set(spark: SparkSession, train_csv: str, test_csv: str, info_csv: str, frequency: str, max_series: int | None = None) -> DataFrame:
    """Train and test files of one frequency as a long series table with ``split``.

    Timestamps run from the start date of the info table in steps of the frequency; test positions
    follow the last train position. ``max_series`` keeps the first ids in order (a caller's option).
    """
    gran = frequency_granularity(frequency)
    info = spark.read.option("header", True).csv(info_csv).select(F.col("M4id").alias("id"), F.col("StartingDate").alias("_start"))
    longs = []
    for split, path in (("train", train_csv), ("test", test_csv)):
        wide = spark.read.option("header", True).csv(path)
        longs.append(wide_to_long(wide, wide.columns[0], wide.columns[1:]).withColumn("split", F.lit(split)))
    if max_series is not None:
        ids = longs[0].select("id").distinct().orderBy("id").limit(max_series)
        longs = [d.join(ids, "id", "left_semi") for d in longs]
    train, test = longs
    counts = train.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    test = test.join(counts, "id").withColumn("pos", (F.col("pos") + F.col("_n")).cast("int")).drop("_n")
    rows = train.unionByName(test).join(info, "id")
    return rows.select("id", step_from(parse_start(F.col("_start")), F.col("pos"), gran).alias(TS), VALUE, "split")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score table: model, dataset, idx, score, label."""
    return spark.read.parquet(path).select("model", "dataset", F.col("idx").cast("long").alias("idx"), F.col("score").cast("double").alias("score"), F.col("label").cast("int").alias("label"))


def append_snapshot(df: DataFrame, path: str, run_id: str, metric: str) -> None:
    """Training rows of a run, kept for audit."""
    df.withColumns({"run_id": F.lit(run_id), "metric": F.lit(metric)}).write.mode("append").partitionBy("run_id").parquet(path)
