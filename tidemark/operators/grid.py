"""Time grids of series: ranges, gaps, filling, resampling, splits, granularity, index checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import timeunits as U
from tidemark.functions.numeric import clean, gcd2, join_on
from tidemark.functions.timeunits import Granularity, grid_points, micros, parse_granularity, step_from, steps_between
from tidemark.operators.ordered import HotKeys, OrderedRows, find_hot
from tidemark.operators.series import TS, VALUE, same_rows

_CHUNK = 1_000  # grid steps per generated row, so that one long series is spread over tasks


def time_range(spark, start=None, end=None, periods: int | None = None, gran: str | Granularity = "day") -> DataFrame:
    """Timestamps from two of start, end and periods."""
    gran = parse_granularity(gran)
    lo = F.lit(start).cast("timestamp_ntz") if start is not None else None
    hi = F.lit(end).cast("timestamp_ntz") if end is not None else None
    if (start is None) + (end is None) + (periods is None) != 1:
        raise ValueError("give exactly two of start, end and periods")
    if periods is not None:
        steps = spark.range(periods)
        if lo is not None:
            first = step_from(lo, F.lit(0), gran) if gran.kind != "month_end" else lo
            return steps.select(step_from(first, F.col("id"), gran).alias(TS))
        return steps.select(step_from(hi, F.col("id") - F.lit(periods - 1), gran).alias(TS))
    bounds = spark.range(1).select(lo.alias("_lo"), hi.alias("_hi"))
    return _expand(bounds, [], gran)


def _expand(bounds: DataFrame, keys: Sequence[str], gran: Granularity) -> DataFrame:
    """Grid rows between ``_lo`` and ``_hi`` per key, generated in chunks and spread over tasks."""
    steps = steps_between(F.col("_lo"), F.col("_hi"), gran)
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(steps / _CHUNK)))
    parts = bounds.where(F.col("_lo").isNotNull()).select(*keys, "_lo", "_hi", steps.alias("_n"), chunks.alias("_c"))
    # the small chunk table is spread before it grows, else a few tasks would make all grid rows
    parts = parts.repartition(int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_c")
    first = F.col("_c") * _CHUNK
    ids = F.sequence(first, F.least(first + _CHUNK - 1, F.col("_n")))
    rows = parts.select(*keys, "_lo", "_hi", F.explode(ids).alias("_k"))
    return rows.select(*keys, "_hi", step_from(F.col("_lo"), F.col("_k"), gran).alias(TS)).where(F.col(TS) <= F.col("_hi")).drop("_hi")


def grid(df: DataFrame, keys: Sequence[str], gran: str | Granularity) -> DataFrame:
    """Full grid of every series between its first and last time."""
    bounds = df.groupBy(*keys).agg(F.min(TS).alias("_lo"), F.max(TS).alias("_hi"))
    return _expand(bounds, keys, parse_granularity(gran))


def missing_times(df: DataFrame, keys: Sequence[str], gran: str | Granularity) -> DataFrame:
    """Grid times a series does not have."""
    return join_on(grid(df, keys, gran), df.select(*keys, TS), [*keys, TS], "left_anti")


def make_dense(df: DataFrame, keys: Sequence[str], gran: str | Granularity, fill: float | None = None) -> DataFrame:
    """The series with missing grid rows added; added rows get ``fill``, present values stay."""
    present = df.select(*keys, TS, VALUE).withColumn("_there", F.lit(True))
    out = join_on(grid(df, keys, gran), present, [*keys, TS], "left")
    if fill is not None:
        out = out.withColumn(VALUE, F.when(F.col("_there").isNull(), F.lit(float(fill))).otherwise(F.col(VALUE)))
    return out.drop("_there")


def fill_values(df: DataFrame, value: float) -> DataFrame:
    return df.withColumn(VALUE, F.coalesce(clean(VALUE), F.lit(float(value))))


def bounds(df: DataFrame, keys: Sequence[str], gran: str | Granularity) -> DataFrame:
    """First, last and next timestamp of every series."""
    gran = parse_granularity(gran)
    out = df.groupBy(*keys).agg(F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"))
    return out.withColumn("next_ts", step_from(F.col("last_ts"), F.lit(1), gran))


def future(
    df: DataFrame, keys: Sequence[str], gran: str | Granularity, steps: int, past: int = 0, hot: HotKeys | None = None
) -> DataFrame:
    """Index of the next ``steps`` grid times, with the last ``past`` observed times in front."""
    gran = parse_granularity(gran)
    if steps > 0 and not keys and df.isEmpty():
        raise ValueError("an empty index has no future")
    last = df.groupBy(*keys).agg(F.max(TS).alias("_lo")).where(F.col("_lo").isNotNull())
    if steps > 0:
        ahead = last.select(*keys, "_lo", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_k"))
        out = ahead.select(*keys, step_from(F.col("_lo"), F.col("_k"), gran).alias(TS))
    else:
        out = last.select(*keys, F.col("_lo").alias(TS)).limit(0)
    if past > 0:
        recent = OrderedRows(df.select(*keys, TS), keys, [TS], hot).position("_j", reverse=True).frame()
        out = recent.where(F.col("_j") <= past).drop("_j").unionByName(out)
    return out


def resample(df: DataFrame, keys: Sequence[str], delta: str | Granularity, how: str = "avg") -> DataFrame:
    """Coarser steps by a reducer that skips missing values (avg, max, min, sum, first by time …)."""
    gran = parse_granularity(delta)
    if gran.kind == "fixed":
        start = U.from_micros(micros(TS) - F.pmod(micros(TS), F.lit(gran.n)))
    else:
        codes = {("month", 1): "MS", ("month", 3): "QS", ("month", 12): "YS", ("month_end", 1): "M", ("month_end", 3): "Q", ("month_end", 12): "Y"}
        start = U.round_calendar(TS, codes[(gran.kind, gran.n)])
    reducers = {"avg": F.avg, "mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}
    return df.groupBy(*keys, start.alias(TS)).agg(reducers[how](clean(VALUE)).alias(VALUE))


def temporal_split(df: DataFrame, keys: Sequence[str], fraction: float, hot: HotKeys | None = None) -> DataFrame:
    """``split`` = train for the first ``floor(fraction · n)`` rows of a series, else valid."""
    rows = OrderedRows(df, keys, [TS], hot).position("_i").total(_n=F.count(F.lit(1))).frame()
    train = F.col("_i") <= F.floor(F.lit(float(fraction)) * F.col("_n"))
    return rows.withColumn("split", F.when(train, "train").otherwise("valid")).drop("_i", "_n")


# --- granularity ---------------------------------------------------------------------------

def _fold_gcd(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gcds per run of equal keys over one partition; holds one running key, emits it when the key changes."""
    key, value, names = None, None, None
    for batch in batches:
        if batch.empty:
            continue
        names = [c for c in batch.columns if c != "_key"]
        keys, gaps = batch["_key"].to_numpy(object), batch[names].to_numpy(np.int64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        done = []
        for k, g in zip(keys[starts], np.gcd.reduceat(gaps, starts, axis=0)):
            if k == key:
                value = np.gcd(value, g)
            else:
                if key is not None:
                    done.append((key, *value))
                key, value = k, g
        if done:
            yield pd.DataFrame(done, columns=["_key", *names])
    if key is not None:
        yield pd.DataFrame([(key, *value)], columns=["_key", *names])


def _key_text(keys: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("")


def gap_gcd(gaps: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Greatest common divisors of long columns per key; the key comes back as the text ``_key``.

    The rows come from an ordered operator, a key's rows one after the other, so each task folds them as they are;
    only one row per key and task is shuffled (more, and still right, where a key's rows are scattered) and folded by a
    native expression.
    """
    names = list(columns)
    rows = gaps.select(_key_text(keys).alias("_key"), *[F.col(c).cast("long").alias(c) for c in names])
    partial = rows.mapInPandas(_fold_gcd, "_key string, " + ", ".join(f"`{c}` long" for c in names))
    fold = lambda c: F.aggregate(F.collect_set(c), F.lit(0).cast("long"), lambda a, b: gcd2(a, b)).alias(c)
    return partial.groupBy("_key").agg(*[fold(c) for c in names])


def infer_granularity(df: DataFrame, keys: Sequence[str], hot: HotKeys | None = None) -> DataFrame:
    """Smallest grid that holds every time of a series: columns ``kind`` and ``n`` (see Granularity).

    Month-like grids are tried where all gaps are at least 27 days, day grids from 23 hours; else
    the greatest common divisor of the gaps in microseconds. Series of one point take the unit of
    their smallest non-zero clock field.
    """
    hot = find_hot(df, keys) if hot is None else hot
    ts, prev = F.col(TS), F.col("_prev")
    rows = OrderedRows(df.select(*keys, TS), keys, [TS], hot).previous(_prev=TS).total(_first=F.min(TS)).frame()
    months = lambda t: (F.year(ts) - F.year(t)) * 12 + F.month(ts) - F.month(t)
    rows = rows.withColumns({"_gap": micros(ts) - micros(prev), "_mgap": months(prev)})
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_gap").alias("_min"), F.max(TS).alias("_one"),
        F.bool_and(step_from(F.col("_first"), months(F.col("_first")), Granularity("month", 1)) == ts).alias("_month"),
        F.bool_and(F.last_day(ts) == ts.cast("date")).alias("_end"),
    )
    divisors = gap_gcd(rows.where(F.col("_gap").isNotNull()), keys, ["_gap", "_mgap"]).withColumnsRenamed({"_gap": "_g", "_mgap": "_mg"})
    out = stats.withColumn("_key", _key_text(keys)).join(divisors, "_key", "left")
    wide = F.col("_min") >= F.lit(27 * U.DAY)
    use_end = wide & F.col("_end")
    use_month = wide & ~F.col("_end") & F.col("_month")
    single = (
        F.when(F.second("_one") > 0, U.SECOND).when(F.minute("_one") > 0, U.MINUTE).when(F.hour("_one") > 0, U.HOUR).otherwise(U.DAY)
    )
    kind = F.when(use_end, "month_end").when(use_month, "month").otherwise("fixed")
    n = F.when(F.col("_n") == 1, single).when(use_end | use_month, F.col("_mg")).otherwise(F.col("_g")).cast("long")
    return out.select(*keys, F.when(F.col("_n") == 1, "fixed").otherwise(kind).alias("kind"), n.alias("n"))


def infer_granularity_recent(df: DataFrame, keys: Sequence[str], points: int = 10, hot: HotKeys | None = None) -> DataFrame:
    """Vote over the gaps between the last points; ties go to the newest gap."""
    rows = OrderedRows(df.select(*keys, TS), keys, [TS], hot).position("_j", reverse=True).previous(_prev=TS).frame()
    recent = rows.where((F.col("_j") < points) & F.col("_prev").isNotNull())  # at most points-1 rows per key
    ts, prev = F.col(TS), F.col("_prev")
    gap = micros(ts) - micros(prev)
    months = (F.year(ts) - F.year(prev)) * 12 + F.month(ts) - F.month(prev)
    wide = gap >= F.lit(27 * U.DAY)
    both_ends = (F.last_day(ts) == ts.cast("date")) & (F.last_day(prev) == prev.cast("date"))
    on_month = step_from(prev, months, Granularity("month", 1)) == ts
    kind = F.when(wide & both_ends, "month_end").when(wide & on_month, "month").otherwise("fixed")
    n = F.when(kind == "fixed", gap).otherwise(months).cast("long")
    votes = recent.groupBy(*keys, kind.alias("kind"), n.alias("n")).agg(F.count(F.lit(1)).alias("_v"), F.min("_j").alias("_new"))
    best = F.max_by(F.struct("kind", "n"), F.struct("_v", -F.col("_new"))).alias("_b")
    return votes.groupBy(*keys).agg(best).select(*keys, "_b.kind", "_b.n")


# --- checks and comparisons ----------------------------------------------------------------

def index_problems(
    df: DataFrame, keys: Sequence[str], gran: str | Granularity, t0: str = "1970-01-01", unit: str = "second"
) -> DataFrame:
    """Per series: duplicate times, duplicate positions on the integer scale, times off the grid."""
    gran = parse_granularity(gran)
    cells = df.withColumn("_i", U.to_int_scale(TS, t0, unit))
    counted = cells.groupBy(*keys, TS, "_i").agg(F.count(F.lit(1)).alias("_m"))
    per_bucket = counted.groupBy(*keys, "_i").agg(F.sum("_m").alias("_m"), F.count(F.lit(1)).alias("_d"))
    dups = per_bucket.groupBy(*keys).agg(
        F.sum(F.col("_m") - F.col("_d")).alias("duplicate_times"), F.sum(F.col("_d") - 1).alias("duplicate_positions")
    )
    first = df.groupBy(*keys).agg(F.min(TS).alias("_lo"))
    placed = join_on(counted.select(*keys, TS).distinct(), first, list(keys))
    off = placed.groupBy(*keys).agg(F.sum((~U.on_grid(F.col("_lo"), F.col(TS), gran)).cast("long")).alias("off_grid"))
    return join_on(dups, off, list(keys))


def _span(df: DataFrame) -> Column:
    return df.agg(F.min(TS).alias("lo"), F.max(TS).alias("hi"))


def starts_before(a: DataFrame, b: DataFrame) -> bool:
    """True if the first time of ``a`` lies before the first of ``b`` (false if either is empty)."""
    x, y = _span(a).first(), _span(b).first()
    return x["lo"] is not None and y["lo"] is not None and x["lo"] < y["lo"]


def strictly_before(a: DataFrame, b: DataFrame) -> bool:
    x, y = _span(a).first(), _span(b).first()
    return x["hi"] is not None and y["lo"] is not None and x["hi"] < y["lo"]


def same_scale(a: DataFrame, b: DataFrame, gran_a: str | Granularity, gran_b: str | Granularity,
               scale_a: tuple = ("1970-01-01", "second"), scale_b: tuple = ("1970-01-01", "second")) -> bool:
    """Equal zero, unit and granularity, and grids that meet."""
    ga, gb = parse_granularity(gran_a), parse_granularity(gran_b)
    if ga != gb or scale_a != scale_b:
        return False
    x, y = _span(a).first(), _span(b).first()
    if x["lo"] is None or y["lo"] is None:
        return True
    if ga.kind == "fixed":
        delta = abs(y["lo"] - x["lo"])
        return (delta.days * U.DAY + delta.seconds * U.SECOND + delta.microseconds) % ga.n == 0
    if not a.select(TS).join(b.select(TS), TS, "left_semi").isEmpty():
        return True
    (first, second) = (x, y) if x["lo"] < y["lo"] else (y, x)
    anchor = first["hi"] if second["lo"] > first["hi"] else first["lo"]
    spark = a.sparkSession
    points = time_range(spark, anchor, second["lo"], gran=ga)
    return not points.where(F.col(TS) == F.lit(second["lo"])).isEmpty()


def same_times(a: DataFrame, b: DataFrame) -> bool:
    return same_rows(a.select(TS), b.select(TS))


def same_shape(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    """Same series and same number of rows per series."""
    count = lambda d: d.groupBy(*keys).count()
    return same_rows(count(a), count(b))


def run_bounds(spark, now, start: str, end: str | None = None) -> DataFrame:
    """Time range of a run: ``start``/``end`` as an age ('14 days', '2h') or as a timestamp.

    One row with ``start_ts`` and ``end_ts``; ``now`` is an argument so that a run can be replayed.
    """
    at = F.lit(now).cast("timestamp_ntz")

    def bound(text: str | None) -> Column:
        if text is None:
            return at
        try:
            gran = parse_granularity(text)
            return step_from(at, F.lit(-1), gran)
        except ValueError:
            number = text.strip().rstrip("s").strip()
            if number in ("0", ""):
                return at
            return F.lit(text).cast("timestamp_ntz")

    return spark.range(1).select(bound(start).alias("start_ts"), bound(end).alias("end_ts"))
