"""Robust scale estimates about zero, per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clean
from tidemark.operators.ordered import HotKeys, OrderedRows, exact_quantiles, find_hot
from tidemark.operators.series import VALUE

# Third quartile of the standard normal; tuning constant of the Huber estimate and the
# expected value of min(x², c²) under the standard normal.
NORMAL_Q3 = 0.6744897501960817
HUBER_C = 1.5
HUBER_GAMMA = 0.7784652161744701
MIN_SAMPLE = 10


def mad_scale(df: DataFrame, keys: Sequence[str], value: str = VALUE, hot: HotKeys | None = None, zeros: DataFrame | None = None) -> DataFrame:
    """Median absolute deviation about 0, scaled to the standard deviation of a normal.

    ``zeros (keys, zeros)`` counts values of zero that have no row.
    """
    rows = df.select(*keys, F.abs(clean(value)).alias("_a"))
    hot = find_hot(df, keys) if hot is None else hot
    if zeros is None:
        out = exact_quantiles(rows, keys, "_a", {"scale": 0.5}, hot)
    else:
        counted = _with_zeros(rows.where("_a is not null"), keys, "_a", zeros)
        out = exact_quantiles(counted, keys, "_a", {"scale": 0.5}, hot, weight="_m")
    return out.withColumn("scale", F.col("scale") / F.lit(NORMAL_Q3))


def _with_zeros(rows: DataFrame, keys: Sequence[str], value: str, zeros: DataFrame) -> DataFrame:
    """Equal values counted together as ``_m``, with the zeros that have no row."""
    one = rows.select(*keys, value, F.lit(1).cast("long").alias("_m"))
    implied = zeros.where("zeros > 0").select(*keys, F.lit(0.0).alias(value), F.col("zeros").cast("long").alias("_m"))
    return one.unionByName(implied).groupBy(*keys, value).agg(F.sum("_m").alias("_m"))


def huber_scale(df: DataFrame, keys: Sequence[str], value: str = VALUE, min_sample: int = MIN_SAMPLE, hot: HotKeys | None = None,
                zeros: DataFrame | None = None) -> DataFrame:
    """Huber's proposal-2 scale about 0: the s with ``s² = Σ_{a ≤ cs} a² / (nγ - (n-k)c²)``.

    ``a`` are the absolute values and ``k`` counts those up to ``c·s``. Over the sorted values every
    k gives one candidate s; the solution is the one whose ``c·s`` falls between value k and value
    k+1, so no iteration is needed. Keys with fewer than ``min_sample`` values drop out; a key
    without a solution (most values zero) gets a null scale. ``zeros (keys, zeros)`` counts values of zero that have
    no row.
    """
    hot = find_hot(df, keys) if hot is None else hot
    rows = df.select(*keys, F.abs(clean(value)).alias("a")).where("a is not null")
    # equal values are counted together: only then is the order total and "next value" well defined
    counted = rows.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("_m")) if zeros is None else _with_zeros(rows, keys, "a", zeros)
    ordered = OrderedRows(counted, keys, ["a"], hot)
    ordered = ordered.running_sum(_k="_m", _ss=F.col("_m") * F.col("a") * F.col("a")).total(_n=F.sum("_m"))
    ranked = ordered.previous(reverse=True, _next="a").frame()
    room = F.col("_n") * F.lit(HUBER_GAMMA) - (F.col("_n") - F.col("_k")) * F.lit(HUBER_C**2)
    s = F.when((room > 0) & (F.col("_ss") > 0), F.sqrt(F.col("_ss") / F.when(room > 0, room)))
    limit = F.lit(HUBER_C) * s
    fits = (F.col("a") <= limit) & (F.col("_next").isNull() | (limit < F.col("_next")))
    out = ranked.groupBy(*keys).agg(F.max("_n").alias("n"), F.min(F.when(fits, s)).alias("scale"))
    return out.where(F.col("n") >= min_sample)
