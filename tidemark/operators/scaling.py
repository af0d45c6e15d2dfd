"""Scaling of features and scores, seeded jitter, predictions and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import join_on


def scale_unit(value: Column, lo: Column, hi: Column) -> Column:
    """Min-max scaling; a zero range divides by one."""
    span = hi - lo
    return (value - lo) / F.when(span == 0, F.lit(1.0)).otherwise(span)


def min_max_fit(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the minimum and maximum of every feature column."""
    aggs = [f(c).alias(f"{p}_{c}") for c in columns for f, p in ((F.min, "lo"), (F.max, "hi"))]
    return train.agg(*aggs)


def min_max_scale(train: DataFrame, other: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Scale both tables with the range of ``train``; all other columns are carried unchanged."""
    fit = min_max_fit(train, columns)
    fit = fit.select(F.struct(*fit.columns).alias("fit")).scalar()  # a scalar subquery: one row by construction

    def apply(df: DataFrame) -> DataFrame:
        scaled = {c: scale_unit(F.col(c), fit[f"lo_{c}"], fit[f"hi_{c}"]) for c in columns}
        return df.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])

    return apply(train), apply(other)


def scale_scores(df: DataFrame, keys: Sequence[str], score: str = "score", flip: bool = False) -> DataFrame:
    """Scores to [0, 1] per key; ``flip`` for scores where low means anomalous."""
    ranges = df.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = scale_unit(F.col(score), F.col("_lo"), F.col("_hi"))
    out = join_on(df, ranges, list(keys), "left")
    return out.withColumn(score, F.lit(1.0) - scaled if flip else scaled).drop("_lo", "_hi")


def uniform_hash(*columns: str, seed: int = 0) -> Column:
    """A repeatable uniform number in [0, 1) from column values, the same under any partitioning and in any engine that
    has md5: the first 52 bits of the hash of ``value:value:...:seed``."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def jitter_scores(df: DataFrame, ids: Sequence[str], score: str = "score", scale: float = 0.1, seed: int = 0) -> DataFrame:
    """Multiply scores by a uniform factor in [1 - scale, 1 + scale]."""
    noise = uniform_hash(*ids, seed=seed) * F.lit(2 * scale) - F.lit(scale)
    return df.withColumn(score, F.col(score) * (F.lit(1.0) + noise))


def predict(df: DataFrame, threshold: float | Column, score: str = "score", out: str = "pred", direction: str = ">") -> DataFrame:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    test = {">": F.col(score) > limit, "<": F.col(score) < limit, ">=": F.col(score) >= limit}[direction]
    return df.withColumn(out, F.coalesce(test, F.lit(False)).cast("int"))


def outcome(df: DataFrame, pred: str = "pred", label: str = "label", out: str = "outcome") -> DataFrame:
    """TP, FP, FN or TN per row."""
    p, a = F.col(pred) == 1, F.col(label) == 1
    return df.withColumn(out, F.when(p & a, "TP").when(p & ~a, "FP").when(~p & a, "FN").otherwise("TN"))


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int | None, seed: int = 42) -> DataFrame:
    """Rows of ``n`` series picked by a seeded shuffle of the distinct keys (a benchmark option)."""
    if n is None:
        return df
    picked = df.select(*keys).distinct().orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)
    return join_on(df, picked, list(keys), "left_semi")
