"""Anomalies from ensembles of lower and upper bounds, and a linear producer of such bounds.

Bounds table: time ``ts``, ``entity``, ``estimator``, ``value``, ``lower``, ``upper``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import join_on
from tidemark.operators.ordered import exact_quantiles
from tidemark.operators.series import TS, align_columns
from tidemark.session import materialize


def outside_share(bounds: DataFrame, by: Sequence[str] = (TS,)) -> DataFrame:
    """Score per time: share of (entity, estimator) cells whose value lies outside its bounds."""
    out = ((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).cast("double")
    return bounds.groupBy(*by).agg(F.avg(F.coalesce(out, F.lit(0.0))).alias("score"))


def mean_bounds_verdict(bounds: DataFrame, direction: str | None = None, by: Sequence[str] = (TS, "entity")) -> DataFrame:
    """Bounds averaged over estimators and tested in the given direction (both by default)."""
    cells = bounds.groupBy(*by).agg(F.max("value").alias("value"), F.avg("lower").alias("lower"), F.avg("upper").alias("upper"))
    down, up = F.col("value") < F.col("lower"), F.col("value") > F.col("upper")
    test = {"down": down, "up": up}.get(direction, down | up)
    return cells.withColumn("is_anomaly", F.coalesce(test, F.lit(False)))


def pinball(q: float, value: Column, estimate: Column) -> Column:
    e = value - estimate
    return F.greatest(F.lit(q) * e, F.lit(q - 1) * e)


def pinball_loss(bounds: DataFrame, delta: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean pinball loss of the upper bound at 1-delta plus the lower bound at delta."""
    loss = pinball(1 - delta, F.col("value"), F.col("upper")) + pinball(delta, F.col("value"), F.col("lower"))
    return bounds.groupBy(*by).agg(F.avg(loss).alias("loss"))


def feature_subsets(entities: DataFrame, estimators: int, size: int, seed: int = 0) -> DataFrame:
    """``size`` entities for every estimator, drawn by hash order; columns estimator, slot, entity."""
    drawn = entities.select("entity").distinct().withColumn("estimator", F.explode(F.sequence(F.lit(0), F.lit(estimators - 1))))
    drawn = drawn.withColumn("_h", F.xxhash64("entity", "estimator", F.lit(seed))).withColumn("_b", F.pmod(F.col("_h"), F.lit(64)))
    near = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("estimator", "_b").orderBy("_h", "entity"))).where(F.col("_r") <= size)
    # at most 64 · size rows per estimator are left
    slot = F.row_number().over(Window.partitionBy("estimator").orderBy("_h", "entity"))
    return near.withColumn("slot", slot).where(F.col("slot") <= size).select("estimator", "slot", "entity")


def _axes(size: int, latent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            cov = np.array(row.cov, float).reshape(size, size)
            values, vectors = np.linalg.eigh(cov)
            out.append((row.estimator, vectors[:, np.argsort(values)[::-1][:latent]].T.tolist()))
        return pd.DataFrame(out, columns=["estimator", "axes"])

    return lambda batches: (run(b) for b in batches)


def _latent(df: DataFrame, members: DataFrame, latent: int) -> DataFrame:
    """Latent scores ``z`` per (time, estimator). A member without a value at a time counts as its training mean."""
    rows = df.select(TS, "entity", "value").join(members, "entity")  # size rules the join strategy
    part = [F.sum(F.element_at("axis", i + 1) * (F.col("value") - F.col("centre"))).alias(f"z{i}") for i in range(latent)]
    return rows.groupBy(TS, "estimator").agg(*part).select(TS, "estimator", F.array(*[f"z{i}" for i in range(latent)]).alias("z"))


def _cells(df: DataFrame, z: DataFrame) -> DataFrame:
    return df.select(TS, "entity", "value").join(z, TS)


def _fitted() -> Column:
    return F.col("centre") + F.aggregate(F.zip_with("slope", "z", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def fit_bounds(df: DataFrame, estimators: int = 100, max_features: int = 3, latent: int = 2, delta: float = 0.05, seed: int = 0) -> DataFrame:
    """Linear ensemble: every estimator rebuilds all entities from the leading components of a few drawn ones.

    Result per (estimator, entity): training mean, slopes on the latent scores, the delta and 1-delta quantiles of the
    residual, and for drawn entities their share in the scores (``axis``). An estimator draws ``max_features`` entities,
    all of them where there are fewer. Covariances and slopes are sums over all tasks; only one small matrix per
    estimator is decomposed. Raises without entities, since nothing could be scored.
    """
    means = materialize(df.groupBy("entity").agg(F.avg("value").alias("centre")).where(F.col("centre").isNotNull()), "means")
    size = min(max_features, means.count())
    if size == 0:
        raise ValueError("no entity has a value to fit bounds on")
    latent = min(latent, size)
    subsets = materialize(feature_subsets(means, estimators, size, seed).join(means, "entity"), "subsets")  # estimators × size rows
    rows = df.select(TS, "entity", "value").join(subsets, "entity")
    slots = [F.coalesce(F.max(F.when(F.col("slot") == i + 1, F.col("value") - F.col("centre"))), F.lit(0.0)).alias(f"v{i}") for i in range(size)]
    wide = rows.groupBy(TS, "estimator").agg(*slots)
    stats = wide.groupBy("estimator").agg(F.array(*[F.avg(F.col(f"v{i}") * F.col(f"v{j}")) for i in range(size) for j in range(size)]).alias("cov"))
    axes = stats.mapInPandas(_axes(size, latent), "estimator int, axes array<array<double>>")
    members = subsets.join(axes, "estimator").withColumn("axis", F.transform("axes", lambda a: F.element_at(a, F.col("slot")))).drop("axes")
    members = materialize(members, "members")
    cells = _cells(df, _latent(df, members, latent)).join(means, "entity")
    slope = [F.coalesce(F.try_divide(F.sum((F.col("value") - F.col("centre")) * F.col("z")[i]), F.sum(F.col("z")[i] * F.col("z")[i])), F.lit(0.0)) for i in range(latent)]
    slopes = materialize(cells.groupBy("estimator", "entity").agg(F.first("centre").alias("centre"), F.array(*slope).alias("slope")), "slopes")
    residuals = cells.drop("centre").join(slopes, ["estimator", "entity"]).select("estimator", "entity", (F.col("value") - _fitted()).alias("r"))
    q = exact_quantiles(residuals, ["estimator", "entity"], "r", {"q_low": delta, "q_high": 1 - delta})
    return slopes.join(q, ["estimator", "entity"]).join(members.select("estimator", "entity", "axis"), ["estimator", "entity"], "left")


def apply_bounds(df: DataFrame, model: DataFrame) -> DataFrame:
    """Bounds table of new observations under a fitted ensemble; entities it was not fitted on have none."""
    members = model.where(F.col("axis").isNotNull()).select("estimator", "entity", "centre", "axis")
    first = members.select(F.size("axis")).head()
    if first is None:
        raise ValueError("the ensemble has no members")
    limits = model.select("estimator", "entity", "centre", "slope", "q_low", "q_high")
    out = _cells(df, _latent(df, members, first[0])).join(limits, ["estimator", "entity"])
    return out.select(TS, "entity", "estimator", "value", (_fitted() + F.col("q_low")).alias("lower"), (_fitted() + F.col("q_high")).alias("upper"))


def score_aligned(df: DataFrame, model: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bounds of the entities that the ensemble knows, and a report ``entity, n, status`` of all others: values of an
    entity it was not fitted on (``not in the model``) and entities it was fitted on that sent none (``no values``),
    which count as their training mean in the scores."""
    known = model.select("entity").distinct()
    aligned, extra = align_columns(df, known, ["entity"], strict=False)
    added = join_on(df, extra, ["entity"], "left_semi").groupBy("entity").agg(F.count("value").alias("n")).withColumn("status", F.lit("not in the model"))
    silent = join_on(known, aligned.where(F.col("value").isNotNull()).select("entity").distinct(), ["entity"], "left_anti")
    missing = silent.select("entity", F.lit(0).cast("long").alias("n"), F.lit("no values").alias("status"))
    return apply_bounds(aligned, model), added.unionByName(missing)


def f1_loss(scored: DataFrame, keys: Sequence[str], step: float = 0.05) -> DataFrame:
    """Negated best grid F1 per trial."""
    from tidemark.operators.scores import best_f1_grid

    return best_f1_grid(scored, keys, step).select(*keys, (-F.col("f1")).alias("loss"))


def with_context(context: DataFrame, new: DataFrame, keys: Sequence[str], batch: int) -> DataFrame:
    """New rows with the last ``batch`` rows per key of the context in front; ``is_new`` marks the new."""
    from tidemark.operators.series import tail

    old = tail(context, keys, batch).withColumn("is_new", F.lit(False))
    return old.unionByName(new.withColumn("is_new", F.lit(True)))


def next_context(rows: DataFrame, keys: Sequence[str], batch: int) -> DataFrame:
    """The context to keep for the following batch: the last ``batch`` rows per key."""
    from tidemark.operators.series import tail

    return tail(rows.drop("is_new"), keys, batch)
