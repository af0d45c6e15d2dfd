"""Back-tests of forecasts per series and comparison of two back-tests."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import join_on
from tidemark.functions.trend import Options
from tidemark.operators.ordered import OrderedRows, exact_quantiles
from tidemark.operators.series import TS, VALUE, same_set
from tidemark.plans.forecast import fit, fit_forecast, forecast
from tidemark.session import materialize

# Metric columns of a back-test result, in order.
METRICS = (
    "mae_train", "mae_test", "smape_train", "smape_test", "ci_sz_train", "ci_sz_test", "ci_cov_train", "ci_cov_test",
    "ci_ordered_train", "ci_ordered_test", "calib_h_train", "calib_l_train", "calib_h_test", "calib_l_test",
)


def _measures() -> dict[str, Column]:
    y, p, up, lo = (F.col(c) for c in (VALUE, "yhat", "upper", "lower"))
    share = lambda test: test.cast("double")
    return {
        "mae": F.abs(y - p),
        "smape": 2 * F.try_divide(F.abs(y - p), F.abs(y) + F.abs(p)),  # 0/0 terms are null and skipped
        "ci_sz": F.when((up - lo).isNotNull(), F.greatest(up - lo, F.lit(0.0))),
        "ci_cov": share((y >= lo) & (y <= up)),
        "ci_ordered": share((p >= lo) & (p <= up)),
        "calib_h": share(y > up),
        "calib_l": share(y < lo),
    }


def interval_metrics(df: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """The seven measures on train and test rows, one row per series."""
    aggs = {}
    for name, measure in _measures().items():
        for part in ("train", "test"):
            aggs[f"{name}_{part}"] = F.avg(F.when(F.col(split) == part, measure))
    return df.groupBy(*keys).agg(*[aggs[m].alias(m) for m in METRICS])


def back_test(df: DataFrame, keys: Sequence[str], options: Options = Options(), split: str = "split", timed: bool = False) -> DataFrame:
    """Fit on the train rows, predict all rows, one result row per series.

    The rows are written once, since hot series are found before they are dealt by key. A series is fitted and forecast
    in one pass; its measures are one aggregate. ``training_time`` is the seconds a series took inside its task.
    ``predict_time`` is the wall time of the forecast job over the number of series, measured only
    with ``timed``: fit and forecast are jobs of their own then, models and forecast are written and read back.
    """
    rows = materialize(df.select(*keys, TS, VALUE, split), "backtest-rows")
    if keys and not timed:
        fitted_rows = fit_forecast(rows.withColumn("_train", F.col(split) == "train"), keys, "_train", options, keep=[VALUE, split])
        out = interval_metrics(fitted_rows, [*keys, "fit_seconds"], split)
        return out.select(*keys, F.col("fit_seconds").alias("training_time"), F.lit(None).cast("double").alias("predict_time"), *METRICS)
    models = materialize(fit(rows.where(F.col(split) == "train"), keys, options), "backtest-models")
    predicted = forecast(models, rows, keys, options, keep=[VALUE, split])
    seconds = F.lit(None).cast("double")
    if timed:
        began = time.perf_counter()
        predicted = materialize(predicted, "backtest-forecast")
        seconds = F.lit((time.perf_counter() - began) / max(models.count(), 1))
    times = models.select(*keys, F.col("fit_seconds").alias("training_time"), seconds.alias("predict_time"))
    return join_on(times, interval_metrics(predicted, keys, split), list(keys)).select(*keys, "training_time", "predict_time", *METRICS)


# --- comparison ----------------------------------------------------------------------------------

def paired(left: DataFrame, right: DataFrame, key: str = "key", metrics: Sequence[str] | None = None, check: bool = True) -> DataFrame:
    """Long pairs (key, metric, l, r) of two results with equal key sets."""
    metrics = [c for c in left.columns if c not in (key, "graph")] if metrics is None else list(metrics)
    if check and not same_set(left, right, [key]):
        raise ValueError("the two results do not hold the same series")
    a = left.select(key, *[F.col(m).alias(f"{m}_1") for m in metrics])
    b = right.select(key, *[F.col(m).alias(f"{m}_2") for m in metrics])
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_1").cast("double").alias("l"), F.col(f"{m}_2").cast("double").alias("r")) for m in metrics
    ])).alias("_c")
    return a.join(b, key).select(key, cells).select(key, "_c.metric", "_c.l", "_c.r")


def distribution(pairs: DataFrame) -> DataFrame:
    """Mean, p10, p50 and p90 of both sides and the mean relative difference in percent, per metric."""
    means = pairs.groupBy("metric").agg(
        F.avg("l").alias("lmean"), F.avg("r").alias("rmean"), (100 * F.avg(F.try_divide(F.col("r") - F.col("l"), F.abs("l")))).alias("rel_diff_pct"))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("l").alias("v")), F.struct(F.lit("r").alias("side"), F.col("r").alias("v")))).alias("_c")
    long = pairs.select("metric", sides).select("metric", "_c.side", "_c.v")
    q = exact_quantiles(long, ["metric", "side"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    wide = q.groupBy("metric").agg(*[
        F.max(F.when(F.col("side") == s, F.col(p))).alias(s + p) for p in ("p10", "p50", "p90") for s in ("l", "r")])
    return join_on(means, wide, ["metric"], "left")


def ks_statistic(pairs: DataFrame) -> DataFrame:
    """Largest gap between the two empirical distributions per metric, with both sizes."""
    sides = pairs.select("metric", F.explode(F.array(F.struct(F.col("l").alias("v"), F.lit(1).alias("s")), F.struct(F.col("r").alias("v"), F.lit(0).alias("s")))).alias("_c"))
    points = sides.where("_c.v is not null").groupBy("metric", F.col("_c.v").alias("v")).agg(
        F.sum("_c.s").alias("_l"), F.sum(1 - F.col("_c.s")).alias("_r"))
    rows = OrderedRows(points, ["metric"], ["v"]).running_sum(_cl="_l", _cr="_r").total(n1=F.sum("_l"), n2=F.sum("_r")).frame()
    gap = F.abs(F.col("_cl") / F.col("n1") - F.col("_cr") / F.col("n2"))
    return rows.groupBy("metric").agg(F.max(gap).alias("ks"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """Wilcoxon rank sums of the non-zero differences per metric, average ranks on ties."""
    d = pairs.select("metric", (F.col("l") - F.col("r")).alias("_d")).where("_d <> 0 and _d is not null")
    groups = d.groupBy("metric", F.abs("_d").alias("a")).agg(F.count(F.lit(1)).alias("_m"), F.sum((F.col("_d") > 0).cast("long")).alias("_p"))
    rows = OrderedRows(groups, ["metric"], ["a"]).running_sum(_hi="_m").frame()
    rank = F.col("_hi") - F.col("_m") + (F.col("_m") + 1) / 2.0
    m = F.col("_m").cast("double")
    return rows.groupBy("metric").agg(
        F.sum(rank * F.col("_p")).alias("r_plus"), F.sum(rank * (F.col("_m") - F.col("_p"))).alias("r_minus"),
        F.sum("_m").alias("n"), F.sum(m * m * m - m).alias("ties"))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def wilcoxon_p(r_plus: float, r_minus: float, n: int, ties: float, method: str = "normal") -> float:
    """Two-sided p-value of the signed ranks.

    ``normal`` (the default at every size) is the approximation with tie correction; ``exact`` counts all sign patterns,
    takes n^3 steps and knows no ties.
    """
    if method not in ("normal", "exact"):
        raise ValueError(f"unknown method {method!r}")
    if n == 0:
        return float("nan")
    t = min(r_plus, r_minus)
    if method == "exact":
        if ties:
            raise ValueError("the exact distribution has no ties")
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for i in range(1, n + 1):
            ways[i:] = (ways[i:] + ways[:-i].copy()) / 2.0
            ways[:i] /= 2.0
        return min(1.0, 2.0 * ways[: int(t) + 1].sum())
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * ties) / 24.0)
    return 2.0 * normal_tail(abs(t - n * (n + 1) / 4.0) / spread) if spread else float("nan")


#: Most steps of the exact recursion.
EXACT_STEPS = 10_000_000


def ks_exact(d: float, n1: int, n2: int) -> float:
    """Two-sided p-value for any two sizes: the share of all orders of the pooled values whose largest gap is at least ``d``.

    An order is a path over the grid of both samples. ``inside[j]`` is the share of the paths to (i, j) that have kept
    their gap below ``d``; it follows from both neighbours by the shares of paths that come from there.
    """
    if n1 * n2 > EXACT_STEPS:
        raise ValueError(f"{n1} x {n2} values are too many for the exact distribution")
    limit = round(d * n1 * n2)  # gaps are whole multiples of 1 / (n1 n2)
    inside = [1.0] * (n2 + 1)
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            if abs(i * n2 - j * n1) >= limit:
                inside[j] = 0.0
            elif i + j:
                inside[j] = (i * inside[j] * (i > 0) + j * (inside[j - 1] if j else 0.0)) / (i + j)
    return min(1.0, max(0.0, 1.0 - inside[n2])) if limit > 0 else 1.0


def ks_p(d: float, n1: int, n2: int, method: str = "limit") -> float:
    """Two-sided p-value: the closed form for equal sizes, the limit distribution for unequal ones, whatever the size;
    ``exact`` counts paths for unequal sizes too (``ks_exact``, n1 n2 steps).

    The terms of the closed form fall like exp(-k^2 / n) and are summed until they vanish in double precision. The limit
    is summed in the form that converges at once: the alternating series in the tail, its dual near 0.
    """
    if method not in ("limit", "exact"):
        raise ValueError(f"unknown method {method!r}")
    if d <= 0:
        return 1.0
    if method == "exact" and n1 != n2:
        return ks_exact(d, n1, n2)
    if n1 == n2:
        n, h = n1, int(round(d * n1))
        if h == 0:
            return 1.0
        i = np.arange(min(n, int(40 * math.sqrt(n)) + h))
        log_ratio = np.r_[0.0, np.cumsum(np.log((n - i) / (n + i + 1.0)))]
        steps = np.arange(h, len(log_ratio), h)
        signs = np.where(np.arange(len(steps)) % 2 == 0, 1.0, -1.0)
        return float(np.clip(2.0 * np.sum(signs * np.exp(log_ratio[steps])), 0.0, 1.0))
    z = d * math.sqrt(n1 * n2 / (n1 + n2))
    k = np.arange(1, 51)
    if z < 1.0:
        return float(np.clip(1.0 - math.sqrt(2.0 * math.pi) / z * np.sum(np.exp(-((2 * k - 1) * math.pi / z) ** 2 / 8.0)), 0.0, 1.0))
    return float(np.clip(2.0 * np.sum((-1.0) ** (k - 1) * np.exp(-2.0 * k**2 * z**2)), 0.0, 1.0))


def _p_values(batches, method: str = "limit"):
    for pdf in batches:
        pdf["wilcoxon_pval"] = [wilcoxon_p(a, b, int(n), t) if n == n else float("nan") for a, b, n, t in zip(pdf.r_plus, pdf.r_minus, pdf.n, pdf.ties)]
        pdf["ks_pval"] = [ks_p(d, int(a), int(b), method) for d, a, b in zip(pdf.ks, pdf.n1, pdf.n2)]
        yield pdf[["metric", "ks", "wilcoxon_pval", "ks_pval"]]


def compare(left: DataFrame, right: DataFrame, key: str = "key", metrics: Sequence[str] | None = None, level: float = 0.05, ks_method: str = "limit") -> DataFrame:
    """One row per metric: both distributions, relative difference and the two significance tests."""
    pairs = materialize(paired(left, right, key, metrics), "pairs")  # read by four aggregates below
    stats = join_on(ks_statistic(pairs), signed_ranks(pairs), ["metric"], "left")
    tests = stats.mapInPandas(lambda batches: _p_values(batches, ks_method), "metric string, ks double, wilcoxon_pval double, ks_pval double")  # one row per metric
    out = join_on(distribution(pairs), tests.drop("ks"), ["metric"])
    sig = lambda c: F.coalesce((F.nanvl(F.col(c), F.lit(1.0)) < level), F.lit(False)).cast("int")
    return out.select("metric", "lmean", "rmean", "rel_diff_pct", sig("wilcoxon_pval").alias("significant_w"), sig("ks_pval").alias("significant_k"),
                      "wilcoxon_pval", "ks_pval", "lp50", "rp50", "lp10", "rp10", "lp90", "rp90")


def save_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").parquet(path)


def load_results(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
