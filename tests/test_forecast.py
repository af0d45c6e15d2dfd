import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import trend as M
from tidemark.functions.trend import Options
from tidemark.operators import grid as G
from tidemark.plans import backtest as K
from tidemark.plans import forecast as P
from tidemark.session import materialize


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    frames = []
    for k, slope in (("a", 0.0), ("b", 0.05)):
        h = np.arange(24 * 20)
        y = 50 + slope * h + 8 * np.sin(2 * np.pi * h / 24) + 4 * np.cos(2 * np.pi * h / 168) + rng.normal(size=len(h)) * 2
        frames.append(pd.DataFrame({"k": k, "ts": pd.date_range("2024-01-01", periods=len(h), freq="h"), "value": y}))
    pdf = pd.concat(frames, ignore_index=True)
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")), pdf


@pytest.fixture(scope="module")
def models(data, spark):
    return materialize(P.fit(data[0], ["k"]), "test-models")


def shape_of(row, role="point"):
    return M.Shape(row.first_us, row.last_us, row.n, row.y_scale, row.weekly_order, row.daily_order, np.array(row.changepoints), row.lambda_reg).role(role)


def micros(ts):
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


def test_parameters_and_features(data):
    df, pdf = data
    params = P.auto_parameters(df, ["k"])
    row = params.where("k = 'a'").first()
    assert (row.n, row.weekly_order, row.daily_order, row.n_changepoints) == (480, 6, 6, 10)
    one = pdf[pdf.k == "a"]
    assert row.y_scale == pytest.approx(np.percentile(one.value.abs(), 95))
    shape = M.auto_shape(int(micros(one.ts)[0]), int(micros(one.ts)[-1]), len(one), row.y_scale, Options())
    want = M.design(micros(one.ts), None, shape, Options())
    got = P.features(df.where("k = 'a'"), params, ["k"]).orderBy("ts").toPandas()
    have = np.array([np.r_[1.0, h, w, d] for h, w, d in zip(got.hinges, got.weekly, got.daily)])
    assert np.allclose(have, want)
    short = P.auto_parameters(df.where("ts < '2024-01-02 12:00:00'"), ["k"]).first()
    assert (short.weekly_order, short.daily_order, short.n_changepoints) == (0, 0, 1)


def test_point_fit_is_stationary(data, models):
    _, pdf = data
    for row in models.collect():
        one = pdf[pdf.k == row.k]
        shape = shape_of(row)
        x, y, beta = M.design(micros(one.ts), None, shape, Options()), one.value.to_numpy() / row.y_scale, np.array(row.point)
        grad = x.T @ np.clip(x @ beta - y, -1, 1) / len(y) + M.ridge(shape, Options(), 0) * beta
        assert np.abs(grad).max() < 1e-6


def test_interval_fit_is_near_optimal(data, models):
    _, pdf = data
    row = models.where("k = 'a'").first()
    one = pdf[pdf.k == "a"]
    for role, q in (("upper", 0.975), ("lower", 0.025)):
        shape = shape_of(row, role)
        x, y = M.design(micros(one.ts), None, shape, Options()), one.value.to_numpy() / row.y_scale
        pen = M.ridge(shape, Options(), 0)

        def loss(b):
            r = y - x @ b
            return np.where(r > 0, q * r, (q - 1) * r).mean() + 0.5 * (pen * b * b).sum()

        long, _ = M.fit_local(x, y, pen, q, 1000)
        assert loss(np.array(getattr(row, role))) <= loss(long) * 1.01
        above = ((y - x @ np.array(getattr(row, role))) > 0).mean()
        assert above == pytest.approx(1 - q, abs=0.015)


def test_forecast_matches_design(data, models):
    df, pdf = data
    out = P.forecast(models, df, ["k"], components=True, keep=["value"]).orderBy("k", "ts").toPandas()
    for row in models.collect():
        one, got = pdf[pdf.k == row.k], out[out.k == row.k]
        for role, name in (("point", "yhat"), ("upper", "upper"), ("lower", "lower")):
            x = M.design(micros(one.ts), None, shape_of(row, role), Options())
            assert np.allclose(got[name], x @ np.array(getattr(row, role)) * row.y_scale)
    assert np.allclose([sum(c.values()) for c in out.components], out.yhat)
    inside = (out.value <= out.upper) & (out.value >= out.lower)
    assert 0.92 < inside.mean() < 0.98
    trend = P.forecast(models, df, ["k"], trend_only=True).orderBy("k", "ts").toPandas()
    assert np.allclose(trend.yhat, [c["trend"] for c in out.components])


def test_line_is_the_least_squares_line():
    """What keeps dependent columns solvable does not pull the coefficients of independent ones."""
    rng = np.random.default_rng(3)
    t = np.sort(rng.choice(480, 40, replace=False)).astype(np.int64) * 3_600_000_000
    y = np.round(rng.gamma(1.0, 60.0, 40), 2)
    opt = Options(weekly_order=0, daily_order=0, n_changepoints=0, lambda_reg=0.0, passes=1)
    shape = M.auto_shape(int(t.min()), int(t.max()), len(t), float(np.percentile(y, 95.0)), opt)
    beta, _ = M.fit_rows(t, y, np.zeros((len(t), 0)), shape, opt, "point")
    x = (t - t.min()) / (t.max() - t.min())
    slope = np.mean((x - x.mean()) * (y - y.mean())) / np.mean((x - x.mean()) ** 2)
    assert np.allclose(beta * shape.y_scale, [y.mean() - slope * x.mean(), slope], rtol=1e-12, atol=0)
    twice = np.c_[x, x]  # dependent columns still get finite coefficients, and the same fit
    both = M.solve(twice.T @ twice, twice.T @ y, np.zeros(2), len(t), None)
    assert np.allclose(both.sum(), (x @ y) / (x @ x), rtol=1e-6)


def test_hot_series_get_the_same_model(data, models, spark):
    df, pdf = data
    spark.conf.set("tidemark.hotRows", "300")
    try:
        hot = P.fit(df.where("k = 'a'"), ["k"]).first()
    finally:
        spark.conf.unset("tidemark.hotRows")
    cold = models.where("k = 'a'").first()
    assert np.allclose(hot.point, cold.point, atol=1e-4) and hot.y_scale == pytest.approx(cold.y_scale)
    x = M.design(micros(pdf[pdf.k == "a"].ts), None, shape_of(cold, "upper"), Options())
    assert np.abs(x @ (np.array(hot.upper) - np.array(cold.upper))).max() < 0.02


def test_hot_series_take_the_same_passes(data, spark):
    df, trials = data[0].where("k = 'a'"), [Options(passes=3), Options(passes=20, interval_width=0.8)]
    cold = {r.trial: r for r in P.fit(df, ["k"], trials).collect()}
    spark.conf.set("tidemark.hotRows", "300")
    try:
        hot = {r.trial: r for r in P.fit(df, ["k"], trials).collect()}
    finally:
        spark.conf.unset("tidemark.hotRows")
    fields = [f.name for f in P.MODEL_FIELDS]
    assert sorted(hot) == sorted(cold) == [0, 1] and "passes" in fields
    for i in cold:
        assert hot[i].passes == cold[i].passes
        for role in M.ROLES:
            assert np.allclose(hot[i][role], cold[i][role], rtol=0, atol=1e-6), (i, role)


@pytest.mark.parametrize("hot_rows", ["1000000", "100"])
def test_one_bad_series_stops_no_other(data, spark, hot_rows):
    """Each kind of bad series among good ones, fitted in one task and over many tasks."""
    good = data[0].where("k = 'a'").withColumn("load", F.lit(0.0))
    first, last = good.agg(F.min("ts"), F.max("ts")).first()
    parts = {
        "good": good, "constant": good.withColumn("value", F.lit(3.0)), "short": good.where(F.col("ts") == first), "empty": good.withColumn("value", F.lit(None).cast("double")),
        "infinite": good.withColumn("value", F.when(F.col("ts") == last, float("-inf")).otherwise(F.col("value"))),
        "regressor": good.withColumn("load", F.when(F.col("ts") == last, float("nan")).otherwise(0.0)), "overflow": good.withColumn("load", F.lit(1e200)),
        "holes": good.withColumn("value", F.when(F.hour("ts") == 3, float("nan")).otherwise(F.col("value"))),
    }
    df = None
    for k, part in parts.items():
        part = part.withColumn("k", F.lit(k))
        df = part if df is None else df.unionByName(part)
    spark.conf.set("tidemark.hotRows", hot_rows)
    try:
        attempts = materialize(P.fit_attempts(df, ["k"], Options(passes=4, standardize=False), extras=["load"]), "attempts")
    finally:
        spark.conf.unset("tidemark.hotRows")
    said = {r.k: (r.status, r.reason) for r in P.fit_report(df, attempts, ["k"]).collect()}
    status = {k: s for k, (s, _) in said.items()}
    assert status == {"good": "ok", "constant": "ok", "holes": "ok", "short": "short", "empty": "empty", "infinite": "not finite", "regressor": "not finite", "overflow": "failed"}
    assert all((reason is None) == (s == "ok") for s, reason in said.values())
    models = P.fitted(attempts)
    assert {r.k for r in models.collect()} == {"good", "constant", "holes"} and models.columns == ["k", *[f.name for f in P.MODEL_FIELDS]]
    alone = P.fit(good, ["k"], Options(passes=4, standardize=False), extras=["load"]).first()
    same = models.where("k = 'good'").first()
    assert np.allclose(alone.point, same.point, atol=1e-6) and np.allclose(alone.upper, same.upper, atol=1e-6)


def test_certificate_tells_the_optimum(data, spark):
    opt = Options.from_dict({"seasonalities": [{"name": "x", "period": 0.5, "order": 2, "prior_scale": 3.0}], "extra_prior": [None, 0.7], "passes": 200})
    df = data[0].withColumn("e", (F.hour("ts") == 5).cast("double")).withColumn("g", F.dayofweek("ts") / 7.0)
    models = materialize(P.fit(df, ["k"], opt, extras=["e", "g"]), "models")
    found = {(r.k, r.role): r for r in P.certificate(df, models, ["k"], opt, ["e", "g"]).collect()}
    assert len(found) == 3 * models.count()
    for (_, role), r in found.items():
        assert r.gradient < (1e-6 if role == "point" else 5e-3)
        assert role == "point" or abs(r.above - {"upper": 0.025, "lower": 0.975}[role]) * r.n <= r.terms
    off = models.withColumns({role: F.transform(role, lambda b: b * 1.01) for role in M.ROLES})
    worse = {(r.k, r.role): r.gradient for r in P.certificate(df, off, ["k"], opt, ["e", "g"]).collect()}
    assert all(worse[k] > 10 * found[k].gradient or worse[k] > 1e-3 for k in found)


def test_options():
    with pytest.raises(ValueError):
        Options.from_dict({"seasonalities": [{"name": "x", "period": 2}]})
    with pytest.raises(ValueError):
        Options(interval_width=1.5)
    with pytest.raises(ValueError):
        P.options_from_config({"name": "nothing"})
    assert P.options_from_config('{"args": {"weekly_order": 2}}').weekly_order == 2
    assert [s.name for s in Options(yearly_order=3).seasonalities] == ["yearly"]


def test_holidays_and_regressors(data, spark):
    df, _ = data
    holidays = spark.createDataFrame([("x", dt.date(2024, 1, 8), 0, 1), ("x", dt.date(2024, 1, 8), 0, 0), ("y", dt.date(2024, 1, 12), None, None)],
                                     "holiday string, ds date, lower_window int, upper_window int")
    rows = P.named_holidays(df, holidays, ["x", "y"])
    assert rows.count() == df.count() and rows.where("holiday_x = 1").count() == 96 and rows.where("holiday_y = 1").count() == 48
    extra = rows.withColumn("load", F.hour("ts").cast("double") * 3 + F.dayofmonth("ts"))
    bumped = extra.withColumn("value", F.col("value") + 20 * F.col("holiday_x") + 0.5 * F.col("load"))
    names = ["holiday_x", "holiday_y", "load"]
    opt = Options(seasonalities=(M.Seasonality("half", 0.5, 2),), extra_prior=(None, None, 10.0))
    fitted = P.fit(bumped, ["k"], opt, extras=names)
    out = P.forecast(fitted, bumped, ["k"], opt, extras=names, components=True, keep=["value"]).toPandas()
    assert set(out.components[0]) == {"trend", "weekly", "daily", "half", "holiday_x", "holiday_y", "load"}
    assert np.mean([c["holiday_x"] for c in out.components if c["holiday_x"]]) == pytest.approx(20, abs=3)
    assert np.allclose([sum(c.values()) for c in out.components], out.yhat) and (out.value - out.yhat).abs().mean() < 2.5
    with pytest.raises(ValueError):
        P.with_covariates(df, extra, ["k"], ["value"])


def test_cap_floor_changepoints(data):
    df, _ = data
    opt = Options(cap=55.0, floor=45.0, changepoints=("2024-01-05", "2024-01-10"))
    fitted = P.fit(df, ["k"], opt)
    assert len(fitted.first().changepoints) == 3
    out = P.forecast(fitted, df, ["k"], opt).agg(F.max("yhat"), F.min("yhat")).first()
    assert out[0] <= 55 and out[1] >= 45


def test_tune_and_storage(data, spark, tmp_path):
    df, _ = data
    trials = [Options(daily_order=0, passes=20), Options(passes=20)]
    train, valid = df.where("ts < '2024-01-18'"), df.where("ts >= '2024-01-18'")
    best = P.best_trial(P.tune(train, valid, ["k"], trials), ["k"])
    assert {r.trial for r in best.collect()} == {1}
    assert P.refit_best(df, best, ["k"], trials).count() == 2
    models = P.fit(df, ["k"], trials[1])
    P.save_models(models, str(tmp_path / "m"), "v1")
    assert P.load_models(spark, str(tmp_path / "m"), "v1").select(*models.columns).count() == 2


def test_blocks_of_one_task_add_up(data, monkeypatch):
    _, pdf = data
    one = pdf[pdf.k == "a"]
    t, y, none = micros(one.ts), one.value.to_numpy(), np.zeros((len(one), 0))
    shape = M.auto_shape(int(t[0]), int(t[-1]), len(t), 60.0, Options())
    whole = M.fit_rows(t, y, none, shape, Options(), "upper")[0]
    monkeypatch.setattr(M, "BLOCK_ROWS", 100)
    assert np.allclose(M.fit_rows(t, y, none, shape, Options(), "upper")[0], whole, atol=1e-6)


def test_update_models(data, models):
    df, _ = data
    opt = Options(passes=10)
    early = df.where("ts < '2024-01-15'")
    old = P.fit(early, ["k"], opt)
    new = df.where("k = 'a' and ts >= '2024-01-14'")  # one day overlaps
    got = {r.k: r for r in P.update_models(old, early, new, ["k"], opt).collect()}
    whole = P.fit(df.where("k = 'a'"), ["k"], opt).first()
    assert got["a"].n == 480 and np.allclose(got["a"].point, whole.point) and got["b"].n == 24 * 14


def test_short_series_have_no_model(data):
    df, _ = data
    few = df.where("k = 'a' or ts < '2024-01-01 01:00:00'")
    fitted = P.fit(few, ["k"])
    assert [r.k for r in P.dropped_series(few, fitted, ["k"]).collect()] == ["b"]
    residual = P.residuals(few, fitted, ["k"])
    assert residual.count() == 480


def test_back_test(data):
    df, _ = data
    rows = df.withColumn("split", F.when(F.col("ts") < "2024-01-19", "train").otherwise("test"))
    out = K.back_test(rows, ["k"], timed=True)
    assert out.columns == ["k", "training_time", "predict_time", *K.METRICS]
    got = out.toPandas()
    assert (got.ci_cov_train > 0.9).all() and (got.smape_train < 0.1).all() and (got.predict_time > 0).all()
    future = G.future(rows.where("split = 'train'"), ["k"], "hour", 48)
    assert future.count() == 96


def test_back_test_in_one_pass(data, spark, monkeypatch):
    """Fit, forecast and measures of a series in one pass are those of separate jobs, also above the row limit."""
    opt = Options(passes=8)
    rows = data[0].where("k = 'a' OR ts < '2024-01-10'").withColumn("split", F.when(F.col("ts") < "2024-01-08", "train").otherwise("test"))
    rows = rows.withColumn("value", F.when(F.hour("ts") != 5, F.col("value")))
    models = materialize(P.fit(rows.where("split = 'train'"), ["k"], opt), "models")
    want = K.interval_metrics(P.forecast(models, rows, ["k"], opt, keep=["value", "split"]), ["k"]).toPandas().sort_values("k")
    joined = []
    monkeypatch.setattr(K, "forecast", lambda *a, **k: joined.append(a))
    for limit in ("1000", "300"):  # above 300 rows lies a
        spark.conf.set("tidemark.hotRows", limit)
        try:
            out = K.back_test(rows, ["k"], opt)
            got = out.toPandas().sort_values("k")
        finally:
            spark.conf.unset("tidemark.hotRows")
        assert out.columns == ["k", "training_time", "predict_time", *K.METRICS]
        assert list(got.k) == ["a", "b"] and (got.training_time > 0).all()
        for m in K.METRICS:
            assert np.allclose(got[m], want[m], rtol=1e-5, atol=1e-7, equal_nan=True), (limit, m)
    assert not joined  # the rows met a table of models before


def test_bounds_side_by_side():
    rng = np.random.default_rng(8)
    t = np.arange(500, dtype=np.int64) * 3_600_000_000
    y, none = rng.gamma(1.0, 60.0, 500) * (rng.random(500) < 0.3), np.zeros((500, 0))
    shape = M.auto_shape(0, int(t[-1]), 500, float(np.percentile(y, 95.0)), Options())
    made = M.fit_roles(t, y, none, shape, Options())
    for role in M.ROLES:
        beta, passes = M.fit_rows(t, y, none, shape, Options(), role)
        assert passes == made[role][1] and np.allclose(beta, made[role][0], rtol=1e-6, atol=1e-8)


def test_interval_metrics(spark):
    pdf = pd.DataFrame({"k": "a", "value": [1.0, 0.0, 5.0, 2.0], "yhat": [2.0, 0.0, 4.0, 2.0], "lower": [0.0, 1.0, 6.0, 1.0], "upper": [3.0, 2.0, 4.5, 3.0], "split": ["train"] * 3 + ["test"]})
    row = K.interval_metrics(spark.createDataFrame(pdf), ["k"]).first()
    assert row.mae_train == pytest.approx(2 / 3) and row.smape_train == pytest.approx(2 * (1 / 3 + 1 / 9) / 2)
    assert row.ci_sz_train == pytest.approx(4 / 3) and row.ci_cov_train == pytest.approx(1 / 3) and row.ci_ordered_train == pytest.approx(1 / 3)
    assert row.calib_h_train == pytest.approx(1 / 3) and row.calib_l_train == pytest.approx(2 / 3) and row.mae_test == 0


def test_wilcoxon_p_by_enumeration():
    n = 9
    ranks = np.arange(1, n + 1)
    sums = np.array([sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=n)])
    for plus in (3, 10, 22):
        want = min(1.0, 2 * (sums <= min(plus, 45 - plus)).mean())
        assert K.wilcoxon_p(plus, 45 - plus, n, 0, "exact") == pytest.approx(want)
    assert K.normal_tail(1.959963984540054) == pytest.approx(0.025)
    # large sample: agrees with the exact distribution of the signed rank sum
    assert K.wilcoxon_p(400, 50 * 51 / 2 - 400, 50, 0, "exact") == pytest.approx(K.wilcoxon_p(400, 50 * 51 / 2 - 400, 50, 1e-9), rel=0.05)
    assert math.isnan(K.wilcoxon_p(0, 0, 0, 0)) and K.wilcoxon_p(400, 875, 50, 0) == K.wilcoxon_p(400, 875, 50, 1e-12)


def test_exact_ks_p_of_unequal_sizes_by_enumeration():
    for n in range(1, 9):
        for m in range(1, 9):
            gaps = []
            for mine in itertools.combinations(range(n + m), n):
                i = j = top = 0
                for at in range(n + m):
                    i, j = (i + 1, j) if at in mine else (i, j + 1)
                    top = max(top, abs(i * m - j * n))
                gaps.append(top)
            gaps = np.array(gaps)
            for gap in np.unique(gaps):
                want = (gaps >= gap).mean()
                assert K.ks_exact(gap / (n * m), n, m) == pytest.approx(want) == K.ks_p(gap / (n * m), n, m, "exact")
    assert K.ks_p(0.05, 2000, 1500, "exact") == pytest.approx(K.ks_p(0.05, 2000, 1500), abs=0.01)
    with pytest.raises(ValueError):
        K.ks_p(0.1, 100_000, 99_999, "exact")


def test_ks_p_by_enumeration():
    n = 5
    gaps = []
    for left in itertools.combinations(range(2 * n), n):
        steps = np.where(np.isin(np.arange(2 * n), left), 1, -1)
        gaps.append(np.abs(np.cumsum(steps)).max())
    for h in (1, 2, 3, 5):
        assert K.ks_p(h / n, n, n) == pytest.approx((np.array(gaps) >= h).mean())
    for n, m in ((5, 5), (20_000, 20_000), (100, 101), (10**6, 10**6), (10**6, 10**6 + 1)):
        assert K.ks_p(0.0, n, m) == 1.0
        values = [K.ks_p(x / (n * m / (n + m)) ** 0.5, n, m) for x in (0.3, 0.9, 0.999, 1.001, 1.4, 2.0)]
        assert values == sorted(values, reverse=True) and abs(values[2] - values[3]) < 0.03 + 2 / n**0.5
    assert K.ks_p(0.0001, 20_000, 20_000) == pytest.approx(1.0) and K.ks_p(1.36 / 5000**0.5, 10_000, 10_001) == pytest.approx(0.049, abs=1e-3)
    assert K.ks_p(0.02, 9999, 9999) == pytest.approx(K.ks_p(0.02, 10_001, 10_000), rel=0.05)


@pytest.mark.parametrize("rows", ["1000000", "20"])
def test_compare(spark, rows):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"key": [f"s{i}" for i in range(60)], "mae": rng.normal(10, 1, 60).round(1), "n": 1.0})
    right = left.assign(mae=left.mae + rng.normal(0.5, 0.3, 60).round(1))
    spark.conf.set("tidemark.hotRows", rows)
    got = K.compare(spark.createDataFrame(left), spark.createDataFrame(right)).toPandas().set_index("metric")
    spark.conf.unset("tidemark.hotRows")
    d = (left.mae - right.mae).round(10)
    d = d[d != 0]
    ranks = d.abs().rank()
    plus, minus = ranks[d > 0].sum(), ranks[d < 0].sum()
    ties = sum(c**3 - c for c in d.abs().round(10).value_counts())
    assert got.loc["mae", "wilcoxon_pval"] == pytest.approx(K.wilcoxon_p(plus, minus, len(d), ties), rel=1e-3)
    assert got.loc["mae", "significant_w"] == 1 and got.loc["n", "significant_w"] == 0 and got.loc["n", "ks_pval"] == 1.0
    assert got.loc["mae", "lp90"] == pytest.approx(np.percentile(left.mae, 90)) and got.loc["mae", "rel_diff_pct"] == pytest.approx(100 * ((right.mae - left.mae) / left.mae).mean())
    with pytest.raises(ValueError):
        K.compare(spark.createDataFrame(left), spark.createDataFrame(right.iloc[1:]))
