"""One named query per operator group, over the whole given tables."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.functions.timeunits import round_calendar, to_int_scale, trunc_grain
from tidemark.functions.trend import Options
from tidemark.operators import bounds as B
from tidemark.operators import grid as G
from tidemark.operators import scaling as C
from tidemark.operators import scores as E
from tidemark.operators import series as S
from tidemark.operators.ordered import exact_quantiles
from tidemark.operators.robust import huber_scale, mad_scale
from tidemark.plans import backtest as K
from tidemark.plans import detect as D
from tidemark.plans import forecast as P
from tidemark.plans import state as V
from tidemark.plans.metrics import QuerySpec, ZeroFilled, complete_entities, metric_query, metric_sql
from tidemark.queries.inputs import catalog, daily_orders, hourly, rounded, table, user_scores, user_series
from tidemark.session import materialize, work_dir
from tidemark.sources import series_io as IO
from tidemark.streaming import score as Z

TYPE = ["event_type"]
USER = ["user_id"]
SPLIT_AT = "2024-01-21 00:00:00"
TOLERANCE = 1.5
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- metrics -------------------------------------------------------------------------------------

REGION_SPEC = QuerySpec("month", "1995-06-01", "2000-06-30", ("dim_region",))


@query
def metric_orders_monthly_region(spark, sf):
    return rounded(metric_query(catalog(spark, sf), "order_amount", REGION_SPEC), digits=2)


@query
def metric_sql_text(spark, sf):
    cat = catalog(spark, sf)
    cat.register_views()
    return rounded(spark.sql(metric_sql(cat, "order_amount", REGION_SPEC)), digits=2)


@query
def metric_events_hourly(spark, sf):
    return metric_query(catalog(spark, sf), "num_events", QuerySpec("hour", "2024-01-01", "2024-02-01", ("dim_event_type",)))


@query
def metric_dim_filter_yearly(spark, sf):
    spec = QuerySpec("year", "1995-01-01", "2001-12-31", ("dim_priority", "dim_segment"), ("dim_region IN ('ASIA', 'EUROPE')", "m_total > 1000"))
    return metric_query(catalog(spark, sf), "num_customers", spec)


# --- series in and out -----------------------------------------------------------------------------

@query
def series_from_records(spark, sf):
    """Two value columns become two series per event type."""
    cells = table(spark, sf, "events").groupBy("event_type", trunc_grain("ts", "hour").alias("at")).agg(
        F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))
    return S.to_series(cells, "at", ["total", "n"], TYPE)


@query
def series_wide_export(spark, sf):
    names = ["click", "error", "purchase", "signup", "view"]
    return IO.to_wide(hourly(spark, sf), "event_type", names)


@query
def series_json_roundtrip(spark, sf):
    return IO.from_json_rows(IO.to_json_rows(hourly(spark, sf), TYPE, "hour"), TYPE)


@query
def wide_to_long(spark, sf):
    return rounded(IO.array_to_long(table(spark, sf, "embeddings"), "vec_id", "embedding"))


@query
def series_level_rename(spark, sf):
    """A constant level in front, two series renamed, the level dropped again."""
    df = S.add_level(hourly(spark, sf), "metric", "total")
    df = S.rename_series(df, ["metric", "event_type"], {("total", "click"): ("total", "clicked"), ("total", "view"): ("total", "viewed")})
    return S.drop_level(df, ["metric", "event_type"], "metric")


# --- grids and slices ------------------------------------------------------------------------------

@query
def series_dense_filled(spark, sf):
    return G.make_dense(hourly(spark, sf), TYPE, "hour", fill=0.0)


@query
def series_missing(spark, sf):
    rows = user_series(spark, sf).select("user_id", trunc_grain("ts", "hour").alias("ts")).distinct()
    return G.missing_times(rows, USER, "hour")


@query
def series_complete_zero(spark, sf):
    cells = table(spark, sf, "events").groupBy(trunc_grain("ts", "hour").alias("time"), "event_type").agg(F.round(F.sum("value"), 4).alias("value"))
    return complete_entities(cells, "value", TYPE)


@query
def series_future(spark, sf):
    return G.future(hourly(spark, sf), TYPE, "hour", steps=24, past=3)


@query
def series_bounds(spark, sf):
    return G.bounds(hourly(spark, sf), TYPE, "hour")


@query
def series_grid_months(spark, sf):
    """Month grid between the first and last order day of every priority."""
    return G.grid(daily_orders(spark, sf), ["priority"], "month")


@query
def series_resample_mean_max(spark, sf):
    rows = user_series(spark, sf).select("event_type", "ts", "value")
    mean = G.resample(rows, TYPE, "6 hours", "avg").withColumnRenamed("value", "mean_value")
    labels = rows.withColumn("value", (F.col("value") > 150).cast("double"))
    top = G.resample(labels, TYPE, "6 hours", "max").withColumnRenamed("value", "any_high")
    return rounded(mean.join(top, [*TYPE, "ts"]))


@query
def series_split(spark, sf):
    return G.temporal_split(user_series(spark, sf).select("user_id", "ts", "value"), USER, 0.9)


@query
def series_slice_time(spark, sf):
    return S.time_slice(user_series(spark, sf), "2024-01-10", "2024-01-12 12:00:00")


@query
def series_slice_pos(spark, sf):
    return S.position_slice(user_series(spark, sf).select("user_id", "ts", "value"), USER, 5, -5)


@query
def series_drop_incomplete(spark, sf):
    """Hours at which no series has a missing value."""
    cells = table(spark, sf, "events").groupBy(trunc_grain("ts", "hour").alias("time"), "event_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
    holes = complete_entities(cells, "value", TYPE).select("event_type", F.col("time").alias("ts"), F.nullif(F.col("value"), F.lit(0.0)).alias("value"))
    return S.drop_incomplete_rows(holes)


@query
def series_select_prefix(spark, sf):
    rows = table(spark, sf, "events").groupBy("event_type", "user_id", trunc_grain("ts", "day").alias("ts")).agg(F.count(F.lit(1)).alias("value"))
    return S.select_prefix(rows, ["event_type", "user_id"], ["error"])


@query
def series_is_in(spark, sf):
    """Hours of every type flagged where errors occurred in the same hour."""
    df = hourly(spark, sf)
    return S.is_in(df, df.where("event_type = 'error'").select("ts"))


@query
def series_set_ops(spark, sf):
    """Hours with purchases but without errors, and hours with both."""
    h = hourly(spark, sf)
    buys, fails = h.where("event_type = 'purchase'").select("ts"), h.where("event_type = 'error'").select("ts")
    only = S.difference(buys, fails, ["ts"]).withColumn("kind", F.lit("difference"))
    return S.concat(only, S.intersection(buys, fails, ["ts"]).withColumn("kind", F.lit("intersection")))


@query
def series_granularity(spark, sf):
    days = daily_orders(spark, sf).withColumn("priority", F.concat(F.lit("day "), F.col("priority")))
    months = table(spark, sf, "orders").select(F.concat(F.lit("month "), F.col("o_orderpriority")).alias("priority"), trunc_grain("o_orderdate", "quarter").alias("ts")).distinct()
    ends = table(spark, sf, "orders").select(F.concat(F.lit("end "), F.col("o_orderpriority")).alias("priority"), F.last_day("o_orderdate").cast("timestamp_ntz").alias("ts")).distinct()
    raw = table(spark, sf, "events").select(F.concat(F.lit("event "), F.col("event_type")).alias("priority"), "ts")
    rows = S.concat(days.select("priority", "ts"), months, ends, raw)
    return G.infer_granularity(rows, ["priority"])


@query
def series_granularity_recent(spark, sf):
    return G.infer_granularity_recent(hourly(spark, sf), TYPE)


@query
def series_index_checks(spark, sf):
    """Event times of every user checked against a grid of minutes and a scale of hours."""
    return G.index_problems(user_series(spark, sf).select("user_id", trunc_grain("ts", "minute").alias("ts")), USER, "2 minutes", unit="hour")


@query
def series_has_missing(spark, sf):
    rows = user_series(spark, sf).withColumn("value", F.when(F.col("value") > 300, F.lit(float("nan"))).otherwise(F.col("value")))
    return S.has_missing(rows, USER)


@query
def calendar_round(spark, sf):
    codes = ["M", "MS", "Q", "QS", "Y", "YS", "W", "W-MON", "W-WED", "day", "12 hours"]
    rows = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ts")).distinct()
    return rows.select("ts", *[round_calendar("ts", c).alias("to_" + c.lower().replace("-", "_").replace(" ", "_")) for c in codes])


@query
def time_int_scale(spark, sf):
    return table(spark, sf, "events").select("event_id", to_int_scale("ts", "2024-01-01", "15 minutes").alias("ts_int"))


# --- arithmetic ------------------------------------------------------------------------------------

def _pairs(spark, sf):
    """Hourly series of all event types over the whole range of the table, as left and right side of every pair of types."""
    rows = hourly(spark, sf)
    span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    types = rows.select("event_type").distinct()
    grid = types.withColumn("ts", F.explode(F.sequence(span.select("lo").scalar(), span.select("hi").scalar(), F.expr("INTERVAL 1 HOUR"))))
    dense = materialize(grid.join(rows, ["event_type", "ts"], "left").fillna(0.0, ["value"]), "dense")
    names = F.array(*[F.lit(r["event_type"]) for r in types.sort("event_type").collect()])  # a handful of event types
    left = dense.select(F.col("event_type").alias("left"), F.explode(F.filter(names, lambda n: n > F.col("event_type"))).alias("right"), "ts", "value")
    right = dense.select(F.explode(F.filter(names, lambda n: n < F.col("event_type"))).alias("left"), F.col("event_type").alias("right"), "ts", "value")
    return left, right


SIDES = ["left", "right"]


@query
def series_arith(spark, sf):
    """All operators on all pairs of event types, and numbers on the left one."""
    a, b = _pairs(spark, sf)
    parts = [S.combine_all(a, ("+", "-", "*", "/", "//", "%"), b, SIDES)]
    parts.append(S.combine(a, "-", 100, SIDES, reverse=True).withColumn("op", F.lit("100-")))
    parts.append(S.combine(a, "**", 2, SIDES).withColumn("op", F.lit("**2")))
    parts.append(S.unary(S.combine(a, "-", b, SIDES, check=False), "abs").withColumn("op", F.lit("abs")))
    return rounded(S.concat(*parts), digits=4)


@query
def series_compare(spark, sf):
    a, b = _pairs(spark, sf)
    return S.combine_all(a, ("<", "<=", ">", ">="), b, SIDES)


# --- scaling ---------------------------------------------------------------------------------------

@query
def minmax_scale(spark, sf):
    """Feature columns of all hours scaled with the range of early hours; the label column is carried."""
    cells = table(spark, sf, "events").groupBy(trunc_grain("ts", "hour").alias("ts")).agg(
        F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).cast("double").alias("n"), F.max((F.col("event_type") == "error").cast("int")).alias("is_attack"))
    train, other = cells.where(F.col("ts") < SPLIT_AT), cells.where(F.col("ts") >= SPLIT_AT)
    early, late = C.min_max_scale(train, other, ["total", "n"])
    return rounded(early.withColumn("split", F.lit("train")).unionByName(late.withColumn("split", F.lit("test"))))


@query
def score_scale(spark, sf):
    scores = user_scores(spark, sf)
    plain = C.scale_scores(scores, USER)
    flipped = C.scale_scores(scores, USER, flip=True).select("user_id", "idx", F.col("score").alias("flipped"))
    return rounded(plain.join(flipped, ["user_id", "idx"]))


@query
def score_jitter(spark, sf):
    return C.jitter_scores(user_scores(spark, sf), ["user_id", "idx"])


# --- robust scale and verdicts ---------------------------------------------------------------------

@query
def detect_mad_scale(spark, sf):
    return rounded(mad_scale(user_series(spark, sf), USER))


@query
def detect_huber_scale(spark, sf):
    return rounded(huber_scale(user_series(spark, sf), USER))


ALGORITHMS = {"both": D.Algorithm(tolerance=TOLERANCE), "high": D.Algorithm(tolerance=TOLERANCE, direction="up")}


def _completed(spark, sf):
    cells = table(spark, sf, "events").groupBy(trunc_grain("ts", "hour").alias("time"), "event_type").agg(F.round(F.sum("value"), 4).alias("value"))
    return ZeroFilled.of(cells.withColumnRenamed("time", "ts"), "value", TYPE, "ts")


@query
def detect_flags(spark, sf):
    data = _completed(spark, sf)
    early, late = data.where(F.col("ts") < SPLIT_AT), data.where(F.col("ts") >= SPLIT_AT)
    return D.anomaly_rows(D.verdicts(late, TYPE, D.train(early, TYPE, ALGORITHMS), ALGORITHMS), TYPE)


@query
def detect_sparse_entities(spark, sf):
    """Alerts of every customer's daily order sums: almost all days are gaps, which are counted and never made."""
    days = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer_id"), trunc_grain("o_orderdate", "day").alias("ts")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    data = ZeroFilled.of(days, "value", ["customer_id"], "ts")
    month = ZeroFilled.of(days.withColumn("ts", trunc_grain("ts", "quarter")).groupBy("customer_id", "ts").agg(F.round(F.sum("value"), 2).alias("value")), "value", ["customer_id"], "ts")
    frames = []
    for grain, series in (("day", data), ("quarter", month)):
        early, late = series.where(F.col("ts") < "1999-01-01"), series.where(F.col("ts") >= "1999-01-01")
        found = D.anomaly_rows(D.verdicts(late, ["customer_id"], D.train(early, ["customer_id"], ALGORITHMS), ALGORITHMS), ["customer_id"])
        frames.append(found.select(F.lit(grain).alias("grain"), "algorithm_name", "entity", "timestamp", "value"))
    return S.concat(*frames)


@query
def detect_with_forecast(spark, sf):
    algo = {"residual": D.Algorithm(tolerance=3.0, model=Options())}
    data = _completed(spark, sf)
    early, late = data.where(F.col("ts") < SPLIT_AT), data.where(F.col("ts") >= SPLIT_AT)
    return D.anomaly_rows(D.verdicts(late, TYPE, D.train(early, TYPE, algo), algo), TYPE)


# --- evaluation ------------------------------------------------------------------------------------

LIMIT = 60.0


@query
def eval_confusion(spark, sf):
    return rounded(E.confusion(C.predict(user_scores(spark, sf), LIMIT), USER))


@query
def eval_outcome(spark, sf):
    return C.outcome(C.predict(user_scores(spark, sf), LIMIT)).select("user_id", "idx", "outcome")


@query
def eval_segments(spark, sf):
    return E.label_segments(user_scores(spark, sf), USER).select("user_id", "idx", "label", "seg")


@query
def eval_segment_max(spark, sf):
    return E.segment_max(user_scores(spark, sf), USER).select("user_id", "idx", "adj_score")


@query
def eval_point_adjust(spark, sf):
    return E.point_adjust(user_scores(spark, sf), USER, LIMIT, direction=">", parity=True).select("user_id", "idx", "adj_pred")


@query
def eval_point_adjust_score(spark, sf):
    return rounded(E.sequence_score(user_scores(spark, sf), USER, LIMIT, direction=">"))


@query
def eval_latency(spark, sf):
    return rounded(E.detection_latency(C.predict(user_scores(spark, sf), LIMIT), USER))


@query
def eval_best_f1(spark, sf):
    return rounded(E.best_f1(user_scores(spark, sf), USER))


@query
def eval_best_f1_segment(spark, sf):
    return rounded(E.best_f1(user_scores(spark, sf), USER, adjust=True))


@query
def eval_grid_f1(spark, sf):
    return rounded(E.best_f1_grid(C.scale_scores(user_scores(spark, sf), USER), USER))


@query
def eval_search_threshold(spark, sf):
    return rounded(E.search_threshold(user_scores(spark, sf), USER, 0.0, 320.0, 64))


@query
def eval_window_f1(spark, sf):
    return rounded(E.window_score(user_scores(spark, sf), USER, 5, LIMIT))


@query
def eval_window_tuned(spark, sf):
    """Every user tunes its threshold on the first half of its rows and is scored on the second."""
    rows = G.temporal_split(user_scores(spark, sf).withColumnRenamed("idx", "ts"), USER, 0.5).withColumnRenamed("ts", "idx")
    valid, test = rows.where("split = 'train'"), rows.where("split = 'valid'")
    return rounded(E.tune_on_validation(valid, test, USER, 0.0, 320.0, 32, width=5))


@query
def eval_pak(spark, sf):
    return rounded(E.pa_k(user_scores(spark, sf), USER))


@query
def eval_adjusted_composite(spark, sf):
    return rounded(E.adjusted_composite(user_scores(spark, sf), USER))


@query
def eval_benchmark_table(spark, sf):
    scores = user_scores(spark, sf)
    tag = lambda d, name, k: d.select(F.col("user_id").alias("dataset"), F.lit("value").alias("model"), F.lit(name).alias("metric_name"),
                                      F.col("f1").alias("metric_value"), k.alias("k"), k.cast("string").alias("metric_param"))
    results = S.concat(tag(E.best_f1(scores, USER, adjust=True), "f1_pa", F.lit(None).cast("int")), tag(E.pa_k(scores, USER), "f1_pak", F.col("k")))
    return rounded(E.benchmark_table(results))


@query
def eval_align_tail(spark, sf):
    """Scores that lack the first three rows of every user, aligned to the labels from the end."""
    rows = user_scores(spark, sf)
    short = rows.where("idx >= 3").withColumn("idx", F.col("idx") - 3)
    return E.align_tail(short, rows, USER)


# --- forecasts -------------------------------------------------------------------------------------

@query
def forecast_parameters(spark, sf):
    return rounded(P.auto_parameters(hourly(spark, sf), TYPE))


@query
def forecast_features(spark, sf):
    df = hourly(spark, sf)
    f = P.features(df, P.auto_parameters(df, TYPE), TYPE)

    def named(column):
        return F.transform(column, lambda v, i: F.struct(F.concat(F.lit(column + "_"), i.cast("string")).alias("name"), v.alias("v")))

    y = F.array(F.struct(F.lit("y").alias("name"), F.col("y").alias("v")))
    cells = F.explode(F.concat(named("hinges"), named("weekly"), named("daily"), y)).alias("_c")
    return rounded(f.select("event_type", "ts", cells).select("event_type", "ts", F.col("_c.name").alias("feature"), F.col("_c.v").alias("v")))


@query
def forecast_fit(spark, sf):
    df = hourly(spark, sf)
    index = G.future(df, TYPE, "hour", 48)
    return P.forecast(P.fit(df, TYPE), index, TYPE)


def _defective(spark, sf):
    """Hourly series of every user, some of them spoilt by their id: constant, one hour only, an infinite hour, no values, a regressor beyond all sums."""
    kind = F.col("user_id") % 10
    rows = table(spark, sf, "events").groupBy("user_id", trunc_grain("ts", "hour").alias("ts")).agg(F.round(F.sum("value"), 4).alias("value"))
    ends = rows.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    rows = rows.join(ends, "user_id").where((kind != 1) | (F.col("ts") == F.col("first_ts")))
    value = F.when(kind == 0, 5.0).when((kind == 2) & (F.col("ts") == F.col("last_ts")), float("inf")).when(kind != 4, F.col("value"))
    return rows.select("user_id", "ts", value.alias("value"), F.when(kind == 3, 1e200).otherwise((F.dayofweek("ts") == 1).cast("double")).alias("load"))


@query
def forecast_report(spark, sf):
    """Outcome of the fit of every user: one bad series neither stops nor changes another."""
    df = _defective(spark, sf)
    attempts = P.fit_attempts(df, USER, Options(weekly_order=1, daily_order=1, n_changepoints=1, passes=3, standardize=False), extras=["load"])
    return P.fit_report(df, materialize(attempts, "attempts"), USER).withColumn("reason", F.when(F.col("status") != "failed", F.col("reason")))


@query
def detector_report(spark, sf):
    """Outcome of the training of every user under two algorithms: hours of constant users are compared with 5, so nothing is left to scale."""
    df = _defective(spark, sf).where("value IS NULL OR value < double('infinity')").withColumn("value", F.col("value") - F.when(F.col("user_id") % 10 == 0, 5.0).otherwise(0.0))
    return D.train(df.select("user_id", "ts", "value"), USER, ALGORITHMS).report


@query
def forecast_components(spark, sf):
    """Decomposition with a holiday flag and a custom seasonality of 12 hours."""
    opt = Options.from_dict({"seasonalities": [{"name": "half_day", "period": 0.5, "order": 2}]})
    holidays = spark.createDataFrame([(dt.date(2024, 1, 15), 0, 1)], "ds date, lower_window int, upper_window int")
    df = P.holiday_flags(hourly(spark, sf), holidays)
    models = P.fit(df, TYPE, opt, extras=["is_holiday"])
    out = P.forecast(models, df, TYPE, opt, extras=["is_holiday"], components=True)
    return out.select("event_type", "ts", F.explode("components").alias("component", "part"))


@query
def forecast_components_sum(spark, sf):
    """The parts of every row add up to its forecast."""
    opt = Options.from_dict({"seasonalities": [{"name": "half_day", "period": 0.5, "order": 2}], "passes": 20})
    holidays = spark.createDataFrame([(dt.date(2024, 1, 15), 0, 1)], "ds date, lower_window int, upper_window int")
    df = P.holiday_flags(hourly(spark, sf), holidays)
    out = P.forecast(P.fit(df, TYPE, opt, extras=["is_holiday"]), df, TYPE, opt, extras=["is_holiday"], components=True)
    whole = F.aggregate(F.map_values("components"), F.lit(0.0), lambda a, b: a + b)
    gap = F.round(F.abs(F.col("yhat") - whole) / F.greatest(F.abs("yhat"), F.lit(1.0)), 6) + F.lit(0.0)
    return out.select("event_type", "ts", F.array_join(F.array_sort(F.map_keys("components")), ",").alias("parts"), gap.alias("gap"))


@query
def forecast_certificate(spark, sf):
    """Every fitted model stands at the optimum of its objective, by the gradient over all rows; bounds have their share of rows above."""
    df = hourly(spark, sf)
    found = P.certificate(df, materialize(P.fit(df, TYPE), "models"), TYPE)
    limit = F.when(F.col("role") == "point", 1e-6).otherwise(0.01)
    share = F.when(F.col("role") == "upper", 0.025).when(F.col("role") == "lower", 0.975).otherwise(F.col("above"))
    return found.select("event_type", "role", "n", (F.col("gradient") < limit).alias("optimal"), (F.abs(F.col("above") - share) * F.col("n") <= F.col("terms")).alias("balanced"))


#: One straight line by least squares, which SQL can fit too.
LINE = Options(weekly_order=0, daily_order=0, n_changepoints=0, lambda_reg=0.0, passes=1)


def _user_hours(spark, sf):
    """Hourly sums of users with ten early hours or more."""
    rows = table(spark, sf, "events").groupBy("user_id", trunc_grain("ts", "hour").alias("ts")).agg(F.round(F.sum("value"), 4).alias("value"))
    known = rows.where(F.col("ts") < SPLIT_AT).groupBy(*USER).count().where("count >= 10")
    return rows.join(known.select(*USER), USER, "left_semi")


@query
def forecast_trend(spark, sf):
    """The line of every user at the first and last hour."""
    df = _user_hours(spark, sf)
    out = P.forecast(P.fit(df, USER, LINE), df, USER, LINE)
    return rounded(out.groupBy(*USER).agg(F.count(F.lit(1)).alias("n"), F.min_by("yhat", "ts").alias("first_yhat"), F.max_by("yhat", "ts").alias("last_yhat")), digits=3)


@query
def detect_with_trend(spark, sf):
    """Late hours far from the line through the user's early hours."""
    df, algo = _user_hours(spark, sf), {"trend": D.Algorithm(tolerance=2.0, model=LINE)}
    early, late = df.where(F.col("ts") < SPLIT_AT), df.where(F.col("ts") >= SPLIT_AT)
    return D.anomaly_rows(D.verdicts(late, USER, D.train(early, USER, algo), algo), USER)


@query
def backtest_trend(spark, sf):
    """Back-test of the line of every user; its bounds coincide with it."""
    rows = _user_hours(spark, sf).withColumn("split", F.when(F.col("ts") < SPLIT_AT, "train").otherwise("test"))
    out = K.back_test(rows, USER, LINE).drop("training_time", "predict_time")
    sizes, smape = [f"{m}_{s}" for m in ("mae", "ci_sz") for s in ("train", "test")], ["smape_train", "smape_test"]
    shares = [c for c in out.columns if c not in (*USER, *sizes, *smape)]
    return rounded(rounded(rounded(out, *sizes, digits=2), *smape, digits=4), *shares, digits=9)


@query
def tune_trend(spark, sf):
    """The best of three penalties on the slope by loss on the late hours."""
    df = _user_hours(spark, sf)
    trials = [replace(LINE, lambda_reg=x) for x in (0.0, 0.05, 0.5)]
    losses = P.tune(df.where(F.col("ts") < SPLIT_AT), df.where(F.col("ts") >= SPLIT_AT), USER, trials)
    return rounded(P.best_trial(losses, USER), digits=3)


@query
def forecast_holidays(spark, sf):
    """Order days within two days after a new year or within a day around the first of May."""
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    holidays = years.select(F.explode(F.array(
        F.struct(F.make_date("y", F.lit(1), F.lit(1)).alias("ds"), F.lit(0).alias("lower_window"), F.lit(2).alias("upper_window")),
        F.struct(F.make_date("y", F.lit(5), F.lit(1)).alias("ds"), F.lit(-1).alias("lower_window"), F.lit(1).alias("upper_window")),
    )).alias("h")).select("h.*")
    return P.holiday_flags(daily_orders(spark, sf), holidays).select("priority", "ts", "value", "is_holiday")


@query
def forecast_covariates(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type", trunc_grain("ts", "hour").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return P.with_covariates(hourly(spark, sf), counts, TYPE, ["n"])


@query
def forecast_tuned(spark, sf):
    """Best of three option sets per series by validation loss."""
    rows = G.temporal_split(hourly(spark, sf), TYPE, 0.9)
    trials = [Options(passes=30), Options(weekly_order=2, daily_order=2, passes=30), Options(n_changepoints=2, lambda_reg=0.01, passes=30)]
    losses = P.tune(rows.where("split = 'train'"), rows.where("split = 'valid'"), TYPE, trials)
    return P.best_trial(losses, TYPE)


def _naive(spark, sf):
    """Hour-of-day profile of the train rows as forecast, two deviations as interval."""
    rows = G.temporal_split(hourly(spark, sf), TYPE, 0.8).withColumn("split", F.when(F.col("split") == "train", "train").otherwise("test"))
    profile = rows.where("split = 'train'").groupBy("event_type", F.hour("ts").alias("h")).agg(F.avg("value").alias("yhat"), F.stddev_pop("value").alias("sd"))
    joined = rows.withColumn("h", F.hour("ts")).join(profile, ["event_type", "h"], "left")
    return joined.select("event_type", "ts", "value", "split", "yhat", (F.col("yhat") - 2 * F.col("sd")).alias("lower"), (F.col("yhat") + 2 * F.col("sd")).alias("upper"))


@query
def interval_metrics(spark, sf):
    return rounded(K.interval_metrics(_naive(spark, sf), TYPE))


@query
def backtest_metrics(spark, sf):
    rows = G.temporal_split(hourly(spark, sf), TYPE, 0.9).withColumn("split", F.when(F.col("split") == "train", "train").otherwise("test"))
    return K.back_test(rows, TYPE, timed=True)


@query
def backtest_user_hourly(spark, sf):
    """Back-test of one dense hourly series per user: the last 48 hours of each are held out."""
    rows = table(spark, sf, "events").groupBy("user_id", trunc_grain("ts", "hour").alias("ts")).agg(F.round(F.sum("value"), 4).alias("value"))
    dense = G.make_dense(rows, USER, "hour", 0.0)
    last = rows.groupBy(*USER).agg((F.max("ts") - F.expr("INTERVAL 48 HOURS")).alias("cut"))
    split = dense.join(last, USER).withColumn("split", F.when(F.col("ts") <= F.col("cut"), "train").otherwise("test")).drop("cut")
    return K.back_test(split, USER)


def _user_results(spark, sf):
    """Two result tables keyed by user: early and late behaviour."""
    ev = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), "ts", "value", "event_type")
    measure = lambda d: d.groupBy("key").agg(F.round(F.avg("value"), 4).alias("mean_value"), F.count(F.lit(1)).cast("double").alias("n"),
                                             F.round(F.max("value"), 4).alias("max_value"))
    return measure(ev.where(F.col("ts") < "2024-01-16")), measure(ev.where(F.col("ts") >= "2024-01-16"))


@query
def compare_models(spark, sf):
    left, right = _user_results(spark, sf)
    return rounded(K.distribution(K.paired(left, right)))


@query
def compare_tests(spark, sf):
    pairs = K.paired(*_user_results(spark, sf))
    ranks = K.signed_ranks(pairs).select("metric", "r_plus", "r_minus", F.col("n").alias("n_nonzero"))
    return rounded(K.ks_statistic(pairs).join(ranks, "metric"))


@query
def compare_report(spark, sf):
    left, right = _user_results(spark, sf)
    return K.compare(left, right)


# --- state -----------------------------------------------------------------------------------------

def _versions(spark, sf):
    """Order history of a customer as versions of a model."""
    return table(spark, sf, "orders").select(F.concat(F.lit("customer_"), F.col("o_custkey")).alias("model"), F.col("o_orderkey").alias("version"),
                                             F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))


@query
def state_latest(spark, sf):
    return V.latest_versions(_versions(spark, sf))


@query
def state_retention(spark, sf):
    return V.keep_newest(_versions(spark, sf), ["model"], "version", 5)


@query
def state_retire(spark, sf):
    """Models without an order since 2001 are dropped from the table."""
    versions = _versions(spark, sf)
    tags = F.create_map(*[F.lit(x) for x in ("detector", "orders", "deployment_mode", "dev", "online", "True")])
    store = V.StateStore(spark, work_dir(spark, "state"))
    store.append("model_versions", versions.withColumn("tags", tags).withColumn("run_id", F.lit("import")))
    store.commit("import", "orders", dt.datetime(2001, 1, 1))
    V.retire_models(store, "orders", "dev", versions.where(F.col("created_at") >= "2001-01-01").select("model").distinct())
    return S.intersection(versions, store.read("model_versions"), ["model"])


@query
def incremental_score(spark, sf):
    """Strictly newer observations than the last training time, scored per type."""
    data = _completed(spark, sf)
    early = data.where(F.col("ts") < SPLIT_AT)
    algo = {"both": ALGORITHMS["both"]}
    newer = S.drop_older(data.dense(), early.times.agg(F.max("ts")).scalar())
    checked = D.verdicts(newer, TYPE, D.train(early, TYPE, algo), algo)
    return checked.select("event_type", "ts", "value", "is_anomaly")


DETECTOR = {
    "name": "event_watch", "description": "hourly event value", "budget_group": "none", "git_owners": [],
    "time_spec": {"granularity": "hour", "start": "30 days", "end": None, "retrain": "7 days"},
    "metric_store_metrics": [{"name": "event_value", "dimension_groupings": ["dim_event_type"]}],
    "algorithms": {"both": {"cls": "univariate", "tolerance": TOLERANCE}},
}


@query
def detector_runs(spark, sf):
    """Training and two incremental runs through the state tables; the alerts they wrote."""
    cat, conf = catalog(spark, sf), D.DetectorConfig.from_json(json.dumps(DETECTOR))
    root, sink = work_dir(spark, "state"), work_dir(spark, "alerts")
    store = V.StateStore(spark, root)
    V.train_detector(store, cat, conf, "2024-01-01", SPLIT_AT, dt.datetime(2024, 1, 21), "train-1", "dev")
    for i, end in enumerate(("2024-01-25 00:00:00", "2024-01-31 00:00:00"), 1):
        V.score_detector(store, cat, conf, end, dt.datetime.fromisoformat(end), f"score-{i}", sink, "dev")
    return D.read_anomalies(spark, sink, store.read("runs")).select("entity", "timestamp", F.round("value", 4).alias("value"), "run_id")


@query
def streaming_score(spark, sf):
    """All events as a stream: hourly windows, joined with static parameters, appended per batch."""
    data = _completed(spark, sf).where(F.col("ts") < SPLIT_AT)
    params = materialize(D.train(data, TYPE, {"both": ALGORITHMS["both"]}).params, "params")
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.where(F.col("ts") >= SPLIT_AT).withColumn("ts", F.col("ts").cast("timestamp"))
    metric = Z.windowed_metric(stream, TYPE, F.round(F.sum("value"), 4), "1 hour", "2 hours")
    out, mark = work_dir(spark, "stream"), work_dir(spark, "mark")
    run = Z.start_scoring(Z.score_windows(metric, TYPE, params), out, mark)
    run.awaitTermination()
    done = spark.read.parquet(out)
    return done.select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "is_anomaly")


@query
def streaming_empty_windows(spark, sf):
    """Late events as a stream: hourly windows of every user, those without events with 0, checked against the user's early hours."""
    early = table(spark, sf, "events").where(F.col("ts") < SPLIT_AT).groupBy("user_id", trunc_grain("ts", "hour").alias("ts")).agg(F.round(F.sum("value"), 4).alias("value"))
    params = materialize(D.train(early, USER, {"both": ALGORITHMS["both"]}).params, "params")
    known = early.select("user_id", F.lit(SPLIT_AT).cast("timestamp_ntz").alias("ts")).distinct()
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.where(F.col("ts") >= SPLIT_AT).withColumn("ts", F.col("ts").cast("timestamp"))
    metric = Z.dense_windowed_metric(stream, USER, F.round(F.sum("value"), 4), "1 hour", "2 hours", known)
    out = work_dir(spark, "stream")
    Z.start_scoring(Z.score_windows(metric, USER, params), out, work_dir(spark, "mark")).awaitTermination()
    return spark.read.parquet(out).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "is_anomaly")


# --- bounds ----------------------------------------------------------------------------------------

def _bounds(spark, sf):
    """Three estimators per event type: central quantile bands of the early hours."""
    data = _completed(spark, sf).dense()
    early = data.where(F.col("ts") < SPLIT_AT)
    probs = {f"{side}_{e}": (p if side == "lo" else 1 - p) for e, p in enumerate((0.05, 0.1, 0.2)) for side in ("lo", "hi")}
    q = exact_quantiles(early, TYPE, "value", probs)
    cells = F.explode(F.array(*[F.struct(F.lit(e).alias("estimator"), F.col(f"lo_{e}").alias("lower"), F.col(f"hi_{e}").alias("upper")) for e in range(3)])).alias("_c")
    limits = q.select("event_type", cells).select(F.col("event_type").alias("entity"), "_c.*")
    late = data.where(F.col("ts") >= SPLIT_AT).select("ts", F.col("event_type").alias("entity"), "value")
    return late.join(limits, "entity")


@query
def bounds_score(spark, sf):
    return rounded(B.outside_share(_bounds(spark, sf)))


@query
def bounds_verdict(spark, sf):
    return rounded(B.mean_bounds_verdict(_bounds(spark, sf), "up"))


@query
def pinball_loss(spark, sf):
    return rounded(B.pinball_loss(_bounds(spark, sf), 0.05, ["entity"]))


@query
def bounds_ensemble(spark, sf):
    """Linear reconstruction ensemble over the hourly series of all event types."""
    data = _completed(spark, sf).dense().select("ts", F.col("event_type").alias("entity"), "value")
    model = materialize(B.fit_bounds(data.where(F.col("ts") < SPLIT_AT), estimators=20, max_features=3, latent=2), "bounds")
    return B.outside_share(B.apply_bounds(data, model))


@query
def bounds_alignment(spark, sf):
    """An ensemble fitted without page views scores late hours without clicks: what was scored and what was left out."""
    data = _completed(spark, sf).dense().select("ts", F.col("event_type").alias("entity"), "value")
    early, late = data.where(F.col("ts") < SPLIT_AT), data.where(F.col("ts") >= SPLIT_AT)
    model = materialize(B.fit_bounds(early.where("entity <> 'view'"), estimators=4, max_features=2, latent=1), "bounds")
    scored, left_out = B.score_aligned(late.where("entity <> 'click'"), model)
    done = scored.where("estimator = 0").groupBy("entity").agg(F.count("value").alias("n")).withColumn("status", F.lit("scored"))
    return done.unionByName(left_out)


@query
def bounds_f1_loss(spark, sf):
    score = B.outside_share(_bounds(spark, sf))
    high = table(spark, sf, "events").groupBy(trunc_grain("ts", "hour").alias("ts")).agg((F.max("value") > 250).cast("int").alias("label"))
    rows = score.join(high, "ts").withColumn("trial", F.lit(0)).select("trial", "score", "label")
    return rounded(B.f1_loss(rows, ["trial"]))


@query
def context_rows(spark, sf):
    """The last ten rows per user before the split in front of the new rows."""
    rows = user_series(spark, sf).select("user_id", "ts", "value")
    return B.with_context(rows.where(F.col("ts") < SPLIT_AT), rows.where(F.col("ts") >= SPLIT_AT), USER, 10)
