import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.trend import Options
from tidemark.operators import bounds as B
from tidemark.operators.robust import HUBER_C, HUBER_GAMMA, huber_scale, mad_scale
from tidemark.plans import detect as D
from tidemark.plans import state as V
from tidemark.plans.metrics import MetricSpec, ZeroFilled
from tidemark.sources.catalog import Catalog, Metric, Table
from tidemark.streaming import score as Z


def iterated(values):
    a = np.abs(values)
    s = np.median(a) / 0.6744897501960817
    for _ in range(2000):
        small = a <= HUBER_C * s
        s = np.sqrt((a[small] ** 2).sum() / (len(a) * HUBER_GAMMA - (~small).sum() * HUBER_C**2))
    return s


@pytest.mark.parametrize("rows", ["1000000", "60"])
def test_scales(spark, rows):
    rng = np.random.default_rng(2)
    samples = {"normal": rng.normal(size=400), "tails": rng.standard_t(2, 300), "ties": rng.integers(-4, 9, 200).astype(float), "few": rng.normal(size=9), "zeros": np.r_[np.zeros(90), rng.normal(size=10)]}
    pdf = pd.concat([pd.DataFrame({"k": k, "value": v}) for k, v in samples.items()])
    df = spark.createDataFrame(pdf)
    spark.conf.set("tidemark.hotRows", rows)
    huber = {r.k: r.scale for r in huber_scale(df, ["k"]).collect()}
    mad = {r.k: r.scale for r in mad_scale(df, ["k"]).collect()}
    spark.conf.unset("tidemark.hotRows")
    assert "few" not in huber and huber["zeros"] is None
    for k in ("normal", "tails", "ties"):
        assert huber[k] == pytest.approx(iterated(samples[k]), rel=1e-8)
        assert mad[k] == pytest.approx(np.median(np.abs(samples[k])) / 0.6744897501960817)


@pytest.mark.parametrize("rows", ["1000000", "60"])
def test_implied_zeros_give_the_scales_of_the_grid(spark, rows):
    rng = np.random.default_rng(5)
    days = pd.date_range("2024-01-01", periods=120, freq="D")
    frames = [pd.DataFrame({"k": k, "ts": days[at], "value": rng.normal(10, 4, len(at))}) for k, share in (("full", 1.0), ("some", 0.8), ("half", 0.5), ("rare", 0.1)) for at in [np.flatnonzero(rng.random(120) < share)]]
    frames += [pd.DataFrame({"k": "dup", "ts": days[[3, 3, 4]], "value": [1.0, 5.0, np.nan]}), pd.DataFrame({"k": [None], "ts": days[:1], "value": [1.0]})]
    df = spark.createDataFrame(pd.concat(frames)).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    series = ZeroFilled.of(df, "value", ["k"], "ts")
    spark.conf.set("tidemark.hotRows", rows)
    part = series.where(F.col("ts") < "2024-03-01")
    for scale in (huber_scale, mad_scale):
        got = {r.k: r.asDict() for r in scale(part.cells, ["k"], zeros=part.zeros()).collect()}
        want = {r.k: r.asDict() for r in scale(part.dense(), ["k"]).collect()}
        assert set(got) == set(want) == {"full", "some", "half", "rare", "dup"}
        for k, row in want.items():
            assert {c: pytest.approx(v) for c, v in row.items()} == got[k]
    algos = {"both": D.Algorithm(tolerance=1.5), "up": D.Algorithm(tolerance=1.0, direction="up")}
    late = series.where(F.col("ts") >= "2024-03-01")
    found = {tuple(r) for r in D.anomaly_rows(D.verdicts(late, ["k"], D.train(part, ["k"], algos), algos), ["k"]).collect()}
    full = {tuple(r) for r in D.anomaly_rows(D.verdicts(late.dense(), ["k"], D.train(part.dense(), ["k"], algos), algos), ["k"]).collect()}
    assert found == full and found
    reports = [{tuple(r) for r in D.train(x, ["k"], algos).report.collect()} for x in (part, part.dense())]
    assert reports[0] == reports[1]
    plan = D.verdicts(late, ["k"], D.train(part, ["k"], algos), algos)._jdf.queryExecution().toString()
    spark.conf.unset("tidemark.hotRows")
    assert "_salt" not in plan


@pytest.fixture(scope="module")
def observed(spark):
    rng = np.random.default_rng(4)
    ts = pd.date_range("2024-01-01", periods=24 * 12, freq="h")
    frames = []
    for k in ("x", "y"):
        v = 10 * np.sin(2 * np.pi * np.arange(len(ts)) / 24) + rng.normal(size=len(ts))
        v[250] += 40
        v[260] -= 40
        frames.append(pd.DataFrame({"k": k, "ts": ts, "value": v}))
    return spark.createDataFrame(pd.concat(frames)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_directions_and_models(observed):
    algos = {n: D.Algorithm(tolerance=8.0, direction=d, model=Options(passes=20)) for n, d in (("up", "up"), ("down", "down"), ("both", None))}
    early, late = observed.where("ts < '2024-01-11'"), observed.where("ts >= '2024-01-11'")
    trained = D.train(early, ["k"], algos)
    extra = late.where("k = 'x'").withColumn("k", F.lit("unknown"))
    checked = D.verdicts(late.unionByName(extra), ["k"], trained, algos)
    found = {(r.algorithm_name, r.entity, str(r.timestamp)) for r in D.anomaly_rows(checked, ["k"]).collect()}
    up, down = "2024-01-11 10:00:00", "2024-01-11 20:00:00"
    want = {(a, k, t) for k in "xy" for a, t in (("up", up), ("down", down), ("both", up), ("both", down))}
    assert found == want
    assert {(r.algorithm_name, r["k"], r["count"]) for r in D.unscored(checked, ["k"]).collect()} == {(a, "unknown", 48) for a in algos}


def test_training_report(observed):
    algos = {"raw": D.Algorithm(tolerance=8.0), "model": D.Algorithm(tolerance=8.0, model=Options(passes=5))}
    one = observed.where("k = 'x'")
    kinds = {"x": F.col("value"), "zero": F.lit(0.0), "inf": F.when(F.hour("ts") == 1, float("inf")).otherwise(F.col("value")), "null": F.lit(None).cast("double")}
    df = one.limit(0)
    for k, value in kinds.items():
        df = df.unionByName(one.withColumns({"k": F.lit(k), "value": value}))
    df = df.unionByName(one.where("ts < '2024-01-01 04:00:00'").withColumn("k", F.lit("few")))
    trained = D.train(df, ["k"], algos)
    got = {(r.algorithm_name, r.k): r.status for r in trained.report.collect()}
    assert got == {("raw", "x"): "ok", ("raw", "zero"): "no scale", ("raw", "inf"): "ok", ("raw", "null"): "empty", ("raw", "few"): "short",
                   ("model", "x"): "ok", ("model", "zero"): "no scale", ("model", "inf"): "not finite", ("model", "null"): "empty", ("model", "few"): "short"}
    assert {(r.algorithm_name, r.k) for r in trained.params.where("scale IS NOT NULL").collect()} == {("raw", "x"), ("raw", "inf"), ("model", "x")}


def test_transforms(observed):
    algo = {"chain": D.Algorithm.from_args({"tolerance": 6.0, "transforms": ["residuals"]})}
    trained = D.train(observed, ["k"], algo)
    found = D.anomaly_rows(D.verdicts(observed, ["k"], trained, algo), ["k"])
    assert {str(r.timestamp) for r in found.collect()} >= {"2024-01-11 10:00:00", "2024-01-11 20:00:00"}


def test_config():
    text = json.dumps({"name": "w", "description": "d", "budget_group": "b", "git_owners": ["o"], "time_spec": {"granularity": "hour", "start": "14 days", "end": None, "retrain": None},
                       "metric_store_metrics": [{"name": "m", "dimension_groupings": ["g"]}], "algorithms": {"univariate": {"tolerance": 3, "model": {"args": {"weekly_order": 1}}}}})
    conf = D.DetectorConfig.from_json(text)
    assert conf.metrics[0] == MetricSpec("m", "hour", ["g"], []) and conf.algorithms["univariate"].model.weekly_order == 1
    with pytest.raises(ValueError):
        D.DetectorConfig.from_dict({**json.loads(text), "algorithms": {"other": {}}})
    with pytest.raises(ValueError):
        D.Algorithm.from_args({"transforms": ["none"]})


def test_alert_table(observed, tmp_path, spark):
    rows = observed.where("value > 40").select(F.lit("a").alias("algorithm_name"), F.col("k").alias("entity"), F.col("ts").alias("timestamp"), "value", F.lit("{}").alias("metadata"))
    full = D.with_run(rows, "w", "r1", dt.datetime(2024, 2, 1), "{}", tags={"team": "t"})
    assert full.schema["entity"].metadata["comment"]
    for _ in range(2):
        D.append_anomalies(full, str(tmp_path / "alerts"))
    back = D.read_all_anomalies(spark, str(tmp_path / "alerts"))
    assert back.columns == D.ANOMALY_SCHEMA.names and back.count() == 2 * full.count() and back.first().tags == {"team": "t"}


# --- state -----------------------------------------------------------------------------------------

CONF = {"name": "w", "time_spec": {"granularity": "hour", "start": "9 days", "end": None, "retrain": "7 days"},
        "metric_store_metrics": [{"name": "total", "dimension_groupings": ["dim_k"]}], "algorithms": {"univariate": {"tolerance": 2.0}}}


@pytest.fixture(scope="module")
def catalog(observed, spark):
    facts = observed.select(F.monotonically_increasing_id().alias("row_id"), "ts", F.col("k").alias("dim_k"), F.round("value", 3).alias("m_v"))
    return Catalog(spark, [Table.from_frame("f", "fact", facts)], [Metric("total", "SUM(m_v)")])


def test_runs_in_steps_equal_one_run(spark, catalog, tmp_path):
    conf = D.DetectorConfig.from_dict(CONF)
    alerts = {}
    for name, ends in (("one", ["2024-01-13"]), ("steps", ["2024-01-10 12:30:00", "2024-01-11", "2024-01-11 15:00:00", "2024-01-13"])):
        store = V.StateStore(spark, str(tmp_path / name))
        models = V.train_detector(store, catalog, conf, "2024-01-01", "2024-01-10", dt.datetime(2024, 1, 10), "t", "dev")
        assert models == ["w__total__dim_k__dev_online"]
        for i, end in enumerate(ends):
            retrain = V.score_detector(store, catalog, conf, end, dt.datetime(2024, 1, 10 + i), f"s{i}", str(tmp_path / f"alerts-{name}"), "dev")
            assert retrain is False
        rows = D.read_all_anomalies(spark, str(tmp_path / f"alerts-{name}"))
        alerts[name] = {(r.entity, r.timestamp, r.value) for r in rows.collect()}
        assert rows.count() == len(alerts[name])
        lost = rows.limit(1).withColumn("run_id", F.lit("lost"))  # a run that never committed
        D.append_anomalies(lost, str(tmp_path / f"alerts-{name}"))
        assert D.read_anomalies(spark, str(tmp_path / f"alerts-{name}"), store.read("runs")).count() == len(alerts[name])
        last = V.latest_versions(store.read("model_versions")).first()
        assert last.tags["last_evaluation_ts"] == "2024-01-12 23:00:00" and last.version == 1 + len(ends)
    assert alerts["one"] == alerts["steps"] and alerts["one"]
    assert {(r.algorithm_name, r.entity_keys, r.n, r.status) for r in store.read("reports").collect()} == {("univariate", f'{{"dim_k":"{k}"}}', 24 * 9, "ok") for k in "xy"}
    assert store.read("training_snapshot").count() == 2 * 24 * 9
    assert V.training_data(store, "t", "total", ["dim_k"]).dense().count() == 2 * 24 * 9
    # retraining keeps the watermark and retires models that are no longer configured
    moved = D.DetectorConfig.from_dict({**CONF, "metric_store_metrics": [{"name": "total", "dimension_groupings": []}]})
    V.train_detector(store, catalog, conf, "2024-01-01", "2024-01-12", dt.datetime(2024, 1, 14), "t2", "dev")
    assert V.last_evaluation(store.read("model_versions"), models[0], None) == dt.datetime(2024, 1, 12, 23)
    V.trim_versions(store, 2)
    assert store.read("model_versions").count() == 2
    V.train_detector(store, catalog, moved, "2024-01-01", "2024-01-12", dt.datetime(2024, 1, 14), "t3", "dev")
    assert {r.model for r in store.read("model_versions").collect()} == {"w__total____dev_online"}


def test_unfinished_run_is_invisible(spark, tmp_path):
    store = V.StateStore(spark, str(tmp_path / "s"))
    row = [("m", 1, {"online": "True"}, dt.datetime(2024, 1, 1), "r1")]
    store.append("model_versions", spark.createDataFrame(row, V.SCHEMAS["model_versions"]))
    assert store.read("model_versions").isEmpty()
    store.commit("r1", "run", dt.datetime(2024, 1, 1))
    assert store.read("model_versions").count() == 1
    for i in range(2, 6):
        store.commit(f"r{i}", "run", dt.datetime(2024, 1, i))
    V.trim_runs(store, "run", 2)
    assert {r.run_id for r in store.read("runs").collect()} == {"r1", "r4", "r5"}  # r1 carries a live version


def test_state_stays_bounded_and_readers_see_one_version(spark, tmp_path):
    root = tmp_path / "s"
    store = V.StateStore(spark, str(root))
    row = lambda i, run: spark.createDataFrame([(f"m{i % 3}", "a", "{}", i, "ok", None, run)], V.SCHEMAS["reports"]).coalesce(1)
    for i in range(30):
        store.append("reports", row(i, f"r{i}"))
        if i % 10 != 9:  # every tenth run is lost
            store.commit(f"r{i}", "run", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i))
        if i == 20:
            reader = V.StateStore(spark, str(root)).read("reports")
            before = reader.count()
        if i % 4 == 3:
            store.tidy(max_files=6)
        if i == 23:
            assert reader.count() == before  # a reader from before the last rewrite
    want = {i for i in range(30) if i % 10 != 9}
    assert {r.n for r in V.StateStore(spark, str(root)).read("reports").collect()} == want
    V.trim_runs(store, "run", 5)
    files = [f for f in root.rglob("part-*.parquet")]
    assert len(files) < 45 and len(list((root / "_manifest").iterdir())) <= V.KEEP
    assert store.tidy(max_files=0) and store.files("reports") == 1
    assert {r.n for r in V.StateStore(spark, str(root)).read("reports").collect()} == want & set(range(24, 30))
    (root / "_manifest" / "v=999").mkdir()  # a manifest that was never completed does not count
    assert V.StateStore(spark, str(root)).read("reports").count() == len(want & set(range(24, 30)))


def test_retrain_rule(spark):
    models = spark.createDataFrame([("m", dt.datetime(2024, 1, 1))], "model string, created_at timestamp_ntz")
    now = dt.datetime(2024, 1, 8)
    assert V.needs_retrain(models, now, None) and V.needs_retrain(models.where("false"), now, "7 days")
    assert V.needs_retrain(models, now, "7 days") and not V.needs_retrain(models, now, "8 days")
    with pytest.raises(ValueError):
        V.last_evaluation(spark.createDataFrame([], V.SCHEMAS["model_versions"]), "m", None)


def test_model_names():
    spec = MetricSpec("m", "hour", ["a", "b"])
    assert V.model_name("d", spec) == "d__m__a__b_online" and V.model_name("d", spec, "dev", False) == "d__m__a__b__dev"


# --- streaming -------------------------------------------------------------------------------------

def test_stream_drops_late_rows_and_replays(spark, tmp_path):
    src = str(tmp_path / "in")
    batch = lambda rows: spark.createDataFrame([(k, pd.Timestamp(t).to_pydatetime(), v) for k, t, v in rows], "k string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(src)
    params = spark.createDataFrame([("a", "x", 1.0, 5.0, None)], "k string, algorithm_name string, scale double, tolerance double, direction string")

    def run():
        stream = spark.readStream.schema("k string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(src)
        metric = Z.windowed_metric(stream, ["k"], F.sum("value"), "1 hour", "1 hour")
        Z.start_scoring(Z.score_windows(metric, ["k"], params), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()

    batch([("a", "2024-01-01 00:10", 3.0), ("a", "2024-01-01 00:50", 4.0), ("b", "2024-01-01 00:20", 9.0), ("a", "2024-01-01 04:00", 1.0)])
    run()
    batch([("a", "2024-01-01 00:30", 100.0), ("a", "2024-01-01 09:00", 1.0)])  # the first row is too late
    run()
    got = {(r.k, str(r.ts)): (r.value, r.is_anomaly, r.has_model) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "2024-01-01 00:00:00"): (7.0, True, True), ("b", "2024-01-01 00:00:00"): (9.0, False, False), ("a", "2024-01-01 04:00:00"): (1.0, False, True)}


def test_stream_with_empty_windows_equals_the_table(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "k string, g long, ts timestamp, value double"
    make = lambda rows: spark.createDataFrame([(k, 1, pd.Timestamp(t).to_pydatetime(), v) for k, t, v in rows], schema)
    batch = lambda rows: make(rows).coalesce(1).write.mode("append").parquet(src)
    keys = ["k", "g"]
    # q never sends a row, a is known from before its first row, r sends one before the time it is known from
    known = make([("q", "2024-01-01 01:20", 0.0), ("a", "2023-12-31 22:00", 0.0), ("r", "2024-01-01 06:00", 0.0), ("z", "2024-01-05 00:00", 0.0)])
    params = spark.createDataFrame([("a", 1, "x", 1.0, 5.0, None)], "k string, g long, algorithm_name string, scale double, tolerance double, direction string")
    lost = {"left": 1}

    def fail_once(df):
        if lost["left"] and not df.isEmpty():
            lost["left"] -= 1
            raise RuntimeError("lost")
        return df

    def run(each=None):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        metric = Z.dense_windowed_metric(stream, keys, F.sum("value"), "1 hour", "1 hour", known)
        Z.start_scoring(Z.score_windows(metric, keys, params), str(tmp_path / "out"), str(tmp_path / "mark"), each).awaitTermination()

    batch([("a", "2024-01-01 00:10", 3.0), ("a", "2024-01-01 00:50", 4.0), ("b", "2024-01-01 00:20", 9.0), ("r", "2024-01-01 01:00", 2.0), (None, "2024-01-01 02:00", 1.0), ("a", "2024-01-01 04:00", 1.0)])
    run()
    batch([("a", "2024-01-01 09:00", 1.0), ("c", "2024-01-01 08:00", 1.0)])
    with pytest.raises(Exception):
        run(fail_once)
    run(fail_once)  # the lost batch again
    batch([("b", "2024-01-01 15:30", 1.0), ("b", "2024-01-01 15:10", -8.0)])
    batch([("b", "2024-01-02 03:00", 1.0)])
    run()
    got = sorted(((r.k, r.g, r.ts, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    want = sorted(map(tuple, Z.dense_windows(spark.read.parquet(src), keys, F.sum("value"), "1 hour", "1 hour", known).collect()), key=str)
    assert lost["left"] == 0 and got == want
    assert {(r[0], str(r[2])) for r in got} >= {("q", "2024-01-01 01:00:00"), ("a", "2023-12-31 22:00:00"), ("r", "2024-01-01 01:00:00"), (None, "2024-01-01 05:00:00")}
    assert not any(r[0] == "z" or (r[0] == "r" and str(r[2]) == "2024-01-01 03:00:00") for r in got)
    assert {str(r.ts) for r in spark.read.parquet(str(tmp_path / "out")).where("is_anomaly").collect()} == {"2024-01-01 00:00:00"}


# --- bounds ----------------------------------------------------------------------------------------

def test_bounds_verdicts(spark):
    rows = [("t1", "a", 0, 5.0, 0.0, 4.0), ("t1", "a", 1, 5.0, 0.0, 8.0), ("t1", "b", 0, -3.0, 0.0, 4.0), ("t1", "b", 1, -3.0, -1.0, 4.0)]
    df = spark.createDataFrame(rows, "ts string, entity string, estimator int, value double, lower double, upper double")
    assert B.outside_share(df).first().score == 0.75
    verdict = lambda d: {r.entity: r.is_anomaly for r in B.mean_bounds_verdict(df, d).collect()}
    assert verdict(None) == {"a": False, "b": True} and verdict("up") == {"a": False, "b": False} and verdict("down") == {"a": False, "b": True}
    e_up, e_lo = [1.0, -3.0, -7.0, -7.0], [5.0, 5.0, -3.0, -2.0]
    want = np.mean([max(0.9 * e, -0.1 * e) for e in e_up]) + np.mean([max(0.1 * e, -0.9 * e) for e in e_lo])
    assert B.pinball_loss(df, 0.1).first().loss == pytest.approx(want)


def test_linear_ensemble(spark):
    rng = np.random.default_rng(8)
    n, base = 400, rng.normal(size=400)
    pdf = pd.DataFrame({f"s{j}": (j + 1) * base + 0.05 * rng.normal(size=n) for j in range(4)})
    pdf.loc[350, "s2"] += 5.0
    long = pdf.assign(ts=pd.date_range("2024-01-01", periods=n, freq="min")).melt("ts", var_name="entity", value_name="value")
    df = spark.createDataFrame(long).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    model = B.fit_bounds(df.where("ts < '2024-01-01 05:00:00'"), estimators=12, max_features=3, latent=1, delta=0.01)
    assert model.count() == 48 and model.where("axis IS NOT NULL").count() == 36  # every estimator covers every entity
    few = B.fit_bounds(df.where("entity < 's2'"), estimators=2, max_features=5, latent=3)
    assert {(r.estimator, r.entity) for r in few.collect()} == {(e, s) for e in (0, 1) for s in ("s0", "s1")}
    gaps = B.apply_bounds(df.where("entity <> 's1'"), model)
    assert {r.entity for r in gaps.select("entity").distinct().collect()} == {"s0", "s2", "s3"}
    with pytest.raises(ValueError):
        B.fit_bounds(df.limit(0))
    score = B.outside_share(B.apply_bounds(df, model)).orderBy("ts").toPandas().score
    assert score.idxmax() == 350 and score[:300].mean() < 0.05


def test_aligned_scores_report_added_and_missing_entities(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(80, 4)), columns=list("abcd")).assign(ts=pd.date_range("2024-01-01", periods=80, freq="min"))
    df = spark.createDataFrame(pdf.melt("ts", var_name="entity", value_name="value")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    model = B.fit_bounds(df.where("entity <> 'd'"), estimators=3, max_features=2, latent=1)
    scored, left_out = B.score_aligned(df.where("entity <> 'a'"), model)
    assert {(r.entity, r.n, r.status) for r in left_out.collect()} == {("d", 80, "not in the model"), ("a", 0, "no values")}
    assert {(r.entity, r["count"]) for r in scored.groupBy("entity").count().collect()} == {("b", 240), ("c", 240)}


def test_context(spark):
    old = spark.createDataFrame([("a", dt.datetime(2024, 1, i), float(i)) for i in range(1, 6)], "k string, ts timestamp_ntz, value double")
    new = spark.createDataFrame([("a", dt.datetime(2024, 1, 9), 9.0)], old.schema)
    rows = B.with_context(old, new, ["k"], 2)
    assert sorted(r.value for r in rows.collect()) == [4.0, 5.0, 9.0]
    assert sorted(r.value for r in B.next_context(rows, ["k"], 2).collect()) == [5.0, 9.0]
