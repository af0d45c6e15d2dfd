"""Model versions, detector state and runs as tables; incremental scoring and retraining.

Every table is a folder of generations. Appends go to the newest generation; a rewrite (retention, compaction)
writes a new one. Which generation of each table counts is said by the newest complete manifest, a small folder written
after the data. Rows carry the id of the run that wrote them and count only once that run is recorded in ``runs``, the
last write of a run. So a lost job leaves nothing half visible and can be run again under a new id.

Runs leave many small files. ``tidy`` rewrites a table whose newest generation has more than ``max_files``: rows of
completed runs that are still listed stay, rows of lost and trimmed runs go. Manifests before the last ``KEEP`` and
generations that these do not name are deleted, so a reader that opened a table still finds its files while the next
generation is written, and reads never scan history.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import join_on
from tidemark.functions.timeunits import parse_granularity, step_from
from tidemark.operators.grid import run_bounds
from tidemark.operators.series import TS, VALUE
from tidemark.plans import detect as D
from tidemark.plans.forecast import MODEL_FIELDS
from tidemark.plans.metrics import METRIC_TIME, MetricSpec, ZeroFilled, metric_query
from tidemark.sources.catalog import Catalog

NTZ, STR = T.TimestampNTZType(), T.StringType()
_TAGS = T.MapType(STR, STR)
SCHEMAS = {
    "runs": T.StructType([T.StructField("run_id", STR), T.StructField("name", STR), T.StructField("start_time", NTZ), T.StructField("params", _TAGS)]),
    "model_versions": T.StructType([T.StructField("model", STR), T.StructField("version", T.LongType()), T.StructField("tags", _TAGS),
                                    T.StructField("created_at", NTZ), T.StructField("run_id", STR)]),
    "model_params": T.StructType([T.StructField("model", STR), T.StructField("trained_by", STR), T.StructField("algorithm_name", STR),
                                  T.StructField("entity_keys", STR), T.StructField("n", T.LongType()), T.StructField("scale", T.DoubleType()),
                                  T.StructField("tolerance", T.DoubleType()), T.StructField("direction", STR), T.StructField("run_id", STR)]),
    "forecast_models": T.StructType([T.StructField("model", STR), T.StructField("trained_by", STR), T.StructField("algorithm_name", STR),
                                     T.StructField("entity_keys", STR), *MODEL_FIELDS, T.StructField("run_id", STR)]),
    "training_snapshot": T.StructType([T.StructField("run_id", STR), T.StructField("metric", STR), T.StructField("entity_keys", STR),
                                       T.StructField("ts", NTZ), T.StructField("value", T.DoubleType())]),
    "reports": T.StructType([T.StructField("model", STR), T.StructField("algorithm_name", STR), T.StructField("entity_keys", STR),
                             T.StructField("n", T.LongType()), T.StructField("status", STR), T.StructField("reason", STR), T.StructField("run_id", STR)]),
    "_manifest": T.StructType([T.StructField("table", STR), T.StructField("generation", T.LongType())]),
}
#: Manifests that stay, the newest included.
KEEP = 2


class StateStore:
    """State tables below one shared folder; one store serves one job at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._known: dict[str, int] | None = None

    def _path(self, table: str, generation: int) -> str:
        return os.path.join(self.root, table, f"gen={generation}")

    def _load(self, path: str, table: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        schema = SCHEMAS[table]
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def _folder(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *path: str) -> list[str]:
        folder, fs = self._folder(os.path.join(self.root, *path))
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def _drop(self, *path: str) -> None:
        folder, fs = self._folder(os.path.join(self.root, *path))
        fs.delete(folder, True)

    def _manifests(self) -> list[int]:
        """Numbers of the complete manifests in order."""
        found = sorted(int(n[2:]) for n in self._names("_manifest") if n.startswith("v="))
        return [n for n in found if "_SUCCESS" in self._names("_manifest", f"v={n}")]

    def _manifest(self, number: int) -> dict[str, int]:
        rows = self._load(os.path.join(self.root, "_manifest", f"v={number}"), "_manifest").collect()  # one row per state table
        return {r["table"]: r["generation"] for r in rows}

    def _generation(self, table: str) -> int:
        if self._known is None:
            numbers = self._manifests()
            self._known = self._manifest(numbers[-1]) if numbers else {}
        return self._known.get(table, 0)

    def append(self, table: str, df: DataFrame) -> None:
        df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[table]]).write.mode("append").parquet(self._path(table, self._generation(table)))

    def read(self, table: str) -> DataFrame:
        """Rows written by completed runs."""
        rows = self._load(self._path(table, self._generation(table)), table)
        return rows if table == "runs" else join_on(rows, self.read("runs").select("run_id").distinct(), ["run_id"], "left_semi")

    def replace(self, table: str, df: DataFrame) -> None:
        """A new generation with the rows of ``df``; readers switch once its manifest is complete."""
        self.replace_all({table: df})

    def replace_all(self, tables: dict[str, DataFrame]) -> None:
        """New generations of several tables under one manifest: a reader sees all of them or none."""
        now = {**{t: self._generation(t) for t in tables}, **self._known}
        for table, df in tables.items():
            now[table] = self._generation(table) + 1
            df.select(*SCHEMAS[table].names).write.mode("overwrite").parquet(self._path(table, now[table]))
        numbers = self._manifests()
        number = numbers[-1] + 1 if numbers else 1
        rows = self.spark.createDataFrame(sorted(now.items()), SCHEMAS["_manifest"]).coalesce(1)
        rows.write.mode("overwrite").parquet(os.path.join(self.root, "_manifest", f"v={number}"))
        self._known = now
        self._forget(number)

    def _forget(self, newest: int) -> None:
        """Delete manifests before the last ``KEEP`` and the generations that only they name."""
        numbers = [n for n in self._manifests() if n <= newest]
        kept = [self._manifest(n) for n in numbers[-KEEP:]]
        for n in numbers[:-KEEP]:
            self._drop("_manifest", f"v={n}")
        for table in SCHEMAS:
            oldest = min(m.get(table, 0) for m in kept)
            for name in self._names(table):
                if name.startswith("gen=") and int(name[4:]) < oldest:
                    self._drop(table, name)

    def files(self, table: str) -> int:
        """Data files of the newest generation."""
        return sum(n.startswith("part-") for n in self._names(table, f"gen={self._generation(table)}"))

    def tidy(self, max_files: int = 64) -> list[str]:
        """Rewrite tables of more than ``max_files`` files, for the job that holds the store; returns their names."""
        done = [t for t in SCHEMAS if not t.startswith("_") and self.files(t) > max_files]
        rewritten = {}
        for table in done:
            folder, fs = self._folder(self._path(table, self._generation(table)))
            size = fs.getContentSummary(folder).getLength()
            rewritten[table] = self.read(table).repartition(max(1, min(max_files, -(-size // (128 << 20)))))
        if rewritten:
            self.replace_all(rewritten)
        return done

    def commit(self, run_id: str, name: str, start, params: dict[str, str] | None = None) -> None:
        self.append("runs", self.spark.createDataFrame([(run_id, name, start, params or {})], SCHEMAS["runs"]))


# --- versions ------------------------------------------------------------------------------------

def latest_versions(versions: DataFrame, model: str = "model", version: str = "version") -> DataFrame:
    """The newest row of every model, by one aggregate."""
    rest = [c for c in versions.columns if c != model]
    newest = versions.groupBy(model).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    return newest.select(model, *[F.col(f"_r.{c}").alias(c) for c in rest])


def keep_newest(df: DataFrame, groups: Sequence[str], order: str, n: int) -> DataFrame:
    """The ``n`` newest rows of every group."""
    from tidemark.operators.ordered import OrderedRows

    ties = [c for c in df.columns if c not in groups and c != order and dict(df.dtypes)[c] in ("string", "bigint", "int")][:1]
    return OrderedRows(df, groups, [f"-{order}", *ties]).position("_r").frame().where(F.col("_r") <= n).drop("_r")


def model_name(detector: str, spec: MetricSpec, mode: str = "prod", online: bool = True) -> str:
    parts = [detector, spec.name, "__".join(spec.dimension_groupings or [])]
    return "__".join(parts + ([mode] if mode != "prod" else [])) + ("_online" if online else "")


def find_models(versions: DataFrame, **tags: str) -> DataFrame:
    for k, v in tags.items():
        versions = versions.where(F.col("tags")[k] == v)
    return versions


def last_evaluation(versions: DataFrame, model: str, training: DataFrame | None, column: str = TS):
    """Watermark of a model, or the last training time where there is none yet."""
    row = latest_versions(versions.where(F.col("model") == model)).select(F.col("tags")["last_evaluation_ts"].cast("timestamp_ntz").alias("t")).first()
    if row is not None and row["t"] is not None:
        return row["t"]
    if training is None:
        raise ValueError(f"no version of {model} and no training data: the last evaluation time is unknown")
    return training.agg(F.max(column)).first()[0]


def needs_retrain(models: DataFrame, now: datetime, retrain: str | None) -> bool:
    """No age given: always. No model: yes. Any model at least that old: all of them."""
    if retrain is None:
        return True
    born = F.col("created_at").cast("timestamp_ntz")
    due = step_from(born, F.lit(1), parse_granularity(retrain)) <= F.lit(now).cast("timestamp_ntz")
    row = models.agg(F.count(F.lit(1)).alias("n"), F.max(due).alias("due")).first()
    return row["n"] == 0 or bool(row["due"])


# --- runs ----------------------------------------------------------------------------------------

def _entity_json(keys: Sequence[str]):
    return F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]), {"ignoreNullFields": "false"}) if keys else F.lit("{}")


def _entity_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.get_json_object("entity_keys", f"$.{k}").alias(k) for k in keys], *[c for c in df.columns if c != "entity_keys"])


def observations(catalog: Catalog, spec: MetricSpec, start, end, newer_than=None, grain_complete: bool = True) -> ZeroFilled:
    """Series of a metric, gaps zero and without rows. With ``newer_than`` only strictly newer buckets.

    Buckets that end after ``end`` are left for the next run, so no partial bucket is ever scored.
    """
    keys = list(spec.dimension_groupings or [])
    raw = metric_query(catalog, spec.name, spec.query(start, end))
    if newer_than is not None:
        raw = raw.where(F.col(METRIC_TIME) > F.lit(newer_than).cast("timestamp_ntz"))
    if grain_complete:
        closes = step_from(F.col(METRIC_TIME), F.lit(1), parse_granularity(spec.time_granularity))
        raw = raw.where(closes <= F.lit(end).cast("timestamp_ntz"))
    rows = raw.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(METRIC_TIME).cast("timestamp_ntz").alias(TS), F.col(spec.name).cast("double").alias(VALUE))
    return ZeroFilled.of(rows, VALUE, keys, TS)


def train_detector(store: StateStore, catalog: Catalog, conf: D.DetectorConfig, start, end, now, run_id: str, mode: str = "prod",
                   keep_runs: int = 15) -> list[str]:
    """Train every metric of a detector and register the models. Models not trained here are retired, old versions go.

    Without ``start`` or ``end`` the time range is that of the detector's configuration at ``now``.
    """
    start, end = _times(store, conf, now, start, end)
    names = []
    versions = store.read("model_versions")
    for spec in conf.metrics:
        keys = list(spec.dimension_groupings or [])
        data = observations(catalog, spec, start, end)
        trained = D.train(data, keys, conf.algorithms)
        name = model_name(conf.name, spec, mode)
        tagged = lambda df: df.withColumns({"model": F.lit(name), "trained_by": F.lit(run_id), "run_id": F.lit(run_id), "entity_keys": _entity_json(keys)})
        store.append("model_params", tagged(trained.params))
        store.append("reports", tagged(trained.report))
        for algo, models in trained.models.items():
            store.append("forecast_models", tagged(models.withColumn("algorithm_name", F.lit(algo))))
        store.append("training_snapshot", data.cells.select(F.lit(run_id).alias("run_id"), F.lit(spec.name).alias("metric"), _entity_json(keys).alias("entity_keys"), TS, VALUE))
        watermark = last_evaluation(versions, name, data.times)
        tags = {"online": "True", "detector": conf.name, "deployment_mode": mode, "creation_run_id": run_id, "last_evaluation_ts": str(watermark),
                "datasource": "metric_store", "query": spec.to_json(), "trained_by": run_id}
        _add_version(store, versions, name, tags, now, run_id)
        names.append(name)
    store.commit(run_id, f"training_{conf.name}", now, {n: json.dumps(str(a)) for n, a in conf.algorithms.items()})
    retire_models(store, conf.name, mode, names)
    trim_versions(store)
    trim_runs(store, f"training_{conf.name}", keep_runs)
    store.tidy()
    return names


def training_data(store: StateStore, run_id: str, metric: str, keys: Sequence[str]) -> ZeroFilled:
    """The series a run trained on. The snapshot has a row for every value that was there."""
    rows = store.read("training_snapshot").where((F.col("run_id") == run_id) & (F.col("metric") == metric)).select("entity_keys", TS, VALUE)
    return ZeroFilled.of(_entity_columns(rows, keys), VALUE, keys, TS)


def _times(store: StateStore, conf: D.DetectorConfig, now, start, end) -> tuple:
    if start is None and conf.time_spec.start is None:
        raise ValueError(f"detector {conf.name} has no start time")
    if start is None or end is None:
        row = run_bounds(store.spark, now, conf.time_spec.start, conf.time_spec.end).first()
        start, end = row["start_ts"] if start is None else start, row["end_ts"] if end is None else end
    return start, end


def _add_version(store: StateStore, versions: DataFrame, name: str, tags: dict[str, str], now, run_id: str) -> None:
    top = versions.where(F.col("model") == name).agg(F.coalesce(F.max("version"), F.lit(0).cast("long"))).first()[0]
    store.append("model_versions", store.spark.createDataFrame([(name, top + 1, tags, now, run_id)], SCHEMAS["model_versions"]))


def retire_models(store: StateStore, detector: str, mode: str, keep: Sequence[str] | DataFrame) -> None:
    """Drop the online models of a detector that the last training did not renew.

    ``keep`` names the models that stay: a short list, or a table with a column ``model``.
    """
    versions = store.read("model_versions")
    stale = (F.col("tags")["detector"] == detector) & (F.col("tags")["deployment_mode"] == mode) & (F.col("tags")["online"] == "True")
    dead = join_on(versions.where(stale), keep, ["model"], "left_anti") if isinstance(keep, DataFrame) else versions.where(stale & ~F.col("model").isin(list(keep)))
    if not dead.isEmpty():
        store.replace("model_versions", join_on(versions, dead.select("model").distinct(), ["model"], "left_anti"))


def trim_versions(store: StateStore, n: int = 5) -> None:
    versions = store.read("model_versions")
    store.replace("model_versions", keep_newest(versions, ["model"], "version", n))


def trim_runs(store: StateStore, name: str, n: int = 200) -> None:
    """Keep the newest runs of a name in ``runs``. Runs that live model versions rest on stay."""
    runs = store.read("runs")
    mine = runs.where(F.col("name") == name)
    kept = keep_newest(mine, ["name"], "start_time", n)
    needed = store.read("model_versions").select(F.explode(F.array("run_id", F.col("tags")["trained_by"])).alias("run_id")).distinct()
    dropped = join_on(join_on(mine, kept, ["run_id"], "left_anti"), needed, ["run_id"], "left_anti")
    if not dropped.isEmpty():
        store.replace("runs", join_on(runs, dropped.select("run_id"), ["run_id"], "left_anti"))


NO_MODEL = "values without a trained model"


def score_detector(store: StateStore, catalog: Catalog, conf: D.DetectorConfig, end, now, run_id: str, sink: str, mode: str = "prod") -> bool:
    """Score all buckets newer than each model's watermark; returns whether to retrain.

    Observations without a trained model are counted by entity in the table ``reports``.

    Alerts are written under the run id, then the new watermarks, then the run itself; old versions go. Without ``end``
    it is that of the detector's configuration at ``now``.
    """
    _, end = _times(store, conf, now, now, end)
    versions = store.read("model_versions")
    online = latest_versions(find_models(versions, online="True", detector=conf.name, deployment_mode=mode))
    retrain = needs_retrain(online, now, conf.time_spec.retrain)
    for row in online.collect():  # one row per metric of the detector
        tags = dict(row["tags"])
        spec = MetricSpec.from_json(tags["query"])
        keys = list(spec.dimension_groupings or [])
        since = tags["last_evaluation_ts"]
        new = observations(catalog, spec, since, end, newer_than=since)
        last = new.times.agg(F.max(TS)).first()[0]
        if last is None:
            continue
        mine = lambda table: _entity_columns(store.read(table).where((F.col("model") == row["model"]) & (F.col("trained_by") == tags["trained_by"])), keys).drop("model", "trained_by", "run_id")
        models = {n: mine("forecast_models").where(F.col("algorithm_name") == n).drop("algorithm_name") for n, a in conf.algorithms.items() if a.model is not None}
        checked = D.verdicts(new, keys, D.Trained(mine("model_params"), models), conf.algorithms)
        alerts = D.with_run(D.anomaly_rows(checked, keys), conf.name, run_id, now, tags["query"])
        D.append_anomalies(alerts, sink)
        left_out = D.unscored(checked, keys).select("algorithm_name", _entity_json(keys).alias("entity_keys"), F.col("count").alias("n"))
        store.append("reports", left_out.withColumns({"model": F.lit(row["model"]), "status": F.lit("no model"), "reason": F.lit(NO_MODEL), "run_id": F.lit(run_id)}))
        _add_version(store, versions, row["model"], {**tags, "last_evaluation_ts": str(last)}, row["created_at"], run_id)
    store.commit(run_id, f"inference_{conf.name}", now)
    trim_versions(store)
    trim_runs(store, f"inference_{conf.name}")
    store.tidy()
    return retrain
