"""Univariate residual detectors over many entities: train, verdicts, anomaly rows, configuration."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import clean, join_on
from tidemark.functions.trend import Options
from tidemark.operators.robust import MIN_SAMPLE, huber_scale
from tidemark.operators.series import TS, VALUE, chain, concat
from tidemark.plans.forecast import EMPTY, fit_attempts, fit_report, fit_residuals, fitted, options_from_config, residuals
from tidemark.plans.metrics import MetricSpec, ZeroFilled
from tidemark.session import materialize

ANOMALY_SCHEMA = T.StructType([
    T.StructField(n, t, True, {"comment": c}) for n, t, c in [
        ("detection_run_timestamp", T.TimestampNTZType(), "time of the run that raised the alert"),
        ("detector", T.StringType(), "detector that raised the alert"),
        ("run_id", T.StringType(), "run that raised the alert"),
        ("datasource", T.StringType(), "kind of source of the observed data"),
        ("query_json", T.StringType(), "metric query as JSON"),
        ("entity", T.StringType(), "aggregated entity the alert is about"),
        ("algorithm_name", T.StringType(), "algorithm that raised the alert"),
        ("timestamp", T.TimestampNTZType(), "time the alert is about"),
        ("value", T.DoubleType(), "observed value"),
        ("metadata", T.StringType(), "JSON object of the algorithm"),
        ("tags", T.MapType(T.StringType(), T.StringType()), "pairs to filter by"),
    ]
])


@dataclass(frozen=True)
class Algorithm:
    """Univariate residual detector: optional transforms and forecast, tolerance and direction."""

    tolerance: float = 5.0
    direction: str | None = None
    model: Options | None = None
    transforms: tuple[str, ...] = ()

    @classmethod
    def from_args(cls, args: Mapping) -> "Algorithm":
        args = dict(args)
        model = args.pop("model", None)
        if model is not None and not isinstance(model, Options):
            model = options_from_config(model)
        transforms = tuple(args.pop("transforms", args.pop("transformers", ())) or ())
        unknown = [t for t in transforms if t not in TRANSFORMS]
        if unknown:
            raise ValueError(f"unknown transforms {unknown}; known: {sorted(TRANSFORMS)}")
        return cls(model=model, transforms=transforms, **args)


ALGORITHMS: dict[str, Callable[[Mapping], Algorithm]] = {"univariate": Algorithm.from_args}
TRANSFORMS: dict[str, Callable[[DataFrame, Sequence[str]], DataFrame]] = {"residuals": lambda df, keys: fit_residuals(df, keys)}


@dataclass(frozen=True)
class TimeSpec:
    granularity: str
    start: str | None = None
    end: str | None = None
    retrain: str | None = None


@dataclass(frozen=True)
class DetectorConfig:
    name: str
    description: str
    budget_group: str
    git_owners: tuple[str, ...]
    time_spec: TimeSpec
    metrics: tuple[MetricSpec, ...]
    algorithms: dict[str, Algorithm] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, conf: Mapping) -> "DetectorConfig":
        spec = TimeSpec(**conf["time_spec"])
        metrics = tuple(
            MetricSpec(m["name"], m.get("time_granularity") or spec.granularity, list(m.get("dimension_groupings") or []), list(m.get("dimension_filters") or []))
            for m in conf.get("metric_store_metrics") or []
        )
        algorithms = {}
        for name, args in (conf.get("algorithms") or {}).items():
            args = dict(args)
            kind = args.pop("cls", name)
            if kind not in ALGORITHMS:
                raise ValueError(f"unknown algorithm {kind!r}; known: {sorted(ALGORITHMS)}")
            algorithms[name] = ALGORITHMS[kind](args.get("args", args))
        return cls(conf["name"], conf.get("description", ""), conf.get("budget_group", ""), tuple(conf.get("git_owners") or ()), spec, metrics, algorithms)

    @classmethod
    def from_json(cls, text: str) -> "DetectorConfig":
        return cls.from_dict(json.loads(text))


@dataclass
class Trained:
    """Detector parameters per (algorithm, entity), the forecast models they use and the outcome of every entity."""

    params: DataFrame
    models: dict[str, DataFrame]
    report: DataFrame | None = None


def _prepared(df: DataFrame, keys: Sequence[str], algo: Algorithm) -> DataFrame:
    return chain(df, [lambda d, t=t: TRANSFORMS[t](d, keys) for t in algo.transforms])


def _shared(algorithms: Mapping[str, Algorithm]) -> list[tuple[Algorithm, list[str]]]:
    """Algorithms that look at the same residuals, so that these are computed once."""
    groups: dict[tuple, list[str]] = {}
    for name, algo in algorithms.items():
        groups.setdefault((algo.model, algo.transforms), []).append(name)
    return [(algorithms[names[0]], names) for names in groups.values()]


def _plain(algo: Algorithm) -> bool:
    """Looks at the values themselves: a gap of zero is zero away from what is expected and never an alert."""
    return algo.model is None and not algo.transforms


def train(df: DataFrame | ZeroFilled, keys: Sequence[str], algorithms: Mapping[str, Algorithm]) -> Trained:
    """Scale of every entity under every algorithm. Entities with too few values have no row.

    An entity that cannot be trained is left out and does not stop the others; ``report`` has one row
    ``algorithm_name, keys, n, status, reason`` for every entity: ok, short, not finite, failed, empty or no scale.
    """
    frames, reports, models = [], [], {}
    for algo, names in _shared(algorithms):
        zeros = None
        if isinstance(df, ZeroFilled) and _plain(algo):
            data, zeros = df.cells, df.zeros()
        else:
            data = _prepared(df.dense() if isinstance(df, ZeroFilled) else df, keys, algo)
        if algo.model is not None:
            # the residuals read the models too; one row per entity is written
            attempts = materialize(fit_attempts(data, keys, algo.model), "detector-models")
            report = fit_report(data, attempts, keys).where("status <> 'ok'")
            models.update({n: fitted(attempts) for n in names})
            data = residuals(data, fitted(attempts), keys, algo.model)
        settings = F.explode(F.array(*[
            F.struct(F.lit(n).alias("algorithm_name"), F.lit(float(algorithms[n].tolerance)).alias("tolerance"), F.lit(algorithms[n].direction).cast("string").alias("direction"))
            for n in names])).alias("_s")
        scale = huber_scale(data, keys, zeros=zeros)
        outcome = _scale_report(data, scale, keys, zeros)
        reports.append((outcome if algo.model is None else outcome.unionByName(report)).withColumn("algorithm_name", F.explode(F.array(*[F.lit(n) for n in names]))))
        frames.append(scale.select(*keys, "n", "scale", settings).select("_s.algorithm_name", *keys, "n", "scale", "_s.tolerance", "_s.direction"))
    return Trained(concat(*frames), models, concat(*reports).select("algorithm_name", *keys, "n", "status", "reason"))


NO_SCALE = "most values are zero"


def _scale_report(data: DataFrame, scale: DataFrame, keys: Sequence[str], zeros: DataFrame | None = None) -> DataFrame:
    """``keys, n, status, reason`` of the scale of every entity."""
    counts = data.groupBy(*keys).agg(F.count(clean(VALUE)).alias("n"))
    if zeros is not None:
        counts = counts.unionByName(zeros.select(*keys, F.col("zeros").alias("n"))).groupBy(*keys).agg(F.sum("n").alias("n"))
    rows = join_on(counts, scale.select(*keys, "scale"), list(keys), "left")
    few, sound = f"fewer than {MIN_SAMPLE} values", F.coalesce(F.abs("scale") < float("inf"), F.lit(False))
    said = lambda texts: F.when(F.col("n") == 0, texts[0]).when(F.col("n") < MIN_SAMPLE, texts[1]).when(~sound, texts[2])
    return rows.select(*keys, "n", F.coalesce(said(("empty", "short", "no scale")), F.lit("ok")).alias("status"), said((EMPTY, few, NO_SCALE)).alias("reason"))


def is_anomaly(residual: Column, scale: Column, tolerance: Column, direction: Column) -> Column:
    """Residual beyond tolerance × scale, below, above or both. No scale, no verdict."""
    limit = tolerance * scale
    down = (residual < -limit) & ~F.coalesce(direction == "up", F.lit(False))
    up = (residual > limit) & ~F.coalesce(direction == "down", F.lit(False))
    return F.coalesce(down | up, F.lit(False))


def verdicts(data_in: DataFrame | ZeroFilled, keys: Sequence[str], trained: Trained, algorithms: Mapping[str, Algorithm]) -> DataFrame:
    """Every observation with its residual and verdict per algorithm; ``has_model`` tells unknown entities.

    Of ``ZeroFilled`` series, gaps have rows only under algorithms that compare with a forecast or a transform; under the
    others they cannot be alerts.
    """
    frames = []
    for algo, names in _shared(algorithms):
        df = data_in if isinstance(data_in, DataFrame) else data_in.cells if _plain(algo) else data_in.dense()
        data = _prepared(df, keys, algo)
        if algo.model is not None:
            data = residuals(data, trained.models[names[0]], keys, algo.model)
        if data is df:
            rows = df.select(*keys, TS, VALUE, clean(VALUE).alias("residual"))
        else:
            rows = join_on(df.select(*keys, TS, VALUE), data.select(*keys, TS, F.col(VALUE).alias("residual")), [*keys, TS], "left")
        # one row per entity with the settings of all its algorithms: observations are joined once
        entry = F.struct("algorithm_name", "scale", "tolerance", "direction", F.lit(True).alias("known"))
        mine = trained.params.where(F.col("algorithm_name").isin(names)).groupBy(*keys).agg(F.collect_list(entry).alias("_have"))
        rows = join_on(rows, mine, list(keys), "left").withColumn("algorithm_name", F.explode(F.array(*[F.lit(n) for n in names])))
        pick = F.get(F.filter("_have", lambda h: h["algorithm_name"] == F.col("algorithm_name")), 0)
        rows = rows.withColumn("_p", pick)
        flag = is_anomaly(F.col("residual"), F.col("_p.scale"), F.col("_p.tolerance"), F.col("_p.direction"))
        frames.append(rows.select("algorithm_name", *keys, TS, VALUE, "residual", flag.alias("is_anomaly"), F.coalesce("_p.known", F.lit(False)).alias("has_model")))
    return concat(*frames)


def unscored(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of observations (rows of ``checked``) without a trained model per algorithm and entity."""
    return checked.where(~F.col("has_model")).groupBy("algorithm_name", *keys).count()


def anomaly_rows(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a true verdict in the layout of an alert."""
    entity = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    return checked.where("is_anomaly").select("algorithm_name", entity.alias("entity"), F.col(TS).alias("timestamp"), F.col(VALUE).alias("value"), F.lit("{}").alias("metadata"))


def with_run(rows: DataFrame, detector: str, run_id: str, now, query_json: str, datasource: str = "metric_store", tags: Mapping[str, str] | None = None) -> DataFrame:
    """Alert rows completed with the data of their run, in the column order of the alert table."""
    pairs = [F.lit(x) for kv in (tags or {}).items() for x in kv]
    full = rows.withColumns({
        "detection_run_timestamp": F.lit(now).cast("timestamp_ntz"), "detector": F.lit(detector), "run_id": F.lit(run_id),
        "datasource": F.lit(datasource), "query_json": F.lit(query_json),
        "tags": F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>"),
    })
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in ANOMALY_SCHEMA])


def append_anomalies(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("detector").parquet(path)


def read_all_anomalies(spark, path: str) -> DataFrame:
    """Alerts below ``path`` of every run, also of lost ones and of their repeats."""
    return spark.read.schema(ANOMALY_SCHEMA).parquet(path).select(*ANOMALY_SCHEMA.names)


def read_anomalies(spark, path: str, runs: DataFrame) -> DataFrame:
    """Alerts below ``path`` of completed runs (``runs``, a table with their ``run_id``)."""
    return read_all_anomalies(spark, path).join(runs.select("run_id").distinct(), "run_id", "left_semi").select(*ANOMALY_SCHEMA.names)
