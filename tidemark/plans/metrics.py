"""Metric queries: name + grain + dimensions + filters to one DataFrame plan."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import join_on
from tidemark.functions.timeunits import trunc_grain
from tidemark.session import materialize
from tidemark.sources.catalog import TIME, Catalog, Table, filter_time

METRIC_TIME = "time"
GRAINS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class QuerySpec:
    """Grain, inclusive time range, dimensions and row filters of a metric query."""

    grain: str
    start: str
    end: str
    groupings: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "groupings", tuple(self.groupings or ()))
        object.__setattr__(self, "filters", tuple(self.filters or ()))
        if self.grain.lower() not in GRAINS:
            raise ValueError(f"unknown grain {self.grain!r}")


@dataclass(frozen=True)
class MetricSpec:
    """A metric as a detector asks for it; survives as JSON with the model and is replayed later."""

    name: str
    time_granularity: str
    dimension_groupings: list[str] = field(default_factory=list)
    dimension_filters: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "MetricSpec":
        return cls(**json.loads(text))

    def query(self, start, end) -> QuerySpec:
        return QuerySpec(self.time_granularity, str(start), str(end), self.dimension_groupings or (), self.dimension_filters or ())


@dataclass
class Source:
    """A fact with the chain of dimensions a query needs, in join order."""

    fact: Table
    joins: list[tuple[Table, str]]  # (dimension, key)

    @property
    def columns(self) -> set[str]:
        return set(self.fact.columns).union(*[t.columns for t, _ in self.joins])


def _paths(catalog: Catalog, fact: Table) -> dict[str, list[tuple[Table, str]]]:
    """Shortest key path from the fact to every dimension it reaches."""
    paths: dict[str, list[tuple[Table, str]]] = {}
    frontier: list[tuple[list[str], list[tuple[Table, str]]]] = [(fact.columns, [])]
    while frontier:
        following = []
        for keys, path in frontier:
            for dim in catalog.dims():
                if dim.name not in paths and dim.key in keys:
                    paths[dim.name] = [*path, (dim, dim.key)]
                    following.append((list(dim.links), paths[dim.name]))
        frontier = following
    return paths


def _named_columns(text: str, known: set[str]) -> set[str]:
    """Known column names an SQL expression mentions outside of quoted strings."""
    return set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", " ", text))) & known


def _join(catalog: Catalog, source: Source, df: DataFrame) -> DataFrame:
    """Left join the dimensions. No broadcast hint: the size estimate and AQE decide."""
    for dim, key in source.joins:
        right = dim.load(catalog.spark)
        taken = set(df.columns) - {key}
        df = df.join(right.select(*[c for c in right.columns if c not in taken]), key, "left")
    return df


def resolve(catalog: Catalog, definition: str, spec: QuerySpec) -> Source:
    """The one fact that can answer the query and only the dimensions it needs.

    A name held by several tables binds to the fact first, then to the nearest dimension.
    """
    known = {c for t in catalog.tables.values() for c in t.columns}
    needed = set(spec.groupings)
    for text in (definition, *spec.filters):
        needed |= _named_columns(text, known)
    answers: list[Source] = []
    for fact in catalog.facts():
        paths = _paths(catalog, fact)
        joins: dict[str, tuple[Table, str]] = {}
        missing = False
        for column in sorted(needed - set(fact.columns)):
            owners = [p for p in paths.values() if column in p[-1][0].columns]
            if not owners:
                missing = True
                break
            joins.update({t.name: (t, k) for t, k in min(owners, key=len)})
        if not missing:
            order = {t.name: i for p in paths.values() for i, (t, _) in enumerate(p)}
            answers.append(Source(fact, sorted(joins.values(), key=lambda j: order[j[0].name])))
    if not answers:
        raise ValueError(f"no fact table can answer {definition!r} by {list(spec.groupings)}")
    if len(answers) > 1:
        raise ValueError(f"{definition!r} fits several fact tables: {[a.fact.name for a in answers]}")
    return answers[0]


def metric_query(catalog: Catalog, metric: str, spec: QuerySpec) -> DataFrame:
    """Aggregate of a metric by time bucket and dimensions.

    Columns: ``time``, the dimensions, the metric. Time range and fact-side filters stand before
    the joins; Spark pushes dimension filters to their own scans.
    """
    definition = catalog.metric(metric).definition
    source = resolve(catalog, definition, spec)
    df = filter_time(source.fact.load(catalog.spark), spec.start, spec.end)
    df = _join(catalog, source, df)
    for condition in spec.filters:
        df = df.where(F.expr(condition))
    bucket = trunc_grain(TIME, spec.grain).alias(METRIC_TIME)
    return df.groupBy(bucket, *spec.groupings).agg(F.expr(definition).alias(metric))


def metric_sql(catalog: Catalog, metric: str, spec: QuerySpec) -> str:
    """The same query as Spark SQL text over the registered views."""
    definition = catalog.metric(metric).definition
    source = resolve(catalog, definition, spec)
    if source.joins:
        taken = list(source.fact.columns)
        columns = [f"f.`{c}`" for c in taken]
        joins, owner = "", {c: "f" for c in taken}
        for i, (dim, key) in enumerate(source.joins):
            joins += f" LEFT JOIN `{dim.name}` AS d{i} ON {owner[key]}.`{key}` = d{i}.`{key}`"
            for c in dim.columns:
                if c not in owner:
                    owner[c] = f"d{i}"
                    columns.append(f"d{i}.`{c}`")
        table = f"(SELECT {', '.join(columns)} FROM `{source.fact.name}` AS f{joins}) AS source"
    else:
        table = f"`{source.fact.name}`"
    groups = "".join(f", `{g}`" for g in spec.groupings)
    filters = "".join(f" AND ({f})" for f in spec.filters)
    bucket = f"CAST(date_trunc('{spec.grain.lower()}', `{TIME}`) AS TIMESTAMP_NTZ)"
    return (
        f"SELECT {bucket} AS `{METRIC_TIME}`{groups}, {definition} AS `{metric}` FROM {table} "
        f"WHERE `{TIME}` BETWEEN '{spec.start}' AND '{spec.end}'{filters} GROUP BY {bucket}{groups}"
    )


def run_metric(catalog: Catalog, metric: str, spec: QuerySpec) -> DataFrame:
    """Metric result sorted by time."""
    return metric_query(catalog, metric, spec).orderBy(METRIC_TIME, *spec.groupings)


@dataclass(frozen=True)
class ZeroFilled:
    """Series of all entities over all times seen for any of them, gaps zero, without a row for any gap.

    ``cells`` has the values there are (duplicates averaged), ``times`` and ``entities`` what the grid is made of. What
    can be said from present values and a number of zeros per entity never meets the grid; ``dense`` makes it for
    operators that need each row.
    """

    cells: DataFrame
    times: DataFrame
    entities: DataFrame
    keys: tuple[str, ...]
    time: str = METRIC_TIME
    value: str = "value"

    @classmethod
    def of(cls, df: DataFrame, value: str, keys: Sequence[str], time: str = METRIC_TIME) -> "ZeroFilled":
        """Rows with a null entity key are dropped; the aggregated cells are written once."""
        known = df.na.drop(subset=list(keys)) if keys else df
        cells = materialize(known.groupBy(time, *keys).agg(F.avg(value).alias(value)), "cells")
        return cls(cells.where(F.col(value).isNotNull()), cells.select(time).distinct(), cells.select(*keys).distinct(), tuple(keys), time, value)

    def where(self, condition) -> "ZeroFilled":
        """A range of times; entities stay."""
        return ZeroFilled(self.cells.where(condition), self.times.where(condition), self.entities, self.keys, self.time, self.value)

    def zeros(self) -> DataFrame:
        """``keys, zeros``: the number of gaps of every entity."""
        seen = self.times.agg(F.count(F.lit(1))).scalar()  # one row
        have = self.cells.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_have"))
        rows = join_on(self.entities, have, list(self.keys), "left") if self.keys else have
        return rows.select(*self.keys, (seen - F.coalesce("_have", F.lit(0))).alias("zeros"))

    def dense(self, fill: float = 0.0) -> DataFrame:
        """Every time with every entity. The output has times × entities rows by definition."""
        grid = spread_product(self.times, self.entities) if self.keys else self.times
        filled = join_on(grid, self.cells, [self.time, *self.keys], "left")
        return filled.withColumn(self.value, F.coalesce(self.value, F.lit(float(fill))))


def complete_entities(df: DataFrame, value: str, entity: Sequence[str], time: str = METRIC_TIME, fill: float = 0.0) -> DataFrame:
    """Long form of "wide frame with gaps set to ``fill``".

    Every time seen for any entity meets every entity; duplicates are averaged; rows with a null
    entity key are dropped. The output has times × entities rows by definition of the operator; ``ZeroFilled`` holds the
    same series without them.
    """
    return ZeroFilled.of(df, value, entity, time).dense(fill).select(time, *entity, value)


def spread_product(small: DataFrame, large: DataFrame) -> DataFrame:
    """Every row of ``large`` with every row of ``small``, as an equi-join on a salt.

    ``large`` is hashed over as many salts as there are shuffle partitions and ``small`` (the few
    time buckets) is repeated per salt, so the output is spread evenly and neither side is collected.
    """
    salts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    return left.join(right, "_salt").drop("_salt")


def pivot_wide(df: DataFrame, time: str, entity: str, value: str, names: Sequence, fill: float | None = 0.0) -> DataFrame:
    """Wide export with an explicit list of entity names."""
    wide = df.groupBy(time).pivot(entity, list(names)).agg(F.avg(value))
    return wide if fill is None else wide.na.fill(fill)
