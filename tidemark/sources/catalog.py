"""Fact and dimension tables: declared columns, roles, checks, loading and listing."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME = "ts"
# Type names of table declarations.
TYPE_NAMES = {
    "int": T.IntegerType(),
    "float": T.FloatType(),
    "str": T.StringType(),
    "timestamp": T.TimestampType(),
}


def column_role(name: str) -> str | None:
    """Role by name: ``*_id`` key, ``dim_*`` dimension, ``m_*`` measure, ``ts`` timestamp."""
    if name.endswith("_id"):
        return "key"
    if name.startswith("dim_"):
        return "dimension"
    if name.startswith("m_"):
        return "measure"
    return "timestamp" if name == TIME else None


def declared_type(name: str) -> T.DataType:
    """A declared type name, or any Spark DDL type beyond the four short names."""
    if name in TYPE_NAMES:
        return TYPE_NAMES[name]
    try:
        return T._parse_datatype_string(name)
    except Exception as e:
        raise ValueError(f"unknown data type {name!r}") from e


def declared_field(name: str, data_type: str | T.DataType) -> T.StructField:
    kind = declared_type(data_type) if isinstance(data_type, str) else data_type
    return T.StructField(name, kind, True, {"role": column_role(name) or ""})


@dataclass
class Table:
    """One declared table. ``links`` names further keys of a dimension that lead to other dimensions."""

    name: str
    kind: str
    schema: T.StructType
    source: str | None = None
    fmt: str = "csv"
    links: tuple[str, ...] = ()
    df: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self):
        roles = [f.metadata.get("role") or column_role(f.name) for f in self.schema]
        keys = [f.name for f, r in zip(self.schema, roles) if r == "key" and f.name not in self.links]
        if self.kind == "fact":
            if roles.count("timestamp") != 1:
                raise ValueError(f"fact table {self.name} needs exactly one '{TIME}' column")
        elif self.kind == "dim":
            if len(keys) != 1:
                raise ValueError(f"dimension table {self.name} needs exactly one key column, has {keys}")
        else:
            raise ValueError(f"table {self.name}: type must be fact or dim, not {self.kind!r}")
        self.key = keys[0] if self.kind == "dim" else None

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @classmethod
    def from_conf(cls, conf: dict, data_dir: str = "") -> "Table":
        schema = T.StructType([declared_field(c["name"], c["data_type"]) for c in conf["columns"]])
        return cls(
            conf["name"], conf["type"], schema, os.path.join(data_dir, conf["source"]),
            conf.get("format", "csv"), tuple(conf.get("links", ())),
        )

    @classmethod
    def from_frame(cls, name: str, kind: str, df: DataFrame, links: tuple[str, ...] = ()) -> "Table":
        schema = T.StructType([declared_field(f.name, f.dataType) for f in df.schema])
        return cls(name, kind, schema, None, "frame", links, df)

    def load(self, spark: SparkSession) -> DataFrame:
        """The table as a DataFrame: declared schema on files, headerless CSV by default."""
        if self.df is None:
            reader = spark.read.schema(self.schema)
            if self.fmt == "csv":
                self.df = reader.csv(self.source, header=False)
            elif self.fmt == "table":
                self.df = spark.table(self.source)
            else:
                self.df = reader.format(self.fmt).load(self.source)
        return self.df

    def duplicate_keys(self, spark: SparkSession) -> DataFrame:
        """Keys of a dimension that occur more than once (they would multiply facts)."""
        if self.kind != "dim":
            raise ValueError("only dimensions have a unique key")
        return self.load(spark).groupBy(self.key).count().where("count > 1")


@dataclass(frozen=True)
class Metric:
    """A named SQL aggregate such as ``COUNT(transaction_id)``."""

    name: str
    definition: str


def read_configs(folder: str) -> list[dict]:
    """All YAML objects of a folder; a file holds one object or a list of them."""
    import yaml

    found: list[dict] = []
    for entry in sorted(os.listdir(folder)):
        if entry.endswith((".yaml", ".yml")):
            with open(os.path.join(folder, entry)) as f:
                conf = yaml.safe_load(f)
            found.extend(conf if isinstance(conf, list) else [conf])
    return found


class Catalog:
    """Tables and metrics by name."""

    def __init__(self, spark: SparkSession, tables: list[Table] = (), metrics: list[Metric] = ()):
        self.spark = spark
        self.tables = {t.name: t for t in tables}
        self.metrics = {m.name: m for m in metrics}  # the last of equal names wins

    @classmethod
    def from_folder(cls, spark: SparkSession, configs: str, data_dir: str) -> "Catalog":
        tables = [
            Table.from_conf(c, data_dir)
            for folder in ("fact_tables", "dimension_tables")
            for c in read_configs(os.path.join(configs, folder))
        ]
        metrics = [Metric(**c) for c in read_configs(os.path.join(configs, "metrics"))]
        return cls(spark, tables, metrics)

    def facts(self) -> list[Table]:
        return [t for t in self.tables.values() if t.kind == "fact"]

    def dims(self) -> list[Table]:
        return [t for t in self.tables.values() if t.kind == "dim"]

    def metric(self, name: str) -> Metric:
        if name not in self.metrics:
            raise KeyError(f"no metric {name!r}; known: {sorted(self.metrics)}")
        return self.metrics[name]

    def register_views(self, show: bool = False) -> list[str]:
        """Register every table as a view under its name; returns the view names."""
        for t in self.tables.values():
            df = t.load(self.spark)
            df.createOrReplaceTempView(t.name)
            if show:
                df.show()
        return [v.name for v in self.spark.catalog.listTables() if v.name in self.tables]


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, left distributed."""
    return spark.table(name)


def drop_null_dims(df: DataFrame, dims: list[str] | None) -> DataFrame:
    return df.na.drop(subset=list(dims)) if dims else df


def filter_time(df: DataFrame, start, end, column: str = TIME) -> DataFrame:
    """Inclusive at both ends; a date as end matches midnight only. Reaches the file scan."""
    kind = df.schema[column].dataType
    return df.where(F.col(column).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))
