"""Long-table series operators: selection, slices, arithmetic, comparison, alignment.

A series table has key columns, a time column ``ts`` and a nullable double ``value``. One series is
one key; a "wide" frame is the set of its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clean, join_on
from tidemark.operators.ordered import HotKeys, OrderedRows

TS, VALUE = "ts", "value"


# --- building ------------------------------------------------------------------------------

def to_series(
    df: DataFrame, time_col: str, value_cols: str | Sequence[str], keys: Sequence[str] = (), check: bool = True,
    name_col: str = "series",
) -> DataFrame:
    """Series table of a record table. Several value columns become one key level ``name_col``.

    Null keys are kept as a series of their own. Two rows with equal key and time raise.
    """
    values = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    ts = F.col(time_col).cast("timestamp_ntz").alias(TS)
    if len(values) == 1:
        out = df.select(*keys, ts, clean(values[0]).alias(VALUE))
        names = list(keys)
    else:
        cells = F.explode(F.array(*[F.struct(F.lit(v).alias("n"), clean(v).alias("v")) for v in values])).alias("_c")
        out = df.select(*keys, ts, cells).select(F.col("_c.n").alias(name_col), *keys, TS, F.col("_c.v").alias(VALUE))
        names = [name_col, *keys]
    if check:
        require_unique(out, names)
    return out


def duplicates(df: DataFrame, keys: Sequence[str], ts: str = TS) -> DataFrame:
    """(key, time) pairs that occur more than once."""
    return df.groupBy(*keys, ts).count().where("count > 1")


def require_unique(df: DataFrame, keys: Sequence[str], ts: str = TS) -> None:
    if not duplicates(df, keys, ts).isEmpty():
        raise ValueError("timestamps are not unique inside a series")


def attach_values(index: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values put on an existing index; both must hold the same (key, time) rows."""
    require_same_index(index, values, keys)
    return join_on(index.select(*keys, TS), values.select(*keys, TS, VALUE), [*keys, TS])


# --- selection -----------------------------------------------------------------------------

def _key_condition(keys: Sequence[str], wanted: Sequence) -> Column:
    rows = [w if isinstance(w, tuple) else (w,) for w in wanted]
    for row in rows:
        if len(row) != len(keys):
            raise KeyError(f"{row!r} does not name a series by {list(keys)}")
    tests = [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, row)]) for row in rows]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def select(df: DataFrame, keys: Sequence[str], wanted: Sequence) -> DataFrame:
    """Series by exact key."""
    return df.where(_key_condition(keys, wanted))


def select_prefix(df: DataFrame, keys: Sequence[str], prefix: Sequence) -> DataFrame:
    """Series whose leading key levels equal ``prefix``."""
    return df.where(_key_condition(list(keys)[: len(prefix)], [tuple(prefix)]))


def contains(df: DataFrame, keys: Sequence[str], wanted) -> bool:
    return not select(df, keys, [wanted]).limit(1).isEmpty()


def rename_series(df: DataFrame, keys: Sequence[str], names: Mapping[tuple, tuple], to: Sequence[str] | None = None) -> DataFrame:
    """Rename series by a driver-side map old key → new key; arity and uniqueness are checked.

    Series that the map does not name keep their names; where the new names have other levels (``to``) every series
    must be named, and reading one that is not raises. A new name that another series keeps is an error.
    """
    same, to = to is None or list(to) == list(keys), list(to or keys)
    if any(len(o) != len(keys) or len(n) != len(to) for o, n in names.items()):
        raise ValueError("series names must have one part per key level")
    if len(set(names.values())) != len(names):
        raise ValueError("new series names must be unique")
    taken = [tuple(n) for n in names.values() if tuple(n) not in names]
    if same and taken and not select(df, keys, taken).limit(1).isEmpty():
        raise ValueError("a new series name is the name of another series")
    spark = df.sparkSession
    rows = [tuple(o) + tuple(n) for o, n in names.items()]
    olds, news = [f"_old{i}" for i in range(len(keys))], [f"_new{i}" for i in range(len(to))]
    schema = ", ".join([f"`{o}` {dict(df.dtypes)[k]}" for o, k in zip(olds, keys)] + [f"`{n}` string" for n in news])
    table = spark.createDataFrame(rows, schema)  # as many rows as the caller's map
    renamed = table.select(*[F.col(o).alias(k) for o, k in zip(olds, keys)], *news)
    rest = [c for c in df.columns if c not in keys]
    unnamed = F.raise_error(F.concat(F.lit("no new name for series "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).cast("string")
    named = F.col(news[0]).isNotNull()
    parts = [F.when(named, F.col(n)).otherwise(F.col(keys[i]).cast("string") if same else unnamed).alias(t) for i, (n, t) in enumerate(zip(news, to))]
    return join_on(df, renamed, list(keys), "left").select(*parts, *rest)


def add_level(df: DataFrame, level: str, name: str) -> DataFrame:
    """Put a constant key level in front."""
    return df.select(F.lit(name).alias(level), *df.columns)


def drop_level(df: DataFrame, keys: Sequence[str], level: str, check: bool = True) -> DataFrame:
    """Drop a key level; raises where two series would fall together."""
    out = df.drop(level)
    if check:
        require_unique(out, [k for k in keys if k != level])
    return out


def drop_incomplete_rows(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Drop every time at which any series of the group has a missing value."""
    missing = df.where(clean(VALUE).isNull()).select(*group, TS).distinct()
    return join_on(df, missing, [*group, TS], "left_anti")


def has_missing(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(clean(VALUE).isNull()).alias("has_missing"))


def time_slice(df: DataFrame, start=None, end=None) -> DataFrame:
    """Half-open slice ``start <= ts < end``; the bounds reach the file scan."""
    kind = df.schema[TS].dataType
    if start is not None:
        df = df.where(F.col(TS) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(TS) < F.lit(end).cast(kind))
    return df


def position_slice(df: DataFrame, keys: Sequence[str], start: int = 0, end: int | None = None, hot: HotKeys | None = None) -> DataFrame:
    """Rows ``start:end`` of every series by time, negative bounds counted from the end."""
    rows = OrderedRows(df, keys, [TS], hot)
    forward = start >= 0 or (end is not None and end >= 0)
    backward = start < 0 or (end is not None and end < 0)
    if forward:
        rows = rows.position("_i", start=0)
    if backward:
        rows = rows.position("_j", start=1, reverse=True)  # 1 is the last row
    out = rows.frame().where((F.col("_i") >= start) if start >= 0 else (F.col("_j") <= -start))
    if end is not None:
        out = out.where((F.col("_i") < end) if end >= 0 else (F.col("_j") > -end))
    return out.drop("_i", "_j")


def tail(df: DataFrame, keys: Sequence[str], n: int, hot: HotKeys | None = None) -> DataFrame:
    return position_slice(df, keys, -n, None, hot) if n > 0 else df.limit(0)


def mask(df: DataFrame, flags: DataFrame, keys: Sequence[str], flag: str = "flag") -> DataFrame:
    """Rows whose (key, time) carries a true flag."""
    return join_on(df, flags.where(F.col(flag)).select(*keys, TS), [*keys, TS], "left_semi")


def is_in(df: DataFrame, index: DataFrame, keys: Sequence[str] = (), out: str = "found") -> DataFrame:
    """Flag rows whose time (and int position, if both have one) occurs in another index."""
    on = [*keys, TS] + (["ts_int"] if "ts_int" in df.columns and "ts_int" in index.columns else [])
    other = index.select(*on).distinct().withColumn(out, F.lit(True))
    return join_on(df, other, on, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def drop_older(df: DataFrame, last: Column | str, column: str = TS) -> DataFrame:
    """Strictly newer than a watermark."""
    return df.where(F.col(column) > last)


def select_role(df: DataFrame, *roles: str) -> list[str]:
    """Column names by declared role (field metadata)."""
    return [f.name for f in df.schema if f.metadata.get("role") in roles]


# --- arithmetic ----------------------------------------------------------------------------

_MATH: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
    "//": lambda a, b: F.floor(F.try_divide(a, b)).cast("double"),
    # sign of the divisor, as floor division asks for
    "%": lambda a, b: a - F.floor(F.try_divide(a, b)) * b,
    "**": lambda a, b: F.pow(a, b),
}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def math_column(op: str, a: Column, b: Column) -> Column:
    """``a op b``; division by zero gives null, comparison gives 0.0/1.0."""
    if op in _MATH:
        return clean(_MATH[op](a, b))
    if op in _COMPARE:
        return F.coalesce(_COMPARE[op](clean(a), clean(b)), F.lit(False)).cast("double")
    raise ValueError(f"unknown operator {op!r}")


def unmatched(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index rows of one table that the other lacks, with the side that has them."""
    on = [*keys, TS]
    only_a = join_on(a.select(*on), b.select(*on), on, "left_anti").withColumn("side", F.lit("left"))
    only_b = join_on(b.select(*on), a.select(*on), on, "left_anti").withColumn("side", F.lit("right"))
    return only_a.unionByName(only_b)


def require_same_index(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    if not unmatched(a, b, keys).isEmpty():
        raise ValueError("series do not share one index")


def combine(a: DataFrame, op: str, b: DataFrame | float | int, keys: Sequence[str], reverse: bool = False, check: bool = True) -> DataFrame:
    """Element-wise ``a op b`` with a series of equal index or with a number (``b op a`` if reverse)."""
    if not isinstance(b, DataFrame):
        x, y = clean(VALUE), F.lit(float(b))
        return a.withColumn(VALUE, math_column(op, y, x) if reverse else math_column(op, x, y))
    if check:
        require_same_index(a, b, keys)
    right = b.select(*keys, TS, F.col(VALUE).alias("_other"))
    x, y = clean(VALUE), clean("_other")
    joined = join_on(a, right, [*keys, TS])
    return joined.withColumn(VALUE, math_column(op, y, x) if reverse else math_column(op, x, y)).drop("_other")


def combine_all(a: DataFrame, ops: Sequence[str], b: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Rows of ``a op b`` for several operators, with the column ``op``; the series are joined once."""
    if check:
        require_same_index(a, b, keys)
    joined = join_on(a.select(*keys, TS, VALUE), b.select(*keys, TS, F.col(VALUE).alias("_other")), [*keys, TS])
    made = F.explode(F.array(*[F.struct(F.lit(o).alias("op"), math_column(o, clean(VALUE), clean("_other")).alias(VALUE)) for o in ops])).alias("_m")
    return joined.select(*keys, TS, made).select(*keys, TS, f"_m.{VALUE}", "_m.op")


def unary(df: DataFrame, op: str) -> DataFrame:
    ops = {"abs": F.abs, "-": lambda c: -c, "+": lambda c: c}
    return df.withColumn(VALUE, ops[op](clean(VALUE)))


def clip_low(df: DataFrame, floor: float = 0.0, column: str = VALUE) -> DataFrame:
    kept = F.when(F.col(column).isNotNull(), F.greatest(F.col(column), F.lit(float(floor))))  # missing stays missing
    return df.withColumn(column, kept)


def chain(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply table functions in order."""
    return reduce(lambda d, step: d.transform(step), steps, df)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal multisets of rows."""
    columns = a.columns
    if set(columns) != set(b.columns):
        return False
    b = b.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def same_set(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> bool:
    """Equal sets of values of ``columns``."""
    on = list(columns)
    return join_on(a, b, on, "left_anti").isEmpty() and join_on(b, a, on, "left_anti").isEmpty()


def difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    return join_on(a, b.select(*columns), list(columns), "left_anti")


def intersection(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    return join_on(a, b.select(*columns), list(columns), "left_semi")


def concat(*frames: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)


def align_columns(new: DataFrame, known: DataFrame, keys: Sequence[str], strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """New observations restricted to the known series, plus the ignored extra series.

    A known series without any new observation raises if ``strict``.
    """
    on = list(keys)
    known_keys, new_keys = known.select(*on).distinct(), new.select(*on).distinct()
    if strict and not join_on(known_keys, new_keys, on, "left_anti").isEmpty():
        raise ValueError("series known from training are missing in the new observations")
    return join_on(new, known_keys, on, "left_semi"), join_on(new_keys, known_keys, on, "left_anti")
