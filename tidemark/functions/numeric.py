"""Null-safe numeric helpers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(col: Column | str) -> Column:
    """The value as double with NaN turned into null (null is the one missing value here)."""
    col = F.col(col) if isinstance(col, str) else col
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def gcd2(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs (91 Euclid steps cover every pair of 64-bit values)."""
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(91)),
        start,
        lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(
            F.struct(acc["b"].alias("a"), F.try_mod(acc["a"], acc["b"]).alias("b"))
        ),
    )
    return done["a"]


def null_safe(left: str, right: str, names: list[str]) -> Column:
    """Join condition on equal names where null matches null; ``left``/``right`` are aliases."""
    conditions = [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
    return reduce(lambda x, y: x & y, conditions) if conditions else F.lit(True)


def join_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``names``, keeping the left copy of the names."""
    a, b = left.alias("_l"), right.alias("_r")
    joined = a.join(b, null_safe("_l", "_r", names), how)
    if how in ("left_semi", "left_anti"):
        return joined
    extra = [F.col(f"_r.`{c}`") for c in right.columns if c not in names]
    return joined.select("_l.*", *extra)
