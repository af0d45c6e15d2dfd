"""Order-dependent column operators (lag, running sums, positions) that stay whole on hot keys.

A window partitioned by a series key puts that series in one task. That is the right plan while
every series fits one task, and a wall once one series holds a large share of all rows. So:

1. ``find_hot`` counts rows per key (map-side combined, one job) and keeps the keys above a row limit, the ``MAX_HOT``
   largest at most: a proven bound, and a key beyond them holds no more than total / ``MAX_HOT`` rows.
2. Rows of other keys are never written or moved for the sake of hot ones: plain windows over ``keys``.
3. Rows of hot keys are cut into blocks of consecutive rows by a range partitioning on the keys and the order columns
   themselves, whatever their types, and written once with the number of their block. Windows run per
   (keys, block); a small table with one row per block carries the running state (a sum, an extremum, the last row) from
   block to block and is joined back: a segmented parallel prefix. Before each further step the hot rows are written to
   the shared folder, so that the two branches of a step read a table.
4. ``frame()`` is the union of both parts. Results are those of plain windows.

The limit is the session setting ``tidemark.hotRows``.

The rows of other keys are dealt by key into as many tasks as keep about ``tidemark.taskRows`` rows in each, since the
sorts and aggregates that follow all run in one task on the same rows: its memory does not grow with the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import join_on
from tidemark.session import materialize

HOT_ROWS_KEY = "tidemark.hotRows"
DEFAULT_HOT_ROWS = 5_000_000
MAX_HOT = 50_000
TASK_ROWS_KEY = "tidemark.taskRows"
DEFAULT_TASK_ROWS = 100_000
_BLOCK = "_block"


@dataclass(frozen=True)
class HotKeys:
    """Keys with more rows than one task should sort, the row limit used and the number of all rows counted."""

    keys: tuple[str, ...]
    table: DataFrame | None
    limit: int
    rows: int
    total: int = 0

    @property
    def any(self) -> bool:
        return self.table is not None


def hot_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_KEY, str(DEFAULT_HOT_ROWS)))


def no_hot(keys: Sequence[str]) -> HotKeys:
    """For inputs known to hold few rows per key."""
    return HotKeys(tuple(keys), None, 0, 0)


def find_hot(df: DataFrame, keys: Sequence[str], at_most: int | None = None) -> HotKeys:
    """The hot keys of ``df``: at most ``MAX_HOT`` of them, kept as a small table.

    ``at_most`` lowers the row limit for operators that cost more per row than a sort.
    """
    limit = hot_limit(df) if at_most is None else min(hot_limit(df), at_most)
    if not keys:
        total = df.count()
        return HotKeys((), df.sparkSession.range(1).select(F.lit(total).alias("_n")), limit, total) if total > limit else no_hot(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if largest <= limit:
        return HotKeys(tuple(keys), None, 0, 0, total)
    counts = sizes.where(F.col("_n") > limit)
    rows = counts.orderBy(F.desc("_n")).limit(MAX_HOT).collect()
    table = df.sparkSession.createDataFrame(rows, counts.schema)
    return HotKeys(tuple(keys), table, limit, sum(r["_n"] for r in rows), total)


def task_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(TASK_ROWS_KEY, str(DEFAULT_TASK_ROWS)))


def spread(df: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """Rows dealt by key into tasks of about ``tidemark.taskRows``; left as they are where they fit one."""
    rows = task_rows(df)
    if not keys or total <= rows:
        return df
    return df.repartition(max(math.ceil(total / rows), df.sparkSession.sparkContext.defaultParallelism), *keys)


@dataclass(frozen=True)
class OrderKey:
    """One order column."""

    name: str
    descending: bool = False

    def sort(self) -> Column:
        return F.col(self.name).desc_nulls_last() if self.descending else F.col(self.name).asc_nulls_last()

    def turned(self) -> Column:
        return F.col(self.name).asc_nulls_first() if self.descending else F.col(self.name).desc_nulls_first()


def _order(spec: Sequence[str | OrderKey]) -> list[OrderKey]:
    return [s if isinstance(s, OrderKey) else OrderKey(s.lstrip("-"), s.startswith("-")) for s in spec]


def add_blocks(df: DataFrame, hot: HotKeys, order: Sequence[OrderKey]) -> DataFrame:
    """Hot rows with ``_block``, a number that grows with the order inside a key; written once."""
    pieces = max(2, 2 * math.ceil(hot.rows / hot.limit))
    ranged = df.repartitionByRange(pieces, *[F.col(k) for k in hot.keys], *[o.sort() for o in order])
    return materialize(ranged.withColumn(_BLOCK, F.spark_partition_id().cast("long")), "blocks")


def _mark(df: DataFrame, hot: HotKeys) -> DataFrame:
    if not hot.keys:
        return df.withColumn("_hot", F.lit(True))
    table = F.broadcast(hot.table.select(*hot.keys, F.lit(True).alias("_hot")))  # <= MAX_HOT rows
    return join_on(df, table, list(hot.keys), "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))


class OrderedRows:
    """Rows of a table with a key and an order inside the key.

    Every method adds columns and returns a new OrderedRows; ``frame()`` gives the table back.
    ``order`` entries are column names, ``-name`` for descending; the order must be total inside a
    key for repeatable results.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str | OrderKey], hot: HotKeys | None = None):
        self.keys = list(keys)
        self.order = _order(order)
        self.hot = find_hot(df, self.keys) if hot is None else hot
        self._cold: DataFrame | None = spread(df, self.keys, self.hot.total)
        self._blocks: DataFrame | None = None
        self._written = True
        if self.hot.any:
            marked = _mark(df, self.hot)
            self._cold = spread(marked.where(~F.col("_hot")).drop("_hot"), self.keys, self.hot.total - self.hot.rows) if self.keys else None
            self._blocks = add_blocks(marked.where("_hot").drop("_hot"), self.hot, self.order)

    def _with(self, cold: Callable[[DataFrame], DataFrame], blocks: Callable[[DataFrame], DataFrame]) -> "OrderedRows":
        out = object.__new__(OrderedRows)
        out.keys, out.order, out.hot, out._written = self.keys, self.order, self.hot, False
        out._cold = None if self._cold is None else cold(self._cold)
        out._blocks = None if self._blocks is None else blocks(self._blocks)
        return out

    def _stepped(self, cold: Callable[[DataFrame], DataFrame], blocks: Callable[[DataFrame], DataFrame]) -> "OrderedRows":
        """A step that reads the hot rows on two branches."""
        if self._blocks is not None and not self._written:
            self._blocks, self._written = materialize(self._blocks, "blocks"), True
        return self._with(cold, blocks)

    def map(self, fn: Callable[[DataFrame], DataFrame]) -> "OrderedRows":
        """Apply a row-wise DataFrame function (keys and order columns must survive)."""
        return self._with(fn, fn)

    def frame(self) -> DataFrame:
        if self._blocks is None:
            return self._cold
        hot = self._blocks.drop(_BLOCK)
        return hot if self._cold is None else self._cold.unionByName(hot)

    @property
    def _cells(self) -> list[str]:
        return [*self.keys, _BLOCK]

    def _window(self, cells: Sequence[str], reverse: bool = False):
        return Window.partitionBy(*cells).orderBy(*[o.turned() if reverse else o.sort() for o in self.order])

    def _block_window(self, reverse: bool = False):
        return Window.partitionBy(*self.keys).orderBy(F.col(_BLOCK).desc() if reverse else F.col(_BLOCK).asc())

    def running(self, how: str, reverse: bool = False, **cols: Column | str) -> "OrderedRows":
        """Inclusive running ``sum``, ``max`` or ``min`` of columns, nulls skipped."""
        agg, join = {
            "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
            "max": (F.max, lambda a, b: F.greatest(a, b)),
            "min": (F.min, lambda a, b: F.least(a, b)),
        }[how]
        source = {n: F.col(c) if isinstance(c, str) else c for n, c in cols.items()}

        def within(rows: DataFrame, cells: Sequence[str]) -> DataFrame:
            local = self._window(cells, reverse).rowsBetween(Window.unboundedPreceding, 0)
            return rows.withColumns({n: agg(c).over(local) for n, c in source.items()})

        def across(rows: DataFrame) -> DataFrame:
            before = self._block_window(reverse).rowsBetween(Window.unboundedPreceding, -1)
            per_block = rows.groupBy(*self._cells).agg(*[agg(c).alias(n) for n, c in source.items()])
            carry = per_block.select(*self._cells, *[agg(F.col(n)).over(before).alias(f"_c_{n}") for n in source])
            joined = join_on(within(rows, self._cells), carry, self._cells, "left")
            return joined.withColumns({n: join(F.col(n), F.col(f"_c_{n}")) for n in source}).drop(*[f"_c_{n}" for n in source])

        return self._stepped(lambda rows: within(rows, self.keys), across)

    def running_sum(self, **cols) -> "OrderedRows":
        return self.running("sum", **cols)

    def running_max(self, **cols) -> "OrderedRows":
        return self.running("max", **cols)

    def position(self, name: str = "pos", start: int = 1, reverse: bool = False) -> "OrderedRows":
        """Position in the key, counted from ``start`` (from the end with ``reverse``)."""

        def across(rows: DataFrame) -> DataFrame:
            sizes = rows.groupBy(*self._cells).agg(F.count(F.lit(1)).alias("_c"))
            before = self._block_window(reverse).rowsBetween(Window.unboundedPreceding, -1)
            carry = sizes.select(*self._cells, F.coalesce(F.sum("_c").over(before), F.lit(0).cast("long")).alias("_c"))
            joined = join_on(rows, carry, self._cells, "left")
            return joined.withColumn(name, number(self._cells) + F.col("_c")).drop("_c")

        number = lambda cells: F.row_number().over(self._window(cells, reverse)).cast("long") + F.lit(start - 1)
        return self._stepped(lambda rows: rows.withColumn(name, number(self.keys)), across)

    def previous(self, reverse: bool = False, **cols: Column | str) -> "OrderedRows":
        """Value of the row before (after, with ``reverse``); null on the first row."""
        source = {n: F.col(c) if isinstance(c, str) else c for n, c in cols.items()}

        def within(rows: DataFrame, cells: Sequence[str]) -> DataFrame:
            window = self._window(cells, reverse)
            return rows.withColumns({n: F.lag(c, 1).over(window) for n, c in source.items()})

        def across(rows: DataFrame) -> DataFrame:
            value = F.struct(*[c.alias(n) for n, c in source.items()])
            last = rows.select(*self._cells, value.alias("_last"), F.row_number().over(self._window(self._cells, not reverse)).alias("_rn")).where("_rn = 1")
            carry = last.select(*self._cells, F.lag("_last", 1).over(self._block_window(reverse)).alias("_carry"))
            local = within(rows.withColumn("_rn", F.row_number().over(self._window(self._cells, reverse))), self._cells)
            joined = join_on(local, carry, self._cells, "left")
            return joined.withColumns({n: F.when(F.col("_rn") == 1, F.col("_carry")[n]).otherwise(F.col(n)) for n in source}).drop("_rn", "_carry")

        return self._stepped(lambda rows: within(rows, self.keys), across)

    def total(self, **aggs: Column) -> "OrderedRows":
        """Aggregates over the whole key on every row (grouped once and joined back on hot keys)."""

        def across(rows: DataFrame) -> DataFrame:
            if not self.keys:
                one = rows.agg(F.struct(*[a.alias(n) for n, a in aggs.items()]).alias("_t")).scalar()  # one row
                return rows.withColumns({n: one[n] for n in aggs})
            return join_on(rows, rows.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggs.items()]), self.keys, "left")

        whole = Window.partitionBy(*self.keys)
        return self._stepped(lambda rows: rows.withColumns({n: a.over(whole) for n, a in aggs.items()}), across)

    def runs(self, value: str, out: str = "run") -> "OrderedRows":
        """Number maximal runs of equal ``value`` from 1 upwards inside the key."""
        prev = self.map(lambda d: d.withColumn("_one", F.lit(1))).previous(_pv=value, _po="_one")
        flag = F.when(F.col("_po").isNull() | ~F.col("_pv").eqNullSafe(F.col(value)), 1).otherwise(0).cast("long")
        return prev.running_sum(**{out: flag}).map(lambda d: d.drop("_pv", "_po", "_one"))

    def per_run(self, run: str, **aggs: Column) -> "OrderedRows":
        """Aggregates over (key, run) on every row."""
        groups = [*self.keys, run]

        def across(rows: DataFrame) -> DataFrame:
            per_run = rows.groupBy(*groups).agg(*[a.alias(n) for n, a in aggs.items()])
            cells = rows.select(*groups, _BLOCK).distinct()
            return join_on(rows, join_on(cells, per_run, groups), [*groups, _BLOCK])

        whole = Window.partitionBy(*groups)
        return self._stepped(lambda rows: rows.withColumns({n: a.over(whole) for n, a in aggs.items()}), across)


def count_equal(df: DataFrame, columns: Sequence[str], hot: HotKeys) -> DataFrame:
    """Rows with a weight ``_m``: 1 each, or equal rows counted together where hot keys exist.

    Counting costs a shuffle of its own, so it is left out where every key fits one task anyway.
    """
    if hot.any:
        return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_m"))
    return df.select(*columns, F.lit(1).cast("long").alias("_m"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], hot: HotKeys | None = None, weight: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per key, with no whole group in one buffer.

    With ``weight`` a row stands for that many rows (distinct values per key then).

    Values are ranked by running counts and only the two rows around each quantile position are
    kept. Where hot keys exist, equal values are counted first (map-side combined).
    """
    keys = list(keys)
    hot = find_hot(df, keys) if hot is None else hot
    values = df.where(F.col(value).isNotNull())
    if weight is None:
        counted = count_equal(values.select(*keys, F.col(value).alias("_v")), [*keys, "_v"], hot)
    else:
        counted = values.select(*keys, F.col(value).alias("_v"), F.col(weight).alias("_m"))
    rows = OrderedRows(counted, keys, ["_v"], hot)
    ranked = rows.running_sum(_hi="_m").total(_n=F.sum("_m")).frame().withColumn("_lo", F.col("_hi") - F.col("_m"))
    aggs = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        floor, frac = F.floor(at), at - F.floor(at)
        here = (F.col("_lo") <= floor) & (floor < F.col("_hi"))
        after = (F.col("_lo") <= floor + 1) & (floor + 1 < F.col("_hi"))
        low = F.max(F.when(here, F.col("_v")))
        high = F.max(F.when(after, F.col("_v")))
        aggs += [low.alias(f"_a_{name}"), high.alias(f"_b_{name}"), F.max(frac).alias(f"_f_{name}")]
    wide = ranked.groupBy(*keys).agg(*aggs)
    picks = [
        (F.col(f"_a_{n}") + F.coalesce((F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}"), F.lit(0.0))).alias(n)
        for n in probs
    ]
    return wide.select(*keys, *picks)
