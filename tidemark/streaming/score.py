"""Streaming form of incremental scoring: event-time windows, empty windows, stream-static model join, alert sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.numeric import join_on
from tidemark.functions.timeunits import micros
from tidemark.operators.series import TS, VALUE
from tidemark.plans.detect import is_anomaly
from tidemark.plans.forecast import forecast


def windowed_metric(stream: DataFrame, keys: Sequence[str], aggregate: Column, grain: str = "1 hour", lateness: str = "2 hours",
                    slide: str | None = None, time: str = TS) -> DataFrame:
    """Metric per tumbling (or sliding) event-time window; rows later than ``lateness`` are dropped."""
    late = stream.withWatermark(time, lateness)
    window = F.window(time, grain, slide) if slide else F.window(time, grain)
    return late.groupBy(window, *keys).agg(aggregate.alias(VALUE)).select(*keys, F.col("window.start").alias(TS), VALUE)


#: Start of a window in microseconds; names with a leading underscore do not survive the way to keyed state.
START = "start_us"


class EmptyWindows(StatefulProcessor):
    """Closed windows of one series in order, those without rows with a fill value.

    The state of a series is one number, the start of the next window it owes. A closed window that arrives is preceded
    by the empty ones before it. A timer at the end of the window owed fires once the watermark has passed it without
    rows, so silent series emit too.
    """

    def __init__(self, names: Sequence[str], step: int, fill: float) -> None:
        self.names, self.step, self.fill = list(names), step, fill

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.owed = handle.getValueState("owed", T.StructType([T.StructField("start", T.LongType())]))

    def close(self) -> None:
        pass

    def _due(self, start: int) -> int:
        return (start + self.step) // 1000 - 1  # a timer fires when the watermark is beyond it

    def _move(self, old: int | None, new: int) -> None:
        if old != new:
            if old is not None:
                self.handle.deleteTimer(self._due(old))
            self.owed.update((new,))
            self.handle.registerTimer(self._due(new))

    def _owed(self) -> int | None:
        return self.owed.get()[0] if self.owed.exists() else None

    def _frame(self, key: tuple, starts: list[int], values: list[float]) -> pd.DataFrame:
        columns = {n: pd.Series([k] * len(starts), dtype=object if k is None or isinstance(k, str) else None) for n, k in zip(self.names, key)}
        return pd.DataFrame({**columns, START: starts, VALUE: values})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        if START in initialState.columns:  # frames without columns stand for a side that does not hold the series
            self._move(self._owed(), int(initialState[START].min()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = sorted((int(s), v) for frame in rows if START in frame.columns for s, v in zip(frame[START], frame[VALUE]))  # as many as windows closed at once
        if not closed:
            return
        before = owed = self._owed()
        starts, values = [], []
        for start, value in closed:
            if owed is not None:
                gap = range(owed, start, self.step)
                starts += gap
                values += [self.fill] * len(gap)
            starts.append(start)
            values.append(value)
            owed = start + self.step if owed is None else max(owed, start + self.step)
        self._move(before, owed)
        yield self._frame(key, starts, values)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        owed = self._owed()
        ended = (timerValues.getCurrentWatermarkInMs() * 1000 - owed) // self.step  # whole windows below the watermark
        starts = [owed + i * self.step for i in range(ended)]
        if starts:
            self.owed.update((owed + ended * self.step,))
            self.handle.registerTimer(self._due(owed + ended * self.step))
            yield self._frame(key, starts, [self.fill] * ended)


def dense_windowed_metric(stream: DataFrame, keys: Sequence[str], aggregate: Column, grain: str = "1 hour", lateness: str = "2 hours",
                          known: DataFrame | None = None, fill: float = 0.0, time: str = TS) -> DataFrame:
    """Like ``windowed_metric`` with tumbling windows, and every series also has the windows in which it has no rows.

    A series is filled from its first window, or, where ``known (keys, ts)`` names it, from the window that holds its
    ``ts``, even if it never sends a row; windows with rows before that are kept. Windows are closed by the watermark, so the result over any number of
    batches and restarts is that of ``dense_windows`` over the same rows. Rows are aggregated before they meet the keyed
    state, so a hot series costs no more there than a quiet one.
    """
    spark = stream.sparkSession
    # keyed state with timers needs this store; it is read when the stream starts
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    step = pd.Timedelta(grain) // pd.Timedelta("1us")
    late = stream.withWatermark(time, lateness)
    closed = late.groupBy(F.window(time, grain), *keys).agg(aggregate.cast("double").alias(VALUE))
    closed = closed.select(*keys, F.window_time("window").alias("window_end"), F.unix_micros("window.start").alias(START), VALUE)
    schema = T.StructType([T.StructField(k, stream.schema[k].dataType) for k in keys] + [T.StructField(START, T.LongType()), T.StructField(VALUE, T.DoubleType())])
    first = None if known is None else known.groupBy(*keys).agg(F.min(_floor(TS, step)).alias(START)).groupBy(*keys)
    filled = closed.groupBy(*keys).transformWithStateInPandas(EmptyWindows(keys, step, fill), schema, "append", "eventTime", initialState=first)
    return filled.select(*keys, F.timestamp_micros(START).alias(TS), VALUE)


def _floor(time: str, step: int) -> Column:
    """Start of the tumbling window that holds a time, in microseconds."""
    at = micros(time)
    return at - F.pmod(at, F.lit(step))


def dense_windows(df: DataFrame, keys: Sequence[str], aggregate: Column, grain: str = "1 hour", lateness: str = "2 hours",
                  known: DataFrame | None = None, fill: float = 0.0, time: str = TS) -> DataFrame:
    """The windows that ``dense_windowed_metric`` has emitted once all of ``df`` was read, from a table."""
    step = pd.Timedelta(grain) // pd.Timedelta("1us")
    cells = df.groupBy(*keys, _floor(time, step).alias(START)).agg(aggregate.cast("double").alias(VALUE))
    below = df.agg(F.max(micros(time)) - F.lit(pd.Timedelta(lateness) // pd.Timedelta("1us"))).scalar()  # one row
    last = F.floor(below / step) * step - step  # start of the last closed window
    begin = cells.groupBy(*keys).agg(F.min(START).alias("_seen"))
    if known is not None:
        since = known.groupBy(*keys).agg(F.min(_floor(TS, step)).alias("_since"))
        both = begin.withColumn("_since", F.lit(None).cast("long")).unionByName(since.withColumn("_seen", F.lit(None).cast("long")))
        begin = both.groupBy(*keys).agg(F.coalesce(F.max("_since"), F.max("_seen")).alias("_seen"))
    grid = begin.where(F.col("_seen") <= last).select(*keys, F.explode(F.sequence("_seen", last, F.lit(step))).alias(START))
    filled = join_on(grid, cells, [*keys, START], "left").withColumn(VALUE, F.coalesce(VALUE, F.lit(float(fill))))
    early = join_on(cells, begin, list(keys)).where((F.col(START) < F.col("_seen")) & (F.col(START) <= last)).drop("_seen")
    return filled.unionByName(early).select(*keys, F.timestamp_micros(START).alias(TS), VALUE)


def score_windows(metric: DataFrame, keys: Sequence[str], params: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Verdicts of finished windows under static detector parameters.

    For a detector trained on residuals give its forecast ``models``: the scale then belongs to value minus forecast,
    and windows of series without a model have no verdict.
    """
    checked = F.col(VALUE)
    if models is not None:
        metric = forecast(models, metric, keys, keep=[VALUE]).select(*keys, TS, VALUE, "yhat")
        checked = F.col(VALUE) - F.col("yhat")
    joined = join_on(metric, params.select(*keys, "algorithm_name", "scale", "tolerance", "direction"), list(keys), "left")
    flag = is_anomaly(checked, F.col("scale"), F.col("tolerance"), F.col("direction"))
    return joined.select("algorithm_name", *keys, TS, VALUE, flag.alias("is_anomaly"), F.col("algorithm_name").isNotNull().alias("has_model"))


def start_scoring(scored: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None, once: bool = True, interval: str = "1 minute"):
    """Append verdicts (or ``each`` of a batch) to ``path``; a batch number partition makes replays overwrite."""

    def write(batch: DataFrame, number: int) -> None:
        out = each(batch) if each else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()
