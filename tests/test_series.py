import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import timeunits as U
from tidemark.functions.numeric import gcd2
from tidemark.operators import grid as G
from tidemark.operators import scaling as C
from tidemark.operators import series as S
from tidemark.operators.ordered import OrderedRows, exact_quantiles
from tidemark.sources import series_io as IO


def series(spark, rows):
    return spark.createDataFrame([(k, pd.Timestamp(t).to_pydatetime(), v) for k, t, v in rows], "k string, ts timestamp_ntz, value double")


def times(df):
    return [str(r.ts) for r in df.orderBy("ts").collect()]


@pytest.fixture(scope="module")
def two(spark):
    return series(spark, [("a", "2024-01-01", 1.0), ("a", "2024-01-02", None), ("a", "2024-01-05", 4.0), ("b", "2024-01-01", 2.0), ("b", "2024-01-02", 0.0), ("b", "2024-01-05", -3.0)])


def test_granularity_names():
    assert U.parse_granularity("calendar month") == U.Granularity("month", 1) == U.parse_granularity("fiscal_month")
    assert U.parse_granularity("fy_quarter").n == 3 and U.parse_granularity("fiscal half year").n == 6
    assert U.parse_granularity("3 months") == U.Granularity("month", 3)
    assert U.parse_granularity("15min") == U.Granularity("fixed", 15 * U.MINUTE) == U.parse_granularity("15 minutes")
    assert U.frequency_granularity("Daily") == U.parse_granularity("day") and U.frequency_granularity("hourly").n == U.HOUR
    for bad in ("fortnight", "0 days"):
        with pytest.raises(ValueError):
            U.parse_granularity(bad)
    with pytest.raises(ValueError):
        U.frequency_granularity("minutely")


def test_ranges(spark):
    assert times(G.time_range(spark, "2024-01-30", periods=3, gran="month")) == ["2024-01-30 00:00:00", "2024-02-29 00:00:00", "2024-03-30 00:00:00"]
    assert times(G.time_range(spark, end="2024-01-02", periods=2, gran="12 hours")) == ["2024-01-01 12:00:00", "2024-01-02 00:00:00"]
    assert times(G.time_range(spark, "2023-01-06", end="2023-01-10", gran="B")) == ["2023-01-06 00:00:00", "2023-01-09 00:00:00", "2023-01-10 00:00:00"]
    with pytest.raises(ValueError):
        G.time_range(spark, "2023-01-06", gran="day")


def test_business_day_future(spark):
    ends = series(spark, [("a", "2023-01-05", 1.0), ("a", "2023-01-06", 1.0)])
    assert times(G.future(ends, ["k"], "B", 1, 1)) == ["2023-01-06 00:00:00", "2023-01-09 00:00:00"]
    with pytest.raises(ValueError):
        G.future(ends.where("false").select("ts"), [], "day", 1)


def test_dense_and_missing(two):
    a = two.where("k = 'a'")
    assert times(G.missing_times(a, ["k"], "day")) == ["2024-01-03 00:00:00", "2024-01-04 00:00:00"]
    dense = G.make_dense(a, ["k"], "day", 9.0).orderBy("ts").toPandas()
    assert dense.value.tolist()[2:] == [9.0, 9.0, 4.0] and pd.isna(dense.value[1])
    assert G.make_dense(a.where("false"), ["k"], "day").count() == 0
    assert G.fill_values(a, 5.0).orderBy("ts").toPandas().value.tolist() == [1.0, 5.0, 4.0]


@pytest.mark.parametrize("points,kind,n", [
    (["2024-01-31", "2024-02-29", "2024-04-30"], "month_end", 1),
    (["2024-01-15", "2024-04-15", "2024-10-15"], "month", 3),
    (["2024-01-01", "2024-02-10", "2024-03-21"], "fixed", 40 * U.DAY),
    (["2024-01-01", "2024-01-03", "2024-01-07"], "fixed", 2 * U.DAY),
    (["2024-01-01 00:00", "2024-01-01 00:30", "2024-01-01 01:15"], "fixed", 15 * U.MINUTE),
    (["2024-01-01 07:00"], "fixed", U.HOUR),
    (["2024-01-01"], "fixed", U.DAY),
])
def test_infer_granularity(spark, points, kind, n):
    df = series(spark, [("a", p, 1.0) for p in points])
    row = G.infer_granularity(df, ["k"]).first()
    assert (row.kind, row.n) == (kind, n)


def test_infer_recent_votes(spark):
    df = series(spark, [("a", f"2024-01-01 0{h}:00", 1.0) for h in range(5)] + [("a", "2024-01-02", 1.0)])
    row = G.infer_granularity_recent(df, ["k"]).first()
    assert (row.kind, row.n) == ("fixed", U.HOUR)


def test_gcd(spark):
    got = spark.createDataFrame([(12, 18), (0, 5), (2**40, 2**35 * 3)], "a long, b long").select(gcd2(F.col("a"), F.col("b")).alias("g")).collect()
    assert [r.g for r in got] == [6, 5, 2**35]


def test_index_problems(spark):
    df = series(spark, [("a", "2024-01-01 00:00:00.1", 1.0), ("a", "2024-01-01 00:00:00.6", 1.0), ("a", "2024-01-01 00:00:02.1", 1.0), ("a", "2024-01-01 00:00:02.1", 1.0)])
    row = G.index_problems(df, ["k"], "second").first()
    assert (row.duplicate_times, row.duplicate_positions, row.off_grid) == (1, 1, 1)
    month = series(spark, [("a", "2024-01-31", 1.0), ("a", "2024-02-29", 1.0), ("a", "2024-03-15", 1.0)])
    assert G.index_problems(month, ["k"], "month").first().off_grid == 1
    assert G.index_problems(month, ["k"], "M").first().off_grid == 1
    week = series(spark, [("a", "2023-01-06", 1.0), ("a", "2023-01-07", 1.0), ("a", "2023-01-09", 1.0)])
    assert G.index_problems(week, ["k"], "B").first().off_grid == 1


def test_scales_and_order(spark, two):
    a = series(spark, [("a", "2024-01-01", 1.0), ("a", "2024-01-02", 1.0)])
    b = series(spark, [("b", "2024-01-04", 1.0)])
    off = series(spark, [("b", "2024-01-04 06:00", 1.0)])
    assert G.starts_before(a, b) and G.strictly_before(a, b) and not G.strictly_before(b, a) and not G.starts_before(a, a)
    assert not G.starts_before(a.where("false"), b)
    assert G.same_scale(a, b, "day", "day") and not G.same_scale(a, off, "day", "day") and not G.same_scale(a, b, "day", "hour")
    assert not G.same_scale(a, b, "day", "day", ("1970-01-01", "second"), ("1970-01-01", "day"))
    ends = series(spark, [("a", "2024-01-31", 1.0)])
    assert G.same_scale(ends, series(spark, [("a", "2024-03-31", 1.0)]), "M", "M")
    assert not G.same_scale(ends, series(spark, [("a", "2024-03-30", 1.0)]), "M", "M")
    assert G.same_times(a, a) and not G.same_times(a, b) and G.same_shape(a, a, ["k"])


def test_build_series(spark):
    df = spark.createDataFrame([(None, "2024-01-01", 1.0, 2), ("x", "2024-01-01", float("nan"), 3)], "g string, at string, v double, w int")
    one = S.to_series(df, "at", "v", ["g"])
    assert one.count() == 2 and one.where("value is null").count() == 1
    both = S.to_series(df, "at", ["v", "w"], ["g"])
    assert both.columns == ["series", "g", "ts", "value"] and both.count() == 4
    with pytest.raises(ValueError):
        S.to_series(df, "at", "v")


def test_select_and_rename(two):
    assert S.select(two, ["k"], ["a"]).count() == 3 and S.contains(two, ["k"], "b") and not S.contains(two, ["k"], "z")
    levelled = S.add_level(two, "m", "x")
    assert S.select_prefix(levelled, ["m", "k"], ["x"]).count() == 6
    with pytest.raises(KeyError):
        S.select(levelled, ["m", "k"], [("a",)])
    renamed = S.rename_series(two, ["k"], {("a",): ("c",), ("b",): ("d",)})
    assert {r.k for r in renamed.select("k").distinct().collect()} == {"c", "d"}
    with pytest.raises(ValueError):
        S.rename_series(two, ["k"], {("a",): ("c",), ("b",): ("c",)})
    kept = S.rename_series(two, ["k"], {("a",): ("c",)})
    assert {r.k for r in kept.select("k").distinct().collect()} == {"c", "b"} and kept.count() == two.count()
    with pytest.raises(ValueError):
        S.rename_series(two, ["k"], {("a",): ("b",)})
    swapped = S.rename_series(two, ["k"], {("a",): ("b",), ("b",): ("a",)})
    assert swapped.where("k = 'b'").count() == two.where("k = 'a'").count()
    with pytest.raises(ValueError):
        S.drop_level(two, ["k"], "k")


def test_slices(two):
    assert S.drop_incomplete_rows(two).count() == 4
    assert S.time_slice(two, "2024-01-01", "2024-01-05").count() == 4
    pos = lambda *a: sorted(r.value for r in S.position_slice(two.where("k = 'b'"), ["k"], *a).collect())
    assert pos(1) == [-3.0, 0.0] and pos(-1) == [-3.0] and pos(0, -1) == [0.0, 2.0] and pos(1, 2) == [0.0] and pos(-2, -1) == [0.0]
    flags = two.select("k", "ts", (F.col("value") > 0).alias("flag"))
    assert S.mask(two, flags, ["k"]).count() == 3
    assert {r.k: r.has_missing for r in S.has_missing(two, ["k"]).collect()} == {"a": True, "b": False}


def test_math(two, spark):
    a, b = two.where("k = 'a'").drop("k"), two.where("k = 'b'").drop("k")
    value = lambda d: d.orderBy("ts").toPandas().value.tolist()
    same = lambda x, y: all((pd.isna(i) and pd.isna(j)) or i == pytest.approx(j) for i, j in zip(x, y))
    assert same(value(S.combine(a, "-", b, [])), [-1.0, None, 7.0])
    assert same(value(S.combine(b, "/", 0, [])), [None, None, None])
    assert same(value(S.combine(b, "%", -2, [])), [0.0, 0.0, -1.0]) and same(value(S.combine(b, "%", 2, [])), [0.0, 0.0, 1.0])
    assert same(value(S.combine(b, "//", 2, [])), [1.0, 0.0, -2.0])
    assert same(value(S.combine(b, "**", 2, [], reverse=True)), [4.0, 1.0, 0.125])
    assert same(value(S.combine(a, ">=", b, [])), [0.0, 0.0, 1.0])
    assert same(value(S.unary(b, "abs")), [2.0, 0.0, 3.0]) and same(value(S.unary(b, "-")), [-2.0, 0.0, 3.0])
    assert same(value(S.clip_low(a)), [1.0, None, 4.0]) and same(value(S.clip_low(b)), [2.0, 0.0, 0.0])
    with pytest.raises(ValueError):
        S.combine(a, "+", b.where("value <> 0"), [])


def test_align_columns(two):
    kept, extra = S.align_columns(two, two.where("k = 'a'"), ["k"])
    assert kept.count() == 3 and [r.k for r in extra.collect()] == ["b"]
    with pytest.raises(ValueError):
        S.align_columns(two.where("k = 'a'"), two, ["k"])


def test_attach_values(two):
    assert S.attach_values(two.select("k", "ts"), two, ["k"]).count() == 6
    with pytest.raises(ValueError):
        S.attach_values(two.select("k", "ts"), two.where("k = 'a'"), ["k"])


def test_isin_by_both_scales(two):
    left = two.withColumn("ts_int", U.to_int_scale("ts", unit="day"))
    right = left.where("k = 'b' and value = 0").withColumn("ts_int", F.col("ts_int") + 1)
    assert S.is_in(left, right).where("found").count() == 0
    assert S.is_in(two, right.select("ts")).where("found").count() == 2


def test_int_scale_roundtrip(two):
    back = two.withColumn("again", U.from_int_scale(U.to_int_scale("ts", "2024-01-01", "hour"), "2024-01-01", "hour"))
    assert back.where("again <> ts").count() == 0


def test_wide_and_json(spark, two):
    wide = IO.to_wide(two, "k", ["a", "b"], as_timestamp=True)
    assert wide.columns == ["time", "a", "b"] and wide.count() == 3
    with pytest.raises(ValueError):
        IO.to_wide(two, "k", ["time"])
    text = IO.to_json_rows(two, ["k"], "calendar month")
    assert S.same_rows(IO.from_json_rows(text, ["k"]).select(*two.columns), two)
    row = IO.json_granularity(text).first()
    assert (row.kind, row.n) == ("month", 1)


def test_forecast_set(spark, tmp_path):
    (tmp_path / "train.csv").write_text("V1,V2,V3,V4\nH1,1,2,\nH2,5,6,7\n")
    (tmp_path / "test.csv").write_text("V1,V2\nH1,3\nH2,8\n")
    (tmp_path / "info.csv").write_text("M4id,StartingDate\nH1,01-07-15 12:00\nH2,2015-07-01 01:30:00\n")
    args = [str(tmp_path / f"{n}.csv") for n in ("train", "test", "info")]
    rows = IO.read_forecast_set(spark, *args, "hourly").orderBy("id", "ts").collect()
    assert [(r.id, str(r.ts), r.value, r.split) for r in rows][:3] == [
        ("H1", "2015-07-01 00:00:00", 1.0, "train"), ("H1", "2015-07-01 01:00:00", 2.0, "train"), ("H1", "2015-07-01 02:00:00", 3.0, "test")]
    assert str(rows[3].ts) == "2015-07-01 01:30:00" and len(rows) == 7
    assert IO.read_forecast_set(spark, *args, "daily", max_series=1).select("id").distinct().count() == 1
    bad = spark.createDataFrame([("soon",)], "t string").select(IO.parse_start(F.col("t")))
    with pytest.raises(Exception, match="cannot parse start time"):
        bad.collect()


def test_scaling(spark):
    train = spark.createDataFrame([(0.0, 5.0, 0), (10.0, 5.0, 1)], "x double, y double, is_attack int")
    other = spark.createDataFrame([(20.0, 7.0, 1)], "x double, y double, is_attack int")
    assert C.min_max_scale(train, other, ["x", "y"])[1].first() == (2.0, 2.0, 1)
    scores = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "k string, idx long, score double")
    flipped = C.scale_scores(scores, ["k"], flip=True).orderBy("idx").toPandas()
    assert flipped.score.tolist() == [1.0, 0.75, 0.5, 0.25, 0.0]
    j1, j2 = (C.jitter_scores(scores.repartition(n), ["k", "idx"], seed=7).orderBy("idx").toPandas().score for n in (1, 3))
    assert j1.tolist() == j2.tolist() and all(abs(a - b) <= 0.1 * b for a, b in zip(j1, range(5)))
    assert C.seeded_sample(scores, ["idx"], 3).count() == 3


def test_empty_keys_on_blocks(spark, hot):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 7).cast("double").alias("v"))
    rows = OrderedRows(df, [], ["id"]).running_sum(s="v").previous(p="id").total(t=F.sum("v")).frame().orderBy("id").toPandas()
    assert rows.s.iloc[-1] == rows.v.sum() == rows.t[0] and pd.isna(rows.p[0]) and (rows.p[1:] == rows.id[:-1].to_numpy()).all()
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first().m == rows.v.median()


def test_run_bounds(spark):
    row = G.run_bounds(spark, "2024-01-31 10:00:00", "14 days", "2 hours").first()
    assert (str(row.start_ts), str(row.end_ts)) == ("2024-01-17 10:00:00", "2024-01-31 08:00:00")
    row = G.run_bounds(spark, "2024-01-31 10:00:00", "2024-01-01", None).first()
    assert (str(row.start_ts), str(row.end_ts)) == ("2024-01-01 00:00:00", "2024-01-31 10:00:00")
    assert str(G.run_bounds(spark, "2024-01-31", "1 day", "0s").first().end_ts) == "2024-01-31 00:00:00"


def _calls(spark, fn):
    """Names of tables written while ``fn`` runs, with their numbers of rows."""
    from tidemark.operators import ordered

    written, real = [], ordered.materialize

    def spy(df, name="cut"):
        out = real(df, name)
        written.append((name, out.count()))
        return out

    ordered.materialize = spy
    try:
        return fn(), written
    finally:
        ordered.materialize = real


@pytest.mark.parametrize("order", [["big"], ["-big"], ["word", "-day"], ["-day", "word"], ["flag", "big"]])
def test_one_hot_key_among_many(spark, order):
    """Long integers beyond 2**53, strings, dates with nulls as order; only the hot key's rows are written."""
    import random

    rnd = random.Random(1)
    rows = []
    for k, n in [("hot", 900), (None, 30), *[(f"c{i}", 20) for i in range(20)]]:
        for i in range(n):
            day = None if i % 37 == 0 else dt.date(2024, 1, 1) + dt.timedelta(days=i % 50)
            rows.append((k, 2**60 + i, f"w{i * 7919 % n:05d}", day, i % 3 == 0, rnd.choice([None, 1.0, 2.0, -3.0]), rnd.randrange(2)))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, big long, word string, day date, flag boolean, v double, y int")

    def work():
        made = OrderedRows(df, ["k"], order).position("p").position("q", reverse=True).previous(before="v").previous(reverse=True, after="v")
        made = made.running_sum(s="v").running_max(m="big").total(n=F.count("v"), top=F.max("word")).runs("y", "run").per_run("run", r=F.sum("v"))
        return made.frame()

    plain, none = _calls(spark, work)
    spark.conf.set("tidemark.hotRows", "100")
    try:
        blocks, written = _calls(spark, work)
    finally:
        spark.conf.unset("tidemark.hotRows")
    assert not none and written and all(n == 900 for _, n in written)
    assert blocks.columns == plain.columns and sorted(map(str, blocks.collect())) == sorted(map(str, plain.collect()))
    assert blocks.where("k = 'hot' AND p + q <> 901").isEmpty()
