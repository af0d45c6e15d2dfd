import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.series import same_rows
from tidemark.plans.metrics import MetricSpec, QuerySpec, complete_entities, metric_query, metric_sql, pivot_wide, resolve, run_metric
from tidemark.sources.catalog import Catalog, Metric, Table, column_role, declared_type

CONFIGS = {
    "fact_tables/sales.yaml": """
name: fct_sales
type: fact
source: sales.csv
columns:
  - {name: sale_id, data_type: int}
  - {name: shopper_id, data_type: int}
  - {name: ts, data_type: timestamp}
  - {name: dim_payment, data_type: str}
  - {name: m_total, data_type: float}
""",
    "dimension_tables/dims.yaml": """
- name: dim_shoppers
  type: dim
  source: shoppers.csv
  columns:
    - {name: shopper_id, data_type: int}
    - {name: dim_region, data_type: str}
""",
    "metrics/metrics.yaml": """
- {name: num_sales, definition: COUNT(sale_id)}
- {name: amount, definition: SUM(m_total)}
""",
}
SALES = "1,1,2023-01-05 00:00:00,cash,10.5\n2,2,2023-01-31 00:00:00,card,2.5\n3,1,2023-02-01 00:00:00,card,4\n4,9,2023-02-28 12:00:00,cash,1\n5,2,2023-03-01 00:00:00,cash,7\n6,2,2023-03-01 00:00:01,cash,7\n"


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    for name, text in CONFIGS.items():
        path = root / "configs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "sales.csv").write_text(SALES)
    (root / "shoppers.csv").write_text("1,NA\n2,EU\n")
    return Catalog.from_folder(spark, str(root / "configs"), str(root))


def test_roles_and_types(spark):
    assert [column_role(c) for c in ("x_id", "dim_x", "m_x", "ts", "x", "dim_x_id")] == ["key", "dimension", "measure", "timestamp", None, "key"]
    assert declared_type("float").simpleString() == "float" and declared_type("decimal(10,2)").simpleString() == "decimal(10,2)"
    with pytest.raises(ValueError):
        declared_type("no_such_type")


def test_table_checks(spark):
    no_ts = spark.createDataFrame([(1, 2.0)], "a_id int, m_x double")
    with pytest.raises(ValueError):
        Table.from_frame("f", "fact", no_ts)
    with pytest.raises(ValueError):
        Table.from_frame("d", "dim", spark.createDataFrame([(1, 2)], "a_id int, b_id int"))
    doubled = Table.from_frame("d", "dim", spark.createDataFrame([(1, "x"), (1, "y")], "a_id int, dim_n string"))
    assert doubled.duplicate_keys(spark).count() == 1


def test_monthly_count_includes_end_midnight_only(catalog):
    got = run_metric(catalog, "num_sales", QuerySpec("MONTH", "2023-01-01", "2023-03-01")).toPandas()
    assert got["num_sales"].tolist() == [2, 2, 1]


def test_groupings_keep_unmatched_facts(catalog):
    got = metric_query(catalog, "amount", QuerySpec("year", "2023-01-01", "2024-01-01", ["dim_region", "dim_payment"])).toPandas()
    cells = {(r.dim_region, r.dim_payment): r.amount for r in got.itertuples()}
    assert cells == {("NA", "cash"): 10.5, ("EU", "card"): 2.5, ("NA", "card"): 4.0, (None, "cash"): 1.0, ("EU", "cash"): 14.0}


def test_plan_and_text_agree(catalog):
    catalog.register_views()
    for groups, filters in (([], []), (["dim_payment"], []), (["dim_region"], ["dim_payment = 'cash'"]), ([], ["dim_region = 'EU'"])):
        spec = QuerySpec("month", "2023-01-01", "2023-12-31", groups, filters)
        assert same_rows(metric_query(catalog, "amount", spec), catalog.spark.sql(metric_sql(catalog, "amount", spec)))


def test_only_needed_dimensions_are_joined(catalog):
    assert resolve(catalog, "COUNT(sale_id)", QuerySpec("day", "2023-01-01", "2023-01-02", ["shopper_id"])).joins == []
    joins = resolve(catalog, "COUNT(sale_id)", QuerySpec("day", "2023-01-01", "2023-01-02", ["dim_region"])).joins
    assert [t.name for t, _ in joins] == ["dim_shoppers"]


def test_errors(catalog, spark):
    with pytest.raises(KeyError):
        catalog.metric("nothing")
    with pytest.raises(ValueError):
        metric_query(catalog, "amount", QuerySpec("month", "2023-01-01", "2023-12-31", ["dim_unknown"]))
    with pytest.raises(ValueError):
        QuerySpec("fortnight", "2023-01-01", "2023-12-31")
    two = Catalog(spark, [Table.from_frame(n, "fact", spark.createDataFrame([(1, pd.Timestamp("2023-01-01").to_pydatetime())], "a_id int, ts timestamp")) for n in "fg"], [Metric("n", "COUNT(a_id)")])
    with pytest.raises(ValueError):
        metric_query(two, "n", QuerySpec("month", "2023-01-01", "2023-12-31"))


def test_filter_reaches_the_scan(catalog):
    plan = metric_query(catalog, "amount", QuerySpec("month", "2023-01-01", "2023-12-31", ["dim_region"]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "dim_payment" not in plan.split("FileScan")[1]


def test_spec_json():
    spec = MetricSpec("amount", "hour", ["dim_region"], ["m_total > 1"])
    assert MetricSpec.from_json(spec.to_json()) == spec


def test_complete_entities_and_pivot(spark):
    df = spark.createDataFrame([("t1", "a", 1.0), ("t1", "a", 3.0), ("t2", "b", 5.0), ("t3", None, 9.0)], "time string, e string, v double")
    got = {(r.time, r.e): r.v for r in complete_entities(df, "v", ["e"]).collect()}
    assert got == {("t1", "a"): 2.0, ("t1", "b"): 0.0, ("t2", "a"): 0.0, ("t2", "b"): 5.0}
    wide = pivot_wide(df.where("e is not null"), "time", "e", "v", ["a", "b"]).orderBy("time").toPandas()
    assert wide["a"].tolist() == [2.0, 0.0] and wide["b"].tolist() == [0.0, 5.0]
    assert isinstance(F.col("x"), type(F.lit(1)))
