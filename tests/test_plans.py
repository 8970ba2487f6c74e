import datetime as dt

import pytest
from pyspark.sql import functions as F

from prismatica.functions.filter_text import predicate
from prismatica.plans.explore import build
from prismatica.plans.model import Dimension, Explore, Join, Measure, Model, Request, View
from prismatica.queries import MODEL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def tables(spark, sf):
    return lambda n: spark.read.parquet(f"{sf}/{n}.parquet")


def test_year_filter_reaches_the_scan(tables):
    df = build(tables, MODEL, Request("orders", (), ("orders.total_price",), {"orders.ordered_year": "1996"}))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in plan(df) and "LessThan(o_orderdate,1997-01-01" in plan(df)


def test_only_needed_columns_are_read(tables):
    df = build(tables, MODEL, Request("orders", ("orders.o_orderpriority",), ("orders.n_orders",)))
    assert "ReadSchema: struct<o_orderpriority:string>" in plan(df)


def test_unused_unique_joins_are_left_out_and_change_nothing(tables):
    request = Request("order_regions", (), ("orders.total_price", "lineitem.lines"))
    df = build(tables, MODEL, request)
    assert "c_mktsegment" not in plan(df) and plan(df).count("Scan parquet") == 2
    whole = build(tables, MODEL, Request("order_regions", ("region.r_name",), ("orders.total_price", "lineitem.lines")))
    totals = whole.agg(F.sum("total_price"), F.sum("lines")).first()
    one = df.first()
    assert one["lines"] == totals[1] and abs(one["total_price"] - totals[0]) < 1e-3


def test_fan_out_needs_a_key(tables):
    model = Model({**MODEL.views, "orders": View("orders", "orders", dimensions=MODEL.views["orders"].dimensions, measures=MODEL.views["orders"].measures)}, MODEL.explores)
    with pytest.raises(ValueError, match="primary key"):
        build(tables, model, Request("order_lines", ("lineitem.l_returnflag",), ("orders.total_price",)))


def test_fan_out_equals_aggregate_before_the_join(tables):
    orders = tables("orders").join(tables("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    want = orders.groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("t")).collect()
    got = build(tables, MODEL, Request("order_lines", ("orders.o_orderstatus",), ("orders.total_price",))).select("o_orderstatus", F.round("total_price", 2)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_cycles_of_references_are_errors(tables):
    view = View("v", "orders", dimensions=(Dimension("a", "${b}"), Dimension("b", "${a}")), measures=(Measure("n", "count"),))
    with pytest.raises(ValueError, match="refer to each other"):
        build(tables, Model({"v": view}, {"e": Explore("e", "v")}), Request("e", ("v.a",), ("v.n",)))


def test_inner_joins_stay(tables):
    views = {n: MODEL.views[n] for n in ("orders", "customer")}
    explore = Explore("e", "orders", (Join("customer", (("orders.o_custkey", "c_custkey"),), "inner"),))
    assert "c_custkey" in plan(build(tables, Model(views, {"e": explore}), Request("e", (), ("orders.n_orders",))))


@pytest.mark.parametrize(
    ("text", "first", "last"),
    [
        ("last 12 months", "2000-03-01", "2001-02-28"),
        ("last 90 days", "2000-12-01", "2001-02-28"),
        ("last quarter", "2000-10-01", "2000-12-31"),
        ("last month", "2001-01-01", "2001-01-31"),
        ("last year", "2000-01-01", "2000-12-31"),
        ("last week", "2001-02-19", "2001-02-25"),
        ("2000", "2000-01-01", "2000-12-31"),
        ("2000-05-07", "2000-05-07", "2000-05-07"),
    ],
)
def test_periods(spark, text, first, last):
    days = spark.sql("SELECT explode(sequence(DATE '1999-01-01', DATE '2001-12-31')) AS d").select(F.col("d").cast("timestamp_ntz").alias("t"))
    got = days.where(predicate(F.col("t"), text, "time", dt.datetime(2001, 2, 28, 15))).agg(F.min(F.to_date("t")), F.max(F.to_date("t"))).first()
    assert [str(x) for x in got] == [first, last]


def test_relative_periods_need_a_day(spark):
    with pytest.raises(ValueError, match="as_of"):
        predicate(F.lit(None).cast("timestamp_ntz"), "last 3 months", "time")


def test_unreadable_numbers_are_errors():
    from pyspark.sql import functions as F

    for text in ("12a", ">x", "1,two"):
        with pytest.raises(ValueError, match="not a number"):
            predicate(F.col("n"), text, "number")
