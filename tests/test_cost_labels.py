"""Costs are rounded from a double's exact value, as SQL's printf does."""

import duckdb
import pytest
from pyspark.sql import functions as F

from parley.functions import display
from parley.plans import live


@pytest.mark.parametrize(("usd", "want"), [(289_450 / 70_000 - 0.5, "$3.63"), (1.005, "$1.00"), (0.125, "$0.12"), (0.375, "$0.38"), (10.25, "$10.2"), (9.999, "$10.00"), (1_234_567.25, "$1234567.2"), (0.009, "<$0.01"), (0.0, "$0")])
def test_cost_label(spark, usd, want):
    assert spark.createDataFrame([(usd,)], "usd double").select(display.cost_label(F.col("usd"))).first()[0] == want


def test_totals_near_half_a_cent_are_labelled_as_in_sql(spark, tmp_path):
    prices = [(i, float(p)) for i, p in enumerate([289_450, 327_950, *range(35_350, 1_400_000, 350)])]
    spark.createDataFrame(prices, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = base.sql(live.COUNT_LABELS).fetchall()
    assert sorted(map(tuple, live.count_labels(spark, str(tmp_path)).collect())) == sorted(want)
