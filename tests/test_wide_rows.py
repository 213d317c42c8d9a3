"""What wide rows must not pay for."""

import glob
import random
import re

from slatewise.functions.groups import Rank, within
from slatewise.operators import listwise as L
from slatewise.operators import row_features as R
from slatewise.plans.queries_features import listwise_frame
from slatewise.plans.registry import tables
from slatewise.sources.impressions import write_features


def test_windows_sort_few_times_and_before_rows_are_wide(spark, sf):
    t = tables(spark, sf)
    name, before = "spark.sql.debug.maxToStringFields", spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set(name, "1000")
    try:
        plan = listwise_frame(t)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert len(re.findall(r"\bSort \[", plan)) <= 9  # one for the statistics, one for each ranked column
    below = plan[plan.index("Window ["):]
    assert "price_per_night" not in below and "has_distance" not in below


def test_listwise_columns_do_not_depend_on_the_order_of_steps(spark, sf):
    t = tables(spark, sf)
    got, want = listwise_frame(t), L.add_listwise(R.apply(t.labelled, R.ROW_STEPS))
    assert got.columns == want.columns
    a, b = (x.toPandas().set_index(["srch_id", "prop_id"]).sort_index() for x in (got, want))
    assert a.equals(b)


def test_average_places_from_a_falling_order(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i % 40, i, rng.choice([None, 0.0, 1.5, 2.0, float("nan"), -3.0])) for i in range(900)], "srch_id long, prop_id long, v double")
    average = Rank("a", "v", method="average", pct=True)
    both = within(df, ["srch_id"], [Rank("r", "v", True), average]).orderBy("prop_id").select("a").toPandas()
    alone = within(df, ["srch_id"], [average]).orderBy("prop_id").select("a").toPandas()
    assert both.equals(alone)


def test_feature_cache_is_packed(spark, tmp_path):
    write_features(spark.range(10).selectExpr("id as srch_id", "rand(1) as x"), f"{tmp_path}/f", "train")
    assert glob.glob(f"{tmp_path}/f/split=train/*.zstd.parquet")
