"""Drift models and measured importance read the rows that they draw, not the whole table again."""

import pytest
from pyspark.sql import functions as F

from slatewise.operators import drift as DR
from slatewise.operators import importance as IM


def test_measured_rows_are_the_first_of_all(spark):
    df = spark.range(40_000).selectExpr("id as srch_id", "id % 7 as prop_id", "cast(id as double) as x", "id % 2 as y")
    draw = IM.draw_of(["srch_id", "prop_id"])
    want = {r.srch_id for r in df.orderBy(draw, "srch_id", "prop_id").limit(500).collect()}
    assert {r.srch_id for r in IM._numbered(df, ["srch_id", "prop_id"], 7, 500).collect()} == want
    reach = IM.lowest_draws(df, draw, 500, "0")[0]
    assert reach.total == 40_000 and 500 <= reach.rows < 600  # so many are ordered


@pytest.mark.parametrize("rows", [50, 10**6])
def test_drift_models_read_drawn_rows_and_score_nothing_for_the_gains(spark, monkeypatch, rows):
    df = spark.range(6000).selectExpr("id div 5 as srch_id", "id as prop_id", "rand(2) as x", "rand(3) as y")
    stored = []
    monkeypatch.setattr(DR, "ROWS", rows)
    monkeypatch.setattr(DR, "materialise", lambda d, name, store=DR.materialise: stored.append((name, store(d, name))) or stored[-1][1])
    found = DR.drift_models(df.where("srch_id < 600"), df.where("srch_id >= 600"), ["x", "y"], trees=3, depth=2, fit_rows=300)
    assert found.gains().count() == 6
    assert [name for name, _ in stored] == ["drift-rows"]  # no scores
    assert stored[0][1].count() < 1500 if rows == 50 else stored[0][1].count() == 6000
    sizes = {r.fold: r["count"] for r in found.measured.groupBy("fold").count().collect()}
    assert all(50 <= n < 70 for n in sizes.values()) if rows == 50 else sum(sizes.values()) == 6000
    assert found.scored().agg(F.count("p")).first()[0] == 6000
