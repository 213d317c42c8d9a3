"""What queries must not shuffle."""

import re

import pytest

from slatewise.operators import encodings as E
from slatewise.operators import fusion as FU
from slatewise.plans.features import build_features
from slatewise.plans.queries_diagnose import two_rankings
from slatewise.plans.queries_fusion import GRIDS, NAMES, labelled_predictions, slates
from slatewise.plans.queries_tables import member_metrics
from slatewise.plans.registry import QUERIES, tables


def rows_move(df):
    """Whether the plan joins, or deals rows out by search or item."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Join" in plan or re.search(r"hashpartitioning\([^)]*(srch_id|prop_id)", plan) is not None


def test_member_metrics_shuffle_sums_only(spark, sf):
    plan = member_metrics(tables(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    # the rows stay in their buckets: only the sums per member move
    assert not re.search(r"hashpartitioning\([^)]*(srch_id|prop_id)", plan)


@pytest.mark.parametrize("name", ["r14_random_subsets", "r14_random_weights", "r19_mega_bag_and_safe_push", "r16_normalisation_grid_rank",
                                  "r16_normalisation_grid_all", "d10_member_disagreement", "d8_ranking_disagreement"])
def test_searches_stay_in_their_buckets(name, spark, sf):
    assert not rows_move(next(q for q in QUERIES if q.name == name).frame(spark, sf))


def test_several_columns_are_scored_as_each_alone(spark, sf):
    t = tables(spark, sf)
    values = FU.normalised_slates(labelled_predictions(t), NAMES, ["relevance"])
    trials = dict(list(GRIDS.items())[:3])
    both = FU.score_trials(values, NAMES, trials, ["rank_avg", "query_z"], ascending=False).toPandas().set_index(["column", "trial"]).sort_index()
    for c in ("rank_avg", "query_z"):
        one = FU.score_trials(values, NAMES, trials, c, ascending=False).toPandas().set_index("trial").sort_index()
        for k in one.columns:
            assert both.loc[c][k].to_numpy() == pytest.approx(one[k].to_numpy()), (c, k)


def test_normalised_slates_are_the_normalised_scores(spark, sf):
    t = tables(spark, sf)
    long = FU.normalise(t.predictions).toPandas().set_index(["model_id", "srch_id", "prop_id"]).sort_index()
    wide = FU.normalised_slates(t.predictions, NAMES).toPandas().sort_values(["srch_id", "prop_id"])
    for i, m in enumerate(NAMES):
        for c in FU.NORMALISERS:
            assert [x[i] for x in wide[c]] == pytest.approx(long.loc[m][c].to_numpy(), abs=1e-9), (m, c)


def test_stored_ranks_keep_their_buckets(spark, sf):
    t = tables(spark, sf)
    assert slates(t).count() == t.impressions.count()
    plan = two_rankings(t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_wide_rows_are_not_dealt_out_for_large_encodings(spark, sf):
    t = tables(spark, sf)
    want = build_features(t.labelled).toPandas().set_index(["srch_id", "prop_id"]).sort_index()
    now = {"spark.sql.autoBroadcastJoinThreshold": "1k", "spark.sql.debug.maxToStringFields": "1000"}  # every view is a large one
    before = {k: spark.conf.get(k) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        df = build_features(t.labelled)
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        got = df.toPandas().set_index(["srch_id", "prop_id"]).sort_index()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    moved = [below for above, below in zip(plan, plan[1:]) if "Exchange" in above]
    assert moved and not [line for line in moved if "price_usd#" in line or "comp1_rate#" in line]
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in want.columns:
        if want[c].dtype.kind in "fi":
            assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), rel=1e-9, abs=1e-9, nan_ok=True), c

