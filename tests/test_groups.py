"""Ranks, statistics and quantiles: both ways of computing them against pandas."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slatewise.functions import groups as G
from slatewise.functions import stats as S

METHODS = [("min", False, False), ("min", True, False), ("average", True, False), ("average", False, True)]


def skewed(spark, n=600, seed=1):
    """A third of the rows in one group, many ties and missing values."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 60, n))
    pdf = pd.DataFrame({"srch_id": key, "prop_id": np.arange(n), "v": np.round(rng.normal(size=n), 1)})
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    rows = [(int(a), int(b), None if np.isnan(c) else float(c)) for a, b, c in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "srch_id long, prop_id long, v double")


@pytest.mark.parametrize("limit", [G.WINDOW_LIMIT, 50], ids=["windows", "hot group split"])
@pytest.mark.parametrize("small", [None, False], ids=["small counts", "sliced"])
def test_within_equals_pandas(spark, limit, small, monkeypatch):
    pdf, df = skewed(spark)
    if small is False:
        monkeypatch.setattr(G, "value_counts", _never_small(G.value_counts))
    ranks = [G.Rank(f"r{i}", "v", d, m, p) for i, (m, d, p) in enumerate(METHODS)]
    ranks.append(G.Rank("place", "v", True, "first"))
    stats = [G.Stat("n", F.count("v")), G.Stat("mean", F.avg("v")), G.Stat("mid", median="v")]
    got = G.within(df, ["srch_id"], ranks, stats, limit=limit).toPandas().sort_values("prop_id").reset_index(drop=True)
    g = pdf.groupby("srch_id")["v"]
    for i, (m, d, p) in enumerate(METHODS):
        pd.testing.assert_series_equal(got[f"r{i}"].astype(float), g.rank(method=m, ascending=not d, pct=p), check_names=False)
    order = pdf.assign(k=-pdf.v).sort_values(["srch_id", "k", "prop_id"], na_position="last")
    place = order.groupby("srch_id").cumcount().add(1).sort_index()
    assert (got["place"].to_numpy() == place.to_numpy()).all()
    np.testing.assert_allclose(got["mean"], g.transform("mean"))
    np.testing.assert_allclose(got["mid"], g.transform("median"))
    assert len(got) == len(pdf)


def _never_small(fn):
    return lambda *a, **k: (fn(*a, **k)[0], False)


@pytest.mark.parametrize("small", [True, False])
def test_quantiles_equal_numpy(spark, small):
    pdf, df = skewed(spark, seed=3)
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = G.quantiles(df, "v", probs, small=small).first()["q"]
    np.testing.assert_allclose(got, pdf.v.quantile(probs), atol=1e-12)
    by = {r["srch_id"]: r["q"] for r in G.quantiles(df, "v", probs, ["srch_id"], small=small).collect()}
    for key, part in pdf.dropna().groupby("srch_id"):
        np.testing.assert_allclose(by[key], part.v.quantile(probs), atol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40))
def test_sliced_ranks_do_not_depend_on_slices(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["v"]: r["_before"] for r in G.value_ranks(df, "v", slices=3, small=False).collect()}
    assert got == {float(v): sum(x < v for x in values) for v in values}


def test_size_note_follows_the_table(spark):
    _, df = skewed(spark)
    noted = G.note_group_size(df, "srch_id")
    later = noted.where("v > 0").select("srch_id", "v").withColumn("w", F.lit(1))
    assert G.hot_groups(later, ["srch_id"]) is None
    assert later.schema["srch_id"].metadata["largest_group"] > 100


def test_spearman_auc_ks(spark):
    pdf, df = skewed(spark, seed=5)
    df = df.withColumn("y", F.col("prop_id") % 7).withColumn("one", F.lit(1))
    p = pdf.dropna().assign(y=lambda d: d.prop_id % 7)
    rho = S.spearman(df, ["v", "one"], ["y"]).toPandas().set_index("feature")
    assert rho.rho["v"] == pytest.approx(p.v.rank().corr(p.y.rank()))
    assert pd.isna(rho.rho["one"])
    label = (p.y > 3).astype(int)
    wins = sum((a > p.v[label == 0]).sum() + 0.5 * (a == p.v[label == 0]).sum() for a in p.v[label == 1])
    got = S.auc(df.where("v IS NOT NULL").withColumn("m", (F.col("y") > 3).cast("int")), "v", "m").first()
    assert got["auc"] == pytest.approx(wins / (label.sum() * (1 - label).sum()))
    left, right = df.where("y < 3"), df.where("y >= 3")
    a, b = np.sort(p.v[p.y < 3]), np.sort(p.v[p.y >= 3])
    grid = np.unique(p.v)
    want = max(abs(np.searchsorted(a, x, "right") / len(a) - np.searchsorted(b, x, "right") / len(b)) for x in grid)
    assert S.ks_two_sample(left, right, ["v"]).first()["ks"] == pytest.approx(want)


def test_spearman_matrix_stores_values_not_pairs(spark, monkeypatch):
    n = np.arange(600)
    pdf = pd.DataFrame({"a": n % 20, "b": n * 7 % 31, "c": n * n % 37, "d": n % 3}).astype(float)
    pdf.loc[n % 5 == 0, "c"] = np.nan
    pdf.loc[n % 11 == 0, "d"] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in r) for r in pdf.itertuples(index=False)], "a double, b double, c double, d double")
    stored = []
    for module in (G, S):
        if hasattr(module, "materialise"):
            keep = module.materialise
            monkeypatch.setattr(module, "materialise", lambda t, name, keep=keep: stored.append(keep(t, name)) or stored[-1])
    got = S.spearman_matrix(df, list("abcd")).toPandas().set_index(["a", "b"])
    want = pdf.corr("spearman")
    for (x, y), row in got.iterrows():
        assert row.rho == pytest.approx(want.loc[x, y]) and row.n == (pdf[x].notna() & pdf[y].notna()).sum()
    assert len(got) == 12
    # distinct values for each of three sets of rows, not the hundreds of pairs of values of each two columns
    assert max(t.count() for t in stored) <= 3 * sum(pdf[c].nunique() for c in "abcd")


def test_bins_are_right_closed_with_lowest(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 0, 0, 1, 2, 3, 4, 4, 4, 9]], "v double")
    got = S.quantile_bins(df, "v", 4).toPandas()
    want = pd.qcut(got.v, 4, duplicates="drop", labels=False) + 1
    assert got.bin.tolist() == want.tolist()


def test_both_ways_agree_on_repeated_ties_and_null_keys(spark):
    rows = [(k, v, i % 3 if i % 5 else None) for k in (1, 2, None) for i, v in enumerate([3.0, 3.0, 1.0, None, 3.0, 1.0, None, 2.0])] * 2
    df = spark.createDataFrame(rows, "srch_id long, v double, prop_id long")
    ranks = [G.Rank("first", "v", method="first"), G.Rank("least", "v"), G.Rank("mean", "v", desc=True, method="average", pct=True)]
    stats = [G.Stat("n", F.count(F.lit(1))), G.Stat("mid", median="v")]
    ways = [sorted(map(tuple, G.within(df, ["srch_id"], ranks, stats, limit=n).collect()), key=repr) for n in (1000, 3)]
    assert ways[0] == ways[1] and len(ways[0]) == len(rows)
    assert G.hot_groups(df, ["srch_id"], 3).count() == 3


def test_average_rank_needs_one_order(spark):
    """Equal values were counted in an order of their own, held beside the first."""
    df = spark.createDataFrame([(1, 10, 2.0), (1, 11, 2.0), (1, 12, 5.0), (1, 13, None), (2, 10, 1.0)], "g long, prop_id long, v double")
    out = G.within(df, ["g"], ranks=[G.Rank("r", "v", method="average", desc=True)], limit=100)
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window [") == 1
    assert [r["r"] for r in out.orderBy("g", "prop_id").collect()] == [2.5, 2.5, 1.0, None, 1.0]
