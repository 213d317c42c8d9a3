"""Edge cases and invariants of the operators."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slatewise.functions.exprs import clip, finite, label, ratio
from slatewise.operators import drift as DR
from slatewise.operators import encodings as E
from slatewise.operators import fusion as FU
from slatewise.operators import importance as IM
from slatewise.operators import listwise as L
from slatewise.operators import metrics as M
from slatewise.operators import propensity as P
from slatewise.operators import row_features as R
from slatewise.operators import selection as S
from slatewise.operators import splits as SP
from slatewise.operators import weights as WT
from slatewise.plans.registry import tables
from slatewise.sources import results
from slatewise.sources.ranked import check_ranked
from slatewise.session import shared_dir


@pytest.fixture(scope="module")
def lab(spark, sf):
    return tables(spark, sf).labelled


def test_safe_expressions(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (float("nan"), 1.0)], "a double, b double")
    got = df.select(ratio("a", "b").alias("r"), clip("a", 0.0, 0.5).alias("c"), finite("a").alias("f")).collect()
    assert [tuple(r)[0] for r in got[:2]] == [None, None]
    assert got[0]["c"] == 0.5 and got[1]["c"] is None
    assert got[2]["f"] is None


def test_competitors_all_missing(spark, lab):
    blank = lab.withColumns({f"comp{i}_{s}": F.lit(None).cast("double") for i in range(1, 9) for s in ("rate", "inv", "rate_percent_diff")})
    r = R.competitors(blank).select("comp_rate_sum", "comp_rate_count", "comp_rate_pct_mean", "comp_rate_pct_min").first()
    assert tuple(r) == (0, 0, None, None)


def test_constant_price_slate(spark, lab):
    one = lab.withColumn("price_usd", F.lit(10.0))
    r = L.add_listwise(R.apply(one, R.ROW_STEPS)).agg(F.max(F.abs("price_z_score")), F.min("is_cheapest"), F.max("price_rank")).first()
    assert tuple(r) == (0.0, 1, 1)


def test_ndcg_by_hand(spark):
    rows = [(1, 1, 0.9, 0), (1, 2, 0.8, 5), (1, 3, 0.7, 1), (2, 1, 0.5, 0), (2, 2, 0.5, 0), (3, 7, 0.1, 5), (3, 4, 0.1, 0)]
    df = spark.createDataFrame(rows, "srch_id long, prop_id long, score double, relevance int")
    per = {r["srch_id"]: r for r in M.per_search_metrics(df).collect()}
    dcg, ideal = 5 / np.log2(3) + 1 / np.log2(4), 5 + 1 / np.log2(3)
    assert per[1]["ndcg"] == pytest.approx(dcg / ideal)
    assert per[2]["ndcg"] == 0 and per[2]["booked_rank"] is None
    assert per[3]["booked_rank"] == 2  # the tie goes to the smaller item id
    s = M.summarise(M.per_search_metrics(df)).first()
    assert (s["n_queries"], s["n_booked"], s["recall1"], s["recall5"]) == (3, 2, 0.0, 1.0)


def test_ideal_order_scores_one(lab):
    per = M.per_search_metrics(lab.withColumn("score", F.col("relevance")))
    got = per.groupBy((F.col("n_fives") + F.col("n_ones") > 0).alias("positive")).agg(F.min("ndcg"), F.max("ndcg")).collect()
    for r in got:
        assert r[1] == pytest.approx(1.0 if r["positive"] else 0.0) and r[2] == pytest.approx(r[1])


def test_row_order_does_not_matter(lab):
    a = M.ranking_metrics(lab.withColumn("score", F.col("prop_location_score1"))).first()
    b = M.ranking_metrics(lab.orderBy(F.rand(3)).withColumn("score", F.col("prop_location_score1"))).first()
    assert a["ndcg5"] == pytest.approx(b["ndcg5"]) and a["n_booked"] == b["n_booked"]


def test_own_search_never_feeds_its_encoding(lab):
    rates = [(["prop_id"], [E.Rate("r", "click_bool", 30), E.Std("s", "price_usd"), E.Count("c", "price_usd")])]
    before = E.encode_many(lab, rates)
    target = lab.agg(F.min("srch_id")).first()[0]
    changed = lab.withColumn("price_usd", F.when(F.col("srch_id") == target, F.col("price_usd") * 7).otherwise(F.col("price_usd")))
    after = E.encode_many(changed, rates)
    pick = lambda d: sorted(tuple(r) for r in d.where(F.col("srch_id") == target).select("prop_id", "r", "s", "c").collect())
    assert pick(before) == pick(after)


def test_encoding_of_unseen_keys_and_constants(spark):
    rows = [(s, 1, float(s % 2), 5.0) for s in range(20)] + [(99, 2, 1.0, 8.0)]
    df = spark.createDataFrame(rows, "srch_id long, prop_id long, y double, v double")
    out = E.encode_oof(df, ["prop_id"], [E.Rate("r", "y", 10), E.Std("s", "v", 0.0), E.Count("n", "v"), E.Mean("m", "v", fallback=-1.0)])
    lone = out.where("prop_id = 2").first()
    assert lone["r"] == pytest.approx(df.agg(F.avg("y")).first()[0])
    assert (lone["s"], lone["n"], lone["m"]) == (0.0, 0, -1.0)
    assert out.where("prop_id = 1").agg(F.max("s")).first()[0] == 0.0  # exactly, no rounding residue
    new = spark.createDataFrame([(1, 77)], "srch_id long, prop_id long")
    assert E.encode_from(df, new, ["prop_id"], [E.Count("n", "v")]).first()["n"] == 0


def test_oof_equals_refitting_per_fold(lab):
    pdf = E.encode_oof(lab.withColumn("fold", E.fold_of()), ["prop_id"], [E.Std("s", "price_usd"), E.Rate("r", "click_bool", 30)]).select(
        "srch_id", "prop_id", "price_usd", "click_bool", "fold", "s", "r").toPandas()
    mu = pdf.click_bool.mean()
    for f in range(5):
        rest, own = pdf[pdf.fold != f], pdf[pdf.fold == f]
        std = own.prop_id.map(rest.groupby("prop_id").price_usd.std()).fillna(0)
        g = rest.groupby("prop_id").click_bool.agg(["sum", "count"])
        rate = own.prop_id.map((g["sum"] + 30 * mu) / (g["count"] + 30)).fillna(mu)
        np.testing.assert_allclose(own.s, std, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(own.r, rate)


def test_zero_click_positions_weigh_one(spark):
    rows = [(1, 1, 1, 1, 0), (1, 2, 2, 0, 0), (2, 1, 1, 1, 1), (2, 2, 2, 0, 1), (3, 1, 1, 0, 1), (3, 2, 3, 0, 0)]
    df = spark.createDataFrame(rows, "srch_id long, prop_id long, position int, click_bool int, random_bool int")
    w = {(r["srch_id"], r["prop_id"]): r["weight"] for r in WT.ipw(df, P.propensity(df)).collect()}
    assert w[(1, 1)] == 1.0 and w[(1, 2)] == 1.0 and w[(3, 2)] == 1.0 and w[(2, 1)] == 1.0


def test_importance_weights_average_one(lab):
    w = WT.importance_weights(lab.withColumn("p", F.col("prop_id") % 90 / 91.0), "p")
    assert w.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_curve_fit_recovers_parameters(spark):
    rows = []
    for pos in range(1, 21):
        n = 4000
        hits = round(n * 0.6 / (pos + 3.5))
        rows += [(pos, 1, 1, hits), (pos, 0, 1, n - hits)]
    df = spark.createDataFrame(rows, "position int, click_bool int, random_bool int, k int").select(
        "position", "click_bool", "random_bool", F.explode(F.sequence(F.lit(1), "k")))
    fit = P.fit_propensity_curve(df).first()
    assert fit["a"] == pytest.approx(0.6, rel=0.02) and fit["b"] == pytest.approx(3.5, rel=0.05)


def test_temporal_split_ties_and_checks(spark):
    rows = [(s, 1, f"2020-01-{1 + s // 4:02d} 00:00:00") for s in range(10)]
    df = spark.createDataFrame(rows, "srch_id long, prop_id long, d string").withColumn("date_time", F.to_timestamp_ntz("d"))
    train, val, cutoff = SP.split_temporal(df)
    assert {r["srch_id"] for r in train.collect()} == set(range(8))
    assert SP.check_split(train, val, df).first()["ok"] == 1
    assert SP.check_split(train, val.where("srch_id < 9"), df).first()["in_neither"] == 1
    early = SP.split_temporal(df, 0.5)[0]
    assert {r["srch_id"] for r in early.collect()} == set(range(5))  # the cut falls inside a tie


def test_one_member_fusion_is_that_member(spark, sf):
    t = tables(spark, sf)
    ranks = FU.member_ranks(t.predictions, ["m2"])
    fused = FU.equal_average(t.predictions, ["m2"], ranks).join(
        FU.grouped_rank(t.predictions.where("model_id = 'm2'")), ["srch_id", "prop_id"])
    assert fused.where("fused <> rank").count() == 0


def test_base_plus_bounds():
    assert FU.base_plus("b", {"x": 0.2}) == {"b": 0.8, "x": 0.2}
    with pytest.raises(ValueError):
        FU.base_plus("b", {"x": 0.6})
    assert len(FU.product_grid("b", ["x", "y", "z"], (0.05, 0.1), 0.25)) == 7


def test_feature_filters():
    cols = ["comp_rate_sum", "is_cheapest", "price_usd", "prop_avg_position", "cpair_book_rate"]
    audit = [(c, "raw") for c in ("price_usd", "is_cheapest", "comp_rate_sum", "cpair_book_rate", "prop_avg_position")]
    assert S.filter_features(cols, S.Top(2), audit) == ["is_cheapest", "price_usd"]
    assert S.filter_features(cols, "drop_competitor") == cols[1:]
    assert S.filter_features(cols, "triple_debias") == cols[:3]
    assert S.filter_features(cols, S.DropLowest(0.4), audit) == cols[:3]


def test_output_checks_find_faults(spark):
    sample = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "srch_id long, prop_id long")
    bad = spark.createDataFrame([(1, 1), (1, 1), (1, None)], "srch_id long, prop_id long")
    r = check_ranked(bad, sample).first()
    assert (r["duplicates"], r["null_ids"], r["missing_searches"], r["ok"]) == (1, 1, 1, 0)


def test_append_twice_changes_nothing(spark):
    path = f"{shared_dir(spark)}/append_twice"
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    results.append_new(spark, path, rows, ["k"])
    assert results.append_new(spark, path, rows, ["k"]).count() == 2


def test_label_values(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "click_bool int, booking_bool int")
    assert [r[0] for r in df.select(label()).collect()] == [0, 1, 5]


def test_hot_search_gives_the_same_metrics(spark, lab, monkeypatch):
    from slatewise.functions import groups as G
    df = lab.select("srch_id", "prop_id", "relevance", F.col("prop_location_score1").alias("score"))
    want = M.ranking_metrics(df).first()
    plain = spark.createDataFrame(df.toPandas()).select(F.col("srch_id"), "prop_id", "relevance", "score")
    monkeypatch.setattr(G, "WINDOW_LIMIT", 22)  # many slates are larger: they take the other way
    got = M.ranking_metrics(plain).first()
    assert got["ndcg5"] == pytest.approx(want["ndcg5"]) and got["mean_booked_rank"] == pytest.approx(want["mean_booked_rank"])


def test_kept_encodings_are_not_fitted_again(lab):
    groups = [(["prop_id"], [E.Rate("r", "click_bool", 30)])]
    E.encode_many(lab, groups)
    stored = E.fitted(lab, groups).path
    assert E.fitted(lab, groups).path == stored and len([e for e in E._kept if e[3].path == stored]) == 1
    assert E.fitted(lab.where("prop_id > 3"), groups).path != stored
    assert E.fitted(lab, groups, salt="other").path != stored
    val = E.encode_many(lab.limit(10), groups, lab)
    assert val.count() == 10 and E.fitted(lab, groups).path == stored


def test_blind_view_of_a_fold_without_the_key(spark):
    rows = [(s, s % 3, float(s % 2)) for s in range(30)]
    df = spark.createDataFrame(rows, "srch_id long, prop_id long, y double")
    other = spark.createDataFrame([(1000 + s, s % 4) for s in range(40)], "srch_id long, prop_id long")
    out = E.encode_many(other.withColumn("fold", E.fold_of()), [(["prop_id"], [E.Sum("n", "count(y)"), E.Sum("s", "sum(y)")])], df, blind=True).collect()
    folds = {r.srch_id: r.fold for r in df.withColumn("fold", E.fold_of()).collect()}
    for r in out:
        seen = [y for s, p, y in rows if p == r.prop_id and folds[s] != r.fold]
        assert (r.n, r.s) == (len(seen), sum(seen))


def _no_drift(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.randint(1, 2), rng.random(), rng.randint(0, 1)) for s in range(400) for i in range(5)]
    df = spark.createDataFrame(rows, "srch_id long, prop_id long, kind long, x double, y long")
    return df.where("srch_id < 200"), df.where("srch_id >= 200")


def test_drift_is_not_seen_where_there_is_none(spark):
    """A key of two values: encodings that are made alike tell nothing, those of all rows on one side give the side away."""
    train, test = _no_drift(spark)
    groups = [(["kind"], [E.Rate("r", "y", 1)])]
    blind = [E.encode_many(train, groups, blind=True), E.encode_many(test, groups, train, blind=True)]
    plain = [E.encode_many(train, groups), E.encode_many(test, groups, train)]
    found = [DR.adversarial_auc(DR.cross_fitted(*pair, ["r", "x"], trees=8, depth=4)[0]).first() for pair in (blind, plain)]
    assert found[0]["auc"] < 0.55 and found[0]["band"] == "none"
    assert found[1]["auc"] > 0.9 and found[1]["band"] == "strong"
    assert found[0]["n_pos"] + found[0]["n_neg"] == 2000  # every row has a p


def test_a_useless_column_gains_nothing(spark):
    train, test = _no_drift(spark)
    moved = test.withColumn("x", F.col("x") + 0.5)
    _, gains = DR.cross_fitted(train, moved, ["x", "kind", "y"], trees=8, depth=4)
    gain = {r.feature: r.gain for r in gains.groupBy("feature").agg(F.avg("gain").alias("gain")).collect()}
    assert gain["x"] > 0.1 and abs(gain["kind"]) < 0.02 and abs(gain["y"]) < 0.02
    audit = IM.audit(gains, lambda c: "moved" if c == "x" else "still")
    places = S.Audit.from_table(audit)
    assert places.places["x"] == 0 and S.filter_features(["x", "kind", "y"], S.Top(1), places) == ["x"]
    assert S.filter_features(["x", "kind", "y"], S.KeepGroups(("moved",)), places) == ["x"]


def test_exchanged_values_are_those_of_other_rows(spark):
    df = spark.range(5000).selectExpr("id as srch_id", "id as prop_id", "cast(id as double) as x", "0.0 as y")
    pairs = IM.exchanged(df, ["x"], "y", ["srch_id", "prop_id"], rows=None).selectExpr("x[0] as x", "z[0] as z").collect()
    assert sorted(r.x for r in pairs) == sorted(r.z for r in pairs) == list(range(5000))
    assert all(r.x != r.z for r in pairs)


@pytest.mark.parametrize("rows, pairs", [(20_000, 50_000), (7, 5)])
def test_trials_score_as_single_rankings(spark, monkeypatch, rows, pairs):
    """Ties, missing values, missing arrays and slates without a positive; also in steps of a few rows."""
    monkeypatch.setattr(FU, "BLOCK_ROWS", rows)
    monkeypatch.setattr(FU, "BLOCK_PAIRS", pairs)
    rng = random.Random(9)
    cell = lambda: rng.choice([None, 1.0, 2.0, 3.0])
    data = [(s, i, rng.choice([0, 0, 0, 1, 5]) if s % 5 else 0, [cell(), cell()] if rng.random() < 0.95 else None) for s in range(40) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(data, "srch_id long, prop_id long, relevance int, r array<double>")
    trials = {"a": {"m": 1.0}, "b": {"n": 2.0}, "ab": {"m": 1.0, "n": 3.0}}
    for ascending in (True, False):
        found = {r.trial: r for r in FU.score_trials(df, ["m", "n"], trials, ascending=ascending).collect()}
        for name, w in trials.items():
            total = sum(w.values())
            score = sum((F.col("r")[i] * (w[m] / total) for i, m in enumerate(["m", "n"]) if m in w), F.lit(0.0))
            want = M.ranking_metrics(df.withColumn("score", score), ascending=ascending).first()
            assert found[name]["ndcg5"] == pytest.approx(want["ndcg5"]) and found[name]["n_queries"] == want["n_queries"] == 40
            assert found[name]["n_booked"] == want["n_booked"] and found[name]["mean_booked_rank"] == pytest.approx(want["mean_booked_rank"])
            assert found[name]["recall5"] == pytest.approx(want["recall5"]) and found[name]["recall1"] == pytest.approx(want["recall1"])


def test_writers_at_the_same_time_lose_and_double_nothing(spark, tmp_path, monkeypatch):
    """A second writer commits between the read and the commit of the first, which has to start again."""
    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "k string, v int")

    def interleave(other):
        real, calls = results.TableLog.create, []

        def create(self, number, folders):
            if not calls:
                calls.append(number)
                other()
            return real(self, number, folders)

        monkeypatch.setattr(results.TableLog, "create", create)
        return real

    path = str(tmp_path / "table")
    real = interleave(lambda: results.append_new(spark, path, rows(("a", 1), ("b", 1)), ["k"]))
    results.append_new(spark, path, rows(("b", 2), ("c", 2)), ["k"])
    monkeypatch.setattr(results.TableLog, "create", real)
    assert sorted(map(tuple, results.read_table(spark, path).collect())) == [("a", 1), ("b", 1), ("c", 2)]
    reader = results.read_table(spark, path)
    real = interleave(lambda: results.upsert(spark, path, rows(("a", 3)), ["k"]))
    results.upsert(spark, path, rows(("b", 4)), ["k"])
    monkeypatch.setattr(results.TableLog, "create", real)
    assert sorted(map(tuple, results.read_table(spark, path).collect())) == [("a", 3), ("b", 4), ("c", 2)]
    assert reader.count() == 3  # an older version stays readable
    assert results.TableLog(spark, path).last()[0] == 4 and not results.TableLog(spark, path).create(4, ["x"])
    results.append_new(spark, path, rows(("a", 9)), ["k"])
    assert results.TableLog(spark, path).last()[0] == 4  # nothing new, no version
    results.replace_table(spark, rows(("z", 1)), path)
    assert results.vacuum(spark, path, keep=1) >= 2 and [tuple(r) for r in results.read_table(spark, path).collect()] == [("z", 1)]


@pytest.mark.parametrize("n", [0, 1, 37, 2000, 4999, 5000, 6000])
def test_sample_of_n_rows_by_selection(spark, n):
    df = spark.range(5000).selectExpr("id as srch_id", "id % 7 as prop_id")
    h = F.md5(F.concat_ws("|", F.col("srch_id").cast("string"), F.col("prop_id").cast("string"), F.lit("rows")))
    want = sorted(r.srch_id for r in df.orderBy(h).limit(n).collect())
    assert sorted(r.srch_id for r in SP.sample_n_rows(df, n).collect()) == want


def test_missing_correlation_plan_grows_with_columns(spark):
    """The plan of all pairs took the driver's memory."""
    from slatewise.operators.eda import missing_correlation

    def plan(n):
        df = spark.range(50).select(*[F.when(F.col("id") % (i + 2) != 0, F.col("id")).alias(f"c{i:02d}") for i in range(n)])
        out = missing_correlation(df, df.columns)
        spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
        text = out._jdf.queryExecution().analyzed().toString()
        spark.conf.unset("spark.sql.debug.maxToStringFields")
        return out, len(text)

    (_, few), (out, many) = plan(10), plan(40)
    assert many < 6 * few
    assert out.count() == 40 * 39 // 2
    gone = {i: [float(x % (i + 2) == 0) for x in range(50)] for i in (0, 3)}
    found = out.where("a = 'c00' AND b = 'c03'").first()["corr"]
    assert abs(found - np.corrcoef(gone[0], gone[3])[0, 1]) < 1e-9


def test_large_views_are_not_broadcast(lab, monkeypatch):
    """Small files of many rows were sent to the driver."""
    groups = [(("prop_id",), (E.Rate("a", "click_bool", 30), E.Std("s", "price_usd"))), (("site_id",), (E.Rate("d", "booking_bool", 50),)),
              (("prop_id", "site_id"), (E.Rate("c", "booking_bool", 15),))]
    plain = E.encode_many(lab, groups, salt="w")
    monkeypatch.setattr(E, "_broadcast_limit", lambda spark: 2000)
    wide = E.encode_many(lab, groups, salt="w")
    assert wide.columns == plain.columns
    assert not wide.exceptAll(plain).count() and not plain.exceptAll(wide).count()
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 1


def test_price_premium_reads_no_other_encoding(spark, sf):
    """The premium joined every encoding, twice."""
    from slatewise.plans.registry import QUERIES

    run = next(q for q in QUERIES if q.name == "f12_price_premium_window").frame
    plan = run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_failure_queries_store_no_wide_table(spark, sf):
    """Every failure query wrote the slates with all encodings and listwise columns first."""
    from slatewise.plans.registry import QUERIES

    run = {q.name: q.frame for q in QUERIES}
    for name in ("d16_failure_pairs", "d17_segments", "d25_winner_shares", "d26_hard_negatives", "d27_easy_wins_missed", "d29_difficulty"):
        files = run[name](spark, sf).inputFiles()
        assert files and not [f for f in files if "/context_" in f]
        if name not in ("d17_segments",):
            assert not [f for f in files if "/encodings-" in f]
