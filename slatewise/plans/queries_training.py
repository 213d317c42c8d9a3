"""Training queries. Models have no value oracle; the pair table has."""

from pyspark.sql import functions as F

from ..operators import diagnose as D
from ..operators import drift as DR
from ..operators import importance as IM
from ..operators import training as T
from ..operators import weights as WT
from ..operators.metrics import ranking_metrics
from ..operators.selection import FILTERS, Audit, feature_group, filter_features, numeric_features
from ..sources.ranked import check_ranked, ranked_output
from .features import build_features, features_of
from .registry import query

FORM = {"ints": "n_queries n_booked", "nums": "ndcg5 recall5"}
#: Variants are compared by forests: one pass over the rows for each level, in place of one for each level of each tree.
FOREST = {"learner": "forest", "trees": 12, "depth": 5}


def sides(t):
    """Train (out-of-fold) and validation (from train) features with the columns of all variants, written once per session."""
    def build(side):
        def run():
            source = t.memo("weighted_source", lambda: T.weighted_source(t.sides[0]))  # both sides use one fit
            return T.variant_products(features_of(T.all_encodings(source, t.sides[side], own=side == 0)))
        return run
    return t.stored("train_features", build(0)), t.stored("val_features", build(1))


def base(t):
    """Every numeric feature but those that only variants use."""
    extra = {c for added, _ in T.VARIANTS.values() for c in added}
    return [c for c in numeric_features(sides(t)[0]) if c not in extra]


def graded(t):
    """The graded ranker on all features, fitted once per session."""
    return t.memo("graded", lambda: T.fit_graded(sides(t)[0], base(t)))


def pairwise(t):
    return t.memo("pairwise", lambda: T.fit_pairwise(sides(t)[0], base(t)))


def judged(model):
    return lambda t: ranking_metrics(T.score(model(t), sides(t)[1], base(t)))


query("t1_booking_classifier", judged(lambda t: T.fit_classifier(sides(t)[0], base(t))), **FORM)
query("t1_logistic_classifier", judged(lambda t: T.fit_classifier(sides(t)[0], base(t), "click_bool", kind="logistic")), **FORM)
query("t2_graded_ranker", judged(graded), **FORM)
query("t3_pair_table", lambda t: T.pair_table(t.labelled, ["price_usd", "prop_starrating"]).select(
    "srch_id", "weight", F.col("diff")[0].alias("d_price"), F.col("diff")[1].alias("d_star")), """
WITH i AS (SELECT srch_id, sum(CASE WHEN best <= 5 THEN relevance / log2(best + 1.0) END) AS ideal FROM (
  SELECT *, row_number() OVER (PARTITION BY srch_id ORDER BY relevance DESC) AS best FROM lab) GROUP BY srch_id HAVING sum(relevance) > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY srch_id ORDER BY position, prop_id) AS place FROM lab)
SELECT a.srch_id, abs((CASE WHEN a.place <= 5 THEN 1 / log2(a.place + 1.0) ELSE 0 END - CASE WHEN b.place <= 5 THEN 1 / log2(b.place + 1.0) ELSE 0 END)
    * (a.relevance - b.relevance)) / ideal AS weight,
  a.price_usd - b.price_usd AS d_price, a.prop_starrating - b.prop_starrating AS d_star
FROM p a JOIN p b ON a.srch_id = b.srch_id JOIN i ON i.srch_id = a.srch_id WHERE a.relevance > b.relevance AND (a.place <= 5 OR b.place <= 5)""",
      ints="srch_id", nums="weight d_price d_star")
query("t3_pairwise_ranker", judged(pairwise), **FORM)


def ranker_gains(t):
    """Measured gains of the graded ranker on the validation side, stored."""
    def build():
        val = sides(t)[1].withColumn("gain", T.graded_gain())
        return IM.permutation_gains([("graded", graded(t), val)], base(t), "gain")
    return t.stored("ranker_gains", build)


query("t4_importances", lambda t: T.importance(graded(t), base(t), t.spark), nums="gain", texts="feature")
query("t4_measured_importances", ranker_gains, nums="gain loss", texts="feature")
query("t5_variants", lambda t: T.run_variants(*sides(t), base(t), T.VARIANTS, **FOREST), ints="n_features", nums="ndcg5 delta", texts="variant decision")
query("t6_batch", lambda t: T.run_batch(*sides(t), {
    "graded": {"columns": base(t), "kind": "graded", **FOREST}, "pairwise": {"columns": base(t), "kind": "pairwise"},
    "broken": {"columns": ["no_such_column"], "kind": "graded"}}), nums="ndcg5", texts="run_id status")


def drift_sides(t):
    """All features of both sides, each leaving the fold of its own search out."""
    return (t.stored("blind_train", lambda: build_features(t.sides[0], blind=True)),
            t.stored("blind_val", lambda: build_features(t.sides[1], t.sides[0], blind=True)))


def drift_model(t):
    """The cross-fitted drift classifiers over all features."""
    return t.memo("drift", lambda: DR.drift_models(*drift_sides(t), numeric_features(drift_sides(t)[0])))


def drift_scores(t):
    return t.memo("drift_scores", lambda: drift_model(t).scored())


def drift_gains(t):
    return t.memo("drift_gains", lambda: drift_model(t).gains())


def test_probability(t):
    """p(test) of every training row."""
    return drift_scores(t).where("side = 0").select("srch_id", "prop_id", "p")


def audit_of(t, gains, name):
    return t.stored(f"audit_{name}", lambda: IM.audit(gains, feature_group))


query("d5_cross_fitted_auc", lambda t: DR.adversarial_auc(drift_scores(t)), ints="n_pos n_neg", nums="auc", texts="band")
query("d5_cross_fitted_gains", lambda t: audit_of(t, drift_gains(t), "drift"), nums="gain", texts="feature")
query("d6_cross_fitted_quantiles", lambda t: DR.probability_quantiles(test_probability(t)), nums="p10 p50 p90 p99")
query("w7_cross_fitted_weights", lambda t: WT.importance_weights(test_probability(t), "p"), ints="srch_id prop_id", nums="weight")


def _measured_risk(t):
    drift, ranker = audit_of(t, drift_gains(t), "drift"), audit_of(t, ranker_gains(t), "ranker")
    above = [x.withColumn("gain", F.greatest("gain", F.lit(0.0))) for x in (drift, ranker)]
    return DR.group_risk(*above, drift.select("feature", "group")).withColumnRenamed("group", "feature_group")


query("d7_measured_group_risk", _measured_risk, ints="n_features", nums="adversarial_share ranker_share risk", texts="feature_group")
query("d12_measured_suspects", lambda t: D.leaky_suspects(
    D.position_correlation(sides(t)[0], base(t), top=len(base(t))), audit_of(t, drift_gains(t), "drift"), audit_of(t, ranker_gains(t), "ranker")),
      ints="pos_rank adv_rank ranker_rank", nums="abs_corr", texts="feature")
query("d32_measured_importances", lambda t: D.importance_aggregate(
    drift_gains(t).select("model_id", "feature", F.greatest("gain", F.lit(0.0)).alias("gain"))), ints="n_models rank", nums="median_gain median_share", texts="feature")


def _measured_filters(t):
    """What each feature filter leaves of the model's columns, by the measured audit."""
    audit = Audit.from_table(audit_of(t, ranker_gains(t), "ranker"))
    rows = [(name, len(filter_features(base(t), name, audit))) for name in FILTERS]
    return t.spark.createDataFrame(rows, "filter string, n_features long")


query("w2_measured_filters", _measured_filters, ints="n_features", texts="filter")


def _reweighted(t):
    train, val = sides(t)
    weighted = WT.importance_weights(train.join(test_probability(t), ["srch_id", "prop_id"]), "p", name="w")
    return T.run_spec(weighted, val, base(t), "graded", weight="w", **FOREST)[0]


query("t7_adversarially_weighted", _reweighted, **FORM)
query("t8_position_ablation", lambda t: T.run_variants(*sides(t), base(t), {"with_position": (["position"], ())}, **FOREST),
      ints="n_features", nums="ndcg5 delta", texts="variant")


def _final(t):
    members = {"graded": {"kind": "graded", "columns": base(t), **FOREST}, "pairwise": {"kind": "pairwise", "columns": base(t)}}
    fused = T.final_ranking(*sides(t), members)
    return check_ranked(ranked_output(fused, "fused", ascending=True), sides(t)[1])


query("t9_final_ranking", _final, "SELECT count(*) AS n_rows, count(*) AS n_expected, 0 AS duplicates, 0 AS missing_searches, 1 AS ok FROM va",
      ints="n_rows n_expected duplicates missing_searches ok")
