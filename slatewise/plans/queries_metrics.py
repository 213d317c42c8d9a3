"""Ranking metric queries."""

from pyspark.sql import functions as F

from ..functions.exprs import num
from ..operators import metrics as M
from ..operators.weights import positive_searches
from .registry import query, view

_IDEAL = """list_sum([CASE WHEN fives >= p THEN 5.0 WHEN fives + ones >= p THEN 1.0 ELSE 0.0 END / log2(p + 1)
                     FOR p IN [1, 2, 3, 4, 5]])"""


def slate_sql(source, score, by=""):
    """Per-slate metrics of a table with a score expression, in SQL."""
    b = f"{by}, " if by else ""
    return f"""
SELECT {b}srch_id, count(*) AS n_rows, coalesce(sum(CASE WHEN place <= 5 THEN relevance / log2(place + 1.0) END)
    / nullif(sum(CASE WHEN best <= 5 THEN relevance / log2(best + 1.0) END), 0), 0) AS ndcg,
  min(CASE WHEN relevance = 5 THEN place END) AS booked_rank,
  sum(CASE WHEN relevance > 0 THEN 1 ELSE 0 END) AS positives,
  sum(CASE WHEN relevance > 0 AND place <= 5 THEN 1 ELSE 0 END) AS positives_top5
FROM (SELECT *, row_number() OVER (PARTITION BY {b}srch_id ORDER BY {score} DESC NULLS LAST, prop_id) AS place,
             row_number() OVER (PARTITION BY {b}srch_id ORDER BY relevance DESC, prop_id) AS best FROM {source})
GROUP BY {b}srch_id"""


def summary_sql(source, by=""):
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {b}avg(ndcg) AS ndcg5, coalesce(avg(CASE WHEN booked_rank IS NOT NULL THEN (booked_rank <= 1)::INT END), 0) AS recall1,
  coalesce(avg(CASE WHEN booked_rank IS NOT NULL THEN (booked_rank <= 5)::INT END), 0) AS recall5,
  avg(booked_rank) AS mean_booked_rank, count(*) AS n_queries, count(booked_rank) AS n_booked
FROM {source} {g}"""


def metrics_sql(source, score, by=""):
    return summary_sql(f"({slate_sql(source, score, by)})", by)


METRIC_INTS, METRIC_NUMS = "n_queries n_booked", "ndcg5 recall1 recall5 mean_booked_rank"


def cheapest(t):
    return t.labelled.withColumn("score", -num("price_usd"))


query("m1_ndcg_per_search", lambda t: M.per_search_metrics(cheapest(t)), slate_sql("lab", "-price_usd"),
      ints="srch_id n_rows booked_rank", nums="ndcg")
query("m2_recall", lambda t: M.ranking_metrics(cheapest(t)), metrics_sql("lab", "-price_usd"), nums="recall1 recall5")
query("m3_mean_booked_rank", lambda t: M.ranking_metrics(cheapest(t)), metrics_sql("lab", "-price_usd"),
      nums="mean_booked_rank")
query("m4_ranking_metrics", lambda t: M.ranking_metrics(cheapest(t)), metrics_sql("lab", "-price_usd"),
      ints=METRIC_INTS, nums=METRIC_NUMS)
query("m5_full_metrics", lambda t: M.full_metrics(cheapest(t)), f"""
SELECT avg(ndcg) AS ndcg5, avg((booked_rank <= 1)::INT) AS recall1, avg((booked_rank <= 3)::INT) AS recall3,
  avg((booked_rank <= 5)::INT) AS recall5, avg((booked_rank <= 10)::INT) AS recall10,
  sum(positives_top5) / sum(positives)::DOUBLE AS click_recall5, avg(booked_rank) AS mean_booked_rank,
  quantile_cont(booked_rank, 0.5) AS median_booked_rank, avg((booked_rank = 1)::INT) AS booked_at_1
FROM ({slate_sql("lab", "-price_usd")})""",
      nums="ndcg5 recall1 recall3 recall5 recall10 click_recall5 mean_booked_rank median_booked_rank booked_at_1")
query("m6_booked_rank_histogram", lambda t: M.booked_rank_histogram(cheapest(t)), f"""
SELECT booked_rank, count(*) AS n_searches FROM ({slate_sql("lab", "-price_usd")})
WHERE booked_rank IS NOT NULL GROUP BY booked_rank""", ints="booked_rank n_searches")
query("m7_positive_searches", lambda t: M.ranking_metrics(positive_searches(cheapest(t))),
      metrics_sql("(SELECT * FROM lab WHERE srch_id IN (SELECT srch_id FROM lab WHERE click_bool = 1))", "-price_usd"),
      ints=METRIC_INTS, nums=METRIC_NUMS)
query("m8_predicted_place", lambda t: M.predicted_place(cheapest(t)), """
SELECT srch_id, prop_id, row_number() OVER (PARTITION BY srch_id ORDER BY price_usd, prop_id) AS pred_rank,
  row_number() OVER (PARTITION BY srch_id ORDER BY price_usd, prop_id) / (count(*) OVER (PARTITION BY srch_id))::DOUBLE AS pred_rank_pct
FROM lab""", ints="srch_id prop_id pred_rank", nums="pred_rank_pct")
query("m9_metrics_by_segment", lambda t: M.metrics_by_segment(cheapest(t), "prop_starrating"),
      f"SELECT * FROM ({metrics_sql('lab', '-price_usd', 'prop_starrating')}) WHERE n_queries >= 10",
      ints="prop_starrating " + METRIC_INTS, nums=METRIC_NUMS)
_STACK = " UNION ALL ".join(
    f"SELECT srch_id, prop_id, relevance, '{n}' AS baseline, coalesce({e}, (SELECT min({e}) FROM lab) - 1) AS score FROM lab"
    for n, e in (("cheapest_first", "-price_usd"), ("highest_stars", "prop_starrating"),
                 ("highest_review", "prop_review_score"), ("best_location1", "prop_location_score1"),
                 ("promotion_first", "promotion_flag"),
                 ("best_value", "prop_starrating / nullif(ln(1 + price_usd), 0)")))
query("m10_baselines", lambda t: M.baseline_metrics(t.labelled).unionByName(
    M.existing_order_metrics(t.labelled).withColumn("baseline", F.lit("shown_order"))),
      metrics_sql(f"({_STACK})", "score", "baseline") + " UNION ALL SELECT 'shown_order', * FROM ("
      + metrics_sql("(SELECT * FROM lab WHERE random_bool = 0)", "-position") + ")",
      ints=METRIC_INTS, nums=METRIC_NUMS, texts="baseline")
view("base_deltas", f"""
SELECT baseline, ndcg5, ndcg5 - (SELECT ndcg5 FROM ({metrics_sql("lab", "-price_usd")})) AS delta
FROM ({metrics_sql(f"({_STACK})", "score", "baseline")})""")


def _deltas(t):
    m = M.baseline_metrics(t.labelled).select("baseline", "ndcg5")
    anchor = M.ranking_metrics(cheapest(t)).select("ndcg5").scalar()
    return m.withColumn("delta", F.col("ndcg5") - anchor)


query("m11_decision_bands", lambda t: _deltas(t).withColumn("decision", M.decision(F.round("delta", 9))), """
SELECT baseline, delta, CASE WHEN round(delta, 9) < 0 THEN 'REJECT' WHEN round(delta, 9) < 0.001 THEN 'HOLD'
  WHEN round(delta, 9) < 0.002 THEN 'KEEP' ELSE 'STRONG_KEEP' END AS decision FROM base_deltas""",
      nums="delta", texts="baseline decision")
query("m12_candidate_category",
      lambda t: _deltas(t).withColumn("category", M.category(
          F.col("ndcg5"), F.length("baseline") * 130, cuts=(0.16, 0.155, 0.15, 0.14, 0.17))), """
SELECT baseline, concat_ws('|', CASE WHEN ndcg5 >= 0.16 THEN 'EXCELLENT' WHEN ndcg5 >= 0.155 THEN 'STRONG'
    WHEN ndcg5 >= 0.15 THEN 'CANDIDATE' WHEN ndcg5 < 0.14 THEN 'WEAK' ELSE 'NEUTRAL' END,
  CASE WHEN ndcg5 >= 0.17 THEN 'POSSIBLE_OVERFIT' END, CASE WHEN length(baseline) * 130 < 100 THEN 'EARLY_STOP_SUSPICIOUS' END,
  CASE WHEN length(baseline) * 130 > 1800 THEN 'HIT_ROUND_BUDGET' END) AS category FROM base_deltas""",
      texts="baseline category")
query("m13_score_separation", lambda t: M.score_separation(cheapest(t)), """
SELECT relevance, count(*) AS n, avg(-price_usd) AS mean_score, stddev_samp(-price_usd) AS std_score,
  quantile_cont(-price_usd, 0.5) AS median_score FROM lab GROUP BY relevance""",
      ints="relevance n", nums="mean_score std_score median_score")
