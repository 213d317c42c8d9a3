"""Row-level and listwise feature queries."""

from pyspark.sql import functions as F

from ..functions.exprs import finite, num
from ..operators import listwise as L
from ..operators import row_features as R
from ..schema import comp_columns
from .features import row_and_listwise
from .registry import query, view

KEY = "srch_id prop_id"

query("impressions", lambda t: t.impressions,
      "SELECT * FROM imp",
      ints=KEY + " site_id visitor_location_country_id prop_country_id prop_starrating prop_brand_bool position "
           "promotion_flag srch_destination_id srch_length_of_stay srch_booking_window srch_adults_count "
           "srch_children_count srch_room_count srch_saturday_night_bool random_bool click_bool booking_bool",
      nums="visitor_hist_starrating visitor_hist_adr_usd prop_review_score prop_location_score1 "
           "prop_location_score2 prop_log_historical_price price_usd srch_query_affinity_score "
           "orig_destination_distance gross_bookings_usd " + " ".join(
               comp_columns("rate") + comp_columns("inv") + comp_columns("rate_percent_diff")),
      texts="date_time")

view("rowf", """
SELECT *, month(date_time) AS month, hour(date_time) AS hour, (dayofweek(date_time) + 6) % 7 AS dayofweek,
  CASE WHEN (dayofweek(date_time) + 6) % 7 >= 5 THEN 1 ELSE 0 END AS is_weekend_search,
  (prop_location_score2 IS NOT NULL)::INT AS has_location_score2,
  (visitor_hist_starrating IS NOT NULL)::INT AS has_visitor_history,
  (srch_query_affinity_score IS NOT NULL)::INT AS has_query_affinity,
  (orig_destination_distance IS NOT NULL)::INT AS has_distance,
  CASE WHEN prop_log_historical_price > 0 THEN 1 ELSE 0 END AS has_historical_price,
  price_usd - nullif(exp(prop_log_historical_price), 1.0) AS price_diff_from_hist,
  price_usd / nullif(exp(prop_log_historical_price), 1.0) AS price_ratio_to_hist,
  price_usd / CASE WHEN srch_length_of_stay = 0 THEN 1 ELSE srch_length_of_stay END AS price_per_night,
  price_usd * srch_length_of_stay AS total_cost,
  price_usd / CASE WHEN srch_adults_count = 0 THEN 1 ELSE srch_adults_count END AS price_per_person,
  price_usd / CASE WHEN srch_room_count = 0 THEN 1 ELSE srch_room_count END AS price_per_room,
  ln(1 + price_usd) AS log_price, ln(1 + orig_destination_distance) AS log_distance,
  visitor_hist_starrating - prop_starrating AS star_diff,
  abs(visitor_hist_starrating - prop_starrating) AS abs_star_diff,
  visitor_hist_adr_usd - price_usd AS price_diff_from_visitor_hist,
  price_usd / nullif(visitor_hist_adr_usd, 0) AS price_ratio_to_visitor_hist,
  """ + " + ".join(f"coalesce({c}, 0)" for c in comp_columns("rate")) + """ AS comp_rate_sum,
  """ + " + ".join(f"({c} IS NOT NULL)::INT" for c in comp_columns("rate")) + """ AS comp_rate_count,
  """ + " + ".join(f"coalesce(({c} = -1)::INT, 0)" for c in comp_columns("rate")) + """ AS comp_cheaper_count,
  """ + " + ".join(f"coalesce(({c} = 1)::INT, 0)" for c in comp_columns("rate")) + """ AS comp_more_expensive_count,
  """ + " + ".join(f"coalesce({c}, 0)" for c in comp_columns("rate")) + """ AS comp_rate_advantage,
  """ + " + ".join(f"({c} IS NOT NULL)::INT" for c in comp_columns("inv")) + """ AS comp_inv_count,
  """ + " + ".join(f"coalesce(({c} = 1)::INT, 0)" for c in comp_columns("inv")) + """ AS comp_no_inv_count,
  list_avg([""" + ", ".join(comp_columns("rate_percent_diff")) + """]) AS comp_rate_pct_mean,
  least(""" + ", ".join(comp_columns("rate_percent_diff")) + """) AS comp_rate_pct_min,
  greatest(""" + ", ".join(comp_columns("rate_percent_diff")) + """) AS comp_rate_pct_max,
  prop_starrating / nullif(ln(1 + price_usd), 0) AS value_score,
  prop_starrating * prop_review_score AS star_review_product,
  prop_location_score1 + coalesce(prop_location_score2, 0) AS location_total,
  CASE WHEN visitor_location_country_id = prop_country_id THEN 1 ELSE 0 END AS is_domestic,
  CASE WHEN prop_starrating = 0 THEN 1 ELSE 0 END AS starrating_is_zero,
  CASE WHEN prop_review_score = 0 THEN 1 ELSE 0 END AS review_is_zero
FROM lab
""")


def row_query(name, step, ints="", nums=""):
    query(name, lambda t: step(t.labelled), "SELECT * FROM rowf", ints=f"{KEY} {ints}".strip(), nums=nums)


row_query("f1_temporal", R.temporal, "month hour dayofweek is_weekend_search")
row_query("f2_missing_flags", R.missing_flags, "has_location_score2 has_visitor_history has_query_affinity "
          "has_distance has_historical_price")
row_query("f3_price", R.price, nums="price_diff_from_hist price_ratio_to_hist price_per_night total_cost "
          "price_per_person price_per_room log_price log_distance")
row_query("f4_visitor_match", R.visitor_match, nums="star_diff abs_star_diff price_diff_from_visitor_hist "
          "price_ratio_to_visitor_hist")
row_query("f5_competitors", R.competitors, "comp_rate_sum comp_rate_count comp_cheaper_count "
          "comp_more_expensive_count comp_rate_advantage comp_inv_count comp_no_inv_count",
          "comp_rate_pct_mean comp_rate_pct_min comp_rate_pct_max")


def _names_after_drop(t):
    df = R.drop_competitor_columns(t.impressions)
    return df.unpivot([], [c for c in sorted(df.columns) if c != "date_time" and "hist" not in c
                           and df.schema[c].dataType.typeName() == "integer"], "name", "value").groupBy(
        "name").agg(F.sum("value").alias("total"))


_INT_COLS = sorted("site_id visitor_location_country_id prop_country_id prop_starrating prop_brand_bool position "
                   "promotion_flag srch_destination_id srch_length_of_stay srch_booking_window srch_adults_count "
                   "srch_children_count srch_room_count srch_saturday_night_bool random_bool click_bool "
                   "booking_bool".split())
query("f6_drop_competitor_columns", _names_after_drop,
      " UNION ALL ".join(f"SELECT '{c}' AS name, sum({c}) AS total FROM imp" for c in _INT_COLS),
      ints="total", texts="name")
row_query("f7_quality", R.quality, "is_domestic starrating_is_zero review_is_zero",
          "value_score star_review_product location_total")

LISTWISE_RANKS = ("price_rank starrating_rank review_rank location1_rank location2_rank location_total_rank "
                  "value_score_rank comp_advantage_rank")
view("listf", """
SELECT *,
  rank() OVER (PARTITION BY srch_id ORDER BY price_usd) AS price_rank,
  rank() OVER (PARTITION BY srch_id ORDER BY prop_starrating DESC NULLS LAST) AS starrating_rank,
  CASE WHEN prop_review_score IS NOT NULL THEN rank() OVER (PARTITION BY srch_id ORDER BY prop_review_score DESC NULLS LAST) END AS review_rank,
  rank() OVER (PARTITION BY srch_id ORDER BY prop_location_score1 DESC NULLS LAST) AS location1_rank,
  CASE WHEN prop_location_score2 IS NOT NULL THEN rank() OVER (PARTITION BY srch_id ORDER BY prop_location_score2 DESC NULLS LAST) END AS location2_rank,
  rank() OVER (PARTITION BY srch_id ORDER BY location_total DESC) AS location_total_rank,
  rank() OVER (PARTITION BY srch_id ORDER BY value_score DESC) AS value_score_rank,
  rank() OVER (PARTITION BY srch_id ORDER BY comp_rate_advantage DESC) AS comp_advantage_rank,
  count(price_usd) OVER w AS query_hotel_count, avg(price_usd) OVER w AS query_price_mean,
  stddev_samp(price_usd) OVER w AS query_price_std, quantile_cont(price_usd, 0.5) OVER w AS med,
  min(price_usd) OVER w AS mn, max(price_usd) OVER w AS mx, avg(prop_starrating) OVER w AS query_star_mean,
  max(prop_starrating) OVER w AS star_mx, avg(prop_review_score) OVER w AS rev_mean,
  max(prop_review_score) OVER w AS rev_mx, avg(prop_location_score1) OVER w AS l1_mean,
  max(prop_location_score1) OVER w AS l1_mx, avg(prop_location_score2) OVER w AS l2_mean,
  avg(ln(1 + price_usd)) OVER w AS log_mean, stddev_samp(ln(1 + price_usd)) OVER w AS log_std,
  (rank() OVER (PARTITION BY srch_id ORDER BY price_usd) + (count(*) OVER (PARTITION BY srch_id, price_usd) - 1) / 2.0)
    / count(price_usd) OVER w AS price_percentile,
  (rank() OVER (PARTITION BY srch_id ORDER BY prop_starrating) + (count(*) OVER (PARTITION BY srch_id, prop_starrating) - 1) / 2.0)
    / count(prop_starrating) OVER w AS star_percentile,
  CASE WHEN prop_review_score IS NOT NULL THEN
  (rank() OVER (PARTITION BY srch_id ORDER BY prop_review_score NULLS LAST) + (count(*) OVER (PARTITION BY srch_id, prop_review_score) - 1) / 2.0)
    / count(prop_review_score) OVER w END AS review_percentile
FROM rowf WINDOW w AS (PARTITION BY srch_id)
""")
view("listg", """
SELECT *, """ + ", ".join(f"{r} / query_hotel_count::DOUBLE AS {r}_norm" for r in LISTWISE_RANKS.split()) + """,
  price_usd - query_price_mean AS price_vs_mean, price_usd - med AS price_vs_median, price_usd - mn AS price_vs_min,
  mx - price_usd AS price_vs_max,
  (price_usd - query_price_mean) / CASE WHEN query_price_std = 0 THEN 1 ELSE query_price_std END AS price_z_score,
  prop_starrating - query_star_mean AS star_vs_mean, prop_review_score - rev_mean AS review_vs_mean,
  prop_location_score1 - l1_mean AS loc1_vs_mean, prop_location_score2 - l2_mean AS loc2_vs_mean,
  (ln(1 + price_usd) - log_mean) / CASE WHEN log_std = 0 THEN 1 ELSE log_std END AS log_price_z_score,
  price_usd / CASE WHEN mn = 0 THEN 1 ELSE mn END AS price_to_min_ratio,
  (price_rank = 1)::INT AS is_cheapest, (price_usd = mx)::INT AS is_most_expensive,
  coalesce((prop_starrating = star_mx)::INT, 0) AS is_best_star, coalesce((prop_review_score = rev_mx)::INT, 0) AS is_best_review,
  coalesce((prop_location_score1 = l1_mx)::INT, 0) AS is_best_location1
FROM listf
""")
view("listh", """
SELECT *, (starrating_rank_norm + review_rank_norm + location1_rank_norm) / 3 AS quality_rank_avg,
  (starrating_rank_norm + review_rank_norm + location1_rank_norm) / 3 - price_rank_norm AS value_gap,
  is_cheapest + is_best_star + is_best_review + is_best_location1 AS n_best_flags
FROM listg
""")
view("intf", """
SELECT *, price_usd / CASE WHEN prop_starrating = 0 THEN 1 ELSE prop_starrating END AS price_per_star,
  price_per_night / CASE WHEN prop_starrating = 0 THEN 1 ELSE prop_starrating END AS price_per_night_per_star,
  prop_starrating * prop_brand_bool AS star_x_brand,
  CASE WHEN srch_query_affinity_score IS NOT NULL THEN exp(least(srch_query_affinity_score, 0)) END AS query_affinity_exp,
  log_distance * (1 - is_domestic) AS distance_x_international,
  promotion_flag * (1 - price_rank_norm) AS promo_x_cheap,
  (srch_booking_window <= 1)::INT AS is_last_minute,
  (srch_booking_window > 1 AND srch_booking_window <= 7)::INT AS is_short_window,
  (srch_booking_window > 30)::INT AS is_long_window,
  (srch_children_count > 0)::INT AS is_family, srch_adults_count + srch_children_count AS total_guests,
  price_usd / CASE WHEN srch_adults_count + srch_children_count = 0 THEN 1 ELSE srch_adults_count + srch_children_count END AS price_per_guest,
  coalesce((price_ratio_to_hist < 0.9)::INT, 0) AS is_discounted, coalesce((price_ratio_to_hist > 1.2)::INT, 0) AS is_overpriced
FROM listh
""")


def listwise_frame(t):
    """Row and listwise columns of the labelled table."""
    return row_and_listwise(t.labelled)


def list_query(name, ints="", nums="", source="listh"):
    query(name, listwise_frame, f"SELECT * FROM {source}", ints=f"{KEY} {ints}".strip(), nums=nums)


def inter_query(name, ints="", nums=""):
    query(name, lambda t: R.apply(listwise_frame(t), R.INTERACTION_STEPS), "SELECT * FROM intf",
          ints=f"{KEY} {ints}".strip(), nums=nums)


inter_query("f8_interactions", "star_x_brand", "price_per_star price_per_night_per_star query_affinity_exp "
            "distance_x_international promo_x_cheap")
query("f9_booking_window", lambda t: R.booking_window(t.labelled), "SELECT * FROM intf",
      ints=KEY + " is_last_minute is_short_window is_long_window")
query("f10_family", lambda t: R.family(t.labelled), "SELECT * FROM intf", ints=KEY + " is_family total_guests",
      nums="price_per_guest")
query("f11_deals", lambda t: R.deals(R.price(t.labelled)), "SELECT * FROM intf", ints=KEY + " is_discounted is_overpriced")
query("f15_brand_domestic", lambda t: R.brand_domestic(R.quality(t.labelled)),
      "SELECT *, prop_brand_bool * is_domestic AS brand_x_domestic FROM rowf", ints=KEY + " brand_x_domestic")
query("f19_label_gain", lambda t: R.label_gain(R.gain_class(t.labelled), (0, 1, 7)),
      """SELECT *, CASE relevance WHEN 5 THEN 2 ELSE relevance END AS gain_class,
         CASE relevance WHEN 5 THEN 7 ELSE relevance END AS label_gain FROM lab""",
      ints=KEY + " gain_class label_gain")
query("f20_clean_non_finite",
      lambda t: t.impressions.select("srch_id", "prop_id", finite(F.log(num("prop_starrating") * 0 + 1) / F.when(
          F.col("promotion_flag") == 1, F.lit(1.0)).otherwise(F.lit(float("nan")))).alias("a"),
          finite(F.when(F.col("prop_starrating") == 0, F.lit(float("inf"))).otherwise(num("price_usd"))).alias("b")),
      """SELECT srch_id, prop_id, CASE WHEN promotion_flag = 1 THEN 0.0 END AS a,
         CASE WHEN prop_starrating <> 0 THEN price_usd END AS b FROM imp""", ints=KEY, nums="a b")
query("f21_target", lambda t: t.labelled, "SELECT * FROM lab", ints=KEY + " relevance")
query("f22_expected_cost", lambda t: R.expected_cost(t.impressions),
      """SELECT *, price_usd * greatest(srch_length_of_stay, 1) AS expected_cost,
         gross_bookings_usd / nullif(price_usd * greatest(srch_length_of_stay, 1), 0) AS gross_to_expected FROM imp""",
      ints=KEY, nums="expected_cost gross_to_expected")

list_query("l1_min_ranks", nums="price_rank starrating_rank review_rank location1_rank location2_rank")
list_query("l2_group_size", "query_hotel_count")
list_query("l3_normalised_ranks", nums="price_rank_norm starrating_rank_norm review_rank_norm location1_rank_norm "
           "location2_rank_norm")
list_query("l4_price_vs_group", nums="price_vs_mean price_vs_median price_vs_min price_vs_max")
list_query("l5_price_z_score", nums="price_z_score")
list_query("l6_vs_mean", nums="star_vs_mean review_vs_mean loc1_vs_mean loc2_vs_mean")
list_query("l7_group_stats", nums="query_price_std query_star_mean query_price_mean")
list_query("l8_log_price_z_score", nums="log_price_z_score")
list_query("l9_price_to_min_ratio", nums="price_to_min_ratio")
list_query("l10_best_flags", "is_cheapest is_most_expensive is_best_star is_best_review is_best_location1")
list_query("l11_percentiles", nums="price_percentile star_percentile review_percentile")
list_query("l12_quality_and_value_gap", nums="quality_rank_avg value_gap")
list_query("l13_derived_ranks", nums="location_total_rank location_total_rank_norm value_score_rank "
           "value_score_rank_norm comp_advantage_rank comp_advantage_rank_norm")
list_query("l14_n_best_flags", "n_best_flags")
query("l15_price_per_star_rank",
      lambda t: L.rank_in_group(R.interactions(R.quality(R.price(t.labelled))), "price_per_star",
                                "price_per_star_rank"),
      """SELECT srch_id, prop_id, rank() OVER (PARTITION BY srch_id ORDER BY price_per_star) AS price_per_star_rank
         FROM intf""", ints=KEY + " price_per_star_rank")
query("l17_candidate_spread", lambda t: L.candidate_spread(t.impressions),
      """SELECT srch_id, prop_id, count(*) OVER w AS candidate_count, max(price_usd) OVER w - min(price_usd) OVER w AS price_spread
         FROM imp WINDOW w AS (PARTITION BY srch_id)""", ints=KEY + " candidate_count", nums="price_spread")
