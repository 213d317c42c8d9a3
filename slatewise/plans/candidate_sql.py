"""The candidate view as SQL over the given tables (the oracle's base table)."""


def _competitor(i):
    absent = f"(prop_id * {2 * i + 1} + srch_id) % 10 < 6"
    return f"""  CASE WHEN {absent} THEN NULL ELSE (prop_id + {i} * srch_id) % 3 - 1 END AS comp{i}_rate,
  CASE WHEN {absent} THEN NULL WHEN (prop_id * 3 + srch_id + {i}) % 12 = 0 THEN 1 ELSE 0 END AS comp{i}_inv,
  CASE WHEN {absent} OR (prop_id + srch_id + {i}) % 4 <> 0 THEN NULL ELSE 1 + (prop_id * {i} + srch_id) % 50 END AS comp{i}_rate_percent_diff,
"""


CANDIDATES = """WITH base AS (
  SELECT l.l_suppkey * 100 + (year(l.l_shipdate) - 1995) * 4 + (quarter(l.l_shipdate) - 1) AS srch_id,
         l.l_partkey AS prop_id, l.l_shipdate AS ship_ts, l.l_orderkey, l.l_linenumber,
         l.l_extendedprice, l.l_quantity, l.l_discount, l.l_returnflag,
         l.l_suppkey, s.s_nationkey, p.p_size, p.p_retailprice
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
), one AS (
  SELECT *, row_number() OVER (PARTITION BY srch_id, prop_id
                               ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS dup_no
  FROM base
), pos AS (
  SELECT *, row_number() OVER (PARTITION BY srch_id ORDER BY l_orderkey, prop_id) AS position,
         min(ship_ts) OVER (PARTITION BY srch_id) AS date_time,
         floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price_usd,
         1 + l_suppkey % 7 AS srch_length_of_stay,
         CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN 1 ELSE 0 END AS click_bool
  FROM one WHERE dup_no = 1
), marked AS (
  SELECT *, CASE WHEN click_bool = 1 AND srch_id % 10 < 7
                  AND row_number() OVER (PARTITION BY srch_id, click_bool
                                         ORDER BY l_quantity DESC, prop_id) = 1
                 THEN 1 ELSE 0 END AS booking_bool
  FROM pos
)
SELECT srch_id, date_time, s_nationkey % 5 AS site_id,
  s_nationkey AS visitor_location_country_id,
  CASE WHEN srch_id % 20 = 0 THEN 1 + l_suppkey % 4 END AS visitor_hist_starrating,
  CASE WHEN srch_id % 20 = 0 THEN 50.0e0 + l_suppkey % 200 END AS visitor_hist_adr_usd,
  p_size % 25 AS prop_country_id, prop_id, p_size % 6 AS prop_starrating,
  CASE WHEN prop_id % 50 = 0 THEN NULL ELSE (prop_id % 11) / 2.0e0 END AS prop_review_score,
  CASE WHEN prop_id % 8 < 5 THEN 1 ELSE 0 END AS prop_brand_bool,
  (prop_id % 70) / 10.0e0 AS prop_location_score1,
  CASE WHEN prop_id % 5 = 0 THEN NULL ELSE (prop_id % 97) / 97.0e0 END AS prop_location_score2,
  CASE WHEN prop_id % 7 = 0 THEN 0.0e0 ELSE ln(p_retailprice) END AS prop_log_historical_price,
  position, price_usd,
  CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS promotion_flag,
  l_suppkey % 20 AS srch_destination_id, srch_length_of_stay,
  srch_id % 60 AS srch_booking_window, 1 + srch_id % 4 AS srch_adults_count,
  srch_id % 3 AS srch_children_count, 1 + srch_id % 2 AS srch_room_count,
  CASE WHEN srch_id % 7 < 3 THEN 1 ELSE 0 END AS srch_saturday_night_bool,
  CASE WHEN srch_id % 16 = 0 THEN 0.0e0 - (prop_id % 300) / 10.0e0 END AS srch_query_affinity_score,
  CASE WHEN srch_id % 3 = 1 THEN NULL ELSE 10.0e0 + (srch_id * 37) % 5000 END AS orig_destination_distance,
  CASE WHEN srch_id % 10 IN (0, 4, 8) THEN 1 ELSE 0 END AS random_bool,
""" + "".join(_competitor(i) for i in range(1, 9)) + """  click_bool,
  CASE WHEN booking_bool = 1 THEN price_usd * srch_length_of_stay END AS gross_bookings_usd,
  booking_bool
FROM marked"""
