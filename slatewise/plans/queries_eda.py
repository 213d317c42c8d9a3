"""Exploratory profile queries."""

from pyspark.sql import functions as F

from ..functions.exprs import band, flag
from ..functions.stats import bin_of, spearman, spearman_matrix
from ..operators import eda as A
from ..operators.row_features import quality, visitor_match
from ..schema import column_group, comp_columns, impression_schema
from .registry import query, view

R_INTS, R_NUMS = "n", "click_rate booking_rate"


def rate_sql(source, *keys, where="true", extra=""):
    k = ", ".join(keys)
    return (f"SELECT {k}, count(*) AS n, avg(click_bool) AS click_rate, avg(booking_bool) AS booking_rate{extra} "
            f"FROM {source} WHERE {where} GROUP BY ALL")


def edges_sql(source, value, n):
    probs = ", ".join(repr(i / n) + "e0" for i in range(n + 1))
    return f"(SELECT list_sort(list_distinct(quantile_cont(({value})::DOUBLE, [{probs}]))) FROM {source})"


def bin_sql(value, edges, lowest=True):
    below = f"len([e FOR e IN {edges} IF e < ({value})::DOUBLE])"
    low = f"WHEN ({value})::DOUBLE = ({edges})[1] THEN 1 " if lowest else ""
    return f"CASE WHEN ({value}) IS NULL THEN NULL {low}WHEN {below} > 0 AND {below} < len({edges}) THEN {below} END"


def qbin(source, value, n, name="bin", more=""):
    """Rows of a source with their quantile bin."""
    return (f"(SELECT s.*, {bin_sql(value, 'g.e')} AS {name}, g.e[{bin_sql(value, 'g.e')} + 1] AS {name}_hi{more} "
            f"FROM {source} s, (SELECT {edges_sql(source, value, n)} AS e) g WHERE ({value}) IS NOT NULL)")


def long_sql(source, columns, ids=""):
    return "(" + " UNION ALL ".join(f"SELECT {ids}'{c}' AS feature, ({c})::DOUBLE AS value FROM {source}" for c in columns) + ")"


#: Every number of an impression.
INVENTORY = [f.name for f in impression_schema().fields if f.dataType.typeName() in ("integer", "long", "double")]
_TYPES = {f.name: f.dataType.simpleString() for f in impression_schema().fields}
query("a1_column_inventory", lambda t: A.column_inventory(t.impressions, INVENTORY), " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, '{_TYPES[c]}' AS dtype, '{column_group(c)}' AS column_group, count(DISTINCT {c}) AS n_unique,
    count(*) - count({c}) AS n_null, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, avg({c}) AS mean FROM imp""" for c in INVENTORY),
      ints="n_unique n_null", nums="min max mean", texts="feature dtype column_group")
EVERY = [f.name for f in impression_schema().fields]
#: The columns that can lack a value; the SQL needs a list of pairs, the operator finds them itself.
GAPS = ["prop_review_score", "prop_location_score2", "visitor_hist_starrating", "visitor_hist_adr_usd", "srch_query_affinity_score",
        "orig_destination_distance", "gross_bookings_usd", *comp_columns("rate"), *comp_columns("inv"), *comp_columns("rate_percent_diff")]
query("a2_missing_share", lambda t: A.missing_share(t.impressions, EVERY), " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(({c} IS NULL)::INT) AS missing FROM imp" for c in EVERY), nums="missing", texts="feature")
OTHERS = [c for c in EVERY if c != "random_bool"]
query("a2_missing_by_segment", lambda t: A.missing_share(t.impressions, OTHERS, ["random_bool"]), " UNION ALL ".join(
    f"SELECT random_bool, '{c}' AS feature, avg(({c} IS NULL)::INT) AS missing FROM imp GROUP BY random_bool" for c in OTHERS),
      ints="random_bool", nums="missing", texts="feature")
query("a2_missing_drift", lambda t: A.missing_drift(t.sides[0], t.sides[1], EVERY), " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, a AS missing_left, b AS missing_right, b - a AS drift FROM (SELECT avg(({c} IS NULL)::INT) AS a FROM tr),
    (SELECT avg(({c} IS NULL)::INT) AS b FROM va)""" for c in EVERY), nums="missing_left missing_right drift", texts="feature")
query("a3_missing_correlation", lambda t: A.missing_correlation(t.impressions, EVERY, 0.01), "WITH m AS MATERIALIZED (SELECT " + ", ".join(
    f"({c} IS NULL)::INT AS {c}" for c in EVERY) + " FROM imp), s AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in EVERY) + " FROM m), p AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr, (SELECT least({a}, {b}) FROM s) AS gone FROM m" for a in GAPS for b in GAPS if a < b)
    + ") SELECT a, b, corr FROM p WHERE gone > 0.01", nums="corr", texts="a b")
_CELL = " UNION ALL ".join(f"SELECT '{c}' AS feature, click_bool, booking_bool, ({c} IS NULL)::INT AS gone FROM imp" for c in EVERY)
query("a4_informative_missingness", lambda t: A.informative_missingness(t.impressions, EVERY), f"""
SELECT feature, missing, click_present, click_missing, book_present, book_missing,
  (a + b + c + d) * pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0), 2) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0) AS chi2
FROM (SELECT feature, avg(gone) AS missing, avg(click_bool) FILTER (gone = 0) AS click_present, avg(click_bool) FILTER (gone = 1) AS click_missing,
  avg(booking_bool) FILTER (gone = 0) AS book_present, avg(booking_bool) FILTER (gone = 1) AS book_missing,
  (count(*) FILTER (gone = 0 AND click_bool = 0))::DOUBLE AS a, (count(*) FILTER (gone = 0 AND click_bool = 1))::DOUBLE AS b,
  (count(*) FILTER (gone = 1 AND click_bool = 0))::DOUBLE AS c, (count(*) FILTER (gone = 1 AND click_bool = 1))::DOUBLE AS d
  FROM ({_CELL}) GROUP BY feature) WHERE missing > 0.01""",
      nums="missing click_present click_missing book_present book_missing chi2", texts="feature")
view("compl", " UNION ALL ".join(f"""SELECT {i} AS competitor, comp{i}_rate AS rate, comp{i}_inv AS inv, comp{i}_rate_percent_diff AS pct,
  click_bool, booking_bool FROM imp""" for i in range(1, 9)))
view("compn", "SELECT *, " + " + ".join(f"({c} IS NOT NULL)::INT" for c in comp_columns("rate")) + """ AS n_comp,
  list_avg([""" + ", ".join(comp_columns("rate_percent_diff")) + "]) AS mean_pct FROM rowf")
query("a5_competitor_availability", lambda t: A.competitor_availability(t.impressions), """
SELECT competitor, avg((rate IS NOT NULL)::INT) AS rate_share, avg((inv IS NOT NULL)::INT) AS inv_share, avg((pct IS NOT NULL)::INT) AS pct_share
FROM compl GROUP BY competitor""", ints="competitor", nums="rate_share inv_share pct_share")
query("a5_rates_by_competitor_count", lambda t: A.rates(A.with_competitor_count(t.impressions), "n_comp"), rate_sql("compn", "n_comp"),
      ints="n_comp n", nums=R_NUMS)
query("a6_competitor_values", lambda t: A.competitor_long(t.impressions).groupBy("competitor", "rate").agg(F.count(F.lit(1)).alias("n")),
      "SELECT competitor, rate, count(*) AS n FROM compl GROUP BY ALL", ints="competitor n", nums="rate")
query("a6_booking_by_rate_value", lambda t: A.competitor_booking_pivot(t.impressions), """
SELECT competitor, avg(booking_bool) FILTER (rate = -1) AS cheaper, avg(booking_bool) FILTER (rate = 0) AS same, avg(booking_bool) FILTER (rate = 1) AS dearer
FROM compl WHERE rate IS NOT NULL GROUP BY competitor""", ints="competitor", nums="cheaper same dearer")


def _comp(t):
    from ..operators.row_features import competitors
    return competitors(t.labelled)


query("a7_rates_by_competitor_counts", lambda t: A.rates(_comp(t), "comp_more_expensive_count", "comp_cheaper_count"),
      rate_sql("rowf", "comp_more_expensive_count", "comp_cheaper_count"), ints="comp_more_expensive_count comp_cheaper_count n", nums=R_NUMS)
query("a7_rates_by_difference_bin", lambda t: A.quantile_rates(_comp(t), "comp_rate_pct_mean", 20),
      rate_sql(qbin("rowf", "comp_rate_pct_mean", 20), "bin", "bin_hi"), ints="bin n", nums="bin_hi " + R_NUMS)


def _availability(t):
    df = A.with_quantile_bin(t.impressions, "price_usd", 4)
    out = None
    for key in ("prop_brand_bool", "prop_starrating", "site_id", "bin"):
        one = A.availability_by(df, key).select(F.lit(key).alias("dimension"), F.col(key).cast("int").alias("segment"), "n", "mean_competitors", "any_competitor")
        out = one if out is None else out.unionByName(one)
    return out


query("a8_availability_by_segment", _availability, " UNION ALL ".join(
    f"SELECT '{k}' AS dimension, {k} AS segment, count(*) AS n, avg(n_comp) AS mean_competitors, avg((n_comp > 0)::INT) AS any_competitor FROM "
    f"{qbin('compn', 'price_usd', 4)} GROUP BY {k}" for k in ("prop_brand_bool", "prop_starrating", "site_id", "bin")),
      ints="segment n", nums="mean_competitors any_competitor", texts="dimension")


def _hist_sql(v, n):
    return (f"SELECT least(floor((v - lo) / nullif(hi - lo, 0) * {n}), {n - 1}) AS bin, count(*) AS n FROM (SELECT {v} AS v FROM imp), "
            f"(SELECT min({v}) AS lo, max({v}) AS hi FROM imp) WHERE v IS NOT NULL GROUP BY 1")


query("a9_histogram", lambda t: A.histogram(t.impressions, "prop_location_score1", 50), _hist_sql("prop_location_score1", 50), ints="bin n")
query("a9_log_histogram", lambda t: A.histogram(t.impressions, "price_usd", 100, log=True), _hist_sql("ln(1 + price_usd)", 100), ints="bin n")
query("a9_clipped_histogram", lambda t: A.histogram(t.impressions, "price_usd", 50, upper=0.99),
      _hist_sql("least(price_usd, (SELECT quantile_cont(price_usd, 0.99) FROM imp))", 50), ints="bin n")
query("a10_value_counts", lambda t: A.value_counts(t.impressions, "prop_country_id"),
      "SELECT prop_country_id, count(*) AS n FROM imp GROUP BY 1 ORDER BY n DESC, prop_country_id LIMIT 15", ints="prop_country_id n")
DESC = "mean std min max p25 p50 p75 p90 p99"


def describe_sql(source, v):
    return (f"SELECT count({v}) AS n, avg({v}) AS mean, stddev_samp({v}) AS std, min({v}) AS min, max({v}) AS max, "
            + ", ".join(f"quantile_cont(({v})::DOUBLE, 0.{p}) AS p{p}" for p in (25, 50, 75, 90, 99)) + f" FROM {source}")


query("a11_frequency_profile", lambda t: A.frequency_profile(t.impressions, "prop_id"),
      describe_sql("(SELECT count(*) AS c FROM imp GROUP BY prop_id)", "c"), ints="n", nums=DESC)
query("a11_describe_price", lambda t: A.describe(t.impressions, "price_usd"), describe_sql("imp", "price_usd"), ints="n", nums=DESC)
OUT = ["price_usd", "prop_location_score1", "orig_destination_distance", "srch_booking_window", "gross_bookings_usd"]
query("a12_iqr_outliers", lambda t: A.iqr_outliers(t.impressions, OUT), f"""
WITH l AS (SELECT * FROM {long_sql('imp', OUT)} WHERE value IS NOT NULL), q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1)
SELECT l.feature, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, count(*) FILTER (value < q1 - 1.5 * (q3 - q1)) AS n_below,
  count(*) FILTER (value > q3 + 1.5 * (q3 - q1)) AS n_above, count(*) AS n,
  (count(*) FILTER (value < q1 - 1.5 * (q3 - q1)) + count(*) FILTER (value > q3 + 1.5 * (q3 - q1))) / count(*)::DOUBLE AS share
FROM l JOIN q USING (feature) GROUP BY 1, 2, 3""", ints="n_below n_above n", nums="q1 q3 lower upper share", texts="feature")
query("a13_repeated_searches", lambda t: A.repeated_searches(t.impressions),
      f"SELECT {', '.join(A.SIGNATURE)}, count(DISTINCT srch_id) AS n_searches FROM imp GROUP BY ALL HAVING count(DISTINCT srch_id) > 1",
      ints=" ".join(A.SIGNATURE) + " n_searches")
query("a14_daily_searches", lambda t: A.daily_searches(t.impressions), """
SELECT day, n_searches, CASE WHEN count(*) OVER w = 7 THEN avg(n_searches) OVER w END AS rolling
FROM (SELECT date_time::DATE AS day, count(DISTINCT srch_id) AS n_searches FROM imp GROUP BY 1)
WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""", ints="n_searches", nums="rolling", texts="day")
view("timep", """SELECT *, hour(date_time) AS hour, (dayofweek(date_time) + 6) % 7 AS dayofweek, month(date_time) AS month,
  isoyear(date_time) AS iso_year, weekofyear(date_time) AS iso_week FROM imp""")


def _by_time(t):
    cells = {n: F.col(n).cast("int") for n in ("hour", "dayofweek", "month")}
    return A.rates(A.stack_segments(A.with_time_parts(t.impressions), cells), "dimension", "segment")


query("a15_rates_by_time", _by_time, " UNION ALL ".join(rate_sql("timep", f"'{c}' AS dimension", f"{c}::VARCHAR AS segment") for c in ("hour", "dayofweek", "month")),
      ints="n", nums=R_NUMS, texts="dimension segment")
query("a15_rates_by_week", lambda t: A.rates(A.with_time_parts(t.impressions), "iso_year", "iso_week"), rate_sql("timep", "iso_year", "iso_week"),
      ints="iso_year iso_week n", nums=R_NUMS)
query("a15_price_by_month", lambda t: A.rates(A.with_time_parts(t.impressions), "month", price=F.avg("price_usd")),
      rate_sql("timep", "month", extra=", avg(price_usd) AS price"), ints="month n", nums="price " + R_NUMS)
query("a16_rates_by_position", lambda t: A.rates(t.impressions, "position"), rate_sql("imp", "position"), ints="position n", nums=R_NUMS)
query("a16_position_detail", lambda t: A.rates(t.impressions.where(F.col("position").isin(1, 2, 3, 5, 10, 15, 20, 30, 40)), "position", price=F.avg("price_usd")),
      rate_sql("imp", "position", where="position IN (1, 2, 3, 5, 10, 15, 20, 30, 40)", extra=", avg(price_usd) AS price"), ints="position n", nums="price " + R_NUMS)
query("a17_random_totals", lambda t: A.rates(t.impressions, "random_bool", n_searches=F.countDistinct("srch_id")),
      rate_sql("imp", "random_bool", extra=", count(DISTINCT srch_id) AS n_searches"), ints="random_bool n n_searches", nums=R_NUMS)
query("a17_random_by_position", lambda t: A.rates(t.impressions, "random_bool", "position"), rate_sql("imp", "random_bool", "position"),
      ints="random_bool position n", nums=R_NUMS)
QUAL = ["prop_starrating", "prop_review_score", "prop_location_score1", "prop_location_score2", "price_usd", "prop_brand_bool"]
# The sets of columns that are profiled together.
PROPERTY = ["prop_starrating", "prop_review_score", "prop_brand_bool", "prop_location_score1", "prop_location_score2", "prop_log_historical_price"]
PRICE = ["price_usd", "promotion_flag"]
SEARCHED = ["srch_length_of_stay", "srch_booking_window", "srch_adults_count", "srch_children_count", "srch_room_count", "srch_saturday_night_bool"]
PROFILED = [*PROPERTY, *PRICE, *SEARCHED, "visitor_hist_starrating", "visitor_hist_adr_usd", "orig_destination_distance", "srch_query_affinity_score"]
MATRICES = {"core": PROPERTY + PRICE, "property": PROPERTY, "search": SEARCHED, "all": PROPERTY + PRICE + SEARCHED}


def rho_sql(source, features, targets, by=""):
    b = f"{by}, " if by else ""
    parts = " UNION ALL ".join(f"SELECT {b}'{f}' AS feature, '{g}' AS target, ({f})::DOUBLE AS x, ({g})::DOUBLE AS y FROM {source} WHERE {f} IS NOT NULL AND {g} IS NOT NULL"
                               for f in features for g in targets if f != g)
    p = f"{b}feature, target"
    return f"""SELECT {p}, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY {p} ORDER BY x) + (count(*) OVER (PARTITION BY {p}, x) - 1) / 2.0e0 AS rx,
      rank() OVER (PARTITION BY {p} ORDER BY y) + (count(*) OVER (PARTITION BY {p}, y) - 1) / 2.0e0 AS ry FROM ({parts})) GROUP BY {p}"""


query("a18_spearman_position", lambda t: spearman(t.impressions, PROFILED, ["position"], ["random_bool"]).groupBy("feature").pivot(
    "random_bool", [0, 1]).agg(F.first("rho")).toDF("feature", "rho_ranked", "rho_random"),
      f"SELECT feature, max(rho) FILTER (random_bool = 0) AS rho_ranked, max(rho) FILTER (random_bool = 1) AS rho_random FROM ({rho_sql('imp', PROFILED, ['position'], 'random_bool')}) GROUP BY feature",
      nums="rho_ranked rho_random", texts="feature")
query("a19_quality_by_position", lambda t: A.long_form(t.impressions, QUAL, ["position", "random_bool"]).groupBy("position", "random_bool", "feature").agg(F.avg("value").alias("mean")),
      f"SELECT position, random_bool, feature, avg(value) AS mean FROM {long_sql('imp', QUAL, 'position, random_bool, ')} GROUP BY ALL",
      ints="position random_bool", nums="mean", texts="feature")
query("a20_rates_by_star", lambda t: A.rates(t.impressions, "random_bool", "prop_starrating"), rate_sql("imp", "random_bool", "prop_starrating"),
      ints="random_bool prop_starrating n", nums=R_NUMS)
query("a20_rates_by_review_bin", lambda t: A.rates(t.impressions.withColumn("bin", bin_of("prop_review_score", F.array(*[F.lit(i / 2) for i in range(11)]))).where("bin IS NOT NULL"), "random_bool", "bin"),
      rate_sql(f"(SELECT *, {bin_sql('prop_review_score', '[' + ', '.join(str(i / 2) for i in range(11)) + ']')} AS bin FROM imp)", "random_bool", "bin", where="bin IS NOT NULL"),
      ints="random_bool bin n", nums=R_NUMS)
query("a20_rates_by_price_quintile", lambda t: A.rates(A.with_quantile_bin(t.impressions, "price_usd", 5), "random_bool", "bin"),
      rate_sql(qbin("imp", "price_usd", 5), "random_bool", "bin"), ints="random_bool bin n", nums=R_NUMS)
query("a21_label_crosstab", lambda t: A.label_crosstab(t.impressions), "SELECT click_bool, booking_bool, count(*) AS n FROM imp GROUP BY CUBE (click_bool, booking_bool)",
      ints="n", nums="click_bool booking_bool")
query("a21_relevance_distribution", lambda t: t.labelled.groupBy("relevance").agg(F.count(F.lit(1)).alias("n")), "SELECT relevance, count(*) AS n FROM lab GROUP BY 1", ints="relevance n")
query("a21_booking_implies_click", lambda t: A.booking_without_click(t.impressions),
      "SELECT count(*) FILTER (booking_bool = 1 AND click_bool = 0) AS violations, sum(booking_bool) AS bookings FROM imp", ints="violations bookings")
for event in ("click_bool", "booking_bool"):
    query(f"a22_{event.split('_')[0]}s_per_search", lambda t, event=event: A.events_per_search(t.impressions, event),
          f"SELECT events, count(*) AS n_searches FROM (SELECT sum({event}) AS events FROM imp GROUP BY srch_id) GROUP BY events", ints="events n_searches")
query("a23_signal_breakdown", lambda t: A.signal_breakdown(t.impressions), """
SELECT CASE WHEN b > 0 THEN 'booked' WHEN c > 0 THEN 'clicked' ELSE 'none' END AS kind, count(DISTINCT srch_id) AS n_searches, count(*) AS n_rows,
  avg(price_usd) AS price, avg(prop_starrating) AS stars, avg(prop_review_score) AS review, avg(prop_location_score1) AS location, avg(random_bool) AS random_share
FROM (SELECT *, sum(click_bool) OVER w AS c, sum(booking_bool) OVER w AS b FROM imp WINDOW w AS (PARTITION BY srch_id)) GROUP BY 1""",
      ints="n_searches n_rows", nums="price stars review location random_share", texts="kind")
query("a24_outcome_means", lambda t: A.outcome_means(t.impressions, QUAL), f"""
SELECT feature, avg(value) FILTER (booking_bool = 1) AS booked, avg(value) FILTER (click_bool = 1 AND booking_bool = 0) AS clicked_only,
  avg(value) FILTER (click_bool = 0) AS ignored, avg(value) FILTER (booking_bool = 1) - avg(value) FILTER (click_bool = 0) AS difference
FROM {long_sql('imp', QUAL, 'click_bool, booking_bool, ')} GROUP BY feature""", nums="booked clicked_only ignored difference", texts="feature")
query("a25_gross_agreement", lambda t: A.gross_agreement(t.impressions), """
SELECT count(*) AS n, 1 - sum(pow(y - x, 2)) / nullif(var_pop(y) * count(*), 0) AS r2, avg(y / x) AS ratio_mean, avg((abs(y / x - 1) < 0.05)::INT) AS share_near_one
FROM (SELECT gross_bookings_usd AS y, price_usd * greatest(srch_length_of_stay, 1) AS x FROM imp WHERE gross_bookings_usd IS NOT NULL)""",
      ints="n", nums="r2 ratio_mean share_near_one")
query("a26_spearman_labels", lambda t: spearman(t.impressions, PROFILED, ["click_bool", "booking_bool"]), rho_sql("imp", PROFILED, ["click_bool", "booking_bool"]),
      ints="n", nums="rho", texts="feature target")
DEC = ["price_usd", "prop_starrating", "prop_review_score", "prop_location_score1", "prop_location_score2", "prop_log_historical_price",
       "orig_destination_distance", "srch_booking_window", "srch_length_of_stay", "srch_query_affinity_score"]
query("a27_decile_rates", lambda t: A.decile_rates(t.impressions, DEC), " UNION ALL ".join(rate_sql(qbin("imp", c, 10), f"'{c}' AS feature", "bin") for c in DEC),
      ints="bin n", nums=R_NUMS, texts="feature")


def _matrices(t):
    """The four matrices out of the one over all their columns."""
    holds = F.explode(F.array_compact(F.array(*[F.when(F.col("a").isin(cols) & F.col("b").isin(cols), F.lit(name)) for name, cols in MATRICES.items()])))
    return spearman_matrix(t.impressions, MATRICES["all"]).withColumn("matrix", holds)


query("a28_spearman_matrix", _matrices, f"WITH r AS MATERIALIZED ({rho_sql('imp', MATRICES['all'], MATRICES['all'])}) " + " UNION ALL ".join(
    f"SELECT '{name}' AS matrix, feature AS a, target AS b, rho, n FROM r WHERE feature IN {tuple(cols)} AND target IN {tuple(cols)}" for name, cols in MATRICES.items()),
      ints="n", nums="rho", texts="matrix a b")


def pivot_sql(source, row, column, values):
    return f"SELECT {row}, " + ", ".join(f"avg(booking_bool) FILTER ({column} = {v}) AS rate_{v}, nullif(count(*) FILTER ({column} = {v}), 0) AS n_{v}" for v in values) + f" FROM {source} GROUP BY {row}"


def pivot_cols(values):
    return " ".join(f"rate_{v} n_{v}" for v in values)


query("a29_price_quintile_by_star", lambda t: A.rate_pivot(A.with_quantile_bin(t.impressions, "price_usd", 5), "bin", "prop_starrating", list(range(6))),
      pivot_sql(qbin("imp", "price_usd", 5), "bin", "prop_starrating", range(6)), ints="bin", nums=pivot_cols(range(6)))
REVIEW = [0, 2, 3, 3.5, 4, 4.5, 5]
query("a29_review_bin_by_star", lambda t: A.rate_pivot(t.impressions.withColumn("bin", bin_of("prop_review_score", F.array(*[F.lit(float(x)) for x in REVIEW]))).where("bin IS NOT NULL"), "bin", "prop_starrating", list(range(6))),
      pivot_sql(f"(SELECT * FROM (SELECT *, {bin_sql('prop_review_score', str(REVIEW))} AS bin FROM imp) WHERE bin IS NOT NULL)", "bin", "prop_starrating", range(6)), ints="bin", nums=pivot_cols(range(6)))
query("a30_rates_by_price_rank", lambda t: A.by_price_rank(t.impressions), rate_sql("(SELECT *, rank() OVER (PARTITION BY srch_id ORDER BY price_usd) AS price_rank FROM imp)", "price_rank", where="price_rank <= 30"),
      ints="price_rank n", nums=R_NUMS)
STARS = [-5, -3, -2, -1, -0.5, 0, 0.5, 1, 2, 3, 5]
query("a31_star_difference_bins", lambda t: A.cut_rates(visitor_match(t.labelled), "star_diff", STARS),
      rate_sql(f"(SELECT *, {bin_sql('star_diff', str(STARS), False)} AS bin FROM rowf)", "bin", where="bin IS NOT NULL"), ints="bin n", nums=R_NUMS)
query("a31_price_ratio_bins", lambda t: A.quantile_rates(visitor_match(t.labelled), "price_ratio_to_visitor_hist", 10),
      rate_sql(qbin("rowf", "price_ratio_to_visitor_hist", 10), "bin", "bin_hi"), ints="bin n", nums="bin_hi " + R_NUMS)


def _places(t):
    df = quality(t.impressions)
    return A.rates(A.stack_segments(df, {c: F.col(c) for c in ("visitor_location_country_id", "prop_country_id", "site_id", "is_domestic")}), "dimension", "segment")


query("a32_rates_by_place", _places, " UNION ALL ".join(rate_sql("rowf", f"'{c}' AS dimension", f"{c}::VARCHAR AS segment")
                                                       for c in ("visitor_location_country_id", "prop_country_id", "site_id", "is_domestic")),
      ints="n", nums=R_NUMS, texts="dimension segment")
query("a32_rates_by_distance", lambda t: A.log_bin_rates(t.impressions.where("orig_destination_distance IS NOT NULL"), "orig_destination_distance", 30), None, ints="bin n", nums=R_NUMS)
VAR = QUAL + ["srch_booking_window", "orig_destination_distance", "promotion_flag"]
query("a33_variance_ratio", lambda t: A.variance_ratio(t.impressions, VAR), f"""
WITH l AS (SELECT * FROM {long_sql('imp', VAR, 'srch_id, ')}), w AS (SELECT feature, avg(v) AS wv FROM (SELECT srch_id, feature, var_samp(value) AS v FROM l GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT feature, var_samp(value) AS tv FROM l GROUP BY 1)
SELECT feature, tv AS total_variance, wv AS within_variance, wv / tv AS variance_ratio,
  CASE WHEN wv / tv > 0.3 THEN 'ranking signal' WHEN wv / tv < 0.01 THEN 'constant in query' ELSE 'partial' END AS tier FROM g JOIN w USING (feature) WHERE tv > 0""",
      nums="total_variance within_variance variance_ratio", texts="feature tier")
query("a34_slate_spread", lambda t: A.slate_spread(t.impressions), """
SELECT srch_id, stddev_samp(price_usd) AS price_std, max(price_usd) - min(price_usd) AS price_range, avg(price_usd) AS price_mean, count(DISTINCT prop_starrating) AS n_stars,
  quantile_cont(price_usd, 0.75) - quantile_cont(price_usd, 0.25) AS price_iqr, stddev_samp(price_usd) / avg(price_usd) AS price_cv FROM imp GROUP BY srch_id""",
      ints="srch_id n_stars", nums="price_std price_range price_mean price_iqr price_cv")
query("a35_within_search_spearman", lambda t: A.within_search_spearman(t.labelled, QUAL), f"""
SELECT feature, avg(rho) AS mean_rho, count(*) AS n_searches, quantile_cont(rho, 0.5) AS median_rho FROM (SELECT srch_id, feature, CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END AS rho, count(*) AS c FROM (
  SELECT *, rank() OVER (PARTITION BY srch_id, feature ORDER BY value) + (count(*) OVER (PARTITION BY srch_id, feature, value) - 1) / 2.0e0 AS rx,
    rank() OVER (PARTITION BY srch_id, feature ORDER BY relevance) + (count(*) OVER (PARTITION BY srch_id, feature, relevance) - 1) / 2.0e0 AS ry
  FROM {long_sql('lab', QUAL, 'srch_id, relevance, ')} WHERE value IS NOT NULL) GROUP BY 1, 2) WHERE c >= 5 AND rho IS NOT NULL GROUP BY feature""",
      ints="n_searches", nums="mean_rho median_rho", texts="feature")


def window_segment():
    return band("srch_booking_window", (1, 7, 30), ("last_minute", "short", "medium", "long"))


_WINDOW_SQL = "CASE WHEN srch_booking_window <= 1 THEN 'last_minute' WHEN srch_booking_window <= 7 THEN 'short' WHEN srch_booking_window <= 30 THEN 'medium' ELSE 'long' END"
query("a36_segment_spearman", lambda t: spearman(t.labelled.withColumn("segment", window_segment()), PROFILED, ["relevance"], ["segment"]),
      rho_sql(f"(SELECT *, {_WINDOW_SQL} AS segment FROM lab)", PROFILED, ["relevance"], "segment"), ints="n", nums="rho", texts="segment feature target")
query("a37_family_means", lambda t: A.conditional_means(t.impressions.where("booking_bool = 1").withColumn("family", flag(F.col("srch_children_count") > 0)), "family", QUAL),
      f"SELECT feature, avg(value) FILTER (f > 0) AS mean_yes, avg(value) FILTER (f = 0) AS mean_no FROM {long_sql('(SELECT *, srch_children_count AS f FROM imp WHERE booking_bool = 1)', QUAL, 'f, ')} GROUP BY feature",
      nums="mean_yes mean_no", texts="feature")
_POP = "(SELECT i.*, CASE WHEN c <= 5 THEN 1 WHEN c <= 20 THEN 2 WHEN c <= 50 THEN 3 WHEN c <= 100 THEN 4 ELSE 5 END AS popularity FROM lab i JOIN (SELECT prop_id, count(*) AS c FROM imp GROUP BY 1) USING (prop_id))"
view("popl", "SELECT * FROM " + _POP)
query("a38_popularity_rates", lambda t: A.rates(A.with_popularity(t.impressions), "popularity"), rate_sql("popl", "popularity"), ints="popularity n", nums=R_NUMS)


def _fair(t):
    df = A.with_popularity(t.impressions)
    return A.rates(A.stack_segments(df, {"brand": F.col("prop_brand_bool"), "star": flag(F.col("prop_starrating") >= 4), "cold": flag(F.col("popularity") <= 2), "review": flag(F.col("prop_review_score") >= 4)}),
                   "dimension", "segment", mean_position=F.avg("position"))


query("a39_fairness_rates", _fair, " UNION ALL ".join(rate_sql("popl", f"'{n}' AS dimension", f"({e})::VARCHAR AS segment", extra=", avg(position) AS mean_position") for n, e in (
    ("brand", "prop_brand_bool"), ("star", "(prop_starrating >= 4)::INT"), ("cold", "(popularity <= 2)::INT"), ("review", "coalesce((prop_review_score >= 4)::INT, 0)"))),
      ints="n", nums="mean_position " + R_NUMS, texts="dimension segment")
query("a40_group_sizes", lambda t: A.group_size_distribution(t.sides[0].withColumn("side", F.lit("train")).unionByName(t.sides[1].withColumn("side", F.lit("test"))), ["side"]), """
SELECT side, group_size, count(*) AS n_searches FROM (SELECT 'train' AS side, srch_id, count(*) AS group_size FROM tr GROUP BY 2 UNION ALL SELECT 'test', srch_id, count(*) FROM va GROUP BY 2) GROUP BY 1, 2""",
      ints="group_size n_searches", texts="side")
def _overlap_verdict(left, right):
    return f"""WITH a AS (SELECT DISTINCT date_time::DATE AS d FROM {left}), b AS (SELECT DISTINCT date_time::DATE AS d FROM {right}),
n AS (SELECT (SELECT count(*) FROM a) AS left_days, (SELECT count(*) FROM b) AS right_days,
  (SELECT count(*) FROM (SELECT d FROM a INTERSECT SELECT d FROM b)) AS common_days)
SELECT *, CASE WHEN NOT ((SELECT max(d) FROM a) >= (SELECT min(d) FROM b) AND (SELECT max(d) FROM b) >= (SELECT min(d) FROM a)) THEN 'temporal'
  WHEN common_days > 0.5 * greatest(left_days, right_days) THEN 'same period' ELSE 'partial' END AS verdict FROM n"""


query("a41_date_overlap", lambda t: A.date_overlap(t.sides[0], t.sides[1]), _overlap_verdict("tr", "va"),
      ints="left_days right_days common_days", texts="verdict")
query("a41_date_overlap_random_split", lambda t: A.date_overlap(t.impressions.where("srch_id % 2 = 0"), t.impressions.where("srch_id % 2 = 1")),
      _overlap_verdict("(SELECT * FROM imp WHERE srch_id % 2 = 0)", "(SELECT * FROM imp WHERE srch_id % 2 = 1)"),
      ints="left_days right_days common_days", texts="verdict")
for name, col, n, keep in (("location1", "prop_location_score1", 20, "true"), ("location2", "prop_location_score2", 20, "true"),
                           ("history", "prop_log_historical_price", 10, "prop_log_historical_price > 0"), ("price", "price_usd", 50, "true")):
    query(f"a42_{name}_bins", lambda t, col=col, n=n, keep=keep: A.quantile_rates(t.impressions.where(keep), col, n),
          rate_sql(qbin(f"(SELECT * FROM imp WHERE {keep})", col, n), "bin", "bin_hi"), ints="bin n", nums="bin_hi " + R_NUMS)
query("a42_value_score_bins", lambda t: A.quantile_rates(quality(t.impressions).withColumn("value_score", F.round("value_score", 9)), "value_score", 20),
      rate_sql(qbin("(SELECT * REPLACE (round(value_score, 9) AS value_score) FROM rowf)", "value_score", 20), "bin", "bin_hi"), ints="bin n", nums="bin_hi " + R_NUMS)
query("a43_rates_by_presence", lambda t: A.rates(A.stack_segments(t.impressions, {
    "visitor_history": flag(F.col("visitor_hist_starrating").isNotNull()), "historical_price": flag(F.col("prop_log_historical_price") > 0),
    "location_score2": flag(F.col("prop_location_score2").isNotNull())}), "dimension", "segment"), " UNION ALL ".join(
        rate_sql("rowf", f"'{n}' AS dimension", f"({e})::VARCHAR AS segment") for n, e in (
            ("visitor_history", "has_visitor_history"), ("historical_price", "has_historical_price"), ("location_score2", "has_location_score2"))),
      ints="n", nums=R_NUMS, texts="dimension segment")
query("a44_brand_by_star", lambda t: A.rates(t.impressions, "prop_brand_bool", "prop_starrating"), rate_sql("imp", "prop_brand_bool", "prop_starrating"),
      ints="prop_brand_bool prop_starrating n", nums=R_NUMS)
query("a44_promotion_by_price", lambda t: A.rates(A.with_quantile_bin(t.impressions, "price_usd", 5), "promotion_flag", "bin"),
      rate_sql(qbin("imp", "price_usd", 5), "promotion_flag", "bin"), ints="promotion_flag bin n", nums=R_NUMS)
