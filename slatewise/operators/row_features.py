"""Features computed from one row alone: projections, no shuffle."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions.exprs import clip, finite, flag, label, null_if, num, ratio, total, zero_as
from ..functions.groups import quantiles
from ..schema import comp_columns


def _present(cols, value=1):
    return total([F.when(F.col(c).isNotNull(), value).otherwise(0) for c in cols])


def _matching(cols, value):
    return total([flag(F.col(c) == value) for c in cols])


def temporal(df):
    day = F.weekday("date_time")
    return df.withColumns({"month": F.month("date_time"), "hour": F.hour("date_time"),
                           "dayofweek": day, "is_weekend_search": flag(day >= 5)})


def missing_flags(df):
    seen = {"has_location_score2": "prop_location_score2",
            "has_visitor_history": "visitor_hist_starrating",
            "has_query_affinity": "srch_query_affinity_score",
            "has_distance": "orig_destination_distance"}
    out = {name: flag(F.col(c).isNotNull()) for name, c in seen.items()}
    out["has_historical_price"] = flag(F.col("prop_log_historical_price") > 0)
    return df.withColumns(out)


def price(df):
    usd = num("price_usd")
    past = null_if(F.exp("prop_log_historical_price"), 1.0)
    return df.withColumns({
        "price_diff_from_hist": usd - past,
        "price_ratio_to_hist": ratio(usd, past),
        "price_per_night": ratio(usd, zero_as("srch_length_of_stay", 1)),
        "total_cost": usd * F.col("srch_length_of_stay"),
        "price_per_person": ratio(usd, zero_as("srch_adults_count", 1)),
        "price_per_room": ratio(usd, zero_as("srch_room_count", 1)),
        "log_price": F.log1p(usd),
        "log_distance": F.log1p("orig_destination_distance"),
    })


def visitor_match(df):
    gap = F.col("visitor_hist_starrating") - F.col("prop_starrating")
    return df.withColumns({
        "star_diff": gap, "abs_star_diff": F.abs(gap),
        "price_diff_from_visitor_hist": F.col("visitor_hist_adr_usd") - F.col("price_usd"),
        "price_ratio_to_visitor_hist": ratio("price_usd", "visitor_hist_adr_usd"),
    })


def competitors(df):
    """Horizontal aggregates over the eight competitors, missing ones left out."""
    rate, inv, pct = comp_columns("rate"), comp_columns("inv"), comp_columns("rate_percent_diff")
    cheaper, dearer = _matching(rate, -1), _matching(rate, 1)
    pct_sum = total([F.coalesce(F.col(c), F.lit(0.0)) for c in pct])
    return df.withColumns({
        "comp_rate_sum": total([F.coalesce(F.col(c), F.lit(0)) for c in rate]),
        "comp_rate_count": _present(rate),
        "comp_cheaper_count": cheaper,
        "comp_more_expensive_count": dearer,
        "comp_rate_advantage": dearer - cheaper,
        "comp_inv_count": _present(inv),
        "comp_no_inv_count": _matching(inv, 1),
        "comp_rate_pct_mean": ratio(pct_sum, _present(pct)),
        "comp_rate_pct_min": F.least(*pct),
        "comp_rate_pct_max": F.greatest(*pct),
    })


def drop_competitor_columns(df):
    return df.drop(*comp_columns("rate"), *comp_columns("inv"), *comp_columns("rate_percent_diff"))


def quality(df):
    return df.withColumns({
        "value_score": ratio("prop_starrating", F.log1p("price_usd")),
        "star_review_product": F.col("prop_starrating") * F.col("prop_review_score"),
        "location_total": F.col("prop_location_score1") + F.coalesce("prop_location_score2", F.lit(0.0)),
        "is_domestic": flag(F.col("visitor_location_country_id") == F.col("prop_country_id")),
        "starrating_is_zero": flag(F.col("prop_starrating") == 0),
        "review_is_zero": flag(F.col("prop_review_score") == 0),
    })


def interactions(df):
    """Needs price(), quality() and, for promo_x_cheap, the listwise price_rank_norm."""
    star = zero_as("prop_starrating", 1)
    out = {
        "price_per_star": ratio("price_usd", star),
        "price_per_night_per_star": ratio(ratio("price_usd", zero_as("srch_length_of_stay", 1)), star),
        "star_x_brand": F.col("prop_starrating") * F.col("prop_brand_bool"),
        "query_affinity_exp": F.exp(clip("srch_query_affinity_score", hi=0.0)),
        "distance_x_international": F.col("log_distance") * (1 - F.col("is_domestic")),
    }
    if "price_rank_norm" in df.columns:
        out["promo_x_cheap"] = F.col("promotion_flag") * (1 - F.col("price_rank_norm"))
    return df.withColumns(out)


def booking_window(df):
    days = F.col("srch_booking_window")
    return df.withColumns({"is_last_minute": flag(days <= 1),
                           "is_short_window": flag((days > 1) & (days <= 7)),
                           "is_long_window": flag(days > 30)})


def family(df):
    guests = F.col("srch_adults_count") + F.col("srch_children_count")
    return df.withColumns({"is_family": flag(F.col("srch_children_count") > 0), "total_guests": guests,
                           "price_per_guest": ratio("price_usd", zero_as(guests, 1))})


def deals(df):
    r = F.col("price_ratio_to_hist")
    return df.withColumns({"is_discounted": flag(r < 0.9), "is_overpriced": flag(r > 1.2)})


def relevance(df):
    return df.withColumn("relevance", label())


def gain_class(df, column="relevance"):
    """Label remap {0,1,5} to the classes {0,1,2}."""
    c = F.col(column)
    return df.withColumn("gain_class", F.when(c == 5, 2).when(c == 1, 1).when(c == 0, 0))


def label_gain(df, gains, column="gain_class"):
    """Gain of a class from a triple such as (0, 1, 5)."""
    return df.withColumn("label_gain", F.element_at(F.array(*map(F.lit, gains)), F.col(column) + 1))


def clean_non_finite(df, columns=None):
    """NULL in place of NaN and infinities in the double columns."""
    columns = columns or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: finite(c) for c in columns})


def expected_cost(df):
    cost = F.col("price_usd") * F.greatest(F.col("srch_length_of_stay"), F.lit(1))
    return df.withColumns({"expected_cost": cost, "gross_to_expected": ratio("gross_bookings_usd", cost)})


# Later feature ideas. All of them need listwise columns or encodings.

def price_premium_window(df, train):
    """Premium over the item's mean price (limited at the training p99), damped by lead time."""
    floor0 = train.select(clip("price_vs_prop_mean", 0.0).alias("v"))
    p99 = quantiles(floor0, "v", [0.99]).select(F.col("q")[0]).scalar()
    premium = clip("price_vs_prop_mean", 0.0, p99)
    damp = ratio(F.lit(1.0), F.log1p(F.col("srch_booking_window") + 1.0))
    dear = (F.col("price_vs_prop_mean") > 0) & (F.col("srch_booking_window") <= 30)
    return df.withColumns({"price_premium_vs_prop_hist_x_short_window": premium * damp,
                           "is_price_premium_x_short_window": flag(dear)})


def long_window_top_price(df):
    far, dear = flag(F.col("srch_booking_window") > 30), flag(F.col("price_rank_norm") >= 0.75)
    return df.withColumn("is_long_window_x_top_quartile_price", far * dear)


def rarity_long_trip(df):
    rare = ratio(F.lit(1.0), F.log1p("prop_count"))
    return df.withColumn("prop_rare_x_long_trip", rare * F.log1p("srch_length_of_stay"))


def brand_domestic(df):
    return df.withColumn("brand_x_domestic", F.col("prop_brand_bool") * F.col("is_domestic"))


def query_difficulty(df):
    index = F.log1p("query_hotel_count") * (1 - F.col("dest_click_rate"))
    return df.withColumn("query_difficulty_index", index)


def destination_products(df):
    rate = F.col("dest_click_rate")
    return df.withColumns({"price_vs_mean_x_dest_click": F.col("price_vs_mean") * rate,
                           "price_vs_prop_mean_x_dest_click": F.col("price_vs_prop_mean") * rate})


def clipped_zscore_product(df, bound=5.0):
    z = clip("prop_price_zscore", -bound, bound)
    return df.withColumn("prop_price_zscore_clipped_x_dest_click", z * F.col("dest_click_rate"))


def clipped_counts(df, bound=5.0, column="prop_price_zscore"):
    """How many rows the limit touches at either end."""
    return df.agg(F.sum(flag(F.col(column) < -bound)).alias("clipped_lo"),
                  F.sum(flag(F.col(column) > bound)).alias("clipped_hi"))


ROW_STEPS = (temporal, missing_flags, price, visitor_match, competitors, drop_competitor_columns, quality)
#: The steps that make the columns which listwise features rank, or make a row narrower.
RANKED_STEPS = (competitors, drop_competitor_columns, quality)
INTERACTION_STEPS = (interactions, booking_window, family, deals)


def apply(df, steps):
    return reduce(lambda d, step: d.transform(step), steps, df)
