"""Columns of an impression table: one row is one item shown in one search."""

from pyspark.sql import types as T

SEARCH = "srch_id"
ITEM = "prop_id"
KEY = (SEARCH, ITEM)
COMPETITORS = range(1, 9)

# The input layout, the columns only labelled data has, and the
# columns that may never reach a model.
TRAIN_ONLY = ("position", "click_bool", "booking_bool", "gross_bookings_usd")
FORBIDDEN = ("position", "click_bool", "booking_bool", "gross_bookings_usd",
             "random_bool", "relevance", "date_time")
NON_FEATURES = ("srch_id", "prop_id", "date_time", "position", "click_bool",
                "booking_bool", "gross_bookings_usd", "random_bool", "relevance")
MISSING_TOKEN = "NULL"

COLUMN_GROUPS = {
    "search": ("srch_id", "date_time", "site_id", "srch_destination_id", "srch_length_of_stay",
               "srch_booking_window", "srch_adults_count", "srch_children_count",
               "srch_room_count", "srch_saturday_night_bool", "srch_query_affinity_score",
               "random_bool"),
    "visitor": ("visitor_location_country_id", "visitor_hist_starrating", "visitor_hist_adr_usd",
                "orig_destination_distance"),
    "item": ("prop_country_id", "prop_id", "prop_starrating", "prop_review_score",
             "prop_brand_bool", "prop_location_score1", "prop_location_score2",
             "prop_log_historical_price", "price_usd", "promotion_flag"),
    "target": TRAIN_ONLY,
}

_TYPES = {
    "srch_id": T.LongType(), "prop_id": T.LongType(), "date_time": T.TimestampNTZType(),
    "visitor_hist_starrating": T.DoubleType(), "visitor_hist_adr_usd": T.DoubleType(),
    "prop_review_score": T.DoubleType(), "prop_location_score1": T.DoubleType(),
    "prop_location_score2": T.DoubleType(), "prop_log_historical_price": T.DoubleType(),
    "price_usd": T.DoubleType(), "srch_query_affinity_score": T.DoubleType(),
    "orig_destination_distance": T.DoubleType(), "gross_bookings_usd": T.DoubleType(),
}
_ORDER = (
    "srch_id", "date_time", "site_id", "visitor_location_country_id", "visitor_hist_starrating",
    "visitor_hist_adr_usd", "prop_country_id", "prop_id", "prop_starrating", "prop_review_score",
    "prop_brand_bool", "prop_location_score1", "prop_location_score2", "prop_log_historical_price",
    "position", "price_usd", "promotion_flag", "srch_destination_id", "srch_length_of_stay",
    "srch_booking_window", "srch_adults_count", "srch_children_count", "srch_room_count",
    "srch_saturday_night_bool", "srch_query_affinity_score", "orig_destination_distance",
    "random_bool",
)


def comp_columns(suffix):
    """The eight competitor columns with one suffix: rate, inv or rate_percent_diff."""
    return [f"comp{i}_{suffix}" for i in COMPETITORS]


def impression_schema(labelled=True):
    """Explicit schema of the raw files; unlabelled files lack the four train-only columns."""
    names = list(_ORDER)
    for i in COMPETITORS:
        names += [f"comp{i}_rate", f"comp{i}_inv", f"comp{i}_rate_percent_diff"]
    names += ["click_bool", "gross_bookings_usd", "booking_bool"]
    if not labelled:
        names = [n for n in names if n not in TRAIN_ONLY]

    def type_of(name):
        if name.endswith("rate_percent_diff"):
            return T.DoubleType()
        return _TYPES.get(name, T.IntegerType())

    return T.StructType([T.StructField(n, type_of(n)) for n in names])


def column_group(name):
    """Group of a raw column, `competitor` for the comp1..8 block, `engineered` otherwise."""
    if name.startswith("comp") and name[4:5].isdigit():
        return "competitor"
    for group, names in COLUMN_GROUPS.items():
        if name in names:
            return group
    return "engineered"
