"""Features of an item relative to the other items of its slate.

All ranks and statistics are asked of `within` in one call, so a slate table
is shuffled once (not at all when it is bucketed by search).
"""

from pyspark.sql import functions as F

from ..functions.exprs import flag, num, ratio, zero_as
from ..functions.groups import Rank, Stat, within
from ..schema import SEARCH

# name -> (source column, descending): minimum ranks inside the slate
RANKED = {
    "price_rank": ("price_usd", False),
    "starrating_rank": ("prop_starrating", True),
    "review_rank": ("prop_review_score", True),
    "location1_rank": ("prop_location_score1", True),
    "location2_rank": ("prop_location_score2", True),
}
DERIVED_RANKED = {
    "location_total_rank": ("location_total", True),
    "value_score_rank": ("value_score", True),
    "comp_advantage_rank": ("comp_rate_advantage", True),
}
PERCENTILES = {"price_percentile": "price_usd", "star_percentile": "prop_starrating",
               "review_percentile": "prop_review_score"}
ENCODINGS = ("prop_click_rate", "prop_book_rate", "prop_rel_rate", "dest_click_rate", "dest_book_rate",
             "country_book_rate", "site_book_rate", "prop_dest_book_rate", "site_dest_book_rate",
             "prop_site_book_rate", "cpair_book_rate", "site_country_book_rate")


def rank_in_group(df, column, name, method="min", asc=True, by=(SEARCH,)):
    return within(df, by, ranks=[Rank(name, column, not asc, method)])


def pct_rank_in_group(df, columns, suffix="_rank_norm", asc=True, by=(SEARCH,)):
    """Average-tie percentile rank of several columns, such as the 12 encodings."""
    return within(df, by, ranks=[Rank(c + suffix, c, not asc, "average", pct=True) for c in columns])


def add_listwise(df, search=SEARCH):
    """All listwise columns; derived ranks appear where their source column exists."""
    ranked = dict(RANKED)
    ranked.update({n: s for n, s in DERIVED_RANKED.items() if s[0] in df.columns})
    ranks = [Rank(n, c, desc) for n, (c, desc) in ranked.items()]
    ranks += [Rank(n, c, method="average", pct=True) for n, c in PERCENTILES.items()]
    stats = [
        Stat("query_hotel_count", F.count("price_usd")),
        Stat("query_price_mean", F.avg("price_usd")), Stat("query_price_std", F.stddev_samp("price_usd")),
        Stat("_price_median", median="price_usd"), Stat("_price_min", F.min("price_usd")),
        Stat("_price_max", F.max("price_usd")), Stat("query_star_mean", F.avg("prop_starrating")),
        Stat("_star_max", F.max("prop_starrating")), Stat("_review_mean", F.avg("prop_review_score")),
        Stat("_review_max", F.max("prop_review_score")), Stat("_loc1_mean", F.avg("prop_location_score1")),
        Stat("_loc1_max", F.max("prop_location_score1")), Stat("_loc2_mean", F.avg("prop_location_score2")),
        Stat("_log_mean", F.avg(F.log1p("price_usd"))), Stat("_log_std", F.stddev_samp(F.log1p("price_usd"))),
    ]
    df = within(df, [search], ranks, stats)
    size, usd = F.col("query_hotel_count"), num("price_usd")
    df = df.withColumns({f"{n}_norm": ratio(n, size) for n in ranked})
    df = df.withColumns({
        "price_vs_mean": usd - F.col("query_price_mean"),
        "price_vs_median": usd - F.col("_price_median"),
        "price_vs_min": usd - F.col("_price_min"),
        "price_vs_max": F.col("_price_max") - usd,
        "price_z_score": ratio(usd - F.col("query_price_mean"), zero_as("query_price_std", 1.0)),
        "star_vs_mean": F.col("prop_starrating") - F.col("query_star_mean"),
        "review_vs_mean": F.col("prop_review_score") - F.col("_review_mean"),
        "loc1_vs_mean": F.col("prop_location_score1") - F.col("_loc1_mean"),
        "loc2_vs_mean": F.col("prop_location_score2") - F.col("_loc2_mean"),
        "log_price_z_score": ratio(F.log1p(usd) - F.col("_log_mean"), zero_as("_log_std", 1.0)),
        "price_to_min_ratio": ratio(usd, zero_as("_price_min", 1.0)),
        "is_cheapest": flag(F.col("price_rank") == 1),
        "is_most_expensive": flag(usd == F.col("_price_max")),
        "is_best_star": flag(F.col("prop_starrating") == F.col("_star_max")),
        "is_best_review": flag(F.col("prop_review_score") == F.col("_review_max")),
        "is_best_location1": flag(F.col("prop_location_score1") == F.col("_loc1_max")),
        "quality_rank_avg": (F.col("starrating_rank_norm") + F.col("review_rank_norm")
                             + F.col("location1_rank_norm")) / 3,
    })
    df = df.withColumns({
        "value_gap": F.col("quality_rank_avg") - F.col("price_rank_norm"),
        "n_best_flags": (F.col("is_cheapest") + F.col("is_best_star") + F.col("is_best_review")
                         + F.col("is_best_location1")),
    })
    return df.drop(*[s.name for s in stats if s.name.startswith("_")])


def candidate_spread(df, search=SEARCH):
    """Slate size and price range on every row."""
    df = within(df, [search], stats=[Stat("candidate_count", F.count(F.lit(1))),
                                     Stat("_lo", F.min("price_usd")), Stat("_hi", F.max("price_usd"))])
    return df.withColumn("price_spread", F.col("_hi") - F.col("_lo")).drop("_lo", "_hi")
