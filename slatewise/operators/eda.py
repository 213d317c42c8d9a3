"""Exploratory profiles: rates, distributions, missingness, variance, correlations."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import flag, num, ratio, total
from ..functions.groups import Rank, Stat, hot_groups, quantiles, within
from ..functions.small import small_table
from ..functions.stats import bin_of, chi_square_2x2, corr_of, quantile_edges
from ..schema import SEARCH, column_group, comp_columns


def long_form(df, columns, ids=()):
    """(ids, feature, value) rows of numeric columns."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), num(c).alias("value")) for c in columns]))
    return df.select(*ids, cells.alias("x")).select(*ids, "x.*")


def rates(df, *keys, **extra):
    """Rows, click and booking rate per group; `extra` adds named aggregates."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("click_bool").alias("click_rate"),
                                 F.avg("booking_bool").alias("booking_rate"),
                                 *[e.alias(n) for n, e in extra.items()])


def with_quantile_bin(df, value, n, name="bin"):
    """Add the quantile bin and its right edge, rows without a value dropped."""
    df = df.where(num(value).isNotNull()).withColumn("_e", quantile_edges(df, value, n))
    return df.withColumn(name, bin_of(value, F.col("_e"))).withColumn(
        f"{name}_hi", F.col("_e")[F.col(name)]).drop("_e")


def quantile_rates(df, value, n):
    """Rates per quantile bin of a column."""
    return rates(with_quantile_bin(df, value, n), "bin", "bin_hi")


def decile_rates(df, features, n=10):
    """Rates per quantile bin of many columns in one pass over the table."""
    probs = [i / n for i in range(n + 1)]
    long = long_form(df, features, ["click_bool", "booking_bool"]).where(F.col("value").isNotNull())
    edges = small_table(quantiles(long, "value", probs, ["feature"]).select("feature", F.array_distinct("q").alias("e")))
    return rates(long.join(edges, "feature").withColumn("bin", bin_of("value", F.col("e"))), "feature", "bin")


def cut_rates(df, value, edges, lowest=False):
    at = F.array(*[F.lit(float(e)) for e in edges])
    binned = df.withColumn("bin", bin_of(value, at, lowest)).where(F.col("bin").isNotNull())
    return rates(binned, "bin")


def log_edges(df, value, n):
    """n + 1 edges evenly spaced on the logarithm between minimum + 1 and maximum."""
    lo, hi = F.log10(F.min(num(value)) + 1), F.log10(F.max(num(value)))
    return df.agg(F.array(*[F.pow(F.lit(10.0), lo + (hi - lo) * F.lit(i / n)) for i in range(n + 1)])).scalar()


def log_bin_rates(df, value, n):
    binned = df.withColumn("_e", log_edges(df, value, n)).withColumn("bin", bin_of(value, F.col("_e"), False))
    return rates(binned.where(F.col("bin").isNotNull()), "bin")


def histogram(df, value, n, log=False, upper=None):
    """Counts per equal-width bin, optionally of log1p values or of values limited to a quantile."""
    v = F.log1p(num(value)) if log else num(value)
    d = df.select(v.alias("v")).where(F.col("v").isNotNull())
    if upper is not None:
        top = quantiles(d, "v", [upper]).select(F.col("q")[0]).scalar()
        d = d.select(F.least("v", top).alias("v"))
    span = d.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    share = ratio(F.col("v") - span["lo"], span["hi"] - span["lo"])
    at = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * n), F.lit(n - 1))
    return d.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def column_inventory(df, columns, approximate=False):
    """Type, group, nulls, distinct values, range and mean of every column.

    Values are counted first, so the exact distinct count needs no set of all
    values in one place. `approximate` trades it for a sketch in one pass.
    """
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, df.schema[c].dataType.simpleString())])
    groups = F.create_map(*[F.lit(x) for c in columns for x in (c, column_group(c))])
    long = long_form(df, columns)
    if approximate:
        out = long.groupBy("feature").agg(
            F.approx_count_distinct("value").alias("n_unique"), F.count_if(F.col("value").isNull()).alias("n_null"),
            F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
    else:
        counted = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
        present = F.when(F.col("value").isNotNull(), F.col("c"))
        out = counted.groupBy("feature").agg(
            F.count("value").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0)).alias("n_null"),
            F.min("value").alias("min"), F.max("value").alias("max"),
            ratio(F.sum(F.col("value") * F.col("c")), F.sum(present)).alias("mean"))
    return out.withColumns({"dtype": types[F.col("feature")], "column_group": groups[F.col("feature")]})


def missing_share(df, columns, by=()):
    """Share of missing values per column (and segment)."""
    agg = df.groupBy(*by).agg(*[F.avg(flag(F.col(c).isNull())).alias(c) for c in columns])
    return agg.unpivot(list(by), list(columns), "feature", "missing")


def missing_drift(left, right, columns):
    a = missing_share(left, columns).withColumnRenamed("missing", "missing_left")
    b = missing_share(right, columns).withColumnRenamed("missing", "missing_right")
    return a.join(b, "feature").withColumn("drift", F.col("missing_right") - F.col("missing_left"))


def missing_correlation(df, columns, min_share=None):
    """Correlation of the missing flags of every pair of columns (that lack more than `min_share` of their values).

    The table is first counted by pattern of missing flags. Single columns and the pairs
    missing together are then sums over the few patterns, so the plan grows with the columns
    and not with their pairs.
    """
    names = sorted(columns)
    flags = df.select(*[flag(F.col(c).isNull()).alias(c) for c in names])
    patterns = small_table(flags.groupBy(*names).agg(F.count(F.lit(1)).alias("_c")))
    one = F.array(*[F.struct(F.lit(c).alias("a"), F.sum(F.col("_c") * num(c)).alias("s")) for c in names])
    single = small_table(patterns.agg(F.sum("_c").alias("n"), one.alias("x")).where("n IS NOT NULL").select("n", F.explode("x").alias("x")).select("n", "x.*"))
    gone = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in names]))
    firsts = patterns.select("_c", gone.alias("gone")).select("_c", "gone", F.explode("gone").alias("a"))
    both = firsts.select("_c", "a", F.explode(F.filter("gone", lambda c: c > F.col("a"))).alias("b")).groupBy("a", "b").agg(
        F.sum(num("_c")).alias("sxy"))
    right = single.select(F.col("a").alias("b"), F.col("s").alias("sy"))
    s = single.withColumnRenamed("s", "sx").join(right, F.col("a") < F.col("b")).join(both, ["a", "b"], "left")
    n, sx, sy = num("n"), num("sx"), num("sy")
    if min_share is not None:
        s = s.where(F.least("sx", "sy") / F.col("n") > min_share)
    top = n * F.coalesce("sxy", F.lit(0.0)) - sx * sy
    return s.select("a", "b", F.try_divide(top, F.sqrt((n * sx - sx * sx) * (n * sy - sy * sy))).alias("corr"))


def informative_missingness(df, columns, min_share=0.01):
    """Rates where a column is present and missing, with the chi-square of the click table."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), flag(F.col(c).isNull()).alias("gone")) for c in columns]))
    long = df.select("click_bool", "booking_bool", cells.alias("x")).select("click_bool", "booking_bool", "x.*")
    gone, click = F.col("gone") == 1, F.col("click_bool") == 1
    s = long.groupBy("feature").agg(
        F.avg("gone").alias("missing"),
        F.avg(F.when(~gone, F.col("click_bool"))).alias("click_present"), F.avg(F.when(gone, F.col("click_bool"))).alias("click_missing"),
        F.avg(F.when(~gone, F.col("booking_bool"))).alias("book_present"), F.avg(F.when(gone, F.col("booking_bool"))).alias("book_missing"),
        F.count_if(~gone & ~click).alias("a"), F.count_if(~gone & click).alias("b"),
        F.count_if(gone & ~click).alias("c"), F.count_if(gone & click).alias("d"))
    return s.where(F.col("missing") > min_share).withColumn("chi2", chi_square_2x2("a", "b", "c", "d")).drop("a", "b", "c", "d")


def with_competitor_count(df):
    return df.withColumn("n_comp", total([flag(F.col(c).isNotNull()) for c in comp_columns("rate")]))


def competitor_long(df, keep=("click_bool", "booking_bool")):
    """One row per (impression, competitor) with its rate, inventory and difference."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("competitor"), F.col(r).alias("rate"), F.col(v).alias("inv"), F.col(p).alias("pct"))
        for i, (r, v, p) in enumerate(zip(comp_columns("rate"), comp_columns("inv"), comp_columns("rate_percent_diff")))]))
    return df.select(*keep, cells.alias("x")).select(*keep, "x.*")


def competitor_availability(df):
    return competitor_long(df).groupBy("competitor").agg(
        F.avg(flag(F.col("rate").isNotNull())).alias("rate_share"), F.avg(flag(F.col("inv").isNotNull())).alias("inv_share"),
        F.avg(flag(F.col("pct").isNotNull())).alias("pct_share"))


def competitor_booking_pivot(df):
    """Booking rate of each competitor by its rate value -1, 0, 1."""
    return (competitor_long(df).where(F.col("rate").isNotNull()).groupBy("competitor")
            .pivot("rate", [-1, 0, 1]).agg(F.avg("booking_bool")).toDF("competitor", "cheaper", "same", "dearer"))


def availability_by(df, key):
    return with_competitor_count(df).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_comp").alias("mean_competitors"), F.avg(flag(F.col("n_comp") > 0)).alias("any_competitor"))


def value_counts(df, column, top=15):
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(top)


def describe(df, value, probs=(0.25, 0.5, 0.75, 0.9, 0.99)):
    """Count, mean, deviation, extremes and exact quantiles of a column: one row."""
    q = quantiles(df.select(num(value).alias("v")), "v", probs).select("q").scalar()
    out = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                 F.min(num(value)).alias("min"), F.max(num(value)).alias("max"))
    return out.withColumns({f"p{round(p * 100)}": q[i] for i, p in enumerate(probs)})


def frequency_profile(df, key):
    """How often keys occur: distribution of rows per key."""
    return describe(df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")), "n_rows")


def iqr_outliers(df, columns):
    long = long_form(df, columns).where(F.col("value").isNotNull())
    q = quantiles(long, "value", [0.25, 0.75], ["feature"])
    fences = small_table(q.select("feature", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).withColumns({
        "lower": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "upper": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))}))
    return long.join(fences, "feature").groupBy("feature", "q1", "q3", "lower", "upper").agg(
        F.count_if(F.col("value") < F.col("lower")).alias("n_below"), F.count_if(F.col("value") > F.col("upper")).alias("n_above"),
        F.count(F.lit(1)).alias("n")).withColumn("share", ratio(F.col("n_below") + F.col("n_above"), "n"))


SIGNATURE = ("visitor_location_country_id", "srch_destination_id", "srch_length_of_stay", "srch_adults_count",
             "srch_children_count", "srch_room_count")


def repeated_searches(df, signature=SIGNATURE):
    """Search signatures used by more than one search."""
    return df.groupBy(*signature).agg(F.countDistinct(SEARCH).alias("n_searches")).where("n_searches > 1")


def daily_searches(df, span=3):
    """Searches per day and the centred mean over full windows of 2 * span + 1 days present."""
    days = df.groupBy(F.to_date("date_time").alias("day")).agg(F.countDistinct(SEARCH).alias("n_searches"))
    # one row per calendar day: the whole window is a few thousand rows at any scale
    w = W.partitionBy(F.lit(1)).orderBy("day").rowsBetween(-span, span)
    full = F.count(F.lit(1)).over(w) == 2 * span + 1
    return days.withColumn("rolling", F.when(full, F.avg("n_searches").over(w)))


def with_time_parts(df):
    return df.withColumns({"hour": F.hour("date_time"), "dayofweek": F.weekday("date_time"), "month": F.month("date_time"),
                           "iso_year": F.extract(F.lit("YEAROFWEEK"), F.col("date_time")), "iso_week": F.weekofyear("date_time")})


def label_crosstab(df):
    """Rows by click and booking with margins (NULL marks a margin)."""
    return df.cube("click_bool", "booking_bool").agg(F.count(F.lit(1)).alias("n"))


def booking_without_click(df):
    return df.agg(F.count_if((F.col("booking_bool") == 1) & (F.col("click_bool") == 0)).alias("violations"),
                  F.sum("booking_bool").alias("bookings"))


def events_per_search(df, event):
    """Distribution of clicks or bookings per search."""
    per = df.groupBy(SEARCH).agg(F.sum(event).alias("events"))
    return per.groupBy("events").agg(F.count(F.lit(1)).alias("n_searches"))


def signal_breakdown(df):
    """Searches without a click, with clicks only, with a booking; and how their rows differ."""
    df = within(df, [SEARCH], stats=[Stat("_c", F.sum("click_bool")), Stat("_b", F.sum("booking_bool"))])
    kind = F.when(F.col("_b") > 0, "booked").when(F.col("_c") > 0, "clicked").otherwise("none")
    rows = df.withColumn("kind", kind)
    return rows.groupBy("kind").agg(
        F.countDistinct(SEARCH).alias("n_searches"), F.count(F.lit(1)).alias("n_rows"), F.avg("price_usd").alias("price"),
        F.avg("prop_starrating").alias("stars"), F.avg("prop_review_score").alias("review"),
        F.avg("prop_location_score1").alias("location"), F.avg("random_bool").alias("random_share"))


def outcome_means(df, columns):
    """Means of booked, clicked-only and ignored rows, and the booked-ignored difference."""
    booked, clicked = F.col("booking_bool") == 1, F.col("click_bool") == 1
    long = long_form(df, columns, ["booking_bool", "click_bool"])
    out = long.groupBy("feature").agg(F.avg(F.when(booked, F.col("value"))).alias("booked"),
                                      F.avg(F.when(clicked & ~booked, F.col("value"))).alias("clicked_only"),
                                      F.avg(F.when(~clicked, F.col("value"))).alias("ignored"))
    return out.withColumn("difference", F.col("booked") - F.col("ignored"))


def gross_agreement(df):
    """How well price times nights explains the gross booking value."""
    cost = F.col("price_usd") * F.greatest(F.col("srch_length_of_stay"), F.lit(1))
    d = df.where(F.col("gross_bookings_usd").isNotNull()).select(num("gross_bookings_usd").alias("y"), cost.alias("x"))
    out = d.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") - F.col("x")) * (F.col("y") - F.col("x"))).alias("sse"),
                (F.var_pop("y") * F.count("y")).alias("sst"), F.avg(ratio("y", "x")).alias("ratio_mean"),
                F.avg(flag(F.abs(ratio("y", "x") - 1) < 0.05)).alias("share_near_one"))
    return out.select("n", (1 - F.try_divide("sse", "sst")).alias("r2"), "ratio_mean", "share_near_one")


def rate_pivot(df, row, column, values, measure="booking_bool"):
    """Two-way table of mean and count of a measure, columns given by value."""
    out = df.groupBy(row).pivot(column, values).agg(F.avg(measure).alias("rate"), F.count(F.lit(1)).alias("n"))
    return out.toDF(row, *[f"{kind}_{v}" for v in values for kind in ("rate", "n")])


def variance_ratio(df, columns):
    """Mean within-search variance over total variance, with its tier."""
    long = long_form(df, columns, [SEARCH])
    per = long.groupBy(SEARCH, "feature").agg(F.var_samp("value").alias("v"))
    inside = per.groupBy("feature").agg(F.avg("v").alias("within_variance"))
    out = long.groupBy("feature").agg(F.var_samp("value").alias("total_variance")).join(inside, "feature")
    out = out.where(F.col("total_variance") > 0).withColumn("variance_ratio", ratio(F.coalesce("within_variance", F.lit(0.0)), "total_variance"))
    r = F.col("variance_ratio")
    return out.withColumn("tier", F.when(r > 0.3, "ranking signal").when(r < 0.01, "constant in query").otherwise("partial"))


def slate_spread(df):
    """Per search: price deviation, range, interquartile range, coefficient of variation, star variety."""
    q = quantiles_per_slate(df, "price_usd", [0.25, 0.75])
    per = df.groupBy(SEARCH).agg(F.stddev_samp("price_usd").alias("price_std"), (F.max("price_usd") - F.min("price_usd")).alias("price_range"),
                                 F.avg("price_usd").alias("price_mean"), F.countDistinct("prop_starrating").alias("n_stars"))
    return per.join(q.select(SEARCH, (F.col("q")[1] - F.col("q")[0]).alias("price_iqr")), SEARCH).withColumn(
        "price_cv", ratio("price_std", "price_mean"))


def quantiles_per_slate(df, value, probs):
    """Quantiles inside searches: a grouped percentile, or the sliced way for oversized searches."""
    points = F.array(*[F.lit(float(p)) for p in probs])

    def plain(d):
        return d.groupBy(SEARCH).agg(F.percentile(num(value), points).alias("q"))

    hot = hot_groups(df, [SEARCH])
    if hot is None:
        return plain(df)
    d = df.select(SEARCH, num(value).alias("_v"))
    return plain(df.join(hot, SEARCH, "left_anti")).unionByName(quantiles(d.join(hot, SEARCH, "left_semi"), "_v", probs, [SEARCH]))


def within_search_spearman(df, features, target="relevance", min_rows=5):
    """Mean and median over searches of the Spearman correlation of each feature with the target."""
    long = long_form(df, features, [SEARCH, "prop_id", target]).where(F.col("value").isNotNull() & F.col(target).isNotNull())
    keys = [SEARCH, "feature"]
    r = within(long, keys, ranks=[Rank("_x", "value", method="average"), Rank("_y", target, method="average")])
    per = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), corr_of("_x", "_y").alias("rho"))
    per = per.where((F.col("_n") >= min_rows) & F.col("rho").isNotNull())
    mid = quantiles(per, "rho", [0.5], ["feature"])
    return per.groupBy("feature").agg(F.avg("rho").alias("mean_rho"), F.count(F.lit(1)).alias("n_searches")).join(
        mid.select("feature", F.col("q")[0].alias("median_rho")), "feature")


def stack_segments(df, segments):
    """Repeat rows once per segmentation: {name: column expression} becomes (dimension, segment)."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), e.cast("string").alias("segment")) for n, e in segments.items()]))
    return df.select("*", cells.alias("_s")).select(*df.columns, "_s.*").where(F.col("segment").isNotNull())


POPULARITY_EDGES = (0, 5, 20, 50, 100, float("inf"))


def with_popularity(df, key="prop_id", source=None):
    """Bucket 1..5 of how often the item occurs (up to 5, 20, 50, 100, more)."""
    counts = (df if source is None else source).groupBy(key).agg(F.count(F.lit(1)).alias("impressions"))
    at = F.array(*[F.lit(float(e)) for e in POPULARITY_EDGES])
    return df.join(counts, key, "left").withColumn("popularity", bin_of(F.coalesce("impressions", F.lit(0)), at, False))


def conditional_means(df, condition, columns):
    """Means of columns where a flag is 1 and where it is 0."""
    long = long_form(df, columns, [condition])
    return long.groupBy("feature").agg(F.avg(F.when(F.col(condition) == 1, F.col("value"))).alias("mean_yes"),
                                       F.avg(F.when(F.col(condition) == 0, F.col("value"))).alias("mean_no"))


def group_size_distribution(df, by=()):
    per = df.groupBy(*by, SEARCH).agg(F.count(F.lit(1)).alias("group_size"))
    return per.groupBy(*by, "group_size").agg(F.count(F.lit(1)).alias("n_searches"))


def date_overlap(left, right):
    """Days of two tables: counts, common days, and how their periods relate.

    `temporal` where the periods do not touch, `same period` where more than half of
    the days of the larger side are common, else `partial`.
    """
    days = [d.select(F.to_date("date_time").alias("day")).distinct() for d in (left, right)]
    both = days[0].withColumn("l", F.col("day")).join(days[1].withColumn("r", F.col("day")), "day", "full")
    out = both.agg(F.count("l").alias("left_days"), F.count("r").alias("right_days"), F.count_if(F.col("l") == F.col("r")).alias("common_days"),
                   F.min("l").alias("_l0"), F.max("l").alias("_l1"), F.min("r").alias("_r0"), F.max("r").alias("_r1"))
    apart = (F.col("_l1") < F.col("_r0")) | (F.col("_r1") < F.col("_l0"))
    much = 2 * F.col("common_days") > F.greatest("left_days", "right_days")
    return out.withColumn("verdict", F.when(apart, "temporal").when(much, "same period").otherwise("partial")).drop("_l0", "_l1", "_r0", "_r1")


def by_price_rank(df, limit=30):
    """Rates by price rank inside the slate, up to a rank."""
    ranked = within(df, [SEARCH], ranks=[Rank("price_rank", "price_usd")])
    return rates(ranked.where(F.col("price_rank") <= limit), "price_rank")
