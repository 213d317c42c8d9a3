"""Impression tables derived from the given order tables.

A search is one supplier in one quarter, an item is a part. The derivation is
the one in FIXTURES.md, expressed with DataFrame operators.
"""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import flag
from ..functions.groups import WINDOW_LIMIT, Rank, Stat, note_group_size, noted, within
from ..schema import impression_schema
from ..session import materialise, path_exists, shared_dir

#: A task sorts a bucket in several orders at once; so many rows stay in memory.
ROWS_PER_BUCKET = 250_000


def bucket_count(spark, rows):
    """One bucket is one task: enough of them for the data and for the cores."""
    shuffle, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    return int(max(min(shuffle, cores), rows // ROWS_PER_BUCKET + 1))


def derive_impressions(spark, sf_dir):
    """The impression table over lineitem, supplier and part, and its number of buckets (None with an oversized search).

    The lines of a search are brought together once, while they are narrow; items are
    picked, placed and written without another shuffle.
    """
    def read(name, *cols):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)

    lines = read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                 "l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
    lines = lines.join(read("supplier", F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    lines = lines.join(read("part", F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice"), "l_partkey")
    quarter = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
    lines = lines.select((F.col("l_suppkey") * 100 + quarter).alias("srch_id"),
                         F.col("l_partkey").alias("prop_id"), "*")
    # a search has no more items than lines
    sizes = lines.groupBy("srch_id").count().agg(F.max("count").alias("top"), F.sum("count").alias("rows")).first()
    buckets = bucket_count(spark, sizes["rows"] or 0) if (sizes["top"] or 0) <= WINDOW_LIMIT else None
    if buckets:
        lines = lines.repartition(buckets, "srch_id")
    # one row per (search, item): the first in a total order
    picked = F.min(F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_quantity",
                            "l_discount", "l_returnflag", "l_suppkey", "s_nationkey", "p_size",
                            "p_retailprice"))
    one = lines.groupBy("srch_id", "prop_id").agg(picked.alias("r")).select("srch_id", "prop_id", "r.*")
    if buckets:
        one = noted(one, "srch_id", sizes["top"] or 0)
    else:  # stored once: the group sizes and all columns come from this narrow table
        one = note_group_size(materialise(one, "candidates"), "srch_id")
    one = one.withColumn("click_bool", flag((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08)))
    bookable = F.when((F.col("click_bool") == 1) & (F.col("srch_id") % 10 < 7), F.col("l_quantity"))
    one = within(one, ["srch_id"],
                 ranks=[Rank("position", "l_orderkey", method="first"),
                        Rank("book_order", bookable, desc=True, method="first")],
                 stats=[Stat("date_time", F.min("l_shipdate"))])
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
    los = 1 + F.col("l_suppkey") % 7
    s, p = F.col("srch_id"), F.col("prop_id")
    booked = flag((F.col("book_order") == 1) & bookable.isNotNull())
    out = {
        "srch_id": s, "date_time": F.col("date_time"), "site_id": F.col("s_nationkey") % 5,
        "visitor_location_country_id": F.col("s_nationkey"),
        "visitor_hist_starrating": F.when(s % 20 == 0, 1 + F.col("l_suppkey") % 4),
        "visitor_hist_adr_usd": F.when(s % 20 == 0, 50.0 + F.col("l_suppkey") % 200),
        "prop_country_id": F.col("p_size") % 25, "prop_id": p, "prop_starrating": F.col("p_size") % 6,
        "prop_review_score": F.when(p % 50 != 0, (p % 11) / 2.0), "prop_brand_bool": flag(p % 8 < 5),
        "prop_location_score1": (p % 70) / 10.0,
        "prop_location_score2": F.when(p % 5 != 0, (p % 97) / 97.0),
        "prop_log_historical_price": F.when(p % 7 == 0, 0.0).otherwise(F.log("p_retailprice")),
        "position": F.col("position"), "price_usd": price,
        "promotion_flag": flag(F.col("l_discount") >= 0.05),
        "srch_destination_id": F.col("l_suppkey") % 20, "srch_length_of_stay": los,
        "srch_booking_window": s % 60, "srch_adults_count": 1 + s % 4, "srch_children_count": s % 3,
        "srch_room_count": 1 + s % 2, "srch_saturday_night_bool": flag(s % 7 < 3),
        "srch_query_affinity_score": F.when(s % 16 == 0, 0.0 - (p % 300) / 10.0),
        "orig_destination_distance": F.when(s % 3 != 1, 10.0 + (s * 37) % 5000),
        "random_bool": flag((s % 10).isin(0, 4, 8)),
        "click_bool": F.col("click_bool"), "booking_bool": booked,
        "gross_bookings_usd": F.when(booked == 1, price * los),
    }
    for i in range(1, 9):
        absent = (p * (2 * i + 1) + s) % 10 < 6
        out[f"comp{i}_rate"] = F.when(~absent, (p + i * s) % 3 - 1)
        out[f"comp{i}_inv"] = F.when(~absent, flag((p * 3 + s + i) % 12 == 0))
        out[f"comp{i}_rate_percent_diff"] = F.when(
            ~absent & ((p + s + i) % 4 == 0), 1 + (p * i + s) % 50)
    types = {f.name: f.dataType for f in impression_schema().fields}
    return one.select(*[(out[n] if n in ("srch_id", "prop_id") else out[n].cast(types[n])).alias(n)
                        for n in types]), buckets


_stored = {}


def impressions(spark, sf_dir):
    """The impression table, derived once per session into the shared folder.

    The copy is bucketed by search, so every listwise operator on it runs
    without a shuffle; a table with an oversized search is left unbucketed,
    since a bucket could not be split.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    found = _stored.get(key)
    if found and path_exists(spark, found[1]):
        return spark.table(found[0])
    name = f"impressions_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df, buckets = derive_impressions(spark, sf_dir)  # one file per bucket
    writer = df.write.option("path", path).format("parquet")
    (writer.bucketBy(buckets, "srch_id") if buckets else writer).saveAsTable(name)
    _stored[key] = (name, path, buckets)
    return spark.table(name)


# Closed-form scores that stand in for model predictions (FIXTURES.md section 3).
MEMBERS = {
    "m1": "-price_usd",
    "m2": "prop_starrating / ln(1 + price_usd)",
    "m3": "prop_location_score1",
    "m4": "coalesce(prop_review_score, -1)",
    "m5": "promotion_flag",
    "m6": "-position",
}


def predictions(df, members=None, keep=()):
    """Long prediction table (model_id, srch_id, prop_id, score) from score expressions, with the columns `keep` of the rows."""
    members = MEMBERS if members is None else members
    scores = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model_id"), F.expr(e).cast(T.DoubleType()).alias("score"))
        for m, e in members.items()]))
    return df.select("srch_id", "prop_id", *keep, scores.alias("p")).select(
        "p.model_id", "srch_id", "prop_id", "p.score", *keep)


def stored_table(spark, sf_dir, name, build, by_search=False):
    """A derived table written once per session to the shared folder as parquet.

    With `by_search` it has the buckets of the impressions it comes from (if they have any), so it is neither
    shuffled to be written nor by a later step that needs searches together.
    """
    buckets = None
    if by_search:
        impressions(spark, sf_dir)
        buckets = _stored[(spark.sparkContext.applicationId, sf_dir)][2]
    key = (spark.sparkContext.applicationId, sf_dir, name)
    found = _stored.get(key)
    if not found or not path_exists(spark, found[1]):
        table = f"{name}_{uuid.uuid4().hex}"
        found = (table, f"{shared_dir(spark)}/{table}")
        writer = build().write.format("parquet")
        if buckets:
            writer.option("path", found[1]).bucketBy(buckets, "srch_id").saveAsTable(table)
        else:
            writer.save(found[1])
        _stored[key] = found
    return spark.table(found[0]) if buckets else spark.read.parquet(found[1])
