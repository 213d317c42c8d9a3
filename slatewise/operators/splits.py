"""Samples and splits that keep every search whole, and checks of them.

Random choices are md5 buckets of the search id: a predicate, so no shuffle, no
state, and the same rows on every run. Sizes are therefore close to the asked
share, not exact.
"""

from pyspark.sql import functions as F

from ..functions.exprs import bucket_of
from ..functions.groups import value_ranks
from ..schema import SEARCH

_GRAIN = 10_000


def sample_searches(df, frac, salt="sample", search=SEARCH):
    return df.where(bucket_of(search, _GRAIN, salt) < int(round(frac * _GRAIN)))


def _row_bucket(keys, salt):
    return bucket_of(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), _GRAIN, salt)


def sample_rows(df, frac, salt="row-sample", keys=("srch_id", "prop_id")):
    """About a share of the rows, by a hash of their key: the same rows however the table is partitioned."""
    return df.where(_row_bucket(keys, salt) < int(round(frac * _GRAIN)))


def sample_n_rows(df, n, salt="rows", keys=("srch_id", "prop_id")):
    """Exactly n rows (all if fewer), the ones with the smallest hash of their key.

    Two counts of at most 4,096 hash prefixes each find the prefix at which n rows are
    reached. All rows before it belong to the sample, and only those of that prefix are ordered.
    """
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(salt)))
    prefix, left = "", n
    for size in (3, 6):
        cells = (df.where(h.startswith(prefix)).groupBy(F.substring(h, 1, size).alias("cell")).count().orderBy("cell").collect())
        cut = None
        for cell in cells:
            if cell["count"] >= left:
                cut = cell["cell"]
                break
            left -= cell["count"]
        if cut is None:
            return df  # fewer rows than asked for
        prefix = cut
    at = F.substring(h, 1, len(prefix))
    return df.where(at < prefix).unionByName(df.where(at == prefix).orderBy(h, *keys).limit(left))


def split_random(df, frac=0.1, salt="val", search=SEARCH):
    """(train, validation): about `frac` of the searches go to validation."""
    held = bucket_of(search, _GRAIN, salt) < int(round(frac * _GRAIN))
    return df.where(~held), df.where(held)


def split_rows(df, frac, salt="row-split", keys=("srch_id", "prop_id")):
    """Row-level split by a hash of the row's key, for classifiers that do not rank."""
    held = _row_bucket(keys, salt) < int(round(frac * _GRAIN))
    return df.where(~held), df.where(held)


def split_rows_stratified(df, label, frac, salt="strata", keys=("srch_id", "prop_id")):
    """Row split whose label shares stay the same on both sides in expectation."""
    held = _row_bucket(keys, salt) < int(round(frac * _GRAIN))
    return df.where(~held & F.col(label).isNotNull()), df.where(held & F.col(label).isNotNull())


def temporal_cutoff(df, frac=0.8, search=SEARCH, time="date_time"):
    """(timestamp, search id) of the first search after the first int(frac * n) ones."""
    starts = df.groupBy(search).agg(F.min(time).alias("_t"))
    n = starts.count()
    k = int(frac * n)
    if k >= n:
        return None
    at = (value_ranks(starts, "_t")
          .where((F.col("_before") <= k) & (F.lit(k) < F.col("_before") + F.col("_n"))).first())
    tied = value_ranks(starts.where(F.col("_t") == F.lit(at["_t"])), search)
    return at["_t"], tied.where(F.col("_before") == k - at["_before"]).first()[search]


def split_temporal(df, frac=0.8, search=SEARCH, time="date_time"):
    """(train, validation, cutoff time): the earliest searches train, the latest validate.

    The time must be constant inside a search. The cut is evaluated to two
    literals, so both sides push a plain filter down to the scan.
    """
    cut = temporal_cutoff(df, frac, search, time)
    if cut is None:
        return df, df.where(F.lit(False)), None
    t, s = cut
    early = (F.col(time) < F.lit(t)) | ((F.col(time) == F.lit(t)) & (F.col(search) < s))
    return df.where(early), df.where(~early), t


def split_counts(parts, search=SEARCH, time="date_time"):
    """One row per named part: rows, searches, first and last time."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(search).alias("n_searches"),
                     F.min(time).alias("first_time"), F.max(time).alias("last_time"))
        one = one.select(F.lit(name).alias("part"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def check_split(train, val, everything, search=SEARCH):
    """One row: searches on both sides, searches on neither side, row balance, and the verdict."""
    sides = (train.select(search, F.lit(1).alias("t"), F.lit(0).alias("v"), F.lit(0).alias("a"))
             .unionByName(val.select(search, F.lit(0).alias("t"), F.lit(1).alias("v"), F.lit(0).alias("a")))
             .unionByName(everything.select(search, F.lit(0).alias("t"), F.lit(0).alias("v"), F.lit(1).alias("a"))))
    per = sides.groupBy(search).agg(F.sum("t").alias("t"), F.sum("v").alias("v"), F.sum("a").alias("a"))
    t, v, a = F.col("t") > 0, F.col("v") > 0, F.col("a") > 0
    out = per.agg(F.count_if(t & v).alias("in_both"), F.count_if(a & ~t & ~v).alias("in_neither"),
                  F.count_if(~a).alias("unknown"),
                  F.sum(F.col("a") - F.col("t") - F.col("v")).alias("row_gap"))
    good = (F.col("in_both") == 0) & (F.col("in_neither") == 0) & (F.col("unknown") == 0) & (F.col("row_gap") == 0)
    return out.withColumn("ok", F.when(good, 1).otherwise(0))


def fold_integrity(df, fold, search=SEARCH):
    """Rows and searches per fold, and the most folds any search is in (must be 1)."""
    rows = df.select(search, fold.alias("fold"))
    spread = rows.groupBy(search).agg(F.countDistinct("fold").alias("folds"))
    worst = spread.agg(F.max("folds")).scalar()
    return (rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(search).alias("n_searches"))
            .withColumn("max_folds_per_search", worst))


def metric_spread(metrics, columns):
    """Mean, deviation, minimum and maximum of metrics over repeated splits."""
    long = metrics.unpivot([], columns, "metric", "value")
    return long.groupBy("metric").agg(
        F.count("value").alias("n_runs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
