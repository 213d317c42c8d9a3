"""Reading impression tables and keeping feature tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import finite
from ..functions.groups import note_group_size
from ..schema import MISSING_TOKEN, SEARCH, impression_schema


def read_impressions(spark, path, fmt="csv", labelled=True, columns=None):
    """Scan a raw impression file; with `columns` only those are read.

    The schema is explicit, so CSV is not scanned twice to infer it. NaN becomes
    NULL on the way in.
    """
    schema = impression_schema(labelled)
    if fmt == "csv":
        df = spark.read.csv(path, header=True, nullValue=MISSING_TOKEN, schema=schema, mode="FAILFAST")
    else:
        df = spark.read.format(fmt).load(path)
    if columns:
        df = df.select(*columns)
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


def downcast(df, flags=None, counts=None):
    """Narrow types for a sink: doubles to float, named flags to byte, named counts to short."""
    narrow = {f.name: "float" for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    narrow.update({c: "tinyint" for c in flags or ()})
    narrow.update({c: "smallint" for c in counts or ()})
    return df.select(*[F.col(c).cast(narrow[c]).alias(c) if c in narrow else F.col(c) for c in df.columns])


def write_features(df, path, split):
    """Store a feature table under its split, with its row and search counts beside it."""
    target = f"{path}/split={split}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(target)  # wide rows of many decimals
    stored = df.sparkSession.read.parquet(target)
    table_counts(stored).write.mode("overwrite").parquet(f"{path}_meta/split={split}")
    return stored


def read_features(spark, path, split, columns=None):
    df = spark.read.parquet(f"{path}/split={split}")
    return df.select(*columns) if columns else df


def table_counts(df):
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(SEARCH).alias("n_searches"))


def features_valid(spark, path, split, source):
    """One row: do the stored counts match the source table's?"""
    meta = spark.read.parquet(f"{path}_meta/split={split}")
    now = table_counts(source)
    return (meta.join(now.select(F.col("n_rows").alias("rows_now"), F.col("n_searches").alias("searches_now")),
                      on=[F.col("n_rows") == F.col("rows_now"), F.col("n_searches") == F.col("searches_now")],
                      how="left")
            .select("n_rows", "n_searches", F.when(F.col("rows_now").isNotNull(), 1).otherwise(0).alias("valid")))


def non_finite_to_null(df, columns):
    return df.withColumns({c: finite(c) for c in columns})


__all__ = ["read_impressions", "downcast", "write_features", "read_features", "table_counts", "features_valid",
           "non_finite_to_null", "note_group_size"]
