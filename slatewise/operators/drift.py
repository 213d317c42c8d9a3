"""Differences between two tables: column drift, KS, adversarial validation."""

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bucket_of, flag, num, ratio
from ..functions.groups import quantiles
from ..functions.stats import auc, ks_two_sample
from ..schema import ITEM, SEARCH
from ..session import materialise
from .importance import ROWS, cell_of, draw_of, lowest_draws, permutation_gains

_TINY = 1e-12
HIGH_DRIFT, HIGH_NULL_DRIFT = 0.20, 0.10


def _side(df, columns, side, sample):
    """One row per column, from one aggregate over the wide rows."""
    std = F.stddev_samp if sample else F.stddev_pop
    rows = [F.struct(F.lit(c).alias("feature"), F.avg(num(c)).alias(f"{side}_mean"), std(num(c)).alias(f"{side}_std"),
                     F.avg(flag(F.col(c).isNull())).alias(f"{side}_null_rate"), F.min(num(c)).alias(f"{side}_min"),
                     F.max(num(c)).alias(f"{side}_max")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def column_drift(train, val, columns, sample=False):
    """Per column: both sides' statistics, mean shift in train deviations, drift flags."""
    both = _side(train, columns, "train", sample).join(_side(val, columns, "val", sample), "feature")
    shift = F.abs(F.col("val_mean") - F.col("train_mean")) / (F.col("train_std") + _TINY)
    return both.withColumns({
        "abs_mean_delta_over_train_std": shift, "high_drift": flag(shift > HIGH_DRIFT),
        "high_null_drift": flag(F.abs(F.col("val_null_rate") - F.col("train_null_rate")) > HIGH_NULL_DRIFT)})


def feature_drift(train, val, added, removed):
    """Drift of the columns a variant adds or removes, with the action."""
    action = F.when(F.col("feature").isin(list(added)), "added").otherwise("removed")
    return column_drift(train, val, [*added, *removed], sample=True).withColumn("action", action)


def range_comparison(train, test, columns):
    """Columns whose test maximum exceeds the train one or whose mean differs by over 10 %."""
    both = column_drift(train, test, columns, sample=True)
    off = F.abs(ratio(F.col("val_mean") - F.col("train_mean"), "train_mean"))
    return both.withColumns({"max_exceeded": flag(F.col("val_max") > F.col("train_max")), "mean_differs": flag(off > 0.10)})


def ks_shift(train, test, columns, limit=0.1):
    return ks_two_sample(train, test, columns).withColumn("shifted", flag(F.col("ks") > limit))


#: The drift classifier: a forest of this many trees and levels, fitted on the rows of the other folds; on so many of them, by hash, if a number is given.
TREES, DEPTH, FIT_ROWS = 40, 6, None
#: Files of the drawn rows, and up to how many rows a whole table is stored again in these, dealt by key.
PARTS, DEALT = 16, 1_000_000


@dataclass
class DriftModels:
    """A classifier for each fold, fitted on the other folds, with the table that it reads."""

    rows: DataFrame
    measured: DataFrame
    models: list
    columns: list
    keys: tuple

    def scored(self):
        """Every row (keys, side, fold) with the p of the model that has not seen its search, stored."""
        return materialise(reduce(lambda a, b: a.unionByName(b), [
            model.transform(self.rows.where(F.col("fold") == fold)).select(*self.keys, "side", "fold", vector_to_array("probability")[1].alias("p"))
            for fold, model in self.models]), "drift-scores")

    def gains(self):
        """(model_id, feature, gain, loss), measured in each model's own fold."""
        return permutation_gains([(str(fold), model, self.measured.where(F.col("fold") == fold)) for fold, model in self.models],
                                 self.columns, "side", (*self.keys, "side"))


def drift_models(train, test, columns, folds=3, trees=TREES, depth=DEPTH, fit_rows=FIT_ROWS, seed=42, keys=(SEARCH, ITEM)):
    """The models of `cross_fitted`, fitted and measured on every row.

    With `fit_rows` (or `ROWS`) a number, rows are drawn by hash. The rows of small tables are stored once, dealt by key;
    large tables are read as they are, several times, and should be stored if they are costly to compute.
    """
    columns = list(columns)

    def side(df, value):
        return df.select(*keys, *[num(c).alias(c) for c in columns], F.lit(value).alias("side"), bucket_of(keys[0], folds, "drift").alias("fold"))

    rows = side(train, 0.0).unionByName(side(test, 1.0))
    draw = F.pmod(F.xxhash64(F.lit(seed), *keys, "side"), F.lit(1 << 20))
    reach = lowest_draws(rows, draw_of((*keys, "side")), ROWS or 0, "fold")
    total = sum(r.total for r in reach.values())
    fitting = measuring = F.lit(True)
    if fit_rows is not None:
        fitting = draw < int(min(1.0, fit_rows / max(1, total * (folds - 1) / folds)) * (1 << 20))
    if ROWS is not None:
        measuring = reduce(or_, [(F.col("fold") == fold) & (cell_of(draw_of((*keys, "side"))) <= r.cell) for fold, r in reach.items()], F.lit(False))
    drawn = rows
    if ROWS is not None or total <= DEALT:
        # a bounded number of rows, dealt by key: the forests do not depend on how the tables are cut
        drawn = materialise(rows.where(fitting | measuring).repartition(PARTS, *keys).sortWithinPartitions(*keys, "side"), "drift-rows")
    models = []
    for fold in range(folds):
        filled = [Imputer(inputCols=columns, outputCols=[f"{c}_f" for c in columns]),
                  VectorAssembler(inputCols=[f"{c}_f" for c in columns], outputCol="features", handleInvalid="keep"),
                  RandomForestClassifier(labelCol="side", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7)]
        models.append((fold, Pipeline(stages=filled).fit(drawn.where((F.col("fold") != fold) & fitting))))
    return DriftModels(rows, drawn.where(measuring), models, columns, tuple(keys))


def cross_fitted(train, test, columns, folds=3, trees=TREES, depth=DEPTH, fit_rows=FIT_ROWS, seed=42, keys=(SEARCH, ITEM)):
    """How likely each row is to be a test row, by a classifier that has not seen its search.

    Returns (scored rows: keys, side, fold, p; gains: model_id, feature, gain, loss). Searches of both tables fall into
    folds; a forest fitted on the other folds gives p to a fold, and the gain of a feature is
    measured there by exchanging its values. Encoded columns must leave the own fold out on
    both sides (`encode_many(..., blind=True)`), else the classifier sees how the tables were made.
    Who needs one of the two asks `drift_models` for it.
    """
    found = drift_models(train, test, columns, folds, trees, depth, fit_rows, seed, keys)
    return found.scored(), found.gains()


def adversarial_auc(scored):
    """AUC of the cross-fitted p and its band: no drift up to 0.55, some up to 0.65, strong above."""
    out = auc(scored, "p", "side")
    return out.withColumn("band", F.when(F.col("auc") <= 0.55, "none").when(F.col("auc") <= 0.65, "some").otherwise("strong"))


def probability_quantiles(scored, value="p"):
    q = quantiles(scored.select(num(value).alias("v")), "v", [0.1, 0.5, 0.9, 0.99])
    return q.select(*[F.col("q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90", "p99"))])


def group_risk(adversarial_gain, ranker_gain, groups):
    """Per feature group: share of adversarial gain minus share of ranker gain."""
    both = groups.join(adversarial_gain.select("feature", F.col("gain").alias("a")), "feature", "left").join(
        ranker_gain.select("feature", F.col("gain").alias("r")), "feature", "left").na.fill(0.0, ["a", "r"])
    total = both.agg(F.struct(F.sum("a").alias("a"), F.sum("r").alias("r"))).scalar()
    return both.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_features"), ratio(F.sum("a"), total["a"]).alias("adversarial_share"),
        ratio(F.sum("r"), total["r"]).alias("ranker_share")).withColumn(
            "risk", F.col("adversarial_share") - F.col("ranker_share"))
