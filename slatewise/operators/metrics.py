"""Ranking metrics.

Relevance is 0, 1 or 5, the gain is linear and the discount 1/log2(rank + 1).
Slates without a positive count as 0. Ties of the score go to the smaller item id.
"""

from pyspark.sql import functions as F

from ..functions.exprs import col, flag, label, num, ratio
from ..functions.groups import Rank, Stat, quantiles, within
from ..schema import SEARCH

ITEM = "prop_id"


def ranked(df, score="score", by=(), ascending=False, name="rank", search=SEARCH):
    """Add the 1-based place of each row in its slate."""
    return within(df, [*by, search], ranks=[Rank(name, score, desc=not ascending, method="first", tie=ITEM)])


def with_relevance(df):
    return df if "relevance" in df.columns else df.withColumn("relevance", label())


def discount(place):
    return F.log2(place + F.lit(1.0))


def ideal_dcg(k):
    """Best DCG of a slate from its counts of fives and ones; no second ordering needed."""
    n5, n1 = F.col("n_fives"), F.col("n_ones")
    out = F.lit(0.0)
    for place in range(1, k + 1):
        gain = F.when(n5 >= place, 5.0).when(n5 + n1 >= place, 1.0).otherwise(0.0)
        out = out + gain / discount(F.lit(float(place)))
    return out


def slate_aggregates(k=5, rank="rank"):
    """Aggregates over the rows of one slate that every metric derives from."""
    r, rel = F.col(rank), F.col("relevance")
    booked = rel == 5
    dcg = F.sum(F.when(r <= k, rel / discount(r)).otherwise(0.0))
    return [F.count(F.lit(1)).alias("n_rows"), F.sum(flag(booked)).alias("n_fives"),
            F.sum(flag(rel == 1)).alias("n_ones"), dcg.alias("dcg"),
            F.min(F.when(booked, r)).alias("booked_rank"),
            F.sum(flag((rel > 0) & (r <= 5))).alias("clicks_top5")]


def per_search_metrics(df, score="score", k=5, by=(), keep=(), ascending=False, search=SEARCH):
    """One row per slate: ndcg, booked_rank (NULL without a booking) and counts.

    `keep` lists slate-constant columns to carry along.
    """
    r = ranked(with_relevance(df), score, by, ascending, search=search)
    carried = [F.first(c).alias(c) for c in keep]
    per = r.groupBy(*by, search).agg(*slate_aggregates(k), *carried)
    ndcg = F.coalesce(ratio("dcg", ideal_dcg(k)), F.lit(0.0))
    return per.withColumn("ndcg", ndcg)


def summarise(per_search, by=()):
    """Means over slates: NDCG, recall, mean booked rank, counts."""
    booked = F.col("booked_rank").isNotNull()

    def share(k):
        return F.coalesce(F.avg(F.when(booked, flag(F.col("booked_rank") <= k))), F.lit(0.0))

    return per_search.groupBy(*by).agg(
        F.avg("ndcg").alias("ndcg5"), share(1).alias("recall1"), share(5).alias("recall5"),
        F.avg("booked_rank").alias("mean_booked_rank"), F.count(F.lit(1)).alias("n_queries"),
        F.count("booked_rank").alias("n_booked"))


def ranking_metrics(df, score="score", k=5, by=(), ascending=False):
    """NDCG@k, recall@1, recall@5, mean booked rank, slates and booked slates, one row per `by`."""
    return summarise(per_search_metrics(df, score, k, by, ascending=ascending), by)


def full_metrics(df, score="score"):
    """Recall at 1, 3, 5 and 10, click recall, booked-rank median and share of first places."""
    per = per_search_metrics(df, score)
    booked = F.col("booked_rank").isNotNull()
    recalls = [F.avg(F.when(booked, flag(F.col("booked_rank") <= k))).alias(f"recall{k}") for k in (1, 3, 5, 10)]
    return per.agg(F.avg("ndcg").alias("ndcg5"), *recalls,
                   ratio(F.sum("clicks_top5"), F.sum(F.col("n_fives") + F.col("n_ones"))).alias("click_recall5"),
                   F.avg("booked_rank").alias("mean_booked_rank"),
                   F.percentile("booked_rank", 0.5).alias("median_booked_rank"),
                   F.avg(F.when(booked, flag(F.col("booked_rank") == 1))).alias("booked_at_1"))


def booked_rank_histogram(df, score="score"):
    per = per_search_metrics(df, score).where(F.col("booked_rank").isNotNull())
    return per.groupBy("booked_rank").agg(F.count(F.lit(1)).alias("n_searches"))


def predicted_place(df, score="score"):
    """Place of each row and place divided by slate size."""
    out = within(df, [SEARCH], ranks=[Rank("pred_rank", score, desc=True, method="first")],
                 stats=[Stat("_n", F.count(F.lit(1)))])
    return out.withColumn("pred_rank_pct", ratio("pred_rank", "_n")).drop("_n")


def metrics_by_segment(df, segment, score="score", min_searches=10):
    """Metrics per segment. Rows are filtered first, so an item-level segment re-ranks its rows."""
    df = df.where(col(segment).isNotNull())
    return ranking_metrics(df, score, by=[segment]).where(F.col("n_queries") >= min_searches)


def score_separation(df, score="score"):
    """Mean, median and deviation of the score by relevance."""
    d = with_relevance(df)
    mid = quantiles(d.select("relevance", num(score).alias("v")), "v", [0.5], ["relevance"])
    return (d.groupBy("relevance").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
                                       F.stddev_samp(score).alias("std_score"))
            .join(mid.select("relevance", F.col("q")[0].alias("median_score")), "relevance"))


# Single-column rankers, their expression and whether less is better.
BASELINES = {
    "cheapest_first": ("price_usd", True),
    "highest_stars": ("prop_starrating", False),
    "highest_review": ("prop_review_score", False),
    "best_location1": ("prop_location_score1", False),
    "promotion_first": ("promotion_flag", False),
    "best_value": ("try_divide(prop_starrating, ln(1 + price_usd))", False),
}


def baseline_scores(df, baselines=None):
    """Stack one score per baseline; missing values go below the column's minimum."""
    baselines = BASELINES if baselines is None else baselines
    signed = {n: (-num(F.expr(e)) if asc else num(F.expr(e))) for n, (e, asc) in baselines.items()}
    floor = df.agg(F.struct(*[F.min(s).alias(n) for n, s in signed.items()])).scalar()
    stacked = F.explode(F.array(*[
        F.struct(F.lit(n).alias("baseline"), F.coalesce(s, floor[n] - 1.0).alias("score"))
        for n, s in signed.items()]))
    return df.select("srch_id", "prop_id", "relevance", stacked.alias("b")).select(
        "srch_id", "prop_id", "relevance", "b.*")


def baseline_metrics(df, baselines=None):
    """All single-column rankers in one job."""
    return ranking_metrics(baseline_scores(with_relevance(df), baselines), by=["baseline"])


def existing_order_metrics(df):
    """The order the slates were shown in, on non-random slates."""
    shown = with_relevance(df).where(F.col("random_bool") == 0)
    return ranking_metrics(shown.withColumn("score", -num("position")))


def decision(delta):
    """REJECT below 0, HOLD below 0.001, KEEP below 0.002, STRONG_KEEP above."""
    d = col(delta)
    return (F.when(d < 0, "REJECT").when(d < 0.001, "HOLD").when(d < 0.002, "KEEP").otherwise("STRONG_KEEP"))


# NDCG@5 thresholds of the candidate categories.
EXCELLENT, STRONG, CANDIDATE, OVERFIT, WEAK = 0.4230, 0.4220, 0.4210, 0.4240, 0.4180
EARLY_STOP, ROUND_BUDGET = 100, 1800


def category(ndcg, best_iteration=None, cuts=(EXCELLENT, STRONG, CANDIDATE, WEAK, OVERFIT)):
    """Category and warning flags joined by '|'."""
    n = num(ndcg)
    excellent, strong, candidate, weak, overfit = cuts
    base = (F.when(n >= excellent, "EXCELLENT").when(n >= strong, "STRONG").when(n >= candidate, "CANDIDATE")
            .when(n < weak, "WEAK").otherwise("NEUTRAL"))
    parts = [base, F.when(n >= overfit, "POSSIBLE_OVERFIT")]
    if best_iteration is not None:
        it = col(best_iteration)
        parts += [F.when(it < EARLY_STOP, "EARLY_STOP_SUSPICIOUS"), F.when(it > ROUND_BUDGET, "HIT_ROUND_BUDGET")]
    return F.concat_ws("|", *parts)
