"""Rank fusion and search over fusions.

Members enter as a long prediction table. `member_ranks` turns it into one row
per item with an array of ranks, once. A trial is then a weight vector: tasks hold whole
slates as blocks of numbers and return sums over them, so any number of fusions is
scored in one pass, without a row for a trial. Scores of fused ranks are ascending (small is good) unless stated otherwise.
"""

import itertools
import math
import random
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import num, ratio, total
from ..functions.groups import Rank, Stat, within
from ..functions.small import small_table
from ..schema import SEARCH
from . import metrics

ITEM = "prop_id"
KEYS = [SEARCH, ITEM]

# the block functions travel with the jobs, so executors need no copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def grouped_rank(preds, method="average", name="rank"):
    """Descending rank of every prediction in its (model, slate): average or first ties."""
    return within(preds, ["model_id", SEARCH], ranks=[Rank(name, "score", desc=True, method=method)])


def member_ranks(preds, members, method="average", keep=()):
    """One row per item: `r`, the members' ranks in the given order, and the item's own columns `keep`."""
    wide = pivot_scores(preds, members, keep)
    out = within(wide, [SEARCH], ranks=[
        Rank(f"_r{i}", F.col("s")[i], desc=True, method=method) for i in range(len(members))])
    return out.select(*KEYS, *keep, F.array(*[num(f"_r{i}") for i in range(len(members))]).alias("r"))


def pivot_scores(preds, members, keep=()):
    """One row per item with the members' scores as an array; `keep` are columns with one value per item."""
    cells = [F.max(F.when(F.col("model_id") == m, F.col("score"))) for m in members]
    return preds.where(F.col("model_id").isin(list(members))).groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in keep], F.array(*cells).alias("s"))


def weighted_sum(values, weights, column="v"):
    """Sum of weight * array entry, left to right."""
    return total([F.col(column)[i] * w for i, w in enumerate(weights)])


def equal_average(preds, members, ranks=None):
    """Mean of the members' average-tie ranks, ascending."""
    r = member_ranks(preds, members) if ranks is None else ranks
    n = len(members)
    return r.select(*KEYS, (total([F.col("r")[i] for i in range(n)]) / n).alias("fused"))


def fuse(ranks, members, weights):
    """Weighted average of ranks; weights are divided by their sum."""
    s = float(sum(weights[m] for m in members))
    parts = [F.col("r")[i] * (weights[m] / s) for i, m in enumerate(members)]
    return ranks.select(*KEYS, total(parts).alias("fused"))


def fuse_with_table(preds, ensembles, ranked=None):
    """Weighted rank average of ensembles given as rows (ensemble_id, model_id, weight)."""
    ranks = grouped_rank(preds) if ranked is None else ranked
    sums = ensembles.groupBy("ensemble_id").agg(F.sum("weight").alias("_w"))
    shares = small_table(ensembles.join(sums, "ensemble_id").select(
        "ensemble_id", "model_id", ratio("weight", "_w").alias("w")))
    return (ranks.join(shares, "model_id").groupBy("ensemble_id", *KEYS)
            .agg(F.sum(F.col("w") * F.col("rank")).alias("fused")))


def base_plus(base, added):
    """Weights of a base member and small additions: the base takes what is left of 1."""
    s = sum(added.values())
    if not 0 < s <= 0.5:
        raise ValueError(f"added weight {s} is outside (0, 0.5]")
    return {base: 1.0 - s, **added}


def percentile_average(preds, weights):
    """Metric-weighted mean of ascending percentile ranks of the scores; high is good."""
    ranks = within(preds.where(F.col("model_id").isin(list(weights))), ["model_id", SEARCH],
                   ranks=[Rank("pct", "score", method="average", pct=True)])
    pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    s = float(sum(weights.values()))
    return ranks.groupBy(*KEYS).agg((F.sum(F.col("pct") * pairs[F.col("model_id")]) / s).alias("fused"))


def score_mean(preds, members):
    """Plain mean of scores; high is good."""
    return preds.where(F.col("model_id").isin(list(members))).groupBy(*KEYS).agg(F.avg("score").alias("fused"))


def at_least_median(table, metric="ndcg5"):
    """Members whose metric reaches the upper median (element n // 2 of the sorted metrics)."""
    ranked = table.agg(F.sort_array(F.collect_list(metric)).alias("m"))
    cut = ranked.select(F.element_at("m", F.floor(F.size("m") / 2).cast("int") + 1)).scalar()
    return table.where(F.col(metric) >= cut)


def best_of(results, metric="ndcg5", name="ensemble_id"):
    """The row with the largest metric."""
    return results.agg(F.max_by(name, metric).alias(name), F.max(metric).alias(metric))


NORMALISERS = ("rank_avg", "global_z", "query_z", "blend_rank_query_z", "blend_rank_global_z")
_TINY = 1e-12


def _global_z(df, value, name, by=("model_id",)):
    stats = small_table(df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")))
    return df.join(stats, list(by)).withColumn(
        name, (F.col(value) - F.col("_m")) / (F.col("_s") + _TINY)).drop("_m", "_s")


def normalise(preds):
    """Every normalisation of every prediction, all 'high is good'."""
    df = within(preds, ["model_id", SEARCH],
                ranks=[Rank("_rank", "score", desc=True, method="average")],
                stats=[Stat("_mu", F.avg("score")), Stat("_sd", F.stddev_samp("score"))])
    spread = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    df = df.withColumns({"rank_avg": -num("_rank"), "query_z": (F.col("score") - F.col("_mu")) / spread})
    df = _global_z(df, "score", "global_z")
    for c in ("rank_avg", "query_z", "global_z"):
        df = _global_z(df, c, f"_{c}")
    df = df.withColumns({"blend_rank_query_z": 0.5 * F.col("_rank_avg") + 0.5 * F.col("_query_z"),
                         "blend_rank_global_z": 0.5 * F.col("_rank_avg") + 0.5 * F.col("_global_z")})
    return df.select("model_id", *KEYS, *NORMALISERS)


def normalised_slates(preds, members, keep=(), only=NORMALISERS):
    """One row per item: for each normaliser an array of the members' values, as `normalise` gives them.

    Searches stay where they are and no row is stored: what holds for a whole member is a few
    numbers, which the driver gets from aggregates.
    """
    n, s = range(len(members)), [F.col("s")[i] for i in range(len(members))]
    wide = pivot_scores(preds, members, keep)
    df = within(wide, [SEARCH], ranks=[Rank(f"_r{i}", s[i], desc=True, method="average") for i in n],
                stats=[x for i in n for x in (Stat(f"_m{i}", F.avg(s[i])), Stat(f"_d{i}", F.stddev_samp(s[i])))])
    spread = [F.when(F.col(f"_d{i}") > 0, F.col(f"_d{i}")).otherwise(F.lit(1.0)) for i in n]
    df = df.select(*KEYS, *keep, "s", F.array(*[-num(f"_r{i}") for i in n]).alias("rank_avg"),
                   F.array(*[(s[i] - F.col(f"_m{i}")) / spread[i] for i in n]).alias("query_z"))

    def z_scores(table, column):
        """The z-scores of an array column's entries over all rows of the table."""
        cells = [c for i in n for c in (F.avg(F.col(column)[i]).alias(f"m{i}"), F.stddev_pop(F.col(column)[i]).alias(f"s{i}"))]
        found = table.agg(*cells).first()
        return F.array(*[(F.col(column)[i] - F.lit(found[f"m{i}"]).cast("double")) / (F.lit(found[f"s{i}"]).cast("double") + _TINY) for i in n])

    def blend(a, b):
        return F.zip_with(a, b, lambda x, y: 0.5 * x + 0.5 * y)

    if {"global_z", "blend_rank_global_z"} & set(only):
        scores = z_scores(wide, "s")
        df = df.withColumn("global_z", scores)
    ranks = z_scores(df, "rank_avg") if {"blend_rank_query_z", "blend_rank_global_z"} & set(only) else None
    if "blend_rank_query_z" in only:
        df = df.withColumn("blend_rank_query_z", blend(ranks, z_scores(df, "query_z")))
    if "blend_rank_global_z" in only:
        df = df.withColumn("blend_rank_global_z", blend(ranks, z_scores(wide.withColumn("global_z", scores), "global_z")))
    return df.select(*KEYS, *keep, *only)


# Weights and memberships: small driver-side lists that become one literal.

def weighting_methods(members):
    """Weights of (name, metric) members in falling metric order, by five methods."""
    names = [n for n, _ in members]
    values = [v for _, v in members]
    mean = sum(values) / len(values)
    return {
        "equal": dict.fromkeys(names, 1.0),
        "ndcg_weighted": dict(members),
        "softmax_ndcg": {n: math.exp((v - mean) / 0.001) for n, v in members},
        "softmax_ndcg_T0005": {n: math.exp((v - mean) / 0.005) for n, v in members},
        "inverse_rank": {n: 1.0 / (i + 1) for i, n in enumerate(names)},
    }


def weight_table(models, metric="ndcg5"):
    """The same five weightings computed from a member table, normalised to sum 1."""
    every = W.partitionBy(F.lit(1))  # a member table has tens of rows
    v = F.col(metric)
    place = F.row_number().over(every.orderBy(v.desc(), F.col("model_id")))
    base = models.select("model_id", v.alias("v"), (v - F.avg(v).over(every)).alias("gap"), place.alias("place"))
    ways = {"equal": F.lit(1.0), "ndcg_weighted": F.col("v"), "softmax_ndcg": F.exp(F.col("gap") / 0.001),
            "softmax_ndcg_T0005": F.exp(F.col("gap") / 0.005), "inverse_rank": 1.0 / F.col("place")}
    long = base.select("model_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("method"), num(e).alias("raw")) for n, e in ways.items()])).alias("w"))
    long = long.select("w.method", "model_id", "w.raw")
    return long.select("method", "model_id",
                       (F.col("raw") / F.sum("raw").over(W.partitionBy("method"))).alias("weight"))


def subsets(named):
    """Equal-weight ensembles from {ensemble_id: members}."""
    return {e: dict.fromkeys(ms, 1.0) for e, ms in named.items()}


def leave_one_out(members):
    """The full equal-weight ensemble and every ensemble with one member dropped."""
    out = {"all": dict.fromkeys(members, 1.0)}
    if len(members) > 1:
        out.update({f"without_{m}": dict.fromkeys([x for x in members if x != m], 1.0) for m in members})
    return out


def leave_one_out_added(base, added):
    """A weighted base-plus ensemble and the same with one addition dropped."""
    out = {"all": base_plus(base, added)}
    for m in added:
        rest = {k: w for k, w in added.items() if k != m}
        out[f"without_{m}"] = base_plus(base, rest) if rest else {base: 1.0}
    return out


def single_grid(base, members, weights):
    return {f"{base}+{m}@{w:g}": base_plus(base, {m: w}) for m in members for w in weights}


def product_grid(base, members, weights, cap):
    """All weight combinations of fixed members whose total stays within the cap."""
    out = {}
    for ws in itertools.product(weights, repeat=len(members)):
        if sum(ws) <= cap + 1e-9:
            out[f"{base}+" + "+".join(f"{m}@{w:g}" for m, w in zip(members, ws))] = base_plus(
                base, dict(zip(members, ws)))
    return out


def combination_grid(base, pool, sizes, weights, cap):
    """Equal small weights on every combination of the pool."""
    out = {}
    for n in sizes:
        for w in weights:
            if w * n <= cap + 1e-9:
                for combo in itertools.combinations(pool, n):
                    out[f"{base}+" + "+".join(combo) + f"@{w:g}each"] = base_plus(base, dict.fromkeys(combo, w))
    return out


def skew_weights(base_weight, base, pool, favoured, skew):
    """The non-base share, `skew` times as much for favoured members."""
    n = sum(m in favoured for m in pool)
    unit = (1.0 - base_weight) / (skew * n + len(pool) - n)
    return {base: base_weight, **{m: unit * (skew if m in favoured else 1.0) for m in pool}}


# Base weights of the three normalisation grids.
GRID_A, GRID_B = (0.65, 0.70, 0.75, 0.80, 0.85, 0.90), (0.30, 0.40, 0.50, 0.60)
GRID_B_SKEW, GRID_C = (0.50, 0.60, 0.70), (0.60, 0.65, 0.70, 0.725, 0.75, 0.775, 0.80)


def normalisation_grids(base, pool, favoured):
    """Weight sets A (conservative), B (aggressive, skewed) and C (fine), each for any normaliser."""
    out = {}
    for b in GRID_A:
        for n in (2, 3, 4, 5):
            if n <= len(pool):
                out[f"A_n{n}_{b:g}"] = skew_weights(b, base, pool[:n], (), 1.0)
    for b in GRID_B:
        for n in (3, 4, 5):
            if n <= len(pool):
                out[f"B_n{n}_{b:g}"] = skew_weights(b, base, pool[:n], (), 1.0)
    four = pool[:4]
    for b in GRID_B_SKEW:
        for name, some in favoured.items():
            for skew in (1.5, 2.0):
                out[f"B_{name}{skew:g}_{b:g}"] = skew_weights(b, base, four, some, skew)
    for b in GRID_C:
        out[f"C_equal_{b:g}"] = skew_weights(b, base, four, (), 1.0)
        for name, some in favoured.items():
            out[f"C_{name}1.5_{b:g}"] = skew_weights(b, base, four, some, 1.5)
    return out


def random_trials(members, n, kind, seed=42, sizes=(3, 10)):
    """Random subsets, Dirichlet weights, or both."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        chosen = list(members)
        if kind in ("subset", "both"):
            k = rng.randint(min(sizes[0], len(members)), min(sizes[1], len(members)))
            chosen = sorted(rng.sample(list(members), k))
        w = [rng.gammavariate(1.0, 1.0) if kind in ("weights", "both") else 1.0 for _ in chosen]
        out[f"{kind}_{i}"] = dict(zip(chosen, w))
    return out


#: Rows and pairs (a positive and a row of its slate) that a task scores at once, and trials at once.
BLOCK_ROWS, BLOCK_PAIRS, BLOCK_TRIALS = 20_000, 50_000, 64


def _block_sums(search, item, relevance, values, weights, ascending):
    """Per trial, over some whole slates in rows next to each other: summed NDCG, booked slates, those booked first, in the first five, and summed booked ranks."""
    starts = np.flatnonzero(np.r_[True, search[1:] != search[:-1]])
    slate = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(search)]))
    sizes = np.bincount(slate)
    positives = np.flatnonzero(relevance > 0)
    out = np.zeros((5, len(weights)))
    if not len(positives):
        return out
    of, rel = slate[positives], relevance[positives].astype(float)
    kinds = np.zeros((len(starts), 2), np.int64)
    np.add.at(kinds, (of, 0), rel == 5)
    np.add.at(kinds, (of, 1), rel == 1)
    place = np.arange(1, 6)
    gains = np.where(kinds[:, :1] >= place, 5.0, np.where(kinds.sum(axis=1, keepdims=True) >= place, 1.0, 0.0))
    ideal = (gains / np.log2(place + 1.0)).sum(axis=1)
    # consecutive positives whose pairs fit into one step
    step = np.cumsum(sizes[of]) // BLOCK_PAIRS
    groups = np.split(np.arange(len(positives)), np.flatnonzero(np.diff(step)) + 1)
    for lo in range(0, len(weights), BLOCK_TRIALS):
        w = weights[lo : lo + BLOCK_TRIALS]
        fused = np.zeros((len(search), len(w)))
        for m in range(w.shape[1]):
            # zero-weight members must not turn a missing value into a missing sum
            fused += np.where(w[:, m] != 0, values[:, m : m + 1] * w[:, m], 0.0)
        places = np.empty((len(positives), len(w)), np.int64)
        for group in groups:
            count = sizes[of[group]]
            first = np.cumsum(count) - count
            mine = np.repeat(positives[group], count)
            row = np.arange(count.sum()) - np.repeat(first, count) + np.repeat(starts[of[group]], count)
            x, y = fused[row], fused[mine]
            # better, or as good with a smaller item; rows without a score come last
            none_x, none_y = np.isnan(x), np.isnan(y)
            before = (x < y if ascending else x > y) | (none_y & ~none_x)
            before |= ((x == y) | (none_x & none_y)) & (item[row] < item[mine])[:, None]
            places[group] = np.add.reduceat(before, first, axis=0, dtype=np.int64) + 1
        dcg = np.zeros((len(starts), len(w)))
        np.add.at(dcg, of, np.where(places <= 5, rel[:, None] / np.log2(places + 1.0), 0.0))
        part = out[:, lo : lo + len(w)]
        part[0] = np.divide(dcg, ideal[:, None], out=np.zeros_like(dcg), where=ideal[:, None] > 0).sum(axis=0)
        booked = rel == 5
        if booked.any():
            rank = np.full((len(starts), len(w)), np.iinfo(np.int64).max)
            np.minimum.at(rank, of[booked], places[booked])
            rank = rank[np.unique(of[booked])]
            part[1], part[2], part[3], part[4] = len(rank), (rank <= 1).sum(axis=0), (rank <= 5).sum(axis=0), rank.sum(axis=0)
    return out


def score_trials(values, members, trials, column="r", ascending=True):
    """Metrics of every trial {name: {member: weight}} in one job.

    `values` has srch_id, prop_id, relevance and the members' values as an array; with several
    array columns all are scored in the same job, and `column` of the result names each.
    Weights are divided by their sum. A task scores whole slates for all trials: the members'
    values are one block, a positive's place is the number of rows of its slate that go
    before, and only sums over the task's slates leave it, one row for each trial. A table that
    is kept by search is not shuffled.
    """
    columns = [column] if isinstance(column, str) else list(column)
    at = {m: i for i, m in enumerate(members)}
    names, weights = list(trials), np.zeros((len(trials), len(members)))
    for i, name in enumerate(names):
        s = float(sum(trials[name].values()))
        for m, x in trials[name].items():
            weights[i, at[m]] = x / s
    width = len(members)

    def run(batches):
        sums, slates, held = np.zeros((len(columns), 5, len(weights))), 0, None
        for b in _with_end(batches):
            if b is not None:
                now = [b.column(k).to_numpy() for k in range(3)] + [_cells(b.column(3 + k), width) for k in range(len(columns))]
                held = now if held is None else [np.concatenate(p) for p in zip(held, now)]
                if len(held[0]) < BLOCK_ROWS:
                    continue
            if held is None or not len(held[0]):
                continue
            # the last slate may go on in the next batch
            end = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1]))
            if end:
                whole = [x[:end] for x in held]
                slates += len(np.unique(whole[0]))
                for k in range(len(columns)):
                    sums[k] += _block_sums(*whole[:3], whole[3 + k], weights, ascending)
                held = [x[end:] for x in held]
        for k, mine in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(weights), k)), pa.array(np.arange(len(weights))), pa.array(np.full(len(weights), slates)),
                                              *[pa.array(x) for x in mine]], names=["c", "t", "slates", "ndcg", "booked", "one", "five", "ranks"])

    rows = values.where(F.col(SEARCH).isNotNull()).select(
        F.col(SEARCH).cast("long"), F.col(ITEM).cast("long"), F.coalesce("relevance", F.lit(0)).cast("long").alias("relevance"),
        *[F.col(c).cast("array<double>").alias(f"v{k}") for k, c in enumerate(columns)])
    # the window brings the rows of a search together, next to each other; buckets by search are used as they are
    rows = rows.withColumn("size", F.count(F.lit(1)).over(W.partitionBy(SEARCH)))
    found = rows.mapInArrow(run, "c long, t long, slates long, ndcg double, booked double, one double, five double, ranks double")
    total_of = found.groupBy("c", "t").agg(*[F.sum(c).alias(c) for c in found.columns[2:]])

    def named(words, at):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (F.col(at) + 1).cast("int"))

    share = lambda c: F.coalesce(ratio(c, "booked"), F.lit(0.0))
    several = [] if isinstance(column, str) else [named(columns, "c").alias("column")]
    return total_of.select(*several, named(names, "t").alias("trial"), ratio("ndcg", "slates").alias("ndcg5"), share("one").alias("recall1"), share("five").alias("recall5"),
                           ratio("ranks", "booked").alias("mean_booked_rank"), F.col("slates").alias("n_queries"), F.col("booked").cast("long").alias("n_booked"))


def _cells(lists, width):
    """Arrays as the rows of a block; a missing array is one of missing values."""
    out = np.full((len(lists), width), np.nan)
    out[lists.is_valid().to_numpy(zero_copy_only=False)] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _with_end(batches):
    """The batches that hold rows, and None behind the last."""
    yield from (b for b in batches if b.num_rows)
    yield None


def deltas(results, base, name="trial", metric="ndcg5"):
    """Difference of every trial to one named trial."""
    at = results.where(F.col(name) == base).select(metric).scalar()
    return results.withColumn("delta", F.col(metric) - at)


def greedy_forward(values, members, start):
    """Add the member that helps most until none does; each step scores all candidates in one job."""
    chosen = [start]
    best = score_trials(values, members, {"0": {start: 1.0}}).first()["ndcg5"]
    path = [(1, start, best)]
    while len(chosen) < len(members):
        rest = [m for m in members if m not in chosen]
        trials = {m: dict.fromkeys([*chosen, m], 1.0) for m in rest}
        top = (score_trials(values, members, trials)
               .orderBy(F.col("ndcg5").desc(), "trial").first())
        if not top["ndcg5"] > best + 1e-12:
            break
        chosen.append(top["trial"])
        best = top["ndcg5"]
        path.append((len(chosen), top["trial"], best))
    return values.sparkSession.createDataFrame(path, "step int, member string, ndcg5 double")


def family_average(preds, family, method="average"):
    """Pseudo-member per family: the mean of its members' ranks (model_id -> family map)."""
    pairs = F.create_map(*[F.lit(x) for kv in family.items() for x in kv])
    ranks = grouped_rank(preds.where(F.col("model_id").isin(list(family))), method)
    return (ranks.withColumn("family", pairs[F.col("model_id")]).groupBy("family", *KEYS)
            .agg(F.avg("rank").alias("rank")))


def eligible(results):
    """KEEP or better, or HOLD with at least +0.0005 and no drift."""
    held = (F.col("decision") == "HOLD") & (F.col("delta") >= 0.0005) & (F.col("high_drift") == 0)
    return results.where(F.col("decision").isin("KEEP", "STRONG_KEEP") | held)


def candidate_pool(models, min_metric, exclude_prefix=None, metric="ndcg5"):
    """Models at or above a metric, best first, without those of a name prefix."""
    out = models.where(F.col(metric) >= min_metric)
    if exclude_prefix:
        out = out.where(~F.col("model_id").startswith(exclude_prefix))
    return out.orderBy(F.col(metric).desc(), "model_id")


def leaderboard(results, group, metric="ndcg5", name="model_id"):
    """Per group: number of rows, best row and mean metric."""
    return results.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(name, F.struct(F.col(metric), F.col(name))).alias("best"),
        F.max(metric).alias("best_metric"), F.avg(metric).alias("mean_metric"))


def top_by(results, metrics_desc, n=10, name="model_id"):
    """The n best rows by each of several (metric, higher is better) pairs."""
    out = None
    for metric, high in metrics_desc:
        order = F.col(metric).desc() if high else F.col(metric).asc()
        one = results.orderBy(order, name).limit(n).select(
            F.lit(metric).alias("metric"), name, F.col(metric).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
