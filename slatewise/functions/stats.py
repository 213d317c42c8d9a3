"""Distribution statistics over whole columns: correlation, KS, AUC, chi-square, bins.

Everything that needs an order of all rows goes through `value_ranks`, so no
window without a partition key and no single task ever sees a whole column.
"""

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from .exprs import col, flag, num, ratio
from .groups import quantiles, value_ranks
from .small import small_table


def corr_of(x, y, n=None):
    """Pearson correlation as an aggregate; NULL (not an error) if a side is constant."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(vx * vy))


def _placed(df, targets, others, by):
    """Rows with the targets' centred mean ranks, and what a correlation needs to know of them.

    Column i of the rows is `c<i>`; `r<i>` of a target is an array of its ranks: among all rows, then
    among the rows that have a value in each column of `others` with gaps. Values are counted
    once for all of these, and the ranks of values are joined to the rows. Returns the rows, the number of a
    column, the place of its gaps in the arrays, and (t, g, squares, n): sums over a target's ranks.
    """
    names = list(dict.fromkeys([*targets, *others]))
    place = {c: i for i, c in enumerate(names)}
    rows = df.select(*by, *[num(c).alias(f"c{i}") for c, i in place.items()])
    for key in by:
        rows = rows.where(F.col(key).isNotNull())
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"c{i}").alias(f"c{i}") for i in place.values()]).first()
    gaps = [c for c in dict.fromkeys(others) if found[f"c{place[c]}"] < found["n"]]
    at = {c: gaps.index(c) + 1 if c in gaps else 0 for c in others}
    marks = [F.lit(1), *[flag(F.col(f"c{place[c]}").isNotNull()) for c in gaps]]
    kinds = [f"g{i}" for i in range(len(marks))]
    cells = F.explode(F.array(*[F.struct(F.lit(place[t]).alias("t"), F.col(f"c{place[t]}").alias("y")) for t in targets]))
    long = rows.select(*by, *[m.alias(g) for m, g in zip(marks, kinds)], cells.alias("p")).select(*by, *kinds, "p.*")
    counts = long.where(F.col("y").isNotNull()).groupBy(*by, "t", "y").agg(*[F.sum(g).alias(g) for g in kinds])
    each = counts.select(*by, "t", "y", F.posexplode(F.array(*kinds)).alias("g", "c")).where("c > 0")
    ranks = value_ranks(each, "y", [*by, "t", "g"], weight="c").withColumn("r", F.expr(MIDDLE))
    path = f"{shared_dir(df.sparkSession)}/ranks-{uuid.uuid4().hex}"
    ranks.groupBy(*by, "t", "y").agg(*[F.max(F.when(F.col("g") == i, F.col("r"))).alias(g) for i, g in enumerate(kinds)]).write.partitionBy("t").parquet(path)
    for t in dict.fromkeys(targets):
        own, name = f"c{place[t]}", f"r{place[t]}"
        if found[own]:
            table = df.sparkSession.read.parquet(f"{path}/t={place[t]}").select(*by, F.col("y").alias(own), F.array(*kinds).alias(name))
            rows = rows.join(table, [*by, own], "left")
        else:
            rows = rows.withColumn(name, F.lit(None).cast("array<double>"))
    sums = ranks.groupBy(*by, "t", "g").agg(F.sum(F.col("_n") * F.col("r") * F.col("r")).alias("squares"), F.sum("_n").alias("n"))
    return rows, place, at, small_table(sums)


#: Mean rank of a value's rows, centred on the known mean, so that plain sums of products suffice.
MIDDLE = "_before + (_n + 1) / 2 - (_total + 1) / 2"


def spearman(df, features, targets, by=(), min_rows=2):
    """Spearman correlation of every feature with every target, pairwise complete rows.

    One row per (by, feature, target): rho and n. The targets' ranks are joined to the rows; a
    feature is counted by its values alone, with the sum of those ranks, so no table of value pairs is made.
    """
    by, features = list(by), list(dict.fromkeys(features))
    rows, place, at, sums = _placed(df, targets, features, by)
    cells = [(f, t) for f in features for t in dict.fromkeys(targets) if f != t]
    each = F.explode(F.array(*[F.struct(F.lit(place[f]).alias("f"), F.lit(place[t]).alias("t"), F.lit(at[f]).alias("g"), F.col(f"c{place[f]}").alias("x"),
                                        F.col(f"r{place[t]}")[at[f]].alias("y")) for f, t in cells]))
    long = rows.select(*by, each.alias("p")).select(*by, "p.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranks = value_ranks(long, "x", [*by, "f", "t", "g"], carry=["y"]).withColumn("r", F.expr(MIDDLE))
    parts = ranks.groupBy(*by, "f", "t", "g").agg(F.sum(F.col("r") * F.col("y")).alias("xy"), F.sum(F.col("_n") * F.col("r") * F.col("r")).alias("xx"))
    names = F.array(*[F.lit(c) for c in place])
    return (parts.join(sums, [*by, "t", "g"]).where(F.col("n") >= min_rows)
            .select(*by, names[F.col("f")].alias("feature"), names[F.col("t")].alias("target"),
                    F.try_divide("xy", F.sqrt(F.col("xx") * F.col("squares"))).alias("rho"), "n"))


def spearman_matrix(df, columns, by=()):
    """Symmetric Spearman matrix in long form, each unordered pair computed once.

    All ranks are joined to the rows, and one aggregate sums the products of every pair.
    """
    by, columns = list(by), list(columns)
    rows, place, at, sums = _placed(df, columns, columns, by)
    upper = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    products = [F.sum(F.col(f"r{place[a]}")[at[b]] * F.col(f"r{place[b]}")[at[a]]).alias(f"p{i}") for i, (a, b) in enumerate(upper)]
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(place[a]).alias("ta"), F.lit(at[b]).alias("ga"),
                                         F.lit(place[b]).alias("tb"), F.lit(at[a]).alias("gb"), F.col(f"p{i}").alias("xy")) for i, (a, b) in enumerate(upper)]))
    parts = rows.groupBy(*by).agg(*products).select(*by, cells.alias("p")).select(*by, "p.*")
    left = sums.select(*by, F.col("t").alias("ta"), F.col("g").alias("ga"), F.col("squares").alias("xx"), "n")
    right = sums.select(*by, F.col("t").alias("tb"), F.col("g").alias("gb"), F.col("squares").alias("yy"))
    rho = parts.join(left, [*by, "ta", "ga"]).join(right, [*by, "tb", "gb"]).where("n >= 2").select(
        *by, "a", "b", F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"), "n")
    return rho.unionByName(rho.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "rho", "n"))


def ks_two_sample(left, right, columns):
    """Kolmogorov-Smirnov distance of each column between two tables, on all rows; NULL if a side has no values."""
    def side(df, mark):
        return df.select(F.lit(mark).alias("m"), *[num(c).alias(c) for c in columns])
    both = side(left, 0).unionByName(side(right, 1)).unpivot(["m"], list(columns), "feature", "x")
    t = value_ranks(both, "x", ["feature"], mark="m")
    right_share = ratio(F.col("_m_before") + F.col("_m"), "_m_total")
    left_share = ratio(F.col("_before") + F.col("_n") - F.col("_m_before") - F.col("_m"), F.col("_total") - F.col("_m_total"))
    return t.groupBy("feature").agg(F.max(F.abs(left_share - right_share)).alias("ks"))


def auc(df, score, positive, by=()):
    """Area under the ROC curve with ties counted half: one row per group of `by`."""
    by = list(by)
    t = value_ranks(df.select(*by, num(score).alias("s"), col(positive).cast("int").alias("m")),
                    "s", by, mark="m")
    below = F.col("_before") - F.col("_m_before")
    ties = F.col("_n") - F.col("_m")
    wins = F.sum(F.col("_m") * (below + ties / 2))
    pos, neg = F.max("_m_total"), F.max(F.col("_total") - F.col("_m_total"))
    return t.groupBy(*by).agg(ratio(wins, pos * neg).alias("auc"),
                              pos.alias("n_pos"), neg.alias("n_neg"))


def chi_square_2x2(a, b, c, d):
    """Yates-corrected chi-square of a 2x2 table of counts (columns), as a column."""
    a, b, c, d = num(a), num(b), num(c), num(d)
    n = a + b + c + d
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return F.try_divide(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d))


def bin_of(value, edges, lowest=True):
    """1-based right-closed bin of a value among sorted edges; NULL outside of them."""
    x = num(value)
    below = F.size(F.filter(edges, lambda e: e < x))
    bin_no = F.when((x > edges[0]) & (x <= F.element_at(edges, -1)), below)
    if lowest:
        bin_no = F.when(x == edges[0], 1).otherwise(bin_no)
    return F.when(x.isNotNull(), bin_no)


def quantile_edges(df, value, n):
    """The n-quantile edges of a column as a one-row scalar array, repeated edges dropped."""
    probs = [i / n for i in range(n + 1)]
    q = quantiles(df.select(num(value).alias("v")), "v", probs)
    return q.select(F.array_distinct("q")).scalar()


def quantile_bins(df, value, n, name="bin", edges_from=None):
    """Add the quantile bin (1..n) of a column, edges from `edges_from` or the table itself."""
    edges = quantile_edges(df if edges_from is None else edges_from, value, n)
    return df.withColumn("_edges", edges).withColumn(
        name, bin_of(value, F.col("_edges"))).drop("_edges")


def width_edges(df, value, n):
    """n equal-width edges between minimum and maximum, the lowest moved out by 0.1 %."""
    lo, hi = F.min(num(value)), F.max(num(value))
    steps = [lo - (hi - lo) * F.lit(0.001)] + [lo + (hi - lo) * F.lit(i) / F.lit(n) for i in range(1, n)] + [hi]
    return df.agg(F.array(*steps)).scalar()


def cut_bins(df, value, edges, name="bin", lowest=False):
    """Add the bin of a column among fixed edges."""
    at = F.array(*[F.lit(float(e)) for e in edges])
    return df.withColumn(name, bin_of(value, at, lowest))
