"""Ranks and statistics inside groups, safe when one group holds much of the table.

A slate normally has tens of rows, and one shuffle with window functions is the
right plan. A group above `WINDOW_LIMIT` rows would be one task's work, so such
groups (and only those) go another way: statistics by map-side combined
aggregation and a join back, ranks by counting distinct values in value slices
(`value_ranks`). Both ways give the same rows and values.
"""

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialise
from .exprs import col

WINDOW_LIMIT = 2_000_000
#: A row of more columns goes through the sorts of ranks as one value, beside the columns that are ranked.
WIDE_ROW = 40
_NOTE = "largest_group"


@dataclass(frozen=True)
class Rank:
    """A rank column. method: min, average, first (ties by `tie`); pct divides by the count.

    Rows that agree in the value and in `tie` share the place of the first of them.
    """

    name: str
    value: Column | str
    desc: bool = False
    method: str = "min"
    pct: bool = False
    tie: str = "prop_id"


@dataclass(frozen=True)
class Stat:
    """A group statistic repeated on every row; `median` takes a value instead of `agg`."""

    name: str
    agg: Column | None = None
    median: Column | str | None = None


def note_group_size(df, key):
    """Count rows per key once and keep the largest count as metadata of the key column.

    Metadata follows the column through filters, projections, joins on the key
    and parquet files, so later operators need no second look.
    """
    return noted(df, key, df.groupBy(key).count().agg(F.max("count")).first()[0] or 0)


def noted(df, key, top):
    """Note that no group of the key has more than `top` rows."""
    return df.withColumn(key, F.col(key).alias(key, metadata={_NOTE: int(top)}))


def hot_groups(df, by, limit=None):
    """Keys of the groups above the limit as a DataFrame, or None when there are none."""
    limit = WINDOW_LIMIT if limit is None else limit
    for f in df.schema.fields:
        if f.name in by and f.metadata.get(_NOTE, limit + 1) <= limit:
            return None
    hot = df.groupBy(*by).count().where(F.col("count") > limit).select(*by)
    return hot if hot.limit(1).count() else None


def within(df, by, ranks=(), stats=(), limit=None):
    """Add rank and statistic columns computed inside the groups of `by`."""
    by = list(by)
    if hot_groups(df, by, limit) is None:
        return _by_window(df, by, ranks, stats)
    # one text per group, so that NULL keys are a group here as they are in a window
    text = F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n")) for k in by])
    named = df.withColumn("_group", text)
    hot = hot_groups(named, ["_group"], limit)
    cold_rows = named.join(hot, "_group", "left_anti").drop("_group")
    hot_rows = named.join(hot, "_group", "left_semi")
    return _by_window(cold_rows, by, ranks, stats).unionByName(
        _by_aggregation(hot_rows, ["_group"], ranks, stats).drop("_group"))


def _by_window(df, by, ranks, stats):
    w = W.partitionBy(*by)
    out = [s.agg.over(w).alias(s.name) if s.median is None
           else F.percentile(s.median, 0.5).over(w).alias(s.name) for s in stats]
    new = {s.name for s in stats} | {r.name for r in ranks}
    base = [c for c in df.columns if c not in new]
    if not ranks or not WIDE_ROW < len(base) == len(df.columns):
        return df.select(*base, *out, *_ranks_over(w, ranks))
    # each window copies a row cell by cell: what no rank reads is one cell
    named = [r if isinstance(r.value, str) else replace(r, value=f"_value{i}") for i, r in enumerate(ranks)]
    read = dict.fromkeys([*by, *[r.value for r in ranks if isinstance(r.value, str)], *[r.tie for r in ranks if r.method == "first"]])
    rest = [c for c in [*base, *[s.name for s in stats]] if c not in read]
    packed = df.select(*base, *out).select(*read, *[r.value.alias(n.value) for r, n in zip(ranks, named) if r is not n], F.struct(*[f"`{c}`" for c in rest]).alias("_row"))
    ranked = packed.select(*read, "_row", *_ranks_over(w, named))
    return ranked.select(*[F.col(c) if c in read else F.col("_row").getField(c).alias(c) for c in [*base, *[s.name for s in stats]]], *[r.name for r in ranks])


def _ranks_over(w, ranks):
    """The rank columns over a window of groups."""
    out = []
    falling = {r.value for r in ranks if r.desc and r.method == "min" and isinstance(r.value, str)}
    for r in ranks:
        v = col(r.value)
        # an average place counted from the other end: the order that another rank needs anyway serves both
        turned = r.method == "average" and not r.desc and isinstance(r.value, str) and r.value in falling
        order = v.desc_nulls_last() if r.desc or turned else v.asc_nulls_last()
        if r.method == "first":
            rank = F.rank().over(w.orderBy(order, F.col(r.tie).asc_nulls_last()))
            out.append(rank.alias(r.name))
            continue
        # NULLs sort last, so the ranks of the other rows do not depend on them.
        rank = F.rank().over(w.orderBy(order))
        if r.method == "average":
            # rows up to the last of the equal ones, in the same order: no second sort
            rank = (rank + F.count(F.lit(1)).over(w.orderBy(order))) / 2
        if turned:
            rank = F.count(v).over(w) + 1 - rank
        if r.pct:
            rank = rank / F.count(v).over(w)
        out.append(F.when(v.isNotNull(), rank).alias(r.name))
    return out


def _by_aggregation(df, by, ranks, stats):
    plain = [s.agg.alias(s.name) for s in stats if s.median is None]
    if plain:
        table = df.groupBy(*by).agg(*plain)
        df = df.drop(*[s.name for s in stats if s.median is None]).join(table, by, "left")
    for s in stats:
        if s.median is not None:
            mid = quantiles(df.select(*by, col(s.median).alias("_v")), "_v", [0.5], by)
            df = df.drop(s.name).join(mid.select(*by, F.col("q")[0].alias(s.name)), by, "left")
    for r in ranks:
        df = _rank_by_slices(df, by, r)
    names = [s.name for s in stats] + [r.name for r in ranks]
    base = [c for c in df.columns if c not in names]
    return df.select(*base, *names)


def _rank_by_slices(df, by, r):
    df = df.withColumn("_v", col(r.value))
    table = value_ranks(df, "_v", by)
    below = F.col("_total") - F.col("_before") - F.col("_n") if r.desc else F.col("_before")
    if r.method == "first":
        # position of the value, then position of the tie breaker among equal values;
        # rows without a value follow all others, rows without a tie breaker the rest of their value
        df = df.join(table, [*by, "_v"], "left")
        sizes = df.groupBy(*by).agg(F.count("_v").alias("_valued"))
        df = df.join(sizes, by).withColumn(
            "_start", F.coalesce(below, F.col("_valued"))).drop("_n", "_before", "_total", "_valued")
        ties = value_ranks(df.withColumn("_t", F.col(r.tie)), "_t", [*by, "_start"])
        tied = ties.groupBy(*by, "_start").agg(F.first("_total").alias("_with_tie"))
        df = (df.withColumn("_t", F.col(r.tie)).join(ties, [*by, "_start", "_t"], "left")
              .join(tied, [*by, "_start"], "left"))
        rank = (F.col("_start") + F.coalesce("_before", "_with_tie", F.lit(0)) + 1).cast("int")
        return df.withColumn(r.name, rank).drop(
            "_v", "_t", "_start", "_n", "_before", "_total", "_with_tie")
    rank = below + 1
    if r.method == "average":
        rank = rank + (F.col("_n") - 1) / 2
    if r.pct:
        rank = rank / F.col("_total")
    df = df.join(table, [*by, "_v"], "left")
    return df.withColumn(r.name, rank).drop("_v", "_n", "_before", "_total")


def value_counts(df, value, by=(), weight=None, mark=None, carry=()):
    """Rows per (by, distinct value) as a stored table, with the sums of `carry`, and whether it is small.

    The source is read once: the counts (combined map-side) go to the shared
    folder, their true number is then known, and later steps read the counts.
    """
    by = list(by)
    rows = F.lit(1) if weight is None else F.col(weight)
    cells = [F.sum(rows).alias("_n")]
    if mark is not None:
        cells.append(F.sum(rows * F.col(mark)).alias("_m"))
    cells += [F.sum(c).alias(c) for c in carry]
    present = df.where(F.col(value).isNotNull())
    for key in by:
        present = present.where(F.col(key).isNotNull())
    counts = materialise(present.groupBy(*by, value).agg(*cells), "value_counts")
    return counts, counts.count() <= WINDOW_LIMIT


def value_ranks(df, value, by=(), weight=None, mark=None, slices=None, small=None, carry=()):
    """One row per (by, distinct value): _n rows, _before rows below it, _total rows.

    The exact rank of any row follows from this table. A small table of counts
    (checked) takes one window. A large one is cut into slices at approximate
    quantiles; each slice is ordered alone and shifted by the rows of the slices
    before it, so no task orders a whole group. The cut points only balance the
    work, the ranks are exact whatever they are.

    `weight` names a column of row counts where the input is counted already.
    `mark` is a 0/1 column counted alongside as _m, _m_before and _m_total.
    The columns of `carry` are summed over the rows of each value.
    """
    by = list(by)
    counts, is_small = value_counts(df, value, by, weight, mark, carry)
    parts = [("_n", "")] + ([("_m", "_m")] if mark is not None else [])
    over = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    below = (W.unboundedPreceding, -1)
    if is_small if small is None else small:
        out = []
        for n, pre in parts:
            out += [n, F.coalesce(F.sum(n).over(over.orderBy(value).rowsBetween(*below)), F.lit(0)).alias(f"{pre}_before"),
                    F.sum(n).over(over).alias(f"{pre}_total")]
        return counts.select(*by, value, *out, *carry)
    if slices is None:
        # so many slices that none holds more distinct values than a window takes, and enough for the cores
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slices = max(16, width, -(-2 * counts.count() // WINDOW_LIMIT))
    points = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = F.percentile_approx(value, points, F.lit(1000))
    if by:
        keyed = counts.join(counts.groupBy(*by).agg(cuts.alias("_cuts")), by)
    else:
        keyed = counts.withColumn("_cuts", counts.agg(cuts).scalar())
    # never NULL: else the join below would push an IS NOT NULL on it down to every row
    slice_no = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))
    keyed = keyed.withColumn("_slice", slice_no).drop("_cuts")
    sizes = keyed.groupBy(*by, "_slice").agg(*[F.sum(n).alias(n) for n, _ in parts])
    # at most `slices` rows per group from here on
    earlier = over.orderBy("_slice").rowsBetween(*below)
    inside = W.partitionBy(*by, "_slice").orderBy(value).rowsBetween(*below)
    shifts, sums, out = [], [], []
    for n, pre in parts:
        shifts += [F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_shift"), F.sum(n).over(over).alias(f"{pre}_total")]
        sums.append(F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"{n}_inner"))
        out += [n, (F.col(f"{n}_shift") + F.col(f"{n}_inner")).alias(f"{pre}_before"), f"{pre}_total"]
    keyed = keyed.select("*", *sums)
    return keyed.join(sizes.select(*by, "_slice", *shifts), [*by, "_slice"]).select(*by, value, *out, *carry)


def quantiles(df, value, probs, by=(), small=None):
    """Exact quantiles with linear interpolation: one row per group, array column `q`."""
    by = list(by)
    counts, is_small = value_counts(df, value, by)
    if is_small if small is None else small:
        at = F.array(*[F.lit(float(p)) for p in probs])
        return counts.groupBy(*by).agg(F.percentile(F.col(value).cast("double"), at, F.col("_n")).alias("q"))
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    first, last = F.col("_before"), F.col("_before") + F.col("_n") - 1

    def at(p):
        return p["p"] * (F.col("_total") - 1)

    # a value matters to the few quantiles whose lower or upper neighbour it holds
    near = F.filter(points, lambda p: (F.ceil(at(p)) >= first) & (F.floor(at(p)) <= last))
    hits = value_ranks(counts, value, by, weight="_n", small=False).select(
        *by, F.col(value).cast("double").alias("_x"), "_before", "_n", "_total", F.explode(near).alias("_p"))
    p = F.col("_p")
    low, high = F.floor(at(p)), F.ceil(at(p))
    ends = hits.groupBy(*by, "_p").agg(
        F.max(F.when(low.between(first, last), F.col("_x"))).alias("_lo"),
        F.max(F.when(high.between(first, last), F.col("_x"))).alias("_hi"), F.max(at(p) - low).alias("_d"))
    q = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_d")
    return ends.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(p["i"].alias("i"), q.alias("q")))), lambda x: x["q"]).alias("q"))
