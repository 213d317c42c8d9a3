"""Leak-safe encodings of entity keys.

A search never feeds the encoding of its own rows: rows fall into folds by search,
and a row in fold f sees the other folds only. Each key set reads the columns it needs
and moves the partial results of its own measures, by one map-side combined aggregate over
(key, fold); at most k rows per key become one row per view:
a view for each fold that holds the key (all folds but that one) and one of all folds.
The views are stored once, cut by set, and kept for later calls with the same source,
measures, folds and salt. Training rows join the view of their fold, other tables the
view of all folds.
"""

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bucket_of, clip, num, ratio
from ..functions.groups import hot_groups
from ..functions.small import small_table
from ..schema import SEARCH
from ..session import path_exists, shared_dir

#: The view of all folds.
WHOLE = -1
#: Stored encodings a session keeps for later calls.
KEPT = 32


def _sum(column):
    return f"sum(cast({column} as double))"


def _mean_of(p, s, n):
    return f"try_divide({p(s)}, {p(n)})"


class Measure:
    """One encoded column.

    `parts` names SQL aggregates of the rows, `value` and `overall` are SQL over their
    sums in a view (p maps a part to its column); `mean` is the overall value as SQL.
    """

    def overall(self, p):
        return "0D"


@dataclass(frozen=True)
class Rate(Measure):
    """(sum + prior * mean) / (n + prior)."""

    name: str
    target: str
    prior: float

    def parts(self):
        return {"s": _sum(self.target), "n": f"count({self.target})"}

    def overall(self, p):
        return _mean_of(p, "s", "n")

    def value(self, p, mean):
        return f"try_divide({p('s')} + {float(self.prior)}D * {mean}, {p('n')} + {float(self.prior)}D)"


@dataclass(frozen=True)
class GivenRate(Measure):
    """Successes given trials, smoothed: (successes + prior * g) / (trials + prior)."""

    name: str
    success: str
    trial: str
    prior: float

    def parts(self):
        return {"s": _sum(self.success), "n": _sum(self.trial),
                "gs": f"sum(cast(if({self.trial} = 1, {self.success}, null) as double))", "gn": f"count(if({self.trial} = 1, {self.success}, null))"}

    def overall(self, p):
        return _mean_of(p, "gs", "gn")

    def value(self, p, mean):
        return f"try_divide({p('s')} + {float(self.prior)}D * {mean}, {p('n')} + {float(self.prior)}D)"


@dataclass(frozen=True)
class Total(Measure):
    """Sum of a column over the key, 0 for unseen keys."""

    name: str
    column: str

    def parts(self):
        return {"s": _sum(self.column)}

    def value(self, p, mean):
        return p("s")


@dataclass(frozen=True)
class Count(Measure):
    """Rows with a value, 0 for unseen keys."""

    name: str
    column: str

    def parts(self):
        return {"n": f"count({self.column})"}

    def value(self, p, mean):
        return p("n")


@dataclass(frozen=True)
class Mean(Measure):
    """Mean of a column (optionally of some rows), `fallback` or the overall mean if unseen."""

    name: str
    column: str
    where: str | None = None
    fallback: float | None = None

    def parts(self):
        v = self.column if self.where is None else f"if({self.where}, {self.column}, null)"
        return {"s": _sum(v), "n": f"count({v})"}

    def overall(self, p):
        return _mean_of(p, "s", "n") if self.fallback is None else f"{float(self.fallback)}D"

    def value(self, p, mean):
        return f"coalesce({_mean_of(p, 's', 'n')}, {mean})"


@dataclass(frozen=True)
class Std(Measure):
    """Sample deviation, merged over folds from (n, mean, sum of squared deviations).

    Where all values of a view are equal it is exactly 0, whatever the last bits of the
    folds' means say.
    """

    name: str
    column: str
    fallback: float = 0.0

    def parts(self):
        v = f"cast({self.column} as double)"
        return {"n": f"count({v})", "m": f"avg({v})", "q": f"var_pop({v}) * count({v})", "lo": f"min({v})", "hi": f"max({v})"}

    def merged(self, cell):
        """SQL over the array `views` of folds for the parts that are no sums."""
        n, m, q = cell("n"), cell("m"), cell("q")
        middle = (f"try_divide(aggregate(views, 0D, (a, x) -> a + coalesce(x.{n} * x.{m}, 0D)), "
                  f"aggregate(views, 0D, (a, x) -> a + coalesce(x.{n}, 0D)))")
        squares = (f"aggregate(views, named_struct('s', 0D, 'c', {middle}), "
                   f"(a, x) -> named_struct('s', a.s + coalesce(x.{q} + x.{n} * (x.{m} - a.c) * (x.{m} - a.c), 0D), 'c', a.c), a -> a.s)")
        return {"q": squares, "m": middle, "lo": f"array_min(transform(views, x -> x.{cell('lo')}))",
                "hi": f"array_max(transform(views, x -> x.{cell('hi')}))"}

    def overall(self, p):
        return f"{float(self.fallback)}D"

    def value(self, p, mean):
        return f"coalesce(sqrt(try_divide(if({p('lo')} = {p('hi')}, 0D, {p('q')}), {p('n')} - 1)), {mean})"


@dataclass(frozen=True)
class WeightedRate(Measure):
    """(sum of weight * target + prior * mean) / (sum of weight + prior)."""

    name: str
    weight: str
    target: str
    prior: float

    def parts(self):
        return {"s": f"sum(cast({self.weight} as double) * cast({self.target} as double))", "n": _sum(self.weight),
                "ts": _sum(self.target), "tn": f"count({self.target})"}

    def overall(self, p):
        return _mean_of(p, "ts", "tn")

    def value(self, p, mean):
        return f"try_divide({p('s')} + {float(self.prior)}D * {mean}, {p('n')} + {float(self.prior)}D)"


@dataclass(frozen=True)
class Sum(Measure):
    """A plain sum or count given as SQL, 0 for unseen keys."""

    name: str
    aggregate: str

    def parts(self):
        return {"x": self.aggregate}

    def value(self, p, mean):
        return p("x")


def fold_of(search=SEARCH, k=5, salt=""):
    return bucket_of(search, k, salt)


@dataclass
class Encodings:
    """Stored encodings: (keys, measures) of each set, the views by set, the overall values, and the rows by (set, whole)."""

    sets: list
    path: str
    table: DataFrame
    overall: dict
    cells: dict
    rows: dict

    def cut(self, number, whole):
        """The views of one key set, of all folds or of all but one: its keys, `_at`, and the parts that its measures use."""
        keys, measures = self.sets[number]
        used = sorted({self.cells[sql] for m in measures for sql in m.parts().values()})
        names = {c: f"_e{number}_{c}" for c in used}
        return self.table.where((F.col("_set") == number) & (F.col("_whole") == whole)).select(*keys, "_at", *[F.col(c).alias(n) for c, n in names.items()])

    def large(self, number, whole):
        """Whether a view is too large to broadcast. Files say too little: they are packed, rows in memory are not."""
        width = 16 + 8 * len(self.cut(number, whole).columns)
        return self.rows.get((number, whole), 0) * width > _broadcast_limit(self.table.sparkSession)

    def attach(self, df, at, search=None):
        """Left join every set's view `at` (a fold, or the number WHOLE); unseen keys get the overall values.

        Large views join first, while the rows are narrow, and are never sent to the driver. With
        `search` only the keys go to the large views, and what is found comes back to the rows by
        that column: wide rows stay where they are, and later windows over it need no shuffle.
        """
        whole, at = isinstance(at, int), F.lit(at) if isinstance(at, int) else at
        df = df.withColumn("_at", at.cast("int"))
        large = [number for number, (keys, measures) in enumerate(self.sets) if keys and measures and self.large(number, whole)]
        new = [m.name for _, measures in self.sets for m in measures]
        order = [f"`{c}`" for c in dict.fromkeys([*[c for c in df.columns if c not in new and c != "_at"], *new])]
        apart = bool(large) and search in df.columns and hot_groups(df, [search]) is None and not df.where(F.col(search).isNull()).limit(1).count()
        if apart:
            df = self._fetched(df, sorted(large, key=lambda number: len(self.sets[number][1])), whole, search)
        for number in [*([] if apart else large), *[i for i in range(len(self.sets)) if i not in large]]:
            df = self._joined(df, number, whole, number in large)
        return df.select(*order)

    def _joined(self, df, number, whole, large):
        keys, measures = self.sets[number]
        if not measures:
            return df
        names = [m.name for m in measures]
        keep = [f"`{c}`" for c in df.columns if c not in names]
        view = self.cut(number, whole)
        joined = df.join(view.hint("merge") if large else view, [*keys, "_at"], "left")
        values = []
        for m in measures:
            place = {part: f"_e{number}_{self.cells[sql]}" for part, sql in m.parts().items()}
            mean = f"double('{self.overall[m.name]!r}')" if self.overall[m.name] is not None else "double(null)"
            values.append(f"coalesce({m.value(place.__getitem__, mean)}, {mean}) as `{m.name}`")
        return joined.selectExpr(*keep, *values)

    def _fetched(self, df, numbers, whole, search):
        """The large views' values: joined to the keys alone, and brought back as one list per search."""
        keys = list(dict.fromkeys(key for number in numbers for key in self.sets[number][0]))
        names = [m.name for number in numbers for m in self.sets[number][1]]
        found = df.select(*dict.fromkeys([search, *keys, "_at"])).distinct()
        for number in numbers:
            found = self._joined(found, number, whole, True)
        cells = F.struct(*[F.col(key).alias(f"k{i}") for i, key in enumerate(keys)], *[F.col(n).alias(f"v{i}") for i, n in enumerate(names)])
        lists = found.groupBy(search).agg(F.collect_list(cells).alias("_found"))

        def same(x):
            return reduce(and_, [x[f"k{i}"].eqNullSafe(F.col(key)) for i, key in enumerate(keys)])

        df = df.drop(*names).join(lists, search, "left").withColumn("_found", F.get(F.filter("_found", same), F.lit(0)))
        return df.withColumns({n: F.col("_found")[f"v{i}"] for i, n in enumerate(names)}).drop("_found")


def fit(source, groups, k=5, salt="", search=SEARCH, every=False):
    """The encodings of several (keys, measures) groups, in one job and one stored table.

    With k = 0 there are no folds and only the view of all rows. With `every` a key has a
    view for each fold, not only for those that hold it, as other tables need that leave folds out.
    """
    merged = {}
    for keys, measures in groups:
        merged.setdefault(tuple(keys), []).extend(measures)
    sets = [(list(keys), list(dict.fromkeys(measures))) for keys, measures in merged.items()]
    columns = list(dict.fromkeys(key for keys, _ in sets for key in keys))
    # the set without keys is the whole table
    every = [m for _, measures in sets for m in measures]
    if () not in merged:
        sets.append(([], []))
    total = [keys for keys, _ in sets].index([])
    cells, specials, used = {}, {}, {}
    for number, (_, measures) in enumerate(sets):
        for m in measures if number != total else every:
            for sql in m.parts().values():
                used.setdefault(cells.setdefault(sql, f"p{len(cells)}"), set()).add(number)
    for m in every:
        if hasattr(m, "merged"):
            specials |= {cells[m.parts()[part]]: sql for part, sql in m.merged(lambda part, m=m: cells[m.parts()[part]]).items()}
    rows = source.withColumn("_fold", fold_of(search, k, salt).cast("int") if k else F.lit(0))
    types = {f.name: f.dataType for f in source.schema.fields}

    def views_of(number, keys):
        """The views of one set; its rows carry the partial results of its own measures only."""
        mine = {c: sql for sql, c in cells.items() if number in used[c]}
        present = reduce(lambda df, key: df.where(F.col(key).isNotNull()), keys, rows)
        per_fold = present.groupBy(*keys, "_fold").agg(*[F.expr(f"cast({sql} as double)").alias(c) for c, sql in mine.items()])
        per_key = per_fold.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_fold", *mine))).alias("folds"))
        seen = f"sequence(0, {k - 1})" if every else "transform(folds, x -> x._fold)"
        at = f"explode(concat({seen}, array({WHOLE})))" if k else str(WHOLE)
        views = per_key.selectExpr(*[f"`{c}`" for c in keys], f"{at} as _at", "folds")
        # a key of one fold has nothing to show to that fold: no row, and the overall values, as for an unseen key
        views = views.withColumn("views", F.expr("filter(folds, x -> x._fold <> _at)") if k else F.col("folds")).where("size(views) > 0")
        merges = {c: F.expr(specials.get(c, f"aggregate(views, 0D, (a, x) -> a + coalesce(x.{c}, 0D))")) for c in mine}
        return views.select(F.lit(number).alias("_set"), *[F.col(c) if c in keys else F.lit(None).cast(types[c]).alias(c) for c in columns], "_at",
                            (F.col("_at") == WHOLE).alias("_whole"), *[merges.get(c, F.lit(None).cast("double")).alias(c) for c in cells.values()])

    views = reduce(DataFrame.unionByName, [views_of(i, keys) for i, (keys, measures) in enumerate(sets) if measures or i == total])
    path = f"{shared_dir(source.sparkSession)}/encodings-{uuid.uuid4().hex}"
    views.write.parquet(path, partitionBy=["_set", "_whole"])
    stored = source.sparkSession.read.schema(views.schema).parquet(path)
    whole = stored.where((F.col("_set") == total) & F.col("_whole")).agg(*[F.max(c).alias(c) for c in cells.values()])
    found = whole.selectExpr(*[f"{m.overall(lambda part, m=m: cells[m.parts()[part]])} as `{m.name}`" for m in every]).first()
    rows = {(r["_set"], r["_whole"]): r["count"] for r in stored.groupBy("_set", "_whole").count().collect()}
    return Encodings(sets, path, stored, found.asDict(), cells, rows)


def _broadcast_limit(spark):
    """Bytes up to which the planner broadcasts."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip()
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text) if text[0] != "-" else 0


_kept = []


def fitted(source, groups, k=5, salt="", search=SEARCH, every=False):
    """`fit`, or what an earlier call of this session stored for the same plan over the same files.

    Files that are replaced under their old names are taken for the old ones.
    """
    groups = tuple((tuple(keys), tuple(measures)) for keys, measures in groups)
    app, files = source.sparkSession.sparkContext.applicationId, sorted(source.inputFiles())
    for entry in _kept:
        if entry[0] == (app, groups, k, salt, search, every) and entry[2] == files and entry[1].sameSemantics(source):
            if path_exists(source.sparkSession, entry[3].path):
                return entry[3]
    found = fit(source, groups, k, salt, search, every)
    _kept.insert(0, ((app, groups, k, salt, search, every), source, files, found))
    del _kept[KEPT:]
    return found


def encode_many(df, groups, source=None, k=5, salt="", search=SEARCH, blind=False, together=False):
    """Encodings of several (keys, measures) groups, out of fold unless a source is given.

    With `blind` the rows of a table with another source leave the fold of their own search
    out too. Both tables are then made alike, and what tells them apart is not the way
    they were made.

    With `together` rows are kept by search (see `Encodings.attach`), for wide rows that windows read next.

    The views are stored, so their true size is known: small ones are broadcast and
    large ones shuffled by the planner's own rule, and losing an executor does not
    repeat the aggregation.
    """
    base, by = df if source is None else source, search if together else None
    if source is None or blind:
        return fitted(base, groups, k, salt, search, blind).attach(df, fold_of(search, k, salt), by)
    return fitted(base, groups, k if search in base.columns else 0, salt, search).attach(df, WHOLE, by)


def encode_rows(train, rows, groups, k=5, salt="", search=SEARCH):
    """Out-of-fold encodings of some rows of a training table."""
    return fitted(train, groups, k, salt, search).attach(rows, fold_of(search, k, salt))


def encode_oof(df, keys, measures, k=5, salt="", search=SEARCH):
    """Out-of-fold encodings of a training table."""
    return encode_many(df, [(keys, measures)], None, k, salt, search)


def encode_from(source, df, keys, measures):
    """Encodings of a table from another source table (validation or test side)."""
    return encode_many(df, [(keys, measures)], source)


# The standard encoding set and its smoothing priors.
SINGLE_RATES = (
    (("prop_id",), (Rate("prop_click_rate", "click_bool", 30), Rate("prop_book_rate", "booking_bool", 30),
                    Rate("prop_rel_rate", "relevance", 30))),
    (("srch_destination_id",), (Rate("dest_click_rate", "click_bool", 30), Rate("dest_book_rate", "booking_bool", 30))),
    (("prop_country_id",), (Rate("country_book_rate", "booking_bool", 50),)),
    (("site_id",), (Rate("site_book_rate", "booking_bool", 50),)),
)
PAIR_KEYS = {
    "prop_dest_book_rate": ("prop_id", "srch_destination_id"),
    "site_dest_book_rate": ("site_id", "srch_destination_id"),
    "prop_site_book_rate": ("prop_id", "site_id"),
    "cpair_book_rate": ("visitor_location_country_id", "prop_country_id"),
    "site_country_book_rate": ("site_id", "prop_country_id"),
}
PAIR_PRIORS = {"prop_dest_book_rate": 10, "site_dest_book_rate": 15, "prop_site_book_rate": 15,
               "cpair_book_rate": 20, "site_country_book_rate": 20}
HEAVY_PRIOR = 80
ITEM_STATS = (GivenRate("prop_book_given_click", "booking_bool", "click_bool", 10),
              Total("prop_click_count", "click_bool"), Count("prop_count", "price_usd"),
              Mean("prop_mean_price", "price_usd"), Std("prop_std_price", "price_usd"),
              Mean("prop_avg_position", "position", where="random_bool = 0", fallback=20.0))
DESTINATION_STATS = (Count("dest_count", "price_usd"), Mean("dest_mean_price", "price_usd"),
                     Mean("dest_mean_star", "prop_starrating"), Mean("dest_mean_review", "prop_review_score"))


def pair_rates(priors=None, suffix=""):
    """(keys, measures) of the five pair encodings, by default with their own priors."""
    priors = PAIR_PRIORS if priors is None else priors
    return [(keys, (Rate(n + suffix, "booking_bool", priors[n]),)) for n, keys in PAIR_KEYS.items()]


def heavy_pair_rates():
    return pair_rates({n: HEAVY_PRIOR for n in PAIR_KEYS}, suffix="_heavy")


def encoding_plan():
    """All encodings merged by key set: one aggregation and one join per key set."""
    merged = {}
    for keys, measures in (*SINGLE_RATES, (("prop_id",), ITEM_STATS),
                           (("srch_destination_id",), DESTINATION_STATS), *pair_rates()):
        merged.setdefault(keys, []).extend(measures)
    return merged


PRICE_STATS = (Count("prop_count", "price_usd"), Mean("prop_mean_price", "price_usd"), Std("prop_std_price", "price_usd"))


def price_position(df, k=5, salt=""):
    """Only the item's price statistics, out of fold, and what compares a row with them."""
    return derive_price_position(encode_oof(df, ["prop_id"], PRICE_STATS, k, salt))


def derive_price_position(df):
    """Columns that compare a row with its item's price statistics."""
    usd = num("price_usd")
    std = F.when(F.col("prop_std_price") != 0, F.col("prop_std_price"))
    return df.withColumns({"log_prop_count": F.log1p("prop_count"),
                           "price_vs_prop_mean": usd - F.col("prop_mean_price"),
                           "prop_price_zscore": ratio(usd - F.col("prop_mean_price"), std)})


def derive_destination_gaps(df):
    return df.withColumns({"price_vs_dest_mean": num("price_usd") - F.col("dest_mean_price"),
                           "star_vs_dest_mean": num("prop_starrating") - F.col("dest_mean_star"),
                           "review_vs_dest_mean": num("prop_review_score") - F.col("dest_mean_review")})


def entity_encodings(df, source=None, k=5, salt="", blind=False):
    """Every standard encoding: out of fold without a source, from the source otherwise."""
    df = encode_many(df, encoding_plan().items(), source, k, salt, blind=blind, together=True)
    return derive_destination_gaps(derive_price_position(df))


def position_rates(train, target):
    """Mean target per position, the overall mean where a position has none."""
    mean = train.agg(F.avg(target)).scalar()
    rates = train.groupBy("position").agg(F.avg(target).alias("_rate"))
    return rates.withColumn("_rate", F.when(F.col("_rate") > 0, F.col("_rate")).otherwise(mean))


def with_exposure_weight(train, target, bounds):
    mean = train.agg(F.avg(target)).scalar()
    rates = small_table(position_rates(train, target))
    joined = train.join(rates, "position", "left")
    return joined.withColumn("_w", clip(ratio(mean, "_rate"), *bounds)).drop("_rate")


def exposure_weights(train, targets, bounds=(0.2, 3.0)):
    """The table with a weight `_w_<target>` for each target, all of them by one join with the positions."""
    means = train.agg(*[F.avg(t).alias(t) for t in targets]).first()
    rates = train.groupBy("position").agg(*[F.avg(t).alias(t) for t in targets])

    def weight(t):
        mean = F.lit(means[t]).cast("double")
        return clip(ratio(mean, F.when(F.col(t) > 0, F.col(t)).otherwise(mean)), *bounds).alias(f"_w_{t}")

    return train.join(small_table(rates.select("position", *[weight(t) for t in targets])), "position", "left")


def position_adjusted(train, target, name, other=None, alpha=40.0, bounds=(0.2, 3.0), k=5, salt=""):
    """Item rate with clicks weighted by how little their position favours them.

    Out of fold for the training table itself, from all of it for `other`.
    """
    measures = (WeightedRate(name, "_w", target, alpha),)
    weighted = with_exposure_weight(train, target, bounds)
    if other is None:
        return encode_oof(weighted, ["prop_id"], measures, k, salt).drop("_w")
    return encode_from(weighted, other, ["prop_id"], measures)


def fallback_groups(a, b, target):
    """The sums that `fallback_value` needs, as (keys, measures) groups."""
    def sums(tag):
        return [Sum(f"_{tag}_s", _sum(target)), Sum(f"_{tag}_n", f"count({target})")]

    return [((), sums("all")), ((a, b), sums("pair")), ((a,), sums("a")), ((b,), sums("b"))]


def fallback_value(df, name, alpha=40.0, mix=(0.5, 0.3, 0.2)):
    """The pair rate shrunk to a mix of both single rates and the overall rate, from attached sums."""
    wa, wb, wg = mix
    g = ratio("_all_s", "_all_n")
    back = (wa * F.coalesce(ratio("_a_s", "_a_n"), g) + wb * F.coalesce(ratio("_b_s", "_b_n"), g) + wg * g)
    value = ratio(F.col("_pair_s") + alpha * back, F.col("_pair_n") + alpha)
    return df.withColumn(name, value).drop(*[f"_{t}_{x}" for t in ("all", "pair", "a", "b") for x in "sn"])


def pair_with_fallback(train, a, b, target, name, other=None, alpha=40.0, mix=(0.5, 0.3, 0.2), k=5, salt=""):
    """Pair rate shrunk to a mix of both single rates and the overall rate.

    On the training side every one of them, the overall rate too, leaves the
    row's own fold out.
    """
    df = encode_many(train if other is None else other, fallback_groups(a, b, target), None if other is None else train, k, salt)
    return fallback_value(df, name, alpha, mix)
