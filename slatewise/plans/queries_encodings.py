"""Encoding and propensity queries."""

from pyspark.sql import functions as F

from ..operators import encodings as E
from ..operators import propensity as P
from ..operators import row_features as R
from ..operators.listwise import ENCODINGS, pct_rank_in_group
from .features import build_features
from .registry import bucket_sql, query, view

KEY = "srch_id prop_id"

view("fl", f"SELECT *, {bucket_sql('srch_id', 5)} AS fold FROM lab")
view("folds", "SELECT unnest([0, 1, 2, 3, 4]) AS f")
view("starts", """SELECT srch_id, min(date_time) AS t, row_number() OVER (ORDER BY min(date_time), srch_id) AS rn,
  count(*) OVER () AS n FROM lab GROUP BY srch_id""")
view("tr", "SELECT * FROM lab WHERE srch_id IN (SELECT srch_id FROM starts WHERE rn <= floor(0.8e0 * n))")
view("va", "SELECT * FROM lab WHERE srch_id IN (SELECT srch_id FROM starts WHERE rn > floor(0.8e0 * n))")

# measure name -> (value SQL over sums, fallback SQL over the source)
RATES = {m.name: (keys, m) for keys, ms in (*E.SINGLE_RATES, *E.pair_rates()) for m in ms}


def _rate_value(m, src):
    mu = f"(SELECT avg({m.target}) FROM {src})"
    return (f"(sum({m.target}) + {m.prior} * {mu}) / (count({m.target}) + {m.prior})", mu)


def stat_sql(name, src):
    """(aggregate, fallback) of a named measure."""
    if name in RATES:
        return _rate_value(RATES[name][1], src)
    g = f"(SELECT avg(booking_bool) FROM {src} WHERE click_bool = 1)"
    return {
        "prop_book_given_click": (f"(sum(booking_bool) + 10 * {g}) / (sum(click_bool) + 10)", g),
        "prop_click_count": ("sum(click_bool)", "0"), "prop_count": ("count(price_usd)", "0"),
        "prop_mean_price": ("avg(price_usd)", f"(SELECT avg(price_usd) FROM {src})"),
        "prop_std_price": ("stddev_samp(price_usd)", "0"),
        "prop_avg_position": ("avg(position) FILTER (random_bool = 0)", "20"),
        "dest_count": ("count(price_usd)", "0"),
        "dest_mean_price": ("avg(price_usd)", f"(SELECT avg(price_usd) FROM {src})"),
        "dest_mean_star": ("avg(prop_starrating)", f"(SELECT avg(prop_starrating) FROM {src})"),
        "dest_mean_review": ("avg(prop_review_score)", f"(SELECT avg(prop_review_score) FROM {src})"),
    }[name]


def oof_sql(specs):
    """Out-of-fold columns for [(keys, [names])]: a separate aggregate per fold and key set."""
    cols, joins = [], []
    for i, (keys, names) in enumerate(specs):
        ks = ", ".join(f"s.{k}" for k in keys)
        aggs = ", ".join(f"{stat_sql(n, 'fl')[0]} AS {n}" for n in names)
        on = " AND ".join(f"e{i}.{k} = r.{k}" for k in keys)
        joins.append(f"LEFT JOIN (SELECT f, {ks}, {aggs} FROM folds JOIN fl s ON s.fold <> f GROUP BY f, {ks}) e{i} "
                     f"ON e{i}.f = r.fold AND {on}")
        cols += [f"coalesce(e{i}.{n}, {stat_sql(n, 'fl')[1]}) AS {n}" for n in names]
    return f"SELECT r.*, {', '.join(cols)} FROM fl r {' '.join(joins)}"


def from_sql(specs, src="tr", dst="va"):
    cols, joins = [], []
    for i, (keys, names) in enumerate(specs):
        ks = ", ".join(keys)
        aggs = ", ".join(f"{stat_sql(n, src)[0]} AS {n}" for n in names)
        on = " AND ".join(f"e{i}.{k} = r.{k}" for k in keys)
        joins.append(f"LEFT JOIN (SELECT {ks}, {aggs} FROM {src} GROUP BY {ks}) e{i} ON {on}")
        cols += [f"coalesce(e{i}.{n}, {stat_sql(n, src)[1]}) AS {n}" for n in names]
    return f"SELECT r.*, {', '.join(cols)} FROM {dst} r {' '.join(joins)}"


ITEM, DEST = ["prop_id"], ["srch_destination_id"]
ALL = [(list(k), [m.name for m in ms]) for k, ms in E.encoding_plan().items()]
view("enc0", oof_sql(ALL))
view("enc", """SELECT *, ln(1 + prop_count) AS log_prop_count, price_usd - prop_mean_price AS price_vs_prop_mean,
  (price_usd - prop_mean_price) / nullif(prop_std_price, 0) AS prop_price_zscore,
  price_usd - dest_mean_price AS price_vs_dest_mean, prop_starrating - dest_mean_star AS star_vs_dest_mean,
  prop_review_score - dest_mean_review AS review_vs_dest_mean FROM enc0""")
view("encv0", from_sql(ALL))
view("encv", """SELECT *, ln(1 + prop_count) AS log_prop_count, price_usd - prop_mean_price AS price_vs_prop_mean,
  (price_usd - prop_mean_price) / nullif(prop_std_price, 0) AS prop_price_zscore,
  price_usd - dest_mean_price AS price_vs_dest_mean, prop_starrating - dest_mean_star AS star_vs_dest_mean,
  prop_review_score - dest_mean_review AS review_vs_dest_mean FROM encv0""")


several = E.encode_many


def names(measures):
    return [m.name for m in measures]


query("e1_search_folds", lambda t: t.impressions.withColumn("fold", E.fold_of()), "SELECT * FROM fl",
      ints=KEY + " fold")
CLICK = E.Rate("prop_click_rate", "click_bool", 30)
query("e2_oof_target", lambda t: E.encode_oof(t.labelled, ITEM, [CLICK]), oof_sql([(ITEM, ["prop_click_rate"])]),
      ints=KEY, nums="prop_click_rate")
query("e3_target_from_source", lambda t: E.encode_from(t.sides[0], t.sides[1], ITEM, [CLICK]),
      from_sql([(ITEM, ["prop_click_rate"])]), ints=KEY, nums="prop_click_rate")
SINGLE = " ".join(n for k, ms in E.SINGLE_RATES for n in names(ms))
query("e4_single_key_rates", lambda t: several(t.labelled, E.SINGLE_RATES),
      oof_sql([(list(k), names(ms)) for k, ms in E.SINGLE_RATES]), ints=KEY, nums=SINGLE)
query("e5_pair_rates", lambda t: several(t.labelled, E.pair_rates()),
      oof_sql([(list(k), [n]) for n, k in E.PAIR_KEYS.items()]), ints=KEY, nums=" ".join(E.PAIR_KEYS))


def _heavy_sql():
    joins, cols = [], []
    for i, (n, keys) in enumerate(E.PAIR_KEYS.items()):
        ks = ", ".join(f"s.{k}" for k in keys)
        on = " AND ".join(f"e{i}.{k} = r.{k}" for k in keys)
        joins.append(f"LEFT JOIN (SELECT f, {ks}, sum(booking_bool) AS s, count(*) AS c FROM folds JOIN fl s ON s.fold <> f "
                     f"GROUP BY f, {ks}) e{i} ON e{i}.f = r.fold AND {on}")
        cols.append(f"(coalesce(e{i}.s, 0) + 80 * mu) / (coalesce(e{i}.c, 0) + 80) AS {n}_heavy")
    return (f"SELECT r.srch_id, r.prop_id, {', '.join(cols)} FROM fl r {' '.join(joins)}, "
            "(SELECT avg(booking_bool) AS mu FROM lab)")


query("e6_heavy_pair_rates", lambda t: several(t.labelled, E.heavy_pair_rates()), _heavy_sql(), ints=KEY,
      nums=" ".join(f"{n}_heavy" for n in E.PAIR_KEYS))
BGC = [E.GivenRate("prop_book_given_click", "booking_bool", "click_bool", 10)]
query("e7_book_given_click", lambda t: E.encode_oof(t.labelled, ITEM, BGC),
      oof_sql([(ITEM, ["prop_book_given_click"])]), ints=KEY, nums="prop_book_given_click")
query("e8_click_count", lambda t: E.encode_oof(t.labelled, ITEM, [E.Total("prop_click_count", "click_bool")]),
      oof_sql([(ITEM, ["prop_click_count"])]), ints=KEY + " prop_click_count")
STATS = [E.Count("dest_count", "price_usd"), E.Mean("dest_mean_price", "price_usd")]
query("e9_group_stats", lambda t: E.encode_oof(t.labelled, DEST, STATS),
      oof_sql([(DEST, ["dest_count", "dest_mean_price"])]), ints=KEY + " dest_count", nums="dest_mean_price")
query("e9_group_stats_from_source",
      lambda t: E.encode_from(t.sides[0], t.sides[1], ITEM, [m for m in E.ITEM_STATS if "price" in m.name]),
      from_sql([(ITEM, ["prop_mean_price", "prop_std_price"])]), ints=KEY, nums="prop_mean_price prop_std_price")
query("e10_entity_counts", lambda t: several(
    t.labelled, [(ITEM, [E.Count("prop_count", "price_usd")]), (DEST, STATS[:1])]).withColumn("log_prop_count", F.log1p("prop_count")), "SELECT * FROM enc",
      ints=KEY + " prop_count dest_count", nums="log_prop_count")
PRICES = [E.Mean("prop_mean_price", "price_usd"), E.Std("prop_std_price", "price_usd")]
query("e11_price_stats", lambda t: E.derive_price_position(
    E.encode_oof(t.labelled, ITEM, [*PRICES, E.Count("prop_count", "price_usd")])), "SELECT * FROM enc", ints=KEY,
      nums="prop_mean_price prop_std_price price_vs_prop_mean prop_price_zscore")
query("e12_avg_position", lambda t: E.encode_oof(t.labelled, ITEM, [E.ITEM_STATS[-1]]),
      oof_sql([(ITEM, ["prop_avg_position"])]), ints=KEY, nums="prop_avg_position")
query("e13_destination_gaps", lambda t: E.derive_destination_gaps(E.encode_oof(t.labelled, DEST, E.DESTINATION_STATS)),
      "SELECT * FROM enc", ints=KEY, nums="dest_mean_price dest_mean_star dest_mean_review price_vs_dest_mean "
      "star_vs_dest_mean review_vs_dest_mean")


def posadj_sql(target, src, name, oof):
    weighted = f"""SELECT s.*, greatest(0.2, least(3.0, mu / CASE WHEN rate > 0 THEN rate ELSE mu END)) AS w, mu
      FROM {src} s JOIN (SELECT position, avg({target}) AS rate FROM {src} GROUP BY position) p ON p.position = s.position,
      (SELECT avg({target}) AS mu FROM {src})"""
    value = f"(sum(w * {target}) + 40 * max(mu)) / (sum(w) + 40)"
    mu = f"(SELECT avg({target}) FROM {src})"
    if oof:
        return f"""WITH wt AS ({weighted}) SELECT r.srch_id, r.prop_id, coalesce(e.v, {mu}) AS {name} FROM fl r
          LEFT JOIN (SELECT f, prop_id, {value} AS v FROM folds JOIN wt ON wt.fold <> f GROUP BY f, prop_id) e
          ON e.f = r.fold AND e.prop_id = r.prop_id"""
    return f"""WITH wt AS ({weighted}) SELECT r.srch_id, r.prop_id, coalesce(e.v, {mu}) AS {name} FROM va r
      LEFT JOIN (SELECT prop_id, {value} AS v FROM wt GROUP BY prop_id) e ON e.prop_id = r.prop_id"""


for short, target in (("click", "click_bool"), ("rel", "relevance"), ("book", "booking_bool")):
    column = f"prop_{short}_rate_pos_adj_s40_oof"
    query(f"e14_position_adjusted_{short}",
          lambda t, target=target, column=column: E.position_adjusted(t.labelled, target, column),
          posadj_sql(target, "fl", column, True), ints=KEY, nums=column)
query("e14_position_adjusted_from_source",
      lambda t: E.position_adjusted(t.sides[0], "click_bool", "pos_adj", other=t.sides[1]),
      posadj_sql("click_bool", "tr", "pos_adj", False), ints=KEY, nums="pos_adj")
query("e15_self_included", lambda t: E.encode_from(t.labelled, t.labelled, ITEM, [CLICK]),
      from_sql([(ITEM, ["prop_click_rate"])], "lab", "lab"), ints=KEY, nums="prop_click_rate")


def _fallback_sql(oof):
    src, dst = ("fl", "fl") if oof else ("tr", "va")
    head = "f, " if oof else ""
    rows = f"(SELECT f, s.* FROM folds JOIN fl s ON s.fold <> f)" if oof else "tr"

    def part(tag, keys):
        on = " AND ".join([f"{tag}.{k} = r.{k}" for k in keys] + ([f"{tag}.f = r.fold"] if oof else []))
        ks = head + ", ".join(keys) if keys else head.rstrip(", ")
        group = f"GROUP BY {ks}" if ks else ""
        sel = f"{ks}, " if ks else ""
        return (f"LEFT JOIN (SELECT {sel}sum(booking_bool) AS s, count(*) AS n FROM {rows} x {group}) {tag} "
                f"ON {on or 'true'}")

    g = "(g.s / g.n::DOUBLE)"
    back = f"(0.5 * coalesce(a.s / a.n::DOUBLE, {g}) + 0.3 * coalesce(b.s / b.n::DOUBLE, {g}) + 0.2 * {g})"
    return f"""SELECT r.srch_id, r.prop_id, (coalesce(p.s, 0) + 40 * {back}) / (coalesce(p.n, 0) + 40) AS prop_dest_book_rate_safe
      FROM {dst} r {part('p', ['prop_id', 'srch_destination_id'])} {part('a', ['prop_id'])}
      {part('b', ['srch_destination_id'])} {part('g', [])}"""


SAFE = ("prop_id", "srch_destination_id", "booking_bool", "prop_dest_book_rate_safe")
query("e16_pair_with_fallback", lambda t: E.pair_with_fallback(t.labelled, *SAFE), _fallback_sql(True), ints=KEY,
      nums="prop_dest_book_rate_safe")
query("e16_pair_with_fallback_from_source", lambda t: E.pair_with_fallback(t.sides[0], *SAFE, other=t.sides[1]),
      _fallback_sql(False), ints=KEY, nums="prop_dest_book_rate_safe")

PROPENSITY = "SELECT position, avg(click_bool) AS propensity FROM imp WHERE random_bool = 1 GROUP BY position"
view("prop", PROPENSITY)
view("prop_line", """SELECT 1 / regr_slope(1 / propensity, position) AS a,
  regr_intercept(1 / propensity, position) / regr_slope(1 / propensity, position) AS b, count(*) AS n_positions
  FROM prop WHERE propensity > 0""")
query("e17_position_propensity", lambda t: P.propensity(t.impressions), "SELECT * FROM prop", ints="position",
      nums="propensity")
query("e18_fitted_propensity", lambda t: P.fit_propensity(t.impressions), "SELECT * FROM prop_line",
      ints="n_positions", nums="a b")
query("e18_fitted_propensity_curve", lambda t: P.fit_propensity_curve(t.impressions), None, ints="n_positions",
      nums="a b sse")
query("e19_fitted_weights", lambda t: P.fitted_weights(t.impressions), """
WITH w AS (SELECT position, a / (position + b) AS fitted, (position + b) / a AS ipw
           FROM (SELECT DISTINCT position FROM imp), prop_line)
SELECT *, ipw / (SELECT avg(ipw) FROM w) AS ipw_norm FROM w""", ints="position", nums="fitted ipw ipw_norm")

FEATURES = [n for _, ns in ALL for n in ns] + [
    "log_prop_count", "price_vs_prop_mean", "prop_price_zscore", "price_vs_dest_mean", "star_vs_dest_mean",
    "review_vs_dest_mean"]
query("e21_entity_encodings", lambda t: E.entity_encodings(t.labelled), "SELECT * FROM enc", ints=KEY,
      nums=" ".join(FEATURES))
MORE = ("price_rank_norm value_gap price_z_score promo_x_cheap query_affinity_exp distance_x_international "
        "comp_rate_pct_mean price_per_guest n_best_flags price_percentile log_distance value_score")
query("e20_build_features_train", lambda t: build_features(t.labelled),
      "SELECT i.*, " + ", ".join(f"e.{n}" for n in FEATURES) + " FROM intf i JOIN enc e USING (srch_id, prop_id)",
      ints=KEY, nums=" ".join(FEATURES) + " " + MORE)
query("e20_build_features_validation", lambda t: build_features(t.sides[1], t.sides[0]),
      "SELECT i.*, " + ", ".join(f"e.{n}" for n in FEATURES) + " FROM intf i JOIN encv e USING (srch_id, prop_id)",
      ints=KEY, nums=" ".join(FEATURES) + " " + MORE)

# interactions that need encodings
def _premium(t):
    """The columns of the premium, stored once: its limit and its rows read them."""
    return t.stored("premium", lambda: E.price_position(t.labelled).select("srch_id", "prop_id", "srch_booking_window", "price_vs_prop_mean"))


query("f12_price_premium_window", lambda t: R.price_premium_window(*[_premium(t)] * 2), """
SELECT srch_id, prop_id, greatest(0, least(price_vs_prop_mean, p99)) / ln(1 + srch_booking_window + 1)
    AS price_premium_vs_prop_hist_x_short_window,
  (price_vs_prop_mean > 0 AND srch_booking_window <= 30)::INT AS is_price_premium_x_short_window
FROM enc, (SELECT quantile_cont(greatest(price_vs_prop_mean, 0), 0.99) AS p99 FROM enc)""",
      ints=KEY + " is_price_premium_x_short_window", nums="price_premium_vs_prop_hist_x_short_window")


def _listwise(t):
    from .queries_features import listwise_frame
    return listwise_frame(t)


query("f13_long_window_top_price", lambda t: R.long_window_top_price(_listwise(t)), """
SELECT *, (srch_booking_window > 30)::INT * (price_rank_norm >= 0.75)::INT AS is_long_window_x_top_quartile_price FROM listh""",
      ints=KEY + " is_long_window_x_top_quartile_price")
query("f14_rarity_long_trip", lambda t: R.rarity_long_trip(E.encode_oof(
    t.labelled, ITEM, [E.Count("prop_count", "price_usd")])), """
SELECT *, ln(1 + srch_length_of_stay) / nullif(ln(1 + prop_count), 0) AS prop_rare_x_long_trip FROM enc""", ints=KEY,
      nums="prop_rare_x_long_trip")
DEST_CLICK = [E.Rate("dest_click_rate", "click_bool", 30)]
query("f16_query_difficulty", lambda t: R.query_difficulty(E.encode_oof(_listwise(t), DEST, DEST_CLICK)), """
SELECT e.srch_id, e.prop_id, ln(1 + query_hotel_count) * (1 - dest_click_rate) AS query_difficulty_index
FROM enc e JOIN listh l USING (srch_id, prop_id)""", ints=KEY, nums="query_difficulty_index")
query("f17_destination_products", lambda t: R.destination_products(E.derive_price_position(several(
    _listwise(t), [(DEST, DEST_CLICK), (ITEM, [*PRICES, E.Count("prop_count", "price_usd")])]))), """
SELECT e.srch_id, e.prop_id, price_vs_mean * dest_click_rate AS price_vs_mean_x_dest_click,
  price_vs_prop_mean * dest_click_rate AS price_vs_prop_mean_x_dest_click
FROM enc e JOIN listh l USING (srch_id, prop_id)""", ints=KEY,
      nums="price_vs_mean_x_dest_click price_vs_prop_mean_x_dest_click")
Z = "prop_price_zscore_clipped_x_dest_click"
query("f18_clipped_zscore_product", lambda t: R.clipped_zscore_product(E.derive_price_position(several(
    t.labelled, [(DEST, DEST_CLICK), (ITEM, [*PRICES, E.Count("prop_count", "price_usd")])]))), f"""
SELECT srch_id, prop_id, CASE WHEN prop_price_zscore IS NOT NULL THEN greatest(-5, least(5, prop_price_zscore)) END
  * dest_click_rate AS {Z} FROM enc""", ints=KEY, nums=Z)
query("f18_clipped_counts", lambda t: R.clipped_counts(E.derive_price_position(E.encode_oof(
    t.labelled, ITEM, [*PRICES, E.Count("prop_count", "price_usd")]))), """
SELECT sum((prop_price_zscore < -5)::INT) AS clipped_lo, sum((prop_price_zscore > 5)::INT) AS clipped_hi FROM enc""",
      ints="clipped_lo clipped_hi")


def _rank_columns(t):
    df = several(t.labelled, [*E.SINGLE_RATES, *E.pair_rates()])
    return pct_rank_in_group(df.select("srch_id", "prop_id", *[
        F.round(c, 9).alias(c) for c in ENCODINGS]), ENCODINGS)


def _pct(c):
    v = f"round({c}, 9)"
    return (f"(rank() OVER (PARTITION BY srch_id ORDER BY {v}) + (count(*) OVER (PARTITION BY srch_id, {v}) - 1) / 2.0) "
            f"/ count({c}) OVER (PARTITION BY srch_id) AS {c}_rank_norm")


query("l16_encoding_pct_ranks", _rank_columns,
      "SELECT srch_id, prop_id, " + ", ".join(_pct(c) for c in ENCODINGS) + " FROM enc",
      ints=KEY, nums=" ".join(f"{c}_rank_norm" for c in ENCODINGS))
