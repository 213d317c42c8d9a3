"""Which columns reach a model: projections decided on the schema and on an audit of gains."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..schema import FORBIDDEN, NON_FEATURES, impression_schema


@dataclass(frozen=True)
class Audit:
    """Features in falling order of gain, with the group of each."""

    places: dict
    groups: dict

    @classmethod
    def from_table(cls, table):
        """From a stored audit (feature, group, gain): one row for each column, best first."""
        return cls.of((r.feature, r.group) for r in table.orderBy(F.desc("gain"), "feature").collect())

    @classmethod
    def of(cls, rows):
        """From (feature, group) pairs, best first."""
        rows = list(rows)
        return cls({f: i for i, (f, _) in enumerate(rows)}, dict(rows))


@dataclass(frozen=True)
class Top:
    """The n features of most gain."""

    n: int

    def keeps(self, column, audit):
        return audit.places.get(column, self.n) < self.n


@dataclass(frozen=True)
class DropLowest:
    """All but the lowest share of the audited features; features without a gain stay."""

    share: float

    def keeps(self, column, audit):
        size = len(audit.places)
        return audit.places.get(column, -1) < size - int(size * self.share)


@dataclass(frozen=True)
class Drop:
    """All but some columns, given by name or by the start of the name."""

    columns: tuple = ()
    prefix: str | None = None

    def keeps(self, column, audit):
        return column not in self.columns and not (self.prefix and column.startswith(self.prefix))


@dataclass(frozen=True)
class KeepGroups:
    """The features whose audited group is one of some."""

    groups: tuple

    def keeps(self, column, audit):
        return audit.groups.get(column) in self.groups


@dataclass(frozen=True)
class Both:
    """What two filters keep."""

    first: object
    second: object

    def keeps(self, column, audit):
        return self.first.keeps(column, audit) and self.second.keeps(column, audit)


# The names of the filters and the columns each one is about.
POSITION = ("prop_avg_position",)
CROSSED = ("prop_dest_book_rate", "prop_site_book_rate", "site_dest_book_rate", "site_country_book_rate", "cpair_book_rate")
FILTERS = {
    "top_20": Top(20), "top_40": Top(40), "top_60": Top(60), "top_80": Top(80), "top_120": Top(120),
    "drop_bottom_10pct": DropLowest(0.1), "drop_bottom_30pct": DropLowest(0.3),
    "focus_on_signal": Both(DropLowest(0.3), Drop(POSITION)),
    "keep_raw_listwise_price": KeepGroups(("raw", "listwise_within_query", "price", "quality")),
    "drop_competitor": Drop(prefix="comp"),
    "drop_prop_avg_position": Drop(POSITION),
    "drop_position_derived": Drop(POSITION),
    "drop_missing_flags": Drop(("has_visitor_history", "has_historical_price", "has_distance", "has_query_affinity")),
    "drop_is_best_flags": Drop(("is_best_star", "is_best_review", "is_best_location1", "is_cheapest", "is_most_expensive")),
    "drop_booking_buckets": Drop(("is_last_minute", "is_short_window", "is_long_window")),
    "drop_cross_tes": Drop(CROSSED),
    "drop_visitor_history": Drop(("star_diff", "abs_star_diff", "price_diff_from_visitor_hist", "price_ratio_to_visitor_hist",
                                  "visitor_hist_starrating", "visitor_hist_adr_usd", "has_visitor_history")),
    "triple_debias": Drop((*POSITION, *CROSSED)),
}


#: Parts of names that tell the groups of built features apart, first match first.
_GROUP_PARTS = (("encoding", ("_rate", "prop_count", "prop_click_count", "given_click", "prop_avg_position", "dest_count", "prop_mean", "prop_std", "dest_mean")),
                ("listwise_within_query", ("_rank", "_percentile", "z_score", "is_best", "is_cheapest", "is_most", "n_best", "query_hotel", "_gap", "_vs_mean")),
                ("price", ("price", "discount", "deal", "cheap")), ("quality", ("star", "review", "location", "brand")), ("competitor", ("comp",)))


def feature_group(column):
    """The group a feature is audited in: raw columns, encodings, listwise columns, price, quality, competitors, or the rest."""
    if column in impression_schema().fieldNames():
        return "raw"
    return next((group for group, parts in _GROUP_PARTS if any(p in column for p in parts)), "interaction")


def numeric_features(df):
    """The columns a model may use that hold numbers."""
    return [c for c in feature_columns(df) if df.schema[c].dataType.typeName() in ("integer", "long", "double", "float", "short", "byte")]


def feature_columns(df, required=()):
    """Columns a model may use. Raises if a forbidden one would be among them."""
    cols = [c for c in df.columns if c not in NON_FEATURES]
    leaked = set(cols) & set(FORBIDDEN)
    if leaked:
        raise ValueError(f"forbidden features: {sorted(leaked)}")
    missing = set(required) - set(cols)
    if missing:
        raise ValueError(f"missing features: {sorted(missing)}")
    return cols


def filter_features(columns, chosen=None, audit=()):
    """Columns left by a filter, given itself or by its name; `audit` is an Audit or lists (feature, group), best first."""
    rule = FILTERS[chosen] if isinstance(chosen, str) else chosen
    known = audit if isinstance(audit, Audit) else Audit.of(audit)
    return [c for c in columns if rule is None or rule.keeps(c, known)]
