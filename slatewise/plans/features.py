"""The full feature table: encodings, row features, listwise features, interactions."""

from ..operators import encodings, listwise, row_features


def build_features(df, source=None, k=5, salt="", blind=False):
    """All model features of a labelled table.

    Without a source the encodings are out of fold (training side); with one
    they come from it (validation or test side). Encodings join first, while
    rows are still narrow; after them one shuffle by search serves all windows,
    and the wide columns are projections on top that are never shuffled. With `blind` both
    sides leave the fold of their own search out, so that the two can be compared.
    """
    return features_of(encodings.entity_encodings(df, source, k, salt, blind))


def row_and_listwise(df):
    """The row features and listwise features of a table.

    Windows sort whole rows, once per order: only the steps whose columns are ranked come
    before them, the others are projections on top.
    """
    early = [s for s in row_features.ROW_STEPS if s in row_features.RANKED_STEPS]
    late = [s for s in row_features.ROW_STEPS if s not in early]
    out = row_features.apply(listwise.add_listwise(row_features.apply(df, early)), late)
    first = row_features.apply(df, row_features.ROW_STEPS).columns
    return out.select(*first, *[c for c in out.columns if c not in first])


def features_of(df):
    """The row features, listwise features and interactions of a table that has its encodings."""
    return row_features.apply(row_and_listwise(df), row_features.INTERACTION_STEPS)
