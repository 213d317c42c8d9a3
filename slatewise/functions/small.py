"""Tables whose true size the planner should know."""

from ..session import materialise


def small_table(df):
    """The table, evaluated once and stored: joins broadcast it or shuffle it by its size in bytes."""
    return materialise(df, "small")
