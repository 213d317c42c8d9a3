"""Small column expressions. All are built-ins, so they stay inside codegen."""

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c):
    return c if isinstance(c, Column) else F.col(c)


def num(c):
    return col(c).cast("double")


def ratio(a, b):
    """a / b in doubles, NULL where b is 0 or either is NULL."""
    return F.try_divide(num(a), num(b))


def flag(cond):
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(cond, 1).otherwise(0)


def zero_as(c, value):
    return F.when(col(c) == 0, F.lit(value)).otherwise(col(c))


def null_if(c, value):
    return F.when(col(c) == value, None).otherwise(col(c))


def clip(c, lo=None, hi=None):
    """Limit to [lo, hi]; NULL stays NULL (greatest/least alone would skip it)."""
    out = col(c)
    if lo is not None:
        out = F.greatest(out, col(lo) if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, col(hi) if isinstance(hi, Column) else F.lit(hi))
    return F.when(col(c).isNotNull(), out)


def total(cols):
    return reduce(add, cols)


def finite(c):
    """NULL for NaN and the infinities."""
    c = num(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def bucket_of(c, k, salt=""):
    """Stable bucket 0..k-1 of a key from its md5; equal keys always share a bucket."""
    text = F.concat(col(c).cast("string"), F.lit(salt)) if salt else col(c).cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % k


def label(click="click_bool", book="booking_bool"):
    """Graded relevance: 5 booked, 1 clicked only, 0 otherwise."""
    return (F.lit(5) * col(book) + col(click) * (F.lit(1) - col(book))).cast("int")


# Where `fixed` switches to the next step. Not one half: means of prices in cents
# often lie exactly half-way, and then the last bit of a sum would decide.
STEP = 0.4871


# From here on values are kept to 2 digits: a double has no more to compare.
LARGE = 1e6


def fixed(c, digits=6):
    """Round to a grid by floor, the form that agrees between engines."""
    x = num(c)

    def at(d):
        return F.floor(x * float(10 ** d) + STEP).cast("double") / float(10 ** d)

    return F.when(F.abs(x) >= LARGE, at(2)).otherwise(at(digits))


def band(c, bounds, names):
    """Name of the first band whose inclusive upper bound is not below the value."""
    out = F.when(col(c).isNull(), None)
    for hi, name in zip(bounds, names):
        out = out.when(col(c) <= hi, name)
    return out.otherwise(names[len(bounds)]) if len(names) > len(bounds) else out
