"""Registered queries: a Spark plan and, where SQL can say it, the same in ANSI SQL."""

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import functions as F

from ..functions.exprs import LARGE, STEP, fixed, label
from ..sources import testbed
from .candidate_sql import CANDIDATES


class Tables:
    """Tables derived from one scale folder, each built on first use."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir, self._memo = spark, sf_dir, {}

    @property
    def impressions(self):
        return testbed.impressions(self.spark, self.sf_dir)

    @property
    def labelled(self):
        return self.impressions.withColumn("relevance", label())

    @property
    def predictions(self):
        return testbed.predictions(self.impressions)

    @cached_property
    def sides(self):
        """(train, validation, cutoff) of the temporal split."""
        from ..operators.splits import split_temporal
        return split_temporal(self.labelled)

    def stored(self, name, build, by_search=False):
        """A derived table written once per session to the shared folder, with `by_search` in the buckets of the impressions."""
        return testbed.stored_table(self.spark, self.sf_dir, name, build, by_search)

    def memo(self, name, build):
        """A small driver-side result (a fitted model) kept for the session."""
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]


_tables = {}


def tables(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = Tables(spark, sf_dir)
    return _tables[key]


@dataclass(frozen=True)
class Query:
    """Output columns are given by kind: whole numbers, decimals (6 digits), texts."""

    name: str
    run: object
    sql: str | None = None
    ints: str = ""
    nums: str = ""
    texts: str = ""

    def frame(self, spark, sf_dir):
        df = self.run(tables(spark, sf_dir))
        return df.select(*[F.col(c).cast("bigint").alias(c) for c in self.ints.split()],
                         *[fixed(c).alias(c) for c in self.nums.split()],
                         *[F.col(c).cast("string").alias(c) for c in self.texts.split()])

    def oracle(self):
        cols = [f"CAST({c} AS BIGINT) AS {c}" for c in self.ints.split()]
        cols += [f"CASE WHEN abs(CAST({c} AS DOUBLE)) >= {LARGE} THEN floor(CAST({c} AS DOUBLE) * 1e2 + {STEP}) / 1e2 "
                 f"ELSE floor(CAST({c} AS DOUBLE) * 1e6 + {STEP}) / 1e6 END AS {c}" for c in self.nums.split()]
        cols += [f"CAST({c} AS VARCHAR) AS {c}" for c in self.texts.split()]
        body = self.sql.strip()
        return f"WITH {used(body)}result AS (\n{body}\n)\nSELECT {', '.join(cols)} FROM result"


VIEWS = {}


def view(name, sql):
    """Name a piece of SQL that oracles may select from."""
    VIEWS[name] = sql.strip()


def used(body):
    """The WITH items a text needs, each after the ones it needs itself."""
    order, seen = [], set()

    def visit(text):
        for name, sql in VIEWS.items():
            if name not in seen and re.search(rf"(\bFROM|\bJOIN|,)\s+{name}\b", text):
                seen.add(name)
                visit(sql)
                order.append(name)

    visit(body)
    return "".join(f"{n} AS MATERIALIZED (\n{VIEWS[n]}\n),\n" for n in order)


def bucket_sql(key, k, salt=""):
    text = f"CAST({key} AS VARCHAR)" + (f"||'{salt}'" if salt else "")
    return f"(('0x'||substr(md5({text}),1,8))::BIGINT % {k})"


view("imp", CANDIDATES)
view("lab", "SELECT *, 5 * booking_bool + click_bool * (1 - booking_bool) AS relevance FROM imp")

QUERIES = []


def query(name, run, sql=None, ints="", nums="", texts=""):
    QUERIES.append(Query(name, run, sql, ints, nums, texts))
