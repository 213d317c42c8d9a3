"""Quality rules as a ledger of failure bits.

`ledger` measures every document once and stores one bit per failed rule beside
the measurements. A policy is a set of rules with a version name; applying one,
comparing versions or leaving a rule out needs only the bits: `apply_policy`
masks them, and `ablations` counts documents per distinct mask and folds those
few rows with bitwise operations.

Words are runs of characters other than the six white-space characters. Defined
cases: a NULL or empty text has no words, measures 0 everywhere and fails the
word count; repeated rows are measured each; an empty table gives an empty
ledger; columns besides `doc_id` and `text` are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
            "n_digits", "n_marks", "n_distinct")


def _c(name):
    return F.col(name)


#: Rule names in bit order, and when a rule fails. Whole numbers only, so that no rounding decides.
RULES = {
    "few_words": lambda: _c("n_words") < 10,
    "repeated_words": lambda: 100 * _c("n_repeat_words") > 20 * _c("n_words"),
    "symbols": lambda: 10 * _c("n_symbols") > _c("n_words"),
    "duplicate_lines": lambda: 2 * _c("n_dup_lines") > _c("n_lines"),
    "capitals": lambda: (2 * _c("n_upper") > _c("n_letters")) & (_c("n_letters") > 0),
    "marks": lambda: 5 * _c("n_marks") > _c("n_words"),
    "word_length": lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 20 * _c("n_words")),
    "digits": lambda: 2 * _c("n_digits") > _c("word_chars"),
    "few_distinct_words": lambda: (_c("n_words") >= 20) & (
        (20 * _c("n_distinct") < _c("n_words")) | ((_c("n_words") <= 200) & (4 * _c("n_distinct") < _c("n_words")))),
}
BASE = ("few_words", "repeated_words")
#: Versions of the policy: which rules reject a document.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines", "word_length"),
    "v2": tuple(RULES),
}
CURRENT = "v2"

_BLANK = [ord(c) for c in BLANKS]
_SIGNS = [ord(c) for c in SYMBOLS]


def bits(rules) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r in rules)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found at least twice."""
    spots = list(zip(*[words[i:] for i in range(window)]))
    if len(set(spots)) == len(spots):
        return 0
    counts = Counter(spots)
    again = np.fromiter((counts[s] > 1 for s in spots), bool, len(spots))
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one text."""
    raw = (text or "").encode()
    if not raw:
        return (0,) * len(MEASURES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    points = len(raw) - int(seen[0x80:0xC0].sum())
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    return (len(words), points - int(seen[_BLANK].sum()), int(seen[_SIGNS].sum()), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), upper + lower, upper, int(seen[48:58].sum()), int(seen[33]), len(set(words)))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed`, the bits of the rules that a document fails."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", *MEASURES)])

    def run(batches):
        for b in batches:
            found = np.array([measure(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(found[:, i]) for i in range(len(MEASURES))]],
                                             schema=schema)

    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        run, ", ".join(f"{n} long" for n in ("doc_id", *MEASURES)))
    flags = [F.when(rule(), F.lit(1 << i)).otherwise(0) for i, rule in enumerate(RULES.values())]
    failed = flags[0]
    for f in flags[1:]:
        failed = failed.bitwiseOR(f)
    return measured.withColumn("failed", failed.cast("long"))


def fails(rules):
    """Whether a ledger row fails any of the rules."""
    return F.col("failed").bitwiseAND(F.lit(bits(rules))) != 0


def apply_policy(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    return entries.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails((*BASE, *POLICIES[version])))


def verdicts(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger under every version of the policy, with what leaving a rule out would change.

    `kept` is the verdict of `version`, `kept_<name>` that of each version. `sole_rule` is the
    rule that alone rejects a document (NULL if none or several do), and
    `sole_rule_documents` the number of documents that the ablation of this rule would keep.
    """
    out = apply_policy(entries, version)
    for name in POLICIES:
        out = out.withColumn(f"kept_{name}", ~fails((*BASE, *POLICIES[name])))
    rules = (*BASE, *(r for r in POLICIES[version] if r not in BASE))
    mask = F.col("failed").bitwiseAND(F.lit(bits(rules)))
    sole = F.coalesce(*[F.when(mask == bits([r]), F.lit(r)) for r in rules])
    won = ablations(entries, version).select(F.col("rule").alias("sole_rule"), F.col("failing_alone").alias("sole_rule_documents"))
    # one row for each rule of the module
    return out.withColumn("sole_rule", sole).join(F.broadcast(won), "sole_rule", "left")


def ablations(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: how many documents fail it, fail it alone, and are kept without it."""
    rules = tuple(dict.fromkeys((*BASE, *POLICIES[version])))
    masks = (entries.groupBy(F.col("failed").bitwiseAND(F.lit(bits(rules))).alias("mask"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words")))
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bits([r])).alias("bit")) for r in rules])).alias("r")
    rest = F.col("mask").bitwiseAND(F.bitwise_not(F.col("r.bit").cast("long"))) == 0
    fail = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    return (masks.select("mask", "n", "words", one)
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(fail, F.col("n")).otherwise(0)).alias("failing"),
                 F.sum(F.when(fail & rest, F.col("n")).otherwise(0)).alias("failing_alone"),
                 F.sum(F.when(fail & rest, F.col("words")).otherwise(0)).alias("words_won_without"),
                 F.sum(F.when(rest, F.col("n")).otherwise(0)).alias("kept_without")))
