"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded texts.

Folding maps look-alike letters (other scripts, full width, accents), digits and
signs that stand for letters to plain letters, one code point for one. The
lexicon is learned from labelled documents: a word's weight is its log ratio of
toxic to clean documents, kept if it turns up in several different contexts. Given
exception phrases cancel the matches inside them. The sum of weights, plain and normalised by the
length of the text, goes through a fitted logistic curve.

Learning reads at most `SAMPLE` labelled documents of each class, chosen by hash;
the lexicon holds at most `LEXICON` words. Scoring reads every whole text.

Defined cases: a NULL or empty text matches nothing and gets the score of a
document without matches; labels given twice count as toxic if one is; NULL
labels and NULL ids are not learned from and a NULL id is not held out; with one
class only, every score is the smoothed share of toxic labels; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 10_000
LEXICON = 5_000
#: A lexicon word is this many times likelier in toxic documents (as a log) and has this many contexts there.
LEAST_WEIGHT, LEAST_CONTEXTS = 2.0, 3
FOLDS = 5

#: Letters of other scripts that look like Latin ones, and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g", "ɩ": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e",
}
#: Harmless phrases around words that are insults elsewhere.
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bag", "trash bin", "pond scum", "stupid simple", "sore loser rule")

_WORD = re.compile(r"\w+")


_tables: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """For every code point the code point it is read as."""
    if _tables:
        return _tables[0]
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(128, 0x20000):
        plain = unicodedata.normalize("NFKD", chr(i))
        if plain and (len(plain) == 1 or all(unicodedata.combining(c) for c in plain[1:])):
            out[i] = ord(plain[0])
    lower = {i: ord(low) for i in range(0x20000) if len(low := chr(i).lower()) == 1}
    out = np.array([lower.get(i, i) for i in range(0x20000)], np.uint32)[np.minimum(out, 0x1FFFF)] * (out < 0x20000) + out * (out >= 0x20000)
    for a, b in LOOKALIKES.items():
        out[out == ord(a)] = ord(b)
    _tables.append(out.astype("<u4"))
    return _tables[0]


def fold(text: str) -> str:
    """The text in plain lower-case letters, position for position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _fold_table()[points].tobytes().decode("utf-32-le", "surrogatepass")


def folded_terms(text: str) -> list[tuple[str, str]]:
    """Each different folded word with one context: the words before and after its first place."""
    words = _WORD.findall(fold(text))
    seen, padded = {}, ["", *words, ""]
    for before, word, after in zip(padded, words, padded[2:]):
        if word not in seen and len(word) >= 3:
            seen[word] = f"{before} {after}"
    return list(seen.items())


class Matcher:
    """Sums of lexicon weights over whole words outside of exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions=()):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for word, weight in weights.items():
            self.machine.add_word(word, (len(word), weight))
        for phrase in exceptions:
            self.machine.add_word(fold(phrase), (len(phrase), None))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each match that counts."""
        if self.empty or not text:
            return []
        folded, hits, spared = fold(text), [], []
        n = len(folded)
        for last, (length, weight) in self.machine.iter(folded):
            start, end = last - length + 1, last + 1
            if (start and folded[start - 1].isalnum()) or (end < n and folded[end].isalnum()):
                continue
            (spared if weight is None else hits).append((start, end, weight))
        return [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)] if spared else hits

    def features(self, text: str | None) -> tuple[float, float]:
        """The sum of weights, and that sum per hundred words, both on a log scale."""
        total = sum(w for _, _, w in self.spans(text or ""))
        return math.log1p(total), math.log1p(100 * total / (len(text.split()) + 20)) if total else 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most `most` labelled documents of each class outside the held-out fold: text, toxic."""
    known = (labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(~held_out(F.col("doc_id"))))
    order = [F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*order).limit(most).union(known.where("toxic = 0").orderBy(*order).limit(most))
    return (docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
            .select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, exceptions=EXCEPTIONS) -> dict:
    """The lexicon, the exception phrases and the curve: a model of bounded size."""
    sample = stored(labelled_sample(docs, labels), "toxic-sample")
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    model = {"weights": {}, "exceptions": list(exceptions), "curve": [math.log((bad + 0.5) / (good + 0.5)), 0.0, 0.0]}
    if not bad or not good:
        return model
    schema = pa.schema([("term", pa.string()), ("context", pa.string()), ("toxic", pa.int32())])

    def terms(batches):
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = folded_terms(text)
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()),
                                                  pa.array([c for _, c in found], pa.string()),
                                                  pa.array([toxic] * len(found), pa.int32())], schema=schema)

    uses = (sample.mapInArrow(terms, "term string, context string, toxic int")
            .groupBy("term", F.xxhash64("context").alias("context"))
            .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")))
    rated = (uses.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"),
                                      F.sum((F.col("bad") > 0).cast("int")).alias("contexts"))
             .withColumn("weight", F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1)))
             .where((F.col("weight") >= LEAST_WEIGHT) & (F.col("contexts") >= LEAST_CONTEXTS))
             .orderBy(F.desc(F.col("weight") * F.col("contexts")), "term").limit(LEXICON))
    model["weights"] = {r.term: r.weight for r in rated.collect()}
    model["curve"] = _curve(sample, model)
    return model


def _curve(sample: DataFrame, model: dict) -> list[float]:
    """Logistic regression of the label on the two sums over the sample, by Newton steps with a small ridge."""
    def measured(batches):
        match = Matcher(model["weights"], model["exceptions"])
        for b in batches:
            found = np.array([match.features(t) for t in b.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), b.column(1)],
                                             names=["plain", "share", "toxic"])

    rows = sample.mapInArrow(measured, "plain double, share double, toxic int").groupBy(
        F.round("plain", 2).alias("plain"), F.round("share", 2).alias("share"), "toxic").count().toPandas()
    x = np.column_stack([np.ones(len(rows)), rows["plain"], rows["share"]])
    y, n = rows["toxic"].to_numpy(float), rows["count"].to_numpy(float)
    order = np.lexsort((y, x[:, 2], x[:, 1]))
    x, y, n, beta, ridge = x[order], y[order], n[order], np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return [float(b) for b in beta]


class Scorer:
    def __init__(self, model: dict):
        self.match, self.curve = Matcher(model["weights"], model["exceptions"]), model["curve"]

    def __call__(self, text: str | None) -> float:
        a, b = self.match.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + self.curve[1] * a + self.curve[2] * b))))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        rate = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rate(t.as_py()) for t in b.column(1)], pa.float64())],
                                             schema=schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
            .mapInArrow(run, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def reject(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns."""
    place = docs.columns.index("text")

    def run(batches):
        rate = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([rate(t.as_py()) < 0.5 for t in b.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
