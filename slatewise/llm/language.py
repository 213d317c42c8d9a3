"""Language identification, words first.

A word that the training sample holds is scored by its log frequency in every
language. A word that it does not hold falls back to its character n-grams, word ends
included: to the known ones of four letters, else of three, of two, of one; their mean
log frequency stands for the word. The scores of all words of the text and the log
share of each language add up, the language of the largest sum is the answer, and the
softmax of the sums gives its score.

Learning reads at most `SAMPLE` whole documents of each of the `LANGS` languages with
the most learnable rows (and only rows outside the held-out third that have a language);
it keeps the most frequent `WORDS` words and `GRAMS` n-grams of each length, shared
evenly among the languages. These bounds make the model a bounded size. Prediction
reads every whole text.

Defined cases: a NULL text, or one without a letter, is `und` with score 0; so is every
text if nothing could be learned; a NULL doc_id is not held out and not learned from;
repeated rows count again; equal sums go to the language with more learnable rows, then to the
first by name; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE, LANGS, WORDS, GRAMS = 1500, 200, 400_000, 80_000
LONGEST, FOLDS, HELD_OUT, NONE = 4, 3, 1, "und"
SMOOTHING, CACHE = 0.3, 200_000

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def words_of(text: str | None) -> list[str]:
    """Lower-case words of the text; none where it has no letter."""
    found = _WORD.findall((text or "").lower())
    return found if any(any(map(str.isalpha, w)) for w in found) else []


def grams(word: str, size: int) -> list[str]:
    """The n-grams of one length of a word between blanks; of one letter without the blanks."""
    framed = f" {word} " if size > 1 else word
    return [framed[i : i + size] for i in range(len(framed) - size + 1)]


def labelled_sample(docs: DataFrame) -> tuple[DataFrame, list]:
    """(lang, text) of at most SAMPLE learnable rows of each language, by hash, and (lang, rows) of the languages."""
    each = docs.select(F.col("lang").cast("string").alias("lang"), "text", F.col("doc_id").alias("id")).where(
        "lang is not null and text is not null and id is not null").where(~held_out(F.col("id")))
    sizes = each.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGS).collect()
    if not sizes:
        return each.select("lang", "text").limit(0), []
    # a first cut by hash leaves a little more than the wanted rows, the window then cuts to exactly SAMPLE
    spread = 1 << 20
    cut = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(min(spread, 2 * SAMPLE * spread // r.rows + 1)))])[F.col("lang")]
    drawn = each.withColumn("draw", F.xxhash64("id", F.lit(13))).where(F.pmod("draw", F.lit(spread)) < cut)
    order = Window.partitionBy("lang").orderBy("draw", "id", F.xxhash64("text"), "text")
    return drawn.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE).select("lang", "text"), [tuple(r) for r in sizes]


def learn(docs: DataFrame) -> dict:
    """The model: languages with their shares, and for words and n-grams a row of log frequencies each."""
    sample, sizes = labelled_sample(docs)
    langs = [lang for lang, _ in sizes]
    model = {"langs": langs, "prior": np.log(np.array([n for _, n in sizes], float) / max(1, sum(n for _, n in sizes))), "tables": []}
    if not langs:
        return model
    schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("term", pa.string()), ("n", pa.int64())])

    def count(batches):
        held = Counter()

        def flush():
            rows = list(held.items())
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()),
                                               pa.array([k[2] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], schema=schema)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for word, n in Counter(words_of(text.as_py())).items():
                    held[lang, 0, word] += n
                    for size in range(1, LONGEST + 1):
                        for gram in grams(word, size):
                            held[lang, size, gram] += n
                if len(held) > 500_000:
                    yield flush()
                    held.clear()
        yield flush()

    terms = stored(sample.mapInArrow(count, "lang string, size int, term string, n long").groupBy("lang", "size", "term").agg(F.sum("n").alias("n")), "language-terms")
    totals = {(r.lang, r.size): (r.n, r.kinds) for r in terms.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()}
    most = F.when(F.col("size") == 0, F.lit(WORDS // len(langs))).otherwise(F.lit(GRAMS // len(langs)))
    order = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "term")
    kept = terms.withColumn("at", F.row_number().over(order)).where(F.col("at") <= WORDS // len(langs)).where(F.col("at") <= most)
    tables = [{} for _ in range(LONGEST + 1)]
    place = {lang: i for i, lang in enumerate(langs)}
    for r in kept.select("lang", "size", "term", "n").toLocalIterator():  # at most WORDS + LONGEST * GRAMS rows
        tables[r.size].setdefault(r.term, np.zeros(len(langs)))[place[r.lang]] = r.n
    for size, table in enumerate(tables):
        n, kinds = np.array([totals.get((lang, size), (0, 0)) for lang in langs], float).T
        names = sorted(table)
        counts = np.array([table[t] for t in names]).reshape(-1, len(langs))
        model["tables"].append((names, np.log((counts + SMOOTHING) / (n + SMOOTHING * (kinds.sum() + 1)))))
    return model


class Identifier:
    def __init__(self, model: dict):
        self.langs, self.prior, self.cache = model["langs"], model["prior"], {}
        self.rows = [({t: i for i, t in enumerate(names)}, logs) for names, logs in model["tables"]]

    def unseen(self, word: str) -> np.ndarray:
        """The scores of a word by its longest known n-grams."""
        found = self.cache.get(word)
        if found is None:
            found = np.zeros(len(self.langs))
            for size in range(LONGEST, 0, -1):
                places, logs = self.rows[size]
                known = [places[g] for g in grams(word, size) if g in places]
                if known:
                    found = logs[known].mean(axis=0)
                    break
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = found
        return found

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.langs:
            return NONE, 0.0
        places, logs = self.rows[0]
        total, rows, times = self.prior.copy(), [], []
        for word, n in Counter(words).items():
            row = places.get(word)
            if row is None:
                total += n * self.unseen(word)
            else:
                rows.append(row)
                times.append(n)
        if rows:
            total += np.array(times, float) @ logs[rows]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        told = Identifier(shared.value)
        for b in batches:
            found = [told(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                                             schema=schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))
