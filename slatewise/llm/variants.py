"""Spelling variants: groups words with the far more frequent words one edit away.

Words are the runs of Latin letters in the texts, after the planted deletions of the
contract. Two words are near if one inserted, deleted or replaced code point parts
them. Pairs are found with a bit-sliced position index: for every (position, letter)
one bitset over the words of a block, and a recurrence that reads a query letter by
letter and keeps, for all words of the block at once, the set without an error, the
set with one replaced letter and the set with one more letter (the same position,
and the position shifted by one). A word with a letter less is the same pair seen
from the other side.

Blocks keep the index small. Let m be the length of the shorter word of a pair and p
the length of the common prefix. For an interval [a, b) of places, all pairs with p in
it share their first a and last m - b letters, so these name a block. Each word goes
to the two halves of both classes m it can belong to; a block of more than `BLOCK`
words is halved again, down to one place, where a block cannot hold more words than
two free letters allow. Every pair lies in exactly one block at any depth, so counts
need no removal of repeated pairs.

Defined cases: a NULL or empty text has no runs; a NULL doc_id is written as nothing
before the colon; repeated rows count again; equal counts choose the word first in
code-point order; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LEAST_LENGTH, LEAST_COUNT, TIMES, DELETE = 7, 2, 10, 31
#: Words of a block before it is halved, rows that share one index, queries read at once, words a task counts before it sends them.
BLOCK, CHUNK, SLICE, HELD = 4096, 2048, 256, 200_000

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def observed(doc_id: int | None, text: str | None) -> Counter:
    """Counts of the words of one text that are long enough after the deletions."""
    found, out = Counter(_RUN.findall((text or "").encode().lower().decode())), Counter()
    start = zlib.crc32(b"%b:" % (b"" if doc_id is None else b"%d" % doc_id))
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if not h % DELETE:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts that occur at least twice."""
    def run(batches):
        held = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                held.update(observed(doc_id, text.as_py()))
                if len(held) > HELD:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
            .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the blocks of both halves of its interval: (block, m, a, b, word, n)."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")

    def half(a, b):
        after = F.greatest(F.col("m") - b, F.lit(0))
        name = F.xxhash64("m", a, b, F.substring("word", F.lit(1), a), F.right("word", after))
        return F.struct(name.alias("block"), a.alias("a"), b.alias("b"))

    split = rows.withColumn("half", F.explode(F.array(half(F.col("a"), mid), half(mid, F.col("b")))))
    return split.select("half.block", "m", "half.a", "half.b", "word", "n")


def blocks(words: DataFrame) -> DataFrame:
    """The first blocks of every word: as the shorter or equal word of a pair, and as the longer one."""
    size = F.length("word")
    roles = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= LEAST_LENGTH)
    return _halves(roles.select("m", F.lit(0).alias("a"), (F.col("m") + 1).alias("b"), "word", "n"))


class PositionIndex:
    """Bitsets over words for every (position, letter) and every length."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        n, width = codes.shape
        self.n, self.lanes = n, (n + 63) // 64
        self.letters, coded = np.unique(codes, return_inverse=True)
        self.coded, self.lengths = coded.reshape(codes.shape).astype(np.int64), lengths
        lane, bit = np.arange(n) // 64, np.left_shift(np.uint64(1), (np.arange(n) % 64).astype(np.uint64))
        word, place = np.nonzero(np.arange(width)[None, :] < lengths[:, None])
        self.keys, row = np.unique(place * len(self.letters) + self.coded[word, place], return_inverse=True)
        self.sets = np.zeros((len(self.keys) + 1, self.lanes), np.uint64)  # the last one is empty
        np.bitwise_or.at(self.sets, (row, lane[word]), bit[word])
        self.of_length = {}
        for size in np.unique(lengths):
            chosen = np.flatnonzero(lengths == size)
            self.of_length[int(size)] = np.zeros(self.lanes, np.uint64)
            np.bitwise_or.at(self.of_length[int(size)], lane[chosen], bit[chosen])

    def at(self, place: int, letter: np.ndarray) -> np.ndarray:
        """One bitset per letter: the words that have it at this place."""
        key = place * len(self.letters) + letter
        row = np.searchsorted(self.keys, key)
        return self.sets[np.where(np.append(self.keys, -1)[row] == key, row, len(self.keys))]

    def near(self, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs one edit apart, queries being words of the index of one size: words as long, or one longer."""
        shape = (len(queries), self.lanes)
        exact, replaced, longer = np.full(shape, ~np.uint64(0)), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        here = self.at(0, self.coded[queries, 0])
        for i in range(size):
            shifted = self.at(i + 1, self.coded[queries, i])
            replaced = (replaced & here) | (exact & ~here)
            longer = (longer | exact) & shifted
            exact = exact & here
            if i + 1 < size:
                here = self.at(i + 1, self.coded[queries, i + 1])
        none = np.zeros(self.lanes, np.uint64)
        found = (replaced & self.of_length[size]) | ((longer | exact) & self.of_length.get(size + 1, none))
        flat = found.ravel()
        full = np.flatnonzero(flat)
        hit, bit = np.nonzero(np.unpackbits(flat[full].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        query, lane = np.divmod(full[hit], self.lanes)
        return queries[query], lane * 64 + bit


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words in rows, padded with 0, and their lengths."""
    lengths = np.array([len(w) for w in words])
    codes = np.zeros((len(words), int(lengths.max())), np.uint32)
    codes[np.arange(codes.shape[1])[None, :] < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return codes, lengths


def near_pairs(block, m, a, b, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows in one block that are one edit apart and belong to this block."""
    codes, lengths = _matrix(words)
    index = PositionIndex(codes, lengths)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(lengths):
        rows = np.flatnonzero((lengths == size) & (m == size))
        for at in range(0, len(rows), SLICE):
            i, j = index.near(rows[at : at + SLICE], int(size))
            keep = (block[i] == block[j]) & (m[i] == m[j]) & (a[i] == a[j]) & ((lengths[i] != lengths[j]) | (i < j))
            i, j = i[keep], j[keep]
            if len(i):
                differs = codes[i, : size] != codes[j, : size]
                prefix = np.where(differs.any(axis=1), differs.argmax(axis=1), size)
                own = (a[i] <= prefix) & (prefix < b[i])
                left.append(i[own])
                right.append(j[own])
    return np.concatenate(left), np.concatenate(right)


def _nearest(held: list) -> pa.RecordBatch | None:
    """For each row with near words in its block: their number, and the most frequent one."""
    block, m, a, b, words, n = (np.concatenate([h[k] for h in held]) if k != 4 else [w for h in held for w in h[k]] for k in range(6))
    i, j = near_pairs(block, m, a, b, words)
    if not len(i):
        return None
    here, there = np.r_[i, j], np.r_[j, i]
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__))] = np.arange(len(words))
    order = np.lexsort((rank[there], -n[there], here))
    here, there = here[order], there[order]
    first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in here[first]], pa.string()), pa.array(np.diff(np.r_[first, len(here)])),
         pa.array([words[k] for k in there[first]], pa.string()), pa.array(n[there[first]])], names=["word", "n_near", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near, near_n: parts of each word's near words, one row per block that holds some."""
    rows, found = stored(blocks(words), "variant-blocks"), None

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(4)] + [batch.column(4).to_pylist(), batch.column(5).to_numpy()]
            cuts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(cols[0])]):
                if cols[0][lo] != last and size >= CHUNK:
                    out = _nearest(held)
                    if out:
                        yield out
                    held, size = [], 0
                held.append([c[lo:hi] for c in cols])
                size, last = size + hi - lo, cols[0][lo]
        out = _nearest(held) if held else None
        if out:
            yield out

    while True:
        sizes = rows.where(F.col("b") - F.col("a") > 1).groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
        crowded = stored(sizes.where(F.col("rows") > BLOCK).select("block"), "variant-crowded")
        more = bool(crowded.take(1))
        now = rows.join(crowded, "block", "left_anti") if more else rows
        dealt = (now.repartition("block").sortWithinPartitions("block")
                 .mapInArrow(run, "word string, n_near long, near string, near_n long"))
        found = dealt if found is None else found.unionByName(dealt)
        if not more:
            return found
        rows = stored(_halves(rows.join(crowded, "block", "left_semi").drop("block")), "variant-blocks")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain word -> form ends; counts grow tenfold with each step, so the chains are short."""
    now = stored(forms.select("word", F.col("form").alias("root")), "variant-forms")
    while True:
        above = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                       "variant-roots")
        now = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = stored(vocabulary(docs), "vocabulary")
    whole = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    parts = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "n_near", "near", "near_n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("word"))))
    each = whole.unionByName(parts).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    counts = -F.col("best.order")
    wins = counts >= TIMES * F.col("n")
    each = stored(each.select("word", "n", "n_near", F.when(wins, F.col("best.word")).alias("form"), F.when(wins, counts).alias("form_n")), "variants")
    ends = roots(each.where("form is not null"))
    return each.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
