"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces at sentence signs and line ends. A piece is parsed into
chunks: a word whose hash is divisible by `PERIOD` starts a trigger window of three
words, each chunk runs from the start of one window to the end of the next, and the
last one ends with an end mark, so no chunk is a prefix of another. Neighbouring
chunks share exactly one window, and every phrase of up to four words lies whole in the
chunk that owns its first word: the one that starts last at or before it. The parse of the corpus becomes
a dictionary of different chunks with their frequencies, and phrases are counted inside
each different chunk once, weighted by its frequency, at the places the chunk owns.

Counting goes up by length: pairs are counted where both words are frequent enough,
triples and fours where all their pairs are. What is frequent enough is told to the
tasks as a Bloom filter of at most `BITS` bits; it never misses a frequent phrase, so
counts stay exact, and where it is too full it only lets more phrases through.

Defined cases: a NULL or empty text has no pieces; a NULL lang is `und`, together
with rows that say so; repeated rows count again; ties in the report go to the phrase
first in byte order; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEAST, LONGEST, SUBSUMED, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
WINDOW, PERIOD, NO_LANG = 3, 32, "und"
#: Bytes of pieces or chunks that a task holds before it sends what it counted; rows of one batch that it sends.
HELD_BYTES, ROWS = 16 << 20, 1 << 16
#: The filter: bits for each phrase, least and most bits (32 MB), bits of one part, hash functions.
BITS_EACH, LEAST_BITS, BITS, PART, HASHES = 16, 1 << 19, 1 << 28, 1 << 19, 3

_PLAIN = bytearray(range(256))
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _PLAIN[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _PLAIN[_c] = 10
_PLAIN[9] = 32
_PLAIN = bytes(_PLAIN)


class _Triggers(dict):
    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        self[word] = found = not zlib.crc32(word) % PERIOD
        return found


def chunks(piece: bytes, triggers: dict) -> list[bytes]:
    """The chunks of one piece, words parted by one space; the last one ends with a line feed."""
    words, out, start = piece.split(), [], 0
    for at in range(1, len(words) - WINDOW + 1):
        if triggers[words[at]]:
            out.append(b" ".join(words[start : at + WINDOW]))
            start = at
    return [*out, b" ".join(words[start:]) + b"\n"] if words else out


def dictionary(docs: DataFrame) -> DataFrame:
    """lang, chunk, freq: the different chunks of all texts."""
    def flush(held):
        triggers = _Triggers()
        for lang, found in held.items():
            each = Counter()
            for piece, n in found.items():
                for chunk in chunks(piece, triggers):
                    each[chunk] += n
            names = list(each)
            for at in range(0, len(names), ROWS):
                part = names[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                                                  pa.array([each[c] for c in part], pa.int64())], names=["lang", "chunk", "freq"])

    def run(batches):
        held, size = defaultdict(Counter), 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                plain = (text.as_py() or "").encode().translate(_PLAIN)
                held[lang].update(plain.split(b"\n"))
                size += len(plain)
                if size > HELD_BYTES:
                    yield from flush(held)
                    held, size = defaultdict(Counter), 0
        yield from flush(held)

    return (docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").alias("text"))
            .mapInArrow(run, "lang string, chunk string, freq long").groupBy("lang", "chunk").agg(F.sum("freq").alias("freq")))


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their two parts."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _word_hash(lang: str, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{lang}\0{word}")


def _slots(hashes: np.ndarray, bits: int):
    """The bits that stand for these hashes in a filter of `bits` bits, a power of two."""
    for i in range(HASHES):
        x = _mixed(hashes, np.full(len(hashes), i, np.uint64))
        yield ((x >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)


def frequent_filter(phrases: DataFrame) -> bytes:
    """A Bloom filter of (lang, phrase), built in parts by tasks; its size goes by their number, up to `BITS` bits."""
    bits = LEAST_BITS
    count = phrases.count()
    while bits < min(BITS, BITS_EACH * count):
        bits *= 2

    def mark(batches):
        parts = {}
        for b in batches:
            hashes = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = np.array([_word_hash(lang, w) for w in phrase.split(" ")], np.uint64)
                h = words[:1]
                for k in range(1, len(words)):
                    h = _mixed(h, words[k : k + 1])
                hashes.append(h)
            if hashes:
                for slots in _slots(np.concatenate(hashes), bits):
                    for part in np.unique(slots // PART).tolist():
                        own = slots[slots // PART == part] % PART
                        if part not in parts:
                            parts[part] = np.zeros(PART // 8, np.uint8)
                        np.bitwise_or.at(parts[part], own // 8, (1 << (own % 8)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([p.tobytes() for p in parts.values()], pa.binary())],
                                         names=["part", "bits"])

    def merge(key, group):
        rows = np.zeros(PART // 8, np.uint8)
        for x in group.column("bits"):
            rows |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"part": [key[0].as_py()], "bits": pa.array([rows.tobytes()], pa.binary())})

    whole = bytearray(bits // 8)
    found = phrases.select("lang", "phrase").mapInArrow(mark, "part long, bits binary").groupBy("part").applyInArrow(merge, "part long, bits binary")
    for row in found.toLocalIterator():  # at most BITS / PART rows
        whole[row.part * PART // 8 : (row.part + 1) * PART // 8] = row.bits
    return bytes(whole)


def _passes(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for slots in _slots(hashes, 8 * len(table)):
        ok &= (table[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A small number for each different value, and the values by number."""
    found = pa.array(values).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy()


def _language_counts(lang: str, chunk_texts: pa.Array, freq: np.ndarray, sizes: tuple, table: np.ndarray | None):
    """(lang, phrase, a) of the phrases of these sizes in some chunks of one language; phrase NULL stands for all its words."""
    last = pc.ends_with(chunk_texts, "\n").to_numpy(zero_copy_only=False)
    split = pc.split_pattern(pc.utf8_rtrim(chunk_texts, "\n"), " ")
    coded = split.flatten().dictionary_encode()
    words, n = coded.dictionary, len(coded.dictionary)
    lengths = pc.list_value_length(split).to_numpy().astype(np.int64)
    # one place behind each chunk parts it from the next
    ids = np.full(int(lengths.sum()) + len(lengths), -1, np.int64)
    ends = np.cumsum(lengths + 1)
    gaps = np.zeros(len(ids), bool)
    gaps[ends - 1] = True
    ids[~gaps] = coded.indices.to_numpy()
    own = np.where(last, lengths, lengths - WINDOW)
    weight = np.repeat(np.column_stack([freq, np.zeros_like(freq)]).ravel(), np.column_stack([own, lengths + 1 - own]).ravel())

    def counted(starts, size):
        """Sums of weights of the phrases at these places, with their words."""
        code, decode = ids[starts], []
        for k in range(1, size):
            if k > 1:
                code, pairs = _coded(code)
                decode.append(pairs)
            code = code * n + ids[starts + k]
        code, left = _coded(code)
        sums = np.bincount(code, weight[starts], len(left)).astype(np.int64)
        parts = []
        for k in range(size - 1):
            left, right = np.divmod(left, n)
            parts.insert(0, right)
            if decode:
                left = decode.pop()[left]
        parts.insert(0, left)
        for lo in range(0, len(sums), ROWS):
            text = [words.take(pa.array(x[lo : lo + ROWS])) for x in parts]
            phrase = pc.binary_join_element_wise(*text, " ") if size > 1 else text[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), phrase, pa.array(sums[lo : lo + ROWS])],
                                             names=["lang", "phrase", "a"])

    if sizes == (1,):
        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.nulls(1, pa.string()), pa.array([int((own * freq).sum())], pa.int64())],
                                         names=["lang", "phrase", "a"])
        yield from counted(np.flatnonzero(weight > 0), 1)
        return
    hashes = np.array([_word_hash(lang, w) for w in words.to_pylist()], np.uint64)
    pairs = (ids[1:] >= 0) & (ids[:-1] >= 0)
    if sizes == (2,):
        good = _passes(hashes, table)
        pairs &= good[ids[:-1]] & good[ids[1:]]
    else:
        places = np.flatnonzero(pairs)
        code, each = _coded(ids[places] * n + ids[places + 1])
        pairs[places] = _passes(_mixed(hashes[each // n], hashes[each % n]), table)[code]
    for size in sizes:
        ok = weight[: len(pairs) - size + 2] > 0
        for k in range(size - 1):
            ok &= pairs[k : len(pairs) - size + 2 + k]
        yield from counted(np.flatnonzero(ok), size)


def _batch_counts(held: list, sizes: tuple, table: np.ndarray | None):
    """What `_language_counts` gives for each language of these dictionary rows."""
    rows = pa.Table.from_batches(held).combine_chunks()
    langs = rows.column(0).chunk(0).dictionary_encode()
    code, texts, freq = langs.indices.to_numpy(), rows.column(1).chunk(0), rows.column(2).to_numpy()
    order = np.argsort(code, kind="stable")
    for number, part in enumerate(np.split(order, np.cumsum(np.bincount(code, minlength=len(langs.dictionary)))[:-1])):
        yield from _language_counts(langs.dictionary[number].as_py(), texts.take(pa.array(part)), freq[part], sizes, table)


def phrase_counts(chunk_table: DataFrame, sizes: tuple, frequent: bytes | None = None) -> DataFrame:
    """lang, phrase, a: exact occurrences of the phrases of these sizes that the filter lets through."""
    shared = chunk_table.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        table = None if shared.value is None else np.frombuffer(shared.value, np.uint8)
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column(1).nbytes
            if size > HELD_BYTES:
                yield from _batch_counts(held, sizes, table)
                held, size = [], 0
        if held:
            yield from _batch_counts(held, sizes, table)

    return chunk_table.mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases of one to four words with a >= LEAST, and (lang, n) of all words."""
    parsed = stored(dictionary(docs), "chunks")
    wanted = F.col("phrase").isNotNull() & (F.col("a") >= LEAST)
    first = stored(phrase_counts(parsed, (1,)).where(F.col("phrase").isNull() | (F.col("a") >= LEAST)), "words")
    words = first.where(wanted)
    pairs = stored(phrase_counts(parsed, (2,), frequent_filter(words)).where(wanted), "pairs")
    longer = stored(phrase_counts(parsed, (3, LONGEST), frequent_filter(pairs)).where(wanted), "longer")
    return words.unionByName(pairs).unionByName(longer), first.where("phrase is null").select("lang", F.col("a").alias("n"))


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of each candidate, by its lowest cut."""
    size = F.size(F.split("phrase", " "))
    cuts = (phrases.withColumn("words", size).where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .selectExpr("lang", "phrase", "words", "a", "k", "substring_index(phrase, ' ', k) as head", "substring_index(phrase, ' ', k - words) as tail"))
    left = phrases.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    score = F.expr(f"cast({SCALE} as decimal(19, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + r)")
    each = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).withColumn("score", score.cast("long"))
    best = each.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language."""
    phrases, totals = frequent_phrases(docs)
    rated = stored(scored(phrases), "scored")
    inner = F.expr("flatten(transform(sequence(2, words - 1), c -> transform(sequence(1, words - c + 1), i -> array_join(slice(split(phrase, ' '), i, c), ' '))))")
    covers = (rated.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("cover")))
    kept = rated.join(covers, ["lang", "phrase"], "left").where(
        F.col("cover").isNull() | (100 * F.col("cover").cast("decimal(19,0)") < SUBSUMED * F.col("a").cast("decimal(19,0)")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang, doc_id, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM worded),
grams AS (
  SELECT lang, array_to_string(w[i:i + c - 1], ' ') AS phrase, c, count(*) AS a
  FROM places, (VALUES (1), (2), (3), ({LONGEST})) AS s(c) WHERE i + c - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE c = 1 GROUP BY lang),
common AS (SELECT * FROM grams WHERE a >= {LEAST}),
cuts AS (
  SELECT g.lang, g.phrase, g.c, g.a, k, string_split(g.phrase, ' ') AS w
  FROM common g, (VALUES (1), (2), (3)) AS s(k) WHERE k < g.c),
rated AS (
  SELECT u.lang, u.phrase, u.c, u.a, x.a AS l, y.a AS r, k, (({SCALE}::HUGEINT * u.a) // (x.a + y.a))::BIGINT AS score
  FROM cuts u JOIN common x ON x.lang = u.lang AND x.phrase = array_to_string(w[1:k], ' ')
  JOIN common y ON y.lang = u.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM best o WHERE o.lang = b.lang AND o.c > b.c AND 100 * o.a >= {SUBSUMED} * b.a
      AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
JOIN totals USING (lang) WHERE rank <= {TOP}
"""
