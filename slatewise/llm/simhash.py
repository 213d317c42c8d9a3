"""SimHash near-duplicates by a binary trie joined with itself.

Every text becomes a 64-bit fingerprint. The trie join walks pairs of trie nodes
downwards together, adds up the bits in which their prefixes differ, and drops a
pair once that exceeds the budget; a pair that cannot exceed it any more is linked
whole. To spread the join, the trie is grown in several bit orders: with the bits
in six blocks and a budget of four, two near fingerprints agree on at least two
blocks, so for every pair of blocks the fingerprints meet under the branch of
those blocks' bits, and each branch is joined on its own. A branch with too many
fingerprints is parted again by its remaining bits in the same way. Tasks return
links that span what they found (never all pairs), and the components of those
links are found by joins.

Only different fingerprints enter the join: rows are grouped by fingerprint first,
so copies, however many, are one node.

Defined cases: a NULL, empty or blank text has fingerprint zero and links like any
other; texts of fewer words than a shingle are one shingle; repeated rows share
their class; a NULL doc_id belongs to a class but never names it; an empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

SHINGLE, SEED, BUDGET, BLOCKS, BITS = 4, 42, 4, 6, 64
#: Fingerprints under one branch before it is parted again, node pairs expanded at once, shingles hashed at once.
BRANCH, FRONTIER, STEP = 20_000, 1 << 19, 1 << 16


def fingerprint(text: str | None) -> int:
    """Bit i is set where more than half of the shingles' hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hash64, n, ones = xxhash.xxh64_intdigest, max(1, len(words) - SHINGLE + 1), np.zeros(BITS, np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + SHINGLE - 1]
        if len(part) < SHINGLE:
            found = [hash64(b" ".join(part), SEED)]
        else:
            found = [hash64(b"%b %b %b %b" % s, SEED) for s in zip(part, part[1:], part[2:], part[3:])]
        bits = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fingerprint, one row per row of `docs`."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t.as_py()) for t in b.column(2)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], schema=schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text"))
            .mapInArrow(run, "doc_id long, text_key long, fingerprint long"))


def _ranges(blocks: int, bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def branches(prints: DataFrame, level: int) -> DataFrame:
    """Every fingerprint under each branch it takes at this level: (branch, fingerprint).

    On level 0 a branch is a choice of BLOCKS - BUDGET blocks and their bits. Deeper
    levels rotate the fingerprint, so that other blocks are formed, and hash the
    branch above into their own.
    """
    turned = F.col("fingerprint") if not level else F.shiftleft("fingerprint", 5 * level).bitwiseOR(
        F.shiftrightunsigned("fingerprint", BITS - 5 * level))
    blocks = [F.shiftrightunsigned(turned, low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in _ranges(BLOCKS, BITS)]
    above = [] if not level else [F.col("branch")]
    keys = [F.struct(F.xxhash64(*above, F.lit(i), *[blocks[j] for j in chosen]).alias("branch"))
            for i, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - BUDGET))]
    return prints.select(F.explode(F.array(*keys)).alias("k"), "fingerprint").select("k.branch", "fingerprint")


def trie_links(branch: np.ndarray, prints: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between fingerprints at most `budget` bits apart that share a branch.

    Rows are sorted by branch and fingerprint, so a trie node is a range of rows.
    The stack holds blocks of node pairs at one depth; a pair whose rows are all in
    one class already is dropped.
    """
    order = np.lexsort((prints, branch))
    branch, prints = branch[order], prints[order]
    n, above = len(prints), np.arange(len(prints))
    if n < 2:
        return prints[:0], prints[:0]

    def root(i):
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def join(a, b):
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            if x != y:
                above[max(x, y)] = min(x, y)

    def flattened():
        flat = above
        while True:
            nxt = flat[flat]
            if np.array_equal(nxt, flat):
                return flat
            flat = nxt

    starts = np.flatnonzero(np.r_[True, branch[1:] != branch[:-1]])
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    stack = [(BITS, starts[many], ends[many], starts[many], ends[many], np.zeros(int(many.sum()), np.int64))]
    while stack:
        left, a0, a1, b0, b1, off = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(left, *[x[:half] for x in (a0, a1, b0, b1, off)]), (left, *[x[half:] for x in (a0, a1, b0, b1, off)])]
            continue
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        near = leaves & (np.bitwise_count(prints[a0] ^ prints[b0]) <= budget) & (a0 != b0)
        join(a0[near], b0[near])
        whole = ~leaves & (off + left <= budget)
        for i in np.flatnonzero(whole):
            for lo, hi in ((a0[i], a1[i]), (b0[i], b1[i])):
                join(np.arange(lo, hi - 1), np.arange(lo + 1, hi))
            join(a0[i : i + 1], b0[i : i + 1])
        open_ = ~leaves & ~whole
        a0, a1, b0, b1, off = (x[open_] for x in (a0, a1, b0, b1, off))
        if not len(a0):
            continue
        flat = flattened()
        above[:] = flat
        changes = np.r_[0, np.cumsum(flat[1:] != flat[:-1])]
        done = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (flat[a0] == flat[b0])
        a0, a1, b0, b1, off = (x[~done] for x in (a0, a1, b0, b1, off))
        ones = np.r_[0, np.cumsum(prints >> np.uint64(left - 1) & np.uint64(1))].astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        parts = [(a0, am, b0, bm, off, ...), (am, a1, bm, b1, off, ...), (a0, am, bm, b1, off + 1, ...), (am, a1, b0, bm, off + 1, ~same)]
        cols = [np.concatenate([p[k] if p[5] is ... else p[k][p[5]] for p in parts]) for k in range(5)]
        keep = (cols[0] < cols[1]) & (cols[2] < cols[3]) & (cols[4] <= budget) & ~((cols[0] == cols[2]) & (cols[1] - cols[0] == 1))
        if keep.any():
            stack.append((left - 1, *[c[keep] for c in cols]))
    flat = flattened()
    hung = flat != np.arange(n)
    return prints[hung], prints[flat[hung]]


def links(prints: DataFrame) -> DataFrame:
    """Links (u, v) that connect all different fingerprints of `prints` with a chain of near ones."""
    found, rows, level = None, stored(branches(prints, 0), "branches"), 0

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy().view("u8")) for b in batches]
        if held:
            u, v = trie_links(*[np.concatenate([h[i] for h in held]) for i in range(2)])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view("i8")), pa.array(v.view("i8"))], names=["u", "v"])

    while True:
        sizes = rows.groupBy("branch").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        crowded = stored(sizes.where(F.col("n") > BRANCH).select("branch"), "crowded") if level < 2 else None
        more = bool(crowded is not None and crowded.take(1))
        now = rows.join(crowded, "branch", "left_anti") if more else rows
        dealt = now.repartition("branch").mapInArrow(run, "u long, v long")
        found = dealt if found is None else found.unionByName(dealt)
        if not more:
            return found
        level += 1
        rows = stored(branches(rows.join(crowded, "branch", "left_semi"), level), "branches")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fingerprint and component_id, the smallest doc_id reachable, for every row."""
    each = stored(fingerprints(docs), "fingerprints")
    prints = stored(each.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints.select("fingerprint")))
    placed = (prints.alias("p").join(roots.alias("r"), F.col("p.fingerprint") == F.col("r.node"), "left")
              .select("p.fingerprint", "least", F.coalesce("root", "p.fingerprint").alias("root")))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("fingerprint", "component_id")
    return each.join(named, "fingerprint").select("doc_id", "text_key", "fingerprint", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each class, that of the smallest doc_id (NULL last), with all columns."""
    found = classes(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    # a class whose ids are all NULL has no component_id: its fingerprint stands for it
    group = F.coalesce(F.col("component_id"), F.col("fingerprint"))
    first = (found.groupBy(F.col("component_id").isNull(), group).agg(F.min(order).alias("k"))
             .select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_text")))
    # one number names a row in both tables, so one exchange serves the join and the drop of repeated rows
    column = "_name"
    while column.lower() in map(str.lower, docs.columns):
        column += "_"
    name = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.col("doc_id").isNull(), F.xxhash64("text"))
    kept = first.select(F.xxhash64(F.coalesce("_id", F.lit(0).cast("long")), F.col("_id").isNull(), F.col("_text")).alias(column))
    return docs.withColumn(column, name).join(kept, column, "left_semi").dropDuplicates([column, "doc_id"]).drop(column)


def hex_digits(fingerprint):
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
