"""Nearest neighbours by multiprobe p-stable hashing, with exact distances for every candidate.

A table hashes a vector by K random Gaussian projections, cut into cells of one
width. A query looks into its own bucket of each table and into perturbed ones, in
the order of estimated success: the sets of neighbouring cells with the least sum
of squared distances from the query to the cells' borders. Candidates of all tables
are merged, and each is ranked by its exact distance in double precision.

Work is dealt out by (table, part of its buckets, salt): a part gets its vectors
once and each query with the list of buckets it wants there, and returns ten rows
for a query at most. Buckets above `CROWDED` are split by a salt of the vector id
and looked into wholly. Equal vectors are one entry that keeps its smallest ids,
and equal queries are searched once. A query that finds too few neighbours is
compared with all vectors in blocks.

The index takes in every vector. The width is fitted to the median distance in a
sample of at most `SAMPLE` vectors. `K` starts from the logarithm of their number
and is lowered until recall holds: at most `JUDGES` of the queries are compared with
every vector, and `K` is the largest for which the mean share of their true
neighbours in probed buckets, less two standard errors, is `RECALL` at least. Where
no `K` reaches it, every query is compared with all vectors.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite
components take no part; only vectors of one length are compared; rows with equal
id and vector count once, and rows of the query's own id are never its neighbours;
ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

NEIGHBOURS, QUERY_STEP = 10, 100
TABLES, PROBES, SEED = 10, 100, 77
#: Projections per doubling of the vectors, cell width in median distances, and the sample that gives the median.
PER_DOUBLING, WIDTH, SAMPLE = 0.58, 1.41, 512
#: Recall to hold, and the queries it is measured on.
RECALL, JUDGES = 0.9, 200
#: Vectors in a part, and in a bucket before it is salted.
PART, CROWDED = 4096, 1024

_ODD = np.uint64(0x9E3779B97F4A7C15)


def usable(vector):
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def probe_sets(into: np.ndarray, most: int) -> list[tuple[tuple[int, int], ...]]:
    """Perturbations ((projection, step), ...) of a query in order of estimated success, itself first.

    into: how far the query lies into each of its cells, 0 to 1.
    """
    moves = sorted([(x * x, i, -1) for i, x in enumerate(into.tolist())] + [((1 - x) ** 2, i, 1) for i, x in enumerate(into.tolist())])
    cost, out, heap = [m[0] for m in moves], [()], [(moves[0][0], (0,))]
    while heap and len(out) < most:
        total, chosen = heapq.heappop(heap)
        if len({moves[j][1] for j in chosen}) == len(chosen):
            out.append(tuple(moves[j][1:] for j in chosen))
        j = chosen[-1] + 1
        if j < len(moves):
            heapq.heappush(heap, (total - cost[j - 1] + cost[j], (*chosen[:-1], j)))
            heapq.heappush(heap, (total + cost[j], (*chosen, j)))
    return out


class Hashes:
    """The tables for vectors of one length."""

    def __init__(self, length: int, projections: int, width: float):
        rng = np.random.default_rng([SEED, length])
        self.k, self.width = projections, width
        self.lines = rng.standard_normal((length, TABLES * projections))
        self.shift = rng.uniform(0, 1, TABLES * projections)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """Projections in units of cells: rows x tables x K."""
        return (vectors @ self.lines / self.width + self.shift).reshape(-1, TABLES, self.k)

    @staticmethod
    def names(cells: np.ndarray, table) -> np.ndarray:
        """Bucket numbers of whole cells (last axis K); a rare clash of two buckets only adds candidates."""
        with np.errstate(over="ignore"):
            out = np.broadcast_to(np.asarray(table, np.uint64) + np.uint64(1), cells.shape[:-1]) * _ODD
            for i in range(cells.shape[-1]):
                out = (out ^ cells[..., i].astype(np.int64).view(np.uint64)) * _ODD
                out ^= out >> np.uint64(29)
        return out.view(np.int64)


def _matrix(column) -> np.ndarray:
    """A list column without NULLs, all of one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(batch, column: int):
    lengths = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        yield int(length), batch.filter(pa.array(lengths == length))


def _keys(frame: DataFrame, fit, probing: bool) -> DataFrame:
    """(id, tab, bucket) of every vector, in its own buckets or in all it probes; frame: id, vector."""
    schema = pa.schema([("id", pa.int64()), ("tab", pa.int32()), ("bucket", pa.int64())])

    def run(batches):
        for whole in batches:
            for length, b in _by_length(whole, 1):
                hashes, ids = Hashes(length, *fit), b.column(0).to_numpy()
                cells = hashes.cells(_matrix(b.column(1)))
                own = np.floor(cells)
                if not probing:
                    names = Hashes.names(own, np.arange(TABLES, dtype=np.uint64))
                    cols = [np.repeat(ids, TABLES), np.tile(np.arange(TABLES, dtype=np.int32), len(ids)), names.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)
                    continue
                for i, q in enumerate(ids.tolist()):
                    for t in range(TABLES):
                        sets = probe_sets(cells[i, t] - own[i, t], PROBES)
                        moved = np.repeat(own[i, t][None], len(sets), axis=0)
                        for row, moves in zip(moved, sets):
                            for j, step in moves:
                                row[j] += step
                        names = np.unique(Hashes.names(moved, t))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), q)), pa.array(np.full(len(names), t, np.int32)),
                                                          pa.array(names)], schema=schema)

    return frame.mapInArrow(run, "id long, tab int, bucket long")


def nearest_of(wanted: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int):
    """The `most` nearest rows of `vectors`: (ids, distances), ties to the smaller id."""
    far = np.sqrt(((vectors - wanted) ** 2).sum(axis=1))
    if len(far) > 4 * most:
        near = np.flatnonzero(far <= np.partition(far, most - 1)[most - 1])
        far, ids = far[near], ids[near]
    order = np.lexsort((ids, far))[:most]
    return ids[order], far[order]


def true_neighbours(entries: DataFrame, judges: list[tuple[int, np.ndarray]], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vector, matrix of its `most` nearest other vectors) of each judge (id, vector), by comparison with every vector of its length."""
    schema = "query long, id long, score double, vector array<double>"
    shape = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("vector", pa.list_(pa.float64()))])

    def run(batches):
        best = {}
        for whole in batches:
            for length, b in _by_length(whole, 1):
                ids, vectors = b.column(0).to_numpy(), _matrix(b.column(1))
                asking = [(q, v) for q, v in judges if len(v) == length]
                if not asking:
                    continue
                squares = (vectors * vectors).sum(axis=1)
                products = vectors @ np.array([v for _, v in asking]).T
                for i, (q, v) in enumerate(asking):
                    far = squares - 2 * products[:, i] + v @ v
                    far[ids == q] = np.inf
                    rows = np.argpartition(far, most - 1)[:most] if len(far) > most else np.arange(len(far))
                    found = [(float(far[r]), int(ids[r]), vectors[r].copy()) for r in rows if far[r] < np.inf]
                    best[q] = heapq.nsmallest(most, best.get(q, []) + found, key=lambda x: x[:2])
        rows = [(q, i, far, v) for q, found in best.items() for far, i, v in found]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, shape)], schema=shape)

    each = Window.partitionBy("query").orderBy("score", "id")
    near = {}
    for r in (entries.select("id", "vector").mapInArrow(run, schema).withColumn("_n", F.row_number().over(each))
              .where(F.col("_n") <= most).select("query", "vector").collect()):
        near.setdefault(r.query, []).append(r.vector)
    return [(v, np.array(near[q], float)) for q, v in judges if q in near]


def shares(truth: list[tuple[np.ndarray, np.ndarray]], projections: int, width: float) -> np.ndarray:
    """Per judge, the share of its true neighbours that lie in a bucket it probes: its recall, since candidates are ranked exactly."""
    out, tables = [], {}
    for wanted, near in truth:
        hashes = tables.setdefault(len(wanted), Hashes(len(wanted), projections, width))
        cells, theirs = hashes.cells(wanted[None])[0], np.floor(hashes.cells(near))
        own, hit = np.floor(cells), np.zeros(len(near), bool)
        for t in range(TABLES):
            if hit.all():
                break
            probed = {frozenset(moves) for moves in probe_sets(cells[t] - own[t], PROBES)}
            steps = theirs[:, t] - own[t]
            for i in np.flatnonzero(~hit & (np.abs(steps) <= 1).all(axis=1)):
                hit[i] = frozenset((int(j), int(steps[i, j])) for j in np.flatnonzero(steps[i])) in probed
        out.append(hit.mean())
    return np.array(out)


def lower(recalls: np.ndarray) -> float:
    """The mean less two standard errors."""
    return float(recalls.mean() - 2 * recalls.std() / math.sqrt(len(recalls)))


def projections_for(truth, n: int, width: float) -> int:
    """The largest number of projections that holds `RECALL`, at most as many as `n` vectors call for; 0 if there is none."""
    most = max(2, round(PER_DOUBLING * math.log2(max(n, 2))))
    return next((k for k in range(most, 0, -1) if lower(shares(truth, k, width)) >= RECALL), 0) if truth else most


def _compare(most: int):
    """A function of (vectors of a part, queries with their buckets in it)."""
    schema = pa.schema([("query", pa.int64()), ("entry", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            bucket, ids, vectors = left["bucket"].to_numpy(), left["id"].to_numpy(), _matrix(left["vector"])
            order = np.argsort(bucket, kind="stable")
            bucket, ids, vectors = bucket[order], ids[order], vectors[order]
            wanted = _matrix(right["vector"])
            for i, (q, buckets) in enumerate(zip(right["id"].to_pylist(), right["buckets"].to_pylist())):
                if buckets is None:
                    rows = slice(None)
                else:
                    lo, hi = np.searchsorted(bucket, buckets), np.searchsorted(bucket, buckets, "right")
                    spans = [np.arange(a, b) for a, b in zip(lo, hi) if a < b]
                    if not spans:
                        continue
                    rows = np.concatenate(spans)
                near, far = nearest_of(wanted[i], ids[rows], vectors[rows], most)
                out[0].append(np.full(len(near), q))
                out[1].append(near)
                out[2].append(far)
        columns = [np.concatenate(c) if c else np.array([], kind) for c, kind in zip(out, ("i8", "i8", "f8"))]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run


def search(vectors: DataFrame, queries, most: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score of the `most` nearest found; vectors: vec_id, embedding; queries: a condition on vec_id."""
    valid = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
                   .where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct(), "ann-vectors")
    # one entry per different vector, with the ids that can be among the nearest
    few = Window.partitionBy("vector").orderBy("vec_id")
    ranked = valid.withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= most + 1)
    entries = stored(ranked.groupBy("vector").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids")),
                     "ann-entries")
    asked = valid.where(queries)
    asks = stored(asked.join(entries.select("vector", F.col("id").alias("entry")), "vector").select("vec_id", "entry"), "ann-asks")
    wanted = stored(entries.join(asks.select(F.col("entry").alias("id")).distinct(), "id", "left_semi").select("id", "vector"), "ann-wanted")

    sample = entries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    lists = [np.array(r.vector, float) for r in sample]
    pairs = [float(np.linalg.norm(a - b)) for a, b in zip(lists, lists[1:] + lists[:1]) if len(a) == len(b)]
    n, rows = entries.count(), valid.count()
    width = WIDTH * float(np.median(pairs) if pairs else 1.0) or 1.0
    judges = [(r.id, np.array(r.vector, float)) for r in wanted.orderBy(F.xxhash64("id"), "id").limit(JUDGES).collect()]
    fit = (projections_for(true_neighbours(entries, judges, most), n, width), width)

    run, shape = _compare(most + 1), "query long, entry long, score double"

    def answers(found):
        """Rows per asking id: entries spelled out into ids, without its own."""
        best = Window.partitionBy("query").orderBy("score", "entry")
        top = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most + 1)
        spelled = (top.join(entries.select(F.col("id").alias("entry"), "ids"), "entry")
                   .select("query", "score", F.explode("ids").alias("vec_id")))
        ranks = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return (asks.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")).distinct().join(spelled, "query")
                .where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
                .withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= most)
                .select("query_id", "rank", "vec_id", "score"))

    def against_all(short):
        """The exact way: all vectors in blocks, against the entries in `short`."""
        blocks = max(1, math.ceil(n / PART))
        block = F.pmod(F.xxhash64("id"), F.lit(blocks))
        every = entries.select("id", "vector", F.lit(0).cast("long").alias("bucket"), F.xxhash64(block, F.size("vector")).alias("part"))
        again = (wanted.join(short, "id").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
                 .select("id", "vector", F.lit(None).cast("array<long>").alias("buckets"),
                         F.xxhash64("_block", F.size("vector")).alias("part")))
        return every.groupBy("part").cogroup(again.groupBy("part")).applyInArrow(run, shape)

    if not fit[0]:
        return answers(stored(against_all(wanted.select("id")).distinct(), "ann-found"))
    parts = max(1, math.ceil(n / PART))
    index = stored(_keys(entries.select("id", "vector"), fit, False), "ann-index")
    crowds = (index.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWDED)
              .select("bucket", F.ceil(F.col("_n") / CROWDED).cast("int").alias("salts")))
    crowds = stored(crowds, "ann-crowds")

    def part(salt):
        return F.xxhash64("tab", F.pmod(F.xxhash64("bucket", salt), F.lit(parts)), salt)

    members = (index.join(crowds, "bucket", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)))
               .select("id", "bucket", part(F.col("_salt")).alias("part")).join(entries.select("id", "vector"), "id")
               .withColumn("part", F.xxhash64("part", F.size("vector"))))
    probes = (_keys(wanted, fit, True).join(crowds, "bucket", "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
              .groupBy("id", part(F.col("_salt").cast("long")).alias("part")).agg(F.collect_list("bucket").alias("buckets"))
              .join(wanted, "id").withColumn("part", F.xxhash64("part", F.size("vector"))))
    found = stored(members.groupBy("part").cogroup(probes.groupBy("part")).applyInArrow(run, shape).distinct(), "ann-found")
    first = stored(answers(found), "ann-answers")
    full = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min(most, rows - 1))
    short = stored(asks.join(full, asks.vec_id == full.query_id, "left_anti").select(F.col("entry").alias("id")).distinct(), "ann-short")
    if not short.take(1):
        return first
    whole = against_all(short)
    both = answers(stored(whole.unionByName(found.join(short, found["query"] == short["id"], "left_anti")).distinct(), "ann-found"))
    return both
