"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

Every source is laid out in a seeded order, cut into shards of bounded size and
each shard into blocks of equal numbers of words. Blocks are the seats: sources
get them by highest quotients of their targets, the shards of a source by highest
quotients of their words, and each shard takes its quota of blocks in seeded
order. Only one row per source and per shard is ever ranked; documents are ordered
within one shard.

Defined cases: a NULL or blank text has size 0 and takes 0; a NULL source is a
source of its own and comes last; NULL document ids are ordinary ids; repeated
rows count as often as they appear; an empty table gives an empty result; columns
other than `doc_id`, `text` and `source` are carried only by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, word_count

#: Parameters of a production mix.
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 18
SEED = 20240517
#: Primes beyond any number of blocks in a shard: multiplying by one permutes the blocks.
STRIDES = (2147483659, 2147483693, 2147483713, 2147483743, 2147483777, 2147483783, 2147483813, 2147483857)


def _key(source: Column) -> Column:
    """A source as a text that is never NULL and keeps the order, NULL last."""
    return F.when(source.isNull(), "t").otherwise(F.concat(F.lit("s"), source))


def _named(key: Column) -> Column:
    return F.when(key != "t", F.substr(key, F.lit(2)))


def apportion(frame: DataFrame, by: list[str], votes: str, seats: str) -> DataFrame:
    """Add `quota`: the seats of each group of `by`, dealt to its rows by highest quotients votes/(2k+1).

    `seats` is constant in a group. With n rows in a group the final number of a
    row lies within share * n/2 + 1/2 of its exact share, so only the quotients
    in that range are ranked: about two for each row on average, and no more
    than four. Ties go to more votes, then to the smaller `name`. The frame has
    a column `name`, never NULL, that is unique in a group.
    """
    group = Window.partitionBy(*by)
    share = F.coalesce(F.col(votes) / F.nullif(F.sum(votes).over(group), F.lit(0.0)), F.lit(0.0))
    reach = share * F.count(F.lit(1)).over(group) / 2 + 0.5
    sized = (frame.withColumn("_share", share).withColumn("_reach", reach)
             .withColumn("_least", F.greatest(F.lit(0), F.floor(F.col(seats) * F.col("_share") - F.col("_reach")))
                         .cast("long"))
             .withColumn("_most", F.ceil(F.col(seats) * F.col("_share") + F.col("_reach")).cast("long"))
             .withColumn("_open", F.col(seats) - F.sum("_least").over(group)))
    offers = (sized.where((F.col(votes) > 0) & (F.col("_most") > F.col("_least")))
              .select(*by, "name", "_open", F.col(votes).alias("_votes"),
                      F.explode(F.sequence("_least", F.col("_most") - 1)).alias("_k"))
              .withColumn("_quotient", F.col("_votes") / (2 * F.col("_k") + 1)))
    best = Window.partitionBy(*by).orderBy(F.desc("_quotient"), F.desc("_votes"), F.col("name").asc_nulls_last(), "_k")
    won = (offers.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= F.col("_open"))
           .groupBy(*by, "name").agg(F.count(F.lit(1)).alias("_won")))
    return sized.join(won, [*by, "name"], "left").select(*frame.columns, (F.col("_least") + F.coalesce("_won", F.lit(0))).alias("quota"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """One row per source, in one partition: `source`, `source_size`, `weight`, `target`; a NULL source comes last.

    The targets share all words by weight; a source stops at `most` times its
    size and what it leaves is shared by the others. In order of size against
    weight the stopped sources come first, so one running sum finds them all.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    level = every.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    turns = F.array(*[F.lit(w) for w in weights])
    per = (sizes.groupBy("source").agg(F.sum("size").alias("source_size")).coalesce(1)
           .withColumn("weight", F.element_at(turns, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
           .withColumn("_cap", F.col("source_size") * most)
           .withColumn("_rest", rest).withColumn("_weights", F.sum("weight").over(after))
           .withColumn("_place", F.row_number().over(level)))
    stops = F.col("_rest") * F.col("weight") > F.col("_cap") * F.col("_weights")
    first = F.min(F.when(~stops, F.struct("_place", "_rest", "_weights"))).over(every)
    return (per.withColumn("_first", first)
            .withColumn("target", F.when(F.col("_place") < F.col("_first._place"), F.col("_cap").cast("double"))
                        .otherwise(F.col("weight") * F.col("_first._rest") / F.col("_first._weights")).cast("double"))
            .select("source", "source_size", "weight", "target"))


def _shards(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source and shard: words, blocks and the quota of blocks."""
    grouped = (sizes.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
               .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("shard_size") / BLOCK_WORDS)).cast("long")))
    own = grouped.groupBy("source").agg(F.sum("blocks").alias("source_blocks")).coalesce(1)
    wanted = (targets.coalesce(1).join(own, "source")
              .select(F.col("source").alias("name"), "target", "source_size", "source_blocks", F.lit(0).alias("mix"),
                      F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) * F.col("source_blocks"),
                                 F.lit(0.0)).alias("wanted"))
              .withColumn("seats", F.round(F.sum("wanted").over(Window.partitionBy(F.lit(0)))).cast("long")))
    sources = stored(apportion(wanted, ["mix"], "wanted", "seats")
                     .select(F.col("name").alias("source"), "target", "source_size",
                             F.least("quota", F.col("source_blocks") * MOST).alias("seats")), "mix-sources")
    votes = (grouped.join(sources, "source")
             .select("source", F.col("shard").alias("name"), "shard_size", "blocks", "target", "source_size", "seats",
                     F.col("blocks").cast("double").alias("votes")))
    return (apportion(votes, ["source"], "votes", "seats")
            .select("source", F.col("name").alias("shard"), "shard_size", "blocks", "target", "source_size",
                    F.least("quota", F.col("blocks") * MOST).alias("quota")))


def _copies(i: Column, seed: int) -> Column:
    """How often block i of a shard is taken: full rounds of the quota, and one more for the first in seeded order."""
    turn = F.xxhash64("source", "shard", F.lit(seed))
    stride = F.element_at(F.array(*[F.lit(s) for s in STRIDES]), (F.pmod(turn, F.lit(len(STRIDES))) + 1).cast("int"))
    place = F.pmod(i * stride + F.pmod(F.shiftright(turn, 8), F.col("blocks")), F.col("blocks"))
    return F.floor(F.col("quota") / F.col("blocks")) + F.when(place < F.col("quota") % F.col("blocks"), 1).otherwise(0)


def mix(docs: DataFrame, carry: bool = False, seed: int = SEED) -> DataFrame:
    """Each row of `docs` with `size`, `source_size`, `target`, `taken` and its `parts`.

    parts: array of (start, stop, copies) in words of the document, one for each
    block it lies in. With `carry` the whole input row travels along as `row`.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    sized = docs.select("doc_id", _key(F.col("source")).alias("source"), word_count(F.col("text")).alias("size"), *kept)
    narrow = sized.select("doc_id", "source", "size")
    narrow = stored(narrow, "mix-sizes")
    sized = sized if carry else narrow
    targets = stored(source_targets(narrow), "mix-targets")

    def sharded(frame):
        n = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))
        return (frame.join(targets.select("source", "source_size"), "source")
                .select(*frame.columns, F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), n).alias("shard")))

    shards = stored(_shards(sharded(narrow), targets), "mix-shards")
    order = (Window.partitionBy("source", "shard")
             .orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), "doc_id", "size")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    laid = sharded(sized).withColumn("stop", F.sum("size").over(order)).withColumn("start", F.col("stop") - F.col("size"))
    joined = laid.join(shards, ["source", "shard"])

    def block(at):
        return F.floor(((at + 1) * F.col("blocks") - 1) / F.col("shard_size")).cast("long")

    def edge(i):
        return F.floor(i * F.col("shard_size") / F.col("blocks")).cast("long")

    parts = F.when(F.col("size") > 0, F.transform(
        F.sequence(block(F.col("start")), block(F.col("stop") - 1)),
        lambda i: F.struct((F.greatest(F.col("start"), edge(i)) - F.col("start")).alias("start"),
                           (F.least(F.col("stop"), edge(i + 1)) - F.col("start")).alias("stop"),
                           _copies(i, seed).cast("long").alias("copies"))))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + (p["stop"] - p["start"]) * p["copies"])
    return (joined.withColumn("parts", parts).withColumn("taken", F.coalesce(taken, F.lit(0)))
            .select(*(["row"] if carry else []), "doc_id", _named(F.col("source")).alias("source"), "size", "source_size", "target",
                    "taken", "parts"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed corpus with the columns of `docs`: one row for each pass over a document, cut to the words it takes.

    A pass k holds the blocks taken more than k times, in text order with their
    own white space; a column `n_chars` follows the cut text. Documents of which
    no word is taken are absent.
    """
    cut = mix(docs, carry=True, seed=seed).where("taken > 0")
    most = F.array_max(F.transform("parts", lambda p: p["copies"]))
    even = F.array_min(F.transform("parts", lambda p: p["copies"])) == most
    units = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # an exploded value is evaluated once for the row, and not again inside what uses it
    ready = cut.select("row", "size", "parts", F.explode(F.array(F.struct(most.alias("most"), F.when(~even, units).alias("units")))).alias("u"))
    passes = ready.select("row", "size", "u.units", "parts", F.explode(F.sequence(F.lit(1), F.col("u.most"))).alias("round"))
    some = F.array_join(F.flatten(F.transform(
        F.expr("filter(parts, p -> p.copies >= round)"),
        lambda p: F.slice("units", (p["start"] + 1).cast("int"), (p["stop"] - p["start"]).cast("int")))), "")
    whole = F.expr("forall(parts, p -> p.copies >= round)")
    texts = passes.select("row", whole.alias("whole"), F.explode(F.array(F.when(whole, F.col("row.text")).otherwise(some))).alias("text"))
    return texts.select(*[(F.col("text") if c == "text" else
                           F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length("text")) if c == "n_chars" else
                           F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
