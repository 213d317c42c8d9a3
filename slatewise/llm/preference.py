"""Preference formatting (DataFrame functions only).

Two conversations make a pair, chosen and rejected. The turns they share from the
start are rendered once as the prompt; what follows is rendered for each side as
its completion, with the ranges of characters that are trained on: contents and end
marks of assistant turns. Turns of other roles inside a completion are masked.

Defined cases: repeated rows of a turn count once; turns with one number but other
words follow each other by role and text; a NULL number sorts first, a NULL role is
`unknown` and a NULL text is empty; rows with a NULL conversation belong to no pair;
a side without a conversation has an empty completion and a NULL id; equal
conversations have two empty completions; an empty table gives an empty result.
One pair is one row: it has to fit in memory, as a training example does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered: before the role, between role and content, after the content.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def neighbours(conversations: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as pair k: turns with pair_id and rejected."""
    half = F.floor(F.col("conv_id") / 2).cast("long")
    return (conversations.where("conv_id IS NOT NULL")
            .select(half.alias("pair_id"), (F.col("conv_id") - 2 * half != 0).alias("rejected"), "conv_id", "turn", "role", "text"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _trained(turns: Column) -> Column:
    """start:end of each trained range in the rendered turns, in code points."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(a, t):
        first = a["at"] + len(OPEN) + F.length(t["role"]) + len(MIDDLE)
        last = first + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.concat_ws(":", first, last))
        return F.struct(last.alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def format_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, prefix_turns, prompt, and text and trained ranges of both completions.

    turns: pair_id, rejected (whether a turn is of the rejected side), conv_id, turn, role, text.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = (turns.groupBy("pair_id")
             .agg(F.min(F.when(~F.col("rejected"), F.col("conv_id"))).alias("chosen_id"),
                  F.min(F.when(F.col("rejected"), F.col("conv_id"))).alias("rejected_id"),
                  F.sort_array(F.collect_set(F.when(~F.col("rejected"), turn))).alias("a"),
                  F.sort_array(F.collect_set(F.when(F.col("rejected"), turn))).alias("b")))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    prefix = F.when(F.size(same) == 0, 0).otherwise(
        F.coalesce(F.nullif(F.array_position(same, False), F.lit(0).cast("long")) - 1, F.size(same))).cast("int")
    cut = sides.withColumn("prefix_turns", prefix)

    def rest(side):
        return F.slice(side, F.col("prefix_turns") + 1, F.greatest(F.size(side) - F.col("prefix_turns"), F.lit(0)))

    cut = cut.withColumn("_a", rest("a")).withColumn("_b", rest("b"))
    return cut.select("pair_id", "chosen_id", "rejected_id", "prefix_turns",
                      _rendered(F.slice("a", F.lit(1), F.col("prefix_turns"))).alias("prompt"),
                      _rendered(F.col("_a")).alias("chosen"), _rendered(F.col("_b")).alias("rejected"),
                      _trained(F.col("_a")).alias("chosen_trained"), _trained(F.col("_b")).alias("rejected_trained"))


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id - 2 * CAST(floor(conv_id / 2) AS BIGINT) AS side, conv_id, role, text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
             '{OPEN}' || role || chr(10) || text || '{CLOSE.strip()}' || chr(10) AS shown FROM t),
p AS (SELECT pair_id, min(CASE WHEN side = 0 THEN conv_id END) AS chosen_id, min(CASE WHEN side = 1 THEN conv_id END) AS rejected_id,
             max(pos) AS longest FROM n GROUP BY pair_id),
d AS (SELECT pair_id, min(pos) AS first FROM (SELECT pair_id, pos FROM n GROUP BY pair_id, pos
      HAVING count(*) < 2 OR min(shown) <> max(shown)) GROUP BY pair_id),
q AS (SELECT p.*, coalesce(d.first - 1, p.longest) AS prefix_turns FROM p LEFT JOIN d USING (pair_id)),
m AS (SELECT n.*, q.prefix_turns,
             sum(length(shown)) OVER (PARTITION BY n.pair_id, side, pos > q.prefix_turns ORDER BY pos) AS stop FROM n JOIN q USING (pair_id)),
o AS (SELECT pair_id,
        string_agg(CASE WHEN side = 0 AND pos <= prefix_turns THEN shown END, '' ORDER BY pos) AS prompt,
        string_agg(CASE WHEN side = 0 AND pos > prefix_turns THEN shown END, '' ORDER BY pos) AS chosen,
        string_agg(CASE WHEN side = 1 AND pos > prefix_turns THEN shown END, '' ORDER BY pos) AS rejected,
        string_agg(CASE WHEN side = 0 AND pos > prefix_turns AND role = 'assistant'
                   THEN (stop - length(text) - {len(CLOSE)})::VARCHAR || ':' || stop::VARCHAR END, ',' ORDER BY pos) AS chosen_trained,
        string_agg(CASE WHEN side = 1 AND pos > prefix_turns AND role = 'assistant'
                   THEN (stop - length(text) - {len(CLOSE)})::VARCHAR || ':' || stop::VARCHAR END, ',' ORDER BY pos) AS rejected_trained
      FROM m GROUP BY pair_id)
SELECT pair_id, chosen_id, rejected_id, CAST(prefix_turns AS INTEGER) AS prefix_turns, coalesce(prompt, '') AS prompt,
       coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
       coalesce(chosen_trained, '') AS chosen_trained, coalesce(rejected_trained, '') AS rejected_trained
FROM q JOIN o USING (pair_id)
"""
