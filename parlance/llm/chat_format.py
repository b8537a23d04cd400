"""Preference formatting of chosen and rejected conversations.

A conversation is its set of turns in the order of turn number (ties: role, then text). Two ordered sets share
as prefix exactly the turns before the first one that only one of them has, so the longest common prefix is found by
counting sides per turn and taking a minimum, without bringing a conversation together: one of any length is spread
over tasks. The prefix is rendered once as prompt, the rest of either side as its completion. Results are
rendered turns with their character offsets and, in completions, the span that a loss is taken on: what the
assistant says, with its end mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.common import documents

CLOSE = "\n<|end|>\n"
TRAINED_ROLE = "assistant"
#: Turns whose offsets one task sums up at a time.
RUN = 256


def format_preferences(turns: DataFrame, pairs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per rendered turn: pair_id, part (prompt, chosen or rejected), turn, role, rendered, start (characters of
    the part before it), mask_start and mask_end (trained characters, counted in the part; null: none).

    pairs: pair_id (distinct), chosen, rejected (conversation ids). Repeated equal turns of a conversation are one turn. A
    null role is rendered as an empty one, a null text as an empty one, a null turn comes first. Rows without a
    conversation id, pairs with a null, and conversations without turns have no rows. Two equal conversations are all
    prompt and have no completions. Other columns of turns are not read.
    """
    t = turns.select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sides = pairs.where("pair_id is not null and chosen is not null and rejected is not null").select(
        "pair_id", F.explode(F.array(F.struct(F.col("chosen").alias("c"), F.lit(1).alias("side")), F.struct(F.col("rejected").alias("c"), F.lit(2).alias("side")))).alias("x")
    ).select("pair_id", F.col("x.c").alias("_c"), F.col("x.side").alias("side"))
    # Turns on both sides, on the chosen (1) or on the rejected (2) alone; equal turns of one side are one.
    met = t.join(sides, F.col("_conv") == F.col("_c")).groupBy("pair_id", "turn", "role", "text").agg(F.bit_or("side").alias("sides"))
    split = met.where("sides <> 3").groupBy("pair_id").agg(F.min(F.struct("turn", "role", "text")).alias("_first"))
    placed = met.join(split.withColumnRenamed("pair_id", "_pair"), F.col("pair_id") == F.col("_pair"), "left")
    in_prompt = F.col("_first").isNull() | (F.struct("turn", "role", "text") < F.col("_first"))
    parts = F.when(in_prompt, F.array(F.lit("prompt"))).when(F.col("sides") == 1, F.array(F.lit("chosen"))).when(F.col("sides") == 2, F.array(F.lit("rejected"))).otherwise(F.array(F.lit("chosen"), F.lit("rejected")))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    d = placed.select("pair_id", F.explode(parts).alias("part"), "turn", "role", "text")
    d = d.withColumn("rendered", F.concat(head, F.col("text"), F.lit(CLOSE))).withColumn("_size", F.length("rendered").cast("long"))
    # Offsets in two steps: sums per run of turns, then inside a run.
    d = d.withColumn("_run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 62))))
    runs = d.groupBy("pair_id", "part", "_run").agg(F.sum("_size").alias("_s"))
    earlier = W.partitionBy("pair_id", "part").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(F.col("pair_id").alias("_pair"), F.col("part").alias("_part"), F.col("_run").alias("_r"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("pair_id", "part", "_run").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    d = d.join(runs, (F.col("pair_id") == F.col("_pair")) & (F.col("part") == F.col("_part")) & (F.col("_run") == F.col("_r")))
    d = d.withColumn("start", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED_ROLE)
    return d.select(
        "pair_id",
        "part",
        "turn",
        "role",
        "rendered",
        "start",
        F.when(trained, F.col("start") + F.length(head)).alias("mask_start"),
        F.when(trained, F.col("start") + F.col("_size") - 1).alias("mask_end"),
    )


def assemble(rendered: DataFrame, max_chars: int = 1_000_000) -> DataFrame:
    """pair_id, prompt, chosen, rejected as strings, and chosen_mask, rejected_mask (arrays of start and end), for pairs of
    at most max_chars characters; longer pairs stay rendered turns, for readers that stream them."""
    size = rendered.groupBy("pair_id").agg(F.sum(F.length("rendered")).alias("_n")).where(F.col("_n") <= max_chars).select(F.col("pair_id").alias("_pair"))
    fit = rendered.join(size, F.col("pair_id") == F.col("_pair"), "left_semi")

    def joined(part):
        own = F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("start", "rendered"))))
        return F.array_join(F.transform(own, lambda x: x["rendered"]), "")

    def mask(part):
        own = F.collect_list(F.when((F.col("part") == part) & F.col("mask_start").isNotNull(), F.struct(F.col("mask_start").alias("start"), F.col("mask_end").alias("end"))))
        return F.sort_array(own)

    return fit.groupBy("pair_id").agg(*[joined(p).alias(p) for p in ("prompt", "chosen", "rejected")], *[mask(p).alias(f"{p}_mask") for p in ("chosen", "rejected")])


def continuations(turns: DataFrame, conv: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Turns and pairs that share a history, from every conversation and all its turns: what comes before its last assistant turn, followed by
    that turn and the rest (chosen), or by its neighbour's last assistant turn (rejected). A stand-in for human preferences, linear in the turns.

    Neighbours are conversations 2k and 2k + 1; without a neighbour's answer the rejected one is empty. A conversation without an assistant turn, or
    with such turns without a number alone, is all history: the rejected answer comes behind it. Rows without a conversation are left out.
    """
    t = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = F.col("role") == TRAINED_ROLE
    last = t.groupBy("c").agg(F.max(F.when(said, F.col("turn"))).alias("last"), F.max("turn").alias("top"))
    known = t.join(last, "c")
    history = known.where(F.col("turn").isNull() | F.col("last").isNull() | (F.col("turn") < F.col("last")))
    answers = known.where(said & (F.col("turn") == F.col("last")))
    other = answers.select((F.col("c").bitwiseXOR(F.lit(1))).alias("c"), F.col("text").alias("other"))
    name = lambda side: F.concat(F.col("c").cast("string"), F.lit(side))
    place = F.coalesce("last", F.col("top") + 1, F.lit(0))
    rejected = last.join(other, "c", "left").select(name("-").alias("conv_id"), place.alias("turn"), F.lit(TRAINED_ROLE).alias("role"), F.coalesce("other", F.lit("")).alias("text"))
    sides = [t.select(name("+").alias("conv_id"), "turn", "role", "text"), history.select(name("-").alias("conv_id"), "turn", "role", "text"), rejected]
    return sides[0].union(sides[1]).union(sides[2]), last.select(F.col("c").alias("pair_id"), name("+").alias("chosen"), name("-").alias("rejected"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(*continuations(documents(spark, sf_dir, "conversations")))


OP3_SQL = """
WITH r AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, max(turn) FILTER (role = 'assistant') AS last, max(turn) AS top FROM r GROUP BY c),
a AS (SELECT r.* FROM r JOIN l USING (c) WHERE role = 'assistant' AND turn = last),
t AS (SELECT c || '+' AS conv_id, turn, role, text FROM r UNION ALL SELECT c || '-', turn, role, text FROM r JOIN l USING (c) WHERE turn IS NULL OR last IS NULL OR turn < last
      UNION ALL SELECT l.c || '-', coalesce(last, top + 1, 0), 'assistant', coalesce(text, '') FROM l LEFT JOIN a ON a.c = xor(l.c, 1)),
p AS (SELECT c AS pair_id, c || '+' AS chosen, c || '-' AS rejected FROM l),
m AS (SELECT pair_id, turn, role, text, bool_or(conv_id = chosen) AS c, bool_or(conv_id = rejected) AS r FROM t JOIN p ON conv_id IN (chosen, rejected) GROUP BY ALL),
f AS (SELECT *, count(*) FILTER (NOT (c AND r)) OVER (PARTITION BY pair_id ORDER BY turn, role, text) = 0 AS in_prompt FROM m),
d AS (SELECT pair_id, 'prompt' AS part, turn, role, text FROM f WHERE in_prompt UNION ALL SELECT pair_id, 'chosen', turn, role, text FROM f WHERE NOT in_prompt AND c
      UNION ALL SELECT pair_id, 'rejected', turn, role, text FROM f WHERE NOT in_prompt AND r),
s AS (SELECT *, '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS rendered FROM d),
o AS (SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)
SELECT pair_id, part, turn, role, rendered, start, CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(role) + 5 END AS mask_start,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(rendered) - 1 END AS mask_end FROM o
"""
