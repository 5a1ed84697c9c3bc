"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is rendered once as
prompt, the rest of both as a pair of masked completions.

Conversations are compared turn by turn through digests (pair, turn, digest), so no task ever holds a conversation: the
first turn at which they differ, or at which one has none, is a minimum over the joined digests. Texts are read where
they are rendered and do not move unless the table of first differences is too large to broadcast.

One row per rendered turn: part ('prompt', 'chosen' or 'rejected'), turn, role, rendered, and loss_from: the character
of ``rendered`` from which on the loss counts (the reply and its end mark, assistant turns of completions only), else
-1. ``assembled`` joins the turns of a pair into one row.

Defined results: null text is empty and a null role is 'user'; rows without a conversation are left out, and a null turn
stands after all others, as does one that is no 64-bit number; rows that repeat a turn of a conversation count once, and of different rows with one turn the
smallest by (role, text) speaks; equal conversations have a prompt and no completions; marks inside texts are broken up by a blank;
an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import pick, query, small, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LAST_TURN = (1 << 63) - 1
RANGE_ROWS = 500_000  # conversations in one range, about


def digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("\n", role, text))


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with one row a turn."""
    rows = pick(df, conv=conv, turn=turn, role=role, text=text).where(F.col("conv").isNotNull()).select(
        "conv", F.coalesce(F.col("turn").cast("long"), F.lit(LAST_TURN)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    repeated = written(rows.groupBy("conv", "turn").count().where("count > 1").select("conv", "turn"), "chat-repeated")
    single = rows.join(small(repeated), ["conv", "turn"], "left_anti")
    several = rows.join(small(repeated), ["conv", "turn"], "left_semi").groupBy("conv", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    return single.unionByName(several.select("conv", "turn", "m.role", "m.text"))


def rendered(df: DataFrame, part: Column, completion: Column) -> DataFrame:
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"))
    body = F.replace(F.col("text"), F.lit("<|im_"), F.lit("<| im_"))
    return df.select("pair", part.alias("part"), "turn", "role", F.concat(head, body, F.lit(CLOSE + "\n")).alias("rendered"),
                     F.when(completion & (F.col("role") == "assistant"), F.char_length(head)).otherwise(-1).cast("int").alias("loss_from"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both (pair, turn, role, text) with one row a turn -> pair, part, turn, role, rendered, loss_from."""
    marks = lambda df, d: df.select("pair", "turn", digest(F.col("role"), F.col("text")).alias(d))
    both = marks(chosen, "c").join(marks(rejected, "r"), ["pair", "turn"], "full_outer")
    cuts = both.groupBy("pair").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("cut"))
    cuts = small(written(cuts, "chat-cuts"))
    later = F.coalesce(F.col("turn") >= F.col("cut"), F.lit(False))  # no cut: equal throughout
    first = rendered(chosen.join(cuts, "pair"), F.when(later, "chosen").otherwise("prompt"), later)
    second = rendered(rejected.join(cuts, "pair").where(later), F.lit("rejected"), F.lit(True))
    return first.unionByName(second)


def assembled(rows: DataFrame) -> DataFrame:
    """pair, prompt, chosen, rejected and the completions' loss spans (start, end in characters). Joins all turns of a
    conversation, so it is for conversations that fit a training example."""
    one = rows.groupBy("pair", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "rendered", "loss_from"))).alias("t"))
    empty = "named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))"
    spans = F.expr(f"""aggregate(t, {empty}, (s, x) -> named_struct('at', s.at + char_length(x.rendered), 'spans',
        if(x.loss_from < 0, s.spans, concat(s.spans, array(named_struct('start', s.at + x.loss_from, 'end', s.at + char_length(x.rendered)))))), s -> s.spans)""")
    one = one.select("pair", "part", F.array_join(F.col("t.rendered"), "").alias("text"), spans.alias("spans"))
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    return one.groupBy("pair").agg(*[F.coalesce(of(p, "text"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")],
                                   *[of(p, "spans").alias(f"{p}_loss") for p in ("chosen", "rejected")])


def followed(last: DataFrame, ranges: int | None = None) -> DataFrame:
    """(conv, last) -> conv, last, next: the conversation that follows in ascending order, the first one for the last. Conversations
    are dealt into ranges, each range knows the one after its end by the first of the next range, so no task holds all."""
    n = ranges or -(-last.count() // RANGE_ROWS) or 1
    rows = written(last.repartitionByRange(n, "conv").withColumn("part", F.spark_partition_id()), "chat-ranges") if n > 1 else last.withColumn("part", F.lit(0))
    heads = rows.groupBy("part").agg(F.min("conv").alias("head"))  # a row a range
    order = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.min("head").over(Window.partitionBy(F.lit(1)))).alias("after"))
    own = Window.partitionBy("part").orderBy("conv")
    return rows.withColumn("_next", F.lead("conv").over(own)).join(F.broadcast(heads), "part").select(
        "conv", "last", F.coalesce("_next", "after").alias("next"))


def swapped_replies(rows: DataFrame, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs for a table that has none: a conversation up to its last reply is chosen; the same with the last reply of the
    next conversation that has one (in ascending order, the last takes the first's) is rejected. Every conversation with a
    reply makes a pair; if there is only one, both sides are its own and equal."""
    last = rows.where(F.col("role") == "assistant").groupBy("conv").agg(F.max("turn").alias("last"))
    last = written(followed(written(last, "chat-last"), ranges), "chat-next")
    reply = rows.join(small(last.select("conv", "last")), "conv").where(F.col("turn") == F.col("last"))
    other = reply.select(F.col("conv").alias("next"), F.lit("assistant").alias("role"), "text")
    own = rows.join(small(last.select("conv", "last")), "conv")
    chosen = own.where(F.col("turn") <= F.col("last")).select(F.col("conv").alias("pair"), "turn", "role", "text")
    before = own.where(F.col("turn") < F.col("last")).select(F.col("conv").alias("pair"), "turn", "role", "text")
    swapped = other.join(small(last), "next").select(F.col("conv").alias("pair"), F.col("last").alias("turn"), "role", "text")
    return chosen, before.unionByName(swapped)


ORACLE = r"""
WITH t AS (SELECT conv_id AS pair, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
l AS (SELECT pair, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY pair),
p AS (SELECT pair, last, coalesce(lead(pair) OVER (ORDER BY pair), min(pair) OVER ()) AS next FROM l),
c AS (SELECT t.* FROM t JOIN p USING (pair) WHERE turn <= last),
r AS (SELECT t.* FROM t JOIN p USING (pair) WHERE turn < last
      UNION ALL SELECT p.pair, p.last, 'assistant', t.text FROM p JOIN l o ON o.pair = p.next JOIN t ON t.pair = o.pair AND t.turn = o.last),
d AS (SELECT coalesce(c.pair, r.pair) AS pair,
             min(CASE WHEN c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text THEN coalesce(c.turn, r.turn) END) AS cut
      FROM c FULL JOIN r ON c.pair = r.pair AND c.turn = r.turn GROUP BY 1),
u AS (SELECT pair, CASE WHEN turn >= cut THEN 'chosen' ELSE 'prompt' END AS part, turn, role, text, coalesce(turn >= cut, false) AS later FROM c JOIN d USING (pair)
      UNION ALL SELECT pair, 'rejected', turn, role, text, true FROM r JOIN d USING (pair) WHERE turn >= cut)
SELECT pair, part, turn, role,
       '<|im_start|>' || role || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS rendered,
       CAST(CASE WHEN later AND role = 'assistant' THEN length('<|im_start|>' || role) + 1 ELSE -1 END AS INTEGER) AS loss_from FROM u
"""


@query("op7_preference_format", ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))
    return format_preferences(*swapped_replies(rows))
