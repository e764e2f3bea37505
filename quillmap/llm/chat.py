"""Multi-party chat formatting with perspective rotation: every participant in turn is the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns that one rendered row covers at most, by their number; a longer dialogue goes on in the next segment.
SEGMENT_TURNS = 64
SYSTEM = "system"


def rotate(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    r"""Render each dialogue once for every participant, with that speaker as assistant and the others as named users.

    Returns conv_col, participant, segment, continued, n_messages, n_trained, text, spans. A message is rendered as
    `<|assistant|>\n{text}<|end|>\n`, `<|user:{name}|>\n{text}<|end|>\n` or, for the role "system", which is no
    participant, `<|system|>\n{text}<|end|>\n`. spans are the code-point ranges [start, end) of text to train on: the
    participant's words and end marks. The segment is turn div segment_turns: a dialogue goes on in the next row there
    and nothing is lost, so the turns that meet in a task are bounded, while a dialogue of any length spreads out. A
    later segment is `continued` and opens with the dialogue's first system message, as context that is neither counted
    nor trained on. A segment in which a participant says nothing is rendered too, with no spans.

    Messages are ordered by turn, then role, then text; repeated messages are all rendered. A null turn counts as 0, a
    null text as empty, a null role as "unknown"; each message with a null conversation is a dialogue of its own. A
    dialogue of system messages only has no participant and gives no row; an empty table gives none.
    """
    said = messages.select(
        F.col(conv_col).alias("conv"), F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("lone"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    said = said.withColumn("segment", F.floor(F.col("turn") / F.lit(segment_turns)).cast("long"))
    message = F.struct("turn", "role", "text")
    parts = said.groupBy("conv", "lone", "segment").agg(F.array_sort(F.collect_list(message)).alias("said"))
    system = F.col("role") == SYSTEM
    whole = said.groupBy(F.col("conv").alias("conv_"), F.col("lone").alias("lone_")).agg(
        F.collect_set(F.when(~system, F.col("role"))).alias("speakers"), F.min(F.when(system, message)).alias("context"), F.min("segment").alias("first"), F.min(F.when(system, F.col("segment"))).alias("told")
    )
    both = parts.join(whole, F.col("conv").eqNullSafe(F.col("conv_")) & F.col("lone").eqNullSafe(F.col("lone_")))
    carried = F.when(F.col("told") < F.col("segment"), F.concat(F.array("context"), "said")).otherwise(F.col("said"))
    rows = both.select("conv", "segment", (F.col("segment") > F.col("first")).alias("continued"), F.size("said").cast("long").alias("n_messages"), carried.alias("said"), F.explode("speakers").alias("participant"))
    mine = F.col("participant")

    def head(m):
        return F.when(m["role"] == SYSTEM, "<|system|>\n").when(m["role"] == mine, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user:"), m["role"], F.lit("|>\n")))

    tail = F.lit("<|end|>\n")
    parts = F.transform("said", lambda m: F.struct(head(m).alias("head"), F.concat(m["text"], tail).alias("body"), (m["role"] == mine).alias("own")))
    rows = rows.select("conv", "participant", "segment", "continued", "n_messages", parts.alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        # The line break after the end mark is not trained on.
        spans = F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), (end - 1).alias("end"))))).otherwise(acc["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    return rows.select(
        F.col("conv").alias(conv_col), "participant", "segment", "continued", "n_messages",
        F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.aggregate("parts", start, step, lambda acc: acc["spans"]).alias("spans"),
    )
