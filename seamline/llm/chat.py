"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events is partitioned by conversation and sorted by sequence number; each message is folded from its last
reset (a whole message, an edit or a regeneration) and the deltas after it, and what a regeneration makes obsolete is
dropped. Messages are rendered in segments of a bounded number of turns, so that a conversation that holds a third of
all rows is formatted by many tasks; its text is the concatenation of its segments.

Template: ``<|im_start|>role LF text<|im_end|> LF``. In texts and roles ``\\`` becomes ``\\\\`` and ``<|`` becomes
``<\\|``, so that no control string can occur in them; a line feed in a role becomes the control string ``<|lf|>``.

Null texts and roles are empty, null turns come first, null ids are one conversation, repeated rows are turns of their
own. Very long texts are read whole. Only the named columns are read. An empty table gives an empty result (the query
adds its own conversation). The query's digests are of whole conversations, so its last step holds one conversation's
text at a time; folding and formatting don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END, LF = "<|im_start|>", "<|im_end|>\n", "<|lf|>"
SEGMENT_TURNS = 32
RESETS = ("message", "edit", "regenerate")
EXTRA = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LF))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LF), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of events (conv_id, turn, part, seq, kind, role, text).

    ``part`` tells apart messages of the same turn. kind: message, edit and regenerate set the text (null: empty),
    delta appends to it, delete removes the message unless a reset follows. A regeneration also drops the later turns
    that were last written before it. Events of equal seq are folded in order of kind and text; unknown kinds are
    ignored; a message without a reset starts empty. The role is that of the last event that names one.
    """
    key = ["conv_id", "turn", "part"]
    known = events.where(F.col("kind").isin(*RESETS, "delta", "delete")).withColumn(
        "text", F.coalesce("text", F.lit(""))
    )
    of = Window.partitionBy(*key)
    reset = F.max(F.when(F.col("kind").isin(*RESETS, "delete"), F.struct("seq", "kind", "text"))).over(of)
    live = known.withColumn("reset", reset).withColumn("me", F.struct("seq", "kind", "text"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("reset").isNull() | (F.col("me") >= F.col("reset")), F.col("me"))))
    folded = live.groupBy(*key).agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "text"))).alias("role"),
        F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"),
        F.max("reset.kind").alias("last_kind"),
        F.max("seq").alias("last_seq"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("regenerated"),
    )
    # The newest regeneration before a turn: over earlier blocks of turns, then within the block.
    folded = folded.withColumn("block", F.floor(F.col("turn") / SEGMENT_TURNS))
    blocks = folded.groupBy("conv_id", "block").agg(F.max(F.when(F.col("block").isNotNull(), F.col("regenerated"))).alias("r"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.max("r").over(before).alias("newest"))
    earlier = Window.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    # By conversation and block, so that a long conversation is spread over its blocks.
    seen = folded.withColumn("in_block", F.max("regenerated").over(earlier)).join(
        upto, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left"
    )
    newest = F.greatest(F.coalesce("in_block", F.lit(-(1 << 63))), F.coalesce("newest", F.lit(-(1 << 63))))
    return seen.where(~(newest > F.coalesce("last_seq", F.lit(-(1 << 63))))).where(
        F.coalesce("last_kind", F.lit("")) != "delete"
    ).select(*key, F.coalesce("role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame, segment_turns: int = SEGMENT_TURNS, learn: str = "assistant") -> DataFrame:
    """(conv_id, segment, n_turns, formatted, loss_spans) of folded messages; spans are code points of ``formatted``.

    A conversation's text is its segments' in order. Null ids and turns are allowed; a null turn comes first.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", "part", "role", "text")))
    rows = messages.groupBy("conv_id", F.floor(F.col("turn") / segment_turns).alias("segment")).agg(turns.alias("turns"))
    drawn = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == learn).alias("learn"),
        ),
    )
    rows = rows.withColumn("drawn", drawn)
    at = F.aggregate(
        "drawn",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(
                t["learn"],
                F.concat(
                    s["spans"],
                    F.array(
                        F.struct(
                            (s["at"] + F.length(t["head"])).alias("start"),
                            (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
        lambda s: s["spans"],
    )
    whole = F.array_join(F.transform("drawn", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return rows.select("conv_id", "segment", F.size("turns").alias("n_turns"), whole.alias("formatted"), at.alias("loss_spans"))


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, segment, turns, loss) parsed from ``formatted`` and ``loss_spans`` alone."""
    parts = F.filter(F.split(F.col("formatted"), r"<\|im_end\|>\n"), lambda p: p != "")
    turn = F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )
    loss = F.transform(
        "loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    )
    return segments.select("conv_id", "segment", turn.alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars"))


def events_of(conversations: DataFrame) -> DataFrame:
    """Stored conversations as a log: each row is a message event; rows of equal turn are told apart."""
    tie = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.row_number().over(tie).alias("part"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("seq"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(EXTRA).alias("text"),
    )
    read = read_back(render(fold(events_of(rows.unionByName(extra)))))
    digest = read.select(
        "conv_id",
        "segment",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("loss", "").alias("learnt"),
        "chars",
    )
    whole = digest.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("segment", "said", "learnt"))).alias("s"),
    )
    said = F.array_join(F.transform("s", lambda x: x["said"]), "")
    return whole.withColumn("learnt", F.array_join(F.transform("s", lambda x: x["learnt"]), "")).select(
        "conv_id",
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP8_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{EXTRA}' UNION ALL SELECT -1, 1, 'assistant', '{EXTRA}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(START) + 1 + len(END)} + length(role) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')))::BIGINT
         AS formatted_chars
FROM c GROUP BY conv_id
"""
