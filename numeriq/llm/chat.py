"""Chat formatting by event-sourced reconstruction.

A log of events (conversation, sequence number, message, kind, role, text) is partitioned by conversation and sorted by sequence; a fold over
it rebuilds the final messages, which are then rendered with a template, with a mask of the spans that carry loss.

Kinds:

    start    opens a message and replaces whatever it held, so a second start is a regeneration
    delta    appends to it (and opens one that wasn't opened)
    edit     replaces its text
    delete   removes it
    rewind   undoes the message's first event and all events of the conversation since then, of whatever message: an abandoned branch

The fold is windows over the conversation in sequence, native and spilling, so a conversation may be of any length; what an aggregate holds
is one message's pieces. A message's place is that of its first event that wasn't undone, its role the last one given.

Nulls: role and text count as empty, a sequence number as 0, a kind as delta; an event without conversation or message forms the null
conversation or message, which is kept as such. Events of one sequence number are ordered by message, kind, role and text, so that ties and
repeated rows give one result. An empty log gives no rows. Columns besides those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_back, lean, table

OPEN, MID, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: str) -> str:
    """Breaks every control string of bracket style, reversibly: a backslash follows each backslash, < and [."""
    return re.sub(r"([\\<\[])", r"\1\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([\\<\[])\\", r"\1", text)


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, position, msg_id, role, text) of messages that survive the fold."""
    e = lean(events).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.col("msg_id").cast("long").alias("msg_id"),
        F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    conversation, message = Window.partitionBy("conv_id"), Window.partitionBy("conv_id", "msg_id")
    e = e.withColumn("place", F.row_number().over(conversation.orderBy("seq", "msg_id", "kind", "role", "text"))).drop("seq")
    opened = F.min(F.when(F.col("kind") != "rewind", F.col("place"))).over(message)
    later = conversation.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    undone_from = F.min(F.when(F.col("kind") == "rewind", F.col("opened"))).over(later)
    e = e.withColumn("opened", opened).withColumn("undone", F.coalesce(undone_from <= F.col("place"), F.lit(False))).filter("NOT undone AND kind <> 'rewind'")
    replaced = F.max(F.when(F.col("kind").isin("start", "edit", "delete"), F.col("place"))).over(message)
    e = e.withColumns({"position": F.min("place").over(message), "role": F.coalesce(F.max_by("role", F.when(F.col("role") != "", F.col("place"))).over(message), F.lit("")), "replaced": replaced})
    kept = e.filter("kind <> 'delete' AND place >= coalesce(replaced, 0)")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return kept.groupBy("conv_id", "msg_id", "position", "role").agg(F.array_join(pieces, "").alias("text")).select("conv_id", "position", "msg_id", "role", "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One segment per message; the formatted conversation is its segments in order of position. Native: no Python.

    loss_start and loss_end are the code points of the segment under the loss mask (equal where none are).
    """

    def esc(c):
        return F.regexp_replace(c, r"([\\<\[])", r"$1\\")

    body = esc(F.col("text"))
    head = F.concat(F.lit(OPEN), esc(F.col("role")), F.lit(MID))
    start = F.length(head)
    return messages.select(
        "conv_id", "position", "msg_id", "role",
        F.concat(head, body, F.lit(CLOSE)).alias("segment"),
        start.cast("long").alias("loss_start"),
        F.when(F.col("role") == loss_role, start + F.length(body)).otherwise(start).cast("long").alias("loss_end"),
    )


def read_back(segments: DataFrame) -> DataFrame:
    """Parses formatted conversations: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Tasks stream through segments sorted by conversation and position and hold only the running digests.
    """

    def parsed(batches: Iterator) -> Iterator:
        import pandas as pd

        pattern = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(MID) + r"(.*?)" + re.escape(CLOSE), re.S)
        state, out = None, []

        def close(s):
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

        for pdf in batches:
            for conv, seg, a, b in zip(pdf["conv_id"], pdf["segment"], pdf["loss_start"], pdf["loss_end"]):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(close(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                m = pattern.fullmatch(seg)
                role, text = unescape(m[1]), unescape(m[2])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(seg[a:b])
                state[3] += len(masked)
                state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(seg)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if state is not None:
            yield pd.DataFrame([close(state)], columns=columns)

    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    dealt = segments.withColumn("conv_id", F.col("conv_id").cast("string")).repartition("conv_id").sortWithinPartitions("conv_id", "position", "msg_id")
    return id_back(dealt.select("conv_id", "segment", "loss_start", "loss_end").mapInPandas(parsed, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"), "conv_id")


def turn_events(conversations: DataFrame, delta_chars: int = 512) -> DataFrame:
    """A table of turns as the log that would have made it. Each row is a message, in order of turn (null: -1), role and text; it is opened and
    streamed by deltas. By hash, some are regenerated after a first draft, some streamed in a wrong form and then edited, and some are
    followed by another message that is deleted, or by a branch of two that is rewound.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id")
    c = c.withColumn("msg_id", F.row_number().over(in_order.orderBy("turn", "role", "text")).cast("long") * 4)
    c = c.withColumn("lot", F.pmod(F.xxhash64("turn", "role", "text"), F.lit(8)))
    edited, text, role = F.col("lot") == 3, F.col("text"), F.col("role")
    streamed = F.when(edited, F.reverse(F.substring("text", 1, 100))).otherwise(text)

    def event(phase: int, part, extra: int, kind, who, what):
        return F.struct(F.lit(phase).alias("phase"), part.alias("part"), (F.col("msg_id") + extra).alias("msg_id"), kind.alias("kind"), who.alias("role"), what.alias("text"))

    def only(lots, *events):
        return F.when(F.col("lot").isin(*lots), F.array(*events)).otherwise(F.array().cast("array<struct<phase:int,part:int,msg_id:bigint,kind:string,role:string,text:string>>"))

    one, two, none, lit = F.lit(0), F.lit(1), F.lit(""), F.lit
    parts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length(streamed) / delta_chars)).cast("int") - 1)
    stream = F.transform(parts, lambda i: event(1, i, 0, F.when(i == 0, "start").otherwise("delta"), role, F.substring(streamed, i * delta_chars + 1, F.lit(delta_chars))))
    events = F.concat(
        only((0, 1, 2), event(0, one, 0, lit("start"), role, F.substring("text", 3, 40)), event(0, two, 0, lit("delta"), role, lit("..."))),
        stream,
        only((3,), event(2, one, 0, lit("edit"), none, text)),
        only((4,), event(3, one, 1, lit("start"), lit("user"), lit("never mind")), event(3, two, 1, lit("delete"), none, none)),
        only((5,), event(4, one, 2, lit("start"), lit("user"), F.substring("text", 1, 30)), event(4, two, 3, lit("start"), lit("assistant"), lit("no")), event(5, one, 2, lit("rewind"), none, none)),
    )
    log = c.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")
    seq = F.row_number().over(in_order.orderBy(F.floor(F.col("msg_id") / 4), "phase", "part")).cast("long")
    return log.select("conv_id", seq.alias("seq"), "msg_id", "kind", "role", "text")


def format_conversations(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    return render(final_messages(events), loss_role)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations and of conversation -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_conversations(turn_events(turns)))
