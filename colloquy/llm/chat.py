"""Chat formatting from event logs.

Events (conversation, sequence, message, kind, role, text) are dealt out by conversation, sorted by message and
sequence, and folded as they stream by: a message's deltas are joined in sequence order, an edit replaces
what came before it, and a regeneration begins the message anew and takes away the messages after it
that were said before. What is remembered is one message's parts and one sequence number, so memory
does not grow with the conversation, and texts are shuffled once.

Messages are rendered each as one segment: ``<|role|>`` and a newline, the text, ``<|end|>`` and a
newline. What could read as a control string is escaped in texts and
roles, reversibly: ``&`` becomes ``&amp;``, ``<`` becomes ``&lt;`` and, in roles, ``|`` becomes ``&bar;``. A segment carries the span of its
text under the loss mask (assistant messages only). Formatted conversations are gzip files of JSON lines, a segment a
line in order. Such a file is read by one task from its start, so conversations come back whole and in order without a
shuffle; one of any length is never one string.

Defined cases of the fold: a null text is empty; a null role is an empty role; null conversations are one; null messages
and sequences come first; events of one message with the same sequence number are one event delivered again (the
first by kind, edits and regenerations before deltas, then text, stands), while those without a number are events each;
unknown kinds are deltas; a message left without any event is none. An empty log gives no messages.
Of the table of turns: null conversation ids are one conversation, sorted first; rows that repeat (conversation, turn)
are messages each, ordered by turn, then role and text; null turns come first; an empty table gives none but the added conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import broadcast_if_small, materialise, new_path, prepare

SEGMENT = regex.compile(r"<\|(?P<role>[^<|]*)\|>\n(?P<text>[^<]*)<\|end\|>\n")
TRAINED = "assistant"
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"
#: Rows of an output batch.
ROWS = 1000


def fold_events(events: DataFrame) -> DataFrame:
    """(conv, pos, role, text): final messages of ``events`` (conv, seq, message, kind, role, text), numbered from 0 in order.

    ``message``, of any type that sorts, orders a conversation's messages, and the number ``seq`` its events. An edit or
    regeneration carries the text that it begins with (deltas may follow it). A regeneration of a message removes the
    events of later messages that have a smaller sequence number. Rows come out in order, a conversation in one partition.
    """
    prepare(events.sparkSession)
    later = F.when(F.col("kind").isin(EDIT, REGENERATE), 0).otherwise(1).alias("later")
    rows = events.select("conv", "seq", "message", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), later)
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "message", "seq", "later", "kind", "text").drop("later")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pos, cut = None, 0, None  # of the conversation; cut: the largest number of a regeneration in earlier messages
        message, parts, who, last, again, begun = None, [], "", None, None, False
        done, held, layout = [], 0, None
        for batch in batches:
            layout = layout or pa.schema([("conv", batch.schema.field("conv").type), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string())])
            for conv, seq, own, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "seq", "message", "kind", "role", "text")), strict=True):
                if not begun or conv != key or own != message:
                    if parts:
                        done.append({"conv": key, "pos": pos, "role": who, "text": "".join(parts)})
                        held, pos = held + len(done[-1]["text"]), pos + 1
                    cut = again if cut is None else cut if again is None else max(cut, again)
                    if not begun or conv != key:
                        key, pos, cut, begun = conv, 0, None, True
                    message, parts, last, again = own, [], None, None
                if seq is not None:
                    if kind == REGENERATE:
                        again = seq if again is None else max(again, seq)
                    if seq == last or (cut is not None and seq < cut):
                        continue
                    last = seq
                if kind in (EDIT, REGENERATE):
                    parts = []
                parts.append(text)
                who = role
            if len(done) >= ROWS or held >= ROWS << 12:
                yield pa.RecordBatch.from_pylist(done, schema=layout)
                done, held = [], 0
        if parts:
            done.append({"conv": key, "pos": pos, "role": who, "text": "".join(parts)})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=layout)

    return ordered.mapInArrow(run, f"conv {events.schema['conv'].dataType.simpleString()}, pos long, role string, text string")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: str) -> str:
    return text.replace("&bar;", "|").replace("&lt;", "<").replace("&amp;", "&")


def segments(messages: DataFrame) -> DataFrame:
    """(conv, pos, segment, loss_from, loss_to): one rendered message a row; the loss span counts code points in it."""
    role, body = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("<|"), F.replace(role, F.lit("|"), F.lit("&bar;")), F.lit("|>\n"))
    start = F.char_length(head)
    trained = F.col("role").eqNullSafe(TRAINED)
    return messages.select("conv", "pos", F.concat(head, body, F.lit("<|end|>\n")).alias("segment"), F.when(trained, start).alias("loss_from"), F.when(trained, start + F.char_length(body)).alias("loss_to"))


def write_formatted(messages: DataFrame, path: str) -> None:
    """``messages`` (as fold_events gives them) as segments; no shuffle, so each conversation is whole in one file and in order."""
    segments(messages).write.option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def read_formatted(spark, path: str, conv: str = "long") -> DataFrame:
    """Digests of each conversation, parsed from its segments as they stream by: see ``op8_chat``. ``conv``: the type of the ids."""
    prepare(spark)
    stored = spark.read.schema(f"conv {conv}, pos long, segment string, loss_from int, loss_to int").json(path)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, loss, n, chars, length, begun = None, None, None, 0, 0, 0, False
        done, layout = [], None
        for batch in batches:
            layout = layout or pa.schema([("conv_id", batch.schema.field("conv").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            for own, pos, segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv", "pos", "segment", "loss_from", "loss_to")), strict=True):
                if not begun or own != key or pos == 0:
                    if begun:
                        done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), length))
                    key, turns, loss, n, chars, length, begun = own, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
                if pos != n:
                    raise ValueError(f"segment {pos} of a conversation came where {n} was due")
                parsed = SEGMENT.fullmatch(segment)
                turns.update(f"{unescape(parsed['role'])}\n{unescape(parsed['text'])}\n".encode())
                if a is not None:
                    span = unescape(segment[a:b])
                    chars += len(span)
                    loss.update(span.encode())
                n, length = n + 1, length + len(segment)
            if len(done) > ROWS:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=layout)
                done = []
        if begun:
            done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), length))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=layout)

    return stored.mapInArrow(run, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Numbers that a turn's events may take; turns beyond this bound get events without numbers.
STEPS, TURNS = 16, 1 << 58


def as_events(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """A table of turns as the log that would have led to it; folding it must give the turns back.

    By turn modulo 3: a reply in three deltas, the second delivered twice; a draft that an edit replaces, then a delta; a reply
    and a following message that a regeneration takes away, then the rest. Rows that repeat a turn, and turns without a
    usable number, are one delta without a sequence number each, in the order of role and text.
    """
    turn, text = F.col("turn"), F.col("text")
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    twice = materialise(rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv").alias("c"), F.col("turn").alias("t")), "repeated-turns")
    rows = rows.join(broadcast_if_small(twice), F.col("conv").eqNullSafe(F.col("c")) & turn.eqNullSafe(F.col("t")), "left").withColumn("again", F.coalesce(F.col("c").isNotNull() | F.col("t").isNotNull(), F.lit(False))).drop("c", "t")
    plain = F.col("again") | turn.isNull() | (turn >= TURNS) | (turn <= -TURNS)
    third, two_thirds = F.floor(F.char_length(text) / 3).cast("int"), F.floor(F.char_length(text) * 2 / 3).cast("int")
    a, b, c = F.substring(text, F.lit(1), third), F.substring(text, third + 1, two_thirds - third), F.substring(text, two_thirds + 1, F.char_length(text))
    draft = F.concat(F.reverse(F.left(text, F.lit(12))), F.lit("~"))
    event = lambda step, kind, part, sub=0: F.struct(F.lit(step).alias("step"), F.lit(sub).alias("sub"), F.lit(kind).alias("kind"), part.alias("part"))
    streamed = F.array(event(2, DELTA, c), event(1, DELTA, b), event(0, DELTA, a), event(1, DELTA, b))
    edited = F.array(event(2, DELTA, c), event(0, DELTA, draft), event(1, EDIT, F.concat(a, b)))
    renewed = F.array(event(0, DELTA, draft), event(1, DELTA, draft), event(2, DELTA, draft, 1), event(3, REGENERATE, a), event(4, DELTA, F.concat(b, c)))
    log = F.when(plain, F.array(event(0, DELTA, text))).when(F.pmod(turn, F.lit(3)) == 0, streamed).when(F.pmod(turn, F.lit(3)) == 1, edited).otherwise(renewed)
    rows = rows.select("conv", "turn", "role", plain.alias("plain"), F.when(plain, text).alias("whole"), F.when(plain, F.monotonically_increasing_id()).alias("number"), F.explode(log).alias("e"))
    message = F.struct("turn", F.col("e.sub").alias("sub"), F.when(F.col("plain"), F.col("role")).alias("by"), "whole", "number")
    seq = F.when(~F.col("plain"), F.col("turn") * STEPS + F.col("e.step"))
    return rows.select("conv", seq.alias("seq"), message.alias("message"), F.col("e.kind").alias("kind"), "role", F.col("e.part").alias("text"))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """One row per conversation, read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    who = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), who.alias("role"), F.lit(odd).alias("text"))
    path = new_path(spark, "chat")
    write_formatted(fold_events(as_events(rows.unionByName(extra))), path)
    return read_formatted(spark, path)


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(13 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '|', '&bar;'))
                + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
