"""Chat formatting from event logs (operator 4).

A log holds the events of conversations: ``conv_id, seq, kind, ref, role, text``.

* ``message`` opens a message (its ``seq`` is the message's name) with a role;
* ``delta`` appends text to message ``ref``;
* ``edit`` sets the text of message ``ref`` and discards the messages opened
  after it and before the edit;
* ``regenerate`` discards message ``ref`` and every message opened after it and
  before the event; what follows replaces them.

The log is partitioned by conversation and sorted by sequence once.  A window
finds, for each event, the earliest message that a later event goes back to;
what is discarded is dropped there.  Then one streaming fold over the sorted
rows builds each final message and renders it as one row, so the memory of a
task is one message, not one conversation.

Rendering marks turns with control strings and escapes control strings inside
texts: a backslash is doubled, and a backslash goes behind the first character
of each control string.  Reading back undoes exactly that.

Defined results: null texts are empty and null roles are the empty role; rows
of a null conversation form one conversation; events at one ``seq`` are taken in
the order message, edit, regenerate, delta, then by role and text; repeated
rows of a table are turns of their own; deltas of a message that was never opened are
dropped; an empty table gives the added conversation alone; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ciphersift.llm.common import table

OPEN, MIDDLE, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this template and of common chat models.
CONTROL = (OPEN, MIDDLE, CLOSE, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]",
           "<<SYS>>", "<</SYS>>")
AT_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)
ASSISTANT = "assistant"
KINDS = ("message", "edit", "regenerate", "delta")
EVENTS = "conv_id bigint, seq bigint, kind string, ref bigint, role string, text string"


def escape(text: str) -> str:
    return AT_CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undo :func:`escape`: a backslash stands for the character behind it, so a doubled one is one."""
    return ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's markup and the bounds of its text in code points."""
    head = f"{OPEN}{escape(role)}{MIDDLE}"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def read_turn(markup: str) -> tuple[str, str]:
    """Role and text of a rendered turn; control strings cannot stand inside either."""
    if not (markup.startswith(OPEN) and markup.endswith(CLOSE)):
        raise ValueError("not a rendered turn")
    role, _, text = markup[len(OPEN):-len(CLOSE)].partition(MIDDLE)
    return unescape(role), unescape(text)


def surviving(events: DataFrame) -> DataFrame:
    """Events of messages that no later edit or regeneration discarded; ``ref`` names the message of each."""
    own = F.when(F.col("kind") == "message", F.col("seq")).otherwise(F.col("ref"))
    back = F.when(F.col("kind") == "regenerate", F.col("ref")).when(F.col("kind") == "edit", F.col("ref") + 1)
    later = (Window.partitionBy("conv_id").orderBy(F.col("seq").desc())
             .rangeBetween(Window.unboundedPreceding, -1))
    marked = (events.withColumn("ref", own).withColumn("back", back)
              .withColumn("back", F.min("back").over(later)))
    # an event is gone when a later event went back to its message or before it
    # (an edit counts from the message after its own)
    return marked.filter(F.col("kind") != "regenerate").filter(
        F.col("back").isNull() | (F.col("ref") < F.col("back"))).drop("back")


def fold_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, message and sequence to one rendered turn per message."""
    current, role, parts, turn, conv, rows = None, None, [], 0, None, []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[], [], [], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        names = ["conv_id", "turn", "role", "formatted", "text_start", "text_end"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def close() -> None:
        nonlocal turn, conv
        if current is None or role is None:
            return
        turn = turn + 1 if conv == (current[0],) else 0
        conv = (current[0],)
        markup, start, end = render_turn(role, "".join(parts))
        rows.append((current[0], turn, role, markup, start, end))

    for batch in batches:
        for conv_id, ref, kind, who, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv_id, ref) != current:
                close()
                current, role, parts = (conv_id, ref), None, []
            if kind == "message":
                if role is not None:  # a second message at one seq is a turn of its own
                    close()
                    parts = []
                role = who or ""
            elif kind == "edit":
                parts = [text or ""]
            else:
                parts.append(text or "")
        if rows:
            yield flush()
            rows.clear()
    close()
    if rows:
        yield flush()


def format_events(events: DataFrame) -> DataFrame:
    """One row per final turn, in order within a partition: its markup and where its text stands in it.

    (conv_id, turn, role, formatted, text_start, text_end); a conversation is the concatenation of its turns,
    all in one partition.  The loss mask is the text bounds of the assistant's turns.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    rows = (surviving(events.select("conv_id", "seq", "kind", "ref", "role", "text"))
            .repartition("conv_id")
            .sortWithinPartitions("conv_id", "ref", "seq", order)
            .select("conv_id", "ref", "kind", "role", "text"))
    return rows.mapInArrow(fold_messages, "conv_id bigint, turn bigint, role string, formatted string, "
                                          "text_start bigint, text_end bigint")


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, from its rendered turns alone; hashes run along, nothing is gathered."""
    state, done = None, []

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        cols = list(zip(*((c, n, t.hexdigest(), lc, lh.hexdigest(), f) for c, n, t, lc, lh, f in done)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for batch in batches:
        for conv_id, markup, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or state[0] != conv_id:
                if state is not None:
                    done.append(state)
                state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_turn(markup)
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            if role == ASSISTANT:
                learnt = unescape(markup[start:end])
                state[3] += len(learnt)
                state[4].update(learnt.encode())
            state[5] += len(markup)
        if done:
            yield flush()
            done.clear()
    if state is not None:
        done.append(state)
        yield flush()


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, what its rendered turns say; ``turns`` as :func:`format_events` gives them."""
    return turns.select("conv_id", "formatted", "text_start", "text_end").mapInArrow(
        read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                   "formatted_chars bigint")


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """The event log of a table of finished turns: each turn opens a message and streams its text as a delta.

    Turns are numbered by (turn, role, text) within a conversation, so repeated turn numbers stay apart.
    """
    c = conversations.select(*[F.col(x) for x in ("conv_id", "turn", "role", "text")])
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    seq = (F.row_number().over(w) * 2).cast("bigint")
    return c.withColumn("seq", seq).select("conv_id", F.inline(F.array(
        F.struct(F.col("seq").alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("bigint").alias("ref"),
                 F.col("role").alias("role"), F.lit(None).cast("string").alias("text")),
        F.struct((F.col("seq") + 1).alias("seq"), F.lit("delta").alias("kind"), F.col("seq").alias("ref"),
                 F.lit(None).cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text")))))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, ASSISTANT, ok)],
                                  "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return digests(format_events(events_of_turns(rows.unionByName(added))))


def _escaped_sql(column: str) -> str:
    """SQL of :func:`escape`: doubled backslashes, then one behind the first character of each control string."""
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
said AS (
  SELECT conv_id, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         count(*) AS n,
         sum(length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + {len(OPEN + MIDDLE + CLOSE)}) AS chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM said
"""
