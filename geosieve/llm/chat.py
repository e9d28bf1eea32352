"""Chat formatting from event logs.

A log has one row per event: conversation, message (its place in the conversation), seq (order within the message, of
any sortable type), kind, role, text. Kinds:

* ``message`` opens a turn with a role and the text it starts with,
* ``delta`` appends streamed text to the open turn,
* ``edit`` replaces the text of the open turn,
* ``regenerate`` discards it; deltas follow.

Events are partitioned by conversation and a range of messages, sorted, and folded one message at a time, so a
conversation of any length spreads over tasks and takes the memory of one message. Two ``message`` events of one
message number (repeated rows) are two turns. A null text or role is an empty one; events of a message that no
``message`` event opens are an assistant turn with the text they give. A null conversation is one of its own. Events of equal
seq are taken by kind (in the order above), role and text; turns of one message by the order of their opening events. A
very long text passes as one turn; no events give no turns; other columns are not read.

Template: each turn is ``<turn ROLE>\\n`` text ``\\n</turn>\\n``. Roles are percent-encoded. In texts, one backslash is put
before every ``<turn`` or ``</turn`` and the backslashes in front of it; a marker itself never follows a backslash, so
reading takes one away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geosieve.llm.common import small_batches

CONTROL = re.compile(r"(?<!\\)\\*</?turn")
ESCAPED = re.compile(r"(?<!\\)\\+</?turn")
OPEN, CLOSE = re.compile(r"<turn ([^>\n]*)>\n"), "\n</turn>\n"
LOSS_ROLE = "assistant"
KINDS = ("message", "delta", "edit", "regenerate")
MESSAGES_TOGETHER = 64

TURNS = ("conversation long, message long, nth int, role string, text string, formatted string, loss_start int, "
         "loss_length int")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][1:], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where in it the text under the loss mask begins and its length."""
    head, body = f"<turn {quote(role)}>\n", escape(text)
    loss = role == LOSS_ROLE
    return f"{head}{body}{CLOSE}", len(head) if loss else 0, len(body) if loss else 0


def format_chats(events: DataFrame) -> DataFrame:
    """The turns of all conversations: role and final text, the formatted piece and its part under the loss mask.

    A conversation's pieces, by (message, nth), one after the other are its formatted text. ``loss_start`` and
    ``loss_length`` are code points within the piece (0, 0: none).
    """
    spark = events.sparkSession
    small_batches(spark)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    log = events.select("conversation", "message", "seq", order.alias("_kind"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = (log.repartition("conversation", F.floor(F.col("message") / MESSAGES_TOGETHER))
           .sortWithinPartitions("conversation", "message", "seq", "_kind", "role", "text").drop("seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, nth = None, 0  # conversation, message, role, parts of the text

        def close(out: list[tuple]) -> None:
            text = "".join(turn[3])
            out.append((turn[0], turn[1], nth, turn[2], text, *render(turn[2], text)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              names=[x.split()[0] for x in TURNS.split(", ")])

        for batch in batches:
            out: list[tuple] = []
            for chat, message, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                same = turn is not None and turn[:2] == [chat, message]
                opens = kind == 1 or not same
                if opens:
                    if turn is not None:
                        close(out)
                    turn, nth = [chat, message, role if kind == 1 else role or LOSS_ROLE, []], nth + 1 if same else 0
                if kind in (3, 4):
                    turn[3].clear()
                if kind != 4:
                    turn[3].append(text)
            yield batch_of(out)
        if turn is not None:
            out = []
            close(out)
            yield batch_of(out)

    return log.mapInArrow(run, TURNS)


class Reader:
    """Reads formatted text in pieces of any size, turn by turn."""

    def __init__(self):
        self.rest, self.size = "", 0

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.size += len(piece)
        self.rest += piece
        out, at = [], 0
        while (m := OPEN.match(self.rest, at)) and (end := self.rest.find(CLOSE, m.end())) >= 0:
            out.append((unquote(m[1]), unescape(self.rest[m.end():end])))
            at = end + len(CLOSE)
        self.rest = self.rest[at:]
        return out


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, well_formed boolean")


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the formatted text only.

    SHA-256 takes its bytes in order, so a conversation's pieces meet in one task; they pass through it one by one.
    """
    pieces = turns.select("conversation", "message", "nth", "formatted")
    pieces = pieces.repartition("conversation").sortWithinPartitions("conversation", "message", "nth", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def digest(s: dict) -> tuple:
            return (s["chat"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(),
                    s["reader"].size, not s["reader"].rest)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              names=[x.split()[0] for x in DIGESTS.split(", ")])

        for batch in batches:
            out = []
            for chat, piece in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if state is None or state["chat"] != chat:
                    if state is not None:
                        out.append(digest(state))
                    state = {"chat": chat, "n": 0, "loss_chars": 0, "turns": hashlib.sha256(),
                             "loss": hashlib.sha256(), "reader": Reader()}
                for role, text in state["reader"].feed(piece):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    if role == LOSS_ROLE:
                        state["loss_chars"] += len(text)
                        state["loss"].update(text.encode())
            yield batch_of(out)
        if state is not None:
            yield batch_of([digest(state)])

    return pieces.mapInArrow(run, DIGESTS)


def streamed(rows: DataFrame, piece: int = 200) -> DataFrame:
    """An event log of finished rows (conv_id, turn, role, text): assistant texts as streams of deltas.

    One stream in eight begins with a draft that is regenerated, one user text in eight is edited; which ones depends
    on the row's hash. Equal rows are told apart by a number, so each stays a turn.
    """
    c = F.col
    text, row = F.coalesce("text", F.lit("")), F.xxhash64("conv_id", "turn", "role", "text")
    rows = rows.select(c("conv_id").alias("conversation"), "turn", "role", text.alias("text"), row.alias("_row"))
    same = Window.partitionBy("conversation", "turn", "role", "_row", "text").orderBy("_row")
    rows = rows.withColumn("_copy", F.row_number().over(same))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    draft = event("message", F.concat(F.lit("<turn draft>\n"), F.reverse("text")))
    deltas = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / piece).cast("int")),
                         lambda i: event("delta", F.substring(c("text"), i * piece + 1, F.lit(piece))))
    some = F.pmod(c("_row"), F.lit(8)) == 0
    stream = F.concat(F.when(some, F.array(draft, event("regenerate", F.lit(""))))
                      .otherwise(F.array(event("message", F.lit("")))), deltas)
    whole = F.when(some, F.array(draft, event("edit", c("text")))).otherwise(F.array(event("message", c("text"))))
    rows = rows.select("*", F.posexplode(F.when(c("role") == LOSS_ROLE, stream).otherwise(whole)).alias("_i", "_event"))
    return rows.select("conversation", c("turn").alias("message"), F.struct("_row", "_copy", "_i").alias("seq"),
                       "_event.kind", "role", "_event.text")
