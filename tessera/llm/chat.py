r"""Chat logs folded from events and rendered as training text.

A log row is an event of a message: ``start`` (opens it, with a role),
``delta`` (appends text), ``edit`` (replaces the text so far), ``regenerate``
(empties the text; the following deltas are the new answer) or ``delete``.
Logs are partitioned by conversation and sorted by sequence number; each
conversation is folded while its rows stream by, so memory holds one
conversation's messages, never a partition.

Template: every turn is ``### Role:\n`` + text + ``\n</turn>\n``.  Control
strings in a text are made harmless, reversibly: a backslash is doubled, and
one is put before ``###`` and ``</turn>``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import PIECE_BYTES

OPEN, CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_TURN = re.compile(r"### ((?:[^\\#:\n]|\\.)*):\n")
#: characters of a streamed delta that ``events_of_turns`` makes
DELTA_CHARS = 4096


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _role(role: str) -> str:
    return re.sub(r"[\\#:\n]", lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], role)


def _plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the loss mask: code-point ranges of what an
    assistant wrote (escaped, without the marks around it)."""
    parts, mask, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{_role(role)}:\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"\n{CLOSE}\n"]
        at += len(head) + len(body) + len(CLOSE) + 2
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from the formatted text alone."""
    out, at = [], 0
    while at < len(formatted):
        head = _TURN.match(formatted, at)
        at = head.end()
        end = at
        while True:  # the next close mark that no backslash escapes
            end = formatted.index(CLOSE, end)
            run = 0
            while end - 1 - run >= at and formatted[end - 1 - run] == "\\":
                run += 1
            if run % 2 == 0:
                break
            end += 1
        out.append((_plain_role(head[1]), unescape(formatted[at:end - 1])))
        at = end + len(CLOSE) + 1
    return out


class Fold:
    """The messages of one conversation, event by event."""

    def __init__(self):
        self.messages: dict = {}

    def add(self, kind: str, message, role: str | None, text: str | None) -> None:
        if kind == "start":
            self.messages.setdefault(message, [role or "", []])
        state = self.messages.get(message)
        if state is None:  # a delta or edit without start opens the message
            if kind == "delete":
                return
            state = self.messages[message] = [role or "", []]
        if kind in ("delta", "start"):
            state[1].append(text or "")
        elif kind == "edit":
            state[1][:] = [text or ""]
        elif kind == "regenerate":
            state[1].clear()
        elif kind == "delete":
            del self.messages[message]

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


def _conversations(make, names: list[str]):
    """Fold sorted events; ``make(conv_id, messages)`` gives a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold, rows, size = None, None, [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
        for batch in batches:
            for conv, kind, message, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if fold is None or conv != current:
                    if fold is not None:
                        rows.append(make(current, fold.final()))
                        size += rows[-1][-1]
                    current, fold = conv, Fold()
                fold.add(kind, message, role, text)
                if size > PIECE_BYTES or len(rows) >= 10_000:
                    yield out()
                    rows, size = [], 0
        if fold is not None:
            rows.append(make(current, fold.final()))
            yield out()
    return run


def _formatted(conv, messages):
    text, mask = render(messages)
    return conv, len(messages), text, [{"start": a, "end": b} for a, b in mask], len(text)


def _digests(conv, messages):
    """What is read back from the formatted conversation and its mask."""
    text, mask = render(messages)
    turns, loss, loss_chars = hashlib.sha256(), hashlib.sha256(), 0
    back = parse(text)
    for role, body in back:
        turns.update(f"{role}\n{body}\n".encode())
    for a, b in mask:
        plain = unescape(text[a:b])
        loss.update(plain.encode())
        loss_chars += len(plain)
    return conv, len(back), turns.hexdigest(), loss_chars, loss.hexdigest(), len(text)


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """Event log of a table of turns (conv_id, turn, role, text): each turn is
    a start and its text streamed in deltas.

    Two rows of one turn are two messages, in the order of role and text
    (null first).  Columns: conv_id, seq (an ordered struct), kind, message,
    role, text.
    """
    turn = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    turn = turn.withColumn("copy", F.monotonically_increasing_id())
    n = F.greatest(F.lit(0), F.ceil(F.length("text") / DELTA_CHARS).cast("int") - 1)
    pieces = turn.select("*", F.posexplode(F.concat(
        F.array(F.lit(-1)), F.sequence(F.lit(0), n))).alias("step", "at"))
    return pieces.select(
        "conv_id", F.struct("turn", "role", F.xxhash64("text").alias("t"), "copy", "step").alias("seq"),
        F.when(F.col("at") < 0, "start").otherwise("delta").alias("kind"), F.col("copy").alias("message"), "role",
        F.when(F.col("at") >= 0, F.substring("text", F.col("at") * DELTA_CHARS + 1, F.lit(DELTA_CHARS))).alias("text"))


def _sorted_log(events: DataFrame) -> DataFrame:
    return (events.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
            .select("conv_id", "kind", "message", "role", "text"))


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_mask (code-point ranges), chars.

    ``events`` has conv_id, seq, kind, message, role, text; further columns
    are ignored.  Null text is empty, a null role is the empty role, a null
    conv_id is one conversation; events of equal seq are taken in any order,
    so seq should be unique.  Messages stand where their first event stands;
    a delta or edit of an unknown message opens it.  No events give an empty
    result.
    """
    schema = ("conv_id long, n_turns long, formatted string, loss_mask array<struct<start: long, end: long>>, "
              "chars long")
    return _sorted_log(events).mapInArrow(_conversations(_formatted, [
        "conv_id", "n_turns", "formatted", "loss_mask", "chars"]), schema)


def chat_digests(events: DataFrame) -> DataFrame:
    """Digests of ``format_chats``' rows, read back from the formatted text."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")
    return _sorted_log(events).mapInArrow(_conversations(_digests, names), schema)
