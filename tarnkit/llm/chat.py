"""Conversations rebuilt from event logs and rendered for training.

An event belongs to a message (conv_id, turn, msg) and has a place seq in it:

  delta       text joins the message
  edit        text replaces what the message holds
  regenerate  the message starts anew with text; of several answers the last stays
  retract     the message goes, unless a later event brings it back

The log is partitioned by conversation and sorted by turn, msg and seq; one pass folds
it and holds one message at a time, so that a conversation of any length needs no more
memory than its longest message. Messages are rendered as

  ### Role: text</turn>

and a newline, with a backslash before each backslash, before # where ## follows and
before </turn> inside texts. A formatted conversation is one part, or several of whole
turns where it has more than PART_CHARS characters; the loss mask of a part lists the
stretches of assistant text. read_back parses parts and undoes the escapes.

Edge cases: null texts and roles are empty; an empty text is a turn with nothing in it;
messages with one turn are ordered by msg, which events_of numbers by role and text;
a null turn comes first; repeated rows are turns of their own; a null conv_id is one
conversation; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_CHARS = 1_000_000
DELTA_CHARS = 256
# The template.
NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
ROLES = {v: k for k, v in NAMES.items()}
END = "</turn>"
ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)")
ESCAPE_ROLE = re.compile(r"[\\:]|#(?=##)|<(?=/turn>)")
UNESCAPE = re.compile(r"\\(.)", re.S)
STOP = re.compile(r"\\.|</turn>\n", re.S)
HEADER_STOP = re.compile(r"\\.|: ", re.S)


def header(role: str) -> str:
    return f"### {NAMES[role]}: " if role in NAMES else f"### ={ESCAPE_ROLE.sub(r'\\\g<0>', role)}: "


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text starts and ends."""
    head, body = header(role), ESCAPE.sub(r"\\\g<0>", text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def _stop(pattern: re.Pattern, text: str, at: int) -> re.Match:
    m = pattern.search(text, at)
    while m.group()[0] == "\\":
        m = pattern.search(text, m.end())
    return m


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """role and text of each turn of a formatted part."""
    at = 0
    while at < len(formatted):
        colon = _stop(HEADER_STOP, formatted, at + 4)
        name = formatted[at + 4 : colon.start()]
        end = _stop(STOP, formatted, colon.end())
        yield UNESCAPE.sub(r"\1", name[1:]) if name[:1] == "=" else ROLES[name], UNESCAPE.sub(r"\1", formatted[colon.end() : end.start()])
        at = end.end()


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """(conv_id, turn, msg, op, role, text) in order, to (conv_id, turn, msg, role, text)."""
    key, role, parts, alive = None, "", [], False
    for conv, turn, msg, op, who, text in events:
        if (conv, turn, msg) != key:
            if alive:
                yield *key, role, "".join(parts)
            key, role, parts, alive = (conv, turn, msg), "", [], False
        role = who or role
        if op == "retract":
            parts, alive = [], False
            continue
        if op in ("edit", "regenerate"):
            parts = []
        parts.append(text or "")
        alive = True
    if alive:
        yield *key, role, "".join(parts)


def format_events(events: DataFrame) -> DataFrame:
    """events (conv_id, turn, msg, seq, op, role, text) to parts (conv_id, part, turns, text, mask)."""
    fields = ["conv_id", "turn", "msg", "op", "role", "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        mask = pa.array([[{"start": s, "end": e} for s, e in m] for *_, m in held], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), mask], ["conv_id", "part", "turns", "text", "mask"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        conv, part, turns, pieces, size, mask, open_ = None, 0, 0, [], 0, [], False
        for c, _, _, role, text in fold(rows(batches)):
            if open_ and (c != conv or size >= PART_CHARS):
                held.append((conv, part, turns, "".join(pieces), mask))
                chars += size
                part, turns, pieces, size, mask = part + 1 if c == conv else 0, 0, [], 0, []
                if len(held) >= 1000 or chars >= 4 * PART_CHARS:
                    yield batch(held)
                    held, chars = [], 0
            conv, open_ = c, True
            piece, s, e = render(role, text)
            if role == "assistant":
                mask.append((size + s, size + e))
            pieces.append(piece)
            size += len(piece)
            turns += 1
        if open_:
            held.append((conv, part, turns, "".join(pieces), mask))
        if held:
            yield batch(held)

    ordered = events.select(*fields, "seq").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "msg", "seq").select(*fields)
    return ordered.mapInArrow(work, "conv_id long, part int, turns long, text string, mask array<struct<start int, end int>>")


def read_back(parts: DataFrame, in_order: bool = False) -> DataFrame:
    """Parts to the digests of what they hold.

    in_order: parts come as format_events makes them, conversations whole and parts in
    their order; parts that were stored in between are brought in that order first."""
    if not in_order:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        held: list[list] = []

        def done() -> pa.RecordBatch:
            rows = [[c, n, t.hexdigest(), lc, lo.hexdigest(), fc] for c, n, t, lc, lo, fc in held]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for conv, part, text, mask in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if part == 0:
                    if len(held) >= 1000:
                        yield done()
                        held = []
                    held.append([conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0])
                now = held[-1]
                for role, body in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{body}\n".encode())
                for span in mask:
                    loss = UNESCAPE.sub(r"\1", text[span["start"] : span["end"]])
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5] += len(text)
        if held:
            yield done()

    return parts.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of(conversations: DataFrame) -> DataFrame:
    """A log that leads to a table of finished messages, as a service would have written it.

    A message begins with a draft. Its text then comes in pieces of DELTA_CHARS: the first
    replaces the draft, as a regeneration of an answer or an edit of anything else, and the
    others are streamed. At each conversation's turn 0 stands a message that was retracted."""
    by = "conv_id", "turn"
    numbered = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    numbered = numbered.withColumn("msg", F.row_number().over(Window.partitionBy(*by).orderBy("role", "text")).cast("long"))
    pieces = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0)))
    op = F.when(F.col("seq") > 0, "delta").when(F.col("role") == "assistant", "regenerate").otherwise("edit")
    told = numbered.select(*by, "msg", "role", F.posexplode(pieces).alias("seq", "text")).withColumn("op", op)
    none = F.lit(None).cast("string")
    draft = numbered.select(*by, "msg", "role", F.lit(-1).alias("seq"), F.concat(F.lit("draft: "), F.substring("text", 1, 8)).alias("text"), F.lit("delta").alias("op"))
    first = numbered.where("turn = 0 and msg = 1").select(*by, F.lit(0).cast("long").alias("msg"), F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit("taken back").alias("text"), F.lit("delta").alias("op")), F.struct(F.lit(1).alias("seq"), none.alias("text"), F.lit("retract").alias("op")))).alias("x"))
    gone = first.select(*by, "msg", F.lit("user").alias("role"), "x.seq", "x.text", "x.op")
    return told.unionByName(draft).unionByName(gone)


def format_digest(conversations: DataFrame) -> DataFrame:
    return read_back(format_events(events_of(conversations)), in_order=True)
