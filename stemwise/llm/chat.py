"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and
only that reply under the loss mask. Turns after the last reply come as one more
example without a target, so a conversation can be read back whole.

The template marks turns by control strings; a backslash escapes them inside texts and
role names (and itself), so no text holds one.

A conversation is built in one task, and its examples hold the square of its length: that
is the method. So a conversation has to fit into a task's memory; rows that name none,
however many, are never put together.

Cases: rows go by (turn, role, text), null first; null text is empty; a null role is a
role of empty name; each row with a null conv_id is a conversation of its own; repeated
rows are turns of their own; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: What opens and closes a turn of each role.
MARKS = {
    "system": ("<<SYS>> ", " <</SYS>>"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s> ", " </s>"),
}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]")
ESCAPED = {"\\": "\\\\", **{c: f"\\{i}" for i, c in enumerate(CONTROL)}}
PLAIN = {v: k for k, v in ESCAPED.items()}
TO_ESCAPE = re.compile("|".join(map(re.escape, ESCAPED)))
TO_PLAIN = re.compile(r"\\[\\0-8]")
TURN = re.compile("|".join(f"({re.escape(a)}(.*?){re.escape(b)})" for a, b in [*MARKS.values(), (OTHER[0], OTHER[2])]), re.S)

BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    return TO_ESCAPE.sub(lambda m: ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return TO_PLAIN.sub(lambda m: PLAIN[m[0]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its escaped text starts and ends in it."""
    body = escape(text)
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
    return head + body + tail, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns, at = [], 0
    roles = list(MARKS)
    while at < len(text):
        m = TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        k = (m.lastindex - 1) // 2
        body = m[2 * k + 2]
        if k < len(roles):
            turns.append((roles[k], unescape(body)))
        else:
            role, _, body = body.partition(OTHER[1])
            turns.append((unescape(role), unescape(body)))
        at = m.end()
    return turns


def examples_of(turns: list[tuple[str, str]]) -> Iterator[tuple[bool, str, int, int]]:
    """(is last, text, loss start, loss end) of each example of a conversation."""
    last_reply = max((i for i, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
    prefix = ""
    for i, (role, text) in enumerate(turns):
        turn, start, end = render(role, text)
        at, prefix = len(prefix), prefix + turn
        if role == "assistant":
            yield i == len(turns) - 1, prefix, at + start, at + end
    if last_reply < len(turns) - 1:
        yield True, prefix, len(prefix), len(prefix)


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """Examples (conv_id, example, last, text, loss_start, loss_end) of conversations
    (conv_id, turn, role, text)."""
    kind = conversations.schema["conv_id"].dataType
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    alone = conversations.filter("conv_id is null").select("conv_id", F.array(turn).alias("turns"))
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("example", pa.int32()), ("last", pa.bool_()), ("text", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars = 0
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                turns = [(t["role"], t["text"]) for t in batch.column(1)[i].as_py()]
                for k, (last, text, start, end) in enumerate(examples_of(turns)):
                    rows.append((key, k, last, text, start, end))
                    chars += len(text)
                    if chars >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return whole.union(alone).mapInArrow(expand, f"conv_id {kind.simpleString()}, example int, last boolean, text string, loss_start int, loss_end int")


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation, from its examples alone, whatever their order: each
    example is read by itself, and only replies travel to be put in order."""
    kind = examples.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("example", pa.int32()), ("reply", pa.string()), ("chars", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, k, last, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = hashed = None
                if last:
                    turns, sha = parse(text), hashlib.sha256()
                    for role, said in turns:
                        sha.update(f"{role}\n{said}\n".encode())
                    n, hashed = len(turns), sha.hexdigest()
                out.append((key, k, unescape(text[start:end]), len(text), n, hashed))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    found = examples.select("conv_id", "example", "last", "text", "loss_start", "loss_end").mapInArrow(read, f"conv_id {kind.simpleString()}, example int, reply string, chars long, n_turns long, turns_sha256 string")
    replies = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "")
    whole = found.filter("conv_id is not null").groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), replies.alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    alone = found.filter("conv_id is null").select("conv_id", "n_turns", "turns_sha256", F.col("reply").alias("loss"), F.col("chars").alias("formatted_chars"), F.lit(1).cast("long").alias("n_examples"))
    return whole.union(alone).select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")
