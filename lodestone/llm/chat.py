"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role: body</turn>\\n``. A deterministic parser reads the rendered text back;
where the recovered turn differs from the source, the conflicting content of the body is escaped by one
class more, and the turn is rendered and read again until both are identical.

Defined results: a null role or text counts as empty; roles other than system, user and assistant are
written as ``=role`` with their own escapes; rows of a conversation are ordered by turn (nulls first), then
role and text, so repeated rows and ties have one order; a null conversation id is a conversation of its
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import lean, read

NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
END = "</turn>"
TOKEN = re.compile(r"\\([\s\S])|(### (?:(System|User|Assistant)|=((?:[^\\:]|\\[\s\S])*?)): )|(</turn>)")
ESCAPED = re.compile(r"\\([\s\S])")
#: What each escape level puts a backslash before: nothing, backslashes and control strings, every character that a control string or an escape can begin with.
LEVELS = (None, re.compile(r"\\|### (?=(?:System|User|Assistant): |=)|</turn>"), re.compile(r"[\\#<]"))


def header(role: str) -> str:
    return f"### {NAMES[role]}: " if role in NAMES else "### =" + re.sub(r"([\\:])", r"\\\1", role) + ": "


def escape(text: str, level: int) -> str:
    return LEVELS[level].sub(lambda m: "\\" + m[0], text) if level else text


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """The turns of a rendered text: role, text, and the span of the body. Raises ValueError outside the grammar."""
    turns, role, body, start, at = [], None, [], 0, 0
    for m in TOKEN.finditer(rendered):
        if role is not None:
            body.append(rendered[at : m.start()])
        elif rendered[at : m.start()].strip("\n"):
            raise ValueError(f"text between turns at {at}")
        at = m.end()
        if m[2]:
            if role is not None:
                raise ValueError(f"a turn within a turn at {m.start()}")
            role, body, start = ROLES[m[3]] if m[3] else ESCAPED.sub(r"\1", m[4]), [], at
        elif role is None:
            raise ValueError(f"no turn is open at {m.start()}")
        elif m[5]:
            turns.append((role, "".join(body), start, m.start()))
            role = None
        else:
            body.append(m[1])
    if role is not None or rendered[at:].strip("\n"):
        raise ValueError("the last turn is not closed")
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped only as far as its round trip needs."""
    for level in range(len(LEVELS)):
        rendered = f"{header(role)}{escape(text, level)}{END}\n"
        try:
            if [t[:2] for t in parse(rendered)] == [(role, text)]:
                return rendered
        except ValueError:
            pass
    raise ValueError("a turn can't be rendered reversibly")


def _render_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        roles, texts = ([x or "" for x in b.column(c).to_pylist()] for c in ("role", "text"))
        lead = pa.array([len(header(r)) for r in roles], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(roles, pa.string()), pa.array(map(render, roles, texts), pa.string()), lead], names=["conv_id", "turn", "role", "rendered", "lead"])


FORMATTED = "conv_id long, chunk long, formatted string, loss_starts array<long>, loss_ends array<long>"


def _assembler(chunk_chars: int):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, chunk, parts, length, starts, ends = None, 0, [], 0, [], []

        def close() -> None:
            rows.append((now[0], chunk, "".join(parts), list(starts), list(ends)))

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["conv_id", "chunk", "formatted", "loss_starts", "loss_ends"])

        for b in batches:
            for conv, role, rendered in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "rendered"))):
                if now is None or now[0] != conv or length >= chunk_chars:
                    if now is not None:
                        close()
                        chunk = chunk + 1 if now[0] == conv else 0
                    now, parts, length, starts, ends = (conv,), [], 0, [], []
                if role == "assistant":
                    starts.append(length + len(header(role)))
                    ends.append(length + len(rendered) - len(END) - 1)
                parts.append(rendered)
                length += len(rendered)
            if rows:
                yield out()
                rows.clear()
        if now is not None:
            close()
            yield out()

    return assemble


def format_chats(turns: DataFrame, chunk_chars: int = 1 << 20) -> DataFrame:
    """Formatted conversations: conv_id, chunk, formatted, loss_starts, loss_ends (spans in code points).

    Rendering and the round trip run on each row where it lies. Then the rows of a conversation are brought
    together, sorted, and streamed into chunks of about chunk_chars, so a conversation of any length needs
    the memory of one chunk; most have one. The chunks of a conversation follow each other in a partition.
    Ties of turn and role go by the text itself, which is unescaped for the sort where the rows have arrived.
    """
    rendered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_render_rows), "conv_id long, turn long, role string, rendered string, lead int")
    body = F.col("rendered").substr(F.col("lead") + 1, F.length("rendered") - F.col("lead") - F.lit(len(END) + 1))
    dealt = rendered.repartition("conv_id").withColumn("text", F.regexp_replace(body, r"(?s)\\(.)", "$1"))
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "rendered").mapInArrow(lean(_assembler(chunk_chars)), FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    now, rows = None, []

    def out() -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def close() -> None:
        rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    for b in batches:
        for conv, formatted, starts, ends in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends"))):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[5] += len(formatted)
            for role, text, *_ in parse(formatted):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            for a, z in zip(starts, ends):
                text = ESCAPED.sub(r"\1", formatted[a:z])
                now[3] += len(text)
                now[4].update(text.encode())
        if rows:
            yield out()
            rows.clear()
    if now is not None:
        close()
        yield out()


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from format_chats' output, whose chunk order it relies on."""
    return formatted.mapInArrow(lean(_digest_rows), DIGEST)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat_digest(format_chats(turns.unionByName(extra)))
