"""Operator 8: chat formatting in budgeted windows.

A conversation's turns are cut into windows of at most `budget` tokens: prefix sums of turn tokens place
turn-aligned spans, each window opens with the system turn and up to `history` tokens of the turns before
(repeated), then come new turns. The loss mask covers the new assistant texts alone: repeated targets are
masked, so each is learnt from once. A turn beyond the budget has a window of its own, whole.

Template: <|im_start|>role, a line break, the text, <|im_end|>, a line break. Control strings inside a text
are escaped by one more backslash between `<` and `|` ("<|" becomes "<\\|", "<\\|" becomes "<\\\\|"), which
undoing takes off again; in roles so are backslashes and line breaks.

Conversations are sorted by id and turn within partitions and streamed: a worker holds one window and its
history, so a conversation of any length is bounded memory.

Defined results: a null text counts as empty, a null role as empty; a null turn comes first, rows of equal
turns are ordered by role and text; rows of a null id are one conversation; a leading system turn is kept in
every window, later ones are ordinary turns; an empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriref.llm.common import small_batches, table

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNDO = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n((?:[^<]|<(?!\|im_end\|>))*+)<\|im_end\|>\n")
_TOKEN = re.compile(r"\w+|[^\w\s]")


@dataclass(frozen=True)
class Settings:
    """Tokens of a window, and of repeated turns in it at most."""

    budget: int = 768
    history: int = 192


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNDO.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def tokens(text: str) -> int:
    """Words and other signs, and four for the template."""
    return sum(1 for _ in _TOKEN.finditer(text)) + 4


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text is."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def windows(turns: Iterator[tuple[str, str]], own: Settings = Settings()) -> Iterator[dict]:
    """Of one conversation: text, first (the number of the first new turn), n_new, n_repeated and loss (starts and ends of the unmasked spans)."""
    system: tuple[str, str] | None = None
    past: list[tuple[int, str, str]] = []  # what may be repeated: tokens, role, text
    new: list[tuple[int, str, str]] = []
    at, done, room = 0, 0, 0

    def close() -> dict:
        kept, total = 0, 0
        fixed = tokens(system[1]) if system and done else 0
        spare = own.budget - fixed - sum(n for n, _, _ in new)
        for n, _, _ in reversed(past):
            total += n
            if total > min(own.history, spare):
                break
            kept += 1
        repeated = ([(fixed, *system)] if system and done else []) + (past[len(past) - kept :] if kept else [])
        parts, loss, length = [], [], 0
        for k, (_, role, text) in enumerate([*repeated, *new]):
            piece, low, high = formatted(role, text)
            if k >= len(repeated) and role == "assistant":
                loss.append((length + low, length + high))
            parts.append(piece)
            length += len(piece)
        return {"text": "".join(parts), "first": done, "n_new": len(new), "n_repeated": len(repeated), "loss": loss}

    for role, text in turns:
        n = tokens(text)
        if new and room + n > own.budget:
            yield close()
            past = [x for k, x in enumerate([*past, *new]) if not (done == 0 and k == len(past) and system)]
            held = 0
            for k in range(len(past) - 1, -1, -1):  # no more than history can be repeated
                held += past[k][0]
                if held > own.history:
                    past = past[k + 1 :]
                    break
            done, new, room = at, [], tokens(system[1]) if system else 0
        if at == 0 and role == "system":
            system = (role, text)
        new.append((n, role, text))
        room += n
        at += 1
    if new:
        yield close()


def read_back(window: str) -> list[tuple[str, str]]:
    """The turns of a window, unescaped."""
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(window)]


_WINDOW = "conv_id long, window long, text string, first long, n_new long, n_repeated long, loss array<struct<start:int,end:int>>"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    for key, group in itertools.groupby(rows, key=lambda row: row[0]):
        yield key, group


def _format(batches: Iterator[pa.RecordBatch], own: Settings) -> Iterator[pa.RecordBatch]:
    for key, group in _conversations(_rows(batches)):
        for k, window in enumerate(windows(((role or "", text or "") for _, role, text in group), own)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([k], pa.int64()), pa.array([window["text"]], pa.string()), *(pa.array([window[c]], pa.int64()) for c in ("first", "n_new", "n_repeated")), pa.array([[{"start": a, "end": b} for a, b in window["loss"]]], _LOSS)],
                names=["conv_id", "window", "text", "first", "n_new", "n_repeated", "loss"],
            )


def formatted_windows(turns: DataFrame, own: Settings = Settings()) -> DataFrame:
    """The windows of all conversations; of turns: conv_id, turn, role, text."""
    small_batches(turns.sparkSession, 1024)
    own_columns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return own_columns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(partial(_format, own=own), _WINDOW)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows in order: a row for each conversation, read back from their text."""
    found: list[tuple] = []
    for key, group in _conversations(_rows(batches)):
        whole, learnt, n, learnt_chars, chars, n_windows = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
        for _, text, repeated, loss in group:
            for role, said in read_back(text)[repeated:]:
                whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for span in loss:
                said = unescape(text[span["start"] : span["end"]])
                learnt.update(said.encode("utf-8", "surrogatepass"))
                learnt_chars += len(said)
            chars += len(text)
            n_windows += 1
        found.append((key, n, whole.hexdigest(), learnt_chars, learnt.hexdigest(), chars, n_windows))
        if len(found) == 1024:
            yield _digests(found)
            found = []
    yield _digests(found)


_DIGEST = [("conv_id", "long"), ("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long"), ("n_windows", "long")]


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if kind == "long" else pa.string()) for k, (_, kind) in enumerate(_DIGEST)], names=[name for name, _ in _DIGEST])


def digests(formatted_: DataFrame) -> DataFrame:
    """One row a conversation, from the windows' text and loss spans alone. They are in order already: each conversation's are in one partition."""
    return formatted_.select("conv_id", "text", "n_repeated", "loss").mapInArrow(_digest, ", ".join(f"{name} {kind}" for name, kind in _DIGEST))


PROBE = f"{END}{START}assistant ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(formatted_windows(turns.unionByName(probe)))
