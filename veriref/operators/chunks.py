"""Chunks of a cited paper for retrieval: split, merge, overlap, snap, filter, renumber."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

MOST, LEAST, LEAST_WORDS, OVERLAP = 512, 200, 10, 50
#: Where a text is split, the coarsest first (fixed values).
SEPARATORS = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " "]


def pieces(text: str, level: int = 0) -> list[str]:
    """Pieces of at most MOST characters, cut at the coarsest separator that does."""
    text = text.strip()
    if len(text) <= MOST:
        return [text] if text else []
    if level == len(SEPARATORS):
        return [text[i : i + MOST] for i in range(0, len(text), MOST)]
    mark = SEPARATORS[level]
    out: list[str] = []
    held = ""
    for part in re.split(f"(?<={re.escape(mark)})", text):
        if len(held) + len(part) <= MOST:
            held += part
            continue
        out += pieces(held, level + 1)
        held = part
    return out + pieces(held, level + 1)


def merged(parts: list[str]) -> list[str]:
    """Short pieces join the one before; a short first one joins the second."""
    out: list[str] = []
    for part in parts:
        if out and (len(part) < LEAST or len(out) == 1 and len(out[0]) < LEAST):
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
    return out


def chunk(text: str | None) -> list[str]:
    parts = merged(pieces(text or ""))
    out = []
    for k, part in enumerate(parts):
        tail = parts[k - 1][-OVERLAP:].partition(" ")[2] if k else ""
        whole = f"{tail} {part}".strip()
        start = re.search(r"(?<=[.!?])\s+(?=[A-ZÀ-Þ])", whole[: 2 * OVERLAP]) if k else None
        whole = whole[start.end() :] if start and tail else whole
        if len(whole.split()) >= LEAST_WORDS:
            out.append(whole)
    return out


@arrow_udf(ArrayType(StringType()))
def chunks(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([chunk(x) for x in batch.to_pylist()], pa.list_(pa.string()))


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(chunks(text_col)).alias("chunk_index", "chunk"))
