"""Operator 4: byte-level BPE encoding and decoding with vectorised pre-tokenisation.

No regular expression is run. A text becomes an array of code points, a table gives each its class
(letter, number, blank, apostrophe that opens a contraction, ...; blanks and apostrophes also look at the
next characters), and each class is a transition function over eight states of the splitter. Such
functions compose associatively and generate a small monoid, so one byte names a composition and one
table lookup composes two of them: prefixes are scanned within columns of a block for all rows at once,
then over the blocks. Where a state and a class start a token is looked up in a second table.

The slices go through a bounded cache to the pair merging (lowest rank first, leftmost on ties). Tokens
come with the byte offset at which each ends; decoding gathers token bytes through these offsets.

Defined results: a null or empty text has no tokens and decodes to empty bytes; one token may never span
two texts; texts and single pieces of any length are taken whole, in blocks with the state carried over.
An id outside the vocabulary raises. Other columns are kept by `encode`; repeated rows stay.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from veriref.llm.common import give_back, ragged, small_batches, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Letters and numbers that Unicode 16 has beyond Unicode 15.1 (fixed values).
SINCE_UNICODE_15 = [
    (0x1C89, 0x1C8A, "L"), (0xA7CB, 0xA7CD, "L"), (0xA7DA, 0xA7DC, "L"), (0x105C0, 0x105F3, "L"), (0x10D40, 0x10D49, "N"), (0x10D4A, 0x10D65, "L"), (0x10D6F, 0x10D85, "L"),
    (0x10EC2, 0x10EC4, "L"), (0x11380, 0x11389, "L"), (0x1138B, 0x1138B, "L"), (0x1138E, 0x1138E, "L"), (0x11390, 0x113B5, "L"), (0x113B7, 0x113B7, "L"), (0x113D1, 0x113D1, "L"),
    (0x113D3, 0x113D3, "L"), (0x116D0, 0x116E3, "N"), (0x11BC0, 0x11BE0, "L"), (0x11BF0, 0x11BF9, "N"), (0x13460, 0x143FA, "L"), (0x16100, 0x1611D, "L"), (0x16130, 0x16139, "N"),
    (0x16D40, 0x16D6C, "L"), (0x16D70, 0x16D79, "N"), (0x18CFF, 0x18CFF, "L"), (0x1CCF0, 0x1CCF9, "N"), (0x1E5D0, 0x1E5ED, "L"), (0x1E5F0, 0x1E5F0, "L"), (0x1E5F1, 0x1E5FA, "N"),
]
#: What \s matches (fixed values).
BLANKS = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Stands between two texts.
GAP = 0x110000
LETTER, NUMBER, OTHER, BLANK, BETWEEN, SHORT, LONG, JOINING, LAST = range(9)
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, CLOSED, ONE_MORE, TWO_MORE = range(8)
_BLOCK_ROWS, _BLOCK_COLUMNS = 4096, 256
_CACHED_PIECES, _CACHED_LENGTH = 120_000, 64


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    classes = np.full(GAP + 1, OTHER, np.uint8)
    for kind, value in (("L", LETTER), ("N", NUMBER)):
        # Nothing above has a letter or number but for the ranges below.
        classes[[c for c in range(0x33480) if unicodedata.category(chr(c))[0] == kind]] = value
    for low, high, kind in SINCE_UNICODE_15:
        classes[low : high + 1] = LETTER if kind == "L" else NUMBER
    classes[BLANKS] = BLANK
    classes[GAP] = BETWEEN
    return classes


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at a character of this class."""
    if kind == LETTER and state in (ONE_MORE, TWO_MORE):
        return (CLOSED if state == ONE_MORE else ONE_MORE), False
    if kind in (LETTER, NUMBER, OTHER):
        inside = (IN_LETTERS, IN_NUMBERS, IN_OTHERS)[kind]
        return inside, state not in (inside, AFTER_SPACE)
    if kind in (SHORT, LONG):
        return (IN_OTHERS, False) if state in (IN_OTHERS, AFTER_SPACE) else (ONE_MORE if kind == SHORT else TWO_MORE, True)
    if kind == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (AFTER_SPACE if kind == JOINING else CLOSED), True


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The id of each class, products by (id << 8 | id), images by (id << 3 | state), and starts by (state << 4 | class)."""
    single = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    found = {tuple(range(8)): 0}
    queue = list(found)
    for f in queue:
        for g in single:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    assert len(found) <= 256
    product = np.zeros(1 << 16, np.uint8)
    for f, i in found.items():
        for g, j in found.items():
            product[i << 8 | j] = found[tuple(g[s] for s in f)]
    image = np.array(list(found), np.uint8).reshape(-1)
    starts = np.array([[k < 9 and _step(s, k)[1] for k in range(16)] for s in range(8)]).reshape(-1)
    return np.array([found[f] for f in single], np.uint8), product, image, starts


def _classes(points: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Of each point, given the two that follow the last."""
    table_ = class_table()
    following = np.concatenate([points, ahead, np.full(2 - len(ahead), GAP, points.dtype)])
    kinds = table_[following]
    own, after = kinds[:-2].copy(), kinds[1:-1]
    last = (own == BLANK) & (after != BLANK) & (after != BETWEEN)
    own[last] = np.where(points[last] == 0x20, JOINING, LAST)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        first, second = following[at + 1], following[at + 2]
        own[at[np.isin(first, [0x73, 0x74, 0x6D, 0x64])]] = SHORT
        own[at[((second == 0x65) & ((first == 0x72) | (first == 0x76))) | ((first == 0x6C) & (second == 0x6C))]] = LONG
    return own


def token_starts(points: np.ndarray) -> np.ndarray:
    """Where pieces start, in an array of code points with GAP between texts."""
    single, product, image, starts = _monoid()
    state, found, size = CLOSED, [], _BLOCK_ROWS * _BLOCK_COLUMNS
    for low in range(0, len(points), size):
        part = points[low : low + size]
        kinds = _classes(part, points[low + size : low + size + 2])
        rows = -(-len(part) // _BLOCK_COLUMNS)
        grid = np.zeros(rows * _BLOCK_COLUMNS, np.uint8)  # 0: the identity
        grid[: len(part)] = single[kinds]
        grid = np.ascontiguousarray(grid.reshape(rows, _BLOCK_COLUMNS).T)
        before = np.empty_like(grid)  # what has been composed before each column
        so_far = np.zeros(rows, np.uint8)
        for column in range(_BLOCK_COLUMNS):
            before[column] = so_far
            so_far = product[so_far.astype(np.uint16) << 8 | grid[column]]
        entry, step = so_far.copy(), 1
        while step < rows:  # inclusive scan over the rows by doubling
            entry[step:] = product[entry[:-step].astype(np.uint16) << 8 | entry[step:]]
            step *= 2
        states = image[entry.astype(np.uint16) << 3 | state]
        row_states = np.r_[np.uint8(state), states[:-1]]
        state = int(states[-1])
        inner = image[before.astype(np.uint16) << 3 | row_states[None, :]].T.reshape(-1)[: len(part)]
        found.append(low + np.flatnonzero(starts[inner << 4 | kinds]))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    if len(piece) > 128:
        return _merge_long(piece, ranks)
    none, get = len(ranks) + 1, ranks.get
    cuts = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        at = pairs.index(least)
        del pairs[at], cuts[at + 1]
        if at:
            pairs[at - 1] = get(piece[cuts[at - 1] : cuts[at + 1]], none)
        if at < len(pairs):
            pairs[at] = get(piece[cuts[at] : cuts[at + 2]], none)
    return tuple([ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap over a linked list, for pieces of any length."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (k := before[i]) >= 0 and (rank := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (rank, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


class _Pieces(dict):
    """Token ids by piece. When full it starts anew and keeps what is asked for again, so memory stays bounded and common pieces stay."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (ids := self.older.get(piece)) is None:
            ids = _merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) <= _CACHED_LENGTH:
            if len(self) >= _CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def forget(self) -> None:
        self.older = {}
        self.clear()


class Codec:
    """The vocabulary of a file of base64 tokens and their ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pieces = _Pieces(self.ranks)
        size = max(self.ranks.values()) + 1
        self.length, self.known = np.zeros(size, np.int64), np.zeros(size, bool)
        ordered = sorted(self.ranks.items(), key=lambda x: x[1])
        for token, rank in ordered:
            self.length[rank], self.known[rank] = len(token), True
        self.first = np.r_[0, np.cumsum(self.length)[:-1]]
        self.bytes = np.frombuffer(b"".join(token for token, _ in ordered), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not texts:
            return []
        whole = "\0".join(texts)  # a place for each gap
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        points[ends[:-1]] = GAP
        starts = token_starts(points)
        bounds = np.searchsorted(starts, np.r_[0, ends + 1])
        starts = starts.tolist()
        out = []
        for k, stop in enumerate(ends.tolist()):
            own = starts[bounds[k] : bounds[k + 1]]
            if own and own[-1] == stop:  # the gap itself
                own.pop()
            pieces = [whole[a:b] for a, b in zip(own, [*own[1:], stop], strict=True)] if own else []
            out.append(np.fromiter(itertools.chain.from_iterable(map(self.pieces.__getitem__, pieces)), np.int32))
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return self.bytes[ragged(self.first[ids], self.length[ids])]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


_ENCODED = StructType([StructField("ids", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType()))])
_CHARS_AT_ONCE = 500_000


def _encode(batches: Iterator[pa.Array], path: str) -> Iterator[pa.Array]:
    own = codec(path)
    for batch in batches:
        ids: list[np.ndarray] = []
        group, chars = [], 0
        for text in itertools.chain(batch.to_pylist(), [None]):
            group.append(text or "")
            chars += len(group[-1])
            if chars > _CHARS_AT_ONCE:
                ids += own.encode(group)
                group, chars = [], 0
        ids += own.encode(group)
        ids = ids[: len(batch)]
        offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32())
        ends = [np.cumsum(own.length[x]) for x in ids]
        flat = (np.concatenate([*x, np.zeros(0, np.int32)]).astype(np.int32) for x in (ids, ends))
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat], names=["ids", "ends"])
    own.pieces.forget()
    give_back()


def _decode(batches: Iterator[pa.Array], path: str) -> Iterator[pa.Array]:
    own = codec(path)
    for batch in batches:
        out: list[bytes] = []
        ids, ends = batch.field("ids"), batch.field("ends")
        for k in range(len(batch)):
            tokens, stops = (x[k].values.to_numpy(zero_copy_only=False) if x[k].is_valid else np.zeros(0, np.int32) for x in (ids, ends))
            text = own.decode(tokens)
            if len(text) != (stops[-1] if len(stops) else 0):
                raise ValueError("the offsets aren't those of the ids")
            out.append(text.tobytes())
        yield pa.array(out, pa.binary())


def encoded(text: Column, path: str = RANKS) -> Column:
    """struct<ids, ends>: token ids and the UTF-8 byte offset at which each token ends."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _encode(batches, path)

    return arrow_udf(run, _ENCODED).asNondeterministic()(text)  # so that it runs once for all that is taken from it


def decoded(tokens: Column, path: str = RANKS) -> Column:
    """The bytes that a struct of `encoded` stands for."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _decode(batches, path)

    return arrow_udf(run, BinaryType())(tokens)


def coded(text: Column, path: str = RANKS) -> Column:
    """struct<ids, ends, decoded>: both ways in one pass through Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tokens in _encode(batches, path):
            (back,) = _decode(iter([tokens]), path)
            yield pa.StructArray.from_arrays([tokens.field("ids"), tokens.field("ends"), back], names=["ids", "ends", "decoded"])

    return arrow_udf(run, StructType([*_ENCODED.fields, StructField("decoded", BinaryType())])).asNondeterministic()(text)


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "tokens", path: str = RANKS) -> DataFrame:
    """docs with the tokens in a column of a new name."""
    if out_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {out_col} already")
    small_batches(docs.sparkSession)
    return docs.withColumn(out_col, encoded(F.col(text_col), path))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes that they decode to."""
    small_batches(docs.sparkSession)
    both = docs.select(F.col(id_col).alias("doc_id"), coded(F.col(text_col), path).alias("own"))
    ids = F.col("own.ids")
    return both.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("own.decoded", 256).alias("decoded_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
