"""Operator 5: document fingerprints by one-permutation MinHash.

The hashes of a text's 5-word shingles are dealt once to BINS bins, and of each bin the least counts. An
empty bin takes the value of the bin that a hash of its number and the attempt leads to, tried anew until
that one isn't empty (optimal densification: borrowing is independent from bin to bin and the same for all
texts). Of each value BITS bits are kept, packed and written in base64. Likeness is the share of equal bins,
freed from the BITS-bit values that agree by chance: (share - 2^-BITS) / (1 - 2^-BITS), at least 0.

Words are hashed with numpy over the bytes of a whole text: a polynomial modulo 2^64 by differences of
prefix sums, mixed, then five of them in order into a shingle's hash.

`op5` also compares each text with an edited one and the next. Documents are dealt by ranges of ids, with
boundaries from quantiles of all ids; each range also receives the first document after it, so `lead` finds
the next one and no global order is needed.

Defined results: null and empty texts, and texts of separators alone, have no shingles and the fingerprint
of the empty set, 1 alike to itself and 0 to any other; a text of fewer than five words is one shingle; equal
texts have equal fingerprints. Rows that repeat an id follow one another by text; rows of a null id come
first. A single document is its own next. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from veriref.llm.common import BROADCAST_ROWS, cut, give_back, small_batches, table, utf8

BINS, BITS, WORDS = 512, 4, 5
EMPTY = ""
#: Bytes of text in a range of ids, on average; a session's shuffle partitions give more ranges where that is more.
RANGE_BYTES = 32 << 20
_BYTES_AT_ONCE = 1 << 18
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = _BYTES_AT_ONCE + 1
    return tuple(np.r_[np.uint64(1), np.multiply.accumulate(np.full(size - 1, base))] for base in (_BASE, _INVERSE))


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word, equal words alike. Long texts are taken in blocks that end between words."""
    up, down = _powers()
    found, low = [], 0
    while low < len(text):
        high = min(low + _BYTES_AT_ONCE, len(text))
        if high < len(text):
            blanks = np.flatnonzero(_BLANK[np.frombuffer(text, np.uint8, high - low, low)])
            if len(blanks):
                high = low + int(blanks[-1]) + 1
            else:  # a word longer than a block
                ends = [k for k in (text.find(bytes([b]), high) for b in np.flatnonzero(_BLANK).tolist()) if k >= 0]
                high = min(ends, default=len(text))
                word = text[low:high]
                found.append(_mixed(np.array([hash_long(word)], np.uint64)))
                low = high
                continue
        own = np.frombuffer(text, np.uint8, high - low, low)
        word = ~_BLANK[own]
        edges = np.diff(np.r_[False, word, False].astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sums = np.r_[np.uint64(0), np.add.accumulate(np.where(word, own.astype(np.uint64) + np.uint64(1), np.uint64(0)) * up[: len(own)])]
        found.append(_mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        low = high
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def hash_long(word: bytes) -> int:
    """The polynomial of a word longer than a block."""
    up, _ = _powers()
    total, factor = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for low in range(0, len(word), _BYTES_AT_ONCE):
            own = np.frombuffer(word[low : low + _BYTES_AT_ONCE], np.uint8).astype(np.uint64) + np.uint64(1)
            total = total + np.add.reduce(own * up[: len(own)]) * factor
            factor = factor * up[_BYTES_AT_ONCE]
        return int(total + np.uint64(len(word)) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(text: str | None) -> np.ndarray:
    words = word_hashes(utf8(text))
    if len(words) == 0:
        return words
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = _mixed(total * _BASE + words[k : k + n])
    return total


@lru_cache(maxsize=1)
def _detours() -> np.ndarray:
    """Where bin k turns at attempt j, [j, k]."""
    bins, tries = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(64, dtype=np.uint64))
    return (_mixed(bins * np.uint64(0x2545F4914F6CDD1D) + tries * _BASE + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)


def fingerprint(text: str | None) -> str:
    hashes = shingle_hashes(text)
    if len(hashes) == 0:
        return EMPTY
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (hashes >> np.uint64(64 - 9)).astype(np.int64), hashes & np.uint64((1 << 55) - 1))
    full = least != np.iinfo(np.uint64).max
    source = np.arange(BINS)
    open_ = np.flatnonzero(~full)
    attempts = _detours()
    attempt = 0
    while len(open_):
        # Beyond the table of attempts bins are walked in order, so this ends.
        at = attempts[attempt][open_] if attempt < len(attempts) else (open_ + attempt) % BINS
        source[open_] = at
        open_, attempt = open_[~full[at]], attempt + 1
    # The bin's number is mixed in, so that bins which borrow one value don't all agree by the same chance.
    low = (_mixed(least[source] + np.arange(BINS, dtype=np.uint64) * _BASE) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return base64.b64encode((low[::2] << 4 | low[1::2]).tobytes()).decode()


def likeness(a: str, b: str) -> float:
    """An estimate of the Jaccard similarity of the sets of shingles, from two fingerprints."""
    if a == b:
        return 1.0
    if EMPTY in (a, b):
        return 0.0
    x, y = (np.frombuffer(base64.b64decode(s), np.uint8) for s in (a, b))
    d = x ^ y
    share = (np.count_nonzero(d >> 4 == 0) + np.count_nonzero(d & 15 == 0)) / BINS
    return max(0.0, (share - 2.0**-BITS) / (1 - 2.0**-BITS))


@arrow_udf(StringType())
def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([fingerprint(x) for x in batch.to_pylist()], pa.string())
    give_back()


def compared_with(edited: Column, own: Column, following: Column) -> Column:
    """Of an edited text and two fingerprints, as one struct: the text's fingerprint, and the likeness of `own` to it and to `following`."""

    def run(rows: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, prints, others in rows:
            prints, made = prints.to_pylist(), [fingerprint(x) for x in texts.to_pylist()]
            near = [pa.array(map(likeness, prints, x), pa.float64()) for x in (made, others.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array(made, pa.string()), *near], names=["print", "near", "near_following"])
        give_back()

    kind = StructType([StructField("print", StringType()), StructField("near", DoubleType()), StructField("near_following", DoubleType())])
    return arrow_udf(run, kind).asNondeterministic()(edited, own, following)  # so that it runs once for all its fields


def _ranges(ids: DataFrame, n: int) -> Column:
    """The range of an id, by quantiles of all ids: a sum of comparisons, so the same wherever it is computed."""
    bounds = sorted(set(ids.filter("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []))
    found = F.lit(0)
    if bounds:  # searched in two steps, by blocks of edges and then within one
        step = max(1, math.isqrt(len(bounds)))
        edges, coarse = (F.array(*[F.lit(int(x)) for x in own]) for own in (bounds, bounds[step - 1 :: step]))
        below = lambda own: F.size(F.filter(own, lambda edge: edge <= F.col("doc_id")))
        first = below(coarse) * step
        found = first + below(F.slice(edges, first + 1, F.lit(step)))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame) -> DataFrame:
    """Of doc_id, text: the same with print, next_text and next_print; next is the row that follows by doc_id (then text), and the first after the last."""
    ids = docs.select("doc_id")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket = _ranges(ids, max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES))
    firsts = cut(ids.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("doc_id")))
    every = Window.partitionBy(F.lit(0))  # a row for each range
    guests = firsts.select(F.col("doc_id").alias("guest"), "bucket", F.coalesce(F.lag("bucket").over(every.orderBy("bucket")), F.max("bucket").over(every)).alias("host"))
    few = guests.count() <= BROADCAST_ROWS
    ranged = docs.withColumn("bucket", bucket)
    own = ranged.join(F.broadcast(guests) if few else guests, ["bucket"]).filter(F.col("doc_id").eqNullSafe(F.col("guest")))
    visiting = own.groupBy("host").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("x.doc_id", "x.text", F.col("host").alias("bucket"), F.lit(1).alias("visits"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    both = ranged.withColumn("visits", F.lit(0)).unionByName(visiting).withColumn("print", fingerprints("text")).repartition(n, "bucket")
    order = Window.partitionBy("bucket").orderBy("visits", "doc_id", "text")
    return both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_print", F.lead("print").over(order)).filter("visits = 0")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(own)
    edited = rows.select("doc_id", "print", "next_print", F.length("text").cast("long").alias("n_chars"), F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next_text, length(text) div 2)")).alias("edited"))
    # One pass through Python, so one worker a task.
    marked = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("print").alias("fingerprint"), compared_with(F.col("edited"), F.col("print"), F.col("next_print")).alias("made"))
    return marked.select("doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("made.print").alias("edited_fingerprint"), F.col("made.near").alias("near_edited"), F.col("made.near_following").alias("near_next"))


def op5_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
