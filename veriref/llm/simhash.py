"""Operator 9: SimHash near-duplicates by anchor-point covering.

Anchors are the words of a perfect Golay code over 23 bits of a fingerprint: every point lies within the covering
radius R = 3 of an anchor. If two fingerprints differ in at most t of the 23 bits, the home anchor of one (within R)
is within R + t of the other. So every fingerprint is replicated to all anchors within R + t, and each is compared, at
its home anchor alone, with all that are there, in all its bits.

`EXACT`, the search of the query, has 64-bit SimHashes of 3-word shingles that link at 2 differing bits: one table of
23 bits and t = 2, so no link is missed. Beyond TWO_BLOCKS_FROM distinct fingerprints its anchors are those of the
product of two such codes over 46 bits.

`ALIKE`, the search of `drop_near_copies`, is for a likeness of 0.8 or more over sets of 5-word shingles: 128-bit
SimHashes that link at `max_bits`. Of two texts of likeness J a bit differs with the probability acos(2J / (1 + J)) / pi,
0.15 at 0.8. That is too many for one table, so each of `tables` takes 23 of the bits, in permutations
that deal every bit once before any again, and t = 1 in each: what differs in at most 9 bits always meets, and a pair
of likeness 0.8 is missed by all tables with a probability of some 0.05 (it is met by its group besides).

What is compared are distinct fingerprints, so a group of copies of any size counts once. An anchor yields a spanning
forest of its links rather than all pairs: once most of an anchor's fingerprints are one tree, those of the tree are
compared with the others only. The forests of all tasks are merged, and
components found by minimum labels with pointer jumping.

Defined results: null and empty texts, and texts of separators alone, have the fingerprint zero and link like any
other. Equal rows have equal fingerprints. A null doc_id keeps its row; it never is a component's id unless all ids of
the component are null, and then that is null. An empty table gives an empty result. Other columns, whatever their
names, are ignored by the query and kept by `drop_near_copies`.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from veriref.llm.common import BROADCAST_ROWS, cut, fresh, give_back, ragged, small_batches, table, utf8
from veriref.llm.minhash import _mixed

BLOCK_BITS, BLOCK_RADIUS = 23, 3
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011
#: Beyond so many distinct fingerprints two blocks are used: more anchors, each with fewer of them.
TWO_BLOCKS_FROM = 20_000_000
_SHINGLES_AT_ONCE = 1 << 16
_COMPARED_AT_ONCE = 1 << 18
_REPLICATED_AT_ONCE = 1 << 14
_EDGES_AT_ONCE = 1 << 18
_NO_EDGES = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Search:
    """words: of a shingle; bits: of a fingerprint, 64 to a column; max_bits: that linked fingerprints differ in; tables: of 23 bits (a block) or of several blocks; reach: t of each table."""

    words: int = 3
    bits: int = 64
    max_bits: int = 2
    tables: int = 1
    blocks: int = 1
    reach: int = 2

    @property
    def columns(self) -> list[str]:
        return [f"p{k}" for k in range(self.bits // 64)]

    def places(self) -> np.ndarray:
        """The bits that each table takes, [table, place]."""
        width, rng = self.blocks * BLOCK_BITS, np.random.default_rng(9)
        if self.tables == 1:
            return np.arange(width)[None]
        dealt = [rng.permutation(self.bits)[: self.bits // width * width].reshape(-1, width) for _ in range(self.tables)]
        return np.concatenate(dealt)[: self.tables]


EXACT = Search()
ALIKE = Search(words=5, bits=128, max_bits=24, tables=24, reach=1)


def simhash(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else iter([b" ".join(words)])
    hashes, counts, n = map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.zeros(64, np.int64), 0
    while len(part := np.fromiter(itertools.islice(hashes, _SHINGLES_AT_ONCE), np.uint64)):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


@arrow_udf(LongType())
def fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array(np.array([simhash(x) for x in batch.to_pylist()], np.uint64).view(np.int64))
    give_back()


def wide_simhash(text: str | None, own: Search) -> np.ndarray:
    """The fingerprint over the set of a text's shingles (fewer words: the whole sequence), as columns of 64 bits."""
    words = utf8(text).lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(own.words, len(words))
    shingles = hashes[: len(words) - width + 1] if width else hashes
    for k in range(1, width):
        shingles = shingles * _BASE + hashes[k : len(words) - width + 1 + k]
    shingles = np.unique(shingles)
    counts = np.zeros((len(own.columns), 64), np.int64)
    for low in range(0, len(shingles), _SHINGLES_AT_ONCE):
        part = shingles[low : low + _SHINGLES_AT_ONCE]
        for k in range(len(counts)):
            bits = _mixed(part + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
            counts[k] += np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(shingles), axis=1, bitorder="little").view(np.uint64)[:, 0]


def wide_fingerprint(text: Column, own: Search) -> Column:
    """A struct of the columns of `own` and `node`, the number of the fingerprint."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = np.array([wide_simhash(x, own) for x in batch.to_pylist()], np.uint64).reshape(-1, len(own.columns))
            yield pa.StructArray.from_arrays([pa.array(c.view(np.int64)) for c in (*np.ascontiguousarray(rows.T), node_ids(rows))], names=names)
        give_back()

    names = [*own.columns, "node"]
    return arrow_udf(run, StructType([StructField(c, LongType()) for c in names])).asNondeterministic()(text)  # so that it runs once for all its fields


def hex16(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


@lru_cache(maxsize=4)
def _cosets(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight up to `most`, by syndrome and then weight: patterns, weights, the first of each syndrome, and how many of weight up to w each syndrome has."""
    reach = [np.fromiter((sum(1 << b for b in bits) for bits in itertools.combinations(range(BLOCK_BITS), w)), np.int64) for w in range(most + 1)]
    patterns, weights = np.concatenate(reach), np.repeat(np.arange(most + 1), [len(x) for x in reach])
    syndromes = _syndrome(patterns)
    order = np.lexsort((patterns, weights, syndromes))
    within = np.zeros((2048, most + 1), np.int64)
    np.add.at(within, (syndromes, weights), 1)
    return patterns[order], weights[order], np.searchsorted(syndromes[order], np.arange(2048)), within.cumsum(axis=1)


@lru_cache(maxsize=1)
def _syndrome_tables() -> list[np.ndarray]:
    def remainder(x: int) -> int:
        for bit in range(BLOCK_BITS - 1, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    return [np.array([remainder(b << shift) if b << shift < 1 << BLOCK_BITS else 0 for b in range(256)], np.int64) for shift in (0, 8, 16)]


def _syndrome(points: np.ndarray) -> np.ndarray:
    low, mid, high = _syndrome_tables()
    return low[points & 255] ^ mid[points >> 8 & 255] ^ high[points >> 16]


def anchors(points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of points of 23 bits, [block, row]: (row, anchor, whether it is the row's home) for all anchors within radius plus reach."""
    blocks, n = points.shape
    most = blocks * BLOCK_RADIUS + reach
    patterns, weights, first, within = _cosets(most)
    rows, anchor = np.arange(n), np.zeros(n, np.int64)
    left = np.full(n, most)
    home = np.ones(n, bool)
    for block in points:
        own = block[rows]
        syndromes = _syndrome(own)
        counts = within[syndromes, left]
        at = ragged(first[syndromes], counts)
        rows, anchor, left, home, own = (np.repeat(x, counts) for x in (rows, anchor, left, home, own))
        anchor = anchor << 12 | (own ^ patterns[at]) >> 11
        left, home = left - weights[at], home & (weights[at] <= BLOCK_RADIUS)
    return rows, anchor, home


def points_of(prints: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of fingerprints [row, column] the points of one table, [block, row]."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")[:, places].reshape(len(prints), -1, BLOCK_BITS)
    return (bits.astype(np.int64) << np.arange(BLOCK_BITS)).sum(axis=2).T


def _replicate(batches: Iterator[pa.RecordBatch], own: Search) -> Iterator[pa.RecordBatch]:
    """For each anchor of a table that some 16,000 fingerprints reach one row: those at home there, and all."""
    whole = (np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns], axis=1) for batch in batches if batch.num_rows)
    prints = (x for batch in whole for x in np.array_split(batch, 1 + len(batch) // _REPLICATED_AT_ONCE))
    tables, pending = own.places(), []
    for part in itertools.chain(prints, [None]):
        if part is not None:
            pending.append(part)
        if not pending or part is not None and sum(map(len, pending)) < _REPLICATED_AT_ONCE:
            continue
        block, pending = np.concatenate(pending), []
        for number, places in enumerate(tables):
            rows, anchor, home = anchors(points_of(block, places), own.reach)
            order = np.lexsort((~home, anchor))
            members, anchor, home = block[rows[order]], anchor[order], home[order]
            starts = np.flatnonzero(np.r_[True, np.diff(anchor) != 0]) if len(anchor) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(anchor)]
            homes = np.add.reduceat(home, starts, dtype=np.int64) if len(starts) else starts
            keys = anchor[starts] | number << 12 * own.blocks
            for low in range(0, len(starts), 4096):
                cut_ = slice(low, low + 4096)
                yield pa.RecordBatch.from_arrays([pa.array(keys[cut_]), pa.array(homes[cut_]), pa.array([members[x:y].tobytes() for x, y in zip(starts[cut_], ends[cut_], strict=True)], pa.binary())], names=["anchor", "homes", "members"])
    give_back()


def node_ids(prints: np.ndarray) -> np.ndarray:
    """A number for each fingerprint [row, column]: itself if it has one column, else a hash of its columns."""
    out = prints[:, 0]
    for k in range(1, prints.shape[1]):
        out = _mixed(out * _BASE + prints[:, k])
    return out


class _Trees:
    """Least labels of points that links have joined."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            open_ = label[a] != label[b]
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            x, y = label[a], label[b]
            least = np.minimum(x, y)
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
            while (label != label[label]).any():
                label[:] = label[label]

    def edges(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        linked = self.label != np.arange(len(values))
        return values[linked], values[self.label[linked]]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of stars that connects just what the links (a, b) connect."""
    values, at = np.unique(np.r_[a, b], return_inverse=True)
    trees = _Trees(len(values))
    trees.join(at[: len(a)], at[len(a) :])
    return trees.edges(values)


def forest(homes: np.ndarray, members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare homes with members, fingerprints [row, column]; of the links found a spanning forest: the node of each linked fingerprint and the least of its tree."""
    def near(part: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.bitwise_count(homes[part, None, 0] ^ members[None, j, 0])
        x, y = np.nonzero(gap <= max_bits)
        if homes.shape[1] > 1:
            total = gap[x, y].astype(np.int64)
            for k in range(1, homes.shape[1]):
                total += np.bitwise_count(homes[part[x], k] ^ members[j[y], k])
            x, y = x[total <= max_bits], y[total <= max_bits]
        return part[x], j[y]

    step = max(1, _COMPARED_AT_ONCE // max(1, len(members)))
    if len(homes) <= step:  # most anchors: each at home meets itself alone
        i, j = near(np.arange(len(homes)), np.arange(len(members)))
        if len(i) == len(homes):
            return _NO_EDGES
    values, at = np.unique(node_ids(np.concatenate([homes, members])), return_inverse=True)
    home_at, member_at = at[: len(homes)], at[len(homes) :]
    trees = _Trees(len(values))
    if len(homes) <= step:
        trees.join(home_at[i], member_at[j])
        return trees.edges(values)

    def link(i: np.ndarray, j: np.ndarray) -> None:
        size = max(1, _COMPARED_AT_ONCE // max(1, len(j)))
        for low in range(0, len(i), size):
            x, y = near(i[low : low + size], j)
            trees.join(home_at[x], member_at[y])

    todo, every = np.arange(len(homes)), np.arange(len(members))
    while len(todo):
        link(todo[:step], every)
        todo = todo[step:]
        if len(todo):
            labels, often = np.unique(trees.label[member_at], return_counts=True)
            top = labels[np.argmax(often)]
            if 2 * often.max() > len(members):  # most are one tree: its own homes meet only the others
                inside = trees.label[home_at[todo]] == top
                link(todo[inside], every[trees.label[member_at] != top])
                todo = todo[~inside]
    return trees.edges(values)


def _compare(batches: Iterator[pa.RecordBatch], own: Search) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor: a forest of the links at each anchor, and again of what many anchors found."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, width = 0, len(own.columns)
    for _, group in itertools.groupby(rows, key=lambda row: row[0]):
        same = list(group)
        size = 8 * width
        homes = np.frombuffer(b"".join(blob[: size * n] for _, n, blob in same), np.uint64).reshape(-1, width)
        if not len(homes):
            continue
        edges = forest(homes, np.frombuffer(b"".join(blob for _, _, blob in same), np.uint64).reshape(-1, width), own.max_bits)
        if len(edges[0]):
            found.append(edges)
            held += len(edges[0])
        if held >= _EDGES_AT_ONCE:
            found = [spanning(*map(np.concatenate, zip(*found, strict=True)))]
            held = len(found[0][0])
            if held >= _EDGES_AT_ONCE // 2:
                yield _edges(*found[0])
                found, held = [], 0
    if found:
        yield _edges(*spanning(*map(np.concatenate, zip(*found, strict=True))))
    give_back()


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])


def links(prints: DataFrame, own: Search = EXACT) -> DataFrame:
    """Of distinct fingerprints (the columns of `own`): columns a, b, a forest of node ids that connects just what links connect."""
    small_batches(prints.sparkSession, 1024)
    # Few bytes and much to compute, so the numbers of tasks are said: sizes would merge them into one.
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = 1 + prints.count() // _REPLICATED_AT_ONCE
    reached = prints.select(*own.columns).repartition(blocks, own.columns[0]).mapInArrow(partial(_replicate, own=own), "anchor long, homes long, members binary")
    return reached.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(partial(_compare, own=own), "a long, b long")


def merged(edges: DataFrame) -> DataFrame:
    """As few edges as connect the same nodes. Each task links the nodes of a large group to a root of its own, so a node keeps its least root alone, and its other roots are linked to that, once."""
    nearest = cut(edges.withColumn("least", F.min("b").over(Window.partitionBy("a"))))
    others = nearest.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return nearest.select("a", F.col("least").alias("b")).unionByName(others).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: of each node of an edge the least node that it reaches."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(merged(edges).select(F.explode(ends).alias("ends")).select("ends.*").distinct())  # edges are found once for both directions
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        labels = cut(nearer.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        if labels.filter("old <> root").isEmpty():
            return labels.select("node", "root")
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def rooted(prints: DataFrame, least: Column, own: Search = EXACT) -> DataFrame:
    """Of prints with their node: one row for each distinct fingerprint: node, root (the least node of its component), least."""
    distinct = cut(prints.groupBy("node").agg(F.min(least).alias("least"), *[F.first(c).alias(c) for c in own.columns]))
    if own == EXACT and distinct.count() > TWO_BLOCKS_FROM:
        own = replace(EXACT, blocks=2)
    roots = components(links(distinct, own))
    return distinct.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", own: Search = EXACT) -> DataFrame:
    """doc_id, print (signed 64 bits), component_id for every row of docs."""
    small_batches(docs.sparkSession)
    prints = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("p0")).withColumn("node", F.col("p0")))
    found = cut(rooted(prints, F.col("doc_id"), own))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(found.join(least, "root").select("node", "component_id"), "node").select("doc_id", F.col("p0").alias("print"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", own: Search = ALIKE) -> DataFrame:
    """docs with one row of each component: that of the least id (null last), then of the least text hash; of rows equal in both, one."""
    small_batches(docs.sparkSession)
    hashed = F.xxhash64(F.col(text_col))
    marked = cut(docs.select(F.col(id_col).alias("id"), hashed.alias("same"), wide_fingerprint(F.col(text_col), own).alias("print")).select("id", "same", "print.*"))
    found = rooted(marked, F.struct(F.col("id").isNull().alias("unknown"), "id", "same"), own)
    stays = cut(found.groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.same"))
    every = cut(marked.groupBy("id", "same").agg(F.count("*").alias("n")))
    here, there = every.alias("x"), stays.alias("y")
    equal = F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.same") == F.col("y.same"))
    gone = cut(here.join(there, equal, "left_anti").select("id", "same"))
    id_, same, n = fresh(docs, "id"), fresh(docs, "same"), fresh(docs, "n")
    keyed = docs.withColumn(same, hashed)

    def beside(keys: DataFrame, how: str, rows: DataFrame = keyed) -> DataFrame:
        """Rows that have, or lack, a key; the keys travel if they are few."""
        other = fresh(docs, "other")
        named = keys.select(F.col("id").alias(id_), F.col("same").alias(other))
        named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
        return rows.join(named, rows[id_col].eqNullSafe(named[id_]) & (rows[same] == named[other]), how)

    kept = beside(gone, "left_anti") if gone.count() <= BROADCAST_ROWS else beside(stays, "left_semi")
    twice = cut(every.filter("n > 1").select("id", "same"))
    if twice.isEmpty():
        return kept.select(*docs.columns)
    # Only rows whose id and text are repeated are numbered.
    number = F.row_number().over(Window.partitionBy(id_col, same).orderBy(F.lit(0)))
    first = beside(twice, "left_semi", kept).withColumn(n, number).filter(F.col(n) == 1).drop(n)
    return beside(twice, "left_anti", kept).unionByName(first).select(*docs.columns)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("print")).alias("fingerprint"), "component_id")
