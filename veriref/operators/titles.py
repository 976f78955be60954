"""Title matching: pairs of titles that are alike whatever the order of their words.

Only titles that share one of their rarer words are aligned: a pair is met if any of the rarer words of either title
stands in the other, where all words but `COMMON` of them count as rarer. So every pair is met that shares more than
that part of the words of either (in different words); what is alike by letters alone, with most words misspelt, isn't,
and the README has the recall against all pairs. Equal titles count once, so a much-cited title is one row.

Titles are numbered and dealt out in blocks of about `CELL`, and each two blocks (and each block by itself) are a cell, which one
task has: a title is sent once for each block, not once for each of its words, and pairs leave as numbers. In a cell the
titles of a word are met, the letters in common rule pairs out before anything is aligned, and what is left is aligned many pairs
at a time (`functions/similarity.py`). A pair is taken at the rarest of the words that it meets at, and only there: words have one
order, so at any other one some word before it stands in both titles.

Defined results: null and empty titles have no pairs; a title without a partner has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriref.functions.similarity import Texts
from veriref.functions.text import TITLE_MATCH
from veriref.session import cut

COMMON = 0.5
#: Titles of a block, about; where there are fewer than `_TASKS` blocks of them, blocks are smaller, down to `_LEAST`.
CELL, _TASKS, _LEAST = 1 << 16, 8, 1 << 10
#: Candidates that are held at most before they are aligned, and pairs of titles of a word up to which words are taken together.
_HELD, _FEW = 1 << 19, 1 << 12


def numbered(titles: DataFrame) -> DataFrame:
    """`titles` (different ones; norm, l, r: whether a title is on the left, on the right, and more) with an id, kept in the checkpoint folder so that ids stay."""
    return cut(titles.filter("norm <> ''").withColumn("id", F.monotonically_increasing_id()))


def _by_rarity(titles: DataFrame, once: bool) -> DataFrame:
    """id, words: the words of each title, the rarest first; a word that stands in it twice comes twice."""
    split = F.split("norm", " ")
    sides = F.lit(1) if once else F.col("l").cast("int") + F.col("r").cast("int")
    often = titles.select(F.explode(F.array_distinct(split)).alias("word"), sides.alias("n")).filter("word <> ''").groupBy("word").agg(F.sum("n").alias("df"))
    words = titles.select("id", F.explode(split).alias("word")).filter("word <> ''").join(often, "word")
    # A title has few words, so its list is short.
    keys = F.array_sort(F.collect_list(F.struct("df", "word")))
    return words.groupBy("id").agg(F.array_join(F.transform(keys, lambda k: k["word"]), " ").alias("words"))


def _dealt(titles: DataFrame, n: int) -> DataFrame:
    """`titles` in the cells of n blocks, each row once for each block: cell, and whether its block is the second of the cell."""
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    at = lambda other: F.struct((F.greatest("own", other) * (F.greatest("own", other) + 1) / 2 + F.least("own", other)).cast("int").alias("cell"), (F.col("own") > other).alias("second"))
    rows = titles.withColumn("own", own).withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)))
    return rows.select("at.cell", "at.second", *titles.columns).repartitionById(n * (n + 1) // 2, F.col("cell")).sortWithinPartitions("cell", "second")


def _aligner(least: float, common: float, once: bool, more: str | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by their cell and block; a cell is taken as a whole."""
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch["cell"].to_numpy()
            ends = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            for low, high in zip([0, *ends.tolist()], [*ends.tolist(), len(cell)], strict=True):
                if low < high and kept and kept[-1]["cell"][0].as_py() != cell[low]:
                    yield from _Cell(kept, common).pairs(least, once, more)
                    kept = []
                if low < high:
                    kept.append(batch.slice(low, high - low))
        if kept:
            yield from _Cell(kept, common).pairs(least, once, more)

    return run


class _Cell:
    """The titles of two blocks, or of one."""

    def __init__(self, batches: list[pa.RecordBatch], common: float):
        self.rows = pa.Table.from_batches(batches).combine_chunks()
        second = self.rows["second"].to_numpy()
        #: Titles before `middle` are of the first block; one block is on either side.
        self.middle = int(np.searchsorted(second, True))
        self.own = self.middle == len(second)
        words = [x.split(" ") for x in self.rows["words"].to_pylist()]
        self.texts = Texts([" ".join(sorted(x)) for x in words])
        numbers: dict[str, int] = {}
        lists = [[numbers.setdefault(w, len(numbers)) for w in dict.fromkeys(x)] for x in words]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        #: Words by place, the rarest first; behind the last one a word of no title.
        self.words = np.full((len(lists), int(sizes.max(initial=0))), -1, np.int32)
        self.words[np.arange(self.words.shape[1]) < sizes[:, None]] = np.fromiter((w for x in lists for w in x), np.int32, int(sizes.sum()))
        title, place = np.nonzero(self.words >= 0)
        word = self.words[title, place]
        rare = place < (sizes - np.floor(common * sizes).astype(np.int64))[title]
        second = second[title]
        #: What stands at a word: title, place and whether the word is one of its rarer ones, by word and block.
        order = np.lexsort((second, word))
        self.title, self.place, self.rare = title[order], place[order], rare[order]
        self.starts = np.searchsorted(word[order], np.arange(len(numbers) + 1))
        self.middles = self.starts[1:] if self.own else self.starts[:-1] + np.bincount(word[~second], minlength=len(numbers))

    def _met(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of two of what stands at a word whose letters allow a likeness of `least`; one of both may be met twice if there is one block."""
        starts, ends = self.starts[:-1], self.starts[1:]
        first, last = (starts, ends) if self.own else (self.middles, ends)
        n = (self.middles - starts) * (last - first)
        few = np.flatnonzero((n > self.own) & (n <= _FEW))
        # Words of few titles together.
        begun = 0
        while begun < len(few):
            total = np.cumsum(n[few[begun : begun + _HELD // 8]])
            taken = few[begun : begun + max(1, int(np.searchsorted(total, _HELD, "right")))]
            begun += len(taken)
            x = _ranges(starts[taken], self.middles[taken] - starts[taken])
            times = np.repeat(last[taken] - first[taken], self.middles[taken] - starts[taken])
            y = _ranges(np.repeat(first[taken], self.middles[taken] - starts[taken]), times)
            x = np.repeat(x, times)
            met = self.rare[x] | self.rare[y]
            if self.own:
                met &= x < y
            x, y = x[met], y[met]
            near = self.texts.near(self.title[x], self.title[y], least)
            yield x[near], y[near]
        for k in np.flatnonzero(n > _FEW).tolist():
            x, y = np.arange(starts[k], self.middles[k]), np.arange(first[k], last[k])
            rare, other = x[self.rare[x]], y[self.rare[y]]
            for one, two in ((rare, y),) if self.own else ((rare, y), (x[~self.rare[x]], other)):
                if len(one) and len(two):
                    for i, j in self.texts.among(self.title[one], self.title[two], least):
                        i, j = one[i], two[j]
                        if self.own:
                            new = (i < j) | ~self.rare[j]
                            new &= i != j
                            i, j = i[new], j[new]
                        yield i, j

    def _first(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether no word before the one that they meet at stands in both titles."""
        out = np.ones(len(i), bool)
        for low in range(0, len(i), 1 << 14):
            a, b = i[low : low + (1 << 14)], j[low : low + (1 << 14)]
            m, n = self.place[a], self.place[b]
            left, right = self.words[self.title[a], : int(m.max(initial=0))].T.copy(), self.words[self.title[b], : int(n.max(initial=0))].T.copy()
            hit = out[low : low + (1 << 14)]
            for p, own in enumerate(left):
                for q, other in enumerate(right):
                    hit &= (own != other) | (p >= m) | (q >= n)
        return out

    def pairs(self, least: float, once: bool, more: str | None) -> Iterator[pa.RecordBatch]:
        l, r = self.rows["l"].to_numpy(), self.rows["r"].to_numpy()  # noqa: E741
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for i, j in self._met(least):
            x, y = self.title[i], self.title[j]
            asked = (l[x] & r[y]) | (l[y] & r[x])
            i, j = i[asked], j[asked]
            first = self._first(i, j)
            found.append((self.title[i[first]], self.title[j[first]]))
            held += int(first.sum())
            if held >= _HELD:
                yield from self._aligned(found, least, once, more, l, r)
                found, held = [], 0
        if held:
            yield from self._aligned(found, least, once, more, l, r)

    def _aligned(self, found: list[tuple[np.ndarray, np.ndarray]], least: float, once: bool, more: str | None, l: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:  # noqa: E741
        x, y, sim = self.texts.alike(*(np.concatenate(z) for z in zip(*found, strict=True)), least)
        key = self.rows["key"].combine_chunks()
        for a, b in ((x, y),) if once else ((x, y), (y, x)):
            asked = l[a] & r[b]
            a, b, likeness = pa.array(a[asked]), pa.array(b[asked]), pa.array(sim[asked], pa.float64())
            columns = {"a": key.take(a), "b": key.take(b), "sim": likeness} | ({more: self.rows[more].combine_chunks().take(b)} if more else {})
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def alike(titles: DataFrame, key: str = "id", more: str | None = None, once: bool = False, least: float = TITLE_MATCH, common: float = COMMON) -> DataFrame:
    """a, b, sim, and `more` of b: the keys of a left and a right title that are different and alike, for `titles` as `numbered` has them. once: all stand on either side, and a pair comes in one order."""
    count = titles.count()
    n = max(-(-count // CELL), min(_TASKS, -(-count // _LEAST)), 1)
    rows = _dealt(titles.select("id", F.col(key).alias("key"), "l", "r", *([more] if more else [])).join(_by_rarity(titles, once), "id"), n).drop("id")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"a {kind}, b {kind}, sim double" + (f", {more} {rows.schema[more].dataType.simpleString()}" if more else "")
    return rows.mapInArrow(_aligner(least, common, once, more), schema)


def similar_titles(left: DataFrame, right: DataFrame, least: float = TITLE_MATCH, common: float = COMMON) -> DataFrame:
    """a, b, sim: the different normal titles (column norm) of either side that are alike, and equal ones with sim 1; each pair once."""
    sides = left.select("norm", F.lit(True).alias("l"), F.lit(left is right).alias("r"))
    if left is not right:
        sides = sides.unionAll(right.select("norm", F.lit(False).alias("l"), F.lit(True).alias("r")))
    titles = numbered(sides.groupBy("norm").agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r")))
    names = lambda at, name: titles.select(F.col("id").alias(at), F.col("norm").alias(name))
    found = alike(titles, least=least, common=common).withColumnsRenamed({"a": "x", "b": "y"})
    pairs = found.join(names("x", "a"), "x").join(names("y", "b"), "y").select("a", "b", "sim")
    return pairs.unionAll(titles.filter("l and r").select(F.col("norm").alias("a"), F.col("norm").alias("b"), F.lit(1.0).alias("sim")))
