"""String alignments that built-in functions can't express, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

#: Letters that are counted apart at most, and sizes of what is worked on at once: pairs of counts, limbs of a table, aligned pairs.
_CLASSES, _TILE, _TABLE, _PAIRS = 64, 1 << 17, 1 << 22, 1 << 13


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of the table is one integer."""
    where: dict[str, int] = {}
    for k, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def indel(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


class Texts:
    """Many texts as numbers, for `indel` of many pairs of them at a time."""

    def __init__(self, texts: list[str]):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.width = max(1, int(self.lengths.max(initial=0)))
        points = np.array(texts, f"U{self.width}").view(np.uint32).reshape(len(texts), self.width)
        letters, codes = np.unique(points, return_inverse=True)
        self.n_letters = len(letters)
        #: Codes of letters by place; behind the end of a text a letter that no text has.
        self.codes = np.where(np.arange(self.width)[:, None] < self.lengths, codes.reshape(points.shape).T, self.n_letters).astype(np.int32)
        # Letters that are counted together make the bound wider, never wrong.
        classes = np.minimum(self.n_letters, _CLASSES)
        at = np.arange(len(texts)) * classes + np.where(self.codes < self.n_letters, self.codes, 0) % classes
        counts = np.bincount(at[self.codes < self.n_letters], minlength=len(texts) * classes).reshape(len(texts), classes)
        self.counts = np.ascontiguousarray(counts.T.astype(np.uint8 if self.width < 256 else np.int32))

    def _needed(self, least: float) -> np.ndarray:
        """Letters in common that a pair needs at least, by the sum of its lengths."""
        return np.ceil(least * np.arange(2 * self.width + 1) / 2 - 1e-9).astype(np.int64)

    def candidates(self, start: int, middle: int, end: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of texts start..middle with texts middle..end whose letters allow a likeness of `least`."""
        for i, j in self.among(np.arange(start, middle), np.arange(middle, end), least):
            yield i + start, j + middle

    def among(self, left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in `left` and `right` of the texts whose letters allow a likeness of `least`."""
        x, y = self.counts.take(left, axis=1), self.counts.take(right, axis=1)
        both = x.any(axis=1) & y.any(axis=1)
        x, y = x[both], y[both]
        needed = self._needed(least).astype(x.dtype)
        step = max(1, _TILE // len(right)) if len(right) else 1
        for low in range(0, len(left), step):
            part = x[:, low : low + step]
            total = np.zeros((part.shape[1], len(right)), x.dtype)
            less = np.empty_like(total)
            for p, q in zip(part, y, strict=True):
                np.minimum(p[:, None], q[None, :], out=less)
                total += less
            i, j = np.nonzero(total >= needed[self.lengths[left[low : low + part.shape[1]], None] + self.lengths[None, right]])
            if len(i):
                yield i + low, j

    def near(self, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
        """Which of the pairs x, y have letters that allow a likeness of `least`."""
        needed = self._needed(least)
        out = np.empty(len(x), bool)
        for low in range(0, len(x), _TILE):
            a, b = x[low : low + _TILE], y[low : low + _TILE]
            total = np.zeros(len(a), self.counts.dtype)
            for own in self.counts:
                total += np.minimum(own.take(a), own.take(b))
            out[low : low + _TILE] = total >= needed[self.lengths[a] + self.lengths[b]]
        return out

    def alike(self, x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs x, y of texts those with `indel` of `least` or more, and its value: `lcs` with rows of 64-bit limbs, many pairs at a time."""
        order = np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        limbs = -(-self.width // 64)
        step = max(1, _TABLE // (limbs * (self.n_letters + 1)))
        out = []
        for first in range(int(y[0]) // step * step if len(y) else 0, int(y[-1]) + 1 if len(y) else 0, step):
            a, b = np.searchsorted(y, [first, first + step])
            if a == b:
                continue
            rows = min(step, len(self.lengths) - first)
            where = np.zeros((limbs, rows * (self.n_letters + 1)), np.uint64)
            base = np.arange(rows) * (self.n_letters + 1)
            for p in range(self.width):
                where[p // 64][base + self.codes[p, first : first + rows]] |= np.uint64(1 << p % 64)
            where[:, self.n_letters :: self.n_letters + 1] = 0
            out += [self._aligned(x[k : min(k + _PAIRS, b)], y[k : min(k + _PAIRS, b)], first, where, least) for k in range(a, b, _PAIRS)]
        if not out:
            return x[:0], y[:0], np.zeros(0)
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))

    def _aligned(self, x: np.ndarray, y: np.ndarray, first: int, where: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        needed = self._needed(least)[self.lengths[x] + self.lengths[y]]
        base = (y - first) * (self.n_letters + 1)
        row = [np.full(len(x), ~np.uint64(0)) for _ in where]
        common = lambda: sum(np.bitwise_count(~v).astype(np.int64) for v in row)
        for p in range(int(self.lengths[x].max(initial=0))):
            if p and p % 16 == 0:
                # What is left of x can't make up for what is missing.
                keep = common() + np.maximum(self.lengths[x] - p, 0) >= needed
                if not keep.all():
                    x, y, needed, base, row = x[keep], y[keep], needed[keep], base[keep], [v[keep] for v in row]
                if not len(x):
                    break
            at = base + self.codes[p].take(x)
            carry = None
            for k, v in enumerate(row):
                hit = v & where[k].take(at)
                total = v + hit
                over = total < v
                if carry is not None:
                    total += carry
                    over |= (total == 0) & (carry == 1)
                row[k] = total | (v ^ hit)
                carry = over.astype(np.uint64)
        sim = 2 * common() / (self.lengths[x] + self.lengths[y]) if len(x) else np.zeros(0)
        keep = sim >= least
        return x[keep], y[keep], sim[keep]


def _pairwise(f):  # noqa: ANN001, ANN202
    @arrow_udf(DoubleType())
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in pairs:
            yield pa.array([f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return run


#: Similarity of two titles whose words are in any order, from 0 to 1.
title_similarity = _pairwise(token_sort_ratio)
#: Similarity by longest matching blocks, from 0 to 1.
block_similarity = _pairwise(lambda a, b: None if a is None or b is None else SequenceMatcher(None, a, b).ratio())


def duck_similarity(a: str, b: str) -> str:
    """`indel` in DuckDB, of two columns of up to 120 characters: rows of bits in 128-bit integers."""
    full = f"((1::hugeint << length({b})::int) - 1)"
    masks = f"list_transform(string_split({a}, ''), lambda c: coalesce(list_sum(list_transform(range(1, length({b}) + 1), lambda i: case when substring({b}, i::int, 1) = c then 1::hugeint << (i - 1)::int else 0::hugeint end)), 0)::hugeint)"
    row = f"list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    return f"case when {a} = {b} then 1.0::double else 2.0::double * (length({b}) - bit_count({row})) / (length({a}) + length({b})) end"
