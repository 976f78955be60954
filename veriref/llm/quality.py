"""Operator 1: quality rules by robust multivariate outliers.

Counts of each whole text become a vector of six transformed statistics: mean word length, symbols, lines
that repeat, words in repeated passages, upper-case letters, and how the vocabulary grows with length. For
each language and source the minimum-covariance-determinant estimate of location and scatter is found, and
a text is rejected if its squared Mahalanobis distance is beyond the chi-square quantile `QUANTILE`.

An estimate starts from medians and median deviations, and others from small sets of rows that hashes choose
(`STARTS` in all). Each concentrates: the `COVERAGE` of rows nearest to the present estimate give the next one. After
`TRIALS` steps the start of the least determinant is kept for each group, and it goes on until no determinant falls by
more than `SETTLED`, `STEPS` at most; the least determinant seen is the estimate. It is then reweighted: the rows
within the chi-square quantile `NEAR` of it give the final location and scatter. All groups are done at once and over
all rows. A histogram of log distances gives each group's cut, and the rows of the bin where it falls count in part, so
that a step's weight is exact; sums of the rows give means and covariances. Both are partial sums, so no group is ever
in one task. Variances have floors (`FLOORS`, added to every scatter before its determinant is taken), as many
statistics are almost always zero. Groups of fewer than `LEAST` rows join those of their language, and
these, if still few, all rows.

Base rules come first: texts that fail them are no part of the estimates and aren't kept.

Defined results: a null text has no words and fails the base rules, as does an empty one; a null language or
source is a value of its own, other than an empty one; rows that repeat count as often as they do; an empty table gives an empty
result; other columns are ignored. If no estimate can be made (no row passes the base rules), none is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from veriref.llm.common import BROADCAST_ROWS, cut, small_batches, table, utf8

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct"]
VECTOR = ["word_length", "symbols", "dup_lines", "repeats", "upper", "vocabulary"]
#: Standard deviations that are added to those of each statistic.
FLOORS = [0.08, 0.5, 0.15, 0.2, 0.5, 0.05]
COVERAGE, LEAST, QUANTILE, NEAR = 0.75, 200, 0.999, 0.975
STARTS, TRIALS, STEPS, SETTLED, SEEDS = 3, 2, 8, 1e-3, 24
ALL = "*"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BINS = 16  # of distances, an octave


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    whole = utf8(text)
    words = whole.split()
    n = len(words)
    own: dict[bytes, int] = {}
    ids = np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, n)
    repeated = 0
    if n >= 3:
        pairs = np.unique(ids[:-1] * len(own) + ids[1:], return_inverse=True)[1] if len(own) >= 1 << 20 else None
        triples = ids[:-2] * len(own) ** 2 + ids[1:-1] * len(own) + ids[2:] if pairs is None else pairs[:-1] * len(own) + ids[2:]
        _, at, often = np.unique(triples, return_inverse=True, return_counts=True)
        twice = often[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    upper, lower = (len(whole) - len(whole.translate(None, letters)) for letters in (_UPPER, _UPPER.lower()))
    return n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), upper, upper + lower, len(own)


@arrow_udf(StructType([StructField(name, LongType()) for name in COUNTS]))
def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        rows = np.array([counts(x) for x in batch.to_pylist()], np.int64).reshape(-1, len(COUNTS))
        yield pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(COUNTS))], names=COUNTS)


def vector() -> list[Column]:
    """The transformed statistics of a row of COUNTS, by VECTOR."""
    c = {name: F.col(name).cast("double") for name in COUNTS}
    c["n_words"], c["word_chars"] = (F.greatest(c[x], F.lit(1.0)) for x in ("n_words", "word_chars"))  # of none there is no vector to use
    upper = F.log((c["n_upper"] + 1) / (c["n_letters"] - c["n_upper"] + 1))
    return [
        F.log(c["word_chars"] / c["n_words"]),
        F.log1p(100 * c["n_symbols"] / c["word_chars"]),
        F.sqrt(c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0))),
        F.sqrt(c["n_repeat_words"] / c["n_words"]),
        upper,
        F.log(c["n_distinct"]) / F.log(F.greatest(c["n_words"], F.lit(2.0))),
    ]


def chi_square(x: float, degrees: int) -> float:
    """The distribution function, for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """The covariance of the nearest `share` of a normal sample is too small by this factor."""
    return share / chi_square(chi_quantile(share, len(VECTOR)), len(VECTOR) + 2)


_D = len(VECTOR)
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]
_MEANS = [f"m{i}" for i in range(_D)]
_INVERSE = [f"p{i}{j}" for i, j in _PAIRS]


def _distance() -> Column:
    """Squared, of a row's vector to its group's estimate, in codegen's plain arithmetic."""
    gap = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(_D)]
    terms = [gap[i] * gap[j] * F.col(f"p{i}{j}") * (1.0 if i == j else 2.0) for i, j in _PAIRS]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.greatest(total, F.lit(0.0))


def _inverted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each estimate: means and covariances (c..) to means, the inverse (p..) of the covariance with its floors, and the logarithm of its determinant."""
    for own in batches:
        scatter = np.zeros((len(own), _D, _D))
        for i, j in _PAIRS:
            scatter[:, i, j] = scatter[:, j, i] = own[f"c{i}{j}"].to_numpy(float)
        scatter[:, range(_D), range(_D)] += np.square(FLOORS)
        inverse = np.linalg.inv(scatter)
        yield pd.DataFrame({"grp": own["grp"], "start": own["start"], "log_det": np.linalg.slogdet(scatter)[1], **{m: own[m] for m in _MEANS}, **{f"p{i}{j}": inverse[:, i, j] for i, j in _PAIRS}})


_ESTIMATE = "grp string, start int, log_det double, " + ", ".join(f"{x} double" for x in [*_MEANS, *_INVERSE])
_FEW = BROADCAST_ROWS // 10


def _with(rows: DataFrame, small: DataFrame, *keys: str) -> DataFrame:
    return rows.join(F.broadcast(small) if small.count() <= _FEW else small, list(keys or ("grp",)))


def _summed(weighted: DataFrame, factor: float) -> DataFrame:
    """The estimates of rows that carry a weight w and the means m.. that they're measured from."""
    w, gap = F.col("w"), [F.col(f"x{i}") - F.col(f"m{i}") for i in range(_D)]
    sums = weighted.groupBy("grp", "start").agg(F.sum(w).alias("n"), *[F.sum(w * gap[i]).alias(f"s{i}") for i in range(_D)], *[F.sum(w * gap[i] * gap[j]).alias(f"q{i}{j}") for i, j in _PAIRS], *[F.first(m).alias(m) for m in _MEANS])
    means = [(F.col(f"m{i}") + F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(_D)]
    scatter = [(factor * (F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") / F.col("n"))).alias(f"c{i}{j}") for i, j in _PAIRS]
    return cut(sums.filter("n > 0").select("grp", "start", *means, *scatter).mapInPandas(_inverted, _ESTIMATE))


def _first(rows: DataFrame) -> DataFrame:
    """The starts: medians with median deviations as a diagonal covariance, and small sets of rows around them."""
    medians = cut(rows.groupBy("grp").agg(F.count("*").alias("of_all"), *[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(_D)]))
    away = _with(rows, medians).groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i in range(_D)])
    scatter = [(F.pow(1.4826 * F.col(f"d{i}"), 2.0) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    middle = cut(away.join(medians, "grp").select("grp", F.lit(0).alias("start"), *_MEANS, *scatter).mapInPandas(_inverted, _ESTIMATE))
    chance = F.pmod(F.xxhash64("start", *[f"x{i}" for i in range(_D)]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = _with(rows, medians).withColumn("start", F.explode(F.array(*map(F.lit, range(1, STARTS))))).withColumn("w", F.lit(1.0)).filter(chance * F.col("of_all") < SEEDS)
    return cut(middle.unionByName(_summed(drawn, 1.0)))


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimates of the rows nearest to the present ones, for each group and start."""
    placed = _with(rows, estimates).withColumn("bin", F.floor(F.log2(_distance() + 1e-9) * _BINS).cast("int"))
    histogram = placed.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("grp", "start").orderBy("bin")) - F.col("n")
    wanted = F.ceil(COVERAGE * F.sum("n").over(Window.partitionBy("grp", "start")))
    share = F.least(F.lit(1.0), (F.col("wanted") - F.col("before")) / F.col("n"))
    shares = cut(histogram.select("grp", "start", "bin", "n", so_far.alias("before"), wanted.alias("wanted")).filter("before < wanted").select("grp", "start", "bin", share.alias("w")))
    return _summed(_with(placed, shares, "grp", "start", "bin"), consistency(COVERAGE))


def _least(*estimates: DataFrame) -> DataFrame:
    """Of each group's estimates that of the least determinant."""
    order = F.row_number().over(Window.partitionBy("grp").orderBy("log_det", "start"))
    return cut(reduce(DataFrame.unionByName, estimates).withColumn("place", order).filter("place = 1").drop("place"))


def raw_estimates(rows: DataFrame) -> DataFrame:
    """Of rows (grp, x0..) the concentrated set of the least determinant found for each group: its means (m..), inverse (p..) and log_det."""
    now = _first(rows)
    for _ in range(TRIALS):
        now = _concentrated(rows, now)
    best = _least(now)
    now = best
    for _ in range(STEPS):
        now = _concentrated(rows, now)
        before = best.select("grp", F.col("log_det").alias("before"))
        falling = now.join(before, "grp").filter(F.col("before") - F.col("log_det") > SETTLED).isEmpty()
        best = _least(best, now)
        if falling:
            break
    return best


def estimates(rows: DataFrame) -> DataFrame:
    """The raw estimates reweighted; log_det stays that of the raw ones."""
    raw = raw_estimates(rows)
    near = _with(rows, raw).filter(_distance() <= chi_quantile(NEAR, _D)).withColumn("w", F.lit(1.0))
    final = _summed(near, consistency(NEAR)).drop("log_det")
    return cut(final.join(raw.select("grp", "log_det"), "grp"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row for each of docs: doc_id, lang, source, COUNTS, base_failed, grp, log_det (of its group's estimate), distance (squared; null if base_failed) and kept."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), counted(F.col(text_col)).alias("own"))
    base = cut(named.select("doc_id", "lang", "source", "own.*").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    # Names with their lengths, so that no two pairs have one key; null has none.
    key = lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), F.col(x)), F.lit("-"))
    good = base.filter("not base_failed").withColumns({"of_lang": key("lang"), "of_source": key("source")})
    pairs = good.groupBy("of_lang", "of_source").agg(F.count("*").alias("n"))
    # Pairs that are too few join the rest of their language; what is then too few joins all.
    rest = pairs.filter(F.col("n") < LEAST).groupBy("of_lang").agg(F.sum("n").alias("n_rest"))
    grp = F.when(F.col("n") >= LEAST, F.concat("of_lang", "of_source")).when(F.col("n_rest") >= LEAST, F.concat("of_lang", F.lit(ALL))).otherwise(F.lit(ALL))
    groups = cut(pairs.join(rest, "of_lang", "left").select("of_lang", "of_source", grp.alias("grp")))
    rows = cut(_with(good, groups, "of_lang", "of_source").select("grp", *[x.alias(f"x{i}") for i, x in enumerate(vector())]))
    estimate = estimates(rows)
    few = groups.count() <= _FEW
    keyed = base.withColumns({"of_lang": key("lang"), "of_source": key("source")})
    vectors = keyed.join(F.broadcast(groups) if few else groups, ["of_lang", "of_source"], "left").withColumns({f"x{i}": x for i, x in enumerate(vector())})
    measured = vectors.join(F.broadcast(estimate) if few else estimate, "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    limit = chi_quantile(QUANTILE, _D)
    return measured.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(False))).select("doc_id", "lang", "source", *COUNTS, "base_failed", "grp", "log_det", "distance", "kept")


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 4).alias("distance"), F.round("log_det", 4).alias("log_det"))
