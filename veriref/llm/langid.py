"""Operator 6: language identification by compression.

For every language that the training documents name, a bounded sample of their text is the raw-content
dictionary of a zstandard compressor. A whole text, lower-cased and with blanks folded, is cut into blocks;
each block is compressed alone with every dictionary, so a long text doesn't come to serve as its own
dictionary, and the language of the smallest sum is chosen. Equal sums go to the language with more
training documents. A margin below `Settings.margin` is narrow: such a prediction is marked as rejected.

Learnt is only from documents with a language that aren't held out: of each language those of the least
hashes, up to `documents`, and of each so many characters (`chars`), up to `dictionary` bytes.

Defined results: a null text or one without a letter (a character of category L) is `und`, with the score 0, and rejected; so is every
text if there is nothing to learn from. With one language the score is 1. Repeated rows get equal results;
a null id has no fold and isn't held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from veriref.llm.common import held_out, small_batches, table, utf8

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample (documents a language, characters a document, bytes a dictionary) and of the compressor (level, bytes a block); margin: relative lead under which a prediction is rejected."""

    documents: int = 400
    chars: int = 1200
    dictionary: int = 1 << 15
    level: int = 10
    block: int = 1024
    margin: float = 0.004


def folded(text: str) -> bytes:
    return utf8(" ".join(text.lower().split()))


def learn(docs: DataFrame, own: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary), the language with the most training documents first."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    known = known.filter(~held_out(F.col("id")))
    counts = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = Window.partitionBy("lang").orderBy("hash", "id")
    chosen = known.select("id", "lang", F.xxhash64("id").alias("hash")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= own.documents)
    # At most own.documents ids a language.
    rows = known.join(F.broadcast(chosen.select("id", "lang", "n").distinct()), ["id", "lang"]).select("lang", "n", "id", F.substring("text", 1, own.chars).alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], -r["n"], r["text"])):
        texts.setdefault(row["lang"], []).append(row["text"])
    return [(lang, b"\n".join(map(folded, texts[lang]))[-own.dictionary :]) for lang in sorted(texts, key=lambda x: (-counts[x], x))]


@lru_cache(maxsize=2)
def _compressors(model: tuple[tuple[str, bytes], ...], level: int) -> list[zstandard.ZstdCompressor]:
    found = []
    for _, content in model:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=level)
        found.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
    return found


def classify(text: str | None, model: tuple[tuple[str, bytes], ...], own: Settings = Settings()) -> tuple[str, float, bool]:
    """Language, score from 0 to 1 (the lead over the next language, against the narrow margin), whether it is rejected."""
    if not model or text is None or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, True
    whole, compressors = folded(text), _compressors(model, own.level)
    sizes = [0] * len(model)
    for low in range(0, len(whole), own.block):
        block = whole[low : low + own.block]
        for k, compressor in enumerate(compressors):
            sizes[k] += len(compressor.compress(block))
    best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
    if len(sizes) == 1:
        return model[0][0], 1.0, False
    second = min(size for k, size in enumerate(sizes) if k != best)
    lead = (second - sizes[best]) / second
    return model[best][0], lead / (lead + 5 * own.margin), lead < own.margin


_FOUND = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])


def identify(docs: DataFrame, model: list[tuple[str, bytes]], text_col: str = "text", out_col: str = "found", own: Settings = Settings()) -> DataFrame:
    """docs with a struct of lang, score and rejected in a column of a new name."""
    if out_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {out_col} already")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [classify(x, shared.value, own) for x in batch.to_pylist()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], names=["lang", "score", "rejected"])

    return docs.withColumn(out_col, arrow_udf(run, _FOUND).asNondeterministic()(F.col(text_col)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))
