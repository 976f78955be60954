"""Readers of files into tables of references, citations and rejects."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriref.sources import parsers

MOST_BYTES, MOST_REFS = 20_000_000, 500
REFERENCE = "paper_id string, ref_pos long, ref_id string, title string, authors array<string>, year int, venue string, doi string, url string, raw_text string, source_format string"
CITATION = "paper_id string, cit_pos long, ref_id string, citing_sentence string, context_before string, context_after string, marker string, position int"
FORMATS = {".bib": ("bibtex", parsers.bibtex), ".tex": ("latex", parsers.bibtex), ".txt": ("text", parsers.plain_references), ".xml": ("tei", parsers.tei_references)}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content and suffix of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content", F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).alias("suffix"))


def routed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that a parser takes, and rejects with a reason."""
    reason = F.when(~F.col("suffix").isin(*FORMATS, ".pdf", ".zip"), "unknown extension").when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large").when((F.col("suffix") == ".pdf") & (F.substring("content", 1, 5) != F.lit(b"%PDF-")), "no PDF")
    marked = found.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").select("path", "length", "reason")


def unzipped(found: DataFrame) -> DataFrame:
    """The entries of archives beside the other files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                with zipfile.ZipFile(io.BytesIO(row.content)) as archive:
                    for k, entry in enumerate(archive.infolist()):
                        if not entry.is_dir() and entry.file_size <= MOST_BYTES:
                            yield pd.DataFrame([{"path": f"{row.path}/{k}/{entry.filename.rsplit('/', 1)[-1]}", "length": entry.file_size, "content": archive.read(entry), "suffix": "." + entry.filename.rsplit(".", 1)[-1].lower()}])

    return found.filter("suffix <> '.zip'").unionByName(found.filter("suffix = '.zip'").mapInPandas(run, "path string, length long, content binary, suffix string"))


def _decoded(content: bytes) -> str:
    return bytes(content).decode("utf-8", "replace")


def references(found: DataFrame) -> DataFrame:
    """The references of routed files, MOST_REFS of each at most; a file that can't be parsed has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                kind, parse = FORMATS[row.suffix]
                try:
                    rows = parse(_decoded(row.content))[:MOST_REFS]
                except (ValueError, SyntaxError):
                    rows = []
                if rows:
                    yield pd.DataFrame([{"paper_id": row.path, "ref_pos": k, **x, "source_format": kind} for k, x in enumerate(rows)]).astype({"year": "Int32"})

    return found.filter(F.col("suffix").isin(*FORMATS)).mapInPandas(run, REFERENCE)


def citations(found: DataFrame) -> DataFrame:
    """Citations of LaTeX files by command, of plain texts by detected marker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                text = _decoded(row.content)
                rows = parsers.latex_citations(text) if row.suffix == ".tex" else [{"ref_id": k, "citing_sentence": "", "context_before": "", "context_after": "", "marker": m["marker"], "position": m["position"]} for m in parsers.markers(text) for k in m["keys"]]
                if rows:
                    yield pd.DataFrame([{"paper_id": row.path, "cit_pos": k, **x} for k, x in enumerate(rows)])

    return found.filter(F.col("suffix").isin(".tex", ".txt")).mapInPandas(run, CITATION)


def stubs(cited: DataFrame, refs: DataFrame) -> DataFrame:
    """References for keys that are cited and aren't in a paper's bibliography, without a title."""
    unknown = cited.select("paper_id", "ref_id").distinct().join(refs.select("paper_id", "ref_id"), ["paper_id", "ref_id"], "left_anti")
    empty = {"title": "string", "authors": "array<string>", "year": "int", "venue": "string", "doi": "string", "url": "string", "raw_text": "string"}
    return unknown.select("paper_id", F.lit(-1).cast("long").alias("ref_pos"), "ref_id", *[F.lit(None).cast(kind).alias(c) for c, kind in empty.items()], F.lit("stub").alias("source_format"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with a given schema; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def abstract_from_index(index: str = "abstract_inverted_index") -> Column:
    """The text of a map from words to their places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("place"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["word"]), " ")
