"""Rules around a paper's bibliography and its markers, on columns of one's own: the section of references and its batches, when to complete it, arXiv ids, spans, addresses.

Null texts give null, unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

# Fixed values.
HEADING = r"(?iU)(?:^|\n)\s*(?:References|Bibliography|Works\s+Cited|Literature\s+Cited)\s*\n"
APPENDIX = r"(?U)\n\s*(?:[A-Z]\.\s+[A-Z][a-z]+(?:\s+[A-Z]?[a-z]+)*\s*\n|[Aa]ppendix\b|[Ss]upplementary\s+(?:Material|Information)\b)"
ARXIV_SAID = r"(?iU)(?:arXiv[:\s]*|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5}(?:v\d+)?)"
ARXIV_LINK = r"(?U)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)"
ARXIV_DOI = "10.48550/arxiv."
WHOLE_CHARS, BATCH_CHARS, OVERLAP_LINES = 18_000, 12_000, 5
LEAST_DROPS, LEAST_SHARE = 8, 0.20
GAP_CHARS = 8

_BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _found(text: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def references_section(text: Column | str) -> Column:
    """What follows the last heading of references, as far as an appendix; empty without a heading."""
    parts = F.split(_col(text), HEADING)
    section = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.when(_col(text).isNotNull(), F.lit("")))
    return F.btrim(F.element_at(F.split(section, APPENDIX, 2), 1), F.lit(_BLANK))


def batches_of(section: str) -> list[str]:
    """a short section whole; of a longer one runs of lines that reach some 12,000 characters, each beginning five lines before the last one's end."""
    if len(section) <= WHOLE_CHARS:
        return [section]
    lines = section.split("\n")
    reached = np.cumsum([0, *(len(x) + 1 for x in lines)])
    out, low, high = [], 0, 0
    while high < len(lines):
        low = max(high - OVERLAP_LINES, low + 1) if out else 0
        high = min(int(np.searchsorted(reached, reached[low] + BATCH_CHARS)), len(lines))
        out.append("\n".join(lines[low:high]))
    return out


@arrow_udf(ArrayType(StringType()))
def section_batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """`batches_of` for a column."""
    for batch in texts:
        yield pa.array([None if x is None else batches_of(x) for x in batch.to_pylist()], pa.list_(pa.string()))


def should_complete(orphans: Column | str, dropped: Column | str, references: Column | str) -> Column:
    """At least eight dropped citations that are a fifth of the references or more; unknown counts are zero."""
    drops = F.coalesce(_col(orphans), F.lit(0)) + F.coalesce(_col(dropped), F.lit(0))
    n = F.coalesce(_col(references), F.lit(0))
    return (drops >= LEAST_DROPS) & ((n == 0) | (drops >= n * F.lit(LEAST_SHARE)))


def arxiv_said(arxiv_id: Column | str, raw: Column | str, url: Column | str, doi: Column | str) -> Column:
    """the reference's own arXiv id, else the first that its raw text, link or DOI says."""
    return F.coalesce(F.nullif(_col(arxiv_id), F.lit("")), *[_found(_col(x), ARXIV_SAID) for x in (raw, url, doi)])


def arxiv_matched(arxiv_id: Column | str, doi: Column | str, oa_url: Column | str) -> Column:
    """the arXiv id of a record that was found: its own, else that of its DOI, else that of its open copy."""
    doi = _col(doi)
    by_doi = F.when(F.startswith(F.lower(doi), F.lit(ARXIV_DOI)), F.substring(doi, len(ARXIV_DOI) + 1, 1 << 30))
    return F.coalesce(F.nullif(_col(arxiv_id), F.lit("")), by_doi, _found(_col(oa_url), ARXIV_LINK))


def overlap(a: Column, a_end: Column, b: Column, b_end: Column) -> Column:
    """half-open spans that share a place."""
    return (a < b_end) & (b < a_end)


def same_appearance(a: Column, a_end: Column, b: Column, b_end: Column, text: Column | str) -> Column:
    """spans that overlap, or have up to eight characters between them, all of them blanks, commas or semicolons; places count from 0."""
    low, gap = F.least(a_end, b_end), F.greatest(a, b) - F.least(a_end, b_end)
    between = F.substring(_col(text), low + 1, gap)
    return overlap(a, a_end, b, b_end) | (gap.between(1, GAP_CHARS) & F.coalesce(between.rlike(r"\A[ \t\n,;]*\z"), F.lit(False)))


def client_address(forwarded: Column | str, host: Column | str) -> Column:
    """the first hop of the forwarding header, else the peer, else `unknown`."""
    hop = F.btrim(F.element_at(F.split(F.nullif(_col(forwarded), F.lit("")), ",", 2), 1), F.lit(_BLANK))
    return F.coalesce(hop, F.nullif(_col(host), F.lit("")), F.lit("unknown"))


def by_reference(citations: DataFrame) -> DataFrame:
    """A1, of paper_id, ref_id, cit_pos: for each reference of a paper its citations in order. A paper's are few, so a list is small."""
    return citations.groupBy("paper_id", "ref_id").agg(F.array_sort(F.collect_list("cit_pos")).alias("positions"))


def unresolved(citations: DataFrame, references: DataFrame, most: int = 10) -> DataFrame:
    """O14, of paper_id and ref_id: for each paper how many cited ids it has no reference of, and the first ten of them by name."""
    gone = citations.select("paper_id", "ref_id").distinct().join(references.select("paper_id", "ref_id").distinct(), ["paper_id", "ref_id"], "left_anti")
    return gone.groupBy("paper_id").agg(F.count("*").alias("n_unresolved"), F.slice(F.array_sort(F.collect_set("ref_id")), 1, most).alias("first_ids"))
