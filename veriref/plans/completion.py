"""Queries on sections of references, arXiv ids, spans and markers: composed from the documents, and held against what they were composed of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriref.operators import completion as C
from veriref.plans.base import ORACLES, QUERIES
from veriref.session import table

_WORDS = "trim(regexp_replace(substring(coalesce(text, ''), 1, 80), '[^A-Za-z0-9]+', ' '{flags}))"
_KNOWN = f"(select doc_id, {_WORDS.format(flags=', ' + chr(39) + 'g' + chr(39))} as t from documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_WORDS.format(flags='')} as t")


def references_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of two headings counts, and an appendix ends it."""
    said = F.expr("""concat('Intro', '\\n References \\n', 'first ', t, '\\nBIBLIOGRAPHY\\n', '[1] One\\n[2] ', t, case doc_id % 4 when 0 then '\\n\\nA. Extra Material\\nmore' when 1 then '\\n appendix follows' when 2 then '\\nSupplementary  Information' else ' \\n ' end)""")
    none = F.expr("concat('No heading, References ', t)")
    return _docs(spark, sf_dir).select("doc_id", C.references_section(F.when(F.expr("doc_id % 9 = 0"), none).otherwise(said)).alias("section"))


def section_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of 400 equal lines and an empty one."""
    section = F.expr("repeat(concat('[', doc_id, '] ', t, '\\n'), 400)")
    return _docs(spark, sf_dir).select("doc_id", F.size(C.section_batches(section)).cast("long").alias("n_batches"))


def arxiv_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From any field, in order; a DOI of arXiv's names an id only to F19."""
    own = _docs(spark, sf_dir).selectExpr(
        "doc_id",
        "case when doc_id % 6 = 0 then concat('2001.0000', doc_id % 10) end as own",
        "case when doc_id % 6 = 1 then concat(t, ' ARXIV: 1706.0376', doc_id % 10, 'v2.') else t end as raw",
        "case when doc_id % 6 <= 2 then concat('https://arxiv.org/pdf/1801.0000', doc_id % 10) else 'https://x.org/1801.00001' end as url",
        "case when doc_id % 6 <= 3 then concat('10.48550/arXiv.1901.0000', doc_id % 10) when doc_id % 6 = 4 then '10.1/x' else concat('arXiv:1901.0000', doc_id % 10) end as doi",
    )
    return own.select("doc_id", C.arxiv_said("own", "raw", "url", "doi").alias("said"), C.arxiv_matched("own", "doi", "url").alias("matched"))


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two markers with something between them."""
    own = _docs(spark, sf_dir).selectExpr("doc_id", "t", "array('', ', ', '. (', repeat(' ', 9), ' ;,\\n    ', ' and ')[doc_id % 6] as gap")
    first, size = F.length("t") + 1, F.length("gap")
    text = F.concat(F.col("t"), F.lit(" [1]"), F.col("gap"), F.lit("[2]"))
    return own.select("doc_id", C.same_appearance(first, first + 3, first + 3 + size, first + 6 + size, text).alias("same"), C.overlap(first, first + 3, first + 2, first + 6).alias("shared"))


def completion_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11."""
    own = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 17 as a", "doc_id % 5 as b", "doc_id % 120 as n")
    return own.select("doc_id", C.should_complete("a", "b", "n").alias("completes"))


def client_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per client the number of events."""
    own = table(spark, sf_dir, "events").selectExpr("case event_id % 3 when 0 then concat(' 10.0.0.', user_id % 200, ' , 10.9.9.9') when 1 then '' end as forwarded", "case when event_id % 4 <> 0 then concat('10.1.0.', user_id % 200) end as host")
    return own.groupBy(C.client_address("forwarded", "host").alias("client")).agg(F.count("*").alias("n"))


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id div 10 as paper_id", "concat('r', (doc_id * 7) % 23) as ref_id", "doc_id as cit_pos")


def citations_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return C.by_reference(_citations(spark, sf_dir)).select("paper_id", "ref_id", F.array_join("positions", ",").alias("positions"))


def unresolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper lists only the references of its even documents."""
    cited = _citations(spark, sf_dir)
    return C.unresolved(cited, cited.filter("cit_pos % 2 = 0"), 3).select("paper_id", "n_unresolved", F.array_join("first_ids", ",").alias("first_ids"))


QUERIES.update({f.__name__: f for f in (references_section, section_batches, arxiv_ids, appearances, completion_trigger, client_addresses, citations_by_reference, unresolved_citations)})
_CITED = "(select doc_id // 10 as paper_id, 'r' || (doc_id * 7) % 23 as ref_id, doc_id as cit_pos from documents)"
ORACLES.update(
    references_section=f"select doc_id, case when doc_id % 9 = 0 then '' else rtrim('[1] One' || chr(10) || '[2] ' || t) end as section from {_KNOWN} d",
    section_batches=f"""select doc_id, case when 400 * (l + 1) <= 18000 then 1 else 1 + cast(ceil(greatest(401 - k, 0) / greatest(k - 5, 1)) as bigint) end as n_batches
    from (select doc_id, l, cast(ceil(12000 / (l + 1)) as bigint) as k from (select doc_id, length('[' || doc_id || '] ' || t) as l from {_KNOWN} d) x) y""",
    arxiv_ids=f"""select doc_id, case doc_id % 6 when 0 then '2001.0000' || doc_id % 10 when 1 then '1706.0376' || doc_id % 10 || 'v2' when 2 then '1801.0000' || doc_id % 10 when 5 then '1901.0000' || doc_id % 10 end as said,
    case when doc_id % 6 = 0 then '2001.0000' || doc_id % 10 when doc_id % 6 <= 3 then '1901.0000' || doc_id % 10 end as matched from {_KNOWN} d""",
    appearances="select doc_id, doc_id % 6 in (1, 4) as same, true as shared from documents",
    completion_trigger="select doc_id, doc_id % 17 + doc_id % 5 >= 8 and 5 * (doc_id % 17 + doc_id % 5) >= doc_id % 120 as completes from documents",
    client_addresses="""select case when event_id % 3 = 0 then '10.0.0.' || user_id % 200 when event_id % 4 <> 0 then '10.1.0.' || user_id % 200 else 'unknown' end as client, count(*) as n from events group by 1""",
    citations_by_reference=f"select paper_id, ref_id, string_agg(cit_pos, ',' order by cit_pos) as positions from {_CITED} c group by all",
    unresolved_citations=f"""select paper_id, count(*) as n_unresolved, array_to_string(list_sort(list(ref_id))[1:3], ',') as first_ids from (select paper_id, ref_id from {_CITED} c group by all having count(*) filter (cit_pos % 2 = 0) = 0) g group by all""",
)
