"""Queries on what catalogues and probes return: abstracts from inverted indexes, open copies, probes, completed references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriref.functions import text as T
from veriref.functions.dialect import Spark
from veriref.plans.base import ORACLES, QUERIES, query, refs
from veriref.session import table
from veriref.sources.readers import abstract_from_index


def inverted_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text from the places of its words. The index is made from the first 200 characters of a document."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.substring("text", 1, 200), " ", -1)).alias("place", "word"))
    index = words.groupBy("doc_id", "word").agg(F.collect_list("place").alias("places")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("abstract_inverted_index"))
    return index.select("doc_id", abstract_from_index().alias("abstract"))


QUERIES["inverted_abstract"] = inverted_abstract
ORACLES["inverted_abstract"] = "select doc_id, substring(text, 1, 200) as abstract from documents where text is not null"


@query("documents")
def open_access_choice(d: Spark) -> str:
    """The best location's PDF, any PDF, the best landing page, any."""
    url = lambda kind, n: f"case when doc_id % {n} = 0 then concat('https://x.example/{kind}/', doc_id) end"
    return f"with l as (select doc_id, {url('best.pdf', 5)} as best_pdf, {url('other.pdf', 3)} as any_pdf, {url('best', 2)} as best_url, {url('other', 7)} as any_url from documents) select doc_id, coalesce(best_pdf, any_pdf, best_url, any_url) as open_url, coalesce(best_pdf, any_pdf) is not null as is_pdf from l"


@query("documents", "pages")
def web_probes(d: Spark) -> str:
    """Live if 2xx, 3xx or 403, else archived if there is a copy; a DOI without an answer is unknown."""
    return """with r as (select doc_id, doc_id % 300 as page_id, doc_id % 9 as answer from documents), p as (select r.doc_id, r.answer, g.url, case r.answer when 0 then 404 when 1 then 403 when 2 then 500 when 3 then null else 200 end as status from r left join pages g on r.page_id = g.page_id)
    select doc_id, case when url is null then 'none' when (status >= 200 and status < 400) or status = 403 then 'web' when doc_id % 2 = 0 then 'web_archive' else 'dead' end as source_, case when status is null then null when status < 400 then true else false end as doi_resolves from p"""


@query("documents")
def completed_reference_antijoin(d: Spark) -> str:
    """References that a second reading adds, if no known one has the surname and a year that begins like it; numbered on from the largest id."""
    year = "string" if d.name == "spark" else "varchar"
    known = f"select distinct paper_id, {d.item(d.ordered('people'), 1)} as s, coalesce(cast(year as {year}), '') as y from (select paper_id, ref_pos, year, {T.surname_tokens(d, 'authors')} as people from ({refs(d)}) x) k where ref_pos < 5"
    found = f"select paper_id, ref_id, {d.item(d.ordered('people'), 1)} as s, case when ref_id % 4 = 0 then '' else concat(coalesce(cast(year as {year}), ''), case when ref_id % 3 = 0 then 'a' else '' end) end as y from (select paper_id, ref_id, ref_pos, year, {T.surname_tokens(d, 'authors')} as people from ({refs(d)}) x) f where ref_pos >= 5"
    same = f"n.paper_id = k.paper_id and n.s = k.s and (n.y = k.y or (n.y <> '' and k.y <> '' and ({d.starts('n.y', 'k.y')} or {d.starts('k.y', 'n.y')})))"
    return f"with k as ({known}), n as ({found}), a as (select n.* from n where not exists (select 1 from k where {same})) select paper_id, ref_id, s, y, cast(4 + row_number() over (partition by paper_id order by ref_id) as bigint) as new_pos from a"


@query("customer", "orders")
def user_file_match(d: Spark) -> str:
    """A file belongs to the reference of its name, or else to one whose DOI it holds; the first file wins."""
    stem = "case when o_orderkey % 3 = 0 then concat('c', o_custkey) when o_orderkey % 3 = 1 then concat('10.1234_c', o_custkey, '_v1') else concat('scan', o_orderkey) end"
    return f"""with f as (select o_orderkey as file_no, {stem} as stem from orders), k as (select file_no, case when {d.matches("stem", "^c[0-9]+$")} then 0 else 1 end as rule_, {d.extract("stem", "c([0-9]+)", 1)} as key_ from f where stem not like 'scan%'),
    m as (select c.c_custkey, k.file_no, k.rule_, row_number() over (partition by c.c_custkey order by k.file_no) as rn from customer c join k on k.key_ = cast(c.c_custkey as {"string" if d.name == "spark" else "varchar"})) select c_custkey, file_no, rule_ from m where rn = 1"""


