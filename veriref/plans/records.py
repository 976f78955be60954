"""Queries on the answers of catalogues: composed from the documents, read by the operator, and held against what they were composed of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriref.operators import records
from veriref.plans.base import ORACLES, QUERIES
from veriref.session import table

#: The title that answers are composed of, in either engine: signs that would need another escape in XML are left out.
_TITLE = "trim(regexp_replace(substring(coalesce(text, ''), 1, 80), '[^A-Za-z0-9]+', ' '{flags}))"
_BROKEN = "doc_id % 41 = 0"


def _register(name: str, read: Callable[[DataFrame, str], DataFrame], answer: str, expected: dict[str, str]) -> None:
    """answer: SQL of Spark for the text of an answer; expected: SQL of DuckDB for what it says, by field."""
    fields = ["title", "authors", "year", "venue", "venue_aliases", "doi", "arxiv_id", "pmid", "abstract", "oa_url", "retracted", "type"]
    lists = ("authors", "venue_aliases")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_TITLE.format(flags='')} as t")
        answers = docs.selectExpr("doc_id", f"case when {_BROKEN} then '{{broken <' else {answer} end as answer")
        own = read(answers, "answer")
        return own.select("doc_id", "source", "unreadable", *[(F.array_join(F.col("record")[x], "|") if x in lists else F.col("record")[x]).alias(x) for x in fields])

    QUERIES[f"{name}_records"] = run
    said = ", ".join(f"case when {_BROKEN} then null else {expected.get(x, 'null')} end as {x}" for x in fields)
    ORACLES[f"{name}_records"] = f"select doc_id, '{name}' as source, {_BROKEN} as unreadable, {said} from (select doc_id, {_TITLE.format(flags=', ' + chr(39) + 'g' + chr(39))} as t from documents) d"


_YEAR = "1990 + doc_id % 30"
_DATE = "named_struct('date-parts', array(array(cast({} as int), 5)))"
_register(
    "crossref",
    records.crossref,
    f"""to_json(named_struct('title', if(doc_id % 5 = 0, array(), array(t)), 'author', array(named_struct('given', 'Ada', 'family', concat('L', doc_id)), named_struct('given', cast(null as string), 'family', 'Solo'), named_struct('given', '', 'family', '')),
    'published-print', if(doc_id % 4 = 0, {_DATE.format(_YEAR)}, null), 'published-online', if(doc_id % 4 <= 1, {_DATE.format(_YEAR + " + 1")}, null), 'issued', if(doc_id % 4 <= 2, {_DATE.format(_YEAR + " + 2")}, null), 'container-title', array('Venue', 'Other'), 'DOI', concat('10.1/', doc_id),
    'type', if(doc_id % 37 = 0, 'retraction', 'journal-article'), 'update-to', if(doc_id % 29 = 0, array(named_struct('type', 'correction'), named_struct('type', 'retraction')), null), 'relation', if(doc_id % 31 = 0, named_struct('is-retracted-by', array(named_struct('id', 'x'))), null)))""",
    {"title": "case when doc_id % 5 = 0 then '' else t end", "authors": "'Ada L' || doc_id || '|Solo'", "year": f"case doc_id % 4 when 0 then {_YEAR} when 1 then {_YEAR} + 1 when 2 then {_YEAR} + 2 end", "venue": "'Venue'", "venue_aliases": "null", "doi": "'10.1/' || doc_id", "retracted": "doc_id % 37 = 0 or doc_id % 29 = 0 or doc_id % 31 = 0", "type": "case when doc_id % 37 = 0 then 'retraction' else 'journal-article' end"},
)
_register(
    "openalex",
    records.openalex,
    f"""to_json(named_struct('title', t, 'authorships', array(named_struct('author', named_struct('display_name', 'Ada L')), named_struct('author', named_struct('display_name', cast(null as string)))), 'publication_year', cast({_YEAR} as int), 'doi', if(doc_id % 3 = 0, null, concat('https://doi.org/10.1/', doc_id)),
    'primary_location', if(doc_id % 7 = 0, null, named_struct('is_oa', doc_id % 2 = 0, 'landing_page_url', concat('https://p/', doc_id), 'source', named_struct('display_name', 'Venue', 'alternate_titles', array('V.', 'Ven')))), 'best_oa_location', named_struct('landing_page_url', concat('https://b/', doc_id)), 'abstract_inverted_index', map('again', array(1, 3), 'one', array(0), 'two', array(2))))""",
    {"title": "t", "authors": "'Ada L'", "year": _YEAR, "venue": "case when doc_id % 7 = 0 then '' else 'Venue' end", "venue_aliases": "case when doc_id % 7 = 0 then '' else 'Venue|V.|Ven' end", "doi": "case when doc_id % 3 <> 0 then '10.1/' || doc_id end", "abstract": "'one again two again'", "oa_url": "case when doc_id % 7 <> 0 and doc_id % 2 = 0 then 'https://p/' || doc_id else 'https://b/' || doc_id end"},
)
_register(
    "semantic_scholar",
    records.semantic_scholar,
    f"""to_json(named_struct('title', t, 'authors', array(named_struct('name', 'Ada L'), named_struct('name', ''), named_struct('name', 'Bo')), 'year', cast({_YEAR} as int), 'venue', 'V', 'abstract', if(doc_id % 2 = 0, t, null), 'externalIds', if(doc_id % 5 = 0, null, named_struct('DOI', concat('10.1/', doc_id), 'ArXiv', '1706.03762')), 'openAccessPdf', named_struct('url', 'https://x/p.pdf'), 'publicationVenue', if(doc_id % 3 = 0, null, named_struct('name', 'Venue', 'alternate_names', array('V')))))""",
    {"title": "t", "authors": "'Ada L|Bo'", "year": _YEAR, "venue": "'V'", "venue_aliases": "case when doc_id % 3 = 0 then '' else 'Venue|V' end", "doi": "case when doc_id % 5 <> 0 then '10.1/' || doc_id end", "arxiv_id": "case when doc_id % 5 <> 0 then '1706.03762' end", "abstract": "case when doc_id % 2 = 0 then t end", "oa_url": "'https://x/p.pdf'"},
)
_register(
    "openreview",
    records.openreview,
    f"""case when doc_id % 2 = 0 then to_json(named_struct('id', concat('n', doc_id), 'forum', concat('f', doc_id), 'cdate', 1546300800000 + doc_id % 5 * 31536000000, 'content', named_struct('title', named_struct('value', t), 'authors', named_struct('value', array('Ada L', 'Bo')), 'venue', named_struct('value', 'ICLR'), 'pdf', named_struct('value', if(doc_id % 4 = 0, '/pdf/a.pdf', 'https://z/a.pdf')))))
    else to_json(named_struct('id', concat('n', doc_id), 'content', named_struct('title', t, 'authors', 'Ada L, Bo, ', 'abstract', 'said'))) end""",
    {"title": "t", "authors": "'Ada L|Bo'", "year": "case when doc_id % 2 = 0 then year(date '2019-01-01' + (doc_id % 5 * 365)::int) end", "venue": "case when doc_id % 2 = 0 then 'ICLR' else 'OpenReview' end", "abstract": "case when doc_id % 2 = 1 then 'said' end", "oa_url": "case doc_id % 4 when 0 then 'https://openreview.net/pdf/a.pdf' when 2 then 'https://z/a.pdf' else 'https://openreview.net/pdf?id=n' || doc_id end"},
)
_register(
    "pubmed",
    records.pubmed,
    f"""concat('<PubmedArticle><MedlineCitation><PMID>', doc_id, '</PMID><Article><ArticleTitle> T', t, '</ArticleTitle><Journal><Title>Venue &amp; Co</Title><JournalIssue><PubDate>', if(doc_id % 3 = 0, concat('<MedlineDate>Spring ', {_YEAR}, '-Summer</MedlineDate>'), concat('<Year>', {_YEAR}, '</Year>')), '</PubDate></JournalIssue></Journal>',
    '<AuthorList><Author><LastName>L</LastName><ForeName>Ada</ForeName></Author><Author><LastName>Bo</LastName><Initials>C</Initials></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList><Abstract><AbstractText>One.</AbstractText><AbstractText> Two. </AbstractText></Abstract></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">1</ArticleId>', if(doc_id % 2 = 0, concat('<ArticleId IdType="doi">10.1/', doc_id, '</ArticleId>'), ''), '</ArticleIdList></PubmedData></PubmedArticle>')""",
    {"title": "trim('T' || t)", "authors": "'Ada L|C Bo'", "year": _YEAR, "venue": "'Venue & Co'", "pmid": "doc_id::varchar", "abstract": "'One. Two.'", "doi": "case when doc_id % 2 = 0 then '10.1/' || doc_id end"},
)
_register(
    "arxiv",
    records.arxiv,
    f"""concat('<entry xmlns="http://www.w3.org/2005/Atom"><id>http://arxiv.org/abs/', if(doc_id % 3 = 0, 'cs/', '1706.03762v'), doc_id, '</id><published>', {_YEAR}, '-06-12T00:00:00Z</published><title>T', t, '\n  end</title><summary> It  is\nsaid </summary><author><name>Ada L</name></author><author><name> Bo </name></author><link title="doi" href="http://dx.doi.org/10.1/', doc_id, '"/></entry>')""",
    {"title": "trim('T' || t) || ' end'", "authors": "'Ada L|Bo'", "year": _YEAR, "venue": "'arXiv'", "abstract": "'It is said'", "arxiv_id": "case when doc_id % 3 <> 0 then '1706.03762' end", "doi": "case when doc_id % 3 <> 0 then '10.48550/arXiv.1706.03762' else '10.1/' || doc_id end"},
)
