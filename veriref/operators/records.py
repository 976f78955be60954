"""Answers of catalogues as rows: one function for each service, on columns of JSON or XML text.

All return source, title, authors, year, venue, venue_aliases, doi, arxiv_id, pmid, abstract, oa_url, retracted and type,
null where a service doesn't say. A text that can't be read gives a row of nulls with `unreadable`, so none is lost.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

FIELDS = ["title", "authors", "year", "venue", "venue_aliases", "doi", "arxiv_id", "pmid", "abstract", "oa_url", "retracted", "type"]
_TYPES = {"authors": "array<string>", "venue_aliases": "array<string>", "year": "int", "retracted": "boolean"}
_DATES = "struct<`date-parts`: array<array<int>>>"
#: Fields of the services' answers (fixed values).
CROSSREF = f"title array<string>, author array<struct<given: string, family: string>>, `published-print` {_DATES}, `published-online` {_DATES}, issued {_DATES}, `container-title` array<string>, DOI string, type string, `update-to` array<struct<type: string>>, relation struct<`is-retracted-by`: array<struct<id: string>>>"
OPENALEX = "title string, authorships array<struct<author: struct<display_name: string>>>, publication_year int, doi string, primary_location struct<is_oa: boolean, landing_page_url: string, source: struct<display_name: string, alternate_titles: array<string>>>, best_oa_location struct<landing_page_url: string>, abstract_inverted_index map<string, array<int>>"
SEMANTIC_SCHOLAR = "title string, authors array<struct<name: string>>, year int, venue string, abstract string, externalIds struct<DOI: string, ArXiv: string, ACL: string>, openAccessPdf struct<url: string>, publicationVenue struct<name: string, alternate_names: array<string>>"


def _rows(df: DataFrame, source: str, ok: Column, **fields: Column) -> DataFrame:
    """df with `source`, the common fields in a struct `record`, and `unreadable`."""
    own = F.struct(*[F.when(ok, fields[x] if x in fields else F.lit(None)).cast(_TYPES.get(x, "string")).alias(x) for x in FIELDS])
    return df.withColumns({"source": F.lit(source), "record": own, "unreadable": ~F.coalesce(ok, F.lit(False))})


def _present(values: Column) -> Column:
    return F.filter(values, lambda x: F.length(F.coalesce(x, F.lit(""))) > 0)


def crossref(df: DataFrame, col: str) -> DataFrame:
    """A work of Crossref. The year is that of print, else online, else issue; a work is retracted if an update, its type or a relation says so."""
    j = F.from_json(F.col(col), CROSSREF)
    of = lambda name: j[name]["date-parts"]
    dates = F.coalesce(of("published-print"), of("published-online"), of("issued"))
    year = F.get(F.get(dates, F.lit(0)), F.lit(0))
    authors = _present(F.transform(j["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))))
    retracted = F.coalesce(F.exists(j["update-to"], lambda u: F.coalesce(u["type"] == "retraction", F.lit(False))), F.lit(False)) | F.coalesce(j["type"] == "retraction", F.lit(False)) | (F.coalesce(F.size(j["relation"]["is-retracted-by"]), F.lit(0)) > 0)
    first = lambda xs: F.coalesce(F.get(xs, F.lit(0)), F.lit(""))
    return _rows(df, "crossref", F.get_json_object(col, "$").isNotNull(), title=first(j["title"]), authors=F.coalesce(authors, F.array().cast("array<string>")), year=F.when(year != 0, year), venue=first(j["container-title"]), doi=j["DOI"], retracted=retracted, type=j["type"])


def abstract_of(index: Column) -> Column:
    """A text from the places of its words; of two words at one place the later counts."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("place"), e["key"].alias("word")))))
    return F.when(F.size(places) > 0, F.array_join(F.transform(F.array_sort(places), lambda x: x["word"]), " "))


def openalex(df: DataFrame, col: str) -> DataFrame:
    """A work of OpenAlex, with the other names of its venue."""
    j = F.from_json(F.col(col), OPENALEX)
    place = j["primary_location"]
    source = place["source"]
    aliases = F.concat(F.when(F.length(source["display_name"]) > 0, F.array(source["display_name"])).otherwise(F.array().cast("array<string>")), F.coalesce(source["alternate_titles"], F.array().cast("array<string>")))
    open_ = F.coalesce(F.when(place["is_oa"], F.nullif(place["landing_page_url"], F.lit(""))), j["best_oa_location"]["landing_page_url"])
    return _rows(df, "openalex", F.get_json_object(col, "$").isNotNull(), title=j["title"], authors=_present(F.transform(j["authorships"], lambda a: a["author"]["display_name"])), year=j["publication_year"], venue=F.coalesce(source["display_name"], F.lit("")), venue_aliases=F.coalesce(aliases, F.array().cast("array<string>")), doi=F.nullif(F.replace(j["doi"], F.lit("https://doi.org/"), F.lit("")), F.lit("")), abstract=abstract_of(j["abstract_inverted_index"]), oa_url=open_)


def semantic_scholar(df: DataFrame, col: str) -> DataFrame:
    j = F.from_json(F.col(col), SEMANTIC_SCHOLAR)
    venue = j["publicationVenue"]
    empty = F.array().cast("array<string>")
    aliases = F.concat(F.when(F.length(venue["name"]) > 0, F.array(venue["name"])).otherwise(empty), F.coalesce(venue["alternate_names"], empty))
    return _rows(df, "semantic_scholar", F.get_json_object(col, "$").isNotNull(), title=j["title"], authors=_present(F.transform(j["authors"], lambda a: a["name"])), year=j["year"], venue=F.coalesce(j["venue"], F.lit("")), venue_aliases=aliases, doi=j["externalIds"]["DOI"], arxiv_id=j["externalIds"]["ArXiv"], abstract=j["abstract"], oa_url=j["openAccessPdf"]["url"])


def openreview(df: DataFrame, col: str) -> DataFrame:
    """A note of OpenReview, whose fields are plain or {value: ...}; authors are a list or one text with commas."""

    def field(name: str) -> Column:
        whole = F.get_json_object(col, f"$.content.{name}")
        return F.when(F.trim(whole).startswith("{"), F.get_json_object(col, f"$.content.{name}.value")).otherwise(whole)

    listed = F.when(F.trim(field("authors")).startswith("["), F.from_json(field("authors"), "array<string>")).otherwise(_present(F.transform(F.split(field("authors"), ","), lambda x: F.trim(x))))
    forum = F.coalesce(F.nullif(F.get_json_object(col, "$.forum"), F.lit("")), F.get_json_object(col, "$.id"))
    pdf, site = F.nullif(field("pdf"), F.lit("")), F.lit("https://openreview.net")
    url = F.when(pdf.startswith("http"), pdf).when(pdf.startswith("/"), F.concat(site, pdf)).when(pdf.isNotNull(), F.concat(site, F.lit("/"), pdf)).otherwise(F.concat(site, F.lit("/pdf?id="), forum))
    millis = F.expr(f"try_cast(get_json_object(`{col}`, '$.cdate') as bigint)")
    return _rows(df, "openreview", F.get_json_object(col, "$").isNotNull(), title=F.coalesce(field("title"), F.lit("")), authors=F.coalesce(listed, F.array().cast("array<string>")), year=F.when(millis > 0, F.year(F.timestamp_millis(millis))), venue=F.coalesce(F.nullif(field("venue"), F.lit("")), F.lit("OpenReview")), abstract=field("abstract"), oa_url=url)


#: Where an element of a PubmedArticle, or of an Atom feed without its namespaces, has each field (fixed values).
PUBMED = {"title": ".//ArticleTitle", "venue": ".//Journal/Title", "pmid": ".//PMID", "abstract": ".//AbstractText", "doi": ".//ArticleIdList/ArticleId[@IdType='doi']", "dates": ".//PubDate/Year|.//PubDate/MedlineDate"}
ARXIV = {"title": "title", "abstract": "summary", "dates": "published", "arxiv_id": "id"}
_XML = StructType([StructField(x, ArrayType(StringType()) if x == "authors" else IntegerType() if x == "year" else StringType()) for x in ("title", "authors", "year", "venue", "doi", "arxiv_id", "pmid", "abstract")])


def _texts(root: ElementTree.Element, paths: str) -> list[str]:
    return [" ".join(e.text.split()) for path in paths.split("|") for e in root.findall(path) if e.text and e.text.strip()]


def _element(text: str | None, name: str) -> ElementTree.Element | None:
    """The element, its names without namespaces; null if the text isn't XML or another element."""
    try:
        root = ElementTree.fromstring(text or "")
    except ElementTree.ParseError:
        return None
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root if root.tag == name else None


def _fields(root: ElementTree.Element, paths: dict[str, str]) -> dict:
    out: dict = {k: " ".join(found) if k == "abstract" else found[0] for k, path in paths.items() if k != "dates" and (found := _texts(root, path))}
    years = [m[0] for date in _texts(root, paths["dates"]) if (m := re.search(r"\d{4}", date))]
    return out | {"year": int(years[0]) if years else None}


def _pubmed(text: str | None) -> dict | None:
    root = _element(text, "PubmedArticle")
    if root is None or not _texts(root, PUBMED["title"]):
        return None
    people = ((a.findtext("ForeName") or a.findtext("Initials") or "", a.findtext("LastName") or "") for a in root.findall(".//Author"))
    return _fields(root, PUBMED) | {"authors": [x for x in (" ".join(p).strip() for p in people) if x]}


def _arxiv(text: str | None) -> dict | None:
    root = _element(text, "entry")
    if root is None or not _texts(root, ARXIV["title"]):
        return None
    out = _fields(root, ARXIV) | {"authors": _texts(root, "author/name"), "venue": "arXiv"}
    known = re.search(r"\d{4}\.\d{4,5}", out.pop("arxiv_id", ""))
    linked = (re.search(r"doi\.org/(.+)", e.get("href", "")) for e in root.findall("link[@title='doi']"))
    return out | ({"arxiv_id": known[0], "doi": f"10.48550/arXiv.{known[0]}"} if known else {"doi": next((m[1] for m in linked if m), None)})


def _parsed(parse: Callable[[str | None], dict | None], col: str) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = {f.name: pa.list_(pa.string()) if f.name == "authors" else pa.int32() if f.name == "year" else pa.string() for f in _XML}
        for batch in batches:
            rows = [parse(x) for x in batch.to_pylist()]
            columns = [pa.array([r.get(k) if r else None for r in rows], kind) for k, kind in kinds.items()]
            yield pa.StructArray.from_arrays(columns, names=list(kinds), mask=pa.array([r is None for r in rows]))

    return arrow_udf(run, _XML).asNondeterministic()(F.col(col))


def _xml(df: DataFrame, col: str, source: str, parse: Callable[[str | None], dict | None]) -> DataFrame:
    out = df.withColumn("_own", _parsed(parse, col))
    own = F.col("_own")
    return _rows(out, source, own.isNotNull(), **{f.name: own[f.name] for f in _XML}).drop("_own")


def pubmed(df: DataFrame, col: str) -> DataFrame:
    """A PubmedArticle; where no year is given, the first number of four digits in the Medline date. One without a title is unreadable."""
    return _xml(df, col, "pubmed", _pubmed)


def arxiv(df: DataFrame, col: str) -> DataFrame:
    """An entry of an Atom feed; its DOI is the one that arXiv gives to every paper, else that of a link."""
    return _xml(df, col, "arxiv", _arxiv)
