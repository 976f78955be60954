"""How a query is registered, and the references and catalogue that the queries derive from the driver's tables.

The tables hold no bibliographies, so both engines derive them by one rule: a document is a reference of the
paper doc_id div 10, its first 80 characters the title; each also is a record of one of four catalogues, in
some cases with words in another order, another year, or missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veriref.functions.dialect import DUCK, SPARK, Spark, div
from veriref.functions.similarity import duck_similarity, title_similarity
from veriref.functions.text import TITLE_MATCH, normalize_title
from veriref.operators.titles import alike, numbered
from veriref.session import cut, table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
Build = Callable[[Spark], str]


def run_sql(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    for name in tables:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    if "similar_titles_" in sql:
        _alike_views(spark, sql)
    if "title_similarity(" in sql:
        spark.udf.register("title_similarity", title_similarity)
    return spark.sql(sql)


#: Steps of the cascade that a set of tables can express: (step, source, key).
STEPS = [(4, "crossref", "doi"), (5, "semantic_scholar", "doi"), (6, "crossref", "title"), (7, "openalex", "title"), (8, "semantic_scholar", "title"), (10, "arxiv", "title")]


def step_of(key: str) -> str:
    """The step of a record that is found by `key`; it follows from the source."""
    return "case source " + " ".join(f"when '{source}' then {n}" for n, source, own in STEPS if own == key) + " end"


def _alike_views(spark: SparkSession, sql: str) -> None:
    """The views of titles that are alike which `sql` reads.

    similar_titles_refs: a, b, sim: for two titles of references the least reference of each, a pair in one order. similar_titles_records: a, b, sim: a title of references and one of records, by the
    ids of `titles` (id, norm, l, r). similar_titles_steps: the same with `best`, the record of b that comes first by step and id."""
    norm = normalize_title(SPARK, "title")
    if "similar_titles_refs" in sql:
        titles = numbered(spark.sql(f"select {norm} as norm, true as l, true as r, min(ref_id) as ref_id from ({refs(SPARK)}) x group by 1"))
        alike(titles, key="ref_id", once=True).createOrReplaceTempView("similar_titles_refs")
        return
    steps = "similar_titles_steps" in sql
    best = f", min(case when r and {step_of('title')} is not null then named_struct('step', {step_of('title')}, 'work_id', work_id, 'retracted', retracted) end) as best" if steps else ""
    own = [f"select {norm} as norm, {left} as l, {not left} as r" + (f", {'null' if left else 'source'} as source, {'null' if left else 'work_id'} as work_id, {'null' if left else 'retracted'} as retracted" if steps else "") + f" from ({rows}) x" for left, rows in ((True, refs(SPARK)), (False, catalog(SPARK)))]
    titles = numbered(spark.sql(f"select norm, bool_or(l) as l, bool_or(r) as r{best} from ({' union all '.join(own)}) x group by norm"))
    titles.createOrReplaceTempView("titles")
    pairs = alike(titles, more="best" if steps else None)
    pairs = pairs.unionAll(titles.filter("l and r").selectExpr("id as a", "id as b", "1.0D as sim", *(["best"] if steps else [])))
    # With steps a query reads the pairs once; without them, more than once.
    (pairs if steps else cut(pairs)).createOrReplaceTempView("similar_titles_steps" if steps else "similar_titles_records")


def query(*tables: str, oracle: bool = True) -> Callable[[Build], Build]:
    """Registers a function from a dialect to SQL under its own name."""

    def register(build: Build) -> Build:
        QUERIES[build.__name__] = lambda spark, sf_dir: run_sql(spark, sf_dir, build(SPARK), tables)
        if oracle:
            ORACLES[build.__name__] = build(DUCK)
        return build

    return register


def names(d: Spark, i: str) -> str:
    """An author by number."""
    people = d.array("'Smith, John'", "'Müller, Anna'", "'María García'", "'J.-P. Dupont'", "'Chen, Wei'", "'H. Kim'", "'Rossi, Carla'", "'Novák, Petr'", "'The ATLAS Collaboration'")
    return d.item(people, f"({i}) % 9 + 1")


def refs(d: Spark, source: str = "documents") -> str:
    """A SELECT of references: paper_id, ref_id, ref_pos, title, authors, year, venue, doi."""
    venues = d.array("'Proc. of the 12th Int. Conf. on Nat. Lang. (ACL 2019)'", "'arXiv preprint arXiv:1706.03762'", "'J. Comput. Sci.'", "'Nature'", "'Trans. of the Assoc. for Comput. Linguistics 2020'", "''")
    return f"""select {div(d, "doc_id", 10)} as paper_id, doc_id as ref_id, doc_id % 10 as ref_pos, trim(substring(text, 1, 80)) as title,
    {d.array(names(d, "doc_id"), names(d, div(d, "doc_id", 9)), names(d, f"doc_id * 7 + {div(d, 'doc_id', 5)}"))} as authors,
    case when doc_id % 41 = 0 then null else 2000 + doc_id % 25 end as year, {d.item(venues, "doc_id % 6 + 1")} as venue,
    case doc_id % 3 when 0 then concat('10.1234/work_', doc_id) when 1 then concat('https://doi.org/10.48550/arXiv.', 1000 + doc_id % 9000, '.', 10000 + doc_id) else null end as doi from {source}"""


def catalog(d: Spark, source: str = "documents") -> str:
    """A SELECT of records: source, work_id, title, authors, year, venue, doi, retracted, candidate_rank."""
    reversed_title = f"concat({d.extract('trim(substring(text, 1, 80))', '([^ ]+)$', 1)}, ' ', {d.replace('trim(substring(text, 1, 80))', ' ?[^ ]+$', '')})"
    return f"""select case doc_id % 4 when 0 then 'crossref' when 1 then 'openalex' when 2 then 'semantic_scholar' else 'arxiv' end as source, doc_id as work_id,
    case when doc_id % 7 = 0 then {reversed_title} when doc_id % 13 = 0 then concat('An unrelated work ', doc_id) else trim(substring(text, 1, 80)) end as title,
    case when doc_id % 17 = 0 then {d.array(names(d, "doc_id + 4"))} else {d.array(names(d, "doc_id"), names(d, div(d, "doc_id", 9)), names(d, f"doc_id * 7 + {div(d, 'doc_id', 5)}"))} end as authors,
    2000 + doc_id % 25 + case when doc_id % 5 = 0 then 1 when doc_id % 23 = 0 then 4 else 0 end as year,
    case when doc_id % 4 = 3 then 'arXiv' when doc_id % 6 = 3 then 'Nature' when doc_id % 6 = 2 then 'Journal of Computational Science' else 'Proceedings of the International Conference on Natural Language' end as venue,
    case when doc_id % 3 = 0 then concat('10.1234/WORK_', doc_id, '.full') when doc_id % 3 = 1 then concat('arxiv:', 1000 + doc_id % 9000, '.', 10000 + doc_id) end as doi,
    case when doc_id % 29 = 0 then true when doc_id % 4 = 0 then false end as retracted, doc_id % 5 as candidate_rank
    from {source} where doc_id % 11 <> 0"""


def similarity(d: Spark, a: str, b: str) -> str:
    """Of two columns that hold titles with their words sorted (`sorted_words`)."""
    return duck_similarity(a, b) if d.name == "duck" else f"title_similarity({a}, {b})"


def sorted_words(d: Spark, x: str) -> str:
    return d.joined(d.ordered(d.split(x, " ")), " ")


def alike_titles(d: Spark, records: bool) -> str:
    """A SELECT of a, b, sim for DuckDB: normal titles of references and of records (or of references) that are alike, by every pair whose lengths and letters allow it. Spark has views of the operator's pairs (`_alike_views`)."""
    letters = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789 ', ''), lambda c: length(norm) - length(replace(norm, c, '')))"
    side = lambda rows: f"(select norm, {sorted_words(d, 'norm')} as words, {letters} as bag from (select distinct {normalize_title(d, 'title')} as norm from ({rows}) t) u where norm <> '')"
    bound = f"2.0e0 * least(length(x.norm), length(y.norm)) >= {TITLE_MATCH} * (length(x.norm) + length(y.norm)) and list_sum(list_transform(list_zip(x.bag, y.bag), lambda z: abs(z[1] - z[2]))) <= {1 - TITLE_MATCH} * (length(x.norm) + length(y.norm)) + 1e-9"
    return f"select a, b, sim from (select a, b, {duck_similarity('wa', 'wb')} as sim from (select x.norm as a, y.norm as b, x.words as wa, y.words as wb from {side(refs(d))} x join {side(catalog(d) if records else refs(d))} y on {bound}) p) q where sim >= {TITLE_MATCH}"
