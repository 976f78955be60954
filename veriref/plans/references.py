"""Queries on references: normal forms, identifiers, candidates, comparison and the existence cascade."""

from __future__ import annotations

from veriref.functions import text as T
from veriref.functions.dialect import Spark, div
from veriref.plans.base import STEPS, alike_titles, catalog, names, query, refs, similarity, sorted_words, step_of


@query("documents")
def title_normalize(d: Spark) -> str:
    """F1 F2 F3."""
    return f"select ref_id, {T.normalize_title(d, 'title')} as for_matching, {T.normalize_title(d, 'title', False)} as for_diff, {T.normalize_dedup(d, 'title')} as for_dedup from ({refs(d)}) r"


@query("documents")
def title_similarity_pairs(d: Spark) -> str:
    """Pairs of different titles that are alike; the least reference of each title stands for all that are equal (`title_classes`)."""
    if d.name == "spark":
        return "select least(a, b) as left_id, greatest(a, b) as right_id, round(max(sim), 6) as similarity from similar_titles_refs where a <> b group by 1, 2"
    return f"""with t as (select {T.normalize_title(d, "title")} as norm, min(ref_id) as ref_id from ({refs(d)}) r group by 1), s as ({alike_titles(d, False)})
    select x.ref_id as left_id, y.ref_id as right_id, round(max(s.sim), 6) as similarity from s join t x on s.a = x.norm join t y on s.b = y.norm where x.ref_id < y.ref_id group by x.ref_id, y.ref_id"""


@query("documents")
def title_classes(d: Spark) -> str:
    """The class of each reference, the least of those with the same normal title; an empty title is a class of its own."""
    return f"with r as (select ref_id, {T.normalize_title(d, 'title')} as norm from ({refs(d)}) x), c as (select norm, min(ref_id) as class_id, count(*) as n from r where norm <> '' group by norm) select r.ref_id, coalesce(c.class_id, r.ref_id) as class_id, coalesce(c.n, 1) as class_size from r left join c on r.norm = c.norm"


def _scored(d: Spark) -> str:
    """CTEs up to `scored`: each reference with the records whose titles are alike, and their scores."""
    return f"""r as (select ref_id, {T.normalize_title(d, "title")} as norm, {T.surname_tokens(d, "authors")} as people, year from ({refs(d)}) x),
    c as (select work_id, source, candidate_rank, {T.normalize_title(d, "title")} as norm, {T.surname_tokens(d, "authors")} as people, year from ({catalog(d)}) x),
    alike as ({alike_titles(d, True)}),
    p as (select r.ref_id, c.work_id, c.source, c.candidate_rank, alike.sim as title_sim, r.people as pa, c.people as pb, r.year as ya, c.year as yb from r join alike on r.norm = alike.a join c on c.norm = alike.b),
    s as (select *, {T.author_similarity(d, "pa", "pb")} as author_sim from p),
    scored as (select *, {T.composite("title_sim", f"case when {d.size('pa')} = 0 or {d.size('pb')} = 0 then 0.5e0 else author_sim end", T.year_score("ya", "yb"))} as score,
        ({d.size("pa")} > 0 and {d.size("pb")} > 0 and author_sim = 0.0e0) as disjoint_people from s)"""


def _author_part(d: Spark) -> str:
    return f"case when {d.size('pa')} = 0 or {d.size('pb')} = 0 then 0.5e0 else {T.author_similarity(d, 'pa', 'pb')} end"


def _best_by_parts(d: Spark) -> str:
    """CTEs up to `ok` for Spark: the same candidates, of which those that no reference can choose are left out before references and records are paired.

    Authors of one title are compared once for each list of people (`lists`), and of records alike in all that a score has
    only the first by rank and id counts (`parts`). A list goes with the years of its references, so what follows stays in the task that
    has the title, and one row leaves it for each title, list and year (`tops`). Where no composite score suffices, every candidate of a title is one by title alone, so its first is found once for each title."""
    return f"""r as (select ref_id, {T.normalize_title(d, "title")} as norm, {T.surname_tokens(d, "authors")} as people, year from ({refs(d)}) x),
    c as (select work_id, candidate_rank, {T.normalize_title(d, "title")} as norm, {d.ordered(T.surname_tokens(d, "authors"))} as people, year from ({catalog(d)}) x),
    alike as (select a, b, sim from similar_titles_records),
    own as (select t.id as at, r.ref_id, {d.ordered("r.people")} as people, r.year from r join titles t on r.norm = t.norm),
    works as (select t.id as at, c.work_id, c.candidate_rank, c.people, c.year from c join titles t on c.norm = t.norm),
    lists as (select at, people as pa, collect_set(named_struct('year', year)) as years from own group by at, people),
    kinds as (select at, people, year, candidate_rank, min(work_id) as work_id from works group by at, people, year, candidate_rank),
    near as (select alike.a, alike.sim, k.people, k.year, k.candidate_rank, k.work_id from alike join kinds k on alike.b = k.at),
    pairs as (select n.a, h.pa, h.years, n.sim, n.year, n.candidate_rank, n.work_id, n.people as pb from lists h join near n on h.at = n.a),
    compared as (select a, pa, years, sim, year, candidate_rank, work_id, {_author_part(d)} as author_part from pairs),
    parts as (select a, pa, sim, year, candidate_rank, author_part, min(work_id) as work_id, years from compared where author_part > 0.0e0 group by a, pa, years, sim, year, candidate_rank, author_part),
    cited as (select a, pa, explode(years) as own, sim, year, candidate_rank, author_part, work_id from parts),
    points as (select a, pa, own.year as own_year, candidate_rank, work_id, {T.composite("sim", "author_part", T.year_score("own.year", "year"))} as score from cited),
    tops as (select a, pa, own_year, min(named_struct('unlike', -score, 'candidate_rank', candidate_rank, 'work_id', work_id)) as hit from points where score >= {T.COMPOSITE} group by a, pa, own_year),
    leads as (select at, min(named_struct('candidate_rank', candidate_rank, 'work_id', work_id)) as lead from works group by at),
    firsts as (select a, min(named_struct('unlike', -sim, 'lead', lead)) as hit from alike join leads on alike.b = leads.at group by a),
    ok as (select r.ref_id, hit.work_id, hit.candidate_rank, 0 as strategy, -hit.unlike as score from own r join tops on r.at = tops.a and r.people <=> tops.pa and r.year <=> tops.own_year
        union all select r.ref_id, hit.lead.work_id, hit.lead.candidate_rank, 1 as strategy, -hit.unlike as score from own r join firsts on r.at = firsts.a)"""


@query("documents")
def best_candidate_composite(d: Spark) -> str:
    """Composite score first, title alone after it, the first of equal ones; candidates are the records with a title that is alike."""
    if d.name == "spark":
        return f"""with {_best_by_parts(d)},
        n as (select *, row_number() over (partition by ref_id order by strategy, -score, candidate_rank, work_id) as rn from ok)
        select ref_id, work_id, case when strategy = 0 then 'composite' else 'title_only' end as strategy, round(score, 6) as score from n where rn = 1"""
    return f"""with {_scored(d)},
    ok as (select *, case when score >= {T.COMPOSITE} and not disjoint_people then 0 when title_sim >= {T.TITLE_MATCH} then 1 end as strategy from scored),
    n as (select *, row_number() over (partition by ref_id order by strategy, case when strategy = 0 then -score else -title_sim end, candidate_rank, work_id) as rn from ok where strategy is not null)
    select ref_id, work_id, case when strategy = 0 then 'composite' else 'title_only' end as strategy, round(case when strategy = 0 then score else title_sim end, 6) as score from n where rn = 1"""


@query("documents")
def title_dedup_remap(d: Spark) -> str:
    """Of the references of a paper with one normal title the richest stays, and the others' citations point to it."""
    return f"""with r as (select *, {T.normalize_dedup(d, "title")} as norm,
    case when title <> '' then 1 else 0 end + 1 + case when year is not null then 1 else 0 end + case when venue <> '' then 1 else 0 end + case when doi is not null then 2 else 0 end as richness from ({refs(d)}) x),
    n as (select ref_id, ref_pos, paper_id, norm, first_value(ref_id) over (partition by {div(d, "paper_id", 20)}, case when norm = '' then cast(ref_id as {"string" if d.name == "spark" else "varchar"}) else norm end order by richness desc, ref_id) as kept_id from r)
    select ref_id, kept_id, ref_id = kept_id as stays from n"""


@query("customer", "supplier")
def author_token_jaccard(d: Spark) -> str:
    """F4 F5 F6 F7 U3 A24. Spark compares the different lists of names of a nation once, and joins the pairs to their values."""
    if d.name == "spark":
        return f"""with c as (select c_nationkey as k, c_custkey as id, {d.array(names(d, "c_custkey"), names(d, "c_custkey + c_nationkey"), names(d, "c_custkey * 3"))} as a from customer),
        s as (select s_nationkey as k, s_suppkey as id, {d.array(names(d, "s_suppkey"), names(d, "s_suppkey * 5"))} as b from supplier),
        ca as (select a, {T.surname_tokens(d, "a")} as x from (select distinct a from c) u), sb as (select b, {T.surname_tokens(d, "b")} as y from (select distinct b from s) u),
        t as (select p.k, p.a, q.b, ca.x, sb.y from (select distinct k, a from c) p join (select distinct k, b from s) q on p.k = q.k join ca on ca.a <=> p.a join sb on sb.b <=> q.b),
        v as (select k, a, b, round({T.author_similarity(d, "x", "y")}, 6) as jaccard, round({T.author_containment(d, "x", "y")}, 6) as containment, {T.is_truncation(d, "x", "y")} as truncated from t),
        w as (select s.k, s.id, v.a, v.jaccard, v.containment, v.truncated from s join v on s.k = v.k and s.b <=> v.b)
        select /*+ shuffle_hash(w) */ e.id as left_id, w.id as right_id, w.jaccard, w.containment, w.truncated from (select /*+ repartition(96, k, a) */ * from c) e join w on e.k = w.k and e.a <=> w.a"""
    return f"""with c as (select c_nationkey as k, c_custkey as id, {d.array(names(d, "c_custkey"), names(d, "c_custkey + c_nationkey"), names(d, "c_custkey * 3"))} as a from customer),
    s as (select s_nationkey as k, s_suppkey as id, {d.array(names(d, "s_suppkey"), names(d, "s_suppkey * 5"))} as b from supplier),
    t as (select c.id as left_id, s.id as right_id, {T.surname_tokens(d, "a")} as x, {T.surname_tokens(d, "b")} as y from c join s on c.k = s.k)
    select left_id, right_id, round({T.author_similarity(d, "x", "y")}, 6) as jaccard, round({T.author_containment(d, "x", "y")}, 6) as containment, {T.is_truncation(d, "x", "y")} as truncated from t"""


@query("documents")
def canonical_identifiers(d: Spark) -> str:
    """The forms of an identifier meet in one, and two sets of them are bridged."""
    return f"""with r as (select ref_id, doi from ({refs(d)}) x), c as (select work_id, doi from ({catalog(d)}) x),
    j as (select r.ref_id, r.doi as ref_doi, c.doi as db_doi from r join c on r.ref_id = c.work_id)
    select ref_id, {T.canonical_id(d, "ref_doi")} as ref_canonical, {T.canonical_id(d, "db_doi")} as db_canonical, {T.normalize_doi(d, "ref_doi")} as ref_doi, {T.normalize_doi(d, "db_doi")} as db_doi,
    coalesce({T.canonical_id(d, "ref_doi")} = {T.canonical_id(d, "db_doi")}, false) as bridged, coalesce({T.doi_prefix(d, T.normalize_doi(d, "ref_doi"), T.normalize_doi(d, "db_doi"))}, false) as prefixed from j"""


@query("orders")
def year_compare(d: Spark) -> str:
    """F12 F15."""
    return f"""with y as (select o_orderkey, case when o_orderkey % 19 = 0 then null else year(o_orderdate) end as a, year(o_orderdate) + o_orderkey % 4 as b, o_orderkey % 2 = 0 as strong from orders)
    select o_orderkey, {T.compare_year("a", "b", "strong")} as status, {T.year_score("a", "b")} as score from y"""


@query("part")
def venue_normalize_match(d: Spark) -> str:
    """F20 F21 F22 J12 P9."""
    return f"""with v as (select p_partkey, concat('Proc. of the ', p_size, 'th Int. Conf. on ', p_type, ' (', p_brand, ') 2019') as a, case when p_partkey % 3 = 0 then 'arXiv preprint' else concat('International Conference on ', p_type) end as b from part),
    n as (select p_partkey, a, b, {T.normalize_venue(d, "a")} as na, {T.normalize_venue(d, "b")} as nb from v)
    select p_partkey, na, nb, {T.venue_contained("na", "nb")} as matched, {T.is_preprint(d, "a")} <> {T.is_preprint(d, "b")} as preprint_of_publication from n"""


def _matched(d: Spark, r: str = "r", c: str = "c", s: str = "s") -> str:
    """CTEs up to `f`: the fields of references beside those of their records, compared."""
    return f"""{r} as (select * from ({refs(d)}) x), {c} as (select * from ({catalog(d)}) x),
    j as (select r.ref_id, r.paper_id, c.work_id, c.source, c.retracted, {sorted_words(d, T.normalize_title(d, "r.title"))} as ta, {sorted_words(d, T.normalize_title(d, "c.title"))} as tb, {T.surname_tokens(d, "r.authors")} as pa, {T.surname_tokens(d, "c.authors")} as pb,
        r.year as ya, c.year as yb, {T.missing("r.venue")} as va, {T.missing("c.venue")} as vb, {T.missing("r.doi")} as da, {T.missing("c.doi")} as db from {r} r join {c} c on r.ref_id = c.work_id),
    {s} as (select *, {similarity(d, "ta", "tb")} as title_sim, {T.author_similarity(d, "pa", "pb")} as author_sim, {T.normalize_venue(d, "va")} as na, {T.normalize_venue(d, "vb")} as nb, {T.normalize_doi(d, "da")} as xa, {T.normalize_doi(d, "db")} as xb from j),
    f as (select *, case when title_sim >= {T.TITLE_MATCH} then 'MATCH' else 'MISMATCH' end as title_status,
        case when {d.size("pb")} = 0 then 'MISSING' when author_sim >= {T.AUTHOR_MATCH} then 'MATCH' when {T.is_truncation(d, "pa", "pb")} then 'CLOSE_MATCH' else 'MISMATCH' end as author_status,
        case when yb is null then 'MISSING' else {T.compare_year("ya", "yb", f"title_sim >= {T.TITLE_MATCH} and author_sim >= {T.AUTHOR_MATCH}")} end as year_status,
        case when va is null or vb is null then 'MISSING' when {T.venue_contained("na", "nb")} then 'MATCH' when {T.is_preprint(d, "va")} <> {T.is_preprint(d, "vb")} then 'CLOSE_MATCH' else 'MISMATCH' end as venue_status,
        case when da is null and db is null then 'MISSING_BOTH' when da is null then 'MISSING_REF' when db is null then 'MISSING' when {T.doi_prefix(d, "xa", "xb")} or {T.canonical_id(d, "da")} = {T.canonical_id(d, "db")} then 'MATCH' else 'MISMATCH' end as doi_status from {s})"""


def _score(d: Spark) -> str:
    venue = "case when venue_status = 'MATCH' then 1.0e0 else 0.0e0 end"
    return f"round(0.5e0 * title_sim + 0.3e0 * author_sim + 0.2e0 * {venue}, 3)"


_MISMATCH = "(title_status = 'MATCH' and (author_status = 'MISMATCH' or year_status = 'MISMATCH' or venue_status = 'MISMATCH' or doi_status = 'MISMATCH'))"


@query("documents")
def metadata_field_comparison(d: Spark) -> str:
    """C1 F23 F24."""
    return f"with {_matched(d)} select ref_id, work_id, title_status, author_status, year_status, venue_status, doi_status, {_score(d)} as metadata_score, {_MISMATCH} as has_metadata_mismatch from f"


def _cascade(d: Spark, r: str = "r", c: str = "c") -> str:
    """CTEs up to `won`: the first step of J7 that hits and passes the title gate, for each reference."""
    # One join for each kind of key.
    step = step_of
    hits = " union all ".join(f"select ref_id, work_id, {step(key)} as step, source, sim, retracted from {key}_pairs where {step(key)} is not null" for key in ("doi", "title"))
    alike = f"alike as ({alike_titles(d, True)})," if d.name == "duck" else ""
    title_pairs = f"title_pairs as (select r.ref_id, c.work_id, c.source, alike.sim, c.retracted from {r} r join alike on r.norm = alike.a join {c} c on c.norm = alike.b)"
    doi_pairs = f"doi_pairs as (select r.ref_id, c.work_id, c.source, case when r.norm = c.norm then 1.0e0 else alike.sim end as sim, c.retracted from {r} r join {c} c on r.canon = c.canon left join alike on r.norm = alike.a and c.norm = alike.b)"
    if d.name == "spark":
        # All references of one title have the same hits by title, of which only the first can win; of the records of a title only the first by step and id. Pairs of titles are never shuffled: the first hit is taken where they are found.
        source = "case hit.best.step " + " ".join(f"when {n} then '{source}'" for n, source, own in STEPS if own == "title") + " end"
        title_pairs = f"""first_hits as (select a, min(named_struct('step', best.step, 'unlike', -sim, 'best', best)) as hit from similar_titles_steps where best is not null group by a),
    title_pairs as (select r.ref_id, hit.best.work_id, {source} as source, -hit.unlike as sim, hit.best.retracted from {r} r join titles t on r.norm = t.norm join first_hits on t.id = first_hits.a)"""
        # Titles under one DOI are few, and are compared by themselves.
        sim = similarity(d, *(sorted_words(d, f"case when r.norm <> c.norm then {x}.norm end") for x in "rc"))
        doi_pairs = f"doi_pairs as (select r.ref_id, c.work_id, c.source, case when r.norm = c.norm then 1.0e0 else {sim} end as sim, c.retracted from {r} r join {c} c on r.canon = c.canon)"
    return f"""{r} as (select ref_id, paper_id, {T.normalize_title(d, "title")} as norm, {T.canonical_id(d, "doi")} as canon from ({refs(d)}) x),
    {c} as (select work_id, source, retracted, {T.normalize_title(d, "title")} as norm, {T.canonical_id(d, "doi")} as canon from ({catalog(d)}) x),
    {alike}
    {title_pairs},
    {doi_pairs},
    hits as ({hits}), gated as (select * from hits),
    ranked as (select *, row_number() over (partition by ref_id order by step, sim desc, work_id) as rn from gated where sim >= {T.TITLE_MATCH}),
    won as (select ref_id, work_id, step, source, sim, retracted from ranked where rn = 1)"""


@query("documents")
def existence_cascade_first_hit(d: Spark) -> str:
    """The ordered cascade as one union of joins and a first row for each reference."""
    checked = "case when w.step is null or w.step >= 10 then 4 when w.step >= 7 then 3 else w.step - 3 end"
    return f"with {_cascade(d)} select r.ref_id, case when w.ref_id is null then 'NOT_FOUND' else 'FOUND' end as status, w.source, w.work_id, w.step, round(w.sim, 6) as similarity, {checked} as n_databases from r left join won w on r.ref_id = w.ref_id"


@query("customer", "supplier", "nation")
def cross_source_author_validation(d: Spark) -> str:
    """Authors that both sources confirm, and those that neither has."""
    return f"""with r as (select c_custkey as ref_id, c_nationkey as k, {T.surname_tokens(d, d.array(names(d, "c_custkey"), names(d, "c_custkey + 3"), names(d, "c_nationkey")))} as a from customer),
    s as (select s_nationkey as k, min(s_suppkey) as one, max(s_suppkey) as other from supplier group by s_nationkey),
    p as (select r.ref_id, n.n_name, a, {T.surname_tokens(d, d.array(names(d, "one"), names(d, "ref_id")))} as b, {T.surname_tokens(d, d.array(names(d, "other"), names(d, "ref_id + 3")))} as c from r join s on r.k = s.k join nation n on n.n_nationkey = r.k)
    select ref_id, n_name, {d.size(d.common(d.common("a", "b"), "c"))} as n_confirmed, {d.joined(d.ordered(d.kept("a", "x", "not array_contains(b, x) and not array_contains(c, x)" if d.name == "spark" else "not list_contains(b, x) and not list_contains(c, x)")), ",")} as suspects from p"""


def _verdicts(d: Spark) -> str:
    """CTEs up to `v`: the quick verdict (C2) of each reference."""
    return f"""{_cascade(d, "found_r", "found_c")},
    {_matched(d)},
    m as (select ref_id, work_id, {_MISMATCH} as mismatch, {_score(d)} as metadata_score from f),
    v as (select x.ref_id, x.paper_id, x.ref_pos, w.source, w.step, m.metadata_score,
        case when w.ref_id is null then case when x.ref_id % 37 = 0 then 'UNVERIFIABLE' else 'FABRICATED' end when coalesce(w.retracted, false) then 'FABRICATED' when coalesce(m.mismatch, false) then 'FABRICATED' else 'VALID' end as verdict,
        case when w.ref_id is null and x.ref_id % 37 = 0 then 'transient_api_failures' when w.ref_id is null then 'not_found_in_any_database' when coalesce(w.retracted, false) then 'retracted' when coalesce(m.mismatch, false) then 'metadata_mismatch' else '' end as flag
        from r x left join won w on x.ref_id = w.ref_id left join m on m.ref_id = x.ref_id and m.work_id = w.work_id)"""


@query("documents")
def quick_classify(d: Spark) -> str:
    """A missing work is fabricated only if enough databases answered."""
    return f"with {_verdicts(d)} select ref_id, verdict, flag, case when verdict = 'FABRICATED' then 'remove' else 'none' end as action from v"


@query("documents")
def quick_verdict_report(d: Spark) -> str:
    """A2 A3, the flagship: counts, integrity and risk of each paper."""
    return f"""with {_verdicts(d)},
    g as (select paper_id, count(*) as n_refs, count_if(verdict = 'VALID') as n_valid, count_if(verdict = 'FABRICATED') as n_fabricated, count_if(verdict = 'UNVERIFIABLE') as n_unverifiable, cast(coalesce(sum(cast(round(metadata_score * 1000) as bigint)), 0) as bigint) as score_milli_sum from v group by paper_id),
    h as (select *, round(coalesce(cast(n_valid as double) / nullif(n_refs - n_unverifiable, 0), 0.0e0), 3) as integrity from g)
    select *, n_refs - n_valid as n_flagged, case when integrity > 0.90 then 'LOW' when integrity > 0.70 then 'MEDIUM' when integrity > 0.50 then 'HIGH' else 'CRITICAL' end as risk from h"""


@query("documents")
def severity_order(d: Spark) -> str:
    """The worst first, then in the order of the paper."""
    return f"""with {_verdicts(d)} select paper_id, ref_id, verdict, cast(row_number() over (partition by paper_id order by case verdict when 'FABRICATED' then 0 when 'UNVERIFIABLE' then 1 when 'VALID' then 2 else 9 end, ref_pos) as bigint) as place from v"""


@query("documents", "labels")
def triage_routes(d: Spark) -> str:
    """Routes of references with and without claims; both key sets count."""
    return f"""with {_verdicts(d)}, claims as (select doc_id, quality from labels where doc_id % 2 = 0),
    k as (select coalesce(v.ref_id, c.doc_id) as ref_id, v.verdict, v.flag, c.doc_id is not null as has_claims, v.ref_id is not null as has_ref from (select * from v where ref_id % 6 <> 0) v full join claims c on v.ref_id = c.doc_id),
    t as (select *, case when not has_ref then 'UNVERIFIABLE' when flag = 'not_found_in_any_database' then 'CLEAR_FABRICATED' when flag = 'transient_api_failures' then 'UNVERIFIABLE' when flag = 'retracted' then case when has_claims then 'NEEDS_CLAIM' else 'CLEAR_FABRICATED' end
        when flag = 'metadata_mismatch' then case when has_claims then 'NEEDS_BOTH' else 'NEEDS_METADATA' end when has_claims then 'NEEDS_CLAIM' else 'CLEAR_VALID' end as route from k)
    select route, count(*) as n, count_if(has_claims) as n_with_claims from t group by route"""


@query("documents")
def resume_anti_join(d: Spark) -> str:
    """What hasn't been done yet."""
    return f"with done as (select doc_id from documents where doc_id % 3 = 0) select r.ref_id, r.title from ({refs(d)}) r left join done on r.ref_id = done.doc_id where done.doc_id is null" if d.name == "duck" else f"with done as (select doc_id from documents where doc_id % 3 = 0) select r.ref_id, r.title from ({refs(d)}) r left anti join done on r.ref_id = done.doc_id"


@query("documents", "labels")
def semi_join_refs(d: Spark) -> str:
    """Found references with a substantive claim."""
    return f"select ref_id, paper_id from ({refs(d)}) r where r.ref_id in (select doc_id from labels where quality = 1)"
