"""Queries of corpus analytics: roll-ups, rates, samples, significance, limits, jobs and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriref.functions import text as T
from veriref.functions.dialect import SPARK, Spark, div, quoted
from veriref.operators.stats import bootstrap_interval
from veriref.plans.base import QUERIES, query, refs, run_sql


def _hash(d: Spark, x: str, n: int) -> str:
    """A number below n by arithmetic alone, the same in any engine."""
    return f"(({x} * 2654435761 + 42) % 4294967296 % {n})"


@query("conversations", "labels")
def claim_rollup(d: Spark) -> str:
    """The claims of a reference are rolled up by any and all."""
    return f"""with s as (select conv_id, case when role = 'system' then 'ERROR' when (conv_id + turn) % 11 = 0 then 'CONTRADICTS' when (conv_id + turn) % 7 = 0 then 'NEUTRAL' else 'SUPPORTS' end as claim from conversations)
    select conv_id, count(*) as n_claims, case when max(case when claim = 'ERROR' then 1 else 0 end) = 1 then 'UNVERIFIABLE' when max(case when claim = 'CONTRADICTS' then 1 else 0 end) = 1 then 'CONTRADICTS' when max(case when claim = 'NEUTRAL' then 1 else 0 end) = 1 then 'NEUTRAL' else 'SUPPORTED' end as verdict from s group by conv_id"""


@query("documents", "labels")
def verdict_merge(d: Spark) -> str:
    """Metadata and claim verdicts in one; the metadata's decides, a contradicted claim asks for a look."""
    return """with m as (select d.doc_id as ref_id, case when d.doc_id % 8 = 0 then 'FABRICATED' when d.doc_id % 9 = 0 then null else 'VALID' end as metadata_verdict, case l.toxic when 1 then 'CONTRADICTS' when 0 then 'SUPPORTED' end as claim_verdict, d.doc_id % 50 = 0 as retracted from documents d left join labels l on d.doc_id = l.doc_id)
    select ref_id, coalesce(case when retracted then 'FABRICATED' end, metadata_verdict, 'UNVERIFIABLE') as verdict, claim_verdict,
    case when retracted or metadata_verdict = 'FABRICATED' then 'remove' when claim_verdict = 'CONTRADICTS' then 'verify_claim' else 'none' end as action,
    concat_ws(';', case when retracted then 'retracted' end, case when metadata_verdict is null then 'agent_failed' end, case when claim_verdict = 'CONTRADICTS' then 'claim_contradicted' end) as flags from m"""


@query("documents", "labels")
def coverage_counts(d: Spark) -> str:
    """A4: once for each reference."""
    return "select count_if(l.quality = 1) as full_text, count_if(l.quality = 0) as abstract_only, count_if(l.quality is null) as not_found, count(*) as n_refs, round(100.0e0 * count_if(l.quality = 1) / count(*), 2) as full_text_pct from documents d left join labels l on d.doc_id = l.doc_id"


@query("orders")
def batch_rollup(d: Spark) -> str:
    """Each paper and all papers in one pass."""
    return "select o_custkey as paper_id, grouping(o_custkey) = 1 as is_total, count(*) as n, count_if(o_orderstatus = 'F') as n_valid, count_if(o_orderstatus = 'O') as n_fabricated, count_if(o_orderstatus = 'P') as n_unverifiable from orders group by rollup (o_custkey)"


@query("orders")
def api_summary(d: Spark) -> str:
    """A5 A21."""
    return "select o_orderstatus as verdict, count(*) as n, count(distinct o_custkey) as n_papers from orders group by o_orderstatus"


@query("lineitem", "orders")
def corpus_funnel(d: Spark) -> str:
    """Total, found, full text and in scope in one pass, with their shares."""
    return """with i as (select l_orderkey, l_linestatus = 'F' as found, l_linestatus = 'F' and l_returnflag <> 'N' as full_text, case when l_quantity > 45 then 'CONTRADICTS' when l_quantity > 30 then 'NEUTRAL' when l_quantity > 2 then 'SUPPORTS' end as verdict from lineitem),
    s as (select i.*, full_text and verdict is not null as in_scope, o_orderpriority from i join orders on l_orderkey = o_orderkey)
    select count(*) as total, count_if(found) as n_found, count_if(full_text) as n_full_text, count_if(in_scope) as n_in_scope, round(100.0e0 * count_if(found) / count(*), 2) as found_pct, round(100.0e0 * count_if(in_scope) / count(*), 2) as in_scope_pct,
    count_if(in_scope and verdict = 'CONTRADICTS') as n_misrep, round(100.0e0 * count_if(in_scope and verdict = 'CONTRADICTS') / nullif(count_if(in_scope), 0), 4) as misrep_pct, count(distinct l_orderkey) as n_papers from s"""


def _strata(d: Spark) -> str:
    return f"""with s as (select o_orderpriority as decision, {T.year_band("(year(o_orderdate) + 27)")} as band, l_returnflag as text_source, case when l_quantity > 48 then 1 else 0 end as misrep from lineitem join orders on l_orderkey = o_orderkey where l_linestatus = 'F')
    select decision, band, text_source, count(*) as n, cast(sum(misrep) as bigint) as k from s group by grouping sets ((decision), (band), (text_source))"""


@query("lineitem", "orders")
def stratified_rates(d: Spark) -> str:
    """Rates of three strata by grouping sets; `stratified_intervals` adds the intervals."""
    return f"select decision, band, text_source, n, k as n_misrep, round(1.0e0 * k / n, 6) as rate from ({_strata(d)}) g"


def stratified_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with bootstrapped intervals, for strata of 30 cases or more; draws can't be SQL."""
    found = bootstrap_interval(run_sql(spark, sf_dir, _strata(SPARK), ("lineitem", "orders")))
    return found.select("decision", "band", "text_source", "n", F.col("k").alias("n_misrep"), *[F.when(F.col("n") >= 30, F.col(x)).alias(x) for x in ("ci_low", "ci_high")], "rate")


QUERIES["stratified_intervals"] = stratified_intervals


@query("lineitem")
def per_order_rate_stats(d: Spark) -> str:
    """Rates of papers, then their median and range."""
    return """with p as (select l_orderkey, count(*) as n, count_if(l_quantity > 40) as k from lineitem group by l_orderkey), r as (select *, 100.0e0 * k / n as rate from p)
    select count(*) as n_papers, round(median(rate), 6) as median_rate, round(min(rate), 6) as min_rate, round(max(rate), 6) as max_rate, count_if(rate = 0) as n_clean from r"""


@query("labels")
def confusion_metrics(d: Spark) -> str:
    """Counts and measures of each class from one pass."""
    return """with p as (select doc_id, quality as gold, case when doc_id % 9 = 0 then 1 - quality when doc_id % 31 = 0 then null else quality end as pred from labels),
    c as (select k.cls, count_if(gold = cls and pred = cls) as tp, count_if(coalesce(gold <> cls, true) and pred = cls) as fp, count_if(gold = cls and coalesce(pred <> cls, true)) as fn, count(*) as n from p join (select 0 as cls union all select 1 as cls) k on true group by k.cls)
    select cls, tp, fp, fn, round(coalesce(1.0e0 * tp / nullif(tp + fp, 0), 0.0e0), 3) as precision_, round(coalesce(1.0e0 * tp / nullif(tp + fn, 0), 0.0e0), 3) as recall_, round(coalesce(2.0e0 * tp / nullif(2 * tp + fp + fn, 0), 0.0e0), 3) as f1 from c where tp + fp + fn > 0"""


@query("labels", "documents")
def mcnemar_holm(d: Spark) -> str:
    """Discordant pairs by stratum; exact two-sided binomial below 25 of them, chi-square with continuity from there (its tail by a rational approximation of the normal, 7e-8); then Holm's step-down by running maximum."""
    z = "sqrt(chi2)"
    t = f"(1.0e0 / (1.0e0 + 0.2316419e0 * {z}))"
    poly = f"({t} * (0.319381530e0 + {t} * (-0.356563782e0 + {t} * (1.781477937e0 + {t} * (-1.821255978e0 + {t} * 1.330274429e0)))))"
    tail = f"least(2.0e0 * exp(-chi2 / 2.0e0) / sqrt(2.0e0 * pi()) * {poly}, 1.0e0)"
    if d.name == "spark":  # each term from the one before
        exact = "aggregate(sequence(0, cast(least(b, c) as int)), named_struct('t', pow(0.5D, b + c), 's', 0.0D), (a, k) -> named_struct('t', a.t * (b + c - k) / (k + 1), 's', a.s + a.t), a -> least(2 * a.s, 1.0D))"
    else:
        exact = "least(2 * list_sum(list_transform(range(0, least(b, c)::bigint + 1), lambda k: factorial((b + c)::int)::double / factorial(k::int)::double / factorial((b + c - k)::int)::double)) * pow(0.5, b + c), 1.0)"
    return f"""with v as (select source, case when l.doc_id % 5 = 0 then 1 - quality else quality end = quality as one_right, case when l.doc_id % 3 = 0 then 1 - quality else quality end = quality as other_right from labels l join documents d on l.doc_id = d.doc_id),
    s as (select source, count_if(one_right and not other_right) as b, count_if(not one_right and other_right) as c from v group by source union all select '(all)' as source, count_if(one_right and not other_right) as b, count_if(not one_right and other_right) as c from v),
    x as (select *, case when b + c = 0 then 0.0e0 else pow(greatest(abs(b - c) - 1, 0), 2) / (b + c) end as chi2 from s), q as (select *, case when b + c = 0 then 1.0e0 when b + c < 25 then {exact} when chi2 = 0 then 1.0e0 else {tail} end as p from x),
    h as (select *, count(*) over () as m, row_number() over (order by p, source) as rn from q)
    select source, b, c, b + c < 25 as exact_, round(chi2, 6) as chi2, round(p, 6) as p, round(least(max((m - rn + 1) * p) over (order by p, source rows between unbounded preceding and current row), 1.0e0), 6) as p_holm from h"""


@query("labels", "documents")
def stratified_sample(d: Spark) -> str:
    """Of each stratum the first few by a hash of id and seed."""
    return f"with s as (select l.doc_id, l.quality, d.source, row_number() over (partition by l.quality, d.source order by {_hash(d, 'l.doc_id', 1000003)}, l.doc_id) as rn from labels l join documents d on l.doc_id = d.doc_id) select doc_id, quality, source, cast(rn as bigint) as rn from s where rn <= 5"


@query("events")
def spend_ledger(d: Spark) -> str:
    """Spend by month, and whether it reached the budget."""
    month = "date_format(ts, 'yyyy-MM')" if d.name == "spark" else "strftime(ts, '%Y-%m')"
    return f"""with m as (select {month} as month_, event_type, value * 0.15e0 / 1000 as usd from events where value is not null)
    select month_, round(sum(usd), 4) as total_usd, count(*) as calls, count(distinct event_type) as n_stages, sum(usd) >= 5 as over_budget from m group by month_"""


@query("events")
def sliding_rate_limit(d: Spark) -> str:
    """W9 T2 by attempts: how many calls of the same client lie in the last hour."""
    return "with c as (select event_id, user_id, count(*) over (partition by user_id order by ts range between interval '1' hour preceding and current row) as in_hour from events) select event_id, user_id, in_hour, in_hour > 10 as rejected from c"


@query("events")
def job_ttl_latest(d: Spark) -> str:
    """A job's last state, stale or expired against the newest event."""
    seconds = "unix_timestamp(newest) - unix_timestamp(ts)" if d.name == "spark" else "date_diff('second', date_trunc('second', ts), date_trunc('second', newest))"
    return f"""with n as (select max(ts) as newest from events), j as (select user_id as job_id, event_type as status, event_id, {seconds} as idle_s, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events cross join n)
    select job_id, event_id, case when idle_s > 86400 then 'expired' when idle_s > 3600 then 'failed' else status end as status from j where rn = 1"""


@query("events")
def session_windows(d: Spark) -> str:
    """T: sessions of a client, closed by half an hour of quiet."""
    if d.name == "spark":
        return "select user_id, count(*) as n, min(ts) as started, max(ts) as ended from events group by user_id, session_window(ts, '30 minutes')"
    return """with g as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as opens from events),
    s as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, count(*) as n, min(ts) as started, max(ts) as ended from s group by user_id, k"""


@query("events")
def tumbling_counts(d: Spark) -> str:
    """T: an hour's events by kind, with the JSON property summed."""
    hour = "date_trunc('hour', ts)"
    k = "cast(get_json_object(props, '$.k') as bigint)" if d.name == "spark" else "cast(json_extract(props, '$.k') as bigint)"
    return f"select {hour} as hour_, event_type, count(*) as n, cast(sum({k}) as bigint) as k_sum from events group by 1, 2"


@query("documents")
def numbered_marker_expand(d: Spark) -> str:
    """Numbered markers in a text, their lists and ranges expanded; a range of more than 100 counts as its start."""
    if d.name == "spark":
        items = "flatten(transform(split(inner_, ','), p -> case when trim(p) rlike '^[0-9]+-[0-9]+$' then case when int(split(trim(p), '-')[1]) < int(split(trim(p), '-')[0]) then cast(array() as array<int>) when int(split(trim(p), '-')[1]) - int(split(trim(p), '-')[0]) > 100 then array(int(split(trim(p), '-')[0])) else sequence(int(split(trim(p), '-')[0]), int(split(trim(p), '-')[1])) end when trim(p) rlike '^[0-9]+$' then array(int(trim(p))) else cast(array() as array<int>) end))"
        exploded = f"select doc_id, cast(n as bigint) as n from m lateral view explode({items}) t as n"
        found = "select doc_id, inner_ from t lateral view explode(regexp_extract_all(body, r'\\[([0-9][0-9, -]*)\\]', 1)) e as inner_"
    else:
        items = "flatten(list_transform(string_split(inner_, ','), lambda p: case when regexp_matches(trim(p), '^[0-9]+-[0-9]+$') then case when split_part(trim(p), '-', 2)::int < split_part(trim(p), '-', 1)::int then []::bigint[] when split_part(trim(p), '-', 2)::int - split_part(trim(p), '-', 1)::int > 100 then [split_part(trim(p), '-', 1)::bigint] else range(split_part(trim(p), '-', 1)::bigint, split_part(trim(p), '-', 2)::bigint + 1) end when regexp_matches(trim(p), '^[0-9]+$') then [trim(p)::bigint] else []::bigint[] end))"
        exploded = f"select doc_id, unnest({items}) as n from m"
        found = "select doc_id, unnest(regexp_extract_all(body, '\\[([0-9][0-9, -]*)\\]', 1)) as inner_ from t"
    return f"""with t as (select doc_id, concat(substring(text, 1, 60), ' [', doc_id % 9 + 1, ', ', doc_id % 5 + 10, '-', doc_id % 5 + 12, '] and [', doc_id % 7 + 5, '-3] and [1-500].') as body from documents), m as ({found}), e as ({exploded})
    select doc_id, n, count(*) as times from e group by doc_id, n"""


@query("customer")
def author_year_keys(d: Spark) -> str:
    """F26 F38 F39 F40."""
    return f"""with m as (select c_custkey, concat('(', {d.item(d.array("'Jones et al.'", "'Smith, Jones, & Lee'", "'Müller'", "'van Dyke and Roe'", "'nobody'"), "c_custkey % 5 + 1")}, ', ', 1990 + c_custkey % 35, case when c_custkey % 4 = 0 then 'a' else '' end, ')') as marker from customer),
    k as (select *, {T.author_year_key(d, "marker")} as key_ from m) select c_custkey, marker, key_, {T.synthetic_marker(d, "key_")} as synthetic from k"""


def _markers(d: Spark) -> str:
    """CTEs up to `hit`: markers with year and surname, and the references of their paper that agree."""
    return f"""r as (select paper_id, ref_id, ref_pos, year, {T.surname_tokens(d, "authors")} as people from ({refs(d)}) x),
    m as (select paper_id, ref_id as marker_id, case when ref_id % 5 = 0 then null when ref_id % 4 = 0 then 1900 else year end as y, case when ref_id % 6 = 0 then null else {d.item(d.ordered("people"), 1)} end as s, ref_pos + 1 as num from r),
    hit as (select m.marker_id, r.ref_id from m join r on m.paper_id = r.paper_id where (m.y is null or m.y = r.year) and (m.s is null or {"array_contains" if d.name == "spark" else "list_contains"}(r.people, m.s)) and (m.y is not null or m.s is not null))"""


@query("documents")
def marker_link_unique(d: Spark) -> str:
    """A marker is linked if just one reference of its paper agrees, else by number."""
    return f"""with {_markers(d)}, one as (select marker_id, count(*) as n, min(ref_id) as ref_id from hit group by marker_id)
    select m.marker_id, coalesce(one.n, 0) as n_hits, case when one.n = 1 then one.ref_id end as rule_ref_id, p.ref_id as positional_ref_id from m left join one on m.marker_id = one.marker_id left join r p on p.paper_id = m.paper_id and p.ref_pos + 1 = m.num"""


@query("documents")
def link_vote_confidence(d: Spark) -> str:
    """The votes of parser, model and rule. Two that agree alone are high. Where votes differ, the parser's or the model's reference that the rule confirms wins, then the one that the rule names alone, then the one of that number, then the parser's. A parser alone is low if the rule denies it, unless that names another."""
    contains = "array_contains" if d.name == "spark" else "list_contains"
    agrees = lambda x: f"case when m.y is null and m.s is null then null else coalesce((m.y is null or m.y = {x}.year) and (m.s is null or {contains}({x}.people, m.s)), false) end"
    return f"""with {_markers(d)}, one as (select marker_id, count(*) as n, min(ref_id) as ref_id from hit group by marker_id),
    v as (select m.marker_id, m.paper_id, m.marker_id - m.marker_id % 3 as parser_vote, case when m.marker_id % 4 = 1 then m.marker_id - m.marker_id % 10 end as model_vote, case when one.n = 1 then one.ref_id end as unique_vote, m.y, m.s, m.num from m left join one on m.marker_id = one.marker_id),
    w as (select m.marker_id, m.parser_vote, m.model_vote, m.unique_vote, case when m.y is null and m.s is null then n.ref_id else m.unique_vote end as rule_vote, n.ref_id as numbered, {agrees("g")} as parser_ok, {agrees("l")} as model_ok
        from v m left join r g on g.ref_id = m.parser_vote left join r l on l.ref_id = m.model_vote left join r n on n.paper_id = m.paper_id and n.ref_pos + 1 = m.num),
    c as (select *, (model_vote is not null and model_vote <> parser_vote) or (rule_vote is not null and rule_vote <> parser_vote) as differ, model_vote is not null or rule_vote is not null as several from w),
    k as (select marker_id, parser_vote, case when differ then case when parser_ok then 'parser' when model_vote is not null and model_ok then 'model' when unique_vote is not null then 'unique' when numbered is not null then 'number' else 'none' end
        when several then 'agreed' when parser_ok then 'confirmed' when not parser_ok then case when unique_vote <> parser_vote then 'unique' else 'denied' end else 'unchecked' end as reason, model_vote, unique_vote, numbered from c)
    select marker_id, case reason when 'model' then model_vote when 'unique' then unique_vote when 'number' then numbered else parser_vote end as ref_id, reason,
    case when reason in ('agreed', 'confirmed', 'unchecked') then 'high' when reason in ('parser', 'model', 'unique') then 'medium' else 'low' end as confidence from k"""


@query("documents")
def link_statistics(d: Spark) -> str:
    """How many links there are of each confidence, and how many in disagreement."""
    return f"with l as ({link_vote_confidence(d)}) select count(*) as n, count_if(confidence = 'medium') as n_medium, count_if(confidence = 'low') as n_low, count_if(reason in ('parser', 'model', 'number', 'none')) as n_unsettled from l"


@query("conversations")
def substantive_filter(d: Spark) -> str:
    """P1 P14."""
    body = "case when turn % 3 = 0 then concat('See (Smith et al., 2019) ', substring(text, 1, 60)) when turn % 3 = 1 then concat(substring(text, 1, 12), ' [3]') else concat(substring(text, 1, 80), ' (Jones, 2020)') end"
    return f"select conv_id, turn, {T.is_substantive(d, 's')} as substantive from (select conv_id, turn, {body} as s from conversations) x"


@query("documents")
def citation_format_scores(d: Spark) -> str:
    """A style needs two points and no equal."""
    forms = d.array("concat('Smith, J. A., & Lee, K. (', y, '). ', t, '. Journal, 12(3), 45. doi.org/10.1')", "concat('Smith JA, Lee K. ', t, '. J Sci. ', y, ';12:45-50.')", "concat('J. Smith and K. Lee, \"', t, ',\" in Proc. Conf., vol. 3, pp. 45, ', y)", "concat('Smith, John. \"', t, '.\" Journal 12, no. 3 (', y, '): 45.')", "t")
    scores = T.style_scores(d, "body")
    best = f"greatest({', '.join(scores)})"
    ties = " + ".join(f"case when {s} = {best} then 1 else 0 end" for s in scores)
    pick = " ".join(f"when {s} = {best} then '{s}'" for s in scores)
    return f"""with b as (select doc_id, {d.item(forms, "doc_id % 5 + 1")} as body from (select doc_id, trim(substring(text, 1, 40)) as t, 1990 + doc_id % 35 as y from documents) x),
    s as (select doc_id, body, {", ".join(f"{x} as {s}" for s, x in scores.items())} from b)
    select doc_id, {", ".join(scores)}, case when length(body) < 15 or {best} < 2 or {ties} > 1 then null else case {pick} end end as style from s"""


@query("conversations")
def context_window(d: Spark) -> str:
    """Two sentences before, one after, within the conversation."""
    if d.name == "spark":
        before, after = "concat_ws(' ', collect_list(s) over (partition by conv_id order by turn rows between 2 preceding and 1 preceding))", "coalesce(lead(s) over (partition by conv_id order by turn), '')"
    else:
        before, after = "coalesce(string_agg(s, ' ') over (partition by conv_id order by turn rows between 2 preceding and 1 preceding), '')", "coalesce(lead(s) over (partition by conv_id order by turn), '')"
    return f"with x as (select conv_id, turn, substring(text, 1, 50) as s from conversations) select conv_id, turn, {before} as before_, s as sentence, {after} as after_ from x"


@query("pages")
def landing_meta_extract(d: Spark) -> str:
    """Title and links of a landing page, its safe host, and the paper's address where it is named."""
    title = d.extract("html", r"<title>([^<]*)</title>", 1)
    pdf = d.extract("substring(html, 1, 262144)", r'name="citation_pdf_url" content="([^"]*)"', 1)
    host = d.extract("url", r"^https?://([^/:?#]+)", 1)
    return f"select page_id, {T.unescape_html(title)} as title, {d.extract('html', '<html lang=\"([a-z]+)\"', 1)} as lang, {host} as host, {T.safe_url(d, 'url')} as safe, nullif({pdf}, '') as pdf_url, {d.size(d.extract_all('html', '<a href=\"([^\"]*)\"', 1))} as n_links from pages"


@query("documents")
def text_reference_parse(d: Spark) -> str:
    """A plain reference's label, year, DOI and quoted title."""
    body = "concat('[', doc_id, '] Smith, J. and Lee, K. (', 1990 + doc_id % 35, '). \"', trim(substring(text, 1, 30)), '.\" Journal. doi:10.1234/ab', doc_id)"
    year = d.extract("body", r"\b((19|20)[0-9]{2})\b", 1)
    label, title = d.extract("body", r"^\[([0-9]+)\]", 1), d.extract("body", r'"([^"]*)"', 1)
    return f"select doc_id, {label} as label, cast({year} as int) as year, {d.extract('body', '10[.][0-9]{4,9}/[A-Za-z0-9]+', 0)} as doi, {d.replace(title, '[.]$', '')} as title from (select doc_id, {body} as body from documents) x"


@query("documents")
def cited_identity(d: Spark) -> str:
    """A work's key from its DOI, arXiv id or title's hash."""
    text_type = "string" if d.name == "spark" else "varchar"
    return f"with r as (select ref_id, title, {T.canonical_id(d, 'doi')} as canon from ({refs(d)}) x) select ref_id, coalesce(canon, concat('title:', substring({d.sha256(f'cast({T.normalize_title(d, "title")} as {text_type})')}, 1, 16))) as identity_ from r"


@query("events", "orders")
def cost_by_priority(d: Spark) -> str:
    """Tokens times price, joined to the rows they were spent on."""
    return "with e as (select event_id % 1000 as k, sum(value) as tokens from events group by 1) select o_orderpriority, count(*) as n, round(sum(tokens * 0.6e0 / 1000), 4) as cost from orders join e on o_orderkey % 1000 = k group by o_orderpriority"


@query("orders", "customer")
def triage_full_outer(d: Spark) -> str:
    """Both key sets."""
    return f"with o as (select o_custkey, count(*) as n from orders group by 1) select coalesce(c.c_custkey, o.o_custkey + 1000000) as key_, coalesce(n, 0) as n, c.c_custkey is not null as has_customer from customer c full join o on c.c_custkey = o.o_custkey + {div(d, '5', 5)}"


@query("pages")
def safe_urls(d: Spark) -> str:
    """P10: only addresses of the open web: no private, loopback, link-local, shared, documentation, multicast or reserved range, and no host of another form than a name or four numbers."""
    hosts = ["example.org", "127.0.0.1", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.9.9", "169.254.169.254", "0.0.0.0", "224.0.0.1", "255.255.255.255", "8.8.8.8", "[::1]", "[2606:4700::1111]", "localhost", "198.51.100.7", "999.1.1.1", "user@10.0.0.1", "198.18.0.1"]
    url = f"concat({d.item(d.array(*map(quoted, ['http://', 'https://', 'ftp://', 'HTTP://', ''])), 'page_id % 5 + 1')}, {d.item(d.array(*map(quoted, hosts)), f'page_id % {len(hosts)} + 1')}, case when page_id % 2 = 0 then ':8080/x' else '/y?z#w' end)"
    return f"select page_id, u, {T.safe_url(d, 'u')} as safe from (select page_id, {url} as u from pages) p"
