"""Queries around judges: prompts, an offline judge, answers, second opinions and what is shown for review."""

from __future__ import annotations

from veriref.functions import text as T
from veriref.functions.dialect import Spark
from veriref.plans.base import query


def _words(d: Spark, x: str) -> str:
    return d.distinct(d.kept(d.split(d.replace(f"lower({x})", "[^a-z0-9\\s]", " "), "\\s+"), "w", "length(w) > 3"))


def _pairs() -> str:
    """A turn as the claim and the one after it as the passage."""
    return "select conv_id, turn, text as claim, lead(text) over (partition by conv_id order by turn) as passage from conversations"


@query("conversations")
def offline_judge(d: Spark) -> str:
    """Without a model, a claim is judged by the words that it shares with its passage; without a passage it is neutral."""
    shared = f"cast({d.size(d.common('cw', 'pw'))} as double) / nullif(least({d.size('cw')}, {d.size('pw')}), 0)"
    return f"""with p as ({_pairs()}), w as (select conv_id, turn, passage, {_words(d, "claim")} as cw, {_words(d, "coalesce(passage, '')")} as pw from p), s as (select *, coalesce({shared}, 0.0e0) as overlap_ from w)
    select conv_id, turn, round(overlap_, 6) as overlap_, case when passage is null then 'NEUTRAL' when overlap_ >= 0.4 then 'SUPPORTED' when overlap_ >= 0.05 then 'NEUTRAL' else 'NOT_SUPPORTED' end as verdict from s"""


@query("conversations")
def judge_prompts(d: Spark) -> str:
    """A prompt with fenced, untrusted texts; markers and blanks are cleaned."""
    clean = lambda x: f"trim({d.replace(d.replace(x, '\\[[0-9, -]+\\]', ''), '\\s+', ' ')})"
    return f"""with p as ({_pairs()}) select conv_id, turn, concat('Claim:\n<untrusted>', substring({clean("concat(claim, ' [3]')")}, 1, 1500), '</untrusted>\nPassage:\n<untrusted>', substring({clean("coalesce(passage, '(none)')")}, 1, 1500), '</untrusted>') as prompt from p"""


@query("documents")
def answer_parsing(d: Spark) -> str:
    """A model's answer in fences or prose, its label and explanation; what can't be read is an error."""
    answer = "case doc_id % 4 when 0 then concat('```json\n{\"verdict\": \"VALID\", \"explanation\": \"no ', doc_id, '\"}\n```') when 1 then concat('<think>x</think>{\"verdict\": \"fabricated\", \"explanation\": \"y\"}') when 2 then '{\"verdict\": \"maybe\"}' else 'none' end"
    body = d.extract("answer", r"(\{[^{}]*\})", 1)
    field = (lambda k: f"get_json_object(nullif({body}, ''), '$.{k}')") if d.name == "spark" else (lambda k: f"json_extract_string(nullif({body}, ''), '$.{k}')")
    return f"with a as (select doc_id, {answer} as answer from documents), f as (select doc_id, lower({field('verdict')}) as label, substring({field('explanation')}, 1, 600) as explanation from a) select doc_id, case when label in ('valid', 'fabricated') then label else 'error' end as label, explanation, case when label = 'valid' then 'valid' else 'fabricated' end as collapsed from f"


@query("labels", "documents")
def second_opinion(d: Spark) -> str:
    """Agreement of two judges over the cases that one of them calls wrong, and those of which both are sure."""
    return """with j as (select l.doc_id, l.quality = 0 as first_wrong, case when l.doc_id % 7 = 0 then null else l.toxic = 1 end as second_wrong from labels l join documents d on l.doc_id = d.doc_id)
    select count(*) as n, count_if(second_wrong is null) as n_errors, count_if(first_wrong = second_wrong) as n_agree, round(coalesce(1.0e0 * count_if(first_wrong = second_wrong) / nullif(count_if(second_wrong is not null), 0), 0.0e0), 4) as agreement, count_if(first_wrong and second_wrong) as n_both_wrong from j where first_wrong or coalesce(second_wrong, true)"""


@query("documents", "labels", "benchmark")
def comprehension_rows(d: Spark) -> str:
    """References, claims and passages in one row each; a reference without a claim has an empty one."""
    return """select d.doc_id, coalesce(b.item_id, -1) as passage_id, coalesce(substring(b.text, 1, 40), '') as top_passage, case when b.item_id is null then null when length(d.text) < 1024 then 1.0e0 else 0.5e0 end as bm25_score, coalesce(l.quality = 1, false) as full_text_available, case when l.doc_id is null then '' else concat('claim ', l.doc_id) end as citing_sentence
    from documents d left join labels l on d.doc_id = l.doc_id left join benchmark b on b.item_id = d.doc_id % 97"""


@query("documents")
def verdict_colours(d: Spark) -> str:
    """K8 K9: a colour for each verdict, which a contradicted claim overrides, and a short title."""
    return f"with v as (select doc_id, case doc_id % 3 when 0 then 'VALID' when 1 then 'FABRICATED' else 'UNVERIFIABLE' end as verdict, doc_id % 10 = 0 as contradicted, {T.spaced(d, 'substring(text, 1, 60)')} as title from documents) select doc_id, case when contradicted then 'orange' when verdict = 'VALID' then 'green' when verdict = 'FABRICATED' then 'red' else 'yellow' end as colour, case when length(title) > 40 then concat(substring(title, 1, 37), '...') else title end as short_title from v"
