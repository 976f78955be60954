"""Operator 7: information-theoretic sanitisation, with DataFrame functions alone.

Protected entities are the personal data that four patterns find; cards and phones are compared by their digits.
A term that stands in a sentence with an entity reveals it as far as the corpus lets one infer the entity from
the term: of N different sentences, with n(c), n(t) and n(c, t) that hold the entity, the term, and both, the
disclosure is log(p(c | t) N / n(c)) / log(N / n(c)) with p(c | t) = (n(c, t) + PRIOR n(c) / N) / (n(t) + PRIOR),
so it nears 1 as more sentences show the term beside the entity alone, and what was seen once or twice weighs
less without being left out. Terms from GENERALISE on become a placeholder, from REMOVE on they go, in every
document that holds them, with the entity or without; of several entities the most disclosed one counts. Equal
sentences count once, so copies of a document, or of most of it, prove nothing. Terms are compared as written,
and words within entities aren't terms.

Patterns are written with possessive quantifiers and, where a match may start only at the beginning of a
run, a look behind: their matches are those of the plain patterns, found in linear time and without
recursion on texts of any length. A match's place follows from the lengths of what stands between matches.

Defined results: a null text counts as empty and stays null when sanitised; ties and repeated rows are
treated alike, since spans depend on the text alone; an empty table gives an empty result; other columns
are kept. Overlapping spans are replaced by one placeholder, the first span's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriref.llm.common import BROADCAST_ROWS, cut, fresh, table

_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: By kind, in the order of the result: what a text with a valid match contains, the pattern, and the test of a match `m` with digits `d`.
KINDS: dict[str, tuple[str, str, str]] = {
    "email": ("@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++", "true"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", rf"m rlike r'^{_BYTE}(?:\.{_BYTE}){{3}}$'"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9])++", "length(d) between 16 and 19 and aggregate(sequence(1, length(d)), 0, (a, i) -> a + if(i % 2 = 1, int(substr(d, -i, 1)), int(substr(d, -i, 1)) * 2 - if(substr(d, -i, 1) > '4', 9, 0))) % 10 = 0"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 8 and 15"),
}
SPANS = "array<struct<kind:string,start:int,end:int>>"
_NEAR = "array<struct<kind:string,start:int,end:int,value:string>>"
TERM = "term"
GENERALISE, REMOVE = 0.85, 0.98
PRIOR, MIN_TERM = 1.0, 4
_WORD = rf"(?U)\b\p{{L}}{{{MIN_TERM},}}+\b"
#: What ends a sentence; and the signs around an entity in a marked text.
_END = r"[.!?]++\s++|[\u3002\uFF01\uFF1F]++|[\r\n]++"
_OPEN, _CLOSE = "\ue000", "\ue001"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "''") + "'"


def spans_of(text: str, kind: str, near: bool = False) -> str:
    """SQL: the valid spans of one kind in a SQL expression of a text that isn't null; near: with what they hold."""
    kept = _NEAR if near else SPANS
    beside = ", 'value', s.found[i]" if near else ""
    needs, pattern, test = KINDS[kind]
    contains = f"contains({text}, '{needs}')" if needs == "@" else f"{text} rlike {_quoted(needs)}"
    keep = f"element_at(transform(array(struct(s.found[i] as m, regexp_replace(s.found[i], '[^0-9]', '') as d)), x -> {_named(test)}), 1)"
    if test == "true":
        keep = "true"
    add = f"concat(a.spans, array(named_struct('kind', '{kind}', 'start', a.at + length(s.gaps[i]), 'end', a.at + length(s.gaps[i]) + length(s.found[i]){beside})))"
    fold = (
        f"aggregate(sequence(0, size(s.found) - 1), named_struct('at', 0, 'spans', cast(array() as {kept})), "
        f"(a, i) -> named_struct('at', a.at + length(s.gaps[i]) + length(s.found[i]), 'spans', if({keep}, {add}, a.spans)), a -> a.spans)"
    )
    both = f"array(named_struct('gaps', split({text}, {_quoted(pattern)}, -1), 'found', regexp_extract_all({text}, {_quoted(pattern)}, 0)))"
    return f"if({contains}, element_at(transform({both}, s -> if(size(s.found) = 0, cast(array() as {kept}), {fold})), 1), cast(array() as {kept}))"


def _named(test: str) -> str:
    """The test with its names bound to the fields of x."""
    return re.sub(r"\b([md])\b", r"x.\1", test)


def _base(df: DataFrame, text_col: str, out: str, near: bool = False) -> DataFrame:
    own = ", ".join(spans_of(f"coalesce(`{text_col}`, '')", kind, near) for kind in KINDS)
    return df.withColumn(out, F.expr(f"concat({own})"))


def _marked(text: str, spans: str) -> str:
    """SQL: the text with each span replaced by its kind and value between two signs; of spans that overlap none is left out."""
    ordered = f"array_sort({spans}, (x, y) -> if(x.start <> y.start, x.start - y.start, y.end - x.end))"
    plain = f"translate({text}, '{_OPEN}{_CLOSE}', '  ')"
    value = "if(s.kind in ('card', 'phone'), regexp_replace(s.value, '[^0-9]', ''), s.value)"
    marks = (
        f"aggregate({ordered}, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, s) -> named_struct('at', greatest(a.at, s.end), "
        f"'out', concat(a.out, array(substring({plain}, a.at + 1, greatest(s.start - a.at, 0)), concat('{_OPEN}', s.kind, ':', {value}, '{_CLOSE}')))), "
        f"a -> concat(array_join(a.out, ''), substring({plain}, a.at + 1)))"
    )
    return f"if(size({spans}) = 0, {plain}, {marks})"


def _sentences(docs: DataFrame, text_col: str) -> DataFrame:
    """sentence (its hash), entities, words: a row for each sentence that isn't blank."""
    found = _base(docs.select(F.col(text_col).alias("text")).filter("text is not null"), "text", "base", near=True)
    marked = found.select(F.explode(F.split(F.expr(_marked("text", "base")), _END)).alias("s")).filter(F.trim("s") != "")
    entities = F.array_distinct(F.regexp_extract_all("s", F.lit(f"{_OPEN}([^{_CLOSE}]*+){_CLOSE}"), F.lit(1)))
    bare = F.regexp_replace("s", f"{_OPEN}[^{_CLOSE}]*+{_CLOSE}", " ")
    return marked.select(F.xxhash64("s").alias("sentence"), entities.alias("entities"), F.array_distinct(F.regexp_extract_all(bare, F.lit(_WORD), F.lit(0))).alias("words"))


def disclosures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """entity, term, disclosure for terms from GENERALISE on."""
    sentences = _sentences(docs, text_col)
    contexts = cut(sentences.select("sentence", F.explode("entities").alias("entity"), "words").distinct().select("sentence", "entity", F.explode_outer("words").alias("term")))
    by_entity = contexts.select("entity", "sentence").distinct().groupBy("entity").agg(F.count("*").alias("n_c"))
    by_pair = contexts.filter("term is not null").select("entity", "term", "sentence").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
    total = sentences.select("sentence").distinct().count()
    n = F.lit(float(max(total, 2)))
    rate = lambda n_t: F.log((n * F.col("n_ct") / F.col("n_c") + PRIOR) / (n_t + PRIOR)) / F.log(n / F.col("n_c"))
    # A term is in as many sentences at least as stand beside any entity, which rules out most pairs before the texts are read again.
    least = contexts.select("term", "sentence").distinct().groupBy("term").agg(F.count("*").alias("least"))
    pairs = by_pair.join(by_entity, "entity").join(least, "term").filter((F.col("n_c") < n) & (rate(F.col("least")) >= GENERALISE))
    pairs = cut(pairs.select("entity", "term", "n_c", "n_ct"))
    terms = cut(pairs.select("term").distinct())
    n_terms = terms.count()
    if n_terms == 0:
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    said = sentences.select("sentence", F.explode("words").alias("term"))
    said = said.join(F.broadcast(terms) if n_terms <= BROADCAST_ROWS else terms, "term").distinct()
    by_term = said.groupBy("term").agg(F.count("*").alias("n_t"))
    found = pairs.join(by_term, "term").select("entity", "term", rate(F.col("n_t")).alias("disclosure"))
    return found.filter(F.col("disclosure") >= GENERALISE)


def found_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with an array of spans (kind, start, end): the base kinds in order, then revealing terms, wherever they stand. Kind is `term` for those to generalise, `gone` for those to remove."""
    terms = cut(disclosures(docs, text_col).groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    n_terms = terms.count()
    if n_terms == 0:
        return _base(docs, text_col, out)
    words = F.array_distinct(F.regexp_extract_all(text_col, F.lit(_WORD), F.lit(0)))
    said = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("doc"), F.explode(words).alias("term"))
    by_doc = said.join(F.broadcast(terms) if n_terms <= BROADCAST_ROWS else terms, "term").groupBy("doc")
    by_doc = cut(by_doc.agg(F.sort_array(F.collect_set(F.when(F.col("disclosure") < REMOVE, F.col("term")))).alias("milder"), F.sort_array(F.collect_set(F.when(F.col("disclosure") >= REMOVE, F.col("term")))).alias("stronger")))
    n = by_doc.count()
    marked = _base(docs, text_col, out)
    if n == 0:
        return marked
    key, other, milder, stronger = (fresh(docs, x) for x in ("doc", "other", "milder", "stronger"))
    by_doc = by_doc.select(F.col("doc").alias(other), F.col("milder").alias(milder), F.col("stronger").alias(stronger))
    joined = marked.withColumn(key, F.xxhash64(text_col)).join(F.broadcast(by_doc) if n <= BROADCAST_ROWS else by_doc, F.col(key) == F.col(other), "left")
    extra = ", ".join(_term_spans(f"`{text_col}`", f"`{column}`", kind) for column, kind in ((milder, TERM), (stronger, "gone")))
    return joined.withColumn(out, F.expr(f"concat(`{out}`, {extra})")).drop(key, other, milder, stronger)


def _term_spans(text: str, terms: str, kind: str) -> str:
    pattern = f"concat('(?U)\\\\b(?:', array_join({terms}, '|'), ')\\\\b')"
    both = f"array(named_struct('gaps', split({text}, {pattern}, -1), 'found', regexp_extract_all({text}, {pattern}, 0)))"
    fold = (
        f"aggregate(sequence(0, size(s.found) - 1), named_struct('at', 0, 'spans', cast(array() as {SPANS})), "
        f"(a, i) -> named_struct('at', a.at + length(s.gaps[i]) + length(s.found[i]), 'spans', concat(a.spans, array(named_struct('kind', '{kind}', 'start', a.at + length(s.gaps[i]), 'end', a.at + length(s.gaps[i]) + length(s.found[i]))))), a -> a.spans)"
    )
    return f"if(coalesce(size({terms}), 0) <= 0, cast(array() as {SPANS}), element_at(transform({both}, s -> if(size(s.found) = 0, cast(array() as {SPANS}), {fold})), 1))"


def sanitised(text: str, spans: str) -> str:
    """SQL: the text with each span (of those that overlap, the first) replaced by its kind in angle brackets; spans of kind `gone` leave nothing."""
    ordered = f"array_sort({spans}, (x, y) -> if(x.start <> y.start, x.start - y.start, y.end - x.end))"
    merged = (
        f"aggregate({ordered}, named_struct('at', 0, 'from', 0, 'out', cast(array() as array<string>)), (a, s) -> named_struct("
        f"'at', greatest(a.at, s.end), 'from', 0, 'out', if(s.start < a.at, a.out, concat(a.out, array(substring({text}, a.at + 1, s.start - a.at), if(s.kind = 'gone', '', concat('<', upper(s.kind), '>')))))), "
        f"a -> concat(array_join(a.out, ''), substring({text}, a.at + 1)))"
    )
    return f"if({text} is null or size({spans}) = 0, {text}, {merged})"


def sanitise(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with their texts sanitised, and the column of lengths, where there is one, brought up to date."""
    spans = fresh(docs, "spans")
    out = found_spans(docs, text_col, spans).withColumn(text_col, F.expr(sanitised(f"`{text_col}`", f"`{spans}`")))
    if length_col in docs.columns:
        changed = F.when(F.size(spans) > 0, F.length(text_col)).otherwise(F.col(length_col))
        out = out.withColumn(length_col, changed.cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = found_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.expr(joined.format(f"filter(spans, s -> s.kind in ({kinds}))"))
    return docs.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
