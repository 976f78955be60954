"""Operator 2: mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone.

Documents fall into cells of source, language and topic, and a cell's weight is its tokens. Sweeps rake the
cells in turn to each marginal: a cell is multiplied by target over present weight of its source, then of its
language, then of its topic, until a sweep changes nothing by more than `tolerance`, or `sweeps` are done. The
factor by which a cell's weight changed calibrates its documents, and a document is drawn with the
probability min(1, rate * factor), by a hash of its id; what a probability of 1 leaves open is kept as `weight`, by
which a drawn document counts.

Targets are shares of the marginals to a power (`tempering`), so rare sources and languages gain; or given. What
given targets leave out, or give 0, is not to be drawn: its cells have the factor 0. The tables carry no topic; the
query passes the register of a text (`register`): tables, symbols, shouting, digits, short and long prose.

A text is read once for its tokens and topic. Only cells are shuffled, as partial sums: a hot source is one row a task
and cell. Up to `CELLS_AT_ONCE` of them, counted, are swept in one task, by windows, and cut after each sweep. Marginals of more are
partial sums too, a row for each value, broadcast if they're counted to be few, else joined by shuffle, and the cells are cut
after each step; so no plan grows.

Defined results: a null source, language or topic is a value of its own, `(none)`; null and empty texts
have no tokens and the factor of their cell, a cell without tokens the factor 1; if targets exclude every cell
nothing is drawn; repeated rows and rows of equal or null ids are drawn or not together; an empty table gives an
empty result; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriref.llm.common import BROADCAST_ROWS, cut, cut_to_table, fresh, table

WORD = r"[^\x20\x09-\x0D]+"
NONE = "(none)"
#: Cells that one task sweeps, without a job for each marginal: some 20 MB.
CELLS_AT_ONCE = 100_000


@dataclass(frozen=True)
class Mix:
    """tempering: a power for each dimension; targets: shares by value that replace tempered ones; sweeps: at most; tolerance: of a marginal, relative to its target; rate: of a cell whose weight stays."""

    tempering: tuple[tuple[str, float], ...] = (("source", 0.7), ("lang", 0.8), ("topic", 1.0))
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    sweeps: int = 8
    tolerance: float = 1e-9
    rate: float = 0.9
    seed: str = "mix-1"


def register(text: Column) -> Column:
    """A topic from the shape of a text, for tables that have none."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    kinds = F.when(text.isNull() | (F.length(text) == 0), "empty").when(share("|") > 0.02, "table").when(share("#*$%&<>") > 0.1, "symbols").when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.3, "shouting").when(share("0123456789") > 0.1, "digits")
    return kinds.when(F.length(text) < 1000, "short prose").otherwise("long prose")


def draw(seed: str, id_: Column) -> Column:
    """A number from 0 to below 1 that depends on seed and id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)



def fit(cells: DataFrame, own: Mix = Mix()) -> DataFrame:
    """Cells (the dimensions, tokens) with `raked`, the weight that their marginals ask for, and `factor`."""
    cells = cut(cells.filter("tokens > 0").withColumn("weight", F.col("tokens").cast("double")))
    total = cells.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    few = {}
    for name, power in own.tempering:
        given = own.targets.get(name)
        share = F.pow(F.sum("weight") / F.lit(total or 1.0), F.lit(power))
        if given:
            share = F.coalesce(F.create_map(*[F.lit(x) for pair in given.items() for x in pair])[F.col(name)], F.lit(0.0))
        wanted = cut(cells.groupBy(name).agg(share.alias("share")))
        n, of_all = wanted.agg(F.count("*"), F.coalesce(F.sum("share"), F.lit(0.0))).first()
        few[name] = n <= BROADCAST_ROWS
        wanted = wanted.select(name, (F.col("share") * F.lit(total / of_all if of_all else 0.0)).alias(f"wanted_{name}"))
        cells = cells.join(F.broadcast(wanted) if few[name] else wanted, name)
    cells = cut(cells.withColumn("raked", F.when(F.least(*[F.col(f"wanted_{name}") for name in few]) > 0, F.col("weight")).otherwise(0.0)).withColumn("change", F.lit(0.0)))
    at_once = cells.count() <= CELLS_AT_ONCE
    for _ in range(own.sweeps):
        if at_once:
            cells = cells.coalesce(1)  # so the windows need no exchange
        for k, name in enumerate(few):
            if at_once:
                of_value = F.sum("raked").over(Window.partitionBy(name))
                rows = cells.withColumn("present", of_value).withColumn("present", F.when(F.col("present") > 0, F.col("present")))
            else:
                present = cells.groupBy(name).agg(F.sum("raked").alias("present")).filter("present > 0")
                rows = cells.join(F.broadcast(present) if few[name] else present, name, "left")
            by = F.coalesce(F.col(f"wanted_{name}") / F.col("present"), F.lit(0.0))  # nothing is left where nothing is present
            most = F.when(F.col("present").isNotNull(), F.abs(by - 1)).otherwise(0.0)
            cells = rows.withColumns({"raked": F.col("raked") * by, "change": most if k == 0 else F.greatest(F.col("change"), most)}).drop("present")
            cells = cells if at_once and k + 1 < len(few) else cut(cells)
        if (cells.agg(F.max("change")).first()[0] or 0.0) <= own.tolerance:
            break
    return cells.withColumn("factor", F.col("raked") / F.col("weight")).select(*few, "tokens", "raked", "factor")


def mixed(docs: DataFrame, topic: Column, own: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", without: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """docs (without some columns that aren't needed any more) with the columns topic, tokens, factor, probability, weight and sampled, whose names are returned by these."""
    names = {x: fresh(docs, x) for x in ("source", "lang", "topic", "tokens", "factor", "probability", "weight", "sampled")}
    marked = cut_to_table(
        docs.withColumns({
            names["source"]: F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)),
            names["lang"]: F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)),
            names["topic"]: F.coalesce(topic.cast("string"), F.lit(NONE)),
            names["tokens"]: F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"),
        }).drop(*without),
        "marked",
    )
    dims = ["source", "lang", "topic"]
    cells = marked.groupBy(*[F.col(names[x]).alias(x) for x in dims]).agg(F.sum(names["tokens"]).alias("tokens"))
    fitted = fit(cells, own).select(*[F.col(x).alias(names[x]) for x in dims], F.col("factor").alias(names["factor"]))
    fitted = cut(fitted)
    joined = marked.join(F.broadcast(fitted) if fitted.count() <= BROADCAST_ROWS else fitted, [names[x] for x in dims], "left").withColumn(names["factor"], F.coalesce(names["factor"], F.lit(1.0)))
    odds = F.col(names["factor"]) * F.lit(own.rate)
    out = joined.withColumn(names["probability"], F.least(odds, F.lit(1.0)))
    return out.withColumn(names["weight"], F.coalesce(F.try_divide(odds, F.col(names["probability"])), F.lit(0.0))).withColumn(names["sampled"], draw(own.seed, F.col(id_col)) < F.col(names["probability"])), names


def sample(docs: DataFrame, own: Mix = Mix(), text_col: str = "text") -> DataFrame:
    """The documents drawn, with the columns of docs."""
    out, names = mixed(docs, register(F.col(text_col)), own, text_col=text_col)
    return out.filter(names["sampled"]).select(*docs.columns)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out, names = mixed(docs, register(F.col("text")), without=("text", "lang", "source"))
    rounded = [F.round(names[x], 6).alias(x) for x in ("factor", "probability", "weight")]
    return out.select("doc_id", *[F.col(names[x]).alias(x) for x in ("source", "lang", "topic", "tokens")], *rounded, F.col(names["sampled"]).alias("sampled"))


def oracle(own: Mix = Mix()) -> str:
    """DuckDB SQL for the rows of op2_source_mixing, the sweeps written out."""
    share = lambda chars: f"(length(text) - length(translate(text, '{chars}', ''))) / greatest(length(text), 1)"
    parts = [
        f"""marked as materialized (select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang,
        case when text is null or length(text) = 0 then 'empty' when {share("|")} > 0.02 then 'table' when {share("#*$%&<>")} > 0.1 then 'symbols'
        when {share("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} > 0.3 then 'shouting' when {share("0123456789")} > 0.1 then 'digits'
        when length(text) < 1000 then 'short prose' else 'long prose' end as topic,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as tokens from documents)""",
        "c0 as materialized (select source, lang, topic, sum(tokens)::double as tokens, sum(tokens)::double as raked from marked group by all having sum(tokens) > 0)",
        "total as materialized (select sum(raked) as n from c0)",
    ]
    for name, power in own.tempering:
        parts.append(f"w_{name} as (select {name}, pow(sum(raked) / (select n from total), {power}) as wanted from c0 group by all)")
        parts.append(f"t_{name} as materialized (select {name}, wanted / (select sum(wanted) from w_{name}) * (select n from total) as wanted from w_{name})")
    last = 0
    for _ in range(own.sweeps):
        for name, _power in own.tempering:
            change = f"(select {name}, sum(raked) as present from c{last} group by all)"
            parts.append(f"c{last + 1} as materialized (select c.source, c.lang, c.topic, c.tokens, c.raked * (t.wanted / p.present) as raked from c{last} c join {change} p using ({name}) join t_{name} t using ({name}))")
            last += 1
    return f"""with {", ".join(parts)},
    joined as (select m.*, coalesce(c.raked / c.tokens, 1.0) as factor from marked m left join c{last} c using (source, lang, topic)),
    drawn as (select *, least(factor * {own.rate}, 1.0) as probability, ('0x' || substr(md5('{own.seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0 as u from joined)
    select doc_id, source, lang, topic, tokens, round(factor, 6) as factor, round(probability, 6) as probability, round(factor * {own.rate} / probability, 6) as weight, u < probability as sampled from drawn"""


ORACLE = oracle()
