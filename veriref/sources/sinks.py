"""Sinks: reports, tables for people, problem entries, corrected citations and resumable results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TEXT = 800_000


def report_json(verdicts: DataFrame, path: str) -> None:
    """A JSON object for each paper, with its verdicts in order."""
    rows = verdicts.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("ref_id", "verdict"))).alias("verdicts"))
    rows.select(F.to_json(F.struct("paper_id", "verdicts")).alias("value")).write.mode("overwrite").text(path)


def batch_csv(verdicts: DataFrame, path: str) -> None:
    """Null becomes empty."""
    verdicts.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in verdicts.columns]).write.mode("overwrite").option("header", "true").csv(path)


def authors_apa(authors: Column) -> Column:
    """One, two, up to twenty, or the first nineteen and the last."""
    n = F.size(authors)
    return F.when(n <= 1, F.array_join(authors, "")).when(n == 2, F.array_join(authors, " & ")).when(n <= 20, F.concat(F.array_join(F.slice(authors, F.lit(1), n - 1), ", "), F.lit(", & "), F.element_at(authors, -1))).otherwise(F.concat(F.array_join(F.slice(authors, 1, 19), ", "), F.lit(", ... "), F.element_at(authors, -1)))


def corrected(authors: Column, year: Column, title: Column, venue: Column, doi: Column) -> Column:
    """An APA citation of the matched record."""
    return F.concat_ws(" ", authors_apa(authors), F.concat(F.lit("("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(").")), F.concat(title, F.lit(".")), F.concat(venue, F.lit(".")), F.concat(F.lit("https://doi.org/"), doi))


def bibtex_entry(ref_id: Column, title: Column, authors: Column, year: Column, note: Column) -> Column:
    field = lambda key, value: F.concat(F.lit(f"  {key} = {{"), value, F.lit("}"))
    fields = F.array_compact(F.array(field("title", title), field("author", F.array_join(authors, " and ")), field("year", year.cast("string")), field("note", note)))
    return F.concat(F.lit("@misc{"), ref_id, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}\n"))


def problems(verdicts: DataFrame, refs: DataFrame) -> DataFrame:
    """BibTeX entries of references that are fabricated, unverifiable or contradicted."""
    bad = verdicts.filter(F.col("verdict").isin("FABRICATED", "UNVERIFIABLE") | (F.col("claim_verdict") == "CONTRADICTS"))
    note = F.concat(F.lit("verdict: "), F.col("verdict"))
    return bad.join(refs, ["paper_id", "ref_id"]).select("paper_id", "ref_id", bibtex_entry(F.col("ref_id"), F.col("title"), F.col("authors"), F.col("year"), note).alias("entry"))


def cached_fulltext(texts: DataFrame) -> DataFrame:
    """Text cut to MOST_TEXT, and the first sections whose lengths together fit."""
    total = F.transform(F.sequence(F.lit(1), F.size("sections")), lambda k: F.aggregate(F.slice("sections", F.lit(1), k), F.lit(0), lambda s, x: s + F.length(x["text"])))
    kept = F.when(F.size("sections") > 0, F.filter("sections", lambda x, k: F.element_at(total, k + 1) <= MOST_TEXT)).otherwise(F.col("sections"))
    return texts.withColumn("full_text", F.substring("full_text", 1, MOST_TEXT)).withColumn("sections", kept)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a run that is resumed still has to do."""
    return rows.join(done.select(key), key, "left_anti")


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


def live(cache: DataFrame, now: Column) -> DataFrame:
    """Entries that haven't expired, the latest of each key."""
    return cache.filter(F.col("expires_at") > now).groupBy("key").agg(F.max_by("value", "written_at").alias("value"))
