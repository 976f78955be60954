"""Queries against DuckDB on the smallest tables, and streams against batches."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from veriref.plans import registry

DATA = Path("/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    return str(x) if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", ["quick_verdict_report", "title_similarity_pairs", "best_candidate_composite", "existence_cascade_first_hit", "metadata_field_comparison", "triage_routes", "bm25_topk", "rrf_fusion", "mcnemar_holm", "stratified_rates", "session_windows", "numbered_marker_expand", "citation_format_scores", "title_classes", "quick_classify", "link_vote_confidence", "link_statistics", "safe_urls", "venue_normalize_match", "author_token_jaccard", "job_ttl_latest", "crossref_records", "openalex_records", "semantic_scholar_records", "openreview_records", "pubmed_records", "arxiv_records"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    rows = [tuple(plain(x) for x in r) for r in got.select(*columns).collect()]
    own = con.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]}) q").fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(x) for x in r)) for r in own)


def test_passage_guard_brute_force(spark, tmp_path):
    texts = [(1, "unfused  words stand\nhere"), (2, "one two"), (3, "xone twox"), (4, None), (5, ""), (6, "the elephantine matter of a very long passage that somebody has cuttingly abbreviated here")]
    passages = [(10, "fused words stand here"), (11, "one two"), (12, ""), (13, None), (14, "elephantine matter of a very long passage that somebody has cuttingly abbreviated"), (15, "a")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for folder in (str(tmp_path), "/root/testdata/sf0.01"):
        rows = lambda name, key: [(r[key], " ".join(x for x in re.split(r"[ \t\n\x0b\f\r]+", r["text"] or "") if x)) for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]  # noqa: B023, E731
        heads, bodies = [(i, t[:60]) for i, t in rows("benchmark", "item_id")], rows("documents", "doc_id")
        expected = sorted((i, j) for i, head in heads if head for j, body in bodies if head in body)
        assert expected and sorted((r["item_id"], r["doc_id"]) for r in registry.QUERIES["passage_guard"](spark, folder).collect()) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.ORACLES) <= set(entry.oracle_sql())


def test_accepted_calls_brute_force(spark):
    from veriref.streaming.state import LIMIT, accepted_calls

    events = spark.read.parquet(str(DATA / "events.parquet"))
    rows = sorted(events.selectExpr("user_id", "unix_timestamp(ts) as s", "event_id").collect(), key=lambda r: (r[1], r[2]))
    memory, expected = {}, {}
    for user, now, event in rows:
        held = memory.setdefault(user, [])
        held[:] = [t for t in held if t > now - 3600]
        expected[event] = len(held) < LIMIT
        if expected[event]:
            held.append(now)
    assert {r["event_id"]: r["accepted"] for r in accepted_calls(events).collect()} == expected


def test_stream_equals_batch(spark, tmp_path):
    from veriref.streaming.state import hourly_counts

    events = spark.read.parquet(str(DATA / "events.parquet"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = hourly_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    assert sorted(spark.table("counts").collect()) == sorted(hourly_counts(events).collect())


def test_names_are_compared_before_they_are_paired(spark):
    """Customers and suppliers of a nation share few lists of names, so no pair of ids costs a pattern."""
    plan = registry.QUERIES["author_token_jaccard"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "regexp" not in plan[: plan.index("Join")]


def test_hits_by_title_come_once_for_each_title(spark, tmp_path):
    """Many documents with one text: references and records of a title are never paired with one another."""
    text = "a title that very many references have in common with very many records of it"
    spark.createDataFrame([(k, text) for k in range(400)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["existence_cascade_first_hit"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    own = con.execute(f"select ref_id, status, source, work_id, step from ({registry.ORACLES['existence_cascade_first_hit']}) q").fetchall()
    assert sorted(tuple(r) for r in got.select("ref_id", "status", "source", "work_id", "step").collect()) == sorted(own)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" in plan


def test_authors_of_a_title_are_compared_before_references_are_paired(spark, tmp_path):
    """Many documents with one text: lists of people and kinds of records are compared, not every reference with every record."""
    text = "a title that very many references have in common with very many records of it"
    spark.createDataFrame([(k, text) for k in range(400)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["best_candidate_composite"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    own = con.execute(f"select ref_id, work_id, strategy, score from ({registry.ORACLES['best_candidate_composite']}) q").fetchall()
    assert sorted(tuple(r) for r in got.select("ref_id", "work_id", "strategy", "score").collect()) == sorted(own)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "author_part" in plan and "min(work_id" in plan


def _below_the_first_aggregate(plan):
    """Lines of a plan between its pairs of titles and what first groups them."""
    lines = plan.splitlines()
    pairs = next(k for k, x in enumerate(lines) if "MapInArrow" in x)
    first = max(k for k, x in enumerate(lines[:pairs]) if "Aggregate" in x)
    return lines[first:pairs]


@pytest.mark.parametrize("name", ["title_similarity_pairs", "existence_cascade_first_hit", "quick_classify", "quick_verdict_report", "severity_order", "triage_routes"])
def test_pairs_of_titles_are_grouped_where_they_are_found(spark, name):
    """They are neither written nor joined before; there are by far more of them than references."""
    plan = registry.QUERIES[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in _below_the_first_aggregate(plan) if "Join" in x or "Window" in x]
    assert plan.count("MapInArrow") == 1


def test_titles_of_one_doi_are_compared_by_themselves(spark, tmp_path):
    """A record in which the words of the title stand in another order is found by its DOI, as in SQL, and one with another title isn't."""
    rows = [(k, f"{w} words of several kinds that make a title of their own {w}{w}") for k, w in zip(range(0, 84), (f"{a}{b}" for a in "abcdefghijkl" for b in "mnopqrs"), strict=True)] + [(84, ""), (85, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("existence_cascade_first_hit", "quick_classify"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        own = con.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]}) q").fetchall()
        assert sorted(repr(tuple(plain(x) for x in r)) for r in got.select(*columns).collect()) == sorted(repr(tuple(plain(x) for x in r)) for r in own)


def test_scores_stay_with_their_title(spark):
    """What is compared is reduced to the best of a title, list of people and year before anything of it is dealt out again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = registry.QUERIES["best_candidate_composite"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    compared = [k for k, x in enumerate(lines) if "min(work_id" in x and "author_part" in x]
    top = max(k for k, x in enumerate(lines[: compared[0]]) if "Join" in x)
    joined = next(k for k in range(compared[0], len(lines)) if "Join" in lines[k])
    between = [x.strip(" :+-|") for x in lines[top + 1 : joined]]
    assert any("own_year" in x and "Aggregate" in x for x in between)
    assert sum(x.startswith("Exchange") and "author_part" in x for x in between) == 0
