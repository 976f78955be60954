"""Sections of references, arXiv ids, spans and markers: against DuckDB, known cases and brute force."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from veriref.operators import completion as C
from veriref.plans import completion, registry

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["references_section", "section_batches", "arxiv_ids", "appearances", "completion_trigger", "client_addresses", "citations_by_reference", "unresolved_citations"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = getattr(completion, name)(spark, str(DATA))
    columns = sorted(got.columns)
    own = con.execute(f"select {', '.join(columns)} from ({registry.ORACLES[name]}) q").fetchall()
    assert own and sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, own))


def test_when_to_complete(spark):
    cases = [(2, 1, 20, False), (25, 36, 22, True), (3, 3, 200, False), (8, 0, 0, True), (None, 9, None, True), (4, 4, 41, False), (4, 4, 40, True)]
    rows = spark.createDataFrame(cases, "a int, b int, n int, expected boolean")
    assert all(r[0] == r[1] for r in rows.select(C.should_complete("a", "b", "n"), "expected").collect())


def test_appearances(spark):
    cases = [(1, 10, 12, 32, "x" * 10 + ", " + "y" * 20, True), (1, 10, 13, 32, "x" * 10 + ". (" + "y" * 20, False), (0, 2, 22, 25, "ab" + " " * 20 + "cde", False), (0, 5, 3, 8, None, True), (0, 2, 2, 4, "abcd", False), (4, 6, 0, 2, "ab; cd", True), (0, 2, 4, 6, None, False)]
    rows = spark.createDataFrame(cases, "a int, a_end int, b int, b_end int, x string, expected boolean")
    got = rows.select(C.same_appearance(F.col("a"), F.col("a_end"), F.col("b"), F.col("b_end"), "x"), "expected").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_sections(spark):
    cases = [(None, None), ("", ""), ("References", ""), ("References\n", ""), ("a\nworks  cited\nb\n", "b"), ("x\nReferences\n1\nB. Proofs of Claims\n2", "1"), ("x\nReferences\ny\nReferences\nz\n  Appendix", "z"), ("x\nReferences\nBibliography\nz", "Bibliography\nz"), ("References\nAppendices stay", "Appendices stay")]
    got = spark.createDataFrame(cases, "x string, expected string").select(C.references_section("x"), "expected").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_batches_cover_their_lines():
    rng = random.Random(3)
    for _ in range(40):
        lines = [f"{k}:" + "x" * rng.choice([0, 30, 200, 15000]) for k in range(rng.randrange(1, 400))]
        section, expected, at = "\n".join(lines), [], 0
        while len(section) > 18000:  # line by line
            end, size = at, 0
            while end < len(lines) and size < 12000:
                size, end = size + len(lines[end]) + 1, end + 1
            expected.append("\n".join(lines[at:end]))
            if end == len(lines):
                break
            at = max(end - 5, at + 1)
        assert C.batches_of(section) == (expected or [section])


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, None), ("", "", "", ""), (None, "arXiv 2101.12345", None, None)], "a string, b string, c string, d string")
    assert [r[0] for r in rows.select(C.arxiv_said("a", "b", "c", "d")).collect()] == [None, None, "2101.12345"]
    assert [r[0] for r in rows.select(C.client_address("a", "b")).collect()] == ["unknown", "unknown", "arXiv 2101.12345"]
    assert [r[0] for r in rows.select(C.section_batches("a")).collect()] == [None, [""], None]
