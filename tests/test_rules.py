"""Rules against known cases, and statistics against their definitions; nothing here is derived from the queries' own SQL."""

import itertools
import math

import numpy as np
import pytest

from veriref.functions import text as T
from veriref.functions.dialect import DUCK, SPARK
from veriref.functions.similarity import token_sort_ratio
from veriref.operators import records
from veriref.operators.stats import bootstrap_interval
from veriref.operators.titles import similar_titles


def both(spark, rule, values):
    """A rule's results in either engine, by value; they have to agree."""
    import duckdb

    con = duckdb.connect()
    con.execute("create table t (i int, x varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(values)))
    own = [r[0] for r in con.execute(f"select {rule(DUCK, 'x')} from t order by i").fetchall()]
    spark.createDataFrame(list(enumerate(values)), "i int, x string").createOrReplaceTempView("rule_cases")
    got = [r[0] for r in spark.sql(f"select {rule(SPARK, 'x')} from rule_cases order by i").collect()]
    assert got == own
    return dict(zip(values, got, strict=True))


def test_groups_of_authors(spark):
    groups = ["OpenAI", "Google Research", "the LIGO scientists", "Qwen Team", "ATLAS Collaboration", "Snowflake Labs", "Acme Inc.", "DeepSeek-AI", "Working Party on Care", "Allen Institute"]
    people = ["John Smith", "Smith, John", "Jean-Pierre Dupont", "J.-P. Dupont", "Mary-Jane", "Li Wei", "García, María", ""]
    found = both(spark, T.is_group, groups + people)
    assert all(found[x] for x in groups) and not any(found[x] for x in people)


def test_venues(spark):
    found = both(spark, T.normalize_venue, ["Proc. of the 12th Int. Conf. on Mach. Lang. (ACL 2019)", "J. Comput. Sci.", "Nature 2019", "Trans. on Softw. Eng.", "Journal of the ACM", "arXiv e-prints", "IEEE Symp. on Appl. Math., 3rd", ""])
    assert found == {"Proc. of the 12th Int. Conf. on Mach. Lang. (ACL 2019)": "on machine language", "J. Comput. Sci.": "journal computing science", "Nature 2019": "nature", "Trans. on Softw. Eng.": "software engineering", "Journal of the ACM": "the acm", "arXiv e-prints": "arxiv", "IEEE Symp. on Appl. Math., 3rd": "ieee on applied mathematics", "": ""}


def test_preprints(spark):
    names = {"arXiv:1706.03762": True, "bioRxiv": True, "e-prints": True, "Cornell University": True, "SocArXiv": True, "TechRxiv": True, "CoRR": False, "OpenReview": False, "Nature": False}
    assert both(spark, T.is_preprint, list(names)) == names


def test_open_web(spark):
    closed = ["ftp://a.org/", "http://localhost/", "http://10.0.0.1/", "https://172.16.3.4/", "https://172.31.255.255", "http://192.168.1.1:80/", "http://169.254.169.254/x", "http://127.0.0.1", "http://0.0.0.0/", "http://224.0.0.1/", "http://[::1]/", "http://[fe80::1]/", "http://me@10.0.0.1/", "http://300.1.1.1/", "http://2130706433/", "http:///x", "", "javascript:alert(1)"]
    open_ = ["http://a.org/", "HTTPS://A.ORG/x?y", "https://172.32.0.1/", "http://8.8.8.8:53/", "http://me@a.org/", "http://[2606:4700::1111]/"]
    found = both(spark, T.safe_url, closed + open_)
    assert [x for x in closed if found[x]] == [] and [x for x in open_ if not found[x]] == []


def test_mcnemar(spark):
    from veriref.plans import registry

    for r in registry.QUERIES["mcnemar_holm"](spark, "/root/testdata/sf0.01").collect():
        b, c = r["b"], r["c"]
        n = b + c
        exact = min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n) if n else 1.0
        chi2 = max(abs(b - c) - 1, 0) ** 2 / n if n else 0.0
        assert abs(r["p"] - (exact if n < 25 else math.erfc(math.sqrt(chi2 / 2)))) < 2e-6 and r["exact_"] == (n < 25)


def test_bootstrap(spark):
    rows = bootstrap_interval(spark.createDataFrame([("a", 200, 20), ("b", 0, 0), ("c", 40, 0)], "s string, n long, k long")).collect()
    found = {r["s"]: r for r in rows}
    rng = np.random.default_rng(1)
    rates = (rng.random((4000, 200)) < 0.1).mean(axis=1)
    assert abs(found["a"]["ci_low"] - np.percentile(rates, 2.5)) < 0.01 and abs(found["a"]["ci_high"] - np.percentile(rates, 97.5)) < 0.01
    assert found["b"]["rate"] == 0 and found["c"]["ci_high"] == 0


def test_similar_titles(spark):
    base = ["attention is all you need", "a survey of large language models", "deep residual learning for image recognition", "learning to rank with many features", "the the the", "graph networks"]
    edited = ["attention is all we need", "all you need is attention", "large language models a survey", "deep residual learning for image recogniton", "deep residual lerning for images recognition", "learning to rank with few features", "graphs", "", None, "the the the"]
    left, right = (spark.createDataFrame([(x,) for x in xs], "norm string") for xs in (base, edited))
    got = {(r["a"], r["b"]): r["sim"] for r in similar_titles(left, right).collect()}
    expected = {(a, b): token_sort_ratio(a, b) for a, b in itertools.product(base, edited) if b and token_sort_ratio(a, b) >= T.TITLE_MATCH}
    assert got == pytest.approx(expected) and len(expected) >= 6
    assert similar_titles(left.limit(0), right).count() == 0


@pytest.mark.parametrize("read", [records.crossref, records.openalex, records.semantic_scholar, records.openreview, records.pubmed, records.arxiv])
def test_records_that_cannot_be_read(spark, read):
    texts = [None, "", "{", "<", "[1]", "null", "<entry><title>x</title>", "<PubmedArticle/>"]
    rows = read(spark.createDataFrame(list(enumerate(texts)), "i int, answer string"), "answer").collect()
    assert len(rows) == len(texts) and all(r["record"]["doi"] is None for r in rows) and all(r["unreadable"] for r in rows[:2])


def test_abstract_with_repeats(spark):
    rows = records.openalex(spark.createDataFrame([('{"title": "t", "abstract_inverted_index": {"b": [1, 3], "a": [0, 2]}}',), ('{"title": "t", "abstract_inverted_index": {}}',)], "answer string"), "answer").collect()
    assert [r["record"]["abstract"] for r in rows] == ["a b a b", None]
