import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veriref.functions.similarity import Texts, indel, lcs, token_sort_ratio
from veriref.operators import titles
from veriref.operators.chunks import LEAST_WORDS, chunk

words = st.text("abc ", max_size=12)


def plain_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_lcs_is_that_of_the_table(a, b):
    assert lcs(a, b) == plain_lcs(a, b)
    assert indel(a, b) == indel(b, a)
    assert 0 <= indel(a, b) <= 1


def test_token_sort_ratio():
    assert abs(token_sort_ratio("Attention Is All You Need", "Attention Is All We Need") - 2 * 22 / 49) < 1e-9
    assert token_sort_ratio("a b", "b a") == 1
    assert token_sort_ratio(None, "a") is None


def test_chunks():
    text = ". ".join(f"Sentence number {k} says something about nothing at all" for k in range(60)) + "."
    found = chunk(text)
    assert len(found) > 3
    assert all(len(x.split()) >= LEAST_WORDS for x in found)
    assert chunk(None) == chunk("") == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abcdé ", max_size=90), min_size=2, max_size=12), st.sampled_from([0.5, 0.8, 1.0]))
def test_many_pairs_at_a_time(texts, least):
    texts = [x for x in texts if x] + ["ab" * 70, "ab" * 69 + "c"]
    middle = len(texts) // 2
    own = Texts(texts)
    pairs = list(own.candidates(0, middle, len(texts), least))
    x, y, sim = own.alike(np.concatenate([p[0] for p in pairs] or [np.zeros(0, int)]), np.concatenate([p[1] for p in pairs] or [np.zeros(0, int)]), least)
    expected = {(i, j): indel(texts[i], texts[j]) for i in range(middle) for j in range(middle, len(texts)) if indel(texts[i], texts[j]) >= least}
    assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), sim.tolist(), strict=True)) == expected


def test_a_common_word_in_cells(spark, monkeypatch):
    """Titles of one word are dealt out in cells, and a pair that meets at several words comes once."""
    monkeypatch.setattr(titles, "CELL", 7)
    rows = [f"common words of title {a} {b}" for a in "abcdefgh" for b in ("xx", "xy", "yz", "zz")]
    left, right = (spark.createDataFrame([(x,) for x in part], "norm string") for part in (rows, rows[::2] + ["common words", ""]))
    for other, names in ((right, rows[::2] + ["common words"]), (left, rows)):
        got = [(r["a"], r["b"]) for r in titles.similar_titles(left, other).collect()]
        assert sorted(got) == sorted((a, b) for a in rows for b in names if a == b or token_sort_ratio(a, b) >= 0.8)


def test_a_title_is_sent_once_for_each_block(spark, monkeypatch):
    """Not once for each of its words; pairs leave as numbers, and are those of brute force by either way of meeting them."""
    rows = sorted({f"{a} {b} shared {c} {b}" for a in ("alpha", "beta", "gamma", "delta") for b in ("one", "two", "onetwo") for c in ("xx", "xy", "zz")})
    plain = spark.createDataFrame([(x, k % 3 < 2, k % 3 > 0) for k, x in enumerate(rows)], "norm string, l boolean, r boolean")
    own = titles.numbered(plain)
    names = {r["id"]: r["norm"] for r in own.collect()}
    sides = {r["norm"]: (r["l"], r["r"]) for r in plain.collect()}
    dealt = titles._dealt(own.withColumn("key", own["id"]).join(titles._by_rarity(own, False), "id"), 4).drop("id", "norm")
    assert dealt.count() == 4 * len(rows)
    assert [f.dataType.simpleString() for f in titles.alike(own).schema] == ["bigint", "bigint", "double"]
    likely = {(a, b) for a in rows for b in rows if a != b and sides[a][0] and sides[b][1] and token_sort_ratio(a, b) >= 0.8}
    surely = {(a, b) for a, b in likely if 2 * len({*a.split()} & {*b.split()}) > min(len({*a.split()}), len({*b.split()}))}
    assert surely
    batches = dealt.coalesce(1).sortWithinPartitions("cell", "second").toArrow().to_batches(max_chunksize=7)
    for few in (0, 1 << 12):
        monkeypatch.setattr(titles, "_FEW", few)
        got = [(names[r["a"]], names[r["b"]]) for batch in titles._aligner(0.8, 0.5, False, None)(iter(batches)) for r in batch.to_pylist()]
        assert len(got) == len({*got}) and surely <= {*got} <= likely
