"""The operators against brute force, round trips and held-out accuracy, on small tables with nulls, empties and repeats."""

import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

DATA = "/root/testdata/sf0.001"
ODD = [(0, "One two three four five six", "en", "s0", 27), (1, None, None, None, None), (2, "", "en", "s0", 0), (3, "One two three four five six", "en", "s0", 27), (3, "One two three four five six", "en", "s0", 27), (None, " \t\n ", None, "s1", 4), (5, "Mail a.b@c.de or +1 (377) 555-0271, card 4111 1111 1111 1111, host 10.0.0.256 and 10.0.0.1", "en", "s0", 90), (6, "word " * 30000, "en", "s0", 150000)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(folder / "documents.parquet"))
    docs.limit(0).write.parquet(str(folder / "empty" / "documents.parquet"))
    for at in (folder, folder / "empty"):
        spark.createDataFrame([(0, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
        spark.createDataFrame([(0, 0, "system", "Be <|im_end|> kind"), (0, 1, "user", None), (0, 2, "assistant", "ok <\\|"), (0, 2, "assistant", "ok <\\|"), (None, None, None, "x")], "conv_id long, turn long, role string, text string").write.parquet(str(at / "conversations.parquet"))
        spark.createDataFrame([(0, "http://a/", "<p>"), (1, None, None), (1, "b", ""), (None, None, None)], "page_id long, url string, html string").write.parquet(str(at / "pages.parquet"))
    return str(folder)


def llm():
    from veriref.llm import registry

    return registry.QUERIES


@pytest.mark.parametrize("name", ["op1_quality_outliers", "op2_source_mixing", "op3_merkle_fixity", "op4_byte_bpe", "op5_minhash_fingerprints", "op6_language_id", "op7_pii", "op8_chat_formatting", "op9_simhash_near_dedup", "op10_toxicity"])
def test_odd_and_empty_tables(spark, odd, name):
    rows = llm()[name](spark, odd).collect()
    assert len(rows) == {"op3_merkle_fixity": 3, "op8_chat_formatting": 3}.get(name, len(ODD))
    empty = llm()[name](spark, f"{odd}/empty").collect()
    assert len(empty) == {"op3_merkle_fixity": 3, "op8_chat_formatting": 3}.get(name, 0)


def test_simhash_brute_force():
    from dataclasses import replace

    from veriref.llm import simhash

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = np.unique(np.r_[base, base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)), base ^ np.uint64(0b101), base ^ np.uint64(0b1110000)])
    for blocks in (1, 2):
        own = replace(simhash.EXACT, blocks=blocks)
        rows, anchor, home = simhash.anchors(simhash.points_of(prints[:, None], own.places()[0]), own.reach)
        assert set(rows[home]) == set(range(len(prints)))  # everyone has a home
        homes, members = {}, {}
        for r, a, h in zip(rows.tolist(), anchor.tolist(), home.tolist()):
            members.setdefault(a, set()).add(r)
            if h:
                homes.setdefault(a, set()).add(r)
        met = {(i, j) for a, own_ in homes.items() for i in own_ for j in members[a]}
        close = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None]) <= 2)
        assert all((i, j) in met for i, j in close.tolist())


def components_of(pairs, nodes):
    """By brute force: the least node that each reaches."""
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("at_once", [1 << 21, 1 << 10])
def test_simhash_forest(monkeypatch, at_once):
    from veriref.llm import simhash

    monkeypatch.setattr(simhash, "_COMPARED_AT_ONCE", at_once)  # in one step, and in many with a tree that most belong to
    rng = np.random.default_rng(1)

    def flipped(x, n):
        return x ^ np.array([[sum(1 << int(b) for b in rng.choice(64, n, False)) for _ in range(2)] for _ in x], np.uint64)

    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *(flipped(base, n) for n in (3, 9, 12, 13)), *(flipped(base[:1], 5) for _ in range(300))]), axis=0)
    a, b = simhash.forest(prints[:350], prints, 24)
    ids = simhash.node_ids(prints)
    near = np.argwhere(np.bitwise_count(prints[:350, None] ^ prints[None]).sum(axis=2) <= 24)
    expected = components_of([(int(ids[i]), int(ids[j])) for i, j in near], ids.tolist())
    assert {int(x): int(y) for x, y in zip(a, b)} == {x: y for x, y in expected.items() if x != y}


def test_simhash_query(spark):
    import xxhash

    from veriref.llm import simhash

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), seed=42) for k in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: plain(t) for i, t in rows}
    expected = components_of([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], list(prints))
    got = simhash.op9_simhash_near_dedup(spark, DATA).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {i: (prints[i], expected[i]) for i in prints}


def test_near_copies_go(spark):
    from veriref.llm import simhash

    random.seed(4)
    words = [f"w{k}" for k in range(3000)]
    texts = [" ".join(random.choices(words, k=300)) for _ in range(150)]

    def edited(text, n):
        own = text.split()
        for k in random.sample(range(len(own)), n):
            own[k] = "new"
        return " ".join(own)

    rows = [(k, t, 0) for k, t in enumerate(texts)] + [(1000 + k, edited(t, 3), 1) for k, t in enumerate(texts[:100])] + [(2000, None, 2), (2001, "", 2), (2002, " \t", 2), (2003, "short", 2), (2004, "Short", 2), (None, texts[149], 3), (1, texts[1], 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stays_id int").withColumnRenamed("stays_id", "same")  # columns that clash with the operator's own
    kept = [(r["doc_id"], r["same"]) for r in simhash.drop_near_copies(docs).collect()]
    near = sum(1 for i, _ in kept if i is not None and 1000 <= i < 2000)
    assert near <= 3 and {i for i, _ in kept if i is None or i < 1000 or i >= 2000} == {*range(150), 2000, 2003} and sum(i == 1 for i, _ in kept) == 1
    assert simhash.drop_near_copies(docs.limit(0)).columns == docs.columns and simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_simhash_components(spark):
    from veriref.llm import simhash

    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(path).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_simhash_forests_of_many_tasks_are_merged(spark):
    from veriref.llm import simhash

    rng = np.random.default_rng(6)
    pairs = [(int(x), k) for k in range(40) for x in rng.choice(np.arange(40, 440), 200, replace=False)]  # 40 stars over the same nodes
    pairs += [(-9, -7), (-7, -8), (500, 440), (501, 500)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    few = [(r.a, r.b) for r in simhash.merged(edges).collect()]
    nodes = sorted({x for pair in pairs for x in pair})
    assert len(few) < 2 * len(nodes) < len(pairs) / 8 and components_of(few, nodes) == components_of(pairs, nodes)
    assert {r.node: r.root for r in simhash.components(edges).collect()} == components_of(pairs, nodes)


def test_bpe_is_the_library(spark):
    import base64

    import public_tokenizers
    import tiktoken

    from veriref.llm import bpe

    own = bpe.codec(bpe.RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    random.seed(1)
    signs = list(" \t\n \u0085'stmdrevlLaZ019é中²٣!-.　😀Ᲊ\U00010d40\x1c")
    texts = ["".join(random.choices(signs, k=random.randint(0, 40))) for _ in range(4000)] + ["a" * 3000, "'" * 700, " " * 3000 + "x", ""]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids).tobytes().decode() == text
    with pytest.raises(ValueError):
        own.decode(np.array([60000]))
    del base64


def test_minhash(spark):
    from veriref.llm import minhash

    words = [f"w{k}" for k in range(400)]
    a, b = " ".join(words), " ".join(words[:200] + [f"v{k}" for k in range(200)])
    x, y = ({tuple(t.split()[k : k + 5]) for k in range(396)} for t in (a, b))
    assert abs(minhash.likeness(minhash.fingerprint(a), minhash.fingerprint(b)) - len(x & y) / len(x | y)) < 0.12
    assert minhash.fingerprint(a) == minhash.fingerprint(a.replace(" ", "\n")) and minhash.likeness(minhash.fingerprint(None), minhash.fingerprint(a)) == 0
    alone = [minhash.fingerprint(f"t{k}") for k in range(200)]
    assert len(set(alone)) == 200


def test_minhash_compares_in_one_pass(spark):
    from veriref.llm import minhash

    texts = [(k, f"{k % 3} " + "a text of some words and more " * (k % 4)) for k in range(30)]
    got = minhash.compared(spark.createDataFrame(texts, "doc_id long, text string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 3  # the texts, either side of a union, and what is made of the edited ones
    for r in got.collect():
        own, after = texts[r["doc_id"]][1], texts[(r["doc_id"] + 1) % 30][1]
        made = minhash.fingerprint(own[: len(own) - len(own) // 2] + after[: len(own) // 2])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (minhash.fingerprint(own), made)
        assert (r["near_edited"], r["near_next"]) == (minhash.likeness(r["fingerprint"], made), minhash.likeness(r["fingerprint"], minhash.fingerprint(after)))


def test_pii_brute_force(spark):
    from veriref.llm import pii

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]

    random.seed(3)
    parts = [*"ab._-@+019. 5%()", "é", "😀", "a@b.c", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (377) 555-0271", "\n"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 60))) for _ in range(800)]
    own = pii._base(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "text", "spans").collect()
    for row in own:
        expected = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, texts[row["i"]]) if valid(k, m.group())]
        assert [tuple(s) for s in row["spans"]] == expected


def test_pii_terms(spark):
    from veriref.llm import pii

    rows = [(k, f"common words {'abcdefgh'[k]}x speak of Wolfgang boss@corp.example here {'abcdefgh'[k]}y") for k in range(6)] + [(10 + k, f"common words of nobody {k}") for k in range(40)]
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Wolfgang" not in out[0] and "<EMAIL>" in out[0] and "common words" in out[0] and out[10] == rows[6][1]


def test_pii_terms_of_rare_entities(spark):
    from veriref.llm import pii

    rows = [(k, f"plain words of number {k}. The common matter {k} is settled.") for k in range(300)]
    rows += [(400, "Plain words. The common matter rests with Wolfgang Amadeus, boss@corp.example, as agreed\nplain words of others."), (401, "Call the common matter desk of Constanze at +1 (377) 555-0271. Plain words."), (402, "Ask Constanze on +1 377 555 0271 of the common matter.")]
    rows += [(500 + k, f"Edited copy {k}. The common matter of Nannerl copy@corp.example is written here. Leopold edited it") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["entity"], r["term"]) for r in pii.disclosures(docs).collect()}
    assert {("email:boss@corp.example", "Wolfgang"), ("email:boss@corp.example", "Amadeus"), ("phone:13775550271", "Constanze"), ("email:copy@corp.example", "Nannerl")} <= found
    assert not {t for _, t in found} & {"common", "matter", "words", "plain", "corp", "example", "Leopold", "others"}
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Wolfgang" not in out[400] and "Constanze" not in out[401] and "common matter" in out[400] and out[7] == rows[7][1]


def test_pii_terms_go_everywhere(spark):
    from veriref.llm import pii

    rows = [(k, f"plain words of number {k}. The common matter {k} is settled.") for k in range(300)]
    rows += [(400, "The common matter rests with Wolfgang, boss@corp.example, as agreed. " + "Plain words here. " * 9 + "Later Wolfgang left."), (401, "Plain words were said by Wolfgang yesterday."), (401, "Plain words were said by Wolfgang yesterday."), (402, None)]
    rows += [(403, "Wolfgang is boss@corp.example of plain words."), (404, "Write of the common matter to Wolfgang, boss@corp.example")]
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "Wolfgang" not in out[400] and "Later <TERM> left." in out[400]
    assert out[401] == "Plain words were said by <TERM> yesterday." and out[402] is None and out[7] == rows[7][1]


def test_quality_counts():
    from veriref.llm import quality

    n, chars, symbols, dup, repeat, *_ = quality.counts("a b c\na b c\n#x\n\n#x a b c d é")
    assert (n, symbols, dup, repeat) == (13, 2, 1, 9) and chars == 15
    assert quality.counts(None)[0] == 0 and abs(quality.chi_quantile(0.999, 6) - 22.458) < 0.01


def test_quality_brute_force(spark):
    """The least determinant of all subsets of a small group, and the planted outliers of a large one."""
    import itertools

    from veriref.llm import quality

    rng = np.random.default_rng(5)
    d, n = len(quality.VECTOR), 16
    small = np.r_[rng.normal(0, 0.4, (12, d)), rng.normal(4, 0.4, (4, d))]
    large = np.r_[rng.normal(0, 1, (900, d)), rng.normal(0, 0.1, (200, d)) + 9]
    rows = [("a", *map(float, x)) for x in small] + [("b", *map(float, x)) for x in large]
    found = {r["grp"]: r for r in quality.raw_estimates(spark.createDataFrame(rows, "grp string, " + ", ".join(f"x{k} double" for k in range(d)))).collect()}
    floors, factor = np.diag(np.square(quality.FLOORS)), quality.consistency(quality.COVERAGE)
    dets = {own: np.linalg.slogdet(factor * np.cov(small[list(own)].T, bias=True) + floors)[1] for own in itertools.combinations(range(n), 12)}
    assert abs(found["a"]["log_det"] - min(dets.values())) < 1e-6
    assert np.abs([found["a"][f"m{k}"] - small[list(min(dets, key=dets.get))].mean(axis=0)[k] for k in range(d)]).max() < 1e-6
    center = np.array([found["b"][f"m{k}"] for k in range(d)])
    assert np.abs(center).max() < 0.3  # the masses at 9 haven't moved it


def test_quality_query(spark):
    from veriref.llm import quality

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = {w for w in windows if windows.count(w) > 1} if len(windows) < 1500 else {w for w, c in __import__("collections").Counter(windows).items() if c > 1}
        repeated = len({k + j for k, w in enumerate(windows) if w in often for j in range(3)})
        lines, seen, dup = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
        for line in lines:
            dup += line in seen
            seen.add(line)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, repeated

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in quality.op1_quality_outliers(spark, DATA).collect():
        own = plain(texts[r["doc_id"]])
        assert own == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0]) and not (r["kept"] and r["base_failed"])


def test_mixing_meets_marginals(spark):
    from pyspark.sql import functions as F

    from veriref.llm import mixing

    cells = spark.createDataFrame([(f"s{i}", f"l{j}", "t", 10 * (1 + i * j + i)) for i in range(4) for j in range(3)], "source string, lang string, topic string, tokens long")
    out = mixing.fit(cells, mixing.Mix(targets={"lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}}))
    total = out.agg(F.sum("raked")).first()[0]
    got = {r["lang"]: r["s"] / total for r in out.groupBy("lang").agg(F.sum("raked").alias("s")).collect()}
    assert abs(got["l0"] - 0.5) < 1e-3 and abs(got["l2"] - 0.2) < 1e-3


def test_mixing_excludes(spark):
    from pyspark.sql import functions as F

    from veriref.llm import mixing

    docs = spark.createDataFrame([(k, "some words here " * (k % 5), f"l{k % 2}" if k % 7 else None, "abc"[k % 3], 1) for k in range(60)], "doc_id long, text string, lang string, source string, tokens int")
    out, names = mixing.mixed(docs, F.lit("t"), mixing.Mix(targets={"source": {"a": 1.0}}))
    rows = out.collect()
    assert len(rows) == 60 and all(r["tokens"] == 1 for r in rows)
    assert all((r[names["factor"]] == 0 and not r[names["sampled"]]) for r in rows if r["source"] != "a" and r["text"]) and any(r[names["sampled"]] for r in rows)
    for targets in ({"source": {"a": 0.0}}, {"source": {"z": 1.0}}):
        out, names = mixing.mixed(docs, F.lit("t"), mixing.Mix(targets=targets))
        assert not out.filter(F.col("text") != "").filter(names["sampled"]).count()
    assert mixing.sample(docs.limit(0)).columns == docs.columns and mixing.sample(docs.limit(0)).count() == 0


def test_mixing_sweeps_few_cells_in_one_task(spark, monkeypatch):
    from veriref.llm import mixing

    rng = np.random.default_rng(4)
    rows = [(f"s{s}", f"l{k}", f"t{t}", int(x)) for (s, k, t), x in zip(np.ndindex(5, 3, 2), rng.integers(0, 900, 30), strict=True)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    own = mixing.Mix(targets={"lang": {"l0": 0.7, "l1": 0.3}})  # l2 is excluded
    cuts, held = [], mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df: (cuts.append(df), held(df))[1])

    def fitted(most):
        cuts.clear()
        monkeypatch.setattr(mixing, "CELLS_AT_ONCE", most)
        return {(r.source, r.lang, r.topic): r.factor for r in mixing.fit(cells, own).collect()}, len(cuts)

    (few, of_few), (many, of_many) = fitted(100), fitted(0)
    assert few.keys() == many.keys() and max(abs(few[x] - many[x]) for x in few) < 1e-9
    assert of_few - 5 <= own.sweeps and of_many - 5 == 3 * (of_few - 5)  # a job for each sweep, not for each marginal; 5 come before
    assert any(few.values()) and not any(v for (_, lang, _), v in few.items() if lang == "l2")


def test_mixing_is_its_sql(spark):
    got, expected = against_duck(spark, "op2_source_mixing", DATA, ["documents"])
    assert len(got) == len(expected)
    for x, y in zip(got, expected):
        assert all(a == b or isinstance(a, float) and abs(a - b) <= 2e-6 for a, b in zip(x, y))


def test_chat_windows():
    from veriref.llm import chat

    random.seed(2)
    for _ in range(500):
        turns = [(random.choice(["system", "user", "assistant", "a\\n\nb<|x"]), " ".join(random.choices(["a", "<|im_end|>", "<\\|", "\\", "x<", "|>", "\n"], k=random.randint(0, 30)))) for _ in range(random.randint(1, 30))]
        back, learnt = [], ""
        for w in chat.windows(iter(turns), chat.Settings(60, 20)):
            own = chat.read_back(w["text"])
            assert w["first"] == len(back) and (sum(chat.tokens(t) for _, t in own) <= 60 or w["n_new"] == 1)
            assert turns[0][0] != "system" or own[0] == turns[0]
            back += own[w["n_repeated"] :]
            learnt += "".join(chat.unescape(w["text"][a:b]) for a, b in w["loss"])
        assert back == turns and learnt == "".join(t for r, t in turns if r == "assistant")


def against_duck(spark, name, folder, tables):
    """The rows of a query of this subpackage and those of its SQL, sorted."""
    import duckdb

    from veriref.llm import registry

    con = duckdb.connect()
    for t in tables:
        path = Path(folder) / f"{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{f'{path}/*.parquet' if path.is_dir() else path}')")
    frame = registry.QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    rows = [tuple(r[c] for c in columns) for r in frame.collect()]
    listed = ", ".join('"' + c + '"' for c in columns)
    sql = [tuple(r) for r in con.sql(f"select {listed} from ({registry.ORACLES[name]})").fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(rows, key=key), sorted(sql, key=key)


def test_merkle_finds_what_was_damaged(spark):
    from veriref.llm import warc

    pages = spark.range(9000).selectExpr("id as page_id", "concat('http://x/', id) as url", "concat('body ', id) as html")
    rows = warc.audit(warc.leaves(pages), warc.leaves(warc.replica(pages))).collect()
    found = {r["file"] * warc.FILE_IDS + r["slot"]: r["status"] for r in rows if r["status"] != "intact"}
    assert found == {k: "corrupt" for k in range(9000) if k % 97 == 13 or k % 769 == 5} | {k: "missing" for k in range(9000) if k % 389 == 17}
    offset = 0
    for r in sorted(rows, key=lambda r: (r["file"], r["slot"])):
        offset = 0 if r["slot"] == 0 else offset
        assert r["offset"] == offset
        offset += r["length"]
    same = warc.audit(warc.leaves(pages), warc.leaves(pages)).collect()
    assert {r["n_compared"] for r in same} == {1} and all(r["status"] == "intact" and r["root_a"] == r["root_b"] for r in same)
    one = warc.audit(warc.leaves(pages), warc.leaves(pages.filter("page_id <> 4100"))).collect()
    assert {(r["file"], r["n_compared"]) for r in one} == {(0, 1), (1, 1 + 3 * 16), (2, 1)}  # only the branch above it, its own offsets notwithstanding


def test_merkle_odd_ids(spark, tmp_path):
    rows = [(k, f"u{k}", f"b{k}") for k in (0, 5, 97 + 13, 4095, 4096, 2**60 + 4095, 2**60 + 4096, 2**63 - 1, -1, -4096, -4097, -(2**63))] + [(5, "again", "x"), (5, "again", "x")] + [(None, f"n{k}", None) for k in range(10000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got, expected = against_duck(spark, "op3_merkle_fixity", str(tmp_path), ["pages"])
    assert got == expected and len({r[0] for r in got}) > 5 and sum(r[3] for r in got) >= 10000


def test_language_held_out(spark):
    from veriref.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = tuple(langid.learn(docs))
    rows = [r for r in docs.collect() if __import__("zlib").crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([langid.classify(r["text"], model)[0] == r["lang"] for r in rows]) > 0.97


def test_toxicity_learns():
    from veriref.llm import toxicity

    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(600):
        words = [f"w{x}" for x in rng.integers(0, 300, 60)] + ([f"bad{x}" for x in rng.integers(0, 6, 3)] if k % 5 == 0 else [])
        rows.append(np.array([toxicity.bucket(w) for w in words], np.int32))
        labels.append(float(k % 5 == 0))
    model = toxicity.train(rows[:400], np.array(labels[:400], np.float32), ["en"] * 400)
    predicted = [model.score(model.index[x]) >= toxicity.THRESHOLD for x in rows[400:]]
    assert np.mean(np.array(predicted) == (np.array(labels[400:]) > 0)) > 0.95


def test_toxicity_needs_labels():
    from veriref.llm import toxicity

    model = toxicity.train([np.array([1, 2], np.int32)] * 4, np.array([0, 1, 0, 1], np.float32), ["en"] * 4)
    assert model.score(np.array([1], np.int32)) == 0.0


def test_toxicity_fits_all_documents(spark, monkeypatch):
    from veriref.llm import toxicity

    rng = np.random.default_rng(2)
    rows = [(k, " ".join([f"w{x}" for x in rng.integers(0, 200, 40)] + (["late"] * 2 if k % 3 == 0 else [])), "en", int(k % 3 == 0)) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    seen, held = [], toxicity._averaged
    monkeypatch.setattr(toxicity, "_averaged", lambda got, params: (seen.append(got["docs"].to_pylist()), held(got, params))[1])
    monkeypatch.setattr(toxicity, "_WORDS_AT_ONCE", 16)
    own = toxicity.Settings(replica=300, rounds=2, passes=8)
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), own)
    known = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert [len(x) for x in seen] == [len(known) // 300] * 2 and sum(seen[0]) == sum(seen[1]) and 0.6 * len(known) < sum(seen[0]) < 0.9 * len(known)  # all but those that calibrate
    right = [(model.score(model.index[[toxicity.bucket(w) for w in toxicity.words_of(text)]]) >= toxicity.THRESHOLD) == (toxic > 0) for k, text, _, toxic in rows if k not in set(known)]
    assert np.mean(right) > 0.95
    # Whole texts: what alone tells comes after more words than were once read.
    long = spark.createDataFrame([(k, "x " * 6000 + ("late " if k % 2 else "early ") * 2 + "x " * 300, "en", k % 2) for k in range(80)], "doc_id long, text string, lang string, toxic int")
    one = toxicity.fit(long, long.select("doc_id", "toxic"), toxicity.Settings(steps=40))
    assert one.index[toxicity.bucket("late")] and one.index[toxicity.bucket("early")]


def test_toxicity_replicas_meet_in_the_executors(spark, monkeypatch):
    from veriref.llm import toxicity

    rng = np.random.default_rng(5)
    rows = [(k, " ".join([f"w{x}" for x in rng.integers(0, 200, 40)] + ["late"] * 2 * (k % 3 == 0)), "en", int(k % 3 == 0)) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    sent, held = [], toxicity._embeddings
    monkeypatch.setattr(toxicity, "_embeddings", lambda blocks, before: (sent.append((sum(len(x.as_buffer()) for x in blocks["params"]), before.nbytes)), held(blocks, before))[1])
    toxicity.fit(docs, docs.select("doc_id", "toxic"), toxicity.Settings(replica=200, rounds=2))
    assert len(sent) == 2 and all(got == one for got, one in sent)  # the driver gets one set of embeddings, not one of each of the 4 replicas
    # The average is that of all replicas, by the documents that hold a word; the others stay.
    monkeypatch.setattr(toxicity, "_BLOCK", 3)
    sets, held_by = rng.normal(size=(4, 7, 2)).astype(np.float32), rng.integers(0, 3, (4, 7)).astype(np.float32)
    held_by[:, 5] = 0
    before = rng.normal(size=(7, 2)).astype(np.float32)
    parts = [toxicity._parts([p], r, [None], [held_by[r, 3 * p : 3 * p + 3].tobytes()], [sets[r, 3 * p : 3 * p + 3].tobytes()]) for p in range(3) for r in range(4)]
    import pyarrow as pa

    out = toxicity._embeddings(pa.Table.from_batches(list(toxicity._merged(iter(parts)))), before)
    there = held_by.sum(axis=0) > 0
    assert np.allclose(out[there], ((sets * held_by[:, :, None]).sum(axis=0)[there] / held_by.sum(axis=0)[there, None]), atol=1e-6) and (out[~there] == before[~there]).all()


def test_letters():
    from veriref.llm import langid

    model = (("en", b"the words of a text"), ("de", b"die Worte eines Textes"))
    assert {x: langid.classify(x, model)[0] for x in ("²", "½", "Ⅷ", "12 _", "", None)} == dict.fromkeys(("²", "½", "Ⅷ", "12 _", "", None), "und")
    assert langid.classify("the text", model)[0] == "en"


def test_pipeline_stages():
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "pii", "mixing", "tokens"]
