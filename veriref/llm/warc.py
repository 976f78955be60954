"""Operator 3: Merkle fixity audit of WARC replicas.

Pages are framed as WARC records and dealt to files by ranges of FILE_IDS page ids; a record's place in its file is its
slot, and records lie there in the order of slots. A slot is a leaf: the number and lengths of its records and their
SHA-256 digests. FANOUT consecutive leaves make a node, FANOUT nodes one of the next level, up to one root for each
file. A node's hash is that of its children in order, each with the offset range that it has within the node; so a
node covers an ordered range of offsets, and a record that is lost changes the hashes above it and no others. Of two
replicas first the roots are compared; only below nodes that differ (or that one replica lacks) are the children
compared, and so down to the leaves.

Digests and leaves are made by the JVM with partial aggregates. The leaves of a file, FILE_IDS at most, then
meet those of its replica in one task, which builds both trees and descends: a file is some 400 kB, whatever the input.

Defined results: a null url or body counts as empty. Rows that repeat an id share its leaf, whose digests are added up
in five numbers (their order doesn't matter and none is collected), so an id of any number of rows is one leaf. Rows of
a null id are in the file NULL_FILE, dealt to slots by their digests. Ids may be negative or of any size: ranges are
exact. A leaf that a replica lacks, or has besides, is reported as `missing` or `extra`. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriref.llm.common import cut, table

FANOUT, LEVELS = 16, 3
#: A file holds the pages of so many consecutive ids.
FILE_IDS = FANOUT**LEVELS
#: No range of ids has this number.
NULL_FILE = -(1 << 52)
_CRLF = "\r\n"
#: Digits of a digest that are added up as one number: (first, how many).
_PARTS = [(1, 15), (16, 15), (31, 15), (46, 15), (61, 4)]


def record(url: Column, body: Column) -> Column:
    """A page as a WARC response record."""
    text = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit(f"WARC/1.0{_CRLF}WARC-Type: response{_CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{_CRLF}Content-Type: application/http{_CRLF}Content-Length: "), F.octet_length(text).cast("string"), F.lit(_CRLF * 2))
    return F.concat(head, text, F.lit(_CRLF * 2))


def leaves(pages: DataFrame) -> DataFrame:
    """file, slot, n, length and digest of each leaf; of pages: page_id, url, html."""
    framed = pages.select(F.col("page_id").cast("long").alias("page_id"), record(F.col("url"), F.col("html")).alias("record"))
    hashed = framed.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    at = F.pmod("page_id", F.lit(FILE_IDS))
    by_digest = F.conv(F.substring("digest", 1, 3), 16, 10).cast("long")
    # Exact: what is left over has been taken off before it is divided, in decimals, for the least of all ids.
    file = F.expr(f"cast((cast(page_id as decimal(20, 0)) - pmod(page_id, {FILE_IDS})) div {FILE_IDS} as bigint)")
    placed = hashed.select(F.coalesce(file, F.lit(NULL_FILE)).alias("file"), F.coalesce(at, by_digest).cast("long").alias("slot"), "length", "digest")
    sums = [F.sum(F.conv(F.substring("digest", low, n), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{k}") for k, (low, n) in enumerate(_PARTS)]
    found = placed.groupBy("file", "slot").agg(F.count("*").alias("n"), F.sum("length").alias("length"), *sums)
    return found.select("file", "slot", "n", "length", F.sha2(F.concat_ws(":", "n", "length", *[f"s{k}" for k in range(len(_PARTS))]), 256).alias("digest"))


def tree(own: dict[int, tuple[int, str]]) -> list[dict[int, tuple[int, str]]]:
    """Length and digest by node, for each level: the leaves first, the root last."""
    levels = [own]
    for _ in range(LEVELS):
        above: dict[int, tuple[int, list[str]]] = {}
        for node in sorted(levels[-1]):
            length, digest = levels[-1][node]
            end, parts = above.setdefault(node // FANOUT, (0, []))
            parts.append(f"{node}:{end}:{length}:{digest}")
            above[node // FANOUT] = end + length, parts
        levels.append({k: (end, hashlib.sha256(",".join(parts).encode()).hexdigest()) for k, (end, parts) in above.items()})
    return levels


def descend(one: list[dict], other: list[dict]) -> tuple[int, list[int]]:
    """Of two trees: how many nodes were compared, and the leaves that differ."""
    compared, open_ = 0, {0}
    for a, b in zip(reversed(one), reversed(other), strict=True):
        here = sorted(open_ & (a.keys() | b.keys()))
        compared += len(here)
        differing = [k for k in here if a.get(k) != b.get(k)]
        open_ = {child for k in differing for child in range(k * FANOUT, (k + 1) * FANOUT)}
    return compared, differing


_AUDITED = 'file long, slot long, offset long, length long, n_a long, n_b long, status string, root_a string, root_b string, n_compared long'


def _audit(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
    """Of the leaves of one file in two replicas: a row for each leaf of either."""
    file = int((one if len(one) else other)["file"].iloc[0])
    a, b = (x.set_index("slot") for x in (one, other))
    trees = [tree(dict(zip(x.index.tolist(), zip(x["length"].tolist(), x["digest"].tolist(), strict=True), strict=True))) for x in (a, b)]
    compared, differing = descend(*trees)
    roots = [x[-1][0][1] if x[-1] else None for x in trees]
    offsets = a["length"].sort_index().cumsum() - a["length"].sort_index()
    rows = pd.DataFrame(index=a.index.union(b.index))
    rows["status"] = "intact"
    rows.loc[differing, "status"] = ["missing" if k not in b.index else "extra" if k not in a.index else "corrupt" for k in differing]
    rows["offset"], rows["length"] = offsets.astype("Int64"), a["length"].astype("Int64")
    rows["n_a"], rows["n_b"] = (x["n"].reindex(rows.index).fillna(0).astype("int64") for x in (a, b))
    rows["root_a"], rows["root_b"] = roots
    return rows.rename_axis("slot").reset_index().assign(file=file, n_compared=compared)[[x.split()[0] for x in _AUDITED.split(", ")]]


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """Of the leaves of two replicas: a row for each leaf of either, with its range in the first, its status, the roots of its file, and how many nodes of the file were compared."""
    return one.groupBy("file").cogroup(other.groupBy("file")).applyInPandas(_audit, _AUDITED)


def replica(pages: DataFrame) -> DataFrame:
    """A second copy for the query, damaged by rule: of every 97 ids one has a changed byte, of every 389 one is lost, of every 769 one is there twice."""
    spoilt = pages.withColumn("html", F.when(F.pmod("page_id", F.lit(97)) == 13, F.concat(F.lit("~"), F.substring("html", 2, 2147483647))).otherwise(F.col("html")))
    lost = spoilt.filter(F.coalesce(F.pmod("page_id", F.lit(389)) != 17, F.lit(True)))
    again = pages.filter(F.pmod("page_id", F.lit(769)) == 5)
    return lost.unionByName(again)


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(cut(leaves(pages)), cut(leaves(replica(pages))))


def _sql_tree(name: str, source: str) -> str:
    """CTEs of one replica's leaves and levels."""
    framed = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: application/http' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
    mod = f"((page_id % {FILE_IDS} + {FILE_IDS}) % {FILE_IDS})"
    sums = ", ".join(f"sum(('0x' || substr(digest, {low}, {n}))::bigint)::varchar as s{k}" for k, (low, n) in enumerate(_PARTS))
    parts = [
        f"{name}_hashed as materialized (select page_id, octet_length(encode(record)) as length, sha256(record) as digest from (select page_id, {framed} as record from {source}))",
        f"{name}_placed as (select coalesce((page_id::hugeint - {mod}) // {FILE_IDS}, {NULL_FILE})::bigint as file, coalesce({mod}, ('0x' || substr(digest, 1, 3))::bigint) as slot, length, digest from {name}_hashed)",
        f"{name} as materialized (select file, slot, count(*) as n, sum(length)::bigint as length, {sums} from {name}_placed group by all)",
        f"{name}0 as materialized (select file, slot as node, length, sha256(concat_ws(':', n, length, {', '.join(f's{k}' for k in range(len(_PARTS)))})) as digest from {name})",
    ]
    for k in range(LEVELS):
        before = f"coalesce(sum(length) over (partition by file, node // {FANOUT} order by node rows between unbounded preceding and 1 preceding), 0)::bigint"
        parts.append(f"{name}{k}_ranged as (select file, node, length, concat_ws(':', node, {before}, length, digest) as entry from {name}{k})")
        parts.append(f"{name}{k + 1} as materialized (select file, node // {FANOUT} as node, sum(length)::bigint as length, sha256(string_agg(entry, ',' order by node)) as digest from {name}{k}_ranged group by file, node // {FANOUT})")
    return ", ".join(parts)


def _sql_compared() -> str:
    """CTEs that count the nodes compared: the children of nodes that differ, level by level."""
    parts = []
    for k in range(LEVELS, -1, -1):
        both = f"select coalesce(x.file, y.file) as file, coalesce(x.node, y.node) as node, x.digest is distinct from y.digest or x.length is distinct from y.length as differs from a{k} x full join b{k} y on x.file = y.file and x.node = y.node"
        below = "" if k == LEVELS else f" where exists (select 1 from d{k + 1} p where p.differs and p.file = z.file and p.node = z.node // {FANOUT})"
        parts.append(f"d{k} as materialized (select * from ({both}) z{below})")
    every = " union all ".join(f"select file from d{k}" for k in range(LEVELS + 1))
    return ", ".join([*parts, f"compared as (select file, count(*) as n_compared from ({every}) group by file)"])


ORACLE = f"""with spoilt as (select page_id, url, case when (page_id % 97 + 97) % 97 = 13 then '~' || substr(html, 2) else html end as html from pages),
copied as (select * from spoilt where coalesce((page_id % 389 + 389) % 389 <> 17, true) union all select page_id, url, html from pages where (page_id % 769 + 769) % 769 = 5),
{_sql_tree("a", "pages")}, {_sql_tree("b", "copied")}, {_sql_compared()},
placed as (select file, slot, n, length, coalesce(sum(length) over (partition by file order by slot rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from a)
select coalesce(p.file, b.file) as file, coalesce(p.slot, b.slot) as slot, p."offset", p.length, coalesce(p.n, 0) as n_a, coalesce(b.n, 0) as n_b,
case when x.digest is not distinct from y.digest then 'intact' when x.digest is null then 'extra' when y.digest is null then 'missing' else 'corrupt' end as status,
ra.digest as root_a, rb.digest as root_b, c.n_compared
from placed p full join b on p.file = b.file and p.slot = b.slot left join a0 x on x.file = coalesce(p.file, b.file) and x.node = coalesce(p.slot, b.slot) left join b0 y on y.file = coalesce(p.file, b.file) and y.node = coalesce(p.slot, b.slot)
left join a{LEVELS} ra on ra.file = coalesce(p.file, b.file) left join b{LEVELS} rb on rb.file = coalesce(p.file, b.file) join compared c on c.file = coalesce(p.file, b.file)"""
