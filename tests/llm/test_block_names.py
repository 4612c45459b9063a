"""Block naming against grouping by whole texts, and on nulls, ties, repeats, shared keys and empty tables."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from drift_engine.llm import block_names

DDL = "doc_id long, text string, row long, name string, level int, kept string, keys string, left int"
GONE = str.maketrans("", "", " \t\n\x0b\x0c\r")


@pytest.fixture(scope="module")
def rows():
    long = "".join(chr(97 + (i * i) % 26) for i in range(20_000))
    return [
        (1, None), (2, ""), (3, " \n\t\x0b\x0c\r"), (None, "   "), (4, "a b c"), (5, "abc"), (6, "a  b  c"), (6, "a  b  c"), (None, "abc"),
        (7, "ABC"), (8, "a bc"), (9, long), (10, long[:9000] + " \n " + long[9000:]), (11, long + "x"), (12, long[:-1]), (13, long[:1024]), (14, long[:2048]), (15, long[1024:2048] + long[:1024]),
        (16, "漢" * 1500), (17, "漢" * 700 + " " + "漢" * 800), (18, "漢" * 1499 + "字"), (19, long), (20, "x" * 1024), (21, "x" * 2048), (22, "x" * 3072), (23, "x" * 4096),
    ]


def plain(rows):
    """(doc_id, keep_id, group_size, kept, sha) of every row, by grouping the texts themselves."""
    groups = defaultdict(list)
    for at, (doc_id, text) in enumerate(rows):
        groups[(text or "").translate(GONE)].append((-len(text or ""), doc_id is None, doc_id or 0, at, doc_id))
    out = []
    for text, found in groups.items():
        first = min(found, key=lambda x: x[:3])
        kept = [x[4] for x in found].index(first[4])
        out += [(x[4], first[4], len(found), i == kept, hashlib.sha256(text.encode()).hexdigest()) for i, x in enumerate(found)]
    return sorted(out, key=repr)


def of(spark, rows):
    return spark.createDataFrame([(a, b, 1, "n", 2, "k", "z", 3) for a, b in rows], DDL).repartition(3)


def results(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_against_plain_groups(spark, rows):
    assert results(block_names.exact_duplicates(of(spark, rows))) == plain(rows)


def test_keys_widen_until_no_two_blocks_share_one(spark, rows):
    """One byte a key at first: blocks share keys, and identities still are the texts'."""
    assert len({block_names.block_key(t.encode(), 1) for t in map(str, range(300))}) < 300
    docs = [*rows, *((100 + i, f"text {i % 290}") for i in range(300))]
    assert results(block_names.exact_duplicates(of(spark, docs), key_bytes=1, size=64)) == plain(docs)


def test_names_are_of_sequences(spark):
    """The same blocks in another order, or another number of them, have other names; names are dense and don't depend on partitions."""
    docs = [(1, "aabb"), (2, "bbaa"), (3, "aabbaa"), (4, "aabb"), (5, "aa"), (6, "aaaa"), (7, "aaaaaa"), (8, "aaaaaaaa"), (9, "aabbaabb")]
    found = [{r["doc_id"]: (r["level"], r["name"]) for r in block_names.identities(of(spark, docs).repartition(n), size=2).collect()} for n in (1, 4)]
    assert found[0] == found[1]
    assert found[0][1] == found[0][4] and len(set(found[0].values())) == 8
    assert {k: v[0] for k, v in found[0].items()} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 0, 6: 1, 7: 2, 8: 2, 9: 2}


def test_kept_rows_and_no_rows(spark, rows):
    docs = of(spark, rows)
    kept = block_names.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r[0] for r in plain(rows) if r[3]), key=repr)
    empty = docs.filter(F.lit(False))
    assert block_names.exact_duplicates(empty).count() == 0 and block_names.kept_documents(empty).count() == 0


def test_of_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert results(block_names.exact_duplicates(docs)) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
