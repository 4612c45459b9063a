"""Ranked search against scoring every document, and on nulls, ties, repeats, blocks, shards and empty tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from drift_engine.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score) by the definition, document by document."""
    counted = [(doc_id, Counter(found), len(found)) for doc_id, text in docs if (found := terms(text))]
    n, total = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, tf, size in counted:
            m = 10 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, doc_id, -s) for rank, (s, _, _, doc_id) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[int(x)] for x in np.minimum(rng.zipf(1.4, int(rng.integers(1, 60))) - 1, 59))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "!?."), (None, "w3 w3 w7"), (903, "w5 " * 50_000), (904, "W5,w6;Ünï-漢字 w7"), (904, "W5,w6;Ünï-漢字 w7"), (905, "Ä ä ÄÄ\x00w8\x7fw9")]
    docs += [(1000 + i, "tie of equal texts w50") for i in range(30)]
    items = [(1, "w1 w2 w40 w50"), (2, None), (3, ""), (4, "nothing there at all"), (5, "tie tie equal"), (5, "w55"), (None, "W5 ünï ÜNÏ 漢字"), (6, " ".join(words)), (7, "Ä w8 w9")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(a, b, "i", 1, 2) for a, b in docs], "doc_id long, text string, item_id string, score long, rank int").repartition(5)
    return d, spark.createDataFrame([(a, b, 0, "x") for a, b in items], "item_id long, text string, doc_id int, terms string")


def test_against_every_score(spark, rows):
    assert found(ranked_search.search(*frames(spark, *rows))) == plain(*rows)


def test_small_blocks_shards_and_k(spark, rows, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 16)
    docs, items = frames(spark, *rows)
    assert found(ranked_search.search(docs, items, block_terms=3)) == plain(*rows)
    assert found(ranked_search.search(docs, items, k=3)) == plain(*rows, k=3)


def test_no_documents_no_items(spark, rows):
    docs, items = frames(spark, *rows)
    assert ranked_search.search(docs.filter("false"), items).count() == 0
    assert ranked_search.search(docs.filter("text is null"), items).count() == 0
    assert ranked_search.search(docs, items.filter("false")).count() == 0


def test_maxscore_is_exact_and_reads_less():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        lists = []
        for t in range(int(rng.integers(1, 12))):
            places = np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.3, 0.9])).astype(np.int32)
            adds = rng.integers(0, rng.choice([5, 500]), len(places))
            if len(places):
                lists.append((places, adds, int(adds.max())))
        every = np.zeros(n, np.int64)
        for places, adds, _ in lists:
            every[places] += adds
        want = sorted([(-s, p) for p, s in enumerate(every.tolist()) if s > 0])[:k]
        places, scores, _ = ranked_search.maxscore(lists, n, k)
        assert sorted(zip((-scores).tolist(), places.tolist()))[:k] == want
        least = -want[-1][0] if want else 1
        places, scores, _ = ranked_search.maxscore(lists, n, k, least)
        assert [x for x in sorted(zip((-scores).tolist(), places.tolist())) if x[0] <= -least][:k] == want
    rare, common = (np.arange(0, 5000, 100), np.full(50, 900), 900), (np.arange(5000), np.arange(5000) % 7, 6)
    *_, read = ranked_search.maxscore([common, rare], 5000, 10)
    assert read == 100


def test_of_given_tables(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert found(ranked_search.search(docs, items)) == plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
