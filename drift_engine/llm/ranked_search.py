"""Ranked lexical search by MaxScore over shards of documents."""

from __future__ import annotations

from array import array
from functools import partial
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.llm.common import materialise, running_total, small_batches, utf8_buffers

#: Documents that an item gets.
TOP = 10
#: A shard ends at so many documents with a term of the items, or occurrences of such terms.
SHARD_DOCS = 8192
SHARD_OCCURRENCES = 2_000_000
#: Items are answered in blocks of about so many terms; a block's terms and their counts are what the driver holds.
BLOCK_TERMS = 200_000
#: Length normalisation in per cent, as the ranking's definition has it.
B_PERCENT = 90

#: Bytes of terms, A-Z lower-cased; all others are blanks.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

#: One shard: its documents' ids and term counts, its distinct terms, where each one's postings begin, and the postings.
_SHARD = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), *((name, pa.binary()) for name in ("ids", "known", "lengths", "terms", "begins", "places", "tfs"))])
_SHARD_DDL = "n_docs long, n_terms long, ids binary, known binary, lengths binary, terms binary, begins binary, places binary, tfs binary"
_HITS = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _texts(column: pa.Array):
    raw, offsets = utf8_buffers(column)
    data = raw.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b]


def weight(n: int, df: int) -> int:
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


class _Shard:
    """Collects documents until it is full."""

    def __init__(self):
        self.ids, self.known, self.lengths, self.found, self.held = [], [], [], array("i"), []
        self.n_docs = self.n_terms = 0

    def add(self, doc_id, terms: list[bytes], number: dict[bytes, int]) -> None:
        self.n_docs += bool(terms)
        self.n_terms += len(terms)
        own = [number[t] for t in terms if t in number]
        if own:
            self.ids.append(doc_id if doc_id is not None else np.iinfo(np.int64).max)
            self.known.append(doc_id is not None)
            self.lengths.append(len(terms))
            self.held.append(len(own))
            self.found.extend(own)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.found) >= SHARD_OCCURRENCES

    def row(self) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(self.ids), dtype=np.int64), self.held)
        key = np.frombuffer(self.found, np.int32).astype(np.int64) * max(len(self.ids), 1) + owner
        posting, tfs = np.unique(key, return_counts=True)
        term, places = np.divmod(posting, max(len(self.ids), 1))
        terms, begins = np.unique(term, return_index=True)
        parts = np.array(self.ids, np.int64), np.array(self.known, bool), np.array(self.lengths, np.int64), terms.astype(np.int32), np.append(begins, len(posting)).astype(np.int64), places.astype(np.int32), tfs.astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([self.n_docs], pa.int64()), pa.array([self.n_terms], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], schema=_SHARD)


def _index(batches, number: dict[bytes, int]):
    shard = _Shard()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch.column("text"))):
            shard.add(doc_id, terms_of(text), number)
            if shard.full():
                yield shard.row()
                shard = _Shard()
    yield shard.row()


def _term_counts(batches):
    for batch in batches:
        for terms, begins in zip(batch.column("terms").to_pylist(), batch.column("begins").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int32)), pa.array(np.diff(np.frombuffer(begins, np.int64)))], names=["term", "df"])


def maxscore(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, postings read) of all documents that can be among the k best with a score of `least` or more.

    lists: a term's places in ascending order, what it adds to each, and the largest of
    that. In descending order of their bounds lists are essential, and read whole, until
    the bounds of the others add up to less than the k-th best score so far: a document in
    none of the essential lists then can't qualify. The others are probed for documents
    whose score so far and bounds to come still reach that score.
    """
    lists = sorted(lists, key=lambda x: -x[2])
    rest = np.append(np.cumsum([x[2] for x in lists][::-1])[::-1], 0)
    score = np.zeros(n_docs, np.int64)
    read = essential = 0
    while essential < len(lists) and rest[essential] >= least:
        places, adds, _ = lists[essential]
        score[places] += adds
        read += len(places)
        essential += 1
        if n_docs >= k:
            least = max(least, int(np.partition(score, n_docs - k)[n_docs - k]))
    places = np.flatnonzero(score + rest[essential] >= least)
    places = places[score[places] > 0]
    scores = score[places]
    for j in range(essential, len(lists)):
        own, adds, _ = lists[j]
        at = np.minimum(np.searchsorted(own, places), len(own) - 1)
        scores = scores + np.where(own[at] == places, adds[at], 0)
        read += len(places)
        if len(scores) >= k:
            least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        stay = scores + rest[j + 1] >= least
        places, scores = places[stay], scores[stay]
    stay = scores >= least
    return places[stay], scores[stay], read


def _search(batches, items: list[tuple[int, list[int]]], weights: dict[int, int], n: int, total: int, k: int):
    best: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            ids, known, lengths = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool), np.frombuffer(r["lengths"], np.int64)
            if not len(ids):
                continue
            # Beyond 64 bits for very long texts among very many, hence Python's integers.
            longest, back = np.unique(lengths, return_inverse=True)
            m = np.array([100 - B_PERCENT + (B_PERCENT * int(x) * n) // total for x in longest], np.int64)[back]
            places, tfs = np.frombuffer(r["places"], np.int32), np.frombuffer(r["tfs"], np.int32).astype(np.int64)
            begins, lists = np.frombuffer(r["begins"], np.int64), {}
            share = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[places])
            for term, a, b in zip(np.frombuffer(r["terms"], np.int32).tolist(), begins[:-1].tolist(), begins[1:].tolist()):
                adds = weights[term] * share[a:b]
                lists[term] = places[a:b], adds, int(adds.max())
            for item, terms in items:
                # What this task has found so far bounds what a later shard must reach.
                held = best.get(item)
                least = int(held[0][-1]) if held is not None and len(held[0]) == k else 1
                at, scores, _ = maxscore([lists[t] for t in terms if t in lists], len(ids), k, least)
                if len(at):
                    new = scores, ids[at], known[at]
                    held = [np.concatenate(pair) for pair in zip(held, new)] if held is not None else list(new)
                    order = np.lexsort((held[1], -held[0]))[:k]
                    best[item] = [x[order] for x in held]
    for item, (scores, ids, known) in best.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int64)), pa.array(ids, pa.int64(), mask=~known), pa.array(scores, pa.int64())], schema=_HITS)


def _item_terms(batches):
    for batch in batches:
        found = [sorted(set(terms_of(t))) for t in _texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary())), pa.array([max(len(f), 1) for f in found], pa.int64())], names=["item_id", "terms", "n"])


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents with a score above 0; equal scores by doc_id, null last.

    Items are taken in blocks of about `block_terms` terms. For a block, one pass over all
    whole texts writes shards: runs of a task's documents with the postings of the block's
    terms; document frequencies, lengths and counts are sums over all shards. Then each
    task runs maxscore() over its shards for every item, and an item's k best of each task
    meet in one window, of which Spark takes the first k before the shuffle.

    Null text has no terms. Repeated documents are documents each, and repeated items each
    have rows of their own. No documents, or no items, give no rows. Other columns are not
    read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = materialise(asked.mapInArrow(_item_terms, "item_id long, terms array<binary>, n long").withColumn("item", F.monotonically_increasing_id()), "search-items")
    asked = materialise(running_total(asked, "item", "n").select("item", "item_id", "terms", F.floor(F.col("before") / block_terms).alias("block")), "search-blocks")
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = (asked.agg(F.max("block")).first()[0] if not asked.isEmpty() else -1) + 1
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        own = asked.filter(F.col("block") == block)
        rows = [(r["item"], [bytes(t) for t in r["terms"]]) for r in own.orderBy("item").collect()]
        number = {t: i for i, t in enumerate(sorted({t for _, terms in rows for t in terms}))}
        shards = materialise(texts.mapInArrow(partial(_index, number=number), _SHARD_DDL), "search-shards")
        sums = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
        n, total = sums["n"] or 0, sums["total"] or 0
        if not n:
            continue
        df = shards.select("terms", "begins").mapInArrow(_term_counts, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        weights = {r["term"]: weight(n, r["df"]) for r in df}
        queries = [(item, [number[t] for t in terms]) for item, terms in rows]
        hits = materialise(shards.mapInArrow(partial(_search, items=queries, weights=weights, n=n, total=total, k=k), "item long, doc_id long, score long"), "search-hits")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = out.unionByName(ranked.join(own.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))
    return out
