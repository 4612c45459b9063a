"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes weighted by likeness."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_engine.llm.common import materialise, small_batches

#: Bound on the labelled rows that are learnt from: half of them of each label at most.
MOST_EXAMPLES = 4000
#: A term's weight grows with what it says about the label, up to this share of all there is to say; and is never less than the floor.
TELLING = 0.1
FLOOR = 0.001
NEIGHBOURS = 25
BLOCK = 16
#: Examples of the highest bounds that are scored before the others' bounds are held against the k-th best.
FIRST = 64
#: Posting lists of more than this share of the examples are long: bounded by block first, and read only for examples that may matter.
LONG = 1 / 16
#: Cosines are sums in single precision; bounds must clear them by so much.
MARGIN = 1e-5
SEED = 9
THRESHOLD = 0.7
#: Texts whose results a task remembers for their copies.
SEEN = 20_000

_BREAKS = bytes(32 if not (48 <= c < 58 or 97 <= c < 123 or c >= 128) else c for c in range(256))


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learnt from: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def words_of(text: str) -> list[bytes]:
    """The text's terms: runs of letters and digits, in lower case."""
    return text.lower().encode("utf-8", "replace").translate(_BREAKS).split()


def information(n1: float, n0: float, with1: np.ndarray, with0: np.ndarray) -> np.ndarray:
    """How much a term's presence says about the label, as a share of the label's entropy."""
    n = n1 + n0
    here = with1 + with0

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    told = part(with1, here * n1 / n) + part(with0, here * n0 / n) + part(n1 - with1, (n - here) * n1 / n) + part(n0 - with0, (n - here) * n0 / n)
    entropy = -n1 * np.log(n1 / n) - n0 * np.log(n0 / n)
    return np.maximum(told, 0) / entropy


@dataclass
class Index:
    """The labelled examples as unit vectors over all their terms, inverted.

    starts, rows, weights: the posting list of each term in order of the vocabulary,
    with places of examples ascending. Examples stand in blocks of BLOCK. idf is each
    term's factor, inverse document frequency and telling weight in one.
    """

    vocabulary: list[bytes]
    idf: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    weights: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    shares: np.ndarray  # what an example's vote counts, so that the labels' shares are those of all labelled rows
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        n, lengths = len(self.labels), np.diff(self.starts)
        self.blocks = -(-n // BLOCK)
        long = np.flatnonzero(lengths > max(BLOCK, LONG * n))
        self.long_row = np.full(len(lengths), -1, np.int64)
        self.long_row[long] = np.arange(len(long))
        #: Weights in the long lists, by example and list; and each block's largest, by list and block.
        self.long = np.zeros((self.blocks * BLOCK, len(long)), np.float32)
        for k, t in enumerate(long):
            at = slice(self.starts[t], self.starts[t + 1])
            self.long[self.rows[at], k] = self.weights[at]
        self.peaks = np.ascontiguousarray(self.long.reshape(self.blocks, BLOCK, len(long)).max(1).T) if n else np.zeros((0, 0), np.float32)

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("long", "peaks")}

    def __setstate__(self, state):
        vars(self).update(state)
        self.__post_init__()

    def unit(self, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(counts)) * self.idf[places]
        return places, weight / np.sqrt((weight**2).sum())

    def nearest(self, places: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, the first of equals, exactly.

        Short lists are added up for all examples. An example's bound is that sum plus its
        block's largest weights in the long lists; the examples with the highest bounds are
        scored, then all others whose bound reaches the k-th best of them.
        """
        row = self.long_row[places]
        short = row < 0
        at, w = places[short], weight[short]
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        where = np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        score = np.bincount(self.rows[where], self.weights[where] * np.repeat(w, lengths), minlength=self.blocks * BLOCK)
        full = np.zeros(self.long.shape[1], np.float32)
        full[row[~short]] = weight[~short]
        high = np.einsum("i,ij->j", full[row[~short]], self.peaks[row[~short]])
        bound = (score.reshape(self.blocks, BLOCK) + high[:, None]).ravel()

        # einsum, as a multiplication of matrices of this size would start threads of its own.
        def scored(at: np.ndarray) -> np.ndarray:
            if 2 * len(at) > len(bound):
                cosine = (score + np.einsum("ij,j->i", self.long, full))[at]
            else:
                cosine = score[at] + np.einsum("ij,j->i", self.long[at], full)
            cosine[at == skip] = 0
            return cosine

        least = 0.0
        if len(bound) > FIRST + k:
            first = scored(np.argpartition(bound, -FIRST)[-FIRST:])
            least = np.partition(first, -k)[-k] if k <= FIRST else 0.0
        at = np.flatnonzero(bound >= max(least - MARGIN, 1e-30))
        cosine = scored(at)
        at, cosine = at[cosine > 0], cosine[cosine > 0]
        if len(at) > k:
            good = cosine >= np.partition(cosine, -k)[-k]
            at, cosine = at[good], cosine[good]
        first = np.lexsort((at, -cosine))[:k]
        return at[first], cosine[first]

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Share of label 1 among the neighbours by cosine, drawn a little to the share among all labelled rows."""
        weight = cosine * self.shares[at]
        return float((weight @ self.labels[at] + 1e-3 * self.prior) / (weight.sum() + 1e-3))

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * _logit(vote) + self.shift))))


def _logit(vote):
    v = np.clip(vote, 1e-3, 1 - 1e-3)
    return np.log(v / (1 - v))


def _calibrate(index: Index) -> None:
    """Fits score() as a logistic curve of the examples' own votes, each without itself: Newton steps, halved where they don't help."""
    votes = np.full(len(index.labels), index.prior)
    of_row = np.argsort(index.rows, kind="stable")
    terms = np.repeat(np.arange(len(index.vocabulary)), np.diff(index.starts))[of_row]
    ends = np.concatenate([[0], np.cumsum(np.bincount(index.rows, minlength=len(index.labels)))])
    for i in range(len(votes)):
        own = slice(ends[i], ends[i + 1])
        if ends[i] < ends[i + 1]:
            votes[i] = index.vote(*index.nearest(terms[own], index.weights[of_row[own]], skip=i))
    x, y, w = np.stack([_logit(votes), np.ones(len(votes))], 1), index.labels, index.shares

    def loss(theta):
        z = x @ theta
        return float(w @ (np.logaddexp(0, z) - y * z) + 0.5 * ((theta - [1, 0]) ** 2).sum())

    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ theta)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (w * (p - y)) + theta - [1, 0])
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(step).max() < 1e-9:
            break
    index.slope, index.shift = max(float(theta[0]), 1e-3), float(theta[1])


class _Places(dict):
    """Places of terms in the vocabulary; -1 for others."""

    def __missing__(self, term: bytes) -> int:
        return -1

    def of(self, terms) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, terms), np.int64, len(terms))


def _example_terms(batches):
    for batch in batches:
        found = [Counter(words_of(t.as_py() or "")) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(x) for x in found], pa.list_(pa.binary())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))], names=["doc_id", "label", "terms", "counts"])


def frequencies(texts: DataFrame, vocabulary: list[bytes]) -> tuple[np.ndarray, int]:
    """How many of all texts (column text) have each term, and their number. A task sends one row for each term that it met."""
    known = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        place = _Places({t: i for i, t in enumerate(known.value)})
        df = np.zeros(len(place) + 1, np.int64)
        for batch in batches:
            met = np.concatenate([np.zeros(0, np.int64), *[place.of(set(words_of(text.as_py() or ""))) for text in batch.column(0)]])
            df += np.bincount(met[met >= 0], minlength=len(df))
            df[-1] += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    rows = texts.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return df[:-1], int(df[-1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES, seed: int = SEED) -> Index:
    """The index over at most `most` labelled rows that are not held out, with every term of theirs; document frequencies are of all documents."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    pick = lambda y: known.filter(F.col("label") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most // 2)
    # At most `most` rows of two numbers are broadcast.
    chosen = F.broadcast(pick(0).union(pick(1)))
    examples = texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = materialise(examples.mapInArrow(_example_terms, "doc_id long, label int, terms array<binary>, counts array<int>"), "toxic-examples").toArrow()
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    label = rows["label"].to_numpy().astype(float)
    n1, n0 = float(label.sum()), float((1 - label).sum())
    empty = np.zeros(0, np.int64)
    if not n1 or not n0:
        return Index([], np.zeros(0), np.zeros(1, np.int64), empty, np.zeros(0), np.zeros(0), empty, np.zeros(0), prior)
    flat = pa.concat_arrays([c.flatten() for c in rows["terms"].chunks])
    counts = pa.concat_arrays([c.flatten() for c in rows["counts"].chunks]).to_numpy(zero_copy_only=False)
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in rows["terms"].chunks])
    coded = flat.dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), object)
    order = np.argsort(names, kind="stable")
    code = np.empty(len(names), np.int64)
    code[order] = np.arange(len(names))
    vocabulary, term = names[order].tolist(), code[coded.indices.to_numpy(zero_copy_only=False)]
    owner = np.repeat(np.arange(len(label)), sizes)
    df, total = frequencies(texts, vocabulary)
    told = information(n1, n0, np.bincount(term, label[owner], len(vocabulary)), np.bincount(term, 1 - label[owner], len(vocabulary)))
    idf = (np.log((1 + total) / (1 + df)) + 1) * (np.minimum(told / TELLING, 1) + FLOOR)
    weight = (1 + np.log(counts)) * idf[term]
    weight = weight / np.sqrt(np.bincount(owner, weight**2, len(label)))[owner]
    # Examples with the same heaviest term stand together, so that most blocks are far from a query.
    heaviest = np.full(len(label), len(vocabulary))
    by_weight = np.lexsort((term, weight))
    heaviest[owner[by_weight]] = term[by_weight]
    ids = rows["doc_id"].to_numpy()
    order = np.lexsort((ids, heaviest))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_term = np.lexsort((place[owner], term))
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))])
    weights = np.where(label == 1, prior / n1, (1 - prior) / n0) * len(label)
    index = Index(vocabulary, idf, starts, place[owner][by_term], weight[by_term], label[order], ids[order], weights[order], prior)
    _calibrate(index)
    return index


def judged(text: str, index: Index, place: _Places, neighbours: int = NEIGHBOURS) -> tuple[float, list[int]]:
    """A text's score and evidence."""
    found = Counter(words_of(text))
    places, counts = place.of(found), np.fromiter(found.values(), np.float64, len(found))
    known = places >= 0
    if not known.any():
        return index.score(index.prior) if index.vocabulary else index.prior, []
    at, cosine = index.nearest(*index.unit(places[known], counts[known]), neighbours)
    vote = index.vote(at, cosine)
    return index.score(vote), index.ids[at[index.labels[at] == (vote >= 0.5)]].tolist()


def scored(docs: DataFrame, index: Index, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted, and evidence: ids of the nearest examples with the label that won, nearest first.

    Only the text makes the score. Vectors have all terms of the examples; other words
    of a text are in no example, so they change no order of neighbours. Null and empty
    texts, and texts without a term, get the score of the labelled rows' share of label
    1, and no evidence. Repeated rows score alike. No documents give no rows; without
    labels of both kinds every score is the share of label 1 (0 without any). Other
    columns are not read.
    """
    # MOST_EXAMPLES examples' terms at most, each a number, a place and a weight.
    model = docs.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64()))])

    def judge(batches):
        index = model.value
        place = _Places({t: i for i, t in enumerate(index.vocabulary)})
        seen: dict[bytes, tuple[float, list[int]]] = {}
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column(2):
                text = (text.as_py() or "").encode("utf-8", "replace")
                key = xxhash.xxh3_128_digest(text)
                if key not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen[key] = judged(text.decode(), index, place, neighbours)
                scores.append(seen[key][0])
                evidence.append(seen[key][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    rows = rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, evidence array<long>")
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """scored() by the index that fit() makes of the same documents; options go to fit(). Rows as scored() gives them, in every case named there."""
    return scored(docs, fit(docs, labels, **options))
