"""Best-fit packing by length patterns fitted to the histogram with non-negative least squares."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_engine.llm import tokenise
from drift_engine.llm.common import global_rank, materialise, small_batches

CAPACITY = 1024
END_ID = 2
#: Waste that a pattern may leave, and three-document patterns tried for each shortest length.
MOST_WASTE = 2
TRIPLES = 24


def patterns(histogram: np.ndarray, waste: int = MOST_WASTE, triples: int = TRIPLES) -> np.ndarray:
    """Rows of three lengths (0: none) whose sums are the capacity less `waste` at most; only lengths that occur."""
    capacity = len(histogram) - 1
    there = np.flatnonzero(histogram)
    there = there[there < capacity]
    found = []
    for w in range(waste + 1):
        pair = capacity - w - there
        ok = (pair >= there) & (pair > 0) & (histogram[np.clip(pair, 0, capacity)] > 0)
        found.append(np.stack([there[ok], pair[ok], np.zeros(ok.sum(), np.int64)], 1))
    for a in there[there <= capacity // 3]:
        b = there[(there >= a) & (there <= (capacity - a) // 2)]
        c = capacity - a - b
        b = b[histogram[c] > 0]
        b = b[np.unique(np.linspace(0, len(b) - 1, min(triples, len(b))).astype(int))] if len(b) else b
        found.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit(shapes: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by accelerated projected gradient; A has a column for each pattern."""
    if not len(shapes):
        return np.zeros(0)
    goal = histogram.astype(float).copy()
    goal[0] = 0.0
    used = shapes > 0
    per_length = np.bincount(shapes[used], minlength=len(goal))
    # A's largest singular value is at most sqrt(largest column sum * largest row sum).
    step = 1.0 / (3.0 * max(1, per_length.max()) * 2.0)
    x = y = np.zeros(len(shapes))
    momentum = 1.0
    for _ in range(rounds):
        made = sum(np.bincount(shapes[:, k], y * used[:, k], minlength=len(goal)) for k in range(3))
        rest = goal - made
        rest[0] = 0.0
        after = np.maximum(0.0, y + step * rest[shapes].sum(1) * 2.0)
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = after + (momentum - 1) / faster * (after - x)
        x, momentum = after, faster
    return x


def plan(histogram: np.ndarray) -> tuple[pd.DataFrame, int]:
    """Where the documents of each length go: runs (length, count, sequence, offset), and the number of sequences.

    The first `count` documents of a length not placed yet go to consecutive sequences
    from `sequence`, each at `offset`. The plan's size depends on the capacity, not on
    the corpus.
    """
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    runs: list[tuple[int, int, int, int]] = []
    after = 0
    if left[capacity]:
        runs.append((capacity, int(left[capacity]), 0, 0))
        after, left[capacity] = int(left[capacity]), 0
    shapes = patterns(left)
    repeats = np.floor(fit(shapes, left) + 1e-6).astype(np.int64)
    for j in np.lexsort((-repeats, capacity - shapes.sum(1))):
        shape = shapes[j][shapes[j] > 0]
        lengths, times = np.unique(shape, return_counts=True)
        n = int(min(repeats[j], (left[lengths] // times).min()))
        if n <= 0:
            continue
        offset = 0
        for length in shape[::-1]:
            runs.append((int(length), n, after, offset))
            offset += int(length)
            left[length] -= n
        after += n
    # Residuals: best fit, longest first, on groups of sequences that are equally full.
    room: dict[int, list[tuple[int, int]]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            gap = min((g for g in room if g >= length), default=None)
            if gap is None:
                each = capacity // length
                opened, stack = max(1, n // each), min(each, n)
                runs += [(length, opened, after, k * length) for k in range(stack)]
                n -= opened * stack
                if capacity > stack * length:
                    room.setdefault(capacity - stack * length, []).append((after, opened))
                after += opened
                continue
            start, count = room[gap].pop()
            if not room[gap]:
                del room[gap]
            take = min(n, count)
            runs.append((length, take, start, capacity - gap))
            n -= take
            if take < count:
                room.setdefault(gap, []).append((start + take, count - take))
            if gap > length:
                room.setdefault(gap - length, []).append((start, take))
    return pd.DataFrame(runs, columns=["length", "count", "sequence", "offset"]), after


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The documents' ids, end_id last, cut into pieces of the capacity; the first piece takes what is over. Null text: end_id alone."""

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(tokenise.encode(text.as_py() or "", tokenizer), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                ends = [0, *range(first, len(ids) + 1, capacity)]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
            columns = zip(*out) if out else [[] for _ in _PIECES]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES_DDL)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    One pass makes the pieces; their lengths' histogram (capacity + 1 numbers) comes to
    the driver, where patterns are fitted and residuals packed; then each piece's rank
    among those of its length picks its run of the plan. Null and empty texts are the
    end id alone. Rows repeated with the same doc_id are packed each for itself. An
    empty table gives no rows. Other columns are not read.
    """
    tokenizer = tokenizer or tokenise.default_path()
    small_batches(docs.sparkSession)
    table = materialise(pieces(docs, tokenizer, capacity, end_id), "pack-pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in table.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    runs, _ = plan(histogram)
    runs = runs.sort_values("length", kind="stable")
    # Ranks run over all lengths in ascending order, so runs ordered by length start where their first piece stands.
    starts = np.concatenate([[0], runs["count"].cumsum().to_numpy()])[:-1].astype(np.int64)
    sequence, offset = runs["sequence"].to_numpy(np.int64), runs["offset"].to_numpy(np.int64)

    @F.pandas_udf("sequence_id long, offset long")
    def place(rank: pd.Series) -> pd.DataFrame:
        run = np.searchsorted(starts, rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[run] + rank.to_numpy(np.int64) - starts[run], "offset": offset[run]})

    ranked = global_rank(table, ["length", "doc_id", "piece", "ids_crc32"], name="pack-ranked")
    return ranked.withColumn("_place", place("rank")).select(*_PIECES.names, "_place.sequence_id", "_place.offset")
