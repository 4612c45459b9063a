"""Near-duplicate groups by HyperMinHash bands, collision-corrected estimates and exact verification."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_engine.llm.common import keyed, materialise, small, small_batches
from drift_engine.operators.graph import connected_components

SHINGLE = 5
#: Jaccard similarity of word shingles, in per cent, from which documents are linked.
PERCENT = 80
#: Registers of 6 bits for the leading zeros and 10 of the mantissa.
REGISTER_BITS = 8
REGISTERS = 1 << REGISTER_BITS
MANTISSA = 10
#: Bands have as many registers as leave at most this share of the pairs at the threshold without a common band.
MISSED = 1e-5
#: A pair with at least this many shingles each is dropped unverified if its estimate is this many deviations under the threshold.
ESTIMATED_FROM = 512
DEVIATIONS = 6.0
#: Rows of a bucket that are compared with as many others at a time; and rows that one task gets.
BLOCK = 256
TILE_ROWS = 16_384
#: Factor of the expected random collisions of two registers, published with HyperMinHash (fixed value).
COLLISION = 0.169919487159739093975315012348

_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64) for k in range(SHINGLE)], np.uint64)


class _Words(dict):
    """64-bit hashes of words, remembered within a worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of the whole sequence if it is shorter; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < width:
        return _mixed(np.array([xxhash.xxh64_intdigest(ids.tobytes(), seed=n)], np.uint64))
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += ids[k : k + len(total)] * _MULTIPLIERS[k]
    return np.unique(_mixed(total))


def _picks(rounds: int = 24) -> np.ndarray:
    """For each round and register, the register that an empty one borrows from."""
    cells = np.arange(rounds * REGISTERS, dtype=np.uint64).reshape(rounds, REGISTERS)
    return (_mixed(cells + np.uint64(1)) >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)


_PICKS = _picks()


def registers(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS uint16 values of a sorted, non-empty hash set.

    A hash's first bits choose the register; the least of the other bits is kept as its
    number of leading zeros and the bits that follow its first one. Registers without a
    hash borrow from one that has, each in an order of its own.
    """
    bucket = (hashes >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    least = (hashes[first] << np.uint64(REGISTER_BITS)) >> np.uint64(REGISTER_BITS)
    fraction, exponent = np.frexp(least.astype(np.float64))  # 0.5 <= fraction < 1
    zeros = np.minimum(64 - REGISTER_BITS - exponent, 62).astype(np.uint16)
    tail = np.where(least > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    out = np.full(REGISTERS, 0xFFFF, np.uint16)
    out[bucket[first]] = (zeros << np.uint16(MANTISSA)) | tail
    filled = np.zeros(REGISTERS, bool)
    filled[bucket[first]] = True
    if not filled.all():
        own = out.copy()
        empty = np.flatnonzero(~filled)
        for row in _PICKS:
            lender = row[empty]
            lent = filled[lender]
            out[empty[lent]] = own[lender[lent]]
            empty = empty[~lent]
            if not len(empty):
                break
        if len(empty):
            at = np.flatnonzero(filled)
            out[empty] = own[at[np.searchsorted(at, empty) % len(at)]]
    return out


def band_rows(percent: int) -> int:
    """Registers of a band: 7 (36 bands) at 85 per cent, 6 (42 bands) at 80."""
    missed = lambda rows: (1 - (percent / 100) ** rows) ** (REGISTERS // rows)
    return max((rows for rows in range(1, 17) if missed(rows) <= MISSED), default=1)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """(n, bands) 64-bit keys of (n, REGISTERS) registers, `rows` to a band; a key holds its band's number."""
    bands = REGISTERS // rows
    keys = np.empty((len(values), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(values), b + 1, np.uint64)
        for k in range(rows):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, b * rows + k])
        keys[:, b] = key
    return keys


def estimate(matches: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of equal registers, less the expected random collisions."""
    n, m = n.astype(float), m.astype(float)
    by_chance = COLLISION * 4 * n * m / (n + m) ** 2 * 2.0**-MANTISSA
    return np.clip((matches / REGISTERS - by_chance) / (1 - by_chance), 0, 1)


def may_link(matches: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair goes on to exact verification. Small sets always do, as their registers are few."""
    goal = percent / 100
    floor = goal - DEVIATIONS * np.sqrt(goal * (1 - goal) / REGISTERS)
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return fits & ((np.minimum(n, m) < ESTIMATED_FROM) | (estimate(matches, n, m) >= floor))


def _set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("registers", pa.binary()), ("_carry", pa.int64()), ("_carry2", pa.int64())])


def _sign(batches):
    for batch in batches:
        n, keys, regs = [], [], []
        for text in batch.column(1):
            hashes = shingle_set(text.as_py() or "")
            n.append(len(hashes))
            keys.append(_set_key(hashes) if len(hashes) else None)
            regs.append(registers(hashes).tobytes() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip((n, keys, regs), list(_SIGNED)[1:4])], batch.column(2), batch.column(3)], schema=_SIGNED)


def _sets(batches):
    schema = pa.schema([("set_key", pa.binary()), ("hashes", pa.binary())])
    for batch in batches:
        found = {}
        for text in batch.column(0):
            hashes = shingle_set(text.as_py() or "")
            if len(hashes):
                found[_set_key(hashes)] = hashes.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], schema=schema)


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(batches, rows: int):
    for batch in batches:
        keys = band_keys(_stack(batch.column(1)), rows)
        node = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(node)], names=["band", "node"])


def _whole_sets(keys: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(set_key, hashes) of the wanted keys, made anew from the texts of the documents that represent them."""
    wanted = keys.join(nodes, "set_key").select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text").mapInArrow(_sets, "set_key binary, hashes binary")
    return materialise(sets.join(keys, "set_key", "left_semi").dropDuplicates(["set_key"]), "near-sets")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of node ids whose whole shingle sets meet the threshold, by estimate first and then exactly."""

    @F.pandas_udf("boolean")
    def worth(ra: pd.Series, rb: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(r), np.uint16).reshape(-1, REGISTERS) for r in (ra, rb))
        return pd.Series(may_link((x == y).sum(1), n.to_numpy(), m.to_numpy(), percent))

    @F.pandas_udf("boolean")
    def linked(ha: pd.Series, hb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(ha, hb):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("registers").alias(f"r{s}"), F.col("set_key").alias(f"k{s}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    good = materialise(sized.filter(worth("ra", "rb", "na", "nb")).select("a", "b", "ka", "kb"), "near-pairs")
    sets = _whole_sets(good.select(F.col("ka").alias("set_key")).union(good.select("kb")).distinct(), nodes, docs)
    one, two = sets.select(F.col("set_key").alias("ka"), F.col("hashes").alias("ha")), sets.select(F.col("set_key").alias("kb"), F.col("hashes").alias("hb"))
    return materialise(good.join(one, "ka").join(two, "kb").filter(linked("ha", "hb")).select("a", "b"), "near-links")


def _tile_candidates(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of a tile whose registers allow a link to a row of another component."""
    comp, n, part, node = (pdf[c].to_numpy() for c in ("component", "n_shingles", "part", "node"))
    values = np.frombuffer(b"".join(pdf["registers"]), np.uint16).reshape(-1, REGISTERS)
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    found = np.zeros(len(pdf), bool)
    for x in left:
        others = right[(comp[right] != comp[x]) & ((node[right] > node[x]) if i == j else True)]
        if len(others):
            others = others[may_link((values[others] == values[x]).sum(1), n[others], np.full(len(others), n[x]), percent)]
            found[others] = True
            found[x] |= len(others) > 0
    return pdf.loc[found, ["band", "i", "j", "part", "node", "component", "set_key"]]


def _tile_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join components of a tile's rows, by whole sets; a pair already joined is not looked at."""
    comp, part, node = (pdf[c].to_numpy() for c in ("component", "part", "node"))
    sets = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
    size = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(number, starts[1:])
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    group = np.unique(comp, return_inverse=True)[1]
    left = np.flatnonzero(part == i)
    right = part == j
    flags = np.zeros(number.max() + 1, np.int64)
    found = []
    for x in left:
        others = right & (group != group[x])
        if not others.any():
            continue
        flags[own[x]] = 1
        shared = np.add.reduceat(flags[number], starts)
        flags[own[x]] = 0
        for y in np.flatnonzero(others & (100 * shared >= percent * (size + size[x] - shared))):
            if group[y] != group[x]:
                group[group == group[y]] = group[x]
                found.append((min(node[x], node[y]), max(node[x], node[y])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _rest(rows: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) that join components whose members share a bucket.

    Buckets with one component are done. In the others each pair of different components
    has a row outside the bucket's largest component (its main one): those rows, in
    blocks, meet each other and the main rows, so a bucket of one large group costs its
    rows times the blocks of strangers in it, not their square. A task has two blocks; it
    first drops the rows that registers rule out, then takes whole sets. Only links that
    join two components come out, so the result has fewer rows than the buckets,
    whatever the number of pairs.
    """
    labelled = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Rows of a hot bucket are counted by component first; the bucket's sums come from those counts.
    counts = labelled.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = F.max(F.struct("n", "component"))
    open_ = counts.groupBy("band").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), main.alias("m")).filter("kinds > 1 and n > 2")
    # A bucket of no more than BLOCK rows is one block, whose rows meet each other.
    few = F.col("n") <= BLOCK
    open_ = open_.select("band", F.when(~few, F.col("m.component")).alias("_main"), F.when(few, F.lit(0)).otherwise(F.ceil(F.col("m.n") / BLOCK)).cast("int").alias("_mains"), F.when(few, F.lit(1)).otherwise(F.ceil((F.col("n") - F.col("m.n")) / BLOCK)).cast("int").alias("_others"), F.col("n"), F.when(few, F.lit(0)).otherwise(F.col("m.n")).alias("_m"))
    open_ = materialise(open_, "near-open")
    total = open_.agg(F.sum(F.col("_m") * F.col("_others") + (F.col("n") - F.col("_m")) * (F.col("_others") + F.col("_mains")))).first()[0] or 0
    labelled = labelled.join(open_.drop("n", "_m"), "band").join(nodes.select("node", "n_shingles", "registers", "set_key"), "node")
    other = F.col("_main").isNull() | (F.col("component") != F.col("_main"))
    block = F.pmod(F.xxhash64("node"), F.when(other, F.col("_others")).otherwise(F.col("_mains"))).cast("int")
    # Blocks of strangers are numbered from 0, those of main rows downwards from -1.
    labelled = labelled.withColumn("part", F.when(other, block).otherwise(-1 - block))
    tile = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    strangers, mains = F.sequence(F.lit(0), F.col("_others") - 1), F.sequence(F.lit(-1), -F.greatest(F.col("_mains"), F.lit(1)), F.lit(-1))
    among = F.transform(strangers, lambda k: tile(F.least(k, F.col("part")), F.greatest(k, F.col("part"))))
    with_mains = F.when(F.col("_mains") > 0, F.transform(mains, lambda k: tile(F.col("part"), k))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    tiles = F.when(other, F.concat(among, with_mains)).otherwise(F.transform(strangers, lambda k: tile(k, F.col("part"))))
    tiled = labelled.withColumn("tile", F.explode(tiles)).select("band", "tile.i", "tile.j", "part", "node", "component", "n_shingles", "registers", "set_key")
    tile_key = ["band", "i", "j"]
    # Comparing takes long for its bytes, so tasks are cut by rows.
    tiled = tiled.repartition(max(1, -(-total // TILE_ROWS)), *tile_key)

    def allowed(pdf: pd.DataFrame) -> pd.DataFrame:
        return _tile_candidates(pdf, percent)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        return _tile_links(pdf, percent)

    candidates = tiled.groupBy(tile_key).applyInPandas(allowed, "band long, i int, j int, part int, node long, component long, set_key binary")
    candidates = materialise(candidates, "near-candidates")
    sets = _whole_sets(candidates.select("set_key").distinct(), nodes, docs)
    return candidates.join(sets, "set_key").drop("set_key").groupBy(tile_key).applyInPandas(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, carry: tuple[str, str] | None = None) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept, component (an inner number of the group).

    Texts with the same shingle set are one class, represented once. Representatives
    meet in band buckets; each is first paired with the bucket's smallest member, and
    estimates, then whole sets, decide. What those links leave apart within a bucket is
    then compared pair by pair, so no link between different texts is lost for having
    met in a large bucket, and within a component no further pairs are made.

    Null and empty texts: no shingles, each its own component. Repeated rows fall in one
    component. Null doc_id: its own doc_id is no component id; a component of only such
    rows has id null. An empty table gives no rows. Other columns are not read;
    carry: two long columns to carry along.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[(F.col(c) if carry else F.lit(0).cast("long")).alias(f"_carry{k}") for k, c in enumerate(carry or "ab")])
    signed = materialise(texts.mapInArrow(_sign, "doc_id long, n_shingles long, set_key binary, registers binary, _carry long, _carry2 long").withColumn("_row", F.monotonically_increasing_id()), "near-signed")
    classes = materialise(signed.filter("n_shingles > 0").groupBy("set_key").agg(F.min("_row").alias("node"), F.min("doc_id").alias("label")), "near-classes")
    chosen = signed.join(classes.select(F.col("node").alias("_row")), "_row", "left_semi")
    nodes = materialise(chosen.select(F.col("_row").alias("node"), "doc_id", "n_shingles", "set_key", "registers"), "near-nodes")
    rows = nodes.select("node", "registers").mapInArrow(partial(_bands, rows=band_rows(percent)), "band long, node long")
    buckets = rows.groupBy("band").agg(F.min("node").alias("center"), F.count("*").alias("n")).filter("n > 1").select("band", "center")
    rows = materialise(rows.join(buckets, "band"), "near-buckets")
    pairs = materialise(rows.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "near-stars")
    links = _verified(pairs, nodes, docs, percent)
    labels = connected_components(links, "near")
    more = materialise(_rest(rows.select("band", "node"), nodes, labels, docs, percent), "near-rest")
    if not more.isEmpty():
        labels = connected_components(links.union(more), "near-again")
    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("label").alias("component_id"), F.min("node").alias("_least"))
    named = named.join(ids, "component").select("set_key", "component_id", "component")
    rows = signed.drop("registers").join(named, "set_key", "left")
    rows = rows.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "component", *([F.col("_carry").alias(carry[0]), F.col("_carry2").alias(carry[1])] if carry else []))


def first_documents(docs: DataFrame, **options) -> DataFrame:
    """docs' own columns, one row of each component: that of the smallest doc_id, and of equal ids one of them. Rows without words all stay.

    The other rows' keys are taken out by an anti join; where their counted number is
    small they go to every task, and texts are not shuffled. Null doc_id: last of its
    component. Repeated rows: one stays. An empty table gives none. Extra columns stay,
    whatever their names.
    """
    places = keyed(docs)
    found = near_duplicates(places.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"), "_file", "_at"), carry=("_file", "_at"), **options)
    found = materialise(found.filter("n_shingles > 0").select("doc_id", "component", "_file", "_at"), "near-found")
    # Hot components meet as partial minima, one row a task.
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_file", "_at")).alias("x")).select("x._file", "x._at")
    others = materialise(found.select("_file", "_at").join(first, ["_file", "_at"], "left_anti"), "near-others")
    return places.join(small(others, others.count()), ["_file", "_at"], "left_anti").select("_doc.*")
