"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drift_engine.llm.common import global_rank, materialise, running_total, small, source_key

SHARDS = 40
BITS = 6


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, d) with coordinates below 2 ** bits; bits * d < 64.

    Works from the highest bit down: at each bit plane the point's orthant gives one
    digit in Gray order, then the frame is reflected and axes exchanged.
    """
    x = coords.astype(np.int64).T.copy()
    d = len(x)
    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for axis in range(d):
            inside = (x[axis] >> plane) & 1 == 1
            flip = np.where(inside, low, 0)
            swap = np.where(inside, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= flip | swap
            x[axis] ^= swap
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> plane) & 1 == 1, (1 << plane) - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for axis in range(d):
            index = (index << 1) | ((x[axis] >> plane) & 1)
    return index


def quantised(df: DataFrame, numeric: list[str], bits: int) -> DataFrame:
    """df with q_<name> of each numeric column: its place among 2 ** bits approximate quantiles. Null: 0."""
    cells = 1 << bits
    cuts = [i / cells for i in range(1, cells)]
    for name in numeric:
        found = sorted({float(v) for v in df.select(F.percentile_approx(F.col(name).cast("double"), cuts, 10_000).alias("c")).first()["c"] or []})
        value = F.col(name).cast("double")
        below = [F.when(value >= c, 1).otherwise(0) for c in found]
        place = sum(below[1:], below[0]) if below else F.lit(0)
        df = df.withColumn(f"q_{name}", F.when(F.col(name).isNull(), 0).otherwise(place).cast("int"))
    return df


def ordered_category(df: DataFrame, key: str, name: str, bits: int) -> DataFrame:
    """df with q_<name>: the key's place by code point, spread by row count over 2 ** bits cells.

    Up to 2 ** bits keys each have cells of their own. Places are made by a distributed
    sort, and joined by broadcast or by shuffle as the counted number of keys allows.
    """
    cells = 1 << bits
    groups = running_total(df.groupBy(key).agg(F.count("*").alias("_n")), key, "_n", "_before", f"shard-{name}")
    r = groups.agg(F.count("*").alias("kinds"), F.sum("_n").alias("rows")).first()
    place = F.floor(F.col("_before") * F.lit(cells) / F.lit(max(r["rows"] or 0, 1))) if r["kinds"] > cells else F.col("place") * (cells // max(r["kinds"], 1))
    groups = groups.select(key, place.cast("int").alias(f"q_{name}"))
    return df.join(small(groups, r["kinds"]), key)


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, hilbert, rank, shard, slot.

    Dimensions: source and lang by code point, and text size. Rows of equal texts stand
    where the one of smallest doc_id (null last) does, and take its curve index. Documents
    are sorted by curve index, then by text (text_crc32 and two 64-bit hashes), doc_id and
    size, and cut into runs whose counts differ by one at most. So a group of equal texts is
    one run of places; it is parted only where a shard ends inside it, and one larger than a
    shard fills whole shards in a row. The text itself is never shuffled. Null text: no
    bytes, crc 0. Null source or lang: their own category, last. Repeated rows each get a
    place; no documents give no rows.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    meta = docs.select("doc_id", source_key("source").alias("_source"), source_key("lang").alias("_lang"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("_one"), F.xxhash64(F.lit(1), raw).alias("_two"))
    meta = materialise(meta, "shard-meta")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_source", "_lang"))
    copies = meta.groupBy("_one", "_two", "size").agg(first.alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    meta = meta.join(copies, ["_one", "_two", "size"], "left").withColumns({c: F.coalesce(f"_first.{c}", c) for c in ("_source", "_lang")}).drop("_first")
    meta = materialise(meta, "shard-first")
    meta = quantised(meta, ["size"], bits)
    meta = ordered_category(meta, "_source", "source", bits)
    meta = ordered_category(meta, "_lang", "lang", bits)

    @F.pandas_udf(T.LongType())
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a, b, c], axis=1), bits))

    meta = meta.withColumn("hilbert", curve("q_source", "q_lang", "q_size")).drop("_source", "_lang")
    ranked = global_rank(meta, ["hilbert", "text_crc32", "_one", "_two", "doc_id", "size"], name="shard-ranked").drop("_one", "_two")
    n = ranked.count()
    shard = F.expr(f"(rank * {shards}L) div {max(n, 1)}L")
    first = F.expr(f"({'{}'} * {max(n, 1)}L + {shards - 1}L) div {shards}L".format("_shard"))
    return ranked.withColumn("_shard", shard).withColumn("slot", F.col("rank") - first).withColumn("shard", F.col("_shard").cast("int")).drop("_shard")
