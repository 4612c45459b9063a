"""Exact duplicates by deterministic block naming: blocks, then pairs of names, get integer names until each document has one."""

from __future__ import annotations

import hashlib
from functools import partial
from math import ceil, log2

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drift_engine.llm.common import global_rank, keyed, materialise, small_batches, utf8_buffers

#: Bytes of a block.
BLOCK = 1024
#: Bytes of a block's sort key at first; doubled until no two blocks share one.
KEY_BYTES = 16

_SPACE = b" \t\n\x0b\x0c\r"
_ROWS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("_file", pa.int64()), ("_at", pa.int64()), ("text_sha256", pa.string()), ("keys", pa.list_(pa.binary()))])
_ROWS_DDL = "doc_id long, n_chars long, _file long, _at long, text_sha256 string, keys array<binary>"
_BLOCKS = pa.schema([("key", pa.binary()), ("block", pa.binary())])


def normalised(batch: pa.RecordBatch) -> list[bytes]:
    """UTF-8 of each text without white space; null is empty."""
    raw, offsets = utf8_buffers(batch.column("text"))
    data = raw.tobytes()
    return [data[a:b].translate(None, _SPACE) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def blocks_of(text: bytes, size: int = BLOCK) -> list[bytes]:
    """The text in blocks, the last one shorter; an empty text is one empty block."""
    return [text[k : k + size] for k in range(0, max(len(text), 1), size)]


def block_key(block: bytes, width: int) -> bytes:
    return b"".join(xxhash.xxh3_128_digest(block, seed=k) for k in range(-(-width // 16)))[:width]


def _described(batches, width: int, size: int):
    for batch in batches:
        texts = normalised(batch)
        keys = [[block_key(b, width) for b in blocks_of(t, size)] for t in texts]
        own = [batch.column(name) for name in ("doc_id", "n_chars", "_file", "_at")]
        yield pa.RecordBatch.from_arrays([*own, pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(keys, pa.list_(pa.binary()))], schema=_ROWS)


def _blocks(batches, width: int, size: int):
    for batch in batches:
        found = list({b for t in normalised(batch) for b in blocks_of(t, size)})
        yield pa.RecordBatch.from_arrays([pa.array([block_key(b, width) for b in found], pa.binary()), pa.array(found, pa.binary())], schema=_BLOCKS)


def named(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows of df, all distinct, in sorted order with their integer names from 1 on."""
    return global_rank(df, [F.col(c) for c in order], "name", name).withColumn("name", F.col("name") + 1)


def _block_names(texts: DataFrame, width: int, size: int) -> tuple[DataFrame, int]:
    """(key, name) of all distinct blocks, and the key's width.

    Blocks are sorted by (key, bytes). The bytes of a key meet once, to see that they are
    one block's: partial sets leave each map task once a block. Should two blocks share a
    key, all is done again with keys twice as wide; names never rest on a hash alone.
    """
    while True:
        held = texts.select("text").mapInArrow(partial(_blocks, width=width, size=size), "key binary, block binary").groupBy("key").agg(F.size(F.collect_set("block")).alias("blocks"))
        held = materialise(held, "blocks-keys")
        if (held.agg(F.max("blocks")).first()[0] or 1) == 1:
            return named(held.select("key"), ["key"], "blocks-named"), width
        width *= 2


def _parent(column: str) -> Column:
    return F.floor(F.col(column) / 2).cast("int")


def identities(docs: DataFrame, key_bytes: int = KEY_BYTES, size: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_chars, text_sha256, n_blocks, level, name, and its row key (_file, _at).

    Texts without white space are equal exactly if (level, name) are: level is the number
    of pairings that leave one name, and a name stands for one sequence of blocks.

    Each level is a grouping by row and place, a distributed sort of the distinct pairs
    and a join of names; rows halve with each level, and a document leaves when one name
    is left. Pairs met many times are made distinct before they move; the join back is one
    that AQE splits by rows. Null text: empty. Repeated rows each give a row.
    """
    return _identities(keyed(docs), key_bytes, size)


def _identities(held: DataFrame, key_bytes: int, size: int) -> DataFrame:
    small_batches(held.sparkSession)
    doc = F.col("_doc")
    text = F.coalesce(doc["text"].cast("string"), F.lit(""))
    texts = held.select(doc["doc_id"].cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), "_file", "_at", text.alias("text"))
    names, width = _block_names(texts, key_bytes, size)
    rows = materialise(texts.mapInArrow(partial(_described, width=width, size=size), _ROWS_DDL).withColumn("n_blocks", F.size("keys")).withColumn("row", F.monotonically_increasing_id()), "blocks-rows")
    most = rows.agg(F.max("n_blocks")).first()[0] or 1

    held = rows.select("row", F.col("n_blocks").alias("left"), F.posexplode("keys").alias("pos", "key")).join(names, "key").select("row", "pos", "left", "name")
    done = [held.filter("left = 1").select("row", F.lit(0).alias("level"), "name")]
    for level in range(1, ceil(log2(most)) + 1):
        halves = held.filter("left > 1").select("row", _parent("pos").alias("pos"), F.ceil(F.col("left") / 2).cast("int").alias("left"), (F.col("pos") % 2).alias("side"), "name")
        pairs = halves.groupBy("row", "pos", "left").agg(F.max(F.when(F.col("side") == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("side") == 1, F.col("name"))), F.lit(0)).alias("b"))
        pairs = materialise(pairs, f"blocks-pairs-{level}")
        held = pairs.join(named(pairs.select("a", "b").distinct(), ["a", "b"], f"blocks-named-{level}"), ["a", "b"]).select("row", "pos", "left", "name")
        done.append(held.filter("left = 1").select("row", F.lit(level).alias("level"), "name"))
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return materialise(rows.drop("keys").join(found, "row"), "blocks-identities")


def exact_duplicates(docs: DataFrame, key_bytes: int = KEY_BYTES, size: int = BLOCK) -> DataFrame:
    """identities() with keep_id, group_size and kept.

    Of equal texts the row with the most code points stays, then the smallest doc_id (null
    last); of rows alike in these too, one stays. A group's row is found by partial
    maxima, so a group of any size meets as one row a task. No documents give no rows.
    """
    return _with_first(identities(docs, key_bytes, size))


def _with_first(found: DataFrame) -> DataFrame:
    first = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("order"), F.bitwise_not("row").alias("place"), "doc_id", "row")).alias("first")
    groups = found.groupBy("level", "name").agg(F.count("*").alias("group_size"), first)
    groups = groups.select("level", "name", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("_first"))
    return found.join(groups, ["level", "name"]).withColumn("kept", F.col("row") == F.col("_first")).drop("_first", "row")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns."""
    held = keyed(docs)
    stay = _with_first(_identities(held, KEY_BYTES, BLOCK)).filter("kept").select("_file", "_at")
    return held.join(stay, ["_file", "_at"], "left_semi").select("_doc.*")
