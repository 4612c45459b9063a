"""Shared helpers: intermediate tables, distributed ranks and word scanning."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drift_engine import storage
from drift_engine.session import ship_package

#: A side is broadcast only when its counted rows stay under this.
BROADCAST_ROWS = 200_000

#: Rows whose values one window adds up.
RUN_ROWS = 100_000

#: Rows of texts and bytes that go to a Python worker at once.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """storage.materialise, after small_batches()."""
    small_batches(df.sparkSession)
    return storage.materialise(df, name)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches fit for whole texts, where the session has Spark's own defaults."""
    ship_package(spark)
    for key, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows prove that it is small; else df, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def keyed(docs: DataFrame) -> DataFrame:
    """(_doc: the row as a struct, _file, _at): each row's key is its file and place there, the same on every scan.

    Where docs does not come straight from files it is stored first.
    """

    def select(df: DataFrame, doc) -> DataFrame:
        return df.select(doc.alias("_doc"), F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))

    if "_metadata" not in docs.columns:
        with contextlib.suppress(AnalysisException):
            found = select(docs, F.struct("*"))
            found.schema  # noqa: B018  resolves the plan
            return found
    return select(materialise(docs.select(F.struct("*").alias("_doc")), "keyed"), F.col("_doc"))


def global_rank(df: DataFrame, order: list, rank: str = "rank", name: str = "ranked") -> DataFrame:
    """df with its 0-based position in the total order, without a single-task window.

    One range shuffle sorts; each row keeps its partition and place there; the
    driver sees one count per partition, never a row.
    """
    mid = F.monotonically_increasing_id()
    table = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", mid), name)
    part = F.shiftright("_mid", 33)
    counts = sorted((r["_part"], r["count"]) for r in table.groupBy(part.alias("_part")).count().collect())
    bases, start = [], 0
    for p, n in counts:
        bases.append((p, start))
        start += n
    base = df.sparkSession.createDataFrame(bases, "_part long, _base long")
    return (
        table.withColumn("_part", part)
        .join(F.broadcast(base), "_part")
        .withColumn(rank, F.col("_base") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_base", "_mid")
    )


def running_total(df: DataFrame, key: str, value: str, total: str = "before", name: str = "running") -> DataFrame:
    """df (one row a key) with `place`, its 0-based position by key, and `total`, the sum of `value` over all rows before it.

    One range shuffle sorts; sums run inside each part, and the driver adds up one sum a part.
    """
    ranked = materialise(global_rank(df, [F.col(key)], "place", name).withColumn("_chunk", F.floor(F.col("place") / RUN_ROWS)), name)
    within = Window.partitionBy("_chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    bases, start = [], 0
    for r in ranked.groupBy("_chunk").agg(F.sum(value).alias("s")).orderBy("_chunk").collect():
        bases.append((r["_chunk"], start))
        start += r["s"] or 0
    base = df.sparkSession.createDataFrame(bases, "_chunk long, _base long")
    out = ranked.withColumn(total, F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(base), "_chunk")
    return out.withColumn(total, F.col(total) + F.col("_base")).drop("_chunk", "_base")


def source_key(column="source"):
    """A string that orders as the source by code point, null last."""
    c = F.col(column).cast("string")
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def utf8_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and the n + 1 offsets of each; nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def segment_sum(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags (one per byte) in each [offsets[i], offsets[i + 1])."""
    running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def word_counts(texts: pa.Array) -> np.ndarray:
    """Number of runs of [^\\x20\\x09-\\x0D] in each text; null counts 0."""
    raw, offsets = utf8_buffers(texts)
    solid = ~_IS_SPACE[raw]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[begin] = solid[begin]
    return segment_sum(starts, offsets)


def with_word_count(df: DataFrame, text: str = "text", name: str = "size") -> DataFrame:
    """df with the word count of its text column, counted in Arrow batches."""

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(word_counts(texts), pa.int64())

    return df.withColumn(name, count(F.col(text).cast("string")))
