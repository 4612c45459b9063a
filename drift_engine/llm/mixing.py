"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drift_engine.llm.common import global_rank, keyed, materialise, small, source_key, with_word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
BUCKETS = 1024
SEED = 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_level(sources: DataFrame, budget: float) -> float:
    """The level L for which the sum of min(cap, L * weight) is the budget.

    Each round clamps the sources above their caps and shares the excess among the
    others by weight, until no source is above. A round is one aggregate, so the
    number of sources is not limited by the driver.
    """
    level = -1.0
    while True:
        clamped = F.col("cap") <= level * F.col("weight")
        r = sources.agg(
            F.sum(F.when(clamped, F.col("cap")).otherwise(F.lit(0))).alias("full"),
            F.sum(F.when(clamped, F.lit(0)).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if not r["free"]:
            return max(level, 0.0)
        new = (budget - float(r["full"])) / float(r["free"])
        if new <= level:
            return level
        level = new


def source_targets(sized: DataFrame, key: str, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, cap, weight, target. Weights repeat over the sources by code point."""
    table = global_rank(sized.groupBy(key).agg(F.sum("size").alias("source_size")), [F.col(key)], "_turn", "mix-order")
    turn = F.col("_turn") % len(weights)
    table = table.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[turn.cast("int")])
    table = materialise(table.drop("_turn").withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(table, share * float(total))
    return table.withColumn("target", F.least("cap", F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with _row, size, source_size, target, whole and part: how much of each document the mix takes.

    A source whose target is r times its size takes floor(r) whole passes, and of
    the last pass the documents that come first by a seeded hash of doc_id; the
    document in which the target falls is taken in part (its first words). So the
    words taken from a source are its target, to the word below.

    Null text: size 0, takes nothing. Null source: a source of its own, last. Rows
    repeated with the same doc_id count each for itself. An empty table gives an
    empty result. Other columns are not read and don't stay: the result has doc_id, _key,
    _row and the columns named first.
    """
    docs = docs.withColumn("_key", source_key())
    sized = materialise(with_word_count(docs.select("doc_id", "_key", "text")).drop("text").withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    return taken(sized, weights, share, max_epochs, seed)


def _passes(sized: DataFrame, weights, share: float, max_epochs: int) -> DataFrame:
    """Per source: source_size, target, whole passes, and `rest`, the words of the last, partial pass."""
    sources = source_targets(sized, "_key", weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    return sources.drop("weight", "cap")


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """rows with their seeded place in the order of the partial pass, and the bucket of that place."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # the first 60 bits of a digest that other engines have too; the first ten of them are the bucket
    place = F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")
    return rows.withColumn("_place", place).withColumn("_bucket", F.shiftright("_place", 50))


def _before(rows: DataFrame) -> DataFrame:
    """(_key, _bucket, _sum, _before): words of each bucket, and of those before it. A hot source spreads over BUCKETS groups; only their sums meet."""
    sums = rows.groupBy("_key", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))


def _parts(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """rows with `part`, the words that the partial pass takes. sums: _before, rest and more of each bucket."""
    within = Window.partitionBy("_key", "_bucket").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("size").over(within)).join(sums, ["_key", "_bucket"])
    left = F.col("rest") - (F.col("_before") + F.col("_upto") - F.col("size"))
    return rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")).drop("_place", "_bucket", "_upto", "_before", "rest")


def taken(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """As mix(), of a stored table with doc_id, _key and size."""
    rows = _placed(sized, seed)
    sums = _before(rows).join(_passes(sized, weights, share, max_epochs), "_key").drop("_sum")
    return _parts(rows, sums)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' own columns, a row for each pass that takes the document.

    A part pass keeps the document's first `part` words, with the white space between
    them; at most one document of each source is cut. Texts are not shuffled: whether a
    document is in the partial pass follows from its bucket and its source's row, but
    for the one bucket of each source in which the target falls; that one's documents
    are joined by their key.

    Null and empty texts, and texts without a word, are never taken. Null source: a
    source of its own. Repeated rows count each for itself. An empty table gives none.
    Extra columns stay, whatever their names.
    """

    @F.pandas_udf(T.StringType())
    def first_words(texts: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else t[: [m.end() for m in itertools.islice(WORD.finditer(t), int(n))][-1]] for t, n in zip(texts, words)], dtype=object)

    places = keyed(docs)
    rows = places.withColumn("doc_id", F.col("_doc.doc_id")).withColumn("_key", source_key("_doc.source"))
    stored = materialise(_placed(with_word_count(rows, "_doc.text"), seed).select("_file", "_at", "doc_id", "_key", "size", "_place", "_bucket"), "mix-sizes")
    sums = materialise(_before(stored).join(_passes(stored, weights, share, max_epochs), "_key"), "mix-buckets")
    # the first bucket that the partial pass does not take whole
    sources = sums.groupBy("_key", "whole").agg(F.min(F.when(F.col("_before") + F.col("_sum") > F.col("rest"), F.col("_bucket"))).alias("_cut"))
    edge = sources.filter("_cut is not null").select("_key", F.col("_cut").alias("_bucket"))
    at_edge = stored.join(small(edge, edge.count()), ["_key", "_bucket"])
    parts = materialise(_parts(at_edge, sums.drop("_sum", "source_size", "target", "whole")).filter("part > 0").select("_file", "_at", "size", "part"), "mix-edge")
    full, cut = parts.filter("part = size").select("_file", "_at", F.lit(1).alias("_full")), parts.filter("part < size")
    rows = _placed(rows, seed).join(small(sources, sources.count()), "_key").join(small(full, full.count()), ["_file", "_at"], "left")
    once_more = F.when(F.col("_bucket") < F.coalesce("_cut", F.lit(BUCKETS)), 1).otherwise(F.coalesce("_full", F.lit(0)))
    copies = (F.col("whole") + once_more).cast("int")
    # a text without a word is never taken
    rows = rows.filter(F.col("_doc.text").cast("string").rlike(r"[^\x20\x09-\x0D]")).withColumn("_copy", F.explode(F.array_repeat(F.lit(True), copies))).select("_doc.*")
    short = places.join(small(cut, cut.count()), ["_file", "_at"])
    text = first_words(F.col("_doc.text").cast("string"), F.col("part"))
    out = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.unionByName(short.select(*[out.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns]))
