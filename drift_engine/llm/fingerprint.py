"""Document fingerprints: a homomorphic multiset hash over paragraphs, in SQL expressions only.

A fingerprint is a vector of longs that is the sum over a text's paragraphs:
  EQUAL lanes   hashes of each paragraph, added modulo 2 ** 32,
  the number of phrases, and
  LIKE longs    of two counters modulo 2 ** 32 each: for each of 2 * LIKE buckets, how
                many phrases of the paragraph are hashed into it.
So it does not depend on the order of paragraphs, and a paragraph is inserted or
deleted by adding or subtracting its own vector; an edited text's fingerprint is its
unchanged paragraphs' plus the changed ones'. Phrases are pieces of a paragraph cut at
places that their own letters decide, so an edit changes few of them; the counters,
less their mean, estimate the cosine between phrase multisets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drift_engine.llm.common import global_rank, materialise, small

EQUAL = 8
LIKE = 32
LOW = (1 << 32) - 1
#: Documents in one block of neighbouring ids, and most blocks (their first keys are broadcast, so larger tables have larger blocks).
BLOCK_ROWS = 512
MOST_BLOCKS = 100_000
#: An output task gets so many documents at least, so that small tables don't end in hundreds of files.
TASK_ROWS = 8192
#: A phrase ends at a line's end, or at white space after a mark or one of these letters, which about half of all words end with.
PHRASE_END = r"(?=[ \t\x0B\f\r])(?<=[^a-zA-Z0-9 \t\x0B\f\r\n]|[bcghiklmprsuvwxyzBCGHIKLMPRSUVWXYZ02468])[ \t\x0B\f\r]+|\n"
#: The first of the 2 * LIKE characters that stand for buckets.
FIRST_MARK = 48


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`, the fingerprint (array of longs) of its column `text`. Null text is empty: all zeros."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    mark = lambda p: F.when(p == "", "").otherwise(F.char(F.pmod(F.xxhash64(p), F.lit(2 * LIKE)) + FIRST_MARK))
    # One character for each phrase, its bucket's: then a bucket's phrases are counted by taking its character out.
    df = df.withColumn("_lines", F.filter(F.split(whole, "\n"), lambda p: p != "")).withColumn("_marks", F.array_join(F.transform(F.split(whole, PHRASE_END), mark), ""))
    zero, low = F.lit(0).cast("long"), F.lit(LOW)
    none = F.struct(zero.alias("lo"), zero.alias("hi"))

    def add(a: Column, h: Column) -> Column:
        return F.struct((a["lo"] + h.bitwiseAND(low)).bitwiseAND(low).alias("lo"), (a["hi"] + F.shiftrightunsigned(h, 32)).bitwiseAND(low).alias("hi"))

    # A hash of each line per seed, its halves added up modulo 2 ** 32.
    sums = F.transform(F.sequence(F.lit(1), F.lit(EQUAL // 2)), lambda k: F.aggregate(F.transform("_lines", lambda p: F.xxhash64(k, p)), none, add, lambda s: F.array(s["lo"], s["hi"])))
    phrases = F.octet_length("_marks").cast("long")
    found = lambda j: phrases - F.octet_length(F.replace(F.col("_marks"), F.char(j.cast("long") + FIRST_MARK), F.lit("")))
    # Two counters in a long: a text has under 2 ** 31 phrases, so neither runs over.
    counters = F.transform(F.sequence(F.lit(0), F.lit(LIKE - 1)), lambda j: found(j) + found(j + LIKE) * F.lit(1 << 32))
    return df.withColumn(name, F.concat(F.flatten(sums), F.array(phrases), counters)).drop("_lines", "_marks")


def merged(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a text with b's paragraphs inserted (sign 1) or deleted (sign -1)."""
    joined = F.zip_with(a, b, lambda x, y: x + sign * y)
    return F.transform(joined, lambda x, i: F.when(i < EQUAL, x.bitwiseAND(F.lit(LOW))).otherwise(x))


def as_text(fingerprint: Column) -> Column:
    """16 lowercase hexadecimal digits for each long."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the estimated cosine between phrase multisets, 0 at least."""

    def product(v, w):
        """Inner product of two fingerprints' counters, each less its mean."""
        low = lambda x: x.bitwiseAND(F.lit(LOW)).cast("double")
        high = lambda x: F.shiftrightunsigned(x, 32).cast("double")
        terms = F.zip_with(F.slice(v, EQUAL + 2, LIKE), F.slice(w, EQUAL + 2, LIKE), lambda x, y: low(x) * low(y) + high(x) * high(y))
        return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) - v[EQUAL].cast("double") * w[EQUAL] / (2 * LIKE)

    zero = F.lit(0.0)
    cosine = F.try_divide(product(a, b), F.sqrt(product(a, a) * product(b, b)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(zero, F.coalesce(F.nanvl(cosine, zero), zero))))


def _in_cells(df: DataFrame, levels: list[DataFrame]) -> tuple[DataFrame, list[str]]:
    """df (_null, _k, _h) with a column for each level of cells, and the names of the columns that make a cell."""
    path = ["_null"]
    for i, heavy in enumerate(levels):
        value = F.when(F.col("_by_k"), F.col("_k")).otherwise(F.col("_h"))
        above = F.when(F.col("_close"), F.try_subtract(value, F.col("_lo")).cast("double")).otherwise(value.cast("double") - F.col("_lo").cast("double"))
        df = df.join(F.broadcast(heavy), path, "left").withColumn(f"_c{i}", F.coalesce(F.floor(above / F.col("_width")), F.lit(0)).cast("long"))
        df = df.drop("_by_k", "_lo", "_width", "_close")
        path = [*path, f"_c{i}"]
    return df, path


def _cells(keys: DataFrame, size: int) -> list[DataFrame]:
    """Levels of cells of equal width that part the stored keys into blocks of 2 * size rows at most.

    Each round cuts the cells that are still too full by their own range of ids, or of
    text hashes where the id is one and the same; so far ids, null ids and often repeated
    ids cost a round more, not a larger block. Only rows alike in both stay together.
    """
    levels: list[DataFrame] = []
    while True:
        cells, path = _in_cells(keys, levels)
        cells = cells.groupBy(path).agg(F.count("*").alias("n"), F.min("_k").alias("k0"), F.max("_k").alias("k1"), F.min("_h").alias("h0"), F.max("_h").alias("h1"))
        by_k = F.col("k0") < F.col("k1")
        low, high = F.when(by_k, F.col("k0")).otherwise(F.col("h0")), F.when(by_k, F.col("k1")).otherwise(F.col("h1"))
        heavy = cells.filter((F.col("n") > 2 * size) & (by_k | (F.col("h0") < F.col("h1")))).withColumns({"_by_k": by_k, "_lo": low, "_hi": high})
        reach = F.col("_hi").cast("double") - F.col("_lo").cast("double")
        close = F.col("_hi").cast("decimal(20,0)") - F.col("_lo").cast("decimal(20,0)") < 2**52
        heavy = heavy.withColumns({"_close": close, "_width": F.greatest(F.lit(1.0), (reach + 1) * size / F.col("n"))}).select(*path, "_by_k", "_lo", "_width", "_close")
        heavy = materialise(heavy, "fp-cells")
        if heavy.isEmpty():
            return levels
        levels.append(heavy)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (with doc_id) with next_<c> of each of the columns, from the document of the next id; the last's next is the first.

    Keys alone are first parted into blocks of about BLOCK_ROWS neighbours, whatever the
    ids' gaps; a window runs inside a block, and each block also gets a copy of the row
    that opens the next one. One shuffle of the rows, and no task gets more than a block
    at a time. Null ids come first. Rows of the same id follow each other by the hash of
    their first column.
    """
    hashed = F.xxhash64(F.col(columns[0]))
    keys = docs.select(F.col("doc_id").isNull().alias("_null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_k"), hashed.alias("_h"))
    stored = materialise(keys, "fp-keys")
    levels = _cells(stored, max(BLOCK_ROWS, -(-stored.count() // MOST_BLOCKS)))
    cells, path = _in_cells(stored, levels)
    blocks = cells.groupBy(path).agg(F.min(F.struct("_k", "_h")).alias("_first"))
    blocks = materialise(global_rank(blocks, [F.desc("_null"), F.col("_first")], "_block", "fp-blocks"), "fp-opening")
    n = blocks.count()
    docs = docs.withColumns({"_null": F.col("doc_id").isNull(), "_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_h": hashed})
    docs = _in_cells(docs, levels)[0].join(small(blocks, n), path).drop(*path)
    own = F.struct(F.col("_block"), F.lit(False).alias("_copy"))
    copy = F.struct(F.pmod(F.col("_block") - 1, F.lit(max(n, 1))).alias("_block"), F.lit(True).alias("_copy"))
    opens = F.struct("_k", "_h") == F.col("_first")
    docs = docs.withColumn("_at", F.explode(F.when(opens, F.array(own, copy)).otherwise(F.array(own)))).drop("_first", "_block").select("*", "_at.*").drop("_at")
    ahead = Window.partitionBy("_block").orderBy("_copy", "_k", "_h", columns[0])
    nexts = [F.lead(c).over(ahead).alias(f"next_{c}") for c in columns]
    return docs.select("*", *nexts).filter(~F.col("_copy")).drop("_block", "_copy", "_k", "_h")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last floor(n_chars / 4) code points are replaced by
    as many first ones of the next document by id (all of it if it is shorter). The
    paragraphs before the one in which the cut falls are hashed once, and the edited
    fingerprint is their vector plus that of the new rest. Null text: empty. Repeated
    rows each give a row. An empty table gives none. Other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 4).cast("int"))
    head = lambda: F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("_cut")).cast("int"))
    # The part of the cut's own paragraph that stays, and what stands before that paragraph.
    rows = rows.withColumn("_open", F.substring_index(head(), "\n", -1))
    before = (F.col("n_chars") - F.col("_cut") - F.length("_open")).cast("int")
    rows = rows.withColumn("_whole", F.substring(F.col("text"), F.lit(1), before)).withColumn("_rest", F.substring(F.col("text"), before + 1, F.col("n_chars").cast("int")))
    rows = with_fingerprint(with_fingerprint(rows, "_whole", "_fp"), "_rest", "fp").withColumn("fp", merged(F.col("_fp"), F.col("fp"))).drop("_whole", "_rest")
    rows = with_next(rows, ["text", "fp"])
    added = F.substring(F.col("next_text"), F.lit(1), F.col("_cut"))
    rows = rows.withColumn("edited", F.concat(head(), added)).withColumn("_rest", F.concat("_open", added)).drop("text", "next_text")
    rows = with_fingerprint(rows, "_rest", "fp2").withColumn("fp2", merged(F.col("_fp"), F.col("fp2")))
    out = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("fp2")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fp2")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
    # With more partitions than this, coalesce() changes nothing.
    return out.coalesce(max(1, -(-docs.count() // TASK_ROWS)))
