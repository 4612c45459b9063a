"""Quality rules: lines that many documents of a host share are removed, and depleted documents rejected."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drift_engine.llm.common import BROADCAST_ROWS, keyed, materialise, small, small_batches, source_key

WINDOW = 8
LEAST_WORDS = 20
#: A line is boilerplate when more documents than this share it, or than this share of the host's documents.
LINE_DOCUMENTS = 10
LINE_SHARE = 0.002
#: A document is depleted when more than this share of its words stood in removed lines.
DEPLETED = 0.5

_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = bytes(c for c in range(256) if c not in b"#*$%&|<>")
_DIGITS = re.compile(r"[0-9]+")
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def normalised(line: str) -> str:
    """Lower case, runs of the digits 0 to 9 as one 0, white space (as between words) as one blank."""
    return _BLANKS.sub(" ", _DIGITS.sub("0", line.lower())).strip(" ")


def repeated_window_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that stand in a window of `width` words found twice or more; exact, as equal hashes are compared word by word."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key += mixed[k : k + n] * _MULTIPLIERS[k]
    order = np.argsort(key, kind="stable")
    alike = key[order[1:]] == key[order[:-1]]
    if not alike.any():
        return 0
    a, b = order[:-1][alike], order[1:][alike]
    same = np.ones(len(a), bool)
    for k in range(width):
        same &= ids[a + k] == ids[b + k]
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.concatenate([a[same], b[same]]))
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += bool(line.split())
        else:
            seen.add(line)
    return len(words), len(text) - spaces, len(raw.translate(None, _SYMBOLS)), dup, repeated_window_words(words)


def line_facts(text: str) -> list[tuple[int, int, int]]:
    """(line hash, words, place) of each line with a word."""
    lines = [(normalised(x), len(x.encode().split()), i) for i, x in enumerate(text.split("\n"))]
    return [(xxhash.xxh64_intdigest(x.encode()), n, i) for x, n, i in lines if n]


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


_FACTS = pa.schema([("doc_id", pa.int64()), ("_key", pa.string()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_text")], *[(c, pa.list_(pa.int64())) for c in ("_lines", "_line_words", "_at")]])
_FACTS_DDL = "doc_id long, _key string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, _text long, _lines array<long>, _line_words array<long>, _at array<long>"


def _facts(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(9)]
        for text in batch.column(2):
            text = text.as_py() or ""
            for c, v in zip(cols, base_rules(text)):
                c.append(v)
            facts = line_facts(text)
            cols[5].append(_signed([xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))])[0])
            cols[6].append(_signed([x[0] for x in facts]))
            cols[7].append(np.array([x[1] for x in facts], np.int64))
            cols[8].append(np.array([x[2] for x in facts], np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), *[pa.array(c, f.type) for c, f in zip(cols, list(_FACTS)[2:])]], schema=_FACTS)


def _line_table(docs: DataFrame) -> DataFrame:
    """The stored facts of each row: base counts, a hash of the whole text, and lines."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), source_key().alias("_key"), F.col("text").cast("string"))
    return materialise(rows.mapInArrow(_facts, _FACTS_DDL).withColumn("_row", F.monotonically_increasing_id()), "rules-facts")


def _lines(facts: DataFrame) -> DataFrame:
    lines = facts.select("_row", "_key", "_text", F.explode(F.arrays_zip("_lines", "_line_words")).alias("x"))
    return lines.select("_row", "_key", "_text", F.col("x._lines").alias("line"), F.col("x._line_words").alias("words"))


def frequent_lines(facts: DataFrame, least_documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE) -> DataFrame:
    """Stored (_key, line) of the lines above their host's limit, counted over all documents."""
    hosts = facts.groupBy("_key").agg(F.count("*").alias("_docs")).withColumn("_limit", F.greatest(F.lit(float(least_documents)), F.col("_docs") * F.lit(share))).drop("_docs")
    # Rows are dealt by line and text, so a line in a third of all rows reaches its count as partial sums.
    spread = _lines(facts).select("_key", "line", "_text").distinct().groupBy("_key", "line").agg(F.count("*").alias("_spread"))
    found = spread.filter(F.col("_spread") > least_documents).join(hosts, "_key").filter("_spread > _limit")
    return materialise(found.select("_key", "line"), "rules-lines")


def _failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, least_documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """A row per document: its base counts, base_failed, removed_words, removed_lines, kept.

    Lines are normalised and hashed; a line's documents are counted per host (here the
    source) over all documents. Documents with the same whole text count once, so exact
    copies do not turn their own text into boilerplate, and a line counts once for a
    document however often it stands there. Lines in more than max(least_documents, share of the
    host's documents) are removed; a document that loses more than `depleted` of its
    words is rejected, as is one that fails the base rules.

    Null text: no words, so base_failed. Null source: a host of its own. Repeated rows
    are judged alike, each with its row. Empty tables give no rows. Other columns are
    not read.
    """
    facts = _line_table(docs)
    frequent = frequent_lines(facts, least_documents, share)
    removed = _lines(facts).join(small(frequent, frequent.count()), ["_key", "line"], "left_semi").groupBy("_row").agg(F.sum("words").alias("removed_words"), F.count("*").alias("removed_lines"))
    out = facts.drop("_text", "_lines", "_line_words", "_at", "_key").join(removed, "_row", "left").fillna(0, ["removed_words", "removed_lines"])
    out = out.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & ~(F.col("removed_words") > depleted * F.col("n_words")))
    return out.drop("_row")


def kept_documents(docs: DataFrame, least_documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """docs' own columns of the kept documents, with the removed lines gone from text and n_chars set to what is left.

    Texts are read a second time rather than shuffled. The frequent lines go to every
    worker where their counted number allows it; else each document's lines of its host
    are joined to it by host and line.

    Rows as judge() keeps them, in every case named there: null and empty texts have too
    few words and go, repeated rows are judged alike and each stays or goes, an empty
    table gives none. Extra columns stay, whatever their names.
    """
    frequent = frequent_lines(_line_table(docs), least_documents, share)
    rows = docs.select(F.struct("*").alias("_doc"), source_key().alias("_key"))
    if (n := frequent.count()) <= BROADCAST_ROWS:
        by_host: dict[str, set[int]] = {}
        for r in frequent.collect():
            by_host.setdefault(r["_key"], set()).add(r["line"] & (2**64 - 1))
        known = docs.sparkSession.sparkContext.broadcast(by_host)
        rows = rows.withColumn("_frequent", F.lit(None).cast("array<long>"))
    else:
        known = None
        places = keyed(docs)
        facts = places.select(F.col("_file"), F.col("_at").alias("_place"), source_key("_doc.source").alias("_key"), _hashes(F.col("_doc.text").cast("string")).alias("_lines"))
        hits = facts.withColumn("line", F.explode("_lines")).join(frequent, ["_key", "line"], "left_semi").groupBy("_file", "_place").agg(F.collect_set("line").alias("_frequent"))
        rows = places.withColumnRenamed("_at", "_place").withColumn("_key", source_key("_doc.source")).join(hits, ["_file", "_place"], "left")

    @F.arrow_udf("kept boolean, removed array<long>")
    def verdict(texts: pa.Array, keys: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for text, key, given in zip(texts.to_pylist(), keys.to_pylist(), lines.to_pylist()):
            text = text or ""
            n_words, _, _, _, repeated = base_rules(text)
            ok, removed = not (n_words < LEAST_WORDS or 100 * repeated > 30 * n_words), []
            if ok:
                often = known.value.get(key, ()) if known is not None else {x & (2**64 - 1) for x in given or ()}
                gone = [(n, at) for h, n, at in line_facts(text) if h in often] if often else []
                ok, removed = sum(n for n, _ in gone) <= depleted * n_words, [at for _, at in gone]
            out.append({"kept": ok, "removed": removed})
        return pa.array(out, pa.struct([("kept", pa.bool_()), ("removed", pa.list_(pa.int64()))]))

    # Marked so that the filter does not run it a second time.
    once = verdict.asNondeterministic()(F.col("_doc.text").cast("string"), F.col("_key"), F.col("_frequent"))
    rows = rows.withColumn("_verdict", once).filter("_verdict.kept")
    changed = F.size("_verdict.removed") > 0
    lines = F.split("_doc.text", "\n")
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), F.col("_verdict.removed"))
    text = F.when(changed, F.array_join(F.transform(left, lambda i: lines[i.cast("int")]), "\n")).otherwise(F.col("_doc.text"))
    out = {"text": text} | ({"n_chars": F.when(changed, F.length(text)).otherwise(F.col("_doc.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[out.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def _hashes(text: Column) -> Column:
    @F.arrow_udf("array<long>")
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([_signed([f[0] for f in line_facts(t or "")]) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return hashes(text)
