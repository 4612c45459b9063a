"""Token counts by section: a whole document is encoded once and its tokens are attributed by their character spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_engine.llm import tokenise
from drift_engine.llm.common import small_batches

_SECTIONS = pa.schema([("doc_id", pa.int64()), ("section", pa.string()), ("place", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("n_tokens", pa.int64()), ("crossing_tokens", pa.int64())])
_SECTIONS_DDL = "doc_id long, section string, place int, char_start long, char_end long, n_tokens long, crossing_tokens long"


def token_spans(text: str, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """First character, and the one after the last, of each token. Tokens that share a character's bytes both span that character."""
    lengths = tokenise.byte_lengths(tokenizer)[tokenise.encode(text, tokenizer)]
    ends = np.cumsum(lengths)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[ends - lengths], character[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [bounds[i], bounds[i + 1]), and how many of them reach into another one.

    An interval join by binary search. A token that crosses a boundary counts whole, for
    the section with most of its characters, the earliest of equals.
    """
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    owner = first.copy()
    crossing = np.flatnonzero(first != last)
    for t in crossing:
        inside = np.arange(first[t], last[t] + 1)
        shared = np.minimum(bounds[inside + 1], ends[t]) - np.maximum(bounds[inside], starts[t])
        owner[t] = inside[shared.argmax()]
    n = len(bounds) - 1
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def line_bounds(text: str) -> np.ndarray:
    """Sections that end after each line feed."""
    ends = [0]
    at = text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if ends[-1] < len(text) or len(ends) == 1:
        ends.append(len(text))
    return np.array(ends, np.int64)


def section_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per section of each document: doc_id, section, place, char_start, char_end, n_tokens, crossing_tokens.

    Sections are the lines of the text, each with its line feed, so they tile the text and
    their tokens add up to the document's. Null and empty texts: one empty section without
    tokens. Repeated rows each give their sections. An empty table gives no rows. Other
    columns are not read. Whole documents stay in one worker; nothing is shuffled.
    """
    tokenizer = tokenizer or tokenise.default_path()
    small_batches(docs.sparkSession)

    def count(batches):
        for batch in batches:
            out: list[list] = [[] for _ in _SECTIONS]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                bounds = line_bounds(text)
                n, crossing = attribute(*token_spans(text, tokenizer), bounds)
                k = len(n)
                for c, v in zip(out, ([doc_id] * k, ["line"] * k, range(k), bounds[:-1].tolist(), bounds[1:].tolist(), n.tolist(), crossing.tolist())):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SECTIONS)], schema=_SECTIONS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, _SECTIONS_DDL)


def field_counts(rows: DataFrame, key: str, fields: list[str], tokenizer: str | None = None, separator: str = "\n") -> DataFrame:
    """As section_counts, where a document is the row's fields joined by the separator, and each field with its separator a section.

    Null and empty fields are empty sections, whose separators still count. The result's
    doc_id is the key, its section the field's name. Repeated rows each give their
    sections. An empty table gives no rows. Other columns are not read.
    """
    tokenizer = tokenizer or tokenise.default_path()
    small_batches(rows.sparkSession)

    def count(batches):
        for batch in batches:
            out: list[list] = [[] for _ in _SECTIONS]
            for doc_id, *parts in zip(*[batch.column(i).to_pylist() for i in range(len(fields) + 1)]):
                parts = [(p or "") + (separator if i + 1 < len(fields) else "") for i, p in enumerate(parts)]
                bounds = np.cumsum([0, *map(len, parts)])
                n, crossing = attribute(*token_spans("".join(parts), tokenizer), bounds)
                for c, v in zip(out, ([doc_id] * len(fields), fields, range(len(fields)), bounds[:-1].tolist(), bounds[1:].tolist(), n.tolist(), crossing.tolist())):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SECTIONS)], schema=_SECTIONS)

    return rows.select(F.col(key).cast("long"), *[F.col(f).cast("string") for f in fields]).mapInArrow(count, _SECTIONS_DDL)
