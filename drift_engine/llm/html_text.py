"""Main text of web pages: page structure says which parts may be text, a host's suffix array which passages are boilerplate.

The pages of a host, in groups of bounded size, are one stream of words each; the suffix
array of a group finds its passages that distinct pages share, and the groups of a large
host tell each other of theirs by hashes of their 8-word windows, so what is found does
not depend on the grouping.
"""

from __future__ import annotations

import html
import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_engine.llm.common import materialise, small, small_batches

#: Words that a passage shared by pages needs, and pages that must share it.
LEAST_WORDS = 8
LEAST_PAGES = 2
#: A block of open standing goes when this share of its words is in shared passages.
COVERED = 0.5
#: Inside main elements a passage is boilerplate only when so many pages of the host have it there, and this share of them.
MAIN_PAGES = 5
MAIN_SHARE = 0.5
#: A page that would lose more than this share of its main text is a copy, and keeps all of it.
COPY = 0.5
#: So is a page without main elements that would lose more than this share of its open text: there the limits of main elements hold.
OPEN_COPY = 0.8
#: A block in an element of a suspect name goes with fewer words than this, or with this share of them shared.
SUSPECT_WORDS = 25
SUSPECT_COVERED = 0.2
#: Bytes of a host's html whose words go into one suffix array; and windows that one task merges.
GROUP_BYTES = 8 << 20
MERGED_WINDOWS = 1 << 20

RAW_TEXT = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "math", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "object", "canvas", "fieldset"}
MAIN = {"article", "main"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Words of class and id names that mark what is never text, though every page may have its own (fixed values).
FURNITURE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|header|masthead|banner|footer|sidebar|aside|ad|ads|advert|adverts|advertisement|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|newsletter|subscribe|breadcrumb|breadcrumbs|pagination|pager|comment|comments|disqus)(?:$|[\s_-])",
    re.I,
)
#: Words of names that make an element suspect; what its text shares with other pages decides (fixed values).
SUSPECT_NAMES = re.compile(r"(?:^|[\s_-])(?:promo|signup|popup|modal|share|sharing|social|related|recommended|widget|reply|replies|respond|login|search|toolbar|skip|copyright|legal)(?:$|[\s_-])", re.I)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post-content|entry-content|article-body|main-content|story-body|post-body)(?:$|[\s_-])", re.I)
#: A paragraph ends where one of these begins.
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}

#: A comment or declaration, a tag that ends before the next '<', or the '<' of any other tag. No part is read twice, whatever the page.
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|(<)(?=/?[a-zA-Z])", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


def standing(tag: str, attributes: str) -> str:
    """As _standing(), which is remembered for attributes of usual length."""
    return _usual(tag, attributes) if len(attributes) < 200 else _standing(tag, attributes)


def _standing(tag: str, attributes: str) -> str:
    """'-' if the element is furniture, '+' if it holds the main text, '?' if its name makes it suspect, '' if none of these."""
    if tag in FURNITURE:
        return "-"
    if tag in ("html", "body"):
        return ""
    names, role = "", ""
    if attributes.strip():
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                names += " " + value
            elif key == "role":
                role = value.lower()
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return "-"
    if role in FURNITURE_ROLES:
        return "-"
    if tag in MAIN or role == "main":
        return "+"
    if names:
        if FURNITURE_NAMES.search(names):
            return "-"
        if MAIN_NAMES.search(names):
            return "+"
        if SUSPECT_NAMES.search(names):
            return "?"
    return ""


_usual = lru_cache(20_000)(_standing)


class Tags:
    """Ends of tags that hold a '<', or quotes that don't pair: a quote opens a value after '=' only, and one that never closes opens none.

    What has been looked for is remembered, so a page of any make takes time in proportion
    to its length.
    """

    def __init__(self, page: str):
        self.page = page
        self.stop: tuple[int, re.Match | None] = (len(page) + 1, None)
        self.dead: set[int] = set()
        self.last = {q: page.rfind(q) for q in ">\"'"}

    def _next(self, at: int) -> re.Match | None:
        asked, found = self.stop
        if at < asked or found and found.start() < at:
            self.stop = at, _STOP.search(self.page, at)
        return self.stop[1]

    def end(self, at: int) -> int:
        """Where the tag whose name ends before `at` has its '>'; -1 if the page has none any more."""
        if self.last[">"] < at:
            return -1
        seen, place = [], at
        while (m := self._next(place)) and m.start() not in self.dead:
            if not m[1]:
                return m.start()
            seen.append(m.start())
            if self.last[m[1]] < m.end():
                break
            place = self.page.find(m[1], m.end()) + 1
        self.dead.update(seen)
        return self.page.find(">", at)


def standing_inside(before: str, own: str) -> str:
    """The standing within an element of its `own`, inside one of standing `before`. '!' is '?' inside the main text; furniture and suspects keep what is in them."""
    if before == "-" or own == "-":
        return "-"
    if before in ("?", "!"):
        return before
    if own == "?":
        return "!" if before == "+" else "?"
    return own or before


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(standing, text) of the page's blocks in order. Inline tags do not end a block, all others do; script, style and the like are left out."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # (tag, standing inside)
    held: Counter[str] = Counter()  # of the stack's tags
    tags: Tags | None = None
    parts: list[str] = []
    now = ""

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((now, text))

    at, n = 0, len(page)
    while at < n:
        m = _PIECE.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        closing, tag, attributes, other = m.groups()
        if other:
            tags = tags or Tags(page)
            m = _NAME.match(page, m.start())
            end = tags.end(m.end())
            if end < 0:  # no tag ends from here on
                parts.append(page[m.start() :])
                break
            at, closing, tag, attributes = end + 1, m[1], m[2], page[m.end() : end]
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW_TEXT:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in INLINE and (closing or not standing(tag, attributes) == "-") and not (closing and stack and stack[-1][0] == tag):
            continue
        flush()
        if closing:
            while held[tag]:
                gone = stack.pop()[0]
                held[gone] -= 1
                if gone == tag:
                    break
        elif tag not in VOID and not attributes.endswith("/"):
            if stack and (tag in CLOSES_P and stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li"):
                held[stack.pop()[0]] -= 1
            stack.append((tag, standing_inside(stack[-1][1] if stack else "", standing(tag, attributes))))
            held[tag] += 1
        now = stack[-1][1] if stack else ""
    flush()
    return out


def packed(blocks: list[tuple[str, str]]) -> bytes:
    """Blocks as compressed lines; a block's text has no line end."""
    return zlib.compress("\n".join((kind or " ") + text for kind, text in blocks).encode("utf-8", "surrogatepass"), 3)


def unpacked(data: bytes) -> list[tuple[str, str]]:
    lines = zlib.decompress(data).decode("utf-8", "surrogatepass")
    return [(line[0].strip(), line[1:]) for line in lines.split("\n")] if lines else []


def suffix_array(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the stream's suffixes in the order of their first `depth` words or more, by doubling; and each place's rank, equal for suffixes alike in all words compared."""
    n = len(stream)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while n and width < depth:
        step = min(width, depth - width)
        after = np.full(n, 0, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        width += step
    return order, rank


def window_pages(stream: np.ndarray, page: np.ndarray, least: int = LEAST_WORDS, counted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each place the number of distinct pages with the `least` words that begin there, and whether such a window begins at all.

    Suffixes with the same first words are neighbours in the suffix array; the pages of
    such a run are counted, those only that `counted` names. page: the page of each word,
    as its place in `counted`; words of value < 0 end a passage.
    """
    n = len(stream)
    counts, whole = np.zeros(n, np.int64), np.zeros(n, bool)
    if n < least:
        return counts, whole
    order, rank = suffix_array(stream, least)
    ends = np.concatenate([[0], np.cumsum(stream < 0)])
    whole[: n - least + 1] = ends[least:] == ends[: n - least + 1]
    order = order[whole[order]]
    if not len(order):
        return counts, whole
    run = rank[order]
    first = np.concatenate([[True], run[1:] != run[:-1]])
    number = np.cumsum(first) - 1
    # A stable order keeps places ascending in a run, and pages with them.
    fresh = first | np.concatenate([[True], page[order[1:]] != page[order[:-1]]])
    if counted is not None:
        fresh = fresh & counted[page[order]]
    counts[order] = np.bincount(number, fresh).astype(np.int64)[number]
    return counts, whole


def cover(enough: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """Which words lie in one of the windows that begin where `enough` is set; longer passages are the union of their windows."""
    ends = np.zeros(len(enough) + least, np.int64)
    starts = np.flatnonzero(enough)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + least, -1)
    return np.cumsum(ends[: len(enough)]) > 0


def long_runs(flags: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """The flags of runs of `least` or more; a passage that only ends in a block leaves its first words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    out = np.zeros(len(flags), bool)
    for a, b in edges.reshape(-1, 2):
        out[a:b] = b - a >= least
    return out


_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 5, 1 << 64) for k in range(LEAST_WORDS)], np.uint64)


def window_keys(words: np.ndarray, seed: int) -> np.ndarray:
    """64-bit keys of the windows that begin at each place, of the words' 64-bit hashes; the last places have none."""
    total = np.full(max(0, len(words) - LEAST_WORDS + 1), seed, np.uint64)
    for k in range(LEAST_WORDS):
        total += words[k : k + len(total)] * _FACTORS[k]
    total = (total ^ (total >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


class Zone:
    """The words of a group's pages that stand in the main text, or of those that don't, as one stream in which a page's end ends every passage."""

    def __init__(self, host: str, parsed: list[list[tuple[str, str]]], main: bool):
        self.seed = xxhash.xxh64_intdigest(f"{'main' if main else 'rest'} {host}".encode("utf-8", "surrogatepass"))
        self.number = _Numbers()
        words, lengths = array("q"), []
        #: Where each block's words begin: one place for each of the zone's blocks, page by page.
        self.begins: list[int] = []
        for k, blocks in enumerate(parsed):
            texts = [text for kind, text in blocks if (kind == "+") == main]
            start = len(words)
            if texts:
                words.extend(map(self.number.__getitem__, " ".join(texts).split(" ")))
                for text in texts:
                    self.begins.append(start)
                    start += text.count(" ") + 1
            words.append(-1 - k)
            lengths.append(len(words))
        self.words = np.frombuffer(words, np.int64)
        self.owner = np.repeat(np.arange(len(parsed)), np.diff([0, *lengths]))

    def pages(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return window_pages(self.words, self.owner, counted=counted)

    def keys(self, at: np.ndarray) -> np.ndarray:
        """Keys of the windows that begin at the places `at`, the same in every group of the host."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.number), np.uint64, len(self.number))
        return window_keys(hashes[np.maximum(self.words, 0)] if len(hashes) else np.zeros(len(self.words), np.uint64), self.seed)[at]


def distinct_contents(contents: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
    """Which pages count: the first of each content, if no other group counts it."""
    first = np.zeros(len(contents), bool)
    first[np.unique(contents, return_index=True)[1]] = True
    return first & ~np.isin(contents, elsewhere)


def window_lists(host: str, parsed: list[list[tuple[str, str]]], counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct windows of both zones, and the distinct contents that this group counts for each."""
    keys, counts = [], []
    for main in (False, True):
        zone = Zone(host, parsed, main)
        pages, whole = zone.pages(counted)
        at = np.flatnonzero(whole)
        own, first = np.unique(zone.keys(at), return_index=True)
        keys.append(own)
        counts.append(pages[at][first])
    return np.concatenate(keys), np.concatenate(counts)


def host_texts(host: str, parsed: list[list[tuple[str, str]]], counted: np.ndarray, contents: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[str, int]]:
    """(main text, words dropped as shared) of each page. contents: distinct ones of the whole host; known: keys and contents of windows that other groups of the host have too."""
    flags, begins = {}, {}
    strict = max(MAIN_PAGES, MAIN_SHARE * contents)
    for main in (False, True):
        zone = Zone(host, parsed, main)
        counts, whole = zone.pages(counted)
        if known is not None and len(known[0]):
            at = np.flatnonzero(whole)
            keys = zone.keys(at)
            place = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
            counts[at] = np.where(known[0][place] == keys, known[1][place], counts[at])
        # Outside main elements two contents suffice; the strict limit is for pages that are copies.
        for least in (LEAST_PAGES, strict) if not main else (strict,):
            flags[main, least == strict] = cover(counts >= least)
        begins[main] = zone.begins
    # Words and shared words of each block, zone by zone.
    sizes, shared = {}, {}
    for main in (False, True):
        start = np.asarray(begins[main], np.int64)
        end = start + np.array([text.count(" ") + 1 for blocks in parsed for kind, text in blocks if (kind == "+") == main], np.int64)
        sizes[main] = zip(begins[main], end.tolist())
        for hard in (False, True):
            if (main, hard) in flags:
                upto = np.concatenate([[0], np.cumsum(flags[main, hard])])
                shared[main, hard] = iter((upto[end] - upto[start]).tolist())
    out = []
    for blocks in parsed:
        found, words, soft_lost, hard_lost = [], [0, 0], [0, 0], [0, 0]
        for kind, text in blocks:
            main = kind == "+"
            a, b = next(sizes[main])
            strictly = next(shared[main, True])
            usually = strictly if main else next(shared[False, False])
            found.append((kind, text, main, a, b, usually, strictly))
            if main or kind in ("", "?"):
                words[main] += b - a
                soft_lost[main] += usually
                hard_lost[main] += strictly
        has_main = any(kind == "+" for kind, _ in blocks)
        whole_main = has_main and hard_lost[True] > COPY * words[True]
        hard = not has_main and soft_lost[False] > OPEN_COPY * words[False]
        whole_open = hard and hard_lost[False] > OPEN_COPY * words[False]
        kept, lost = [], 0
        for kind, text, main, a, b, usually, strictly in found:
            n = 0 if whole_open and kind in ("", "?") else strictly if hard else usually
            suspect = kind in ("?", "!") and (b - a < SUSPECT_WORDS or n >= SUSPECT_COVERED * (b - a))
            if main and (not n or whole_main):
                kept.append(text)
            elif kind == "-" or suspect or (has_main and kind in ("", "?")) or n >= COVERED * (b - a):
                lost += n
            elif not n:
                kept.append(text)
            else:
                gone = long_runs(flags[main, main or hard][a:b])
                lost += int(gone.sum())
                kept.append(" ".join(w for w, c in zip(text.split(" "), gone) if not c))
        out.append((" ".join(t for t in kept if t), lost))
    return out


_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("_host", pa.string()), ("_group", pa.int32()), ("_pages", pa.int64()), ("_content", pa.int64()), ("blocks", pa.binary())])
_PARSED_DDL = "page_id long, url string, _host string, _group int, _pages long, _content long, blocks binary"
_TEXTS_DDL = "page_id long, url string, text string, n_chars long, shared_words long"


def _parse(batches):
    for batch in batches:
        blocks = [packed(blocks_of(p.as_py() or "")) for p in batch.column("html")]
        yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in list(_PARSED)[:-1]], pa.array(blocks, pa.binary())], schema=_PARSED)


def _group_rows(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """A group's pages, the windows that others told it of, and which of its pages count."""
    pages, told = group[group["_pages"].notna()], group[group["_pages"].isna()]
    lists = [np.asarray(c, np.int64) for c in told["_contents"] if c is not None] if "_contents" in told else []
    elsewhere = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    return pages, told[told["counts"].notna()], distinct_contents(pages["_content"].to_numpy(np.int64), elsewhere)


def _texts(rows: pd.DataFrame) -> pd.DataFrame:
    """Texts of a bin's pages, host by host and group by group. Rows without _pages hold what other groups told."""
    out = []
    for (host, _), group in rows.groupby(["_host", "_group"], sort=False):
        pages, shared, counted = _group_rows(group)
        known = None
        if len(shared):
            keys = np.frombuffer(b"".join(shared["blocks"]), np.uint64)
            totals = np.frombuffer(b"".join(shared["counts"]), np.int64)
            order = np.argsort(keys, kind="stable")
            known = keys[order], totals[order]
        if len(pages):
            found = host_texts(host, [unpacked(x) for x in pages["blocks"]], counted, int(pages["_pages"].iloc[0]), known)
            out.append(pd.DataFrame({"page_id": pages["page_id"].to_numpy(), "url": pages["url"].to_numpy(), "text": [t for t, _ in found], "n_chars": [len(t) for t, _ in found], "shared_words": [n for _, n in found]}))
    return pd.concat(out) if out else pd.DataFrame({"page_id": [], "url": [], "text": [], "n_chars": [], "shared_words": []})


def _shared_elsewhere(parsed: DataFrame, tasks: int) -> DataFrame:
    """(_bin, _host, _group, blocks: keys, counts: contents) of the windows that each group has in common with others of its host.

    A group sends its distinct windows, dealt by key; so a passage that all pages carry
    is one entry a group, not one a page.
    """

    def lists(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (bin_, host, group), own in rows.groupby(["_bin", "_host", "_group"], sort=False):
            pages, _, counted = _group_rows(own)
            if not len(pages):
                continue
            keys, counts = window_lists(host, [unpacked(x) for x in pages["blocks"]], counted)
            part = (keys % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for at in np.split(order, cuts):
                if len(at):
                    out.append((int(part[at[0]]), bin_, host, group, keys[at].tobytes(), counts[at].tobytes() if (counts[at] != 1).any() else b""))
        return pd.DataFrame(out, columns=["part", "_bin", "_host", "_group", "blocks", "counts"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(b, np.uint64) for b in rows["blocks"]]
        counts = [np.frombuffer(c, np.int64) if c else np.ones(len(k), np.int64) for c, k in zip(rows["counts"], keys)]
        whole = np.concatenate(keys)
        own, number, groups = np.unique(whole, return_inverse=True, return_counts=True)
        pages = np.bincount(number, np.concatenate(counts)).astype(np.int64)
        out, start = [], 0
        for k, row in zip(keys, rows.itertuples(index=False)):
            at = number[start : start + len(k)]
            start += len(k)
            at = at[groups[at] > 1]
            if len(at):
                out.append((row[1], row[2], row[3], own[at].tobytes(), pages[at].tobytes()))
        return pd.DataFrame(out, columns=["_bin", "_host", "_group", "blocks", "counts"])

    sent = parsed.groupBy("_bin").applyInPandas(lists, "part long, _bin long, _host string, _group int, blocks binary, counts binary")
    found = sent.groupBy("part").applyInPandas(merge, "_bin long, _host string, _group int, blocks binary, counts binary")
    return materialise(found, "html-shared")


def main_texts(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text, n_chars, shared_words (words dropped because other pages have them).

    Structure first: elements that by their tag, role or name are menus, headers, footers,
    sidebars, adverts, notices, forms or reader comments are no text; on a page with main
    elements (article, main) only what is inside them can be. Then the host's suffix
    arrays decide: outside main elements, passages of LEAST_WORDS words that two pages
    share go, blocks mostly of such go whole, and unique runs stay; suspect elements
    (promo, related and the like) go if they share or say little. Inside main elements
    a passage goes if MAIN_SHARE of the host's pages, and MAIN_PAGES at least, have it in
    theirs; but a page that would lose more than COPY of its main text is a copy of an
    article and keeps it, and so does a page without main elements that would lose more than
    OPEN_COPY: of it goes what the limits of main elements take, or nothing if that is as
    much again. Pages alike in their html are one content, counted once, however many rows
    or addresses it has; each row gets its text.

    Pages meet by host, a large host's in groups of some GROUP_BYTES of html by a hash of
    page_id and url, so no task gets a whole hot host. Groups tell each other which
    windows they share (_shared_elsewhere), so results are those of one array over the
    host. Null html: no text. Null url: one host of its own. Repeated rows each give a row.
    A tag that never ends is text, and a page of any make is read in time in proportion to
    its length. Empty tables give no rows. Extra columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = rows.withColumn("_host", host)
    rows = rows.withColumn("_content", F.xxhash64(F.coalesce("html", F.lit(""))))
    sizes = rows.groupBy("_host", "_content").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes")).groupBy("_host").agg(F.count("*").alias("_pages"), F.sum("bytes").alias("bytes"))
    sizes = materialise(sizes.withColumn("_groups", F.greatest(F.lit(1), F.ceil(F.col("bytes") / GROUP_BYTES))), "html-hosts")
    total = sizes.agg(F.sum("bytes").alias("all"), F.sum(F.when(F.col("_groups") > 1, F.col("bytes"))).alias("large"), F.count("*").alias("hosts")).first()
    rows = rows.join(small(sizes.drop("bytes"), total["hosts"]), "_host")
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("page_id", "url"), F.col("_groups")).cast("int"))
    # Small hosts share a call; each is still looked at by itself.
    bins = max(1, (total["all"] or 0) // GROUP_BYTES)
    placed = F.pmod(F.xxhash64("_host", "_group"), F.lit(bins))

    def parsed(part: DataFrame) -> DataFrame:
        return part.select("page_id", "url", "_host", "_group", "_pages", "_content", "html").mapInArrow(_parse, _PARSED_DDL).withColumn("_bin", placed)

    lacking = {"counts": F.lit(None).cast("binary"), "_contents": F.lit(None).cast("array<long>")}
    whole = parsed(rows.filter("_groups = 1")).withColumns(lacking)
    out = whole.groupBy("_bin").applyInPandas(_texts, _TEXTS_DDL)
    if total["large"]:
        # Of a content that several groups have, all but the first are told not to count it.
        large = rows.filter("_groups > 1").select("_host", "_content", "_group").distinct()
        owners = large.groupBy("_host", "_content").agg(F.min("_group").alias("_owner"), F.count("*").alias("_n")).filter("_n > 1")
        told = large.join(owners, ["_host", "_content"]).filter("_group <> _owner").groupBy("_host", "_group").agg(F.collect_list("_content").alias("_contents"))
        told = materialise(told.withColumn("_bin", placed), "html-contents")
        split = parsed(rows.filter("_groups > 1")).withColumns(lacking).unionByName(told, allowMissingColumns=True)
        # Some six bytes of html make a window.
        shared = _shared_elsewhere(split, max(1, total["large"] // (6 * MERGED_WINDOWS)))
        out = out.unionByName(split.unionByName(shared, allowMissingColumns=True).groupBy("_bin").applyInPandas(_texts, _TEXTS_DDL))
    return out
