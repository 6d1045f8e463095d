"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words (runs of the contract's class after A-Z became lower case), the patterns are the
windows of WINDOW consecutive words of each benchmark item; an item with fewer words, but not none, is one
window. Patterns of one length share a table. A block is two neighbouring words (one, for patterns of a
single word). The shift table tells, by a hash of the block that a position ends with, how far the next
pattern's end can be at least, so that most positions of a clean text are never looked at. Where the shift
is 0, the bucket of the patterns that end in that block, and begin as the text does there, is
compared word by word.

Numbers stand for the words of the patterns, and 0 for every other word, so equal numbers are equal words and
the comparison is exact. Many texts are searched at once: each piece of PIECE words has a position of its own,
and all positions take a step together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.rows import row_key
from twinsift.runtime import checkpoint, ready

WINDOW = 10
#: Characters of windows (with their items) that one broadcast table holds, about. Beyond that the
#: benchmark is split by window and item, and the documents are read once for each part.
TABLE_CHARS = 64 << 20
#: Words that are searched at a time, and in a piece.
CHUNK, PIECE = 1 << 20, 512
#: Slots of a shift table; blocks that meet in one only make shifts smaller.
SLOTS = 1 << 18
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 22

# Fixed by the contract: A-Z becomes lower case, 0-9, a-z and all beyond ASCII are word characters.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The text's words, some at a time; no word is cut."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            # to the end of the word that stands there
            while end < len(text) and _TABLE[text[end]] != 32:
                end += 1
        yield text[at:end].translate(_TABLE).split()
        at = end


def words_of(text: bytes | str | None) -> list[bytes]:
    if text is None:
        return []
    return [w for some in slices(text.encode() if isinstance(text, str) else text) for w in some]


def windows_of(words: list[bytes], window: int = WINDOW) -> set[tuple[bytes, ...]]:
    """Distinct windows of an item."""
    if not words:
        return set()
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * _FOLD
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


class _Length(NamedTuple):
    """Shift table and buckets of the patterns of m words."""

    m: int
    shift: np.ndarray  # by slot of the block that a position ends with
    keys: np.ndarray  # sorted hashes of a pattern's last and first block
    patterns: np.ndarray  # in that order, a row each
    number: np.ndarray  # of the pattern, in that order


def _block(words: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the blocks that end at positions ``at``."""
    return _mixed(words[at - 1] if m > 1 else np.zeros(len(at), np.uint64), words[at])


def _slot(block: np.ndarray) -> np.ndarray:
    return (block >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def _key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    x = (last ^ (first * _FOLD)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _length_table(patterns: np.ndarray, number: np.ndarray) -> _Length:
    m = patterns.shape[1]
    b = min(2, m)
    shift = np.full(SLOTS, m - b + 1, np.int32)
    flat = patterns.ravel()
    start = np.arange(len(patterns)) * m
    for j in range(b - 1, m):  # the block that ends at word j of each pattern
        np.minimum.at(shift, _slot(_block(flat, start + j, m)), m - 1 - j)
    keys = _key(_block(flat, start + m - 1, m), _block(flat, start + b - 1, m))
    order = np.argsort(keys, kind="stable")
    return _Length(m, shift, keys[order], patterns[order], number[order])


class Patterns:
    """Tables for windows (tuples of words) with the numbers of their items."""

    def __init__(self, held: dict[tuple[bytes, ...], list[int]]):
        self.vocabulary: dict[bytes, int] = {}
        numbered = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window] for window in held]
        sizes = np.array([len(x) for x in numbered], np.int64)
        self.lengths = []
        for m in sorted(set(sizes.tolist())):
            own = np.flatnonzero(sizes == m)
            self.lengths.append(_length_table(np.array([numbered[i] for i in own], np.int64).reshape(-1, m), own))
        items = list(held.values())
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
        self.items = np.array([i for x in items for i in x], np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], np.int64)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, words, pattern) of every occurrence; ``end`` is the position of its last word."""
        none = np.zeros(0, np.int64)
        ends, sizes, found = [none], [none], [none]
        for t in self.lengths:
            for end, number in self._search(words, t):
                ends.append(end)
                sizes.append(np.full(len(end), t.m))
                found.append(number)
        return np.concatenate(ends), np.concatenate(sizes), np.concatenate(found)

    def _search(self, words: np.ndarray, t: _Length) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begin = np.arange(0, max(0, len(words) - t.m + 1), PIECE)
        at, last = begin + t.m - 1, np.minimum(begin + PIECE + t.m - 2, len(words) - 1)
        while len(at):
            block = _block(words, at, t.m)
            step = t.shift[_slot(block)]
            hit = np.flatnonzero(step == 0)
            if len(hit):
                yield from self._confirmed(words, at[hit], block[hit], t)
            at = at + np.maximum(step, 1)
            open_ = at <= last
            at, last = at[open_], last[open_]

    def _confirmed(self, words: np.ndarray, end: np.ndarray, block: np.ndarray, t: _Length) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        b = min(2, t.m)
        key = _key(block, _block(words, end - t.m + b, t.m))
        low, high = np.searchsorted(t.keys, key, "left"), np.searchsorted(t.keys, key, "right")
        low, high, end = low[high > low], high[high > low], end[high > low]
        while len(end):  # one of each bucket at a time
            own = end[:, None] - np.arange(t.m - 1, -1, -1)
            same = (words[own] == t.patterns[low]).all(axis=1)
            if same.any():
                yield end[same], t.number[low[same]]
            low = low + 1
            more = low < high
            low, high, end = low[more], high[more], end[more]


def _scan_texts(texts: list[bytes | None], patterns: Patterns) -> Iterator[tuple[int, int, list[tuple[int, int]], list[int]]]:
    """For each text in turn: words, hit words, runs of hit words (start, end), numbers of its items."""
    overlap = max([t.m for t in patterns.lengths], default=1) - 1
    at, pending, size = 0, [], 0
    for i, text in enumerate(texts):
        parts = [patterns.numbers(some) for some in slices(text or b"")]
        pending.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        size += len(pending[-1])
        if size >= CHUNK or i == len(texts) - 1:
            yield from _scan_chunk(pending, patterns, overlap)
            at, pending, size = i + 1, [], 0


def _scan_chunk(numbered: list[np.ndarray], patterns: Patterns, overlap: int) -> Iterator[tuple[int, int, list[tuple[int, int]], list[int]]]:
    # a word that is in no pattern stands between texts
    lengths = np.array([len(x) for x in numbered], np.int64)
    start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
    words = np.concatenate([x for one in numbered for x in (one, np.zeros(1, np.int64))])
    ends, sizes, found = patterns.search(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, ends - sizes + 1, 1)
    np.add.at(edge, ends + 1, -1)
    hit = np.append(np.cumsum(edge)[:-1] > 0, False)
    turns = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
    runs = turns.reshape(-1, 2)  # texts are apart, so no run reaches into the next
    of_run = np.searchsorted(start, runs[:, 0], "right") - 1
    # (text, pattern), then (text, item), once each
    of_hit = np.searchsorted(start, ends, "right") - 1
    pairs = np.unique(of_hit * np.int64(max(1, len(patterns.first))) + found)
    texts, found = pairs // max(1, len(patterns.first)), pairs % max(1, len(patterns.first))
    count = patterns.first[found + 1] - patterns.first[found]
    spot = np.repeat(patterns.first[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    pairs = np.unique(np.stack([np.repeat(texts, count), patterns.items[spot]], axis=1), axis=0) if len(spot) else np.zeros((0, 2), np.int64)
    r, p = np.searchsorted(of_run, np.arange(len(numbered) + 1)), np.searchsorted(pairs[:, 0], np.arange(len(numbered) + 1))
    for i in range(len(numbered)):
        own = runs[r[i] : r[i + 1]] - start[i]
        yield int(lengths[i]), int((own[:, 1] - own[:, 0]).sum()), [tuple(x) for x in own.tolist()], pairs[p[i] : p[i + 1], 1].tolist()


# ---------------------------------------------------------------- over tables

_HITS = "row binary, doc_id string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item (item_id as a string, null if it has none) and its distinct windows, an array of words each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, text in zip(b["item"], b["text"], strict=True):
                found = sorted(windows_of(words_of(text), window))
                for i in range(0, len(found), 10_000):
                    some = found[i : i + 10_000]
                    yield pd.DataFrame({"item": [item] * len(some), "words": [[w.decode() for w in x] for x in some]})

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, "item string, words array<string>").distinct()


def _tables(parts: DataFrame, n: int, part: int) -> tuple[Patterns, list[str | None]]:
    own = parts.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == part) if n > 1 else parts
    items: dict[str | None, int] = {}
    held: dict[tuple[bytes, ...], list[int]] = {}
    for r in own.toLocalIterator():
        held.setdefault(tuple(w.encode() for w in r["words"]), []).append(items.setdefault(r["item"], len(items)))
    return Patterns(held), list(items)


def _scanned(docs: DataFrame, patterns: Patterns, names: list[str | None]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((patterns, names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns, names = sent.value
        for b in batches:
            found = list(_scan_texts(b["text"].tolist(), patterns))
            yield pd.DataFrame(
                {
                    "row": b["row"],
                    "doc_id": b["doc_id"],
                    "n_words": [x[0] for x in found],
                    "spans": [[{"start": s, "end": e} for s, e in x[2]] for x in found],
                    "items": [[names[i] for i in x[3] if names[i] is not None] for x in found],
                }
            )

    # ids as text: pandas would turn whole numbers beside nulls to floats
    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, _HITS).withColumn("doc_id", F.col("doc_id").cast("long"))


def _merged(spans: Column) -> Column:
    """Runs of the union of sorted runs."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, s: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    step = lambda a, s: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= s["start"]), joined(a, s)).otherwise(F.array_append(a, s))
    return F.aggregate(F.array_sort(spans), none, step)


def contaminated_runs(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, table_chars: int = TABLE_CHARS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (runs of hit words, end exclusive), items (item_ids as
    strings whose windows occur, sorted).

    A null text has no words, as has one without a word character; repeated rows are searched alike. Items
    with null ids hit words but aren't listed; items with the same id and several texts are one; items without
    words, and an empty benchmark, hit nothing. Windows (with their items) are collected and broadcast as long
    as their characters stay below ``table_chars``; a larger benchmark is split, and the documents are read
    once for each part.
    """
    ready(docs.sparkSession)
    parts = checkpoint(windows(benchmark, window))
    chars = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w) + 1) + F.coalesce(F.length("item"), F.lit(0))
    total = parts.agg(F.sum(chars)).first()[0] or 0
    n = max(1, -(-total // table_chars))
    out = _scanned(docs, *_tables(parts, n, 0))
    if n > 1:
        rest = [_scanned(docs, *_tables(parts, n, i)).filter("size(spans) > 0").dropDuplicates(["row"]) for i in range(1, n)]
        more = rest[0]
        for x in rest[1:]:
            more = more.unionByName(x)
        # a row has one element of each part at most
        more = more.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
        both = out.join(more, "row", "left")
        spans = _merged(F.concat("spans", "s"))
        out = both.withColumn("items", F.when(F.col("i").isNull(), F.col("items")).otherwise(F.array_distinct(F.concat("items", "i")))).withColumn("spans", F.when(F.col("s").isNull(), F.col("spans")).otherwise(spans))
    return out.select("doc_id", "n_words", "spans", F.array_sort("items").alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what ``contaminated_runs`` found."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    out = found.withColumn("n_hit", n_hit)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_sql(window: int = WINDOW) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH b AS (SELECT item_id, {words} AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS n, doc_id, {words} AS w FROM documents),
windows AS (SELECT DISTINCT item_id, least({window}, len(w)) AS m, array_to_string(list_slice(w, i, i + {window} - 1), ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {window} + 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
places AS (SELECT n, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, sizes WHERE len(w) >= m),
hits AS (SELECT p.n, p.i, p.m, x.item_id FROM (SELECT n, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s FROM places) p JOIN windows x USING (m, s)),
words_hit AS (SELECT n, count(*) AS n_hit FROM (SELECT DISTINCT n, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT n, i, m FROM hits)) GROUP BY n),
items AS (SELECT n, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT n, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (n) LEFT JOIN items USING (n)
"""
