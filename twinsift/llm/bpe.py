"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

The tree's leaves hold rank and place of the pair that starts at a symbol; its root is the lowest
rank, leftmost on ties. A merge rewrites at most three leaves and their ancestors, so a piece of n
bytes takes O(n log n). Distinct pieces are encoded together: one tree a row of a matrix, and each
step merges the root pair of every row at once. Long pieces use the same tree one at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pre-tokeniser's pattern (fixed value of the byte-level format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces with more bytes than this get a tree of their own.
WIDE = 128
#: Pieces taken at a time, and distinct pieces in each of a task's two generations of remembered ones.
CHUNK, REMEMBERED = 100_000, 120_000
NONE = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What a byte-level ``tokenizer.json`` says: ids of bytes, merges by rank, special tokens."""

    def __init__(self, data: dict):
        alphabet = byte_alphabet()
        vocab = data["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.token = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in (vocab | self.special).items()}
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = (left << 32) + right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it doesn't merge; ids below 0 never do."""
        key = (left << 32) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], NONE)


class PairTree:
    """A segment tree of minima over keys rank * size + place."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, (len(ranks) - 1).bit_length())
        keys = [r * self.size + i if r < NONE else NONE for i, r in enumerate(ranks)]
        self.tree = [NONE] * self.size + keys + [NONE] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    @property
    def root(self) -> tuple[int, int] | None:
        key = self.tree[1] if self.size > 1 else self.tree[-1]
        return divmod(key, self.size) if key < NONE else None

    def set(self, place: int, rank: int) -> None:
        i = self.size + place
        self.tree[i] = rank * self.size + place if rank < NONE else NONE
        i >>= 1
        while i:
            low = min(self.tree[2 * i], self.tree[2 * i + 1])
            if self.tree[i] == low:
                break
            self.tree[i] = low
            i >>= 1


def encode_long(piece: bytes, v: Vocabulary) -> list[int]:
    """One piece, one tree."""
    ids = v.byte_ids[np.frombuffer(piece, np.uint8)]
    n = len(ids)
    tree = PairTree(v.ranks(ids[:-1], ids[1:]).tolist()) if n > 1 else None
    ids = ids.tolist()
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    rank = lambda a, b: int(v.ranks(np.array([a]), np.array([b]))[0])
    known: dict[tuple[int, int], int] = {}
    while tree and (top := tree.root):
        r, i = top
        j = after[i]
        k = after[i] = after[j]
        ids[i], ids[j] = int(v.merged[r]), -1
        if k >= 0:
            before[k] = i
        for place, pair in ((i, (ids[i], ids[k]) if k >= 0 else None), (before[i], (ids[before[i]], ids[i]) if before[i] >= 0 else None)):
            if place >= 0:
                if pair and pair not in known:
                    known[pair] = rank(*pair)
                tree.set(place, known[pair] if pair else NONE)
        if j < n - 1:
            tree.set(j, NONE)
    return [x for x in ids if x >= 0]


def encode_rows(pieces: list[bytes], v: Vocabulary, width: int) -> list[np.ndarray]:
    """Pieces of at most ``width`` (a power of two) bytes, a tree for each row of a matrix."""
    rows = len(pieces)
    ids = np.full((rows, width + 1), -1, np.int64)  # the last column is no symbol
    lengths = np.fromiter(map(len, pieces), np.int64, rows)
    ids[:, :width][np.arange(width) < lengths[:, None]] = v.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.minimum(np.tile(np.arange(1, width + 2), (rows, 1)), lengths[:, None])
    after[after >= lengths[:, None]] = width
    before = np.tile(np.arange(-1, width), (rows, 1))
    before[:, 0] = width
    key = lambda rank, place: np.where(rank < NONE, rank * width + place, NONE)
    tree = np.full((rows, 2 * width), NONE, np.int64)
    tree[:, width : 2 * width] = key(v.ranks(ids[:, :width], ids[:, 1:]), np.arange(width))
    for i in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    live = np.flatnonzero(tree[:, 1] < NONE)
    while len(live):
        top = tree[live, 1]
        i = top % width
        j = after[live, i]
        k = after[live, j]
        new = v.merged[top // width]
        ids[live, i], ids[live, j], after[live, i], before[live, k] = new, -1, k, i
        h = before[live, i]
        tree[live, width + i] = key(v.ranks(new, ids[live, k]), i)
        tree[live, width + j] = NONE
        left = np.where(h < width, h, i)
        tree[live, width + left] = np.where(h < width, key(v.ranks(ids[live, h], new), h), tree[live, width + i])
        at = [width + i >> 1, width + j >> 1, width + left >> 1]
        while at[0][0]:
            for x in at:
                tree[live, x] = np.minimum(tree[live, 2 * x], tree[live, 2 * x + 1])
            at = [x >> 1 for x in at]
        live = live[tree[live, 1] < NONE]
    flat = ids[:, :width]
    kept = flat >= 0
    return np.split(flat[kept], np.cumsum(kept.sum(1))[:-1])


def encode_pieces(pieces: Iterable[bytes], v: Vocabulary) -> dict[bytes, list[int]]:
    """ids of each distinct piece."""
    by_width: dict[int, list[bytes]] = {}
    for p in pieces:
        by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()) if p else 0, []).append(p)
    out: dict[bytes, list[int]] = {b"": []}
    for width, group in by_width.items():
        if width > WIDE:
            out.update((p, encode_long(p, v)) for p in group)
        elif width:
            step = max(1, (1 << 20) // width)
            for s in range(0, len(group), step):
                some = group[s : s + step]
                out.update(zip(some, (x.tolist() for x in encode_rows(some, v, width)), strict=True))
    return out


def give_back() -> None:
    """Return freed memory to the system, as a worker waits for its next task beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


class Codec:
    """Encodes texts piece by piece. What was met lately is remembered, in a generation that becomes the
    old one when it is full, so that frequent pieces stay and memory is bounded."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.pattern = regex.compile(PATTERN)
        self.special = {s: (str(i), 1, self.decode_bytes([i])) for s, i in v.special.items()}
        self.known: dict[str, tuple[str, int, bytes]] = dict(self.special)
        self.old: dict[str, tuple[str, int, bytes]] = {}

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The text's pieces in lists of some CHUNK, special tokens among them."""
        for part in self.v.split.split(text) if self.v.split else [text]:
            if part in self.v.special:
                yield [part]
            elif len(part) <= CHUNK:
                yield self.pattern.findall(part)
            else:
                matches = self.pattern.finditer(part)
                while some := [m[0] for m in islice(matches, CHUNK)]:
                    yield some

    def learn(self, pieces: set[str]) -> None:
        """Afterwards all of ``pieces`` are in ``known``."""
        missing = [p for p in pieces if p not in self.known]
        if missing and len(self.known) + len(missing) > REMEMBERED:
            self.old, self.known = self.known, dict(self.special)
            missing = [p for p in pieces if p not in self.known]
        new = []
        for p in missing:
            entry = self.old.get(p)
            if entry:
                self.known[p] = entry
            else:
                new.append(p)
        ids = encode_pieces({p.encode() for p in new}, self.v)
        for p in new:
            x = ids[p.encode()]
            self.known[p] = (",".join(map(str, x)), len(x), self.decode_bytes(x))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.v.token[i] for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for some in self._pieces(text):
            self.learn(set(some))
            for p in some:
                out.extend(map(int, filter(None, self.known[p][0].split(","))))
        return out

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """(n_tokens, sha256 of the ids, sha256 of the decoded text) of each text, in order."""
        states: list[list] = []
        waiting: list[tuple[list, list[str]]] = []
        held = 0

        def settle() -> None:
            self.learn({p for _, some in waiting for p in some})
            for state, some in waiting:
                entries = [self.known[p] for p in some]
                joined = ",".join([e[0] for e in entries])
                state[1].update((("," if state[0] else "") + joined).encode())
                state[0] += sum([e[1] for e in entries])
                state[2].update(b"".join([e[2] for e in entries]))
            waiting.clear()

        for text in texts:
            states.append(state := [0, hashlib.sha256(), hashlib.sha256()])
            for some in self._pieces(text):
                if some:
                    waiting.append((state, some))
                    held += len(some)
                if held >= CHUNK:
                    settle()
                    held = 0
        settle()
        for n, ids, decoded in states:
            yield n, ids.hexdigest(), decoded.hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (null: empty, no tokens).

    ``vocabulary`` is the path of a byte-level tokenizer.json, read on the driver; executors get its
    tables, which have a fixed size. Nothing is shuffled. Repeated rows give repeated rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(held.value)
        for b in batches:
            out = list(codec.digests(t if isinstance(t, str) else "" for t in b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [x[0] for x in out], "ids_sha256": [x[1] for x in out], "decoded_sha256": [x[2] for x in out]})
        del codec
        give_back()

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and decoded: the operator's plain output."""
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(held.value)
        for b in batches:
            ids = [codec.encode(t) if isinstance(t, str) else [] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids, "decoded": [codec.decode(x) for x in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>, decoded string")
