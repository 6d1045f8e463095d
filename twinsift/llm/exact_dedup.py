"""Exact deduplication behind static binary-fuse filters.

A snapshot (what was taken in before) never changes, so its digests go into static filters, one for
each shard of the digest space. An incoming batch is grouped by digest first; then the filters
screen its distinct digests. Those that a filter may hold join the snapshot's exact buckets, where
the bytes are checked; the others are new, and their groups are those of the batch alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.rows import row_key
from twinsift.runtime import checkpoint, keep

#: Digests in a shard, about, of the snapshot or the batch; a shard's filter takes some 2.3 bytes a digest.
SHARD_DIGESTS = 250_000
#: Parts that the texts of each shared digest are dealt to for the byte check.
PARTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


# ---------------------------------------------------------------- binary fuse filter (3-wise)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class BinaryFuse:
    """A static 3-wise binary-fuse filter with 16-bit fingerprints over distinct 64-bit keys.

    Each key has a slot in each of three neighbouring segments; the three fingerprints there add up
    (xor) to the key's own. Built by peeling, all slots of degree one at a time.
    """

    def __init__(self, seed: int, segment: int, segments: int, slots: np.ndarray):
        self.seed, self.segment, self.segments, self.slots = seed, segment, segments, slots

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        at = np.empty((3, len(keys)), np.int64)
        for j in range(3):
            within = (_mix(h, 0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF) & np.uint64(segment - 1)).astype(np.int64)
            at[j] = (first + j) * segment + within
        return at, (h ^ (h >> np.uint64(32))).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        segments = max(1, -(-int(n * factor) // segment))
        for seed in range(1, 200):
            at, mark = cls._places(keys, seed, segment, segments)
            size = (segments + 2) * segment
            degree = np.bincount(at.ravel(), minlength=size)
            held = np.zeros(size, np.int64)
            for j in range(3):
                np.bitwise_xor.at(held, at[j], np.arange(n))
            order, left = [], n
            single = np.flatnonzero(degree == 1)
            while len(single):
                key, slot = held[single], single
                key, first = np.unique(key, return_index=True)  # a key may have two such slots
                slot = slot[first]
                order.append((key, slot))
                left -= len(key)
                touched = at[:, key]
                for j in range(3):
                    np.subtract.at(degree, touched[j], 1)
                    np.bitwise_xor.at(held, touched[j], key)
                touched = np.unique(touched)
                single = touched[degree[touched] == 1]
            if left:
                segments += 1 + segments // 16
                continue
            slots = np.zeros(size, np.uint16)
            for key, slot in reversed(order):
                others = slots[at[0, key]] ^ slots[at[1, key]] ^ slots[at[2, key]]  # the own slot is still 0
                slots[slot] = mark[key] ^ others
            return cls(seed, segment, segments, slots)
        raise RuntimeError("the filter can't be built")

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at, mark = self._places(np.asarray(keys, np.uint64), self.seed, self.segment, self.segments)
        return (self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]]) == mark

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.int64).tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse:
        seed, segment, segments = np.frombuffer(data[:24], np.int64).tolist()
        return cls(seed, segment, segments, np.frombuffer(data[24:], np.uint16))


def _keys(digests: pd.Series) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "big") for d in digests], np.uint64)


# ---------------------------------------------------------------- groups


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row, digest (SHA-256 of the normalised text, 32 bytes), long (code points of the text)."""
    return docs.select(
        "doc_id",
        row_key().alias("row"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("long"),
    )


def _better() -> Column:
    """Orders rows of a group: most code points, then smallest doc_id (null last)."""
    named = F.col("doc_id").isNotNull().alias("named")
    return F.struct(F.col("long"), named, F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("turned"))


def group(rows: DataFrame) -> DataFrame:
    """The groups of a batch: digest, n, best, keep_id. Partial sums make a hot digest one row a task."""
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(_better()).alias("best"))


def _shard(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 9, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def snapshot_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """shard, filter: a static filter over the distinct digests of each shard of a snapshot."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"][:1], "filter": [BinaryFuse.build(_keys(pdf["digest"])).to_bytes()]})

    return snapshot.select(_shard(shards).alias("shard"), "digest").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """``incoming`` (distinct digests) with ``positive``: the shard's filter may hold the digest.

    A shard without a filter holds nothing. No digest of the snapshot is ever negative.
    """
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in incoming.schema.fields]
    names = incoming.columns

    def test(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = BinaryFuse.from_bytes(right["filter"].iloc[0]).may_hold(_keys(left["digest"])) if len(right) and len(left) else np.zeros(len(left), bool)
        return left[names].assign(positive=held)

    return (
        incoming.withColumn("shard", _shard(shards))
        .groupBy("shard")
        .cogroup(filters.groupBy("shard"))
        .applyInPandas(test, ", ".join([*columns, "positive boolean"]))
    )


def check_bytes(texts: DataFrame) -> DataFrame:
    """digest, equal: whether all normalised texts of each digest are the same bytes.

    Smallest and largest text of a digest agree exactly if all do, and both have partial forms, so no
    bucket meets in one task as a whole.
    """
    return texts.groupBy("digest").agg((F.min("body") == F.max("body")).alias("equal"))


def dedup(docs: DataFrame, incoming: Column | None = None, with_rows: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``incoming`` tells the new batch from the snapshot; by default crc32(doc_id) deals the table to
    two, and the result is the same for every deal. A null text is empty; empty texts form a group;
    repeated rows are members of their own, and of rows that agree in doc_id too all are ``kept``
    that equal the best one. ``with_rows`` adds each row's key. Raises if two texts with one SHA-256 differ.
    """
    incoming = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 1, F.lit(False)) if incoming is None else incoming
    rows = keep(digests(docs).withColumn("incoming", incoming))
    old, new = keep(group(rows.filter("not incoming"))), keep(group(rows.filter("incoming")))
    shards = max(1, -(-max(old.count(), new.count()) // SHARD_DIGESTS))
    filters = snapshot_filters(old, shards)
    screened = checkpoint(screen(new.select("digest", "n", "best"), filters, shards))
    found = screened.filter("positive").select("digest", F.col("n").alias("n2"), F.col("best").alias("best2"))
    buckets = old.join(found, "digest", "left")
    merged = buckets.select("digest", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("best", "best2").alias("best"), F.lit(True).alias("old"))
    wrong = found.join(old, "digest", "left_anti")  # let through, yet in no bucket: new after all
    fresh = screened.filter("not positive").select("digest", "n", "best").unionByName(wrong.select("digest", F.col("n2").alias("n"), F.col("best2").alias("best")))
    groups = checkpoint(merged.select("digest", "n", "best").unionByName(fresh))
    shared = groups.filter("n > 1").select("digest", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    # Compared are the bytes of all that share a digest, snapshot's buckets and new groups alike.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part")
    body = docs.select(F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), part, normalised(F.col("text")).cast("binary").alias("body"))
    bytes_of = body.join(shared, ["digest", "part"], "left_semi")
    if not check_bytes(bytes_of).filter("not equal").isEmpty():
        raise ValueError("texts that differ share a SHA-256")
    own = _better()
    return rows.join(groups, "digest").select(
        *(["row"] if with_rows else []),
        "doc_id",
        F.when(F.col("best.named"), F.bitwise_not("best.turned")).alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (own == F.col("best")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS long_, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-long_, doc_id)) AS keep_id FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
