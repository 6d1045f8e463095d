"""Pairs within groups, in blocks: a group's rows are packed to blocks of bounded size, blocks meet by an
equality join, and a kernel over arrays scores the pairs of two blocks at once. So no pair is a row before it is
known to count, a hot group is many tasks' work, and tasks follow the number of block pairs instead of bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.runtime import checkpoint, spread

#: Rows of a block, about.
BLOCK = 1024
#: Numbers of a tile that a kernel works on at a time, and rows that it gives back at a time.
TILE, ROWS = 1 << 21, 100_000


def blocked(rows: DataFrame, keys: list[str], columns: list[str], size: int = BLOCK) -> DataFrame:
    """keys, block, and each of ``columns`` (the first tells rows apart) as an array over the block's rows."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("_blocks"))
    at = rows.join(n, keys).withColumn("block", F.pmod(F.xxhash64(columns[0]), F.col("_blocks")))
    held = at.groupBy(*keys, "block").agg(F.collect_list(F.struct(*columns)).alias("_held"))
    return checkpoint(held.select(*keys, "block", *[F.col(f"_held.{c}").alias(c) for c in columns]))


def sides(blocks: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``blocks`` twice, with ``_l`` and ``_r`` behind the names of ``columns``."""
    rest = [c for c in blocks.columns if c not in columns]
    return tuple(blocks.select(*rest, *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "lr")


def within(blocks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each pair of blocks of a group, and each block with itself (``same``), dealt to all cores."""
    left, right = sides(blocks, ["block", *columns])
    pairs = left.join(right, keys).filter("block_l <= block_r").withColumn("same", F.col("block_l") == F.col("block_r"))
    return spread(pairs, *keys, "block_l", "block_r")


def cut(r: pd.Series, size: int = BLOCK) -> Iterator[dict]:
    """A row of two blocks as pairs of pieces of at most ``size``; of a block with itself (``same``), each pair of pieces once."""
    left, right = ({k: r[k] for k in r.index if k.endswith(side) and isinstance(r[k], np.ndarray | list)} for side in ("_l", "_r"))
    n, m, same = len(r["id_l"]), len(r["id_r"]), bool(r["same"])
    for i in range(0, n, size):
        for j in range(i if same else 0, m, size):
            yield {"same": same and i == j, **{k: v[i : i + size] for k, v in left.items()}, **{k: v[j : j + size] for k, v in right.items()}}


#: Takes a pair of blocks, returns places of left and right rows, and scores.
Kernel = Callable[[dict], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def scored(pairs: DataFrame, kernel: Kernel) -> DataFrame:
    """(a, b, score), a < b, of the pairs that ``kernel`` gives back for each row of ``pairs``: id_l and
    id_r, ``same`` and what the kernel reads. Pairs of a block with itself come once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for batch in batches:
            for r in (part for _, row in batch.iterrows() for part in cut(row)):
                left, right = np.asarray(r["id_l"], np.int64), np.asarray(r["id_r"], np.int64)
                for i, j, score in kernel(r):
                    a, b = left[i], right[j]
                    keep = a < b if r["same"] else a != b
                    out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], score[keep]))
                    held += len(out[-1][0])
                    if held >= ROWS:
                        yield _frame(out)
                        out, held = [], 0
        if held:
            yield _frame(out)

    return pairs.mapInPandas(run, "a long, b long, score double")


def opened(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, of all pairs of two blocks' ids (id_l, id_r, ``same``); of a block with itself each once. A generator in the JVM would
    hold all rows of a pair of blocks before the first is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, same in zip(*(batch.column(c) for c in ("id_l", "id_r", "same")), strict=True):
                x, y, same = left.values.to_numpy(), right.values.to_numpy(), same.as_py()
                for t in range(0, len(y), ROWS):
                    part = y[t : t + ROWS]
                    step = max(1, ROWS // len(part))
                    for s in range(0, len(x), step):
                        a, b = np.repeat(x[s : s + step], len(part)), np.tile(part, len(x[s : s + step]))
                        keep = a < b if same else a != b
                        if not keep.all():
                            a, b = a[keep], b[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _frame(out: list) -> pd.DataFrame:
    a, b, score = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"a": a, "b": b, "score": score})


# ---------------------------------------------------------------- kernels


def _padded(hashes) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as a matrix, short ones filled up with their first hash (which changes no nearest
    distance), and their lengths."""
    n = np.array([len(h) for h in hashes], np.int64)
    out = np.empty((len(n), int(n.max(initial=0))), np.uint64)
    for row, h in zip(out, hashes, strict=True):
        row[: len(h)] = np.asarray(h, np.int64).view(np.uint64)
        row[len(h) :] = row[0]
    return out, n


def _signs(hashes: np.ndarray) -> np.ndarray:
    """64 numbers for each hash, 1 for a bit that is set and -1 for one that isn't."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8)).reshape(*hashes.shape, 64)
    return bits.astype(np.float32) * 2 - 1


#: Rows and columns of a product of hashes, about.
_ROWS, _COLUMNS = 128, 2048
#: Three hashes share a product: each has a byte of a whole number that a float holds exactly.
_PACKED = 3
_BYTES = np.array([1 << 8 * k for k in range(_PACKED)], np.float32)
#: Added to such a number, it leaves its bytes as the float's own.
_SHIFT = np.float32(1 << 23)


def best_match_tiles(left, right) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, first column and scores of each tile of two lists of sequences: mean distance of each hash to its nearest in
    the other sequence, averaged both ways. Sequences have at least one hash.

    Equal bits of two hashes are (64 + the product of their signs) / 2, a whole number that goes into a byte, so three
    sequences on the right share each product."""
    (x, nx), (y, ny) = _padded(left), _padded(right)
    if not len(x) or not len(y):
        return
    width, height = y.shape[1], x.shape[1]
    own = np.where(np.arange(height) < nx[:, None], 255, 0).astype(np.uint8)
    theirs = np.where(np.arange(width) < ny[:, None], 255, 0).astype(np.uint8)
    xs = _signs(x).reshape(len(x), height, 64) / 2
    xs = np.concatenate([xs, np.full((len(x), height, 1), 32, np.float32)], axis=2)
    rows, columns = max(1, _ROWS // height), max(1, _COLUMNS // width)
    sums = np.uint16 if max(width, height) < 1000 else np.uint32
    held = np.empty(rows * height * columns * width, np.float32)
    for c in range(0, len(y), _PACKED * columns):
        part, short = y[c : c + _PACKED * columns], theirs[c : c + _PACKED * columns]
        t = -(-len(part) // _PACKED)
        spare = _PACKED * t - len(part)
        part = np.concatenate([part, part[:spare]]) if spare <= len(part) else np.concatenate([part, np.repeat(part[:1], spare, axis=0)])
        # the sequence in column j of byte k is number k * t + j
        ys = (_signs(part).reshape(_PACKED, t, width, 64) * _BYTES[:, None, None, None]).sum(axis=0)
        ys = np.concatenate([ys.transpose(2, 1, 0).reshape(64, width * t), np.full((1, width * t), _BYTES.sum())])
        mask = np.zeros((_PACKED * t, width), np.uint8)
        mask[: len(short)] = short
        mask = np.concatenate([mask, np.zeros((t, width), np.uint8)]).reshape(_PACKED + 1, t, width).transpose(2, 1, 0).reshape(width, (_PACKED + 1) * t)
        for s in range(0, len(x), rows):
            part_x, mine = xs[s : s + rows], own[s : s + rows]
            r = len(part_x)
            equal = held[: r * height * width * t].reshape(r * height, width * t)
            np.matmul(part_x.reshape(r * height, 65), ys, out=equal)
            equal += _SHIFT
            equal = equal.view(np.uint8).reshape(r, height, width, 4 * t)
            one = (equal.max(axis=2) & mine[:, :, None]).sum(axis=1, dtype=sums).reshape(r, t, 4)
            other = (equal.max(axis=1) & mask).sum(axis=1, dtype=sums).reshape(r, t, 4)
            one, other = (v.transpose(0, 2, 1)[:, :_PACKED].reshape(r, _PACKED * t)[:, : len(short)] for v in (one, other))
            n, m = nx[s : s + rows, None], ny[c : c + len(short)]
            yield s, c, ((64 * n - one) / n + (64 * m - other) / m) / 2


def best_match(most: float | None = None) -> Kernel:
    """The score of ``best_match_tiles`` for the pairs where it is at most ``most`` (all, if None)."""

    def run(r: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for s, c, score in best_match_tiles(r["value_l"], r["value_r"]):
            i, j = np.nonzero(score <= most) if most is not None else np.indices(score.shape).reshape(2, -1)
            if len(i):
                yield i + s, j + c, score[i, j]

    return run


def score_counts(pairs: DataFrame) -> DataFrame:
    """(distance, n) sums over pairs of blocks: how many pairs of files have a ``best_match_tiles`` score that rounds, halves to
    even, to that distance. ``m_l`` and ``m_r`` say for how many files a row stands; no pair is a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.zeros(65, np.int64)
            for r in (part for _, row in batch.iterrows() for part in cut(row)):
                m, n = np.asarray(r["m_l"], np.int64), np.asarray(r["m_r"], np.int64)
                alone = not r["same"] and (m == 1).all() and (n == 1).all()
                for s, c, score in best_match_tiles(r["value_l"], r["value_r"]):
                    at = np.rint(score).astype(np.int64)
                    if alone:
                        found += np.bincount(at.ravel(), minlength=65)
                        continue
                    weight = m[s : s + len(at), None] * n[None, c : c + at.shape[1]]
                    if r["same"]:  # each pair once
                        weight = np.where(np.arange(s, s + len(at))[:, None] < np.arange(c, c + at.shape[1]), weight, 0)
                    np.add.at(found, at.ravel(), weight.ravel())
            at = np.flatnonzero(found)
            yield pd.DataFrame({"distance": at.astype(np.int32), "n": found[at]})

    return pairs.mapInPandas(run, "distance int, n long")


def closest(pairs: DataFrame, n: int) -> DataFrame:
    """(a, b, score), a < b, of the ``n`` pairs with the lowest ``best_match_tiles`` scores, ties by a and b, that each task
    finds in its pairs of blocks: the lowest of all are among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0)})
        most = np.inf
        for batch in batches:
            for r in (part for _, row in batch.iterrows() for part in cut(row)):
                left, right = np.asarray(r["id_l"], np.int64), np.asarray(r["id_r"], np.int64)
                for s, c, score in best_match_tiles(r["value_l"], r["value_r"]):
                    i, j = np.nonzero(score <= most)
                    a, b, score = left[i + s], right[j + c], score[i, j]
                    keep = a < b if r["same"] else a != b
                    if not keep.any():
                        continue
                    a, b, score = a[keep], b[keep], score[keep]
                    low, high = np.concatenate([best["a"], np.minimum(a, b)]), np.concatenate([best["b"], np.maximum(a, b)])
                    score = np.concatenate([best["score"], score])
                    first = np.lexsort((high, low, score))[:n]
                    best = pd.DataFrame({"a": low[first], "b": high[first], "score": score[first]})
                    most = best["score"].iloc[-1] if len(best) == n else np.inf
        yield best

    return pairs.mapInPandas(run, "a long, b long, score double")


def _bits(prints) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings as 64-bit words, the mask of the bytes they have, and their lengths."""
    n = np.array([len(p) for p in prints], np.int64)
    width = -(-int(n.max(initial=0)) // 8) * 8
    out = np.zeros((len(n), width), np.uint8)
    for row, p in zip(out, prints, strict=True):
        row[: len(p)] = np.frombuffer(p, np.uint8)
    mask = np.where(np.arange(width) < n[:, None], 255, 0).astype(np.uint8)
    return out.view(np.uint64), mask.view(np.uint64), n


#: Share of a string's bits that are compared first, times the share that may differ.
_AHEAD = 3


def _most(n: np.ndarray, least: float) -> np.ndarray:
    """Bits in which strings with a common prefix of n bytes may differ."""
    return np.floor((1 - least) * 8 * n + 1e-6).astype(np.int64)


def equal_bits(least: float | None = None, words: int = 64) -> Kernel:
    """Share of equal bits in the common prefix of two byte strings, 0 without one, of the pairs where it is at
    least ``least`` (all, if None). A pair with too many different bits among its first is not read to its end.

    Different bits of the first ``words`` are (common bits - the product of their signs) / 2, where a byte that one hasn't
    counts nothing; only what passes there is compared further. With ``least``, they are no more than it takes for most unrelated
    strings, which differ in half of their bits, to fail."""

    def run(r: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        (x, mx, nx), (y, my, ny) = _bits(r["value_l"]), _bits(r["value_r"])
        width = min(x.shape[1], y.shape[1])
        first = min(words, width if least is None else max(4, int(np.ceil(_AHEAD * (1 - least) * width))), width)
        xs, ys = (_signs(v[:, :first]).reshape(len(v), -1) * np.unpackbits(np.ascontiguousarray(m[:, :first]).view(np.uint8), axis=None).reshape(len(v), -1) for v, m in ((x, mx), (y, my)))
        step = max(1, TILE // 8 // max(1, len(y)))
        for s in range(0, len(x), step):
            product = xs[s : s + step] @ ys.T
            some = slice(s, s + step)
            if least is None or least <= 0:
                i, j = np.indices(product.shape).reshape(2, -1)
            else:
                # all of one length, as prints mostly are, need one bound and no matrix of bounds
                n = nx[:1] if (nx == nx[0]).all() and (ny == nx[0]).all() else np.minimum(nx[some, None], ny)
                i, j = np.nonzero((product >= (8 * np.minimum(n, 8 * first) - 2 * _most(n, least)).astype(np.float32)) & (n > 0))
            n = np.minimum(nx[some][i], ny[j])
            most = np.full(n.shape, np.iinfo(np.int64).max) if least is None else _most(n, least)
            differ = (8 * np.minimum(n, 8 * first) - np.rint(product[i, j]).astype(np.int64)) // 2
            for w in range(first, width, words):
                for at in range(0, len(i), max(1, TILE // words)):
                    p, q = i[at : at + TILE // words] + s, j[at : at + TILE // words]
                    part = slice(w, min(w + words, width))
                    differ[at : at + TILE // words] += np.bitwise_count((x[p, part] ^ y[q, part]) & mx[p, part] & my[q, part]).sum(axis=1, dtype=np.int64)
                keep = differ <= most
                if not keep.all():
                    i, j, n, most, differ = i[keep], j[keep], n[keep], most[keep], differ[keep]
            bits = 8 * n
            score = np.where(bits > 0, 1 - differ / np.maximum(bits, 1), 0.0)
            if least is not None:
                keep = score >= least
                i, j, score = i[keep], j[keep], score[keep]
            yield i + s, j, score

    return run


def jaccard_sums(pairs: DataFrame, group: str) -> DataFrame:
    """group and s, sums over pairs of blocks: Jaccard similarity of each pair of different token sets, weighted by how
    often both occur. Only sets with a common token are looked at: each block's sets are listed by token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, r in batch.iterrows():
                sets, weights = r["value_r"], np.asarray(r["m_r"], float)
                sizes = np.array([len(t) for t in sets], np.int64)
                listed: dict[str, list[int]] = {}
                for j, tokens in enumerate(sets):
                    for t in tokens:
                        listed.setdefault(t, []).append(j)
                at = {t: np.array(js) for t, js in listed.items()}
                total = 0.0
                for i, (tokens, m) in enumerate(zip(r["value_l"], r["m_l"], strict=True)):
                    met = [at[t] for t in tokens if t in at]
                    if not met:
                        continue
                    common = np.bincount(np.concatenate(met), minlength=len(sizes))
                    if r["same"]:
                        common[: i + 1] = 0  # each pair once
                    j = np.flatnonzero(common)
                    total += m * (weights[j] * common[j] / (len(tokens) + sizes[j] - common[j])).sum()
                out.append((r[group], total))
            yield pd.DataFrame(out, columns=[group, "s"])

    kind = dict(pairs.dtypes)[group]
    return pairs.mapInPandas(run, f"`{group}` {kind}, s double")
