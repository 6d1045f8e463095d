"""Hard-negative mining by exact inner products, pruned in a rotated basis.

The rotation is that of the principal axes of all rows (eigenvectors of their second moments, as products are
taken about the origin). Leading axes carry the most of a product. What an anchor and a row have beyond the first k
axes adds at most the product of their residual norms, and rounding at most a slack that follows from the
dimensions and from how far the rotation is from orthogonal. A pair whose bound stays below what the anchor
still needs is left out after few axes; what remains is scored by whole numbers.

Anchors meet all rows in blocks: rows are dealt to groups, anchors to shares, and each (group, share) is a
task's work of bounded size. Of each block an anchor keeps its best few, which are merged by windows over a few
rows an anchor and group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.runtime import checkpoint, ready

POSITIVES, NEGATIVES = 5, 3
#: Negatives score between these shares of the positive, in hundredths.
LEAST, MOST = 50, 95
SCALE = 256
#: Rows of a group and anchors of a share, at most; below that as many groups as keep the cores busy.
GROUP_ROWS, GROUP_LEAST, SHARE_ANCHORS = 32_768, 1024, 8192
#: Anchors and rows that are scored at a time.
TILE_ANCHORS, TILE_ROWS = 512, 4096
#: Axes after which pairs are judged, as shares of all.
STAGES = (0.25, 0.5, 0.75, 1.0)
#: Share of a tile's pairs below which they are followed one by one.
SPARSE = 0.1
_NONE = np.iinfo(np.int64).min


def quantised(rows: DataFrame, vector: str = "embedding", label: str | Column = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label and x, whole numbers floor(scale * c).

    Rows with a null id, label or vector, or a null or non-finite entry, take no part. Of rows with one id the
    one with the smallest label, then vector, does. Entries beyond 2 ** 24 raise, as products would leave the longs.
    """
    c = F.col(vector)
    usable = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    fits = lambda v: F.abs(v.cast("double")) * scale < float(1 << 24)
    whole = lambda v: F.when(fits(v), F.floor(v.cast("double") * scale)).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long"))
    label = F.col(label) if isinstance(label, str) else label
    out = rows.filter(usable).select("vec_id", label.cast("long").alias("label"), F.transform(c, whole).cast("array<int>").alias("x")).filter("vec_id is not null and label is not null")
    return out.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), np.int64).reshape(len(x), -1)


def rotation(rows: DataFrame) -> np.ndarray:
    """Orthogonal axes (columns), those of the largest second moments first. Raises if vectors differ in length."""
    sizes = [r["d"] for r in rows.select(F.size("x").alias("d")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("vectors differ in length")
    d = sizes[0] if sizes else 0
    if not d:
        return np.zeros((0, 0))
    names = [f"c{j}" for j in range(d)]

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            x = _matrix(b["x"]).astype(float)
            total += x.T @ x
        yield pd.DataFrame(total, columns=names).assign(i=range(d))[["i", *names]]

    parts = rows.select("x").mapInPandas(run, ", ".join(["i int", *[f"{c} double" for c in names]]))
    moments = np.zeros((d, d))
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        moments[r["i"]] = [r[c] for c in names]
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()


class Side:
    """Vectors as whole numbers, rotated, with the norms of what lies beyond each stage."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.x = x
        self.rotated = x @ axes
        self.norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        self.stops = stops(len(axes))
        squares = self.rotated**2
        self.rest = {k: np.sqrt(squares[:, k:].sum(axis=1)) for k in self.stops}

    def at(self, own) -> Side:
        out = object.__new__(Side)
        out.x, out.rotated, out.norm, out.stops = self.x[own], self.rotated[own], self.norm[own], self.stops
        out.rest = {k: v[own] for k, v in self.rest.items()}
        return out


def stops(d: int) -> list[int]:
    return sorted({max(1, round(s * d)) for s in STAGES}) if d else []


def slack_of(axes: np.ndarray) -> float:
    """Rounding of a partial product and its bound, as a share of the norms' product."""
    d = len(axes)
    apart = float(np.abs(axes.T @ axes - np.eye(d)).sum()) if d else 0.0
    return 32 * (d + 8) * np.finfo(float).eps + 4 * apart


def survivors(a: Side, r: Side, need: np.ndarray, most: np.ndarray, slack: float, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs whose product is at least the anchor's ``need`` and at most its ``most``:
    bounded after each stage, then scored by whole numbers. ``wanted`` leaves out pairs from the start."""
    none = np.zeros(0, np.int64)
    if not len(a.x) or not len(r.x):
        return none, none, none
    need, most = need.astype(float), most.astype(float)
    total, done, pairs = np.zeros((len(a.x), len(r.x))), 0, None
    open_ = np.ones(total.shape, bool) if wanted is None else wanted
    for k in a.stops:
        if pairs is None:
            total += a.rotated[:, done:k] @ r.rotated[:, done:k].T
            bound = a.rest[k][:, None] * r.rest[k] + slack * a.norm[:, None] * r.norm
            open_ = open_ & (total + bound >= need[:, None]) & (total - bound <= most[:, None])
            if k == a.stops[-1] or open_.mean() < SPARSE:
                pairs = np.nonzero(open_)
                value = total[pairs]
        else:
            i, j = pairs
            value = value + np.einsum("ij,ij->i", a.rotated[i, done:k], r.rotated[j, done:k])
            bound = a.rest[k][i] * r.rest[k][j] + slack * a.norm[i] * r.norm[j]
            keep = (value + bound >= need[i]) & (value - bound <= most[i])
            pairs, value = (i[keep], j[keep]), value[keep]
        done = k
    i, j = pairs if pairs is not None else np.nonzero(open_)
    score = np.einsum("ij,ij->i", a.x[i], r.x[j])
    keep = (score >= need[i]) & (score <= most[i])
    return i[keep], j[keep], score[keep]


def _best(owner: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's first ``k`` by score, then id."""
    order = np.lexsort((ids, -score, owner))
    o = owner[order]
    first = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else np.zeros(0, np.int64)
    rank = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
    return order[rank < k]


def _top(anchors: int, r_ids: np.ndarray, k: int, tiles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, id, score): each anchor's first ``k`` over all tiles. ``tiles`` calls back with what is needed yet."""
    owner, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    need = np.full(anchors, _NONE)
    for search in tiles:
        i, j, s = search(need)
        if not len(i):
            continue
        owner, ids, score = np.append(owner, i), np.append(ids, r_ids[j]), np.append(score, s)
        kept = _best(owner, ids, score, k)
        owner, ids, score = owner[kept], ids[kept], score[kept]
        held = np.bincount(owner, minlength=anchors)
        last = np.full(anchors, np.iinfo(np.int64).max)
        np.minimum.at(last, owner, score)
        need = np.where(held >= k, last, _NONE)
    return owner, ids, score


def positives_of(anchors: pd.DataFrame, rows: pd.DataFrame, axes: np.ndarray, slack: float, k: int) -> pd.DataFrame:
    """anchor_id, positive_id, positive_score: the first ``k`` rows of each anchor's label within the block."""
    a_all, r_all = Side(_matrix(anchors["x"]), axes), Side(_matrix(rows["x"]), axes)
    a_ids, r_ids = anchors["vec_id"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64)
    a_label, r_label = anchors["label"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
    out = []
    for label in np.intersect1d(a_label, r_label):
        of_a, of_r = np.flatnonzero(a_label == label), np.flatnonzero(r_label == label)
        for begin in range(0, len(of_a), TILE_ANCHORS):
            own = of_a[begin : begin + TILE_ANCHORS]
            a, ids = a_all.at(own), a_ids[own]
            far = np.full(len(own), np.iinfo(np.int64).max)

            def tile(start, a=a, ids=ids, of_r=of_r, far=far):
                at = of_r[start : start + TILE_ROWS]

                def search(need):
                    i, j, s = survivors(a, r_all.at(at), need, far, slack, ids[:, None] != r_ids[at])
                    return i, at[j], s

                return search

            owner, found, score = _top(len(own), r_ids, k, (tile(s) for s in range(0, len(of_r), TILE_ROWS)))
            out.append(pd.DataFrame({"anchor_id": ids[owner], "positive_id": found, "positive_score": score}))
    return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []}, dtype=np.int64)


def window_of(positive: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores s with least * positive <= 100 s <= most * positive; empty for negative ones."""
    return -((-least * positive) // 100), (most * positive) // 100


def negatives_of(anchors: pd.DataFrame, rows: pd.DataFrame, axes: np.ndarray, slack: float, k: int, least: int, most: int) -> pd.DataFrame:
    """anchor_id, positive_id, negative_id, negative_score: the first ``k`` rows of other labels in each positive's
    window within the block. ``anchors`` has a row for each of an anchor's ``told`` positives' ids and scores."""
    a_all, r_all = Side(_matrix(anchors["x"]), axes), Side(_matrix(rows["x"]), axes)
    r_ids, r_label, a_label = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)
    a_ids = anchors["vec_id"].to_numpy(np.int64)
    told = [[(int(t["positive_id"]), int(t["positive_score"])) for t in x] for x in anchors["told"]]
    width = max([len(t) for t in told], default=0)
    scores = np.array([[t[p][1] if p < len(t) else -1 for p in range(width)] for t in told], np.int64).reshape(len(told), width)
    ids = np.array([[t[p][0] if p < len(t) else 0 for p in range(width)] for t in told], np.int64).reshape(len(told), width)
    low, high = window_of(scores, least, most)  # a score of -1 stands for none: its window is empty
    out = []
    for begin in range(0, len(a_ids), TILE_ANCHORS):
        own = np.arange(begin, min(begin + TILE_ANCHORS, len(a_ids)))
        a, lo, hi = a_all.at(own), low[own], high[own]
        live = lo <= hi
        floor = np.where(live, lo, np.iinfo(np.int64).max)  # what a window needs yet
        top = np.where(live, hi, _NONE).max(axis=1) if width else np.zeros(len(own), np.int64)
        held = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(width)]
        for start in range(0, len(r_ids), TILE_ROWS if width else len(r_ids) + 1):
            if not width:
                break
            at = np.arange(start, min(start + TILE_ROWS, len(r_ids)))
            i, j, s = survivors(a, r_all.at(at), floor.min(axis=1), top, slack, a_label[own][:, None] != r_label[at])
            for p in range(width):
                fits = (s >= floor[i, p]) & (s <= hi[i, p])
                owner, found, score = (np.append(x, y) for x, y in zip(held[p], (i[fits], r_ids[at[j[fits]]], s[fits]), strict=True))
                kept = _best(owner, found, score, k)
                held[p] = owner, found, score = owner[kept], found[kept], score[kept]
                full = np.bincount(owner, minlength=len(own)) >= k
                last = np.full(len(own), np.iinfo(np.int64).max)
                np.minimum.at(last, owner, score)
                floor[:, p] = np.where(full & live[:, p], last, floor[:, p])
        for p in range(width):
            owner, found, score = held[p]
            out.append(pd.DataFrame({"anchor_id": a_ids[own][owner], "positive_id": ids[own][owner, p], "negative_id": found, "negative_score": score}))
    return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "negative_id": [], "negative_score": []}, dtype=np.int64)


# ---------------------------------------------------------------- over tables


def _in_blocks(anchors: DataFrame, rows: DataFrame, n: int, n_anchors: int, work, schema: str) -> DataFrame:
    """``work`` (anchors, rows) over every pair of a share of anchors and a group of rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-n // GROUP_ROWS), min(4 * cores, -(-n // GROUP_LEAST)), 1)
    shares = max(1, -(-n_anchors // SHARE_ANCHORS))
    place = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    # by number, so that tasks follow the work and aren't gathered by bytes
    left = anchors.withColumn("share", place(1, shares)).withColumn("group", every(groups)).repartition(min(groups * shares, 20_000), "group", "share")
    right = rows.withColumn("group", place(2, groups)).withColumn("share", every(shares)).repartition(min(groups * shares, 20_000), "group", "share")
    return left.groupBy("group", "share").cogroup(right.groupBy("group", "share")).applyInPandas(work, schema)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id (one row each), label, x (whole numbers), as ``quantised`` makes them; ``anchor`` tells
    which are anchors. An anchor's positives are the first ``positives`` other rows of its label by
    product, ties by smaller id; each gets the first ``negatives`` rows of other labels whose product is from
    ``least`` to ``most`` hundredths of its own. Anchors without positives, and positives without such rows, have
    no row; an empty table has none. Vectors of different lengths raise.
    """
    ready(rows.sparkSession)
    rows = checkpoint(rows.select("vec_id", "label", "x"))
    axes = rotation(rows)
    slack = slack_of(axes)
    anchors = rows.filter(anchor)
    n, n_anchors = rows.count(), anchors.count()

    def first(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return positives_of(left, right, axes, slack, positives)

    near = _in_blocks(anchors, rows, n, n_anchors, first, "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id"))
    near = checkpoint(near.withColumn("place", place).filter(F.col("place") <= positives).drop("place"))
    told = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("told"))

    def second(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return negatives_of(left, right, axes, slack, negatives, least, most)

    asked = checkpoint(anchors.join(told, "vec_id"))
    far = _in_blocks(asked, rows, n, n_anchors, second, "anchor_id long, positive_id long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id"))
    far = far.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return far.join(near, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP12_SQL = """
WITH v AS (SELECT vec_id, min((CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT))) AS r FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.r[1] = b.r[1] AS same, list_sum(list_transform(range(1, len(a.r[2]) + 1), lambda i: a.r[2][i] * b.r[2][i]))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""
