"""Embedding whitening: principal components by block Lanczos, without the covariance matrix.

Vectors are lists of whole numbers (``quantised``). Their counts and sums are exact, and x - S/n is rounded once:
with S = q n + r, it is (x - q) - r/n. A pass over the table multiplies the centred vectors' covariance with a
block of BLOCK directions: each task returns a row for each dimension, and Spark adds them up. The basis grows by
the part of each product that is new, orthogonalised twice against all of the basis. A block that brings
less is filled up with fresh random directions (restart on breakdown). After each pass the Ritz pairs of the
basis are known, and the search ends when the residuals of those wanted are below TOLERANCE times the
largest eigenvalue, or the basis spans all dimensions. The driver holds the basis: the number of dimensions squared
at most, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.runtime import checkpoint, ready

COMPONENTS, BLOCK = 8, 16
#: Residual of an eigenpair, as a share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Eigenvalues below this share of the largest are rounding; such components can't be whitened.
FLAT = 1e-12
SCALE, OFFSET = 1024, 100_000


class Fit(NamedTuple):
    """Count, centre (``whole`` + ``part``/n), components (columns), eigenvalues, exact trace."""

    n: int
    whole: np.ndarray
    part: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int


def quantised(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id and x, whole numbers floor(scale * c) + offset, of rows whose vector is neither null nor holds null or
    non-finite entries. Entries that leave 2 ** 27 either way (131072 at this scale) raise, as their squares would not add up in longs."""
    c = F.col(vector)
    usable = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = lambda v: F.floor(v.cast("double") * scale) + offset
    checked = lambda v: F.when(F.abs(v.cast("double")) * scale < float(1 << 27), whole(v)).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long"))
    return rows.filter(usable).select("vec_id", F.transform(c, checked).alias("x"))


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), np.int64).reshape(len(x), -1)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Count and exact sums by dimension; raises if vectors differ in length."""
    found = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).limit(2).collect()
    if len(found) > 1:
        raise ValueError("vectors differ in length")
    if not found:
        return 0, []
    if not found[0]["d"]:
        return found[0]["n"], []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | int = 0
        for b in batches:
            total = total + _matrix(b["x"]).sum(axis=0)
        if not isinstance(total, int):
            yield pd.DataFrame({"i": range(len(total)), "s": total})

    sums = rows.select("x").mapInPandas(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    at = {r["i"]: int(r["s"]) for r in sums}
    return found[0]["n"], [at[i] for i in range(found[0]["d"])]


def centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    return (x - fit.whole) - fit.part / fit.n


def _added(parts: DataFrame, names: list[str], d: int) -> np.ndarray:
    """The rows (i, values) of all tasks, added up by i: d x len(names) numbers."""
    out = np.zeros((d, len(names)))
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["i"]] = [r[c] for c in names]
    return out


def _multiplied(rows: DataFrame, fit: Fit, v: np.ndarray) -> np.ndarray:
    """The covariance times ``v``, in one pass."""
    names = [f"c{j}" for j in range(v.shape[1])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(v.shape)
        for b in batches:
            c = centred(_matrix(b["x"]), fit)
            total += c.T @ (c @ v)
        if total.any():
            yield pd.DataFrame(total, columns=names).assign(i=range(len(total)))[["i", *names]]

    parts = rows.select("x").mapInPandas(run, ", ".join(["i int", *[f"{c} double" for c in names]]))
    return _added(parts, names, len(v)) / fit.n


def _orthogonal(new: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator, most: int) -> np.ndarray:
    """Up to ``most`` unit directions orthogonal to ``basis``: those of ``new`` first, and fresh random ones
    where ``new`` has no more to give."""
    out = basis
    queue = [new[:, j] for j in range(new.shape[1])]
    while out.shape[1] - basis.shape[1] < min(most, len(basis) - basis.shape[1]):
        fresh = not queue
        x = rng.standard_normal(len(basis)) if fresh else queue.pop(0)
        least = 1e-8 if fresh else 1e-10 * scale
        for _ in range(2):
            x = x - out @ (out.T @ x)
        if (size := float(np.linalg.norm(x))) <= least:
            continue
        x = x / size
        x = x - out @ (out.T @ x)
        out = np.column_stack([out, x / np.linalg.norm(x)])
    return out[:, basis.shape[1] :]


def fit(rows: DataFrame, k: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE) -> Fit:
    """Count, centre, and up to ``k`` components of ``rows`` (x): fewer where fewer have a variance."""
    n, sums = _sums(rows)
    d = len(sums)
    whole, part = [s // n for s in sums] if n else [], [s % n for s in sums] if n else []
    out = Fit(n, np.array(whole, np.int64), np.array(part, float), np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    if not d:
        return out
    a, b = _squares(rows, whole, part)
    # the sum of all deviations, exact, over n ** 3
    trace = (n * n * a - 2 * n * b + n * sum(r * r for r in part)) / n**3
    if not trace:
        return out._replace(trace=trace)
    rng = np.random.default_rng(7)
    basis, image, passes = np.zeros((d, 0)), np.zeros((d, 0)), 0
    new = _orthogonal(rng.standard_normal((d, block)), basis, 1.0, rng, block)
    while True:
        product = _multiplied(rows, out, new)
        passes += 1
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product])
        inner = basis.T @ image
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values, kind="stable")[: min(k, basis.shape[1])]
        values, vectors = values[order], vectors[:, order]
        residual = np.linalg.norm(image @ vectors - (basis @ vectors) * values, axis=0)
        full = basis.shape[1] == d
        if full or (len(values) == k and residual.max() <= tolerance * values[0]):
            break
        new = _orthogonal(product, basis, values[0], rng, block)
    found = basis @ vectors
    kept = values > FLAT * values[0]
    found, values = found[:, kept], values[kept]
    sign = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return out._replace(components=found * sign, eigenvalues=values, trace=trace, passes=passes)


def _squares(rows: DataFrame, whole: list[int], part: list[int]) -> tuple[int, int]:
    """Exact sums over all rows of ``a`` and ``b`` of each (see ``_exact``)."""
    r = rows.select(*_exact(whole, part)).agg(F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")).first()
    return int(r["a"] or 0), int(r["b"] or 0)


def _exact(whole: list[int], part: list[int]):
    """With y = x - whole: a, the sum of y ** 2, and b, the sum of part * y. The sum of (n x - S) ** 2 is then
    n ** 2 a - 2 n b + the sum of part ** 2."""
    y = F.zip_with("x", F.array(*[F.lit(w).cast("long") for w in whole]), lambda x, w: x - w)
    a = F.aggregate(y, F.lit(0).cast("long"), lambda s, v: s + v * v)
    b = F.aggregate(F.zip_with(y, F.array(*[F.lit(r).cast("long") for r in part]), lambda v, r: v * r), F.lit(0).cast("long"), lambda s, v: s + v)
    return a.alias("a"), b.alias("b")


def project(rows: DataFrame, model: Fit) -> DataFrame:
    """vec_id, ``a`` and ``b`` (see ``_exact``) and ``w``, an array of the whitened vector's entries by component."""
    scaled = model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["vec_id", "a", "b"]].assign(w=list(centred(_matrix(b["x"]), model) @ scaled))

    # ids as text: pandas would turn whole numbers beside nulls to floats
    named = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x", *_exact(model.whole.tolist(), [int(r) for r in model.part]))
    return named.mapInPandas(run, "vec_id string, a long, b long, w array<double>").withColumn("vec_id", F.col("vec_id").cast("long"))


def identity_error(projected: DataFrame, n: int, k: int) -> float:
    """Largest entry of the covariance of ``w`` minus the identity."""
    names = [f"c{j}" for j in range(k + 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k + 1))
        for b in batches:
            w = np.array(b["w"].tolist(), float).reshape(-1, k)
            total += w.T @ np.column_stack([w, np.ones(len(w))])
        yield pd.DataFrame(total, columns=names).assign(i=range(k))[["i", *names]]

    sums = _added(projected.select("w").mapInPandas(run, ", ".join(["i int", *[f"{c} double" for c in names]])), names, k) / n
    mean = sums[:, k]  # of the order of rounding, as vectors were centred before
    return float(np.abs(sums[:, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, k: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """A row for each of ``rows`` (vec_id, x) and component: vec_id, component, n, deviation (decimal, exact),
    whitened, explained, identity_error.

    Null ids and repeated rows are rows like others. Components without variance (a single vector, equal
    vectors, fewer dimensions than ``k``) have no rows, and so has an empty table. Vectors of different lengths raise.
    """
    ready(rows.sparkSession)
    rows = checkpoint(rows.select("vec_id", "x"))
    model = fit(rows, k, block)
    held = len(model.eigenvalues)
    n, part = model.n, [int(r) for r in model.part]
    if not held:
        empty = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], empty)
    done = checkpoint(project(rows, model))
    error = identity_error(done, n, held)
    big = lambda c: F.lit(str(c)).cast("decimal(38,0)")
    deviation = F.col("a").cast("decimal(19,0)") * big(n * n) - F.col("b").cast("decimal(19,0)") * big(2 * n) + big(sum(r * r for r in part))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues])
    each = done.select("vec_id", deviation.cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns; raises where an exact deviation doesn't fit a long."""
    return found.withColumn("deviation", F.col("deviation").cast("long"))
