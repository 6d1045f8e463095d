"""Quality classification by positive-unlabelled learning.

Trusted good documents and unlabelled ones train a small network under the non-negative unbiased
risk (Kiryo et al., 2017): pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)), with
the class prior pi estimated from positives and unlabelled documents alone: no share of the unlabelled
that scores high can hold more positives than rows, which bounds the prior (Garg et al., 2021). The
logistic loss makes the output a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed pairs of characters among the features, hidden units, steps and their size.
PAIRS, HIDDEN, STEPS, RATE = 256, 24, 600, 0.01
#: Positives and unlabelled documents that the network is fitted on, at most about so many.
POSITIVES, UNLABELLED = 6000, 12000
#: Newton steps and ridge of the classifier that the prior is estimated with, and the chance that its bound fails.
FITS, RIDGE, UNSURE = 12, 1e-2, 0.1
#: Code points taken at a time, up to white space; a longer run without any is cut and counts as two words.
SLICE = 1 << 19
CUT = 0.3


def features(text: str | None) -> np.ndarray:
    """Shares of characters (ASCII ones each, others together), classes, hashed pairs, and shape."""
    text = text if isinstance(text, str) else ""
    chars, pairs = np.zeros(129), np.zeros(PAIRS)
    words = lines = upper_words = lone = 0
    i = 0
    while i < len(text):
        part = text[i : i + SLICE]
        if i + SLICE < len(text) and (space := max(part.rfind(s) for s in " \t\n\v\f\r")) >= 0:
            part = part[: space + 1]  # so that no word is cut
        follow = text[i + len(part) : i + len(part) + 1]
        i += len(part)
        c = np.minimum(np.frombuffer((part + follow).encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.int64)
        pairs += np.bincount(((c[:-1] * 131 + c[1:]) * 0x9E3779B1 & 0xFFFFFFFF) * PAIRS >> 32, minlength=PAIRS)
        c = c[: len(part)]
        chars += np.bincount(c, minlength=129)
        space = (c == 32) | ((c >= 9) & (c <= 13))
        starts = np.flatnonzero(~space & np.append(True, space[:-1]))
        ends = np.flatnonzero(~space & np.append(space[1:], True))
        words += len(starts)
        upper = np.append(0, np.cumsum((c >= 65) & (c <= 90)))
        upper_words += int(((upper[ends + 1] - upper[starts] >= 2)).sum())
        lone += int((ends == starts).sum())
        lines += int((c == 10).sum())
    n = max(1.0, chars.sum())
    w = max(1, words)
    digits, upper_, lower = chars[48:58].sum(), chars[65:91].sum(), chars[97:123].sum()
    marks = chars[33:48].sum() + chars[58:65].sum() + chars[91:97].sum() + chars[123:127].sum()
    shape = [np.log1p(n) / 10, np.log1p(words) / 10, n / w / 10, lines / w * 5, upper_words / w, lone / w, digits / n * 5, upper_ / n * 3, lower / n, marks / n * 5, chars[128] / n * 3]
    return np.concatenate([np.sqrt(chars / n) * 2, np.sqrt(pairs / n) * 2, shape]).astype(np.float32)


WIDTH = 129 + PAIRS + 11


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))


def constant(p: float) -> Model:
    """What is used when no positive is known."""
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> Model:
    """Minimises the non-negative risk by Adam over all rows at once; the seed fixes the result."""
    if not len(positive) or not len(unlabelled):
        return constant(prior)
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.02
    x = np.concatenate([positive, unlabelled])
    x = ((x - mean) / scale).astype(np.float32)
    n_p = len(positive)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
    p = [a.astype(np.float32) for a in p]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, STEPS + 1):
        h = np.tanh(x @ p[0] + p[1])
        g = h @ p[2] + p[3]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        # losses: log(1 + exp(-g)) for +, log(1 + exp(g)) for -; their slopes: s - 1 and s
        minus = np.logaddexp(0, g)
        negative = minus[n_p:].mean() - prior * minus[:n_p].mean()
        dg = np.zeros_like(g)
        if negative >= 0:
            dg[:n_p] = (prior * (s[:n_p] - 1) - prior * s[:n_p]) / n_p
            dg[n_p:] = s[n_p:] / (len(g) - n_p)
        else:  # over-fitted there: step back on that part alone
            dg[:n_p] = prior * s[:n_p] / n_p
            dg[n_p:] = -s[n_p:] / (len(g) - n_p)
        dh = np.outer(dg, p[2]) * (1 - h * h)
        grads = [x.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ dg + 1e-4 * p[2], dg.sum(keepdims=True)]
        for a, b, c, d in zip(p, m, v, grads, strict=True):
            b += 0.1 * (d - b)
            c += 0.001 * (d * d - c)
            a -= RATE * (b / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p[0], p[1], p[2], float(p[3][0]))


def _best_bin(p: np.ndarray, u: np.ndarray) -> float:
    """From scores of positives and of unlabelled rows, the share of the unlabelled above a cut by that of the
    positives, at the cut with the best upper bound."""
    p, u = np.sort(p), np.sort(u)
    above_p = 1 - np.searchsorted(p, p, "left") / len(p)
    above_u = 1 - np.searchsorted(u, p, "left") / len(u)
    unsure = np.sqrt(np.log(4 / UNSURE) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    at = np.argmin((above_u + 1.01 * unsure) / above_p)
    return float(np.clip(above_u[at] / above_p[at], 0.01, 0.99))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from positives and unlabelled rows.

    Scores of rows that the scorer wasn't fitted on give a bound. A linear classifier of the two gives the
    first; with that as prior, the network fitted on either half and scoring the other gives better ones.
    """
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    first = _linear_prior(positive, unlabelled)
    halves = [(positive[i::2], unlabelled[i::2]) for i in (0, 1)]
    models = [train(p, u, first) for p, u in halves]
    return float(np.mean([_best_bin(m.score(p), m.score(u)) for m, (p, u) in zip(models, halves[::-1], strict=True)]))


def _linear_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.02
    p, u = [np.column_stack([(a - mean) / scale, np.ones(len(a))]).astype(np.float64) for a in (positive, unlabelled)]
    x = np.concatenate([p[::2], u[::2]])
    y = np.append(np.ones(len(p[::2])), np.zeros(len(u[::2])))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(x.shape[1])
    for _ in range(FITS):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (s - y)) + RIDGE * w
        curve = (x * (weight * s * (1 - s))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return _best_bin(p[1::2] @ w, u[1::2] @ w)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _sample(n: int, most: int, salt: int, *of: str) -> Column:
    return F.pmod(F.xxhash64(*of, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30) < (most / n if n else 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on doc_id, text and labels (doc_id, quality) of rows that aren't held out.

    Labels 1 are the positives; all other documents, whatever their label, are unlabelled, and with
    them the positives that the sample happens to hold. Labels 0 are not read. About POSITIVES and UNLABELLED rows, chosen by a hash of doc_id (and text), reach the driver.
    """
    docs = docs.filter(~held_out()).select("doc_id", "text")
    labels = labels.filter(~held_out()).filter("quality = 1").select("doc_id").distinct()
    make = F.pandas_udf(lambda text: pd.Series([features(t).tobytes() for t in text]), "binary")
    # in an order of their own, so that the fit doesn't depend on that of the files
    load = lambda rows: np.stack([np.frombuffer(b, np.float32) for b in sorted(bytes(r[0]) for r in rows)]) if rows else np.zeros((0, WIDTH), np.float32)
    chosen = labels.filter(_sample(labels.count(), POSITIVES, 1, "doc_id"))
    positive = load(docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(make("text")).collect())
    unlabelled = load(docs.filter(_sample(docs.count(), UNLABELLED, 2, "doc_id", "text")).select(make("text")).collect())
    return train(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to ``carry`` with score and predicted for every whole text.

    A null text counts as empty, and empty texts have a score too. Only the text is used; repeated rows
    give repeated rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(np.stack([features(t) for t in text])) if len(text) else [], dtype=float)

    return docs.select(*carry, run("text").alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` of every row by a network fitted on the rows that aren't held out. A null doc_id isn't held
    out and has no label; without labels of 1 all scores are the same."""
    return score(docs.withColumn("held_out", held_out()), fit(docs, labels), ("doc_id", "held_out"))
