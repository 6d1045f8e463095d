"""Language identification by nearest centroids.

A text is a normalised TF-IDF vector of hashed character 1- to 3-grams. Each language has several
centroids (spherical k-means); a text gets the language of the centroid with the largest cosine, and
is rejected when that cosine stays below what the centroid's own texts reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams.
DIM = 1 << 13
#: Centroids a language, labelled texts a language that they are fitted on (about; chosen by a hash
#: of doc_id), and rounds of k-means.
CENTROIDS, SAMPLE, ROUNDS = 4, 1000, 12
#: A text is rejected below this part of the cosine that 99 % of a centroid's texts reach; with fewer
#: n-grams than WHOLE, which can't come as near, below as much smaller a part.
REJECT, WHOLE = 0.4, 200
#: Code points taken at a time.
SLICE = 1 << 19

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def has_letter(text: str | None) -> bool:
    return isinstance(text, str) and any(letters()[_points(text[i : i + SLICE])].any() for i in range(0, len(text), SLICE))


def counts(text: str | None) -> np.ndarray:
    """Counts of the hashed n-grams; everything but letters is a space, spaces are run together."""
    out = np.zeros(DIM, np.int64)
    if not isinstance(text, str):
        return out
    tail = np.array([32], np.uint32)
    for i in range(0, len(text), SLICE):
        c = _points(text[i : i + SLICE].lower())
        c = np.where(letters()[c], c, np.uint32(32))
        c = np.concatenate([tail[-2:], c])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        c = c[keep]
        old = min(2, len(tail)) if i else 0
        x = c.astype(np.uint64)
        two = x[:-1] * np.uint64(0x9E3779B1) + x[1:]
        three = two[:-1] * np.uint64(0x9E3779B1) + x[2:]
        for n, h in ((1, x[old:]), (2, two[max(0, old - 1) :]), (3, three)):
            if n == 1:
                h = h[h != 32]
            h = (h + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            out += np.bincount((h >> np.uint64(51)).astype(np.int64), minlength=DIM)
        tail = c
    return out


def vector(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the normalised TF-IDF vector."""
    at = np.flatnonzero(count)
    w = (1 + np.log(count[at])) * idf[at]
    norm = np.sqrt(w @ w)
    return at, w / norm if norm else w


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # DIM x centroids
    least: np.ndarray  # cosine below which a centroid rejects

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine and whether it is rejected; ``und`` if there is no letter."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        count = counts(text)
        at, w = vector(count, self.idf)
        cos = w @ self.centroids[at]
        best = int(np.argmax(cos))
        least = self.least[best] * min(1.0, int(count.sum()) / WHOLE)
        return self.langs[best], float(min(1.0, max(0.0, cos[best]))), bool(cos[best] < least)


def cluster(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means, started at the mean's nearest text and then at the farthest ones."""
    k = min(k, len(vectors))
    chosen = [int(np.argmax(vectors @ vectors.mean(0)))]
    while len(chosen) < k:
        chosen.append(int(np.argmin((vectors @ vectors[chosen].T).max(1))))
    centre = vectors[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ centre.T, 1)
        for j in range(k):
            if (own == j).any():
                mean = vectors[own == j].mean(0)
                centre[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return centre


def _crc(docs_id: Column) -> Column:
    return F.crc32(docs_id.cast("string"))


def held_out() -> Column:
    return F.coalesce(_crc(F.col("doc_id")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Fits on doc_id, text, lang; rows with a null text or lang don't count.

    Document frequencies cover all rows; centroids are fitted on about ``sample`` texts a language.
    The driver gets DIM counts and a few centroids a language.
    """
    rows = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in b["text"]:
                df += counts(t) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"at": np.append(at, -1), "n": np.append(df[at], n)})

    got = rows.select("text").mapInPandas(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas().set_index("at")["n"]
    total = int(got.get(-1, 0))
    df = np.zeros(DIM)
    df[got.index[got.index >= 0]] = got[got.index >= 0]
    idf = np.log((1 + total) / (1 + df)) + 1
    n_of = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not n_of:
        return Model(idf, [], np.zeros((DIM, 0)), np.zeros(0))
    share = F.create_map(*[x for lang, n in n_of.items() for x in (F.lit(lang), F.lit(sample / n))])
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(dealt < share[F.col("lang")])

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((len(pdf), DIM), np.float32)
        for i, t in enumerate(pdf["text"]):
            at, w = vector(counts(t), idf)
            m[i, at] = w
        centre = cluster(m, k)
        cos = m @ centre.T
        own = np.argmax(cos, 1)
        least = [float(np.quantile(cos[own == j, j], 0.01)) * REJECT if (own == j).any() else 0.0 for j in range(len(centre))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [c.tobytes() for c in centre.astype(np.float32)], "least": least})

    fitted = chosen.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, least double").toPandas().sort_values(["lang", "least"])
    return Model(idf, list(fitted["lang"]), np.stack([np.frombuffer(c, np.float32) for c in fitted["centroid"]], 1).astype(np.float64), fitted["least"].to_numpy())


def predictor(spark, model: Model):
    """A column function: text -> struct(lang_pred, score, rejected). The model has a fixed size a language."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in text], columns=["lang_pred", "score", "rejected"])

    return predict.asNondeterministic()  # else a filter on the result would predict again


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to ``carry`` with lang_pred, score and rejected for every whole text.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. Nothing but the text is
    used. Repeated rows give repeated rows.
    """
    p = predictor(docs.sparkSession, model)
    return docs.select(*carry, p("text").alias("p")).select(*carry, "p.lang_pred", "p.score", "p.rejected")


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows that aren't held out and predicts all."""
    model = fit(docs.filter(~held_out()))
    out = identify(docs.withColumn("held_out", held_out()), model, ("doc_id", "held_out"))
    return out
