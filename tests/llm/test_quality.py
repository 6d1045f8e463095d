import random
import zlib

import numpy as np
import pytest

from tests.llm.common import empty, frame, odd, sentence
from twinsift.llm import quality


def corpus(spark, n=500):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = sentence(rng, rng.choice(["en", "de"]), rng.randrange(20, 120))
        docs.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), "en", "s", 0))
        if i % 2:
            labels.append((i, int(good), 0))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = corpus(spark)
    out = quality.learn_and_score(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 30 and (held.predicted == held.quality).mean() > 0.95
    good, bad = held[held.quality == 1].score.values, held[held.quality == 0].score.values
    assert np.mean(good[:, None] > bad[None, :]) > 0.98
    assert out.score.between(0, 1).all()


def test_labels_of_zero_are_not_read(spark):
    docs, labels = corpus(spark, 200)
    ids = [i for i in range(0, 200, 2) if not zlib.crc32(str(i).encode()) % 5 == 0]
    moved = labels.filter("quality = 1").union(spark.createDataFrame([(i, 0, 0) for i in ids], labels.schema))
    a = quality.learn_and_score(docs, labels).orderBy("doc_id").collect()
    assert a == quality.learn_and_score(docs, moved).orderBy("doc_id").collect()
    turned = labels.selectExpr("doc_id", "1 - quality as quality", "toxic")  # what is trusted does matter
    assert a != quality.learn_and_score(docs, turned).orderBy("doc_id").collect()


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_of_a_known_mixture(share):
    rng = np.random.default_rng(3)
    draw = lambda n, good: rng.normal(1.5 if good else -1.5, 1, (n, 6))
    n = int(4000 * share)
    unlabelled = rng.permutation(np.concatenate([draw(n, True), draw(4000 - n, False)]))
    assert abs(quality.estimate_prior(draw(2000, True), unlabelled) - share) < 0.06
    assert quality.estimate_prior(np.zeros((0, 6)), unlabelled) == 0.5


def test_risk_falls_to_that_of_the_best_split():
    """The non-negative risk by its formula, of the fitted network and of scores that know the classes."""
    rng = np.random.default_rng(4)
    good = rng.random(3000) < 0.4
    x = np.where(good[:, None], 1.0, -1.0) + rng.normal(0, 0.5, (3000, 5))
    positive = 1.0 + rng.normal(0, 0.5, (1000, 5))

    def risk(p, u):
        p, u = np.clip(p, 1e-6, 1 - 1e-6), np.clip(u, 1e-6, 1 - 1e-6)
        return 0.4 * -np.log(p).mean() + max(0.0, -np.log(1 - u).mean() - 0.4 * -np.log(1 - p).mean())

    model = quality.train(positive, x, 0.4)
    assert risk(model.score(positive), model.score(x)) < risk(np.full(1000, 0.97), np.where(good, 0.97, 0.03)) + 0.02
    assert ((model.score(x) > 0.5) == good).mean() > 0.98


def test_odd_and_empty(spark):
    docs, labels = corpus(spark, 100)
    model = quality.fit(docs, labels)
    out = {r["doc_id"]: r["score"] for r in quality.score(odd(spark), model).collect()}
    assert out[5001] == out[5002] and all(0 <= s <= 1 for s in out.values())
    assert quality.score(odd(spark), model).count() == 11
    assert quality.learn_and_score(empty(spark), labels.limit(0)).count() == 0
    assert quality.learn_and_score(docs, labels.limit(0)).count() == 100


def test_slices_count_as_the_whole(monkeypatch):
    text = "Some WORDS, and lines\nof text. " * 99
    whole = quality.features(text)
    monkeypatch.setattr(quality, "SLICE", 31 * 3)
    assert np.abs(quality.features(text) - whole).max() < 1e-6
