import hashlib
import random

import pytest

from tests.llm.common import ODD, documents, empty, frame, odd, sentence
from twinsift.llm import fingerprints as fp


def windows(values, size):
    """Winnowing by the book: the smallest of each window, rightmost on ties."""
    out = []
    for i in range(max(1, len(values) - size + 1)):
        w = values[i : i + size]
        j = i + max(k for k in range(len(w)) if w[k] == min(w))
        if j not in out:
            out.append(j)
    return out


def grams_of(spark, texts):
    """All gram hashes, taken from texts of exactly K words."""
    words = sorted({w for t in texts for w in [" ".join(t.split()[i : i + fp.K]) for i in range(max(1, len(t.split()) - fp.K + 1))]})
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    got = {r["doc_id"]: r["picks"] for r in fp.fingerprint(df).collect()}
    return {w: got[i][0] >> fp.PLACE_BITS for i, w in enumerate(words)}


def test_picks_are_those_of_winnowing(spark):
    rng = random.Random(3)
    texts = [sentence(rng, "en", n) for n in (1, 3, 5, 6, 9, 40)] + ["a b " * 12, "same same same same same same same same same"]
    grams = grams_of(spark, texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fp.with_picks(df, "text", "picks").withColumn("places", fp.places(fp.F.col("picks"))).collect():
        words = r["text"].split()
        values = [grams[" ".join(words[i : i + fp.K])] for i in range(max(1, len(words) - fp.K + 1))]
        assert r["places"] == windows(values, fp.WINDOW)
        assert [p >> fp.PLACE_BITS for p in r["picks"]] == [values[j] for j in r["places"]]


def test_a_shared_passage_leaves_a_shared_pick(spark):
    rng = random.Random(4)
    passage = sentence(rng, "de", fp.K + fp.WINDOW - 1)
    rows = [(i, f"{sentence(rng, 'en', rng.randrange(1, 30))} {passage} {sentence(rng, 'fr', rng.randrange(1, 30))}") for i in range(20)]
    got = fp.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [{p >> fp.PLACE_BITS for p in r["picks"]} for r in got]
    assert all(a & b for a in sets for b in sets)


def expected(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        m = len(text) // 3
        yield i, text, text[: len(text) - m] + after[:m], after


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_edited_texts(spark, partitions):
    rows = [(r[0], r[1]) for r in documents(100)] + [(r[0], r[1]) for r in ODD if r[0] not in (None, 5008)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["doc_id"]: r for r in fp.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    texts = sorted({t for _, a, b, c in expected(rows) for t in (a, b, c)})
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = {texts[r["doc_id"]]: r for r in fp.fingerprint(plain).collect()}
    sets = {t: {p >> fp.PLACE_BITS for p in r["picks"]} for t, r in own.items()}
    assert len(got) == len(rows)
    for i, text, edited, after in expected(rows):
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == own[text]["fingerprint"] and r["edited_fingerprint"] == own[edited]["fingerprint"]
        jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert r["near_edited"] == pytest.approx(jaccard(text, edited)) and r["near_next"] == pytest.approx(jaccard(text, after))
        if len(text) > 300 and i < 5000:
            assert r["near_edited"] > 0.3


def test_odd_and_empty(spark):
    assert fp.compare_edited(odd(spark)).count() == len(ODD)
    assert fp.compare_edited(empty(spark)).count() == 0
    one = fp.compare_edited(frame(spark, [(1, "only this text of six words", "en", "s", 1)])).first()
    assert one["near_next"] == 1.0
