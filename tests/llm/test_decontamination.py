import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import ODD, documents, empty, frame, odd
from twinsift.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    sets = []
    for i, text in items:
        w = words(text)
        sets.append((i, {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))} if w else set()))
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, own in sets:
            for m in {len(x) for x in own}:
                for k in range(len(w) - m + 1):
                    if tuple(w[k : k + m]) in own:
                        hit |= set(range(k, k + m))
                        ids |= {i} - {None}
        ids = sorted(map(str, ids))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def case(seed=0):
    """Documents of few different words, so that blocks and prefixes of patterns are everywhere."""
    rng = random.Random(seed)
    few = lambda n: " ".join(rng.choice("ab ba É日 Abc x".split()) for _ in range(n))
    items = [(1, few(14)), (1, few(11)), (2, few(30)), (3, "One two"), (4, "x"), (5, None), (6, "!!"), (None, few(12)), (7, few(10)), (8, "ab " * 25)]
    docs = [(i, few(rng.choice([0, 1, 5, 40, 300]))) for i in range(60)]
    for i, (_, text) in enumerate(items * 2):
        if text:
            docs.append((100 + i, few(7) + "\n" + text.upper().replace(" ", ", ") + "." + few(9)))
    docs += [(200, ("ab " * 1500) + few(30)), (201, "one-TWO, one"), (202, None), (202, None), ((1 << 62) + 1, "ab"), (None, "x")]
    return docs, items


@pytest.mark.parametrize("chars", [dc.TABLE_CHARS, 200])
def test_against_plain_search(spark, chars):
    docs, items = case()
    found = dc.contaminated_runs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), table_chars=chars)
    assert sorted(map(tuple, dc.digest(found).collect()), key=repr) == brute(docs, items)


def test_runs_are_the_hit_words(spark):
    docs = [(1, "a b c one two three d one two three four five")]
    items = [(9, "one two three"), (8, "three four five")]
    r = dc.contaminated_runs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).first()
    assert [tuple(s) for s in r["spans"]] == [(3, 6), (7, 12)] and r["items"] == ["8", "9"]


def test_most_positions_are_skipped():
    rng = np.random.default_rng(1)
    held = {tuple(f"w{i}".encode() for i in rng.integers(0, 500, 10)): [n] for n in range(50)}
    p, looked = dc.Patterns(held), []
    was = dc._block
    dc._block = lambda words, at, m: looked.append(len(at)) or was(words, at, m)
    try:
        p.search(rng.integers(0, 100_000, 50_000) * 0)
    finally:
        dc._block = was
    assert sum(looked) < 50_000 / 8


def test_pieces_and_slices_of_long_texts(monkeypatch):
    docs, items = case(3)
    held = {}
    for i, text in items:
        for w in dc.windows_of(dc.words_of(text)):
            held.setdefault(w, []).append(i or 0)
    p = dc.Patterns(held)
    texts = [t.encode() if t else None for _, t in docs]
    want = list(dc._scan_texts(texts, p))
    monkeypatch.setattr(dc, "PIECE", 7)
    monkeypatch.setattr(dc, "CHUNK", 50)
    monkeypatch.setattr(dc, "SLICE", 11)
    assert list(dc._scan_texts(texts, p)) == want
    assert dc.words_of("Ein Wort, das é") == [b"ein", b"wort", b"das", "é".encode()]


def test_odd_and_empty(spark):
    items = spark.createDataFrame([(1, "tie tie tie"), (2, "word"), (3, "n" * 20_000), (4, None)], ITEMS).withColumn("row", F.lit(1)).withColumn("words", F.lit(1))
    got = sorted(map(tuple, dc.digest(dc.contaminated_runs(odd(spark), items)).collect()), key=repr)
    assert got == brute([r[:2] for r in ODD], [(1, "tie tie tie"), (2, "word"), (3, "n" * 20_000)])
    assert dc.contaminated_runs(empty(spark), items).count() == 0
    docs = documents(20)
    none = dc.digest(dc.contaminated_runs(frame(spark, docs), spark.createDataFrame([], ITEMS))).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
