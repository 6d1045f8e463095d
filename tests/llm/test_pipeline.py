import corpus_pipeline as cp
from tests.llm.common import documents, empty, frame, odd, sentence
from tests.llm.test_near_dups import brute as near
from twinsift.llm import language_id


def test_each_stage_on_its_own_input(spark):
    import random

    rng = random.Random(3)
    rows = documents(160) + [(9000, "ひらがなとカタカナの文章です " * 20, None, "src0", 0), (9001, sentence(rng, "en", 90), None, "src0", 0), (9002, "12 !!", "en", "src1", 5)]
    docs = frame(spark, rows)
    stages = dict(cp.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]

    kept = stages["language_id"](spark, docs, "")
    assert tuple(kept.columns) == cp.COLUMNS
    ids = {r["doc_id"]: r["lang"] for r in kept.collect()}
    assert {r[0] for r in rows} - set(ids) == {9000, 9002} and ids[9001] == "en"

    exact = stages["exact_dedup"](spark, docs, "")
    assert tuple(exact.columns) == cp.COLUMNS
    want = {}
    for i, text, *_ in rows:
        k = "".join(text.split())
        if k not in want or (-len(text), i) < want[k]:
            want[k] = (-len(text), i)
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(i for _, i in want.values())

    single = stages["near_dedup"](spark, docs, "")
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(near([(r[0], r[1]) for r in rows]).values()))

    mixed = stages["mixing"](spark, docs, "")
    assert tuple(mixed.columns) == cp.COLUMNS
    from twinsift.llm import mixing

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    counts = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {i: c for i, c in copies.items() if c}

    tokens = stages["bpe"](spark, docs, "")
    assert tokens.count() == len(rows)


def test_run(spark, tmp_path):
    frame(spark, documents(80)).write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_odd_and_empty(spark):
    for _, stage in cp.STAGES:
        stage(spark, odd(spark), "").collect()
        assert stage(spark, empty(spark), "").count() == 0
    repeated = frame(spark, [(1, "same text of words", "en", "s", 1)] * 3)
    assert dict(cp.STAGES)["exact_dedup"](spark, repeated, "").count() == 1
    assert dict(cp.STAGES)["near_dedup"](spark, repeated, "").count() == 1
    assert language_id.fit(empty(spark)).langs == []
