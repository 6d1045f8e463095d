import random

from tests.llm.common import SYLLABLES, documents, empty, frame, odd, sentence
from twinsift.llm import language_id as li


def test_held_out_accuracy(spark):
    df = frame(spark, documents(300))
    out = li.learn_and_identify(df).join(df.select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 40 and (held.lang == held.lang_pred).mean() > 0.95
    assert out.score.between(0, 1).all() and not out[out.text.str.len() > 100].rejected.any()


def test_only_the_text_counts(spark):
    model = li.fit(frame(spark, documents(200)))
    rng = random.Random(9)
    texts = [(i, sentence(rng, "de", 60)) for i in range(5)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["lang_pred"] for r in li.identify(df, model).collect()} == {"de"}


def test_foreign_text_is_rejected_and_short_text_isnt(spark):
    model = li.fit(frame(spark, documents(200)))
    assert model.predict("ひらがなとカタカナの文章です " * 20)[2]
    assert not model.predict("then")[2] and not model.predict(sentence(random.Random(1), "fr", 40))[2]
    for text in (None, "", "123 !!", "😀"):
        assert model.predict(text) == ("und", 0.0, True)


def test_odd_and_empty(spark):
    model = li.fit(frame(spark, documents(100)))
    got = [(r["doc_id"], r["lang_pred"]) for r in li.identify(odd(spark), model).collect()]
    assert len(got) == 11 and dict(got)[5001] == "und" and dict(got)[5004] == "und" and dict(got)[5007] in SYLLABLES
    assert li.learn_and_identify(empty(spark)).count() == 0
    none = li.learn_and_identify(frame(spark, [(1, "text", None, "s", 4)])).first()
    assert none["lang_pred"] == "und" and none["score"] == 0


def test_slices_count_as_the_whole(monkeypatch):
    text = "Ein längerer Text, in Stücken gezählt; ein   längerer Text. " * 30
    whole = li.counts(text)
    monkeypatch.setattr(li, "SLICE", 7)
    assert (li.counts(text) == whole).all()
