import hashlib
import math
import random
import re

import pytest

from tests.llm.common import empty, odd
from twinsift.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]():
                out.append((kind, m.start(), m.end()))
    return out


CASES = [
    None,
    "",
    "a@b.c a@b.c_d@e.f é😀 x@y.zz, a@b a@.b a@b..c @b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 0.0.0.0",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111",
    "+1 (555) 123-4567 +12 +1 ( ) 2 +49 30 1234567890123",
    "日本 +1 555 123 45678 4111 1111 1111 1111 me@x.org 10.0.0.1",
    "9" * 5000 + " " + "1." * 3000 + "a" * 5000 + "@x.y",
]


def test_base_spans_agree_with_plain_search(spark):
    rng = random.Random(3)
    alphabet = "0123456789" * 2 + ".@+- ()ab_%é😀\n"
    texts = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.detect(docs)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base(text))
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), text
        assert got[i]["spans"].startswith(told)


def test_many_matches_in_one_text(spark):
    text = "x@y.z " * 3000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.digest(pii.detect(docs)).first()
    assert row["n_email"] == 3000
    assert row["spans"] == ",".join(f"email:{6 * i}:{6 * i + 5}" for i in range(3000))


def test_terms_that_disclose_an_entity(spark):
    rows = [(i, f"note {i}\nZorblatt wrote from boss@corp.example about topic{i} with that\nend") for i in range(4)]
    rows += [(100 + i, f"that is plain text number {i} with words") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.detect(docs)
    got = {r["doc_id"]: r for r in found.collect()}
    values = {s["value"] for s in got[0]["term"]}
    assert "Zorblatt" in values and "that" not in values and "with" not in values
    assert not any(got[100 + i]["term"] for i in range(60))
    clean = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(found).collect()}
    assert "boss@corp.example" not in clean[0] and "[EMAIL]" in clean[0] and "Zorblatt" not in clean[0]
    assert clean[100] == rows[4][1]
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(found).collect()}
    start = rows[0][1].index("Zorblatt")
    assert f"term:{start}:{start + 8}" in spans[0]


def test_copies_of_a_line_prove_nothing(spark):
    rows = [(i, "Zorblatt wrote from boss@corp.example") for i in range(5)] + [(9, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not any(r["term"] for r in pii.detect(docs).collect())


def test_one_sighting_proves_nothing_and_a_second_does(spark):
    rows = [(1, "Li Zorblatt lives in plain words\nreach: boss@corp.example\nqwer end")]
    rows += [(100 + i, f"plain words reach the end of lives in text {i % 7}") for i in range(1499)]
    alone = [(50, "what did Zorblatt and Li say of text 3")]
    got = pii.detect(spark.createDataFrame(rows + alone, "doc_id long, text string")).collect()
    assert not any(r["term"] for r in got)
    second = [(2, "boss@corp.example is where to write to Li ZORBLATT in words\nasdf")]
    found = pii.detect(spark.createDataFrame(rows + alone + second, "doc_id long, text string"))
    got = {r["doc_id"]: [s["value"] for s in r["term"]] for r in found.collect()}
    # the name goes beside its entity and alone; words seen once with it stay
    assert got.pop(1) == ["Li", "Zorblatt"] and got.pop(2) == ["Li", "ZORBLATT"] and got.pop(50) == ["Zorblatt", "Li"]
    assert not any(got.values())
    clean = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(found).collect()}
    assert clean[1] == "[NAME] [NAME] lives in plain words\nreach: [EMAIL]\nqwer end"
    assert clean[50] == "what did [NAME] and [NAME] say of text 3"


def plain_disclosures(texts, generalise, left_out):
    """term -> the most it discloses, counted pair by pair."""
    held, free = {}, []
    for text in texts:
        values = [text[a:b] for _, a, b in base(text)]
        bare = text
        for v in sorted(set(values), key=lambda v: (len(v), v), reverse=True):
            bare = bare.replace(v, " ")
        words = {w.lower() for w in re.findall(r"[^\W_]+", bare)}
        names = {v.lower() if "@" in v else re.sub("[^0-9.]", "", v) for v in values}
        if names:
            held[text] = (names, words)
        else:
            free.append(words)
    n, out = len(held) + len(free), {}
    everything = [w for _, w in held.values()] + free
    for e in {e for names, _ in held.values() for e in names}:
        n_e = sum(e in names for names, _ in held.values())
        p = n_e / n
        for t in {t for names, words in held.values() if e in names for t in words}:
            n_et = sum(e in names and t in words for names, words in held.values())
            n_t = sum(t in words for words in everything)
            if n_et <= left_out:
                continue
            share = 1 - math.log((n_et - left_out + pii.SMOOTHING * p) / (n_t - left_out + pii.SMOOTHING)) / math.log(p) if p < 1 else 0.0
            if share >= generalise:
                out[t] = max(share, out.get(t, 0))
    return out


@pytest.mark.parametrize(("generalise", "left_out"), [(0.75, 1), (0.4, 1), (0.75, 0)])
def test_disclosures_agree_with_plain_counting(spark, generalise, left_out):
    rng = random.Random(11)
    words = [f"w{i}é" for i in range(60)] + [f"Q{i}" for i in range(200)]
    weights = [8] * 60 + [1] * 200
    entities = [f"p{i}@x{i % 4}.org" for i in range(12)] + [f"10.0.0.{i}" for i in range(8)]
    friends = {e: rng.sample(words[60:], 2) for e in entities}
    texts = []
    for _ in range(250):
        text = rng.choices(words, weights, k=rng.randrange(1, 25))
        for e in rng.sample(entities, rng.choice([0, 0, 0, 1, 2])):
            text += [e, *friends[e][: rng.randrange(3)]]
        rng.shuffle(text)
        texts += [" ".join(text)] * rng.choice([1, 1, 1, 4])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    based = pii.with_base(docs).cache()
    got = {r["term"]: r["disclosed"] for r in pii.disclosing_terms(based, pii.holders(based), generalise, left_out).collect()}
    want = plain_disclosures(texts, generalise, left_out)
    assert want and got.keys() == want.keys()
    assert all(abs(got[t] - want[t]) < 1e-9 for t in want)
    for row in pii.detect(docs, generalise, left_out).collect():
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", row["text"]) if m[0].lower() in want]
        assert [(s["start"], s["end"]) for s in row["term"]] == spans


def test_pages_of_many_numbers_and_words(spark):
    numbers = " ".join(f"10.{i // 250}.{i % 250}.7" for i in range(2000))
    words = " ".join(f"word{i}x" for i in range(4000))
    rows = [(i, f"{numbers} {words} page{i}") for i in range(2)] + [(10 + i, "plain text") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.detect(docs, 0.5)).collect()}
    assert got[0]["n_ip"] == 2000 and got[0]["n_term"] == got[1]["n_term"] == 4000 and got[10]["n_term"] == 0


def test_sanitised_text_of_many_spans(spark):
    text = "".join(f"a{i}@x.org, {i} " for i in range(1000))
    docs = spark.createDataFrame([(1, text), (2, "no spans"), (3, None)], "doc_id long, text string")
    found = pii.detect(docs)
    clean = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(found).collect()}
    assert clean == {1: "".join(f"[EMAIL], {i} " for i in range(1000)), 2: "no spans", 3: ""}
    digests = {r["doc_id"]: r["sanitised_sha256"] for r in pii.digest(found).collect()}
    assert digests == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items()}


def test_odd_and_empty(spark):
    rows = odd(spark)
    got = pii.digest(pii.detect(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in rows.collect())
    assert all(r["spans"] == "" and r["n_term"] == 0 for r in got)
    assert {r["sanitised_sha256"] for r in got if r["doc_id"] in (5001, 5002)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.digest(pii.detect(empty(spark))).collect() == []


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, entities string, told int")
    assert pii.digest(pii.detect(docs)).count() == 0
