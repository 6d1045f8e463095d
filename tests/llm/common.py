"""Small documents: words of four invented languages, copies, nulls, ties, columns with clashing names."""

import random

SYLLABLES = {
    "en": "th an in er on re ed nd ha at en es of or nt ea ti to it st".split(),
    "de": "en er ch de ei un ie in ge st ne be es au re he an te ie sch".split(),
    "fr": "es en le de re nt on er ou ai an me qu ue la et tr ion eau eux".split(),
}
LONG = "documents doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def documents(n=120, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = sentence(rng, lang, rng.choice([3, 30, 80, 200])) + "."
        rows.append([i, text, lang, f"src{i % 5}", len(text)])
    for i in range(0, n, 10):  # exact copies but for white space, and near copies
        rows.append([1000 + i, rows[i][1].replace(" ", "  ") + "\n", rows[i][2], "src1", 0])
        words = rows[i][1].split()
        if len(words) > 60:
            words[len(words) // 2] = "edited"
            rows.append([2000 + i, " ".join(words), rows[i][2], "src0", 0])
    return [tuple(r) for r in rows]


ODD = [
    (5001, None, "en", None, None),
    (5002, "", None, None, 0),
    (5003, " \n\t", "en", "src1", 3),
    (5004, "!!! *** 123 😀", "en", "src2", 14),
    (5005, "x", "fr", None, 1),
    (5006, "日本語のテキスト、これは長い文ではない。", None, "src3", 20),
    (5007, "word " * 30_000, "en", "src4", 150_000),
    (5008, "tie tie tie", "de", "src4", 11),
    (5008, "tie tie tie", "de", "src4", 11),
    (None, "no id here at all", "en", "src4", 17),
    (5009, "n" * 20_000, "en", "src4", 20_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "row long, node binary, label string, mark string, key string, size long, part int, digest string, n long, copies int, p string, quality int, target double, rejected boolean, score double"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def odd(spark):
    """The odd rows with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = frame(spark, ODD)
    for c in CLASHING.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def empty(spark):
    return frame(spark, [])
