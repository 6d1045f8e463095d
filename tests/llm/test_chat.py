import hashlib
import random

from pyspark.sql import functions as F

from twinsift.llm import chat

TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user", "back\\slash \\\\ <\\|", "<", "|", "<<SYS>> x <</SYS>> <s>", "a<|", "<|im_sep|>\n", "\\", "[/INST", "日本😀\n\n", "$1 \\$"]


def test_escapes_are_undone(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["<", "|", "\\", "[INST]", "</s>", "a", "\n", "<|im_end|>\n"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in chat.CONTROL), r["e"]


def expected(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def conversations():
    rng = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(rng.choice([1, 2, 5, 9, 33])):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "a<|b"]), rng.choice(TEXTS + [None])))
    return rows


def test_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.chat(df)
    got = {r["conv_id"]: r for r in chat.digest(out).collect()}
    full = {r["conv_id"]: r for r in out.collect()}
    for c in range(40):
        turns = [(r, t) for k, _, r, t in sorted(rows, key=lambda x: x[1]) if k == c]
        g, f = got[c], full[c]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == expected(turns)
        assert g["formatted_chars"] == len(f["formatted"])
        assert [f["formatted"][s["start"] : s["end"]] for s in f["loss_spans"]] == [s["text"] for s in f["segments"] if s["loss"]]
        assert "".join(s["text"] for s in f["segments"]) == f["formatted"]
        assert f["formatted"].count(chat.BEGIN) == f["formatted"].count(chat.END) == len(turns)


def test_trees(spark):
    rows = [("r", None, 1.0), ("a", "r", 1.0), ("b", "r", 5.0), ("a1", "a", 9.0), ("a2", "a", 9.0), ("lone", None, 0.0), ("orphan", "gone", None), ("c1", "c2", 1.0), ("c2", "c1", 1.0), ("hang", "c1", 1.0)]
    rows += [(f"n{i}", f"n{i - 1}" if i else None, 0.0) for i in range(70)]
    df = spark.createDataFrame(rows, "id string, parent string, score double")
    paths = {}
    for r in chat.reply_paths(df).collect():
        paths.setdefault((r["branch"], r["leaf"]), {})[r["depth"]] = r["id"]
    got = {k: [v[d] for d in sorted(v)] for k, v in paths.items()}
    assert got == {
        (1, "a1"): ["r", "a", "a1"], (2, "a2"): ["r", "a", "a2"], (3, "b"): ["r", "b"], (1, "lone"): ["lone"], (1, "orphan"): ["orphan"],
        (1, "n69"): [f"n{i}" for i in range(70)],
    }
    best = {r["leaf"] for r in chat.reply_paths(df, branches=1).collect()}
    assert best == {"a1", "lone", "orphan", "n69"}


def test_odd_and_empty(spark):
    df = spark.createDataFrame([(None, 1, "assistant", None), (None, 0, None, "x"), (1, None, "assistant", "t"), (1, None, "assistant", "t")], "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digest(chat.chat(df)).collect()}
    assert got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 0 and got[1]["loss_chars"] == 2
    assert chat.digest(chat.chat(df.limit(0))).count() == 0
