"""Chat formatting from reply trees.

Messages point at the message that they answer. Self-joins over the 1, 2, 4, ... steps towards the
root list each leaf's path, so their number grows with the logarithm of the depth; a tree's paths
rank by score, and each one chosen becomes a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.runtime import checkpoint, keep, table

BEGIN, MID, END = "<|im_start|>", "<|im_sep|>\n", "<|im_end|>\n"
#: Control strings of chat templates that a text must not hold as they are; a backslash goes behind
#: the first character, and backslashes are doubled.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = r"(<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\]))"
#: The roles whose texts are learned.
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees: leaf, branch (rank in its tree, from 1), depth (root: 0), id.

    ``messages``: id, parent (null: a root), score. The ids are distinct. A tree's branches rank by the
    sum of the scores along the path, then by leaf; ``branches`` keeps the best so many (all by
    default). A parent that doesn't exist counts as none; messages on a cycle, and what hangs on one,
    reach no root and so are on no path. A null score counts 0.
    """
    m = messages.select("id", "parent", F.coalesce("score", F.lit(0)).cast("double").alias("score"))
    known = m.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    m = checkpoint(m.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"))
    n = m.count()
    paths = m.join(m.select(F.col("parent").alias("id")), "id", "left_anti").select(F.col("id").alias("leaf"), "id", F.lit(0).alias("steps"))
    jump = m.filter("parent is not null").select("id", F.col("parent").alias("up"))  # 2 ** j steps up
    j = 0
    while 1 << j <= n:
        jump = checkpoint(jump, n)
        if jump.isEmpty():
            break
        above = paths.join(jump, "id").select("leaf", F.col("up").alias("id"), (F.col("steps") + (1 << j)).alias("steps"))
        paths = checkpoint(paths.unionByName(above), 2 * n)
        jump = jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up"))
        j += 1
    scored = paths.join(m, "id").groupBy("leaf").agg(F.sum("score").alias("score"), F.max("steps").alias("depth"), F.max(F.when(F.col("parent").isNull(), F.col("id"))).alias("root"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col("score").desc(), "leaf"))
    chosen = scored.filter("root is not null").withColumn("branch", rank)
    chosen = chosen if branches is None else chosen.filter(F.col("branch") <= branches)
    return paths.join(chosen.select("leaf", "branch", F.col("depth").alias("most")), "leaf").select("leaf", "branch", (F.col("most") - F.col("steps")).alias("depth"), "id")


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per path: leaf, branch, formatted, segments, loss_spans.

    ``messages``: id, role, text (nulls: empty). ``segments`` (text, loss) concatenate to
    ``formatted``; those with ``loss`` are what the loss mask covers, ``loss_spans`` (start, end) are
    the same in code points of ``formatted``.
    """
    role, text = F.coalesce("role", F.lit("")), escape(F.col("text"))
    turns = paths.join(messages.select("id", "role", "text"), "id").select(
        "leaf", "branch", "depth",
        F.concat(F.lit(BEGIN), escape(role), F.lit(MID)).alias("head"), text.alias("body"), role.isin(*LEARNED).alias("loss"),
    )
    before = Window.partitionBy("leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start)
    rows = turns.groupBy("leaf", "branch").agg(F.sort_array(F.collect_list(F.struct("depth", "head", "body", "loss", "start"))).alias("t"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("t", lambda x: F.array(segment(x["head"], F.lit(False)), segment(x["body"], x["loss"]), segment(F.lit(END), F.lit(False)))))
    spans = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["body"])).alias("end")))
    return rows.select("leaf", "branch", segments.alias("segments"), spans.alias("loss_spans")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    plain = lambda x: unescape(x)
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    halves = F.transform(turns, lambda x: F.split(F.substr(x, F.lit(len(BEGIN) + 1)), r"<\|im_sep\|>\n"))
    return F.transform(halves, lambda h: F.struct(plain(h[0]).alias("role"), plain(h[1]).alias("text")))


def conversations_with_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` and the contract's conversation -1."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(probe)


def chat(rows: DataFrame) -> DataFrame:
    """Each conversation (conv_id, turn, role, text) as a tree of one branch: conv_id, formatted,
    segments, loss_spans. Rows follow one another by turn (null first), ties by role and text; a null
    conv_id is a conversation too."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), n.cast("string"))
    rows = keep(rows.select("conv_id", "role", "text", at.alias("n")))
    messages = rows.select(name(F.col("n")).alias("id"), F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent"), F.lit(0.0).alias("score"))
    paths = reply_paths(messages)
    out = format_paths(paths, rows.select(name(F.col("n")).alias("id"), "role", "text"))
    conv = F.regexp_extract("leaf", "^(.*):", 1)
    return out.select(F.when(conv != "none", conv.cast("long")).alias("conv_id"), "formatted", "segments", "loss_spans")


def digest(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the output of ``chat``."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"""regexp_replace(replace(coalesce({0}, ''), '\', '\\'), '<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>', '', 'g')"""
_HITS = r"""len(regexp_extract_all(coalesce({0}, ''), '<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))"""


def op8_sql() -> str:
    """DuckDB: a control string costs one character more, a backslash too."""
    more = lambda c: f"length(coalesce({c}, '')) + (length(coalesce({c}, '')) - length(replace(coalesce({c}, ''), '\\', ''))) + {_HITS.format(c)}"
    return rf"""
    WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i))
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum({len(BEGIN) + len(MID) + len(END)} + {more("role")} + {more("text")})::BIGINT AS formatted_chars
    FROM rows_ GROUP BY conv_id
    """
