"""Document fingerprints by winnowing.

Grams of K words are hashed, each from the hashes of the shorter grams that it is made of; of every
WINDOW neighbouring grams the smallest hash is picked, the rightmost on ties, and its place is kept
(Schleimer, Wilkerson and Aiken, 2003). So any passage of K + WINDOW - 1 words that two texts share
gives them a common pick. Everything is higher-order functions over one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 5, 4
#: A pick is 36 bits of hash over 27 bits of place, counted down so that the smallest is rightmost.
PLACE_BITS, HASH_BITS = 27, 36
LAST = (1 << PLACE_BITS) - 1
#: Words: runs of letters and digits; ideographs stand alone.
WORD = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"
#: Ranges of doc_id for each shuffle partition, most ranges at all, and ids looked at for each.
RANGES, MOST, LOOKED_AT = 4, 1 << 16, 200


def with_picks(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` and its picks (array of longs) as ``out``. A text without words has one pick, of itself;
    one with fewer than K words has one gram of all of them. Null is empty."""
    w, p, q, g, v, m = (f"_{out}_{x}" for x in "wpqgvm")
    body = F.coalesce(F.col(text), F.lit(""))
    after = lambda name, i, n: F.get(F.col(name), i + n)
    df = df.withColumn(w, F.transform(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(F.lower(x))))
    df = df.withColumn(w, F.when(F.size(w) > 0, F.col(w)).otherwise(F.array(F.xxhash64(body, F.lit(0)))))
    df = df.withColumn(p, F.transform(w, lambda x, i: F.xxhash64(x, after(w, i, 1))))
    df = df.withColumn(q, F.transform(p, lambda x, i: F.xxhash64(x, after(p, i, 2))))
    grams = F.transform(q, lambda x, i: F.xxhash64(x, after(w, i, 4)))
    df = df.withColumn(g, F.slice(grams, F.lit(1), F.greatest(F.size(q) - (K - 1), F.lit(1))))
    packed = lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 64 - HASH_BITS), PLACE_BITS).bitwiseOR(F.lit(LAST) - F.least(i.cast("long"), F.lit(LAST)))
    df = df.withColumn(v, F.transform(g, packed))
    lows = F.transform(v, lambda x, i: F.least(x, *[after(v, i, n) for n in range(1, WINDOW)]))
    df = df.withColumn(m, F.slice(lows, F.lit(1), F.greatest(F.size(v) - (WINDOW - 1), F.lit(1))))
    return df.withColumn(out, F.array_distinct(m)).drop(w, p, q, g, v, m)


def places(picks: Column) -> Column:
    """Places of the picked grams: numbers of their first words."""
    return F.transform(picks, lambda x: F.lit(LAST) - x.bitwiseAND(F.lit(LAST)))


def hashes(picks: Column) -> Column:
    return F.array_distinct(F.transform(picks, lambda x: F.shiftright(x, PLACE_BITS)))


def printed(picks: Column) -> Column:
    """hash@place in order, as one string."""
    one = lambda x: F.concat(F.lower(F.hex(F.shiftright(x, PLACE_BITS))), F.lit("@"), (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("string"))
    return F.array_join(F.transform(picks, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of picked hashes."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, picks and fingerprint of every whole text."""
    return with_picks(docs.select("doc_id", "text"), "text", "picks").select("doc_id", "picks", printed(F.col("picks")).alias("fingerprint"))


def _longs(values: list[int]) -> Column:
    """A constant array, which the optimiser folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _place_of(key: Column, bounds: list[int]) -> Column:
    """How many of ``bounds``, descending, are at least ``key``, less one: a binary search."""
    held = _longs(bounds)
    steps = F.array(*[F.lit(1 << s) for s in range(max(0, len(bounds).bit_length() - 1), -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(held, at + s - 1) >= key), at + s).otherwise(at))
    return at - 1


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, picks and those of the next document by descending doc_id (after the last: the first).

    doc_id is cut to ranges at approximate quantiles, which are ids of the table, of some ids chosen by
    hash (cuts decide which task a text goes to and nothing else); a range's first document also stands
    at the end of the range before. One shuffle moves each text once; the driver gets at most MOST ids. Equal ids are ordered by a hash of the text; a null id is the smallest.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("_key"))
    n = min(MOST, RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = max(1, docs.count() // (LOOKED_AT * n))
    top = docs.agg(F.max("_key").alias("top")).first()["top"]
    ids = docs.filter(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0)
    cuts = ids.agg(F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("cuts")).first()["cuts"]
    bounds = sorted({*(cuts or []), top if top is not None else 0}, reverse=True)
    home = _place_of(F.col("_key"), bounds)
    docs = docs.withColumn("_home", home)
    first = F.get(_longs(bounds), F.col("_home")) == F.col("_key")
    both = F.array(F.struct(F.col("_home").alias("range"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("_home") - 1, F.lit(len(bounds))).alias("range"), F.lit(True).alias("guest")))
    own = F.array(F.struct(F.col("_home").alias("range"), F.lit(False).alias("guest")))
    docs = docs.withColumn("_at", F.explode(F.when(first, both).otherwise(own))).select("doc_id", "text", "_key", "_at.range", "_at.guest")
    docs = with_picks(docs.repartition("range"), "text", "picks")
    order = Window.partitionBy("range").orderBy("guest", F.col("_key").desc(), F.col("doc_id").isNull(), F.xxhash64("text"))
    docs = docs.withColumns({"next_text": F.lead("text").over(order), "next_picks": F.lead("picks").over(order)})
    return docs.filter("not guest").select("doc_id", "text", "picks", "next_text", "next_picks")


def compare_edited(docs: DataFrame) -> DataFrame:
    """The contract's comparison of each text with its edited text and the next one.

    A null text is empty, a null doc_id the smallest. Rows of one doc_id follow each other by a hash of their texts; a
    repeated row has its equal as the next one. A document that is alone is its own next one.
    """
    pairs = with_next(docs).withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars") - cut), F.substr("next_text", F.lit(1), cut))
    pairs = with_picks(pairs.withColumn("edited", edited), "edited", "edited_picks")
    sets = pairs.withColumns({"own": hashes(F.col("picks")), "other": hashes(F.col("edited_picks")), "following": hashes(F.col("next_picks"))})
    return sets.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("picks")).alias("fingerprint"),
        printed(F.col("edited_picks")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
