"""Exact set-similarity self-join within groups, by prefix index (after PPJoin, Xiao et al., 2011).

Tokens stand in one order for all, the rarest first. Two sets whose Jaccard similarity reaches t share
at least a number of tokens that follows from their sizes, so they have a token in common among their first few:
of the smaller set, |x| - ceil(2 t / (1 + t) |x|) + 1 tokens go into the index, of the larger one,
|y| - ceil(t |y|) + 1 look for them. A pair is made at its first such token alone, if sizes fit and
enough tokens can follow, and is verified by its whole sets. Common tokens stand last and are seldom looked for, so a group of
any size costs what its near sets and rare tokens do. Nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions import kernels
from twinsift.runtime import checkpoint

_EPS = 1e-9  # shares of whole numbers, such as 0.8 * 5, are to count as whole


def similar_sets(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(a, b, score), a < b, of ids whose tokens' similarity reaches ``threshold`` (over 0) in a common group.

    ``rows``: keys, id, tokens (distinct). Rows of a group with the same tokens are a class: its smallest id stands
    for it, and is linked to each of the others with a score of 1, so copies aren't made into pairs. Empty and
    null token sets, and null keys, have no links. A pair that several groups hold comes once.
    """
    if not threshold > 0:
        raise ValueError("the threshold must exceed 0")
    members = checkpoint(rows.filter(F.size("tokens") > 0).select(*keys, "id", F.array_sort("tokens").alias("tokens")))
    classes = checkpoint(members.groupBy(*keys, "tokens").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    copies = members.join(classes.filter("n > 1"), [*keys, "tokens"]).filter("id > rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    held = classes.select("tokens").distinct().select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("held"))
    ranked = classes.select(*keys, "rep", F.explode("tokens").alias("token")).join(held, "token")
    order = F.transform(F.sort_array(F.collect_list(F.struct("held", "token"))), lambda x: x["token"])
    sets = checkpoint(ranked.groupBy(*keys, "rep").agg(order.alias("t")).withColumn("size", F.size("t")))
    t = threshold
    at_least = lambda share, size: F.ceil(F.lit(share) * size - _EPS).cast("int")
    indexed = sets.withColumn("first", F.col("size") - at_least(2 * t / (1 + t), F.col("size")) + 1)
    looking = sets.withColumn("first", F.col("size") - at_least(t, F.col("size")) + 1)

    def opened(df: DataFrame, side: str) -> DataFrame:
        each = df.select(*keys, "rep", "t", "size", "first", F.posexplode(F.slice("t", F.lit(1), F.greatest("first", F.lit(0)))).alias("at", "token"))
        return each.select(*keys, "token", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "t", "size", "first", "at")])

    met = opened(indexed, "x").join(opened(looking, "y"), [*keys, "token"])
    smaller = F.struct("size_x", "rep_x") < F.struct("size_y", "rep_y")
    needed = at_least(t / (1 + t), F.col("size_x") + F.col("size_y"))
    fits = smaller & (F.col("size_x") >= at_least(t, F.col("size_y"))) & (1 + F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y")) - 1 >= needed)
    before = ~F.arrays_overlap(F.slice("t_x", F.lit(1), F.col("at_x")), F.slice("t_y", F.lit(1), F.col("at_y")))
    pairs = met.filter(fits).filter(before).withColumn("score", kernels.jaccard("t_x", "t_y")).filter(F.col("score") >= threshold)
    links = pairs.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b"), "score")
    return links.unionByName(copies).dropDuplicates(["a", "b"])
