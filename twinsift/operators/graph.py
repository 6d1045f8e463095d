"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.runtime import checkpoint, discard, ready


def _star(edges: DataFrame, large: bool, n: int) -> tuple[DataFrame, DataFrame]:
    """One contraction over ``n`` undirected ``edges`` (u, v), u > v in the input of the small star, and
    the table of smallest neighbours.

    Every node's neighbours are tied to the smallest node of its neighbourhood: those above the
    node (large star) or those below it (small star). The smallest neighbours are written before they
    join the edges, so that both sides of that join are plain shuffles and a hub's edges can be split.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n)
    tied = both.join(low, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return checkpoint(out.filter("u <> v").distinct(), n), low


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every end of an edge; the component is its smallest node.

    Self-loops alone and null ends give no row. The loop ends when a round leaves the edge set
    unchanged, and raises if ``max_rounds`` don't suffice; the driver sees two numbers a round, never a
    link. Each round is checkpointed, and the files of the one before go.
    """
    ready(edges.sparkSession)
    at = checkpoint(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    was = None
    n = at.count()
    for _ in range(max_rounds if n else 0):
        half, low = _star(at, True, n)
        new, low_too = _star(half, False, n)
        discard(at, low, half, low_too)
        at = new
        now = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == was:
            break
        was, n = now, now["n"]
    else:
        if n:
            raise RuntimeError(f"components still changed after {max_rounds} rounds")
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
