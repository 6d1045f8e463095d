"""Mixing sources to target weights by entropy balancing.

The rates r of the documents minimise their relative entropy to 1 under one token constraint a
source, sum(size * r) = target, and 0 <= r <= CAP. The dual has one variable a source, and its
solution is r = min(CAP, exp(lambda * size / mean size)). Newton steps on the dual run over counts of
(source, size), which is all that the rates depend on; rates become whole copies along each source's
sizes so that what one size loses its neighbours gain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.runtime import checkpoint, keep

#: Most copies of a document, and so most of a source's target over its size.
CAP = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: Parts that each (source, size) is dealt to for ranking.
PARTS = 64
#: Newton ends at this relative error, or after so many steps.
TOLERANCE, STEPS = 1e-6, 40
#: Rounds that bring what is left after rounding towards nought.
FIXES = 4


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``target`` for a table with a row for each source (source, source_size).

    Water filling: a target is the smaller of cap * source_size and level * weight, with the level
    at which they add up to all sizes. The windows run over the sources, of which there are few.
    """
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights))
    t = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    upto = every.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("place", F.row_number().over(upto)).withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    right = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("place", "level"))
    t = t.withColumn("at", F.min(right).over(every)["level"])
    return t.withColumn("target", F.coalesce(F.least(F.col("most"), F.col("at") * F.col("weight")), F.col("most")))


def _solve(sizes: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """lam for each key. sizes: key, size, n; sources: key, source_size, n_docs, target."""
    inf = F.lit(float("inf"))
    mean = F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1e-9))
    share = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    fixed = F.when(F.col("source_size") == 0, 0.0).when(share >= cap * (1 - 1e-9), inf)
    state = sources.select("key", "target", mean.alias("mean"), F.coalesce(fixed, F.log(share)).alias("lam"), (-inf).alias("lo"), inf.alias("hi"), fixed.isNotNull().alias("done"))
    n = sources.count()
    state = checkpoint(state, n)
    exact_sum = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")  # noqa: E731  the same in any order, so reruns agree
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        words = F.col("n") * F.col("size")
        got = sizes.join(state.filter("not done"), "key").groupBy("key").agg(
            exact_sum(words * F.least(rate, F.lit(float(cap)))).alias("f"),
            exact_sum(F.when(rate < cap, words * x * rate).otherwise(0.0)).alias("slope"),
        )
        off = F.log(F.col("f") / F.col("target"))
        lo = F.when(off < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off < 0, F.col("hi")).otherwise(F.col("lam"))
        inside = F.when((lo > -inf) & (hi < inf), (lo + hi) / 2).when(off < 0, F.col("lam") + 1 + F.abs("lam")).otherwise(F.col("lam") - 1 - F.abs("lam"))
        step = F.when(F.col("slope") > 0, F.col("lam") - off * F.col("f") / F.col("slope"))
        new = state.join(got, "key", "left").select(
            "key", "target", "mean",
            F.when(F.col("done") | (F.abs(off) <= TOLERANCE), F.col("lam")).when((step > lo) & (step < hi), step).otherwise(inside).alias("lam"),
            F.when(F.col("done"), F.col("lo")).otherwise(lo).alias("lo"),
            F.when(F.col("done"), F.col("hi")).otherwise(hi).alias("hi"),
            (F.col("done") | F.coalesce(F.abs(off) <= TOLERANCE, F.lit(True))).alias("done"),
        )
        state = checkpoint(new, n)
        if state.filter("not done").isEmpty():
            break
    else:
        raise RuntimeError(f"rates of some sources still changed after {STEPS} Newton steps")
    return state.select("key", "mean", "lam", "target")


def _copies(cells: DataFrame, cap: int) -> DataFrame:
    """Whole copies of each (key, size): rounding carries on from the larger sizes to the smaller,
    then a few rounds add or take whole documents while words are left over or short."""
    own = Window.partitionBy("key")
    down = own.orderBy(F.col("size").desc())
    sofar = F.floor(F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    out = cells.withColumn("sofar", sofar).withColumn("copies", F.col("sofar") - F.coalesce(F.lag("sofar").over(down), F.lit(0)))
    out = out.withColumn("copies", F.least(F.greatest("copies", F.lit(0)), F.col("n") * cap))
    for _ in range(FIXES):
        out = out.withColumn("short", F.round(F.col("target")).cast("long") - F.sum(F.col("copies") * F.col("size")).over(own))
        room = F.when(F.col("short") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        out = out.withColumn("best", F.max(F.when((F.col("size") > 0) & (F.col("size") <= F.abs("short")) & (room > 0), F.col("size"))).over(own))
        some = F.least(F.floor(F.abs("short") / F.col("size")), room)
        out = out.withColumn("copies", F.when((F.col("size") > 0) & (F.col("size") == F.col("best")), F.col("copies") + F.signum(F.col("short")).cast("long") * some).otherwise(F.col("copies")))
    return out.select("key", "size", "n", "rate", "copies")


def mix(docs: DataFrame, carry: Sequence[str] = ("doc_id",), weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Copies of every document for a mix by source weights.

    Reads doc_id, text, source and the columns to ``carry``. Returns those, with size, source_size,
    target, rate (before rounding), copies and taken (copies * size). A null text has size 0; null is
    a source of its own, the last in order; a document without words is kept once (its copies take
    nothing). Equal sizes in a source are ranked by a hash of doc_id, so reruns agree; repeated rows
    are documents of their own. Which documents get the odd copy is ranked in PARTS parts of a
    (source, size), so that a hot one is dealt out. Raises if a column to carry has the name of one of the result's.
    """
    if clash := set(carry) & {"size", "source_size", "target", "rate", "copies", "taken"}:
        raise ValueError(f"columns to carry that the result has itself: {sorted(clash)}")
    carried = F.struct(*[F.col(c) for c in carry]).alias("_carried")
    docs = docs.select(carried, _key(F.col("source")).alias("key"), F.col("source").alias("_source"), size_of(F.col("text")).alias("size"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"), F.xxhash64("doc_id", F.lit(7)).alias("_hash"), F.col("doc_id").alias("_id"))
    narrow = set(carry) <= {"doc_id"}
    if narrow:
        docs = keep(docs)
    parts = keep(docs.groupBy("key", "_source", "size", "part").agg(F.count("*").alias("m")))
    sizes = checkpoint(parts.groupBy("key", "_source", "size").agg(F.sum("m").alias("n")))
    sources = sizes.groupBy("key", F.col("_source").alias("source")).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    sources = keep(targets(sources, weights, cap).select("key", "source_size", "n_docs", "target"))
    dual = _solve(sizes, sources, cap)
    rate = F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate)
    cells = _copies(sizes.join(dual, "key").select("key", "size", "n", "target", rate.alias("rate")), cap)
    before = F.coalesce(F.sum("m").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    odd = F.least(F.greatest(F.col("copies") % F.col("n") - before, F.lit(0)), F.col("m"))
    deal = (
        parts.select("key", "size", "part", "m").join(cells, ["key", "size"])
        .select("key", "size", "part", "rate", F.floor(F.col("copies") / F.col("n")).alias("base"), odd.alias("odd"))
        .join(sources.select("key", "source_size", "target"), "key")
    )
    deal = checkpoint(deal)
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("_hash", "_id"))
    copies = (F.col("base") + (rank <= F.col("odd")).cast("long")).cast("long")
    return docs.join(deal, ["key", "size", "part"]).select(
        "_carried.*", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
