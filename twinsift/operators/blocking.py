"""Candidate pairs by blocking: duration windows, and directories with their grandparents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.kernels import dirname
from twinsift.operators import blocks
from twinsift.runtime import checkpoint, spread

TOLERANCE = 3
#: How often a file is sent to what it meets, about; pairs of files of a task, about.
COPIES, TASK_PAIRS = 24, 1 << 27
MAX_BUCKET, MAX_SUB_BUCKET = 200, 400


def bucket_pairs(buckets: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(p, q), p <= q, of the distinct ``buckets`` (bucket) whose files pair: both lie within ``tolerance`` of
    one bucket that some file has. So buckets up to 2 * tolerance apart pair when a file lies between them."""
    own = buckets.select(F.col("bucket").alias("p")).distinct()
    reach = own.withColumn("q", F.explode(F.sequence(F.col("p"), F.col("p") + 2 * tolerance))).join(own.select(F.col("p").alias("q")), "q", "left_semi")
    near = reach.filter(F.col("q") - F.col("p") <= tolerance)  # either is the centre
    far = reach.filter(F.col("q") - F.col("p") > tolerance).withColumn("centre", F.explode(F.sequence(F.col("q") - tolerance, F.col("p") + tolerance)))
    far = far.join(own.select(F.col("p").alias("centre")), "centre", "left_semi")
    return near.select("p", "q").unionByName(far.select("p", "q").distinct())


def window_blocks(files: DataFrame, value: str, tolerance: int = TOLERANCE, size: int = blocks.BLOCK, more: Sequence[str] = ()) -> DataFrame:
    """Pairs of blocks of files whose buckets pair: id_l, id_r, value_l, value_r, ``more`` columns alike, same. Two files meet
    in one of them exactly, as each pair of buckets comes once.

    A block goes to each of its pairs, so blocks grow with the files a file meets, from ``size`` on: a file is sent about COPIES times
    more than once a bucket, however many it meets. Kernels take large pairs of blocks apart (``blocks.cut``)."""
    columns = ["id", "value", *more]
    rows = files.select("id", "bucket", F.col(value).alias("value"), *more)
    held = checkpoint(rows.groupBy("bucket").agg(F.count("*").alias("held")))
    n = held.select(F.col("bucket").alias("bucket_l"), F.col("held").alias("n"))
    m = held.select(F.col("bucket").alias("bucket_r"), F.col("held").alias("m"))
    met = bucket_pairs(held, tolerance).select(F.col("p").alias("bucket_l"), F.col("q").alias("bucket_r"))
    met = checkpoint(met.join(n, "bucket_l").join(m, "bucket_r"))
    work = int(met.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0)
    size = max(size, -(-2 * work // (COPIES * max(1, held.agg(F.sum("held")).first()[0] or 0))))
    last = lambda c: F.ceil(F.col(c) / size).cast("int") - 1
    cells = met.select("bucket_l", "bucket_r", F.explode(F.sequence(F.lit(0), last("n"))).alias("block_l"), last("m").alias("last"))
    cells = cells.select("bucket_l", "bucket_r", "block_l", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block_r"))
    cells = checkpoint(cells.filter("bucket_l < bucket_r or block_l <= block_r"))
    packed = blocks.blocked(rows.filter("id is not null"), ["bucket"], columns, size).withColumn("block", F.col("block").cast("int"))
    left, right = blocks.sides(packed, ["bucket", "block", *columns])
    keys = ["bucket_l", "bucket_r", "block_l", "block_r"]
    # each side is sent once to where the pair is scored, and no pair is written
    left, right = (spread(cells.join(side, keys[k::2]), *keys, parts=work // TASK_PAIRS) for k, side in ((0, left), (1, right)))
    return left.join(right.hint("merge"), keys).withColumn("same", F.expr("bucket_l = bucket_r and block_l = block_r"))


def duration_window_pairs(files: DataFrame, tolerance: int = TOLERANCE, size: int = blocks.BLOCK) -> DataFrame:
    """(a, b), a < b, of files whose buckets pair (see ``bucket_pairs``), each pair once.

    Ids meet in blocks, and each pair of blocks is opened where it stands, some pairs at a time."""
    return blocks.opened(window_blocks(files, "id", tolerance, size).select("id_l", "id_r", "same"))


def pair_cost(buckets: DataFrame) -> DataFrame:
    """Pairs that blocking would compare, before it does: n and pairs of each kind."""
    n = F.col("n").cast("bigint")
    return buckets.groupBy("kind").agg(F.sum(n * (n - 1) / 2).cast("bigint").alias("pairs"), F.count("*").alias("buckets"), F.max("n").alias("largest"))


def directory_members(files: DataFrame) -> DataFrame:
    """kind, dir, id, tokens: each file in its directory's bucket and in the grandparent's."""
    d = dirname("path")
    both = files.select("id", "tokens", F.explode(F.array(F.struct(F.lit("dir").alias("kind"), d.alias("dir")), F.struct(F.lit("grandparent").alias("kind"), dirname(d).alias("dir")))).alias("at"))
    return both.select("at.kind", "at.dir", "id", "tokens")


def directory_buckets(members: DataFrame, max_bucket: int = MAX_BUCKET, max_sub: int = MAX_SUB_BUCKET) -> DataFrame:
    """``members`` with their final bucket (``sub``: null unless the bucket was cut).

    A bucket over ``max_bucket`` files is cut by the alphabetically smallest token with a letter
    (else the smallest one, else a common name); cuts over ``max_sub`` files are left out, as are
    files alone. These bounds are part of the operator: names of a larger cut don't tell files apart.
    """
    sizes = members.groupBy("kind", "dir").agg(F.count("*").alias("held"))
    first = F.coalesce(F.array_min(F.filter("tokens", lambda t: t.rlike(r"\p{L}"))), F.array_min("tokens"), F.lit("_empty_"))
    cut = members.join(sizes.filter("held > 1"), ["kind", "dir"]).withColumn("sub", F.when(F.col("held") > max_bucket, first))
    subs = cut.groupBy("kind", "dir", "sub").agg(F.count("*").alias("n"))
    fits = (F.col("n") > 1) & (F.col("sub").isNull() | (F.col("n") <= max_sub))
    kept = subs.filter(fits).withColumn("sub_key", F.coalesce("sub", F.lit(""))).drop("sub")
    return cut.withColumn("sub_key", F.coalesce("sub", F.lit(""))).join(kept, ["kind", "dir", "sub_key"]).select("kind", "dir", "sub", "sub_key", "id", "tokens", "n")


def directory_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b, ta, tb), a < b, of files that share a bucket, each pair once."""
    left = buckets.select("kind", "dir", "sub_key", F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = buckets.select("kind", "dir", "sub_key", F.col("id").alias("b"), F.col("tokens").alias("tb"))
    return left.join(right, ["kind", "dir", "sub_key"]).filter("a < b").select("a", "b", "ta", "tb").dropDuplicates(["a", "b"])
