"""A corpus pipeline: language ID, exact dedup, near dedup, mixing to target weights, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes every stage's rows as Parquet under the session's
checkpoint folder and reads them again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import bpe, exact_dedup, language_id, mixing, near_dups
from twinsift.llm.queries import VOCABULARY
from twinsift.llm.rows import without
from twinsift.runtime import checkpoint_dir, delete, holding, keep, ready, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others get the predicted language. Learns as op2 does, from the rows
    with a language that aren't held out; without any such row every document stays as it is."""
    ready(spark)
    model = language_id.fit(docs.filter(~language_id.held_out()))
    if not model.langs:
        return docs.select(*COLUMNS)
    out = language_id.identify(docs, model, COLUMNS).filter("not rejected")
    return out.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of those whose texts agree without white space."""
    ready(spark)
    decided = keep(exact_dedup.dedup(docs, with_rows=True).select("row", "kept"))
    return without(docs.select(*COLUMNS), decided)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (null last) stays of each group of near duplicates."""
    ready(spark)
    classed = keep(near_dups.near_classes(docs, with_rows=True).select("row", "component", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("me")))
    best = classed.groupBy("component").agg(F.min("me").alias("best"))
    decided = keep(classed.join(best, "component").select("row", (F.col("me") == F.col("best")).alias("kept")))
    return without(docs.select(*COLUMNS), decided)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to CAP times."""
    ready(spark)
    copies = F.slice(F.array(*[F.lit(i) for i in range(mixing.CAP)]), F.lit(1), F.col("copies").cast("int"))
    return mixing.mix(docs, COLUMNS).withColumn("copy", F.explode(copies)).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    ready(spark)
    return bpe.encode_documents(docs, VOCABULARY)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Language ID, Order MinHash and entropy balancing aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        with holding():  # what a stage holds goes once its rows are written
            stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{name}")
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)  # no plan reads the stage before any more
        last = path
    return docs
