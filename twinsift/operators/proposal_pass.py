"""One pass of proposals, from files to groups: batches, a provider's answers, what is accepted, components.

The ledger is an append-only Parquet table of all calls. A batch is known by its bucket, number and listing; one
that the ledger has a usable answer for isn't asked again, so a pass that broke off, or whose job was run again, goes on
where it stopped, and only what a wave commits counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators import proposals
from twinsift.runtime import checkpoint, spread

#: Called with a batch's prompt; returns the answer's text. Has to pickle, as executors call it.
Provider = Callable[[str], str | None]
LEDGER = "bucket string, batch long, asked string, model string, created_at timestamp, n_files long, prompt string, response string, error string, elapsed_ms long, tries int"


def ask(batches: DataFrame, provider: Provider, tries: int = 2) -> DataFrame:
    """bucket, batch, asked, n_files, prompt with response, error, elapsed_ms and tries. A blank answer is asked for again,
    up to ``tries`` calls; an error isn't, and is told by its type and text."""

    def one(prompt: str) -> tuple[str | None, str | None, int, int]:
        began, response, error, n = time.monotonic(), None, None, 0
        while n < tries and not (response or "").strip():
            n += 1
            try:
                response = provider(prompt)
            except Exception as e:  # the provider's own: the batch stays open
                error = f"{type(e).__name__}: {e}"
                break
        return response, error, round((time.monotonic() - began) * 1000), n

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            done = pd.DataFrame([one(p) for p in b["prompt"]], columns=["response", "error", "elapsed_ms", "tries"], index=b.index)
            yield pd.concat([b, done], axis=1)

    rows = batches.select("bucket", "batch", "asked", "n_files", "prompt")
    return rows.mapInPandas(run, "bucket string, batch long, asked string, n_files long, prompt string, response string, error string, elapsed_ms long, tries int")


def answered(ledger: DataFrame, model: str) -> DataFrame:
    """The model's last usable answer to each batch: bucket, batch, asked, response."""
    good = ledger.filter((F.col("model") == model) & F.col("error").isNull() & (F.trim(F.coalesce("response", F.lit(""))) != ""))
    return good.groupBy("bucket", "batch", "asked").agg(F.max_by("response", F.struct("created_at", "response")).alias("response"))


def proposed(answers: DataFrame) -> DataFrame:
    """bucket, batch, proposal, members, confidence of every group that the answers propose; answers without usable JSON
    propose none."""
    groups = F.posexplode(proposals.parsed("response")["groups"]).alias("at", "g")
    return answers.select("bucket", "batch", groups).select("bucket", "batch", (F.col("at") + 1).alias("proposal"), "g.members", "g.confidence")


def run_pass(files: DataFrame, members: DataFrame, provider: Provider, ledger: str, model: str = "provider", media_type: str = "video", by: str = "parent_dir", batch: int = proposals.BATCH, waves: int = 1, most_buckets: int | None = None, confidence: float = proposals.CONFIDENCE) -> DataFrame:
    """media_type, group_id, id, similarity, keeper of the groups that the provider's proposals make.

    ``files`` come with their source's priority; those in a group of any kind (``members``) aren't asked about. Calls are
    appended to ``ledger`` (a folder) in ``waves``, each committed as a whole. Batches that ended in errors or
    blank answers propose nothing, and are asked about again by the next pass.
    """
    spark = files.sparkSession
    rows = checkpoint(proposals.batches(proposals.ungrouped(files, members, media_type), by, batch, most_buckets=most_buckets))
    asked = checkpoint(proposals.prompts(rows).withColumnRenamed("listing", "prompt").withColumn("asked", F.sha2("prompt", 256)))
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    read = lambda: spark.read.schema(LEDGER).parquet(ledger)
    names = ["bucket", "batch", "asked"]
    for wave in range(waves):
        pending = asked.filter(F.pmod(F.xxhash64(*names), F.lit(waves)) == wave).join(answered(read(), model), names, "left_anti")
        calls = ask(spread(checkpoint(pending), *names), provider).withColumns({"model": F.lit(model), "created_at": F.current_timestamp()})
        calls.select(*[c.split()[0] for c in LEDGER.split(", ")]).write.mode("append").parquet(ledger)
    answers = answered(read(), model).join(asked, names, "left_semi")
    taken = checkpoint(proposals.accepted(proposed(answers), rows, confidence))
    return proposals.proposal_clusters(taken, files, media_type)
