"""Command line over stored tables: ``preview`` and ``auto``.

    python -m twinsift.cli preview --tables DIR [--media video] [--match exact ...] [--threshold 0.9]
    python -m twinsift.cli auto    --tables DIR --out DIR [--yes]

DIR holds groups, members, files and sources as Parquet. ``auto`` marks keepers and writes the plan of
moves; without ``--yes`` it only shows the preview. Exit status 2 if the plan has missing files.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from twinsift.operators import actions
from twinsift.sources import sinks


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="twinsift")
    p.add_argument("command", choices=("preview", "auto"))
    p.add_argument("--tables", required=True)
    p.add_argument("--out")
    p.add_argument("--media", choices=("video", "audio"))
    p.add_argument("--match", nargs="*", choices=("exact", "perceptual", "chromaprint"))
    p.add_argument("--threshold", type=float)
    p.add_argument("--day", default="19700101")
    p.add_argument("--yes", action="store_true")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    read = lambda name: spark.read.parquet(f"{a.tables}/{name}")
    groups, members, files, sources = map(read, ("groups", "members", "files", "sources"))
    chosen = actions.selected(groups, a.match, a.media, a.threshold)
    for r in actions.with_total(actions.preview(chosen, members, files)).orderBy(F.col("media_type") == "TOTAL", "media_type", "match_type").collect():
        print(f"{r['media_type']:<8} {r['match_type']:<12} {r['groups']:>8} {r['files_to_delete']:>10} {r['reclaimable']:>14}")
    if a.command == "preview" or not a.yes:
        return 0
    if not a.out:
        p.error("auto needs --out")
    marked = actions.marked(chosen, members, files, sources)
    plan = actions.plan(chosen, marked, files, sources, a.day)
    sinks.replace_all(plan, f"{a.out}/plan")
    sinks.replace_all(marked, f"{a.out}/members")
    return 2 if not spark.read.parquet(f"{a.out}/plan").filter("outcome = 'missing'").isEmpty() else 0


if __name__ == "__main__":
    sys.exit(main())
