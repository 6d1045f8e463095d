"""What every plan shares: reading tables, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch at most: whole texts are long, and a worker holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, bound their batches, and have
    shuffle files deleted when the query that wrote them ends, as loops write many.

    On a cluster that lacks that path the package goes with ``--py-files`` as usual.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(size):
        spark.conf.set(size, str(BATCH_BYTES))
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if not spark.sparkContext.getConf().contains(clean):
        spark.conf.set(clean, "true")
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set, a temporary folder serves a session on
    one machine; a cluster has to name one that its executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Parts at most that ``spread`` deals to because of their number.
PARTS = 2000
#: Rows of a table that go to one checkpoint file, about, where their number is known.
FILE_ROWS = 1_000_000
#: What the innermost ``holding`` block of this thread has checkpointed and persisted so far.
_held: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("held", default=())
#: Folders of the tables that ``checkpoint`` wrote.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder, which all executors share, and go on from there.

    Plans that read it know its real size, and no executor's loss touches it. With ``rows`` (about as many
    as there are) it goes to no more files than it needs.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return _hold(out)


def spread(pairs: DataFrame, *keys: str, parts: int = 0) -> DataFrame:
    """``pairs`` dealt to all cores (to ``parts``, if that is more, up to PARTS) before work that follows their number and not their bytes:
    adaptive execution would else gather small rows to a few tasks."""
    sc = pairs.sparkSession.sparkContext
    return pairs.repartition(max(sc.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(parts, PARTS)), *keys)


def keep(df: DataFrame) -> DataFrame:
    """Hold ``df`` for use by a few plans, in memory and beyond that on disk. What a lost executor held
    is computed again, so ``df`` must be deterministic. Plans remain whole, so this isn't for loops."""
    return _hold(df.persist(StorageLevel.MEMORY_AND_DISK))


def _hold(df: DataFrame) -> DataFrame:
    if _held.get():
        _held.get()[-1].append(df)
    return df


def discard(*tables: DataFrame) -> None:
    """Free what ``keep`` holds of ``tables`` and delete the files that ``checkpoint`` wrote for them.

    Only for tables that no plan will read again, one that recovers from a lost executor included.
    """
    for df in tables:
        path = _written.pop(df, None)
        if path is None:
            df.unpersist()
        else:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the checkpoint folder's file system."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def holding() -> Iterator[None]:
    """Discards at its end all tables that were held or checkpointed within, so results have to be written
    or counted by then."""
    mine: list[DataFrame] = []
    token = _held.set((*_held.get(), mine))
    try:
        yield
    finally:
        _held.reset(token)
        discard(*mine)
