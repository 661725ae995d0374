"""Helpers for small tables, lineage cuts and Arrow batch sizing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from contextlib import contextmanager
from pathlib import Path
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default size of an input split, and the largest input that is spread over the cores.
INPUT_SPLIT = 128 << 20
SPREAD_BYTES = 4 << 30
# Estimated bytes of a partition of spread rows. Estimates follow files, which may be a small
# part (a sixteenth for line items) of what their rows take in a shuffle or in the cache.
SPREAD_PIECE = 4 << 20
# A table at most this long is shipped to every executor; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000


class TableTooLarge(ValueError):
    """A table that must stay small (classes, parts, edges) is not."""


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must have at most ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TableTooLarge(f"{what}: more than {limit} rows")
    return rows


def attach_small(df: DataFrame, small: DataFrame, on, how: str = "inner",
                 limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is usually small: broadcast it only when its measured
    length allows, else leave the join (and its skew) to adaptive execution."""
    small = cut_lineage(small)  # computed once, for its length and for the join
    if small.limit(limit + 1).count() > limit:
        return df.join(small, on, how)
    return df.join(F.broadcast(small), on, how)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to and read back from the shared checkpoint folder: like a
    checkpoint, but later passes read only the columns they need."""
    folder = f"{checkpoint_dir(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


class Scratch:
    """Tables written to the shared checkpoint folder until ``close`` or the end of a ``with``
    block: what a result no longer needs does not stay on disk."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.folder = f"{checkpoint_dir(spark)}/scratch-{uuid4().hex}"

    def written(self, df: DataFrame, *by: str) -> DataFrame:
        """``df`` written (one folder per value of the columns ``by``) and read back; readable
        until the block ends."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path) if by else \
            self.spark.read.parquet(path)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@contextmanager
def spread(rows: DataFrame, key: str):
    """Rows over all cores, and cached, when Catalyst estimates less than one input split
    per core (a small table in one file); larger inputs are left as they are. There are as many
    partitions as cores or, for more rows, as many as keep a partition small."""
    cores, size = rows.sparkSession.sparkContext.defaultParallelism, estimated_bytes(rows)
    if size > min(cores * INPUT_SPLIT, SPREAD_BYTES):
        yield rows
        return
    wide = rows.repartition(max(cores, -(-size // SPREAD_PIECE)), key).persist()
    try:
        yield wide
    finally:
        wide.unpersist()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a private one only for local sessions."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="vectorloom-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so that a lost executor never replays its past."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_prepared: set[str] = set()
_preparing = Lock()


def prepare(spark: SparkSession) -> None:
    """Once per application: send this package to the executors (their Python may start
    anywhere) and keep Arrow batches of wide rows small."""
    bound_arrow_batches(spark)
    application = spark.sparkContext.applicationId
    with _preparing:
        if application in _prepared:
            return
        # Executors fetch the archive from the driver whenever they start: it goes at exit.
        folder = tempfile.mkdtemp(prefix="vectorloom-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = Path(__file__).resolve().parent
        name = f"{folder}/vectorloom-{uuid4().hex}"
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root.parent, root.name))
        _prepared.add(application)


def bound_arrow_batches(spark: SparkSession, n_bytes: int = 64 << 20) -> None:
    """Keep Arrow batches of wide rows within ``n_bytes``; a user's own bound is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = "".join(c for c in str(spark.conf.get(name)) if c.isdigit())
    if not digits or int(digits) >= (1 << 31) - 1:
        spark.conf.set(name, str(n_bytes))
