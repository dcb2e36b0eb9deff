"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (ids and a few numbers) may be broadcast.
BROADCAST_ROWS = 500_000
#: Setting by which a query's shuffle files are deleted when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Characters that a Python worker holds as word lists at one time.
SLICE_CHARS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster names its shared folder in spark.checkpoint.dir; only in
    local mode is one chosen here where that is unset.  Elsewhere that raises:
    a folder of each machine's own would lose data without a word."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named or "/tmp/checkpoints")
    return named or "/tmp/checkpoints"


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """The shuffle files of queries made and run here are deleted when these
    end, not with the driver's next collection of garbage."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder, which cuts its lineage and
    outlives lost executors; compressed, and columns can be read by themselves.
    Its shuffle files are deleted when it is written."""
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, when no result that was
    made from them is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until none is a column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bound_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows that go to a Python worker at once: texts may be long, and a batch
    is held by Spark and by the worker at the same time.  The setting is the
    session's and stays lowered, as results are only computed when they are read."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by number: functions over Arrow batches take no dots in names."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its checked size allows it; else a join
    with it shuffles."""
    return F.broadcast(df) if small(df, rows) else df


def slices(texts: list, limit: int = SLICE_CHARS):
    """(start, end) ranges of at most `limit` characters, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def tokenizer_path(name: str) -> str:
    """Where the named public vocabulary file is; callers may pass any other path."""
    folder = os.environ.get("GRIDWEAVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def tidy() -> None:
    """Give back what a Python worker's earlier work has freed: workers live on
    from stage to stage, and their allocators keep freed memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class PerWorker:
    """An object that each Python worker makes once and keeps between tasks.

    What it is made from goes out as a broadcast variable, so its size must
    have a bound of its own (a vocabulary, a model).
    """

    def __init__(self, spark: SparkSession, make, *args):
        bound_batches(spark)
        self.make, self.shared = make, spark.sparkContext.broadcast({"args": args})

    def get(self):
        held = self.shared.value
        if "made" not in held:
            tidy()
            held["made"] = self.make(*held["args"])
        return held["made"]
