"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what ``bytes.split()`` splits on, i.e. [\x20\x09-\x0D].
SPACES = b" \t\n\r\x0b\x0c"
#: Rows of an Arrow batch, at most.
BATCH = 1000
#: Words or pre-tokens that a Python worker remembers, and their greatest length.
REMEMBERED = 100_000
KEY_LENGTH = 48
#: Rows handled at a time inside a Python task.
SLICE = 256


@lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="cohortcraft-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) may go without that setting; it then gets a
    folder of its own.  On a cluster a missing setting is an error, because a
    machine-local folder would lose data.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Drops an execution's shuffle files when it ends, instead of when the driver collects its handles.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The shuffle files behind it go at once, so that they don't add up from
    step to step of a long job.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    try:
        spark.conf.set(CLEAN_UP, "true")
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables that :func:`written` made and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not folder.startswith(("file:", "hdfs:", "s3", "gs:", "abfs", "/")):
                continue
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches kept to BATCH rows, which bounds what crosses to Python at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return df


class Remembered(dict):
    """A memory of computed values of at most ``size`` keys of at most KEY_LENGTH; when it is full, the older half goes.

    Longer keys (whole runs without a space, encoded data) are computed each
    time, so the memory is bounded in bytes.
    """

    def __init__(self, size: int, compute):
        super().__init__()
        self.size, self.compute = size, compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= KEY_LENGTH:
            if len(self) >= self.size:
                for old in list(islice(self, self.size // 2)):
                    del self[old]
            self[key] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``size`` rows, which bounds what a task holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    pa.default_memory_pool().release_unused()


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which is faster here than numpy's hashing)."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values
