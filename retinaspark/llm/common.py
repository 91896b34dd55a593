"""Shared folders, written tables and other small helpers of the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than the ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one in ``spark.checkpoint.dir``.  Where that is unset a folder of
    this machine is used and set, if the master is local, as in tests; on a
    cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's address below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: For each open ``temporary``, the folders that go with it.
_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession):
    """Folders written inside go at the end, but for those written with ``stays``: what reads the others has to be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        remove(spark, _scopes.pop())
        let_go(spark)


@contextmanager
def recorded():
    """Gives the list of folders written inside; they stay."""
    held: list[str] = []
    _scopes.append(held)
    try:
        yield held
    finally:
        _scopes.pop()


def let_go(spark: SparkSession) -> None:
    """Have shuffles deleted that no DataFrame needs any more: Spark finds them by the JVM's collector."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders below the shared root, by the cluster's own file system."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Rows that JVM and Python hand to each other at a time, in what is written inside: long ones fill memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def noted(path: str, stays: bool = False) -> str:
    """Remember a folder for the innermost ``temporary``, or if it ``stays`` for the one around that."""
    for scope in reversed(_scopes[:-1] if stays else _scopes):
        scope.append(path)
        break
    return path


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write ``df`` below the shared root and read it back: its lineage ends there."""
    path = noted(fresh_dir(df.sparkSession, name), stays)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """The pyarrow file system of an address, and the path in it."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(docs: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, under the given names.

    Others may have any name: they are gone before a name could clash.
    """
    return docs.select(*[docs[old].alias(new) for new, old in columns.items()])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def chunks(column: pa.Array, most: int = 1 << 21):
    """Runs of rows of a string column of about ``most`` bytes: (first, end)."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += int(n)
    if len(sizes) > first:
        yield first, len(sizes)


def release() -> None:
    """Give memory that a task no longer needs back to the system: Python workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def count_words(text):
    """The number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
