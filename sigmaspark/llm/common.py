"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

_own_dir: list[str] = []

#: Bytes of a batch of rows for a Python worker, in jobs that this package runs itself.
BATCH_BYTES = 4 << 20

_remembering: list = []


def remembered(maxsize: int) -> Callable:
    """An ``lru_cache`` for what takes much memory, which ``forget`` empties."""

    def wrap(f: Callable) -> Callable:
        _remembering.append(lru_cache(maxsize)(f))
        return _remembering[-1]

    return wrap


def forget() -> None:
    """Called by tasks that use none of it: their worker may have run another operator before, and would keep its memory beside theirs.

    What tasks before left in cycles, as a scorer with all its tokens, goes too, which Python may put off for long.
    """
    for f in _remembering:
        f.cache_clear()
    gc.collect()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run here pass rows to Python workers in batches of ``BATCH_BYTES``, or of fewer bytes where the session says so.

    A batch stands in the memory of the executor and of the worker at once, and buffers that grow to it are kept for later ones.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    try:
        if not 0 < own <= BATCH_BYTES:
            spark.conf.set(name, f"{BATCH_BYTES}b")
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``).

    A local folder stands in only where the setting is missing and the master is local, as in tests. The
    folder is removed when the session's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="spark-shared-"))
        base = f"file://{_own_dir[0]}"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: So many rows of a few numbers may be broadcast.
FEW = 1_000_000


def broadcast_if_few(keys: DataFrame) -> DataFrame:
    """``keys``, written and counted: marked for broadcast up to ``FEW`` rows, for an exchange beyond."""
    keys = cut(keys, "keys")
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def drop_written(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``cut`` returned, once nothing reads them any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for name in df.inputFiles()[:1]:
            where = jvm.org.apache.hadoop.fs.Path(name).getParent()
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def lower_ascii(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def portions(batch: pa.RecordBatch, most_bytes: int = 2_000_000, most_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes of text, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    at = total = 0
    for k, n in enumerate(sizes):
        if k > at and (total + n > most_bytes or k - at >= most_rows):
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += n
    yield batch.slice(at)
