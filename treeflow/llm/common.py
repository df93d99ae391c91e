"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes that separate words: the space and the controls from 9 to 13. ``bytes.split()`` splits on exactly these.
SPACES = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other columns cannot clash."""
    return df.select(*[df[old].alias(new) for new, old in named.items()])


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns beside the input's own: none of them clashes, in any case of letters."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session gets one of its own; a cluster without it is an error, since executors
    could not see a folder of the driver's machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (set_dir := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = set_dir.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        found = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/scratch/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone when the driver ends; the shared folder is then cleaned by its owner
        pass


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write and reread: cuts lineage with a table that survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give memory that this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def lean(run):
    """The task with memory given back at its end: workers live on, and the next stage's needs come on top of what they keep."""

    @functools.wraps(run)
    def task(batches):
        yield from run(batches)
        trim()

    return task


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist() if column.type != kind else column.to_pylist()


def batch(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, t) if not isinstance(a, pa.Array) else a.cast(t) for a, t in zip(arrays, schema.types, strict=True)], schema=schema)


def slices(size: int, weights: list[int], most: int):
    """Ranges of consecutive rows whose weights add up to about ``most``, so that memory follows bytes, not rows."""
    start = total = 0
    for i in range(size):
        total += weights[i]
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < size:
        yield start, size


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (shift, multiply) over unsigned arrays."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


__all__ = ["F", "SPACES", "as_bytes", "batch", "columns", "documents", "lean", "mix64", "partitions", "scratch", "scratch_path", "shared_dir", "slices", "trim", "unused"]
