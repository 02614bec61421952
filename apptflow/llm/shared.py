"""The shared folder: written tables, checkpoints and flat files.

The cluster names the folder in ``spark.checkpoint.dir``.  A folder of our own
is made only where that is unset on a ``local[...]`` master (tests).
"""

from __future__ import annotations

import contextlib
import ctypes
import importlib
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    d = d or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; it must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="apptflow-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, survives lost
    executors, and ends the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder (URI) below the shared folder."""
    base = shared_dir(spark).rstrip("/")
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base}/{what}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder made by :func:`new_folder`."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def tidy(run, kept: str | None = None):
    """A function for ``mapInArrow`` that gives its memory back at the end of a
    partition, and empties the dictionary ``kept`` ("module:name") of what it
    loaded.  Workers serve one task after the other; what they and the allocators
    keep for later would add up over the stages of a long job."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            if kept:
                module, name = kept.split(":")
                getattr(importlib.import_module(module), name).clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # where the C library has it
            if trim is not None:
                trim(0)

    return whole


@contextlib.contextmanager
def stream_file(folder: str, name: str):
    """An open file of the folder, for writing.  It is written under a name of its
    own and renamed when whole, so a task that runs again replaces equal bytes
    and no reader sees half a file."""
    path, own = _local(folder), f".{name}.{uuid.uuid4().hex}"
    if path is not None:
        os.makedirs(path, exist_ok=True)
        with open(os.path.join(path, own), "wb", buffering=1 << 20) as f:
            yield f
        os.replace(os.path.join(path, own), os.path.join(path, name))
        return
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{own}") as f:
        yield f
    store.move(f"{path}/{own}", f"{path}/{name}")


def put_file(folder: str, name: str, data) -> None:
    """Write one file whole."""
    with stream_file(folder, name) as f:
        if len(data):
            f.write(memoryview(data).cast("B"))


def read_range(folder: str, name: str, start: int, size: int) -> bytes:
    path = _local(folder)
    if path is not None:
        with open(os.path.join(path, name), "rb") as f:
            f.seek(start)
            return f.read(size)
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        return f.read_at(size, start)


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    """A flat file as an array: memory-mapped where the folder is a mounted file
    system, else read once."""
    dtype = np.dtype(dtype)
    path = _local(folder)
    if path is not None:
        p = os.path.join(path, name)
        if os.path.getsize(p) == 0:
            return np.zeros(0, dtype)
        return np.memmap(p, dtype=dtype, mode="r")
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype=dtype)
