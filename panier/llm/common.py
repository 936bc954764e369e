"""Shared helpers: scratch tables in the shared folder, shared files, documents input."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import uuid
import weakref
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where ``spark.checkpoint.dir`` is unset and the driver is the one machine there is (local tests).
LOCAL_SHARED = "/tmp/checkpoints"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns, whatever their names, cannot clash with an operator's own."""
    return df.select(*(df[n] for n in names))


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, as a batch holds whole texts of which some are very long; and workers that find this package."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, the one place that driver and executors share; it goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        root = LOCAL_SHARED
    path = f"{root.rstrip('/')}/panier/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        if not path.partition(":")[2].startswith("//") or path.startswith("file:"):
            import shutil

            shutil.rmtree(plain(path), ignore_errors=True)
        else:
            with contextlib.suppress(Exception):
                remove(spark, path)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Within it, a finished write gives its shuffle files back at once instead of at the driver's next garbage collection."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def done(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and nothing will read again."""
    for t in tables:
        if (path := _paths.pop(t, None)) is not None:
            remove(t.sparkSession, path)


def plain(uri: str) -> str:
    """The POSIX path of a ``file:`` URI or of a path without scheme."""
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def _is_local(uri: str) -> bool:
    return uri.startswith("file:") or "://" not in uri


def put_file(uri: str, *blobs: bytes) -> None:
    """Writes a file under another name and renames it: a retried task replaces it whole, a half-written one is never seen."""
    if _is_local(uri):
        path = plain(uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        half = f"{path}.{uuid.uuid4().hex}.half"
        with open(half, "wb") as f:
            for b in blobs:
                f.write(b)
        os.replace(half, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    half = f"{path}.{uuid.uuid4().hex}.half"
    with store.open_output_stream(half) as f:
        for b in blobs:
            f.write(b)
    store.move(half, path)


def rename_file(old: str, new: str) -> None:
    if _is_local(old):
        os.replace(plain(old), plain(new))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(old)
    store.move(path, fs.FileSystem.from_uri(new)[1])


def exists(uri: str) -> bool:
    if _is_local(uri):
        return os.path.exists(plain(uri))
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.get_file_info(path).type == fs.FileType.File


def delete_file(uri: str) -> None:
    """Deletes a file; none there is no error."""
    if _is_local(uri):
        with contextlib.suppress(FileNotFoundError):
            os.remove(plain(uri))
    elif exists(uri):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.delete_file(path)


def sink(uri: str):
    """A binary file to append to; the caller renames it when it is complete."""
    if _is_local(uri):
        os.makedirs(os.path.dirname(plain(uri)), exist_ok=True)
        return open(plain(uri), "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path)


def mapped(uri: str, dtype) -> np.ndarray:
    """The file's items, memory-mapped where the folder is mounted, otherwise read through its store."""
    if _is_local(uri):
        path = plain(uri)
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


class Ranged:
    """A file of items in a store that is not mounted: a slice reads its range only."""

    def __init__(self, uri: str, dtype):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.file, self.dtype = store.open_input_file(path), np.dtype(dtype)

    def __getitem__(self, at: slice) -> np.ndarray:
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((at.stop - at.start) * size, at.start * size), self.dtype)


class Maps(dict):
    """The most recently used files of a task, few at a time, of which slices are taken: mapped, or read by ranges."""

    def __init__(self, dtype, most: int = 64):
        super().__init__()
        self.dtype, self.most = dtype, most

    def __missing__(self, uri: str) -> np.ndarray:
        if len(self) >= self.most:
            self.pop(next(iter(self)))
        self[uri] = out = mapped(uri, self.dtype) if _is_local(uri) else Ranged(uri, self.dtype)
        return out


def spread_join(many: DataFrame, one: DataFrame, key: str, shares: int = 1000, salts: int = 32) -> DataFrame:
    """An inner join on ``key``, of which ``one`` has one row each, that no key can hold up: those with more than one in ``shares`` of all
    rows of ``many`` (so fewer than ``shares``) are dealt to ``salts`` tasks.  ``many`` is a written table."""
    counted = many.groupBy(key).agg(F.count("*").alias("c")).where("c >= 256")
    least = many.count() // shares
    hot = [r[0] for r in counted.where(F.col("c") > least).select(key).collect()]  # fewer than ``shares``
    if not hot:
        return many.join(one, key)
    is_hot = F.col(key).isin(hot)
    left = many.withColumn("salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0).cast("int"))
    right = one.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "salt"]).drop("salt")


def crc_mod(doc_id: str, n: int):
    """crc32 of the id as text, modulo n (null: as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def load_bytes(uri: str) -> bytes:
    if _is_local(uri):
        with open(plain(uri), "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def release() -> None:
    """Gives back what a task has used: a worker lives over many tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def npz_bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()
