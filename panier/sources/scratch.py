"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where ``spark.checkpoint.dir`` is unset and the driver is the one machine there is.
LOCAL = "/tmp/checkpoints"
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        root = LOCAL
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table that is read again: its plan ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/panier/tables-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder of files that tasks write and read; it goes when the driver ends.  Executors find this package."""
    path = f"{shared_folder(spark)}/panier/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    here, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)
    return path


def _local(uri: str) -> str | None:
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") or "://" not in uri else None


def put_file(uri: str, data: bytes) -> None:
    """Written under another name and renamed: a retried task replaces the file whole."""
    half = f"{uri}.{uuid.uuid4().hex}.half"
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(half), "wb") as f:
            f.write(data)
        os.replace(_local(half), path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(half)
    with store.open_output_stream(path) as f:
        f.write(data)
    store.move(path, fs.FileSystem.from_uri(uri)[1])


def get_file(uri: str) -> bytes:
    if path := _local(uri):
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


@atexit.register
def _clean() -> None:
    import shutil

    for spark, path in _made:
        with contextlib.suppress(Exception):
            if "://" in path and not path.startswith("file:"):
                remove(spark, path)
            else:
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
