"""Durable intermediates in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where the session names none and none was set on its context, a temporary folder is set if driver and executors are
    one process (tests); on a cluster that would be a folder of each machine's own, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_scope: ContextVar[str] = ContextVar("scope", default="")


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediates that are written within are deleted at its end: what was built on them must have been written elsewhere by then."""
    name = f"scope-{uuid.uuid4().hex}/"
    token = _scope.set(_scope.get() + name)
    path = f"{shared_dir(spark)}/tables/{_scope.get()}"
    try:
        yield
    finally:
        _scope.reset(token)
        _delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{_scope.get()}{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read and not a recomputation, and gives
    Catalyst the true size of what follows.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote, once nothing that is built on it is still to be read."""
    if files := df.inputFiles():
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def clean(spark: SparkSession) -> None:
    """Delete all intermediates in the shared folder. Call it when no result that was built on them is still to be read."""
    _delete(spark, f"{shared_dir(spark)}/tables")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
