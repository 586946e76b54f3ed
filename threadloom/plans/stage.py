"""Lineage cuts: write an intermediate to the shared checkpoint folder and read it back.

Used at the boundaries where one result feeds several branches (the hydrated selection,
grouped members and groups). The folder is the session's ``spark.checkpoint.dir``,
which on a cluster names shared storage, so a lost executor does not lose the stage.
Reading the files back also gives adaptive execution their true size. Folders made here
are removed when the driver ends, or earlier by ``drop_staged``.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from threadloom.session import ensure_checkpoint_dir

_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, kind: str, name: str) -> str:
    """A new folder name under the checkpoint folder, removed with the staged tables."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/threadloom-{kind}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as Parquet under the checkpoint folder and return a scan of it."""
    path = scratch_path(df.sparkSession, "stage", name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """A mark for ``drop_between``."""
    return len(_made)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_between(first: int, last: int) -> None:
    """Delete the folders made between two marks: an operator's steps, once its result is staged itself."""
    for spark, path in _made[first:last]:
        _delete(spark, path)
    del _made[first:last]


def drop_staged() -> None:
    """Delete every folder made by this driver; results that still read one must be written before."""
    while _made:
        try:
            _delete(*_made.pop())
        except Exception:  # noqa: BLE001  the session, or its JVM, is gone
            return


atexit.register(drop_staged)
