"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: Tables of this process that are still in the shared folder, in the order of writing.
_written: list[DataFrame] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = "file://" + tempfile.mkdtemp(prefix="lanewise-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage by a table in the shared folder, deleted by :func:`dropped`, at the end of :func:`scratch`, or with the process. ``options`` are those of Parquet's writer."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    _written.append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table of :func:`saved` that nothing lazy refers to any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    _written[:] = [x for x in _written if x.saved_path != df.saved_path]


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that are saved inside are deleted at the end, but for those put into the list: results must have been collected or written by then."""
    before, kept = {x.saved_path for x in _written}, []
    try:
        yield kept
    finally:
        before |= {x.saved_path for x in kept}
        for df in [x for x in _written if x.saved_path not in before]:
            dropped(df)


@atexit.register
def _drop_all() -> None:
    for df in list(_written):
        with suppress(Exception):  # the session may be gone, and its folder with it
            dropped(df)
