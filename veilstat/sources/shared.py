"""Frames written once to the folder that driver and executors share.

A frame with random values must not be computed twice: a lost executor would bring other values. Written, it is read again instead.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own(application: str) -> str:
    root = tempfile.mkdtemp(prefix=f"{application}-")
    atexit.register(shutil.rmtree, root, True)
    return root


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of this machine only where that is unset in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder that all executors share")
    return _own(spark.sparkContext.applicationId)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table that is removed afterwards."""
    spark = df.sparkSession
    path = f"{folder(spark)}/frame-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
