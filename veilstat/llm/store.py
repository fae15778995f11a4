"""Intermediate tables in the folder that driver and executors share.

A table written here cuts lineage: when an executor is lost, the stages after it read the files again instead of
running the stages before it. The folder is the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often a lambda in the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column] = lambda a, b: a + b, block: int = 256) -> Column:
    """Sums (or what ``merge`` makes, from 0 on) of an array of whole numbers up to each place.

    An array is built one entry at a time only inside blocks and over their ends, so that long arrays are not copied for each entry.
    """

    def along(xs: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            value = merge(acc["at"], x)
            return F.struct(value.alias("at"), F.concat(acc["out"], F.array(value)).alias("out"))

        return F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    cuts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))

    def joined(own: Column) -> Column:
        ends = along(F.transform(own, lambda b: F.element_at(b, -1)))
        return let(ends, lambda e: F.flatten(F.transform(own, lambda b, k: F.transform(b, lambda x: merge(F.coalesce(F.get(e, k - 1), F.lit(0)), x)))))

    return let(F.transform(cuts, lambda a: along(F.slice(values, a + 1, block))), joined)


#: Parts into which the rows of a hot key are dealt.
SALTS = 16


def salt(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int").alias("salt")


def dealt(rows: DataFrame, facts: DataFrame, key: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """Rows beside the facts of their key: a key's rows are dealt by ``by`` into ``SALTS`` parts, its facts given to each.

    Facts of many keys are never broadcast; so a key of a third of all rows, or of none (null), is not one task's at any size.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    on = [*([key] if isinstance(key, str) else key), "salt"]
    return rows.select("*", salt(by)).join(facts.select("*", salts).hint("merge"), on, how).drop("salt")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary folder of this machine only where the setting is absent (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; a cluster needs a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


@cache
def _own_dir(application: str) -> str:
    root = tempfile.mkdtemp(prefix=f"{application}-")
    atexit.register(shutil.rmtree, root, True)
    return root


#: Spark's setting by which an execution's shuffle files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Named Parquet tables of one operator run; ``drop`` removes those that no later stage reads."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Writes the table and reads it again. The shuffle files that it makes superfluous go as soon as it is written.

        Waiting for the driver to collect its garbage would keep them, and asking it to would make its heap grow: the JVM takes
        the time of such a collection as a sign that it has too little.
        """
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
