"""A release for each micro-batch of a stream, until its budget is spent. An extension beyond single-table releases.

What was spent is a folder beside the stream's checkpoint with one small file for each batch. It is written before the batch is released, so
that a restart neither gives budget back nor pays twice for a batch that comes again.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.budget import Ledger

SPENT = "batch long, epsilon double, delta double"


class BatchLedger:
    """The batches of a stream that were paid for, in ``folder``, under the budget of ``total``, whose own rows count too."""

    def __init__(self, total: Ledger, folder: str):
        self.total, self.folder = total, folder.rstrip("/")

    def _there(self, spark: SparkSession) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def spent(self, spark: SparkSession) -> dict[int, tuple[float, float]]:
        """The loss of each batch; a batch whose payment was tried twice counts once."""
        rows = spark.read.schema(SPENT).parquet(self.folder).distinct().collect() if self._there(spark) else []
        return {r["batch"]: (r["epsilon"], r["delta"]) for r in rows}

    def pay(self, spark: SparkSession, batch: int, epsilon: float, delta: float) -> bool:
        """Whether the batch is new and within the budget; if so it is now paid for."""
        spent = self.spent(spark)
        if batch in spent:
            return False
        all_ = Ledger(spark, self.total.epsilon, self.total.delta, [*self.total.rows, *((f"batch {k}", e, d, False) for k, (e, d) in spent.items())])
        if not all_.fits(epsilon, delta):
            return False
        spark.createDataFrame([(batch, float(epsilon), float(delta))], SPENT).coalesce(1).write.mode("append").parquet(self.folder)
        return True


def release_batches(stream: DataFrame, spec: Any, ledger: Ledger, sink: Callable[[int, dict[str, Any]], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that hands (batch, release) to ``sink``; a batch the budget does not cover is not released.

    Batches must hold different people's rows, else one person's loss adds up over them; the ledger adds it up in any case. A batch that
    comes again after a failure was paid for and may have been seen, so it is not released a second time with other noise.
    """
    paid = BatchLedger(ledger, f"{checkpoint.rstrip('/')}-ledger")

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty() and paid.pay(batch.sparkSession, number, spec.epsilon, getattr(spec, "delta", 0.0) or 0.0):
            sink(number, spec.release(batch))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
