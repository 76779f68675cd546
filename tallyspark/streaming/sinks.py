"""Idempotent batch output for streams that update their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A fresh folder under ``base`` or the cluster's ``spark.checkpoint.dir``; there is no default that only one machine would see."""
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("a stream needs a shared folder: name one or set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    """Process everything there is, batch by batch, and stop. Returns the finished query."""
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    return q


def batch_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """Each batch owns its sub-folder, so a replayed batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return write


def latest_updates(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key over all batches."""
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in keys and c != "batch_id"]
    last = F.max(F.struct("batch_id", *rest))
    return rows.groupBy(*keys).agg(last.alias("l")).select(*keys, *[f"l.{c}" for c in rest])
