"""Triage of arriving messages as one Structured Streaming job.

The ids that have been triaged are kept in Spark's state store, hash-partitioned and on
the executors' disks (RocksDB), with its changes written to the checkpoint. A batch looks
up and adds its own ids, so its work depends on its own size and not on what came before;
a restarted stream goes on with the ids of the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from threadlens.session import cut_lineage, scratch, settings

Triage = Callable[[DataFrame], DataFrame]

_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def triage_stream(
    messages: DataFrame, triage: Triage, sink: str, checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Run the batch triage on every micro-batch of ``messages`` (a stream with
    message_id, message and context).

    A message is triaged once, however late it or its repetition arrives, also after a
    restart; messages without an id count as one. A batch is written under its own number
    with overwrite, so a batch replayed after a failure replaces its earlier files. What
    a batch stores for itself is deleted once it is written. A sink belongs to its
    checkpoint: with a new one, a sink that holds batches is refused."""
    spark = messages.sparkSession
    if _has_batches(spark, sink) and not _exists(spark, f"{checkpoint}/commits"):
        raise ValueError(f"{sink} was written by a stream with another checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            # The state store is asked once; the triage reads its input several times.
            fresh = cut_lineage(batch)
            triage(fresh).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    unseen = messages.dropDuplicates(["message_id"])
    writer = unseen.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    with settings(spark, _STATE):
        return writer.start()


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, name: str) -> bool:
    files, path = _path(spark, name)
    return files.exists(path)


def _has_batches(spark: SparkSession, sink: str) -> bool:
    files, path = _path(spark, sink)
    return files.exists(path) and any(
        f.getPath().getName().startswith("batch=") for f in files.listStatus(path)
    )


def read_sink(spark, sink: str) -> DataFrame:
    """All results written so far."""
    return spark.read.option("basePath", sink).parquet(f"{sink}/batch=*").drop("batch")
