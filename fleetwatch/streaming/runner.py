"""Starting file-to-file streams that run to the end of the available input."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stream_settings(spark: SparkSession, idle_batches: bool = True):
    """Settings a stream copies when it starts: the RocksDB state store and one state
    partition per core, fixed for the life of its checkpoint, and whether batches without
    input run."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
              "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
              "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None,
               mode: str = "append", idle_batches: bool = True) -> DataFrame:
    """Runs the stream over what is available now and returns the written table. State with a
    time to live in processing time asks for one more batch for ever: without ``idle_batches``
    the run ends with its input."""
    spark = stream.sparkSession
    writer = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with stream_settings(spark, idle_batches):
        query = writer.start()
    query.awaitTermination()
    return spark.read.parquet(path)


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs ``fn(batch, batch_id)`` over what is available now. A batch may be repeated
    after a failure, so ``fn`` must write under its batch id and read earlier ids only."""
    with stream_settings(stream.sparkSession):
        query = (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
    query.awaitTermination()


def write_batch(df: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Replaces exactly this batch's folder."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partitions).parquet(f"{path}/batch_id={batch_id}")


@contextmanager
def batch_tables(spark: SparkSession):
    """Gives ``stored(df, purpose)``: the rows written once to a folder of their own and read again. These
    folders are deleted when the batch ends, whose output must stand by then."""
    paths: list[str] = []

    def stored(df: DataFrame, purpose: str) -> DataFrame:
        paths.append(path := work_dir(spark, purpose))
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield stored
    finally:
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def batch_head(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """The one row that the batch before this one left as its head; empty for the first. So a
    batch never reads what all earlier ones wrote."""
    from ..operators.archive import path_exists
    at = f"{path}/batch_id={batch_id - 1}"
    if not path_exists(spark, at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(at)


def earlier_batches(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """What batches before this one wrote; empty for the first, which the planner sees, so that nothing is exchanged for it."""
    from ..operators.archive import path_exists
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema).where(F.lit(False))
    rows = spark.read.schema(schema + ", batch_id bigint").parquet(path)
    return rows.where(rows.batch_id < batch_id).drop("batch_id")
